"""Queries of readers, formats, discovery, languages and reports over the given tables, each with the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import text as X
from ..operators import discovery, language, latest, leads, metrics, ranking, reports, rules, scoring, taxonomy, themes
from ..operators.settle import alone, settled
from ..sources import readers, writers
from .adapters import ENRICHED, EVIDENCE, ITEMS, NOW, evidence, items, snapshots, table
from .queries import BASE, BASED, BREAKOUT, CHANNEL, ENGAGED, LABELLED, THEMES, TOPICS, VELOCITY, WEIGHT_CLASS, enriched, measured, query, rounded, rounded_scaled, z_sql


def _sql_compact(c: str) -> str:
    """compact_number in SQL, halves of the decimal value up."""
    def scaled(divisor: str, suffix: str) -> str:
        return f"rtrim(rtrim(CAST(CAST(round(CAST({c} / {divisor} AS DECIMAL(30, 8)), 1) AS DECIMAL(30, 1)) AS VARCHAR), '0'), '.') || '{suffix}'"

    return f"CASE WHEN {c} IS NULL THEN 'unknown' WHEN abs({c}) >= 1e9 THEN {scaled('1e9', 'B')} WHEN abs({c}) >= 1e6 THEN {scaled('1e6', 'M')} WHEN abs({c}) >= 1e3 THEN {scaled('1e3', 'K')} ELSE {scaled('1.0', '')} END"


# Scorers: reasons, addresses and order


@query(f"""WITH {ENRICHED}, {BREAKOUT}
SELECT video_id, row_number() OVER (ORDER BY score DESC, views DESC, video_id) AS place, {_sql_compact('views_per_sub')} || 'x views/sub: ' || {_sql_compact('views')} || ' views on ' || {_sql_compact('subscribers')} || ' subscribers' AS reason,
       'https://www.youtube.com/watch?v=' || video_id AS video_url, 'https://www.youtube.com/channel/' || channel_id AS channel_url FROM breakout""")
def breakout_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The breakout scorer's rows in their order, with what each says."""
    out = _placed(scoring.breakout_outliers(enriched(spark, sf_dir)))
    return out.select("video_id", "place", "reason", "video_url", "channel_url")


def _placed(result: DataFrame) -> DataFrame:
    """A scorer's result with its places in the order of `ranked`, counted by score so that no task orders all rows."""
    result = settled(result)  # read twice, scored once
    ranks = ranking.cumulative(ranking.histogram(result, [], "score"), []).select(F.col("v").alias("score"), F.col("n") - F.col("before") - F.col("c"))
    ahead = ranks.toDF("score", "_ahead")
    tied = F.row_number().over(latest.Window.partitionBy("score").orderBy(F.desc_nulls_last("views"), "video_id"))
    return result.join(ahead, "score").withColumn("place", (F.col("_ahead") + tied).cast("long")).drop("_ahead")


@query(f"""WITH {ENRICHED}, {CHANNEL} SELECT video_id, row_number() OVER (ORDER BY score DESC, views DESC, video_id) AS place,
       {_sql_compact('mult')} || 'x the channel''s median of ' || {_sql_compact('m')} || ' over ' || n || ' other videos' AS reason FROM channel""")
def channel_relative_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(scoring.channel_relative(enriched(spark, sf_dir), min_multiple=3)).select("video_id", "place", "reason")


@query(f"""WITH {ENRICHED}, {WEIGHT_CLASS} SELECT video_id, 'top ' || CAST(round(CAST(greatest(0.1, (1 - score) * 100) AS DECIMAL(30, 12)), 1) AS DECIMAL(30, 1)) || '% of ' || sub_class || ' subscribers / ' || video_count_class || ' videos' AS reason,
       round(pct_views, 9) AS pct_views, round(pct_views_per_sub, 9) AS pct_views_per_sub FROM weight_class""")
def weight_class_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scoring.weight_class_performance(measured(spark, sf_dir))
    return rounded(out.select("video_id", "reason", "pct_views", "pct_views_per_sub"), ["pct_views", "pct_views_per_sub"], 9)


@query(f"WITH {ENRICHED}, {z_sql('comment_rate', 'cz')} SELECT e.video_id, round(p.centre, 9) AS center FROM enriched e JOIN cz_pick p USING (sub_class)")
def robust_centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = settled(metrics.add_classes(metrics.add_item_metrics(items(spark, sf_dir), NOW)).select("video_id", "sub_class", "comment_rate"))
    return rounded(ranking.robust_z(df, "sub_class", "comment_rate", "z", "source", "center").select("video_id", "center"), ["center"], 9)


@query(f"""WITH {ENRICHED}, p AS (SELECT * FROM enriched WHERE views >= 50000)
SELECT video_id, round(views_per_sub, 6) AS views_per_sub FROM p WHERE views_per_sub >= (SELECT quantile_cont(views_per_sub, 0.99) FROM p) ORDER BY p.views_per_sub DESC, video_id LIMIT 2000""")
def fallback_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(themes.fallback_leads(enriched(spark, sf_dir)).select("video_id", "views_per_sub"), ["views_per_sub"])


_STACK = {"breakout_outliers": ("1.35", "breakout"), "weight_class_performance": ("1.35", "weight_class"), "channel_relative": ("1.05", "channel"), "velocity": ("0.85", "(SELECT * FROM vb WHERE views >= 10000 AND score >= 10)"), "engagement": ("0.60", "engagement")}


@query(f"""WITH {ENRICHED}, {BREAKOUT}, {WEIGHT_CLASS}, {CHANNEL}, {VELOCITY}, {ENGAGED},
stack AS ({" UNION ALL ".join(f"SELECT {k} AS k, '{n}' AS name, {w} AS w, video_id, score, cume_dist() OVER (ORDER BY score) AS s FROM {t}" for k, (n, (w, t)) in enumerate(_STACK.items()))}),
blend AS (SELECT video_id, count(*) AS hits, string_agg(name, ',' ORDER BY k) AS algorithms, sum(s * w) * (1 + 0.12 * (count(*) - 1)) AS total, {", ".join(f"coalesce(max(s) FILTER (name = '{n}'), 0) AS score_{n}" for n in _STACK)} FROM stack GROUP BY video_id)
SELECT video_id, CAST(hits AS INTEGER) AS algorithms_hit, algorithms, round(CAST(total AS DOUBLE), 9) AS composite_score, {", ".join(f"round(score_{n}, 9) AS score_{n}" for n in _STACK)}, title, channel_id, channel_name, subscribers, views, sub_class, video_count_class, category_id
FROM blend JOIN enriched USING (video_id)""")
def blended_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five scorers over the whole tables, normalised, blended, with the identity of each lead."""
    df = enriched(spark, sf_dir)
    scorers = {
        "breakout_outliers": lambda: scoring.breakout_outliers(df), "weight_class_performance": lambda: scoring.weight_class_performance(df), "channel_relative": lambda: scoring.channel_relative(df, min_multiple=3),
        "velocity": lambda: scoring.velocity(df, snapshots(spark, sf_dir), max_age_days=9000, min_score=10), "engagement": lambda: scoring.engagement(df),
    }
    found = {n: alone(spark, lambda make=make: make().select("video_id", "score", "reason")) for n, make in scorers.items()}  # titles and the like come from df
    out = leads.combine(leads.normalize_scores(found), df)
    names = ["composite_score", *[f"score_{n}" for n in found]]
    return rounded(out.select("video_id", "algorithms_hit", "algorithms", *names, "title", "channel_id", "channel_name", "subscribers", "views", "sub_class", "video_count_class", "category_id"), names, 9)


@query(f"""WITH {ITEMS}, {THEMES},
mt AS (SELECT video_id, unnest(list_distinct(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])))) AS term FROM tl),
mk AS (SELECT video_id, term, lift, burst, lead_count FROM mt JOIN th USING (term) QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY lift DESC, term) <= 5),
mi AS (SELECT video_id, sum(ln(1 + lift) * ln(1 + lead_count) * sqrt(greatest(burst, 0))) AS strength, avg(lift) AS theme_lift, avg(burst) AS theme_burst, string_agg(term, ' | ' ORDER BY lift DESC, term) AS matched_terms FROM mk GROUP BY video_id),
sa AS (SELECT i.category_id, count(DISTINCT l.video_id) / count(DISTINCT i.video_id) / ln(1 + greatest(count(DISTINCT i.channel_id), 1)) AS sat FROM items i LEFT JOIN lead l USING (video_id) GROUP BY i.category_id)
SELECT lead.video_id, coalesce(matched_terms, '') AS matched_terms, round(coalesce(theme_lift, 0), 6) AS theme_lift, round(coalesce(theme_burst, 1), 6) AS theme_burst,
       round(round(coalesce(strength, 0) * (1 + 0.35 * sat / (SELECT max(sat) FROM sa)), 9), 6) AS score
FROM lead LEFT JOIN mi USING (video_id) LEFT JOIN sa ON sa.category_id = lead.category_id""")
def uncapped_topic_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topic scores of all leads, before repeated terms are capped."""
    df = settled(items(spark, sf_dir))
    out = themes.score_topics(df, df.filter("views >= 300000"), themes.ThemeParams(max_term_repeats=None))
    return rounded_scaled(out.select("video_id", "matched_terms", "theme_lift", "theme_burst", "score"), ["theme_lift", "theme_burst", "score"])


# Topics with the cap on repeated terms, and the whole blend

_LEAD = "lead AS (SELECT * FROM items WHERE views >= 300000),\n"
assert _LEAD in THEMES
#: Topic scores of the rows of a table `lead`, capped: as table topics. A row stays if it is among the first three of one of its terms.
TOPIC_SCORES = THEMES.replace(_LEAD, "").replace("GROUP BY term HAVING count(*) >= 3)", "GROUP BY term HAVING count(*) >= 3 QUALIFY row_number() OVER (ORDER BY count(*) DESC, term) <= 5000)") + """,
mt AS (SELECT video_id, unnest(list_distinct(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])))) AS term FROM tl),
mk AS (SELECT video_id, term, lift, burst, lead_count, row_number() OVER (PARTITION BY video_id ORDER BY lift DESC, term) AS k FROM mt JOIN th USING (term) QUALIFY k <= 5),
mi AS (SELECT video_id, sum(ln(1 + lift) * ln(1 + lead_count) * sqrt(greatest(burst, 0))) AS strength, avg(lift) AS theme_lift, avg(burst) AS theme_burst, string_agg(term, ' | ' ORDER BY k) AS matched_terms FROM mk GROUP BY video_id),
sa AS (SELECT i.category_id, count(DISTINCT l.video_id) / count(DISTINCT i.video_id) / ln(1 + greatest(count(DISTINCT i.channel_id), 1)) AS sat FROM items i LEFT JOIN lead l USING (video_id) GROUP BY i.category_id),
ta AS (SELECT lead.*, coalesce(matched_terms, '') AS matched_terms, coalesce(mi.theme_lift, 0) AS theme_lift, coalesce(mi.theme_burst, 1) AS theme_burst, round(coalesce(strength, 0) * (1 + 0.35 * sat / (SELECT max(sat) FROM sa)), 9) AS score
       FROM lead LEFT JOIN mi USING (video_id) LEFT JOIN sa ON sa.category_id = lead.category_id),
topics AS (SELECT * FROM ta WHERE matched_terms = '' OR video_id IN (SELECT video_id FROM mk JOIN ta USING (video_id) QUALIFY row_number() OVER (PARTITION BY term ORDER BY score DESC, views DESC NULLS LAST, video_id) <= 3))"""


@query(f"""WITH {ENRICHED}, {BREAKOUT}, lead AS (SELECT * EXCLUDE (score) FROM breakout), {TOPIC_SCORES}
SELECT video_id, round(score, 6) AS score, CASE WHEN matched_terms <> '' THEN 'themes ' || matched_terms || ' (lift ' || CAST(round(CAST(theme_lift AS DECIMAL(30, 12)), 1) AS DECIMAL(30, 1)) || ')' ELSE 'no recurring theme' END AS reason, title, channel_name, subscribers, views,
       matched_terms, round(theme_lift, 6) AS theme_lift, round(theme_burst, 6) AS theme_burst, 'Unknown (' || category_id || ')' AS category_name, 'https://www.youtube.com/watch?v=' || video_id AS video_url, 'https://www.youtube.com/channel/' || channel_id AS channel_url FROM topics""")
def topic_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leads by title themes, with the greedy cap on repeats."""
    corpus = measured(spark, sf_dir)
    out = themes.score_topics(corpus, scoring.breakout_outliers(corpus), themes.ThemeParams(max_terms=5_000))  # as the SQL of TOPIC_SCORES
    return rounded_scaled(out, ["score", "theme_lift", "theme_burst"])


_KEPT = ENRICHED.replace("items AS (\n", "all_items AS (\n").replace("aged AS (", "items AS (SELECT * FROM all_items WHERE duration_seconds > 60 OR duration_seconds IS NULL),\naged AS (")
_ALL = {**_STACK, "topics": ("0.35", "topics")}
_SCORED = " UNION ALL ".join(f"SELECT '{n}' AS name, video_id, score FROM {t}" for n, (_, t) in _STACK.items())
_MORE = ["views_per_sub", "channel_relative_multiple", "comment_rate", "video_age_days"]


@query(f"""WITH {_KEPT}, {BREAKOUT}, {WEIGHT_CLASS}, {CHANNEL}, {VELOCITY}, {ENGAGED}, {BASED}, scored AS ({_SCORED}),
best AS (SELECT DISTINCT video_id FROM (SELECT video_id, row_number() OVER (PARTITION BY name ORDER BY score DESC, video_id) AS k FROM scored) WHERE k <= 1000),
input AS (SELECT u.video_id FROM (SELECT video_id, max(score) AS score FROM scored GROUP BY video_id) u LEFT JOIN best ON best.video_id = u.video_id ORDER BY best.video_id IS NULL, score DESC, u.video_id LIMIT 5000),
lead AS (SELECT e.* FROM input JOIN enriched e USING (video_id)), {TOPIC_SCORES},
stack AS ({" UNION ALL ".join(f"SELECT {k} AS k, '{n}' AS name, {w} AS w, video_id, score, cume_dist() OVER (ORDER BY score) AS s FROM {t}" for k, (n, (w, t)) in enumerate(_ALL.items()))}),
blend AS (SELECT video_id, count(*) AS hits, string_agg(name, ',' ORDER BY k) AS algorithms, sum(s * w) * (1 + 0.12 * (count(*) - 1)) AS total,
          {", ".join(f"coalesce(max(s) FILTER (name = '{n}'), 0) AS score_{n}, max(score) FILTER (name = '{n}') AS raw_{n}" for n in _ALL)} FROM stack GROUP BY video_id)
SELECT video_id, round(CAST(total AS DOUBLE), 6) AS composite_score, CAST(hits AS INTEGER) AS algorithms_hit, algorithms, CAST(NULL AS BOOLEAN) AS is_short_confirmed, {", ".join(f"round(CAST(score_{n} AS DOUBLE), 6) AS score_{n}, round(raw_{n}, 5) AS raw_{n}" for n in _ALL)},
       title, channel_id, channel_name, subscribers, video_count, views, comments, round(views_per_sub, 6) AS views_per_sub, round(CASE WHEN channel_video_sample >= 5 THEN views / m END, 6) AS channel_relative_multiple, round(comment_rate, 6) AS comment_rate, published_at,
       round(video_age_days, 6) AS video_age_days, sub_class, video_count_class, category_id, CAST(NULL AS VARCHAR) AS channel_language, CAST(NULL AS VARCHAR) AS language_source, 'https://www.youtube.com/watch?v=' || video_id AS video_url, 'https://www.youtube.com/channel/' || channel_id AS channel_url
FROM blend JOIN based USING (video_id)""")
def composite_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All six scorers over items and history, blended."""
    options = {"channel_relative": {"min_multiple": 3}, "velocity": {"max_age_days": 9000, "min_score": 10}, "topics": {"max_terms": 5_000}}  # the terms as in TOPIC_SCORES
    out = leads.generate_leads(items(spark, sf_dir), NOW, snapshots(spark, sf_dir), params=options)
    out = rounded_scaled(out.drop("reasons"), ["composite_score", *[c for c in out.columns if c.startswith("score_")], *_MORE])
    return rounded_scaled(out, [c for c in out.columns if c.startswith("raw_")], 5)


_WARM = f"""WITH RECURSIVE {ITEMS}, {BASE}, {LABELLED}, verdicts AS (SELECT CAST(o_orderkey AS VARCHAR) AS video_id FROM orders WHERE o_orderstatus = 'P'),
candidates AS (SELECT video_id, topic, confidence, lower(trim(title)) AS title, channel_id, views, row_number() OVER (ORDER BY confidence DESC, views DESC, video_id, topic) AS k FROM labelled
  WHERE confidence >= 2 AND views >= 10000 AND duration_seconds > 60 AND video_id NOT IN (SELECT video_id FROM verdicts) AND CAST('0x' || substr(sha256(channel_id), 1, 8) AS BIGINT) % 1000 < 350),
fold(k, kept, titles, parents, topics) AS (
  SELECT CAST(0 AS BIGINT), false, CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[])
  UNION ALL
  SELECT k, keep, CASE WHEN keep THEN list_append(titles, title) ELSE titles END, CASE WHEN keep THEN list_append(parents, channel_id) ELSE parents END, CASE WHEN keep THEN list_append(topics, topic) ELSE topics END
  FROM (SELECT c.k, titles, parents, topics, c.title, c.channel_id, c.topic, NOT list_contains(titles, c.title) AND len(list_filter(parents, lambda x: x = c.channel_id)) < CASE WHEN c.confidence >= 4 THEN 3 ELSE 2 END
               AND len(list_filter(topics, lambda x: x = c.topic)) < 40 AS keep FROM fold JOIN candidates c ON c.k = fold.k + 1))
SELECT video_id, topic, CAST(confidence AS INTEGER) AS confidence, channel_id, views FROM candidates JOIN fold USING (k) WHERE kept"""


@query(_WARM)
def warm_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every labelled item of the WARM pool that the caps by title, parent and topic leave; the draw of a few is off."""
    corpus = items(spark, sf_dir)
    labelled = taxonomy.classify(corpus, TOPICS)
    verdicts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("video_id"), (F.col("o_orderstatus") == "P").alias("is_short"))
    out = discovery.warm_items(labelled, corpus, verdicts, TOPICS.version, least_confidence=2, per_topic=40, n=None)
    return out.select("video_id", "topic", "confidence", "channel_id", "views")


# Many rules at once


@query(f"""WITH {ITEMS}, named AS (SELECT DISTINCT p_name AS term FROM part), typed AS (SELECT DISTINCT lower(split_part(p_name, ' ', 1)) AS word, left(lower(split_part(p_name, ' ', 2)), 3) AS stem FROM part),
wanted AS (SELECT 'leads:title:' || term AS rule, ' ' || term || ' ' AS a, ' ' AS b FROM named UNION SELECT 'corpus:title:' || CASE WHEN word < stem || '*' THEN word || '&' || stem || '*' ELSE stem || '*&' || word END, ' ' || word || ' ', ' ' || stem FROM typed)
SELECT rule, count(video_id) AS matched_rows FROM wanted LEFT JOIN items ON contains(' ' || title || ' ', a) AND contains(' ' || title || ' ', b) GROUP BY rule""")
def many_rules_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of every part's name, and of every first word with the stem of a second one, over all items by the index."""
    names = [r[0] for r in table(spark, sf_dir, "part").select("p_name").distinct().collect()]  # rules are the driver's
    found = [rules.Rule((n,)) for n in names] + [rules.Rule((n.split(" ")[0], n.split(" ")[1][:3] + "*"), scope="corpus") for n in names]
    return rules.reach(items(spark, sf_dir), found).select("rule", "matched_rows")


# Readers: parents with fallback sources, API payloads, profiles

_ID = "'UC' || lpad(CAST({k} AS VARCHAR), 22, '0')"


def _canonical(c: str) -> Column:
    return F.concat(F.lit("UC"), F.lpad(F.col(c).cast("string"), 22, "0"))


@query(f"""WITH c AS (SELECT {_ID.format(k='c_custkey')} AS channel_id, c_custkey AS k, c_name, c_acctbal AS subscribers, c_mktsegment = 'BUILDING' AS lost, c_nationkey FROM customer)
SELECT channel_id, CASE WHEN NOT lost THEN c_name WHEN k % 2 = 1 THEN 'profile ' || k END AS channel_name, CAST(subscribers + CASE WHEN NOT lost THEN 1 ELSE 0 END AS DOUBLE) AS subscribers,
       CASE WHEN NOT lost OR k % 2 = 0 THEN TIMESTAMP '2000-01-01' + to_days(CAST(k % 1000 AS INTEGER)) END AS channel_published_at FROM c""")
def parents_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as parents: the newest of two snapshots, but those of one segment only by a profile under their name or by statistics under their id."""
    c = table(spark, sf_dir, "customer").withColumns({"channel_id": _canonical("c_custkey"), "day": F.expr("timestamp '2000-01-01 00:00:00' + make_dt_interval(cast(c_custkey % 1000 as int))")})
    have, lost = c.filter("c_mktsegment <> 'BUILDING'"), c.filter("c_mktsegment = 'BUILDING'")
    taken = have.select("channel_id", F.col("c_name").alias("channel_name"), F.explode(F.array(F.lit(0), F.lit(1))).alias("id"), "c_acctbal", F.col("day").alias("channel_published_at"))
    taken = taken.select("channel_id", "channel_name", "id", (F.col("c_acctbal") + F.col("id")).cast("string").alias("subscribers"), F.lit("1").alias("video_count"), F.lit("xx").alias("country"), "channel_published_at", F.lit("2001-01-01").alias("collected_at"))
    profiles = lost.select(F.upper("c_name").alias("channel_key"), F.lit(None).cast("string").alias("channel_id"), F.concat(F.lit("profile "), F.col("c_custkey").cast("string")).alias("channel_name"), F.col("c_acctbal").cast("string").alias("subscribers"), F.lit(None).cast("string").alias("channel_published_at"))
    stats = lost.filter("c_custkey % 2 = 0").select(F.lit(None).cast("string").alias("channel_key"), "channel_id", F.col("c_acctbal").cast("string").alias("subscribers"), F.col("day").cast("string").alias("channel_published_at"))
    mapping = lost.select(F.lower("c_name").alias("channel_key"), "channel_id").unionByName(lost.select(F.lower("channel_id").alias("channel_key"), "channel_id"))
    found = readers.latest_parents(taken, c.select("channel_id"), profiles, stats, mapping)
    return found.select("channel_id", "channel_name", "subscribers", F.col("channel_published_at").cast("timestamp").alias("channel_published_at"))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS video_id, CAST(o_custkey AS VARCHAR) AS channel_id, o_orderdate AS published_at, CAST(3600 * (o_orderkey % 3) + o_orderkey % 60 AS BIGINT) AS duration_seconds,
       CASE WHEN o_orderkey % 5 <> 0 THEN CAST(floor(o_totalprice) AS BIGINT) END AS views, CASE WHEN o_orderkey % 7 = 0 THEN 'de' END AS default_audio_language FROM orders WHERE o_orderkey % 11 <> 0""")
def api_item_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as landed API pages of a customer each, read back as items; every eleventh has no parent, every fifth an empty count."""
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    made = F.to_json(F.struct(F.collect_list(F.struct(
        key.cast("string").alias("id"),
        F.struct(F.when(key % 11 != 0, F.col("o_custkey").cast("string")).alias("channelId"), F.col("o_orderdate").cast("timestamp").cast("string").alias("publishedAt"), F.when(key % 7 == 0, "de").alias("defaultAudioLanguage")).alias("snippet"),
        F.struct(F.when(key % 5 == 0, "").otherwise(F.floor("o_totalprice").cast("string")).alias("viewCount")).alias("statistics"),
        F.struct(F.concat(F.lit("PT"), (key % 3).cast("string"), F.lit("H"), (key % 60).cast("string"), F.lit("S")).alias("duration")).alias("contentDetails"),
    )).alias("items")))
    pages = o.groupBy("o_custkey").agg(made.alias("j")).select(F.from_json("j", readers.VIDEO_PAYLOAD).alias("p")).select("p.items")
    return readers.video_rows(pages).select("video_id", "channel_id", "published_at", "duration_seconds", "views", "default_audio_language")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS video_id, 'de' AS default_audio_language, CAST(NULL AS VARCHAR) AS default_language FROM orders WHERE o_orderkey % 7 = 0")
def api_language_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The languages alone of API pages, for a backfill: items without any go."""
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    made = F.to_json(F.struct(F.collect_list(F.struct(key.cast("string").alias("id"), F.struct(F.when(key % 7 == 0, "de").alias("defaultAudioLanguage")).alias("snippet"))).alias("items")))
    pages = o.groupBy("o_custkey").agg(made.alias("j")).select(F.from_json("j", readers.VIDEO_PAYLOAD).alias("p")).select("p.items")
    return readers.language_rows(pages)


@query("SELECT 'stats' AS source, 's' || s_suppkey AS channel_id, s_name AS channel_name, CAST(CAST(floor(s_acctbal) AS BIGINT) AS VARCHAR) AS subscribers_total, 0 AS texts, CAST(NULL AS VARCHAR) AS engagement FROM supplier")
def common_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("channel_id"), F.col("s_name").alias("channel_name"), F.floor("s_acctbal").alias("subscribers_total"), F.lit(1).alias("other"))
    return S.channel_profile(s, "stats").select("source", "channel_id", "channel_name", "subscribers_total", F.size("raw_rendered_text").alias("texts"), "engagement")


# Formats


@query("""WITH t AS (SELECT p_partkey, p_size, p_retailprice FROM part)
SELECT p_partkey, CAST(floor(p_retailprice * 10) / 10 * 1000 AS BIGINT) AS parsed, CAST(p_size * 3600 + p_size * 60 + p_size AS BIGINT) AS seconds,
       TIMESTAMP '2001-01-01' - to_days(CAST(7 * p_size AS INTEGER)) AS published_at, 'b' || p_partkey AS after, [CAST(p_size AS VARCHAR)] AS between_lines, 'a' || p_partkey AS first_id FROM t""")
def parsed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, durations, ages, labelled lines and identifiers written out from the parts and parsed again."""
    p = table(spark, sf_dir, "part")
    size, key = F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    lines = F.array(F.lit("top"), F.lit("Label"), F.concat(F.lit("b"), key), F.lit("From"), size, F.lit("To"))
    return p.select(
        "p_partkey", S.parse_compact_number(F.concat(F.format_string("%.1f", F.floor(F.col("p_retailprice") * 10) / 10), F.lit("K views"))).alias("parsed"),
        S.iso_duration_seconds(F.concat(F.lit("PT"), size, F.lit("H"), size, F.lit("M"), size, F.lit("S"))).alias("seconds"),
        S.relative_age_to_time(F.concat(size, F.lit(" weeks ago")), F.lit("2001-01-01").cast("timestamp")).alias("published_at"),
        S.after_label(lines, "Label").alias("after"), S.between_labels(lines, "From", "To").alias("between_lines"), F.get(S.identifiers(F.concat(F.lit("a"), key), F.lit("UC1")), 0).alias("first_id"),
    )


@query("""WITH n AS (SELECT event_id, value FROM events) SELECT event_id, """ + _sql_compact("value * 1000") + """ AS short, round(CASE WHEN value IS NULL THEN 0 ELSE sign(value) * ln(1 + abs(value)) END, 9) AS compressed FROM n""")
def number_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return rounded(e.select("event_id", S.compact_number(F.col("value") * 1000).alias("short"), S.log_compress(F.col("value")).alias("compressed")), ["compressed"], 9)


# Discovery and verdicts


@query("""WITH v AS (SELECT user_id, event_type = 'error' AS is_live, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1),
u AS (SELECT * FROM v WHERE NOT is_live OR date_diff('microsecond', ts, (SELECT max(ts) FROM events)) <= 864000000000)
SELECT CAST(o_orderkey AS VARCHAR) AS video_id FROM orders LEFT JOIN u ON u.user_id = o_custkey WHERE coalesce(NOT is_live, true) AND o_orderdate >= TIMESTAMP '2001-09-01' - INTERVAL 900 DAY""")
def fresh_items_not_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recent items whose parent isn't known to be live, old verdicts that say live being forgotten."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("video_id"), (F.col("event_type") == "error").alias("is_live"), F.col("ts").cast("timestamp").alias("checked_at"), F.col("event_id").alias("id"))
    now = str(e.agg(F.max("checked_at")).first()[0])
    verdicts = metrics.usable_liveness(latest.latest(e, "video_id", "checked_at"), now, 10)
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("video_id"), F.col("o_orderkey").cast("string").alias("item"), F.col("o_orderdate").cast("timestamp").alias("at"))
    kept = metrics.drop_known(metrics.recent(orders, "at", NOW, 900, False), verdicts, "is_live", True)
    return kept.select(F.col("item").alias("video_id"))


_FEED = "feed AS (SELECT CASE WHEN l_suppkey % 2 = 0 THEN 'UC' || lpad(CAST(l_suppkey AS VARCHAR), 22, '0') ELSE ' Handle' || l_suppkey END AS channel_id, l_shipdate AS published_at, l_shipdate + INTERVAL 1 DAY AS observed_at, 'n' || l_linenumber AS channel_name FROM lineitem)"


def _feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    day = F.col("l_shipdate").cast("timestamp")
    return lines.select(F.when(F.col("l_suppkey") % 2 == 0, _canonical("l_suppkey")).otherwise(F.concat(F.lit(" Handle"), F.col("l_suppkey").cast("string"))).alias("channel_id"), day.alias("published_at"), (day + F.expr("interval 1 day")).alias("observed_at"), F.concat(F.lit("n"), F.col("l_linenumber").cast("string")).alias("channel_name"))


@query(f"""WITH {_FEED} SELECT lower(trim(channel_id)) AS channel_key, max(published_at) AS last_published_at, max(observed_at) AS last_seen_at, max(CASE WHEN channel_id LIKE 'UC%' THEN channel_id END) AS canonical_id FROM feed GROUP BY 1""")
def feed_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.feed_state(_feed(spark, sf_dir)).select("channel_key", "last_published_at", "last_seen_at", "canonical_id")


_STATE = """state AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'uc' || lpad(CAST(s_suppkey AS VARCHAR), 22, '0') ELSE 'handle' || s_suppkey END AS channel_key, TIMESTAMP '1995-01-01' AS last_published_at, TIMESTAMP '1995-01-02' AS last_seen_at,
  CASE WHEN s_suppkey % 5 = 0 THEN TIMESTAMP '2001-08-01' WHEN s_suppkey % 5 = 1 THEN TIMESTAMP '2001-08-30' END AS last_success_at, s_suppkey % 7 = 0 AS under_review, s_suppkey % 11 = 0 AS eligible, s_suppkey % 4 AS attempts FROM supplier WHERE s_suppkey % 3 <> 0)"""


def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, k = table(spark, sf_dir, "supplier").filter("s_suppkey % 3 <> 0"), F.col("s_suppkey")
    return s.select(
        F.when(k % 2 == 0, F.lower(_canonical("s_suppkey"))).otherwise(F.concat(F.lit("handle"), k.cast("string"))).alias("channel_key"), F.lit(None).cast("string").alias("canonical_id"),
        F.lit("1995-01-01").cast("timestamp").alias("last_published_at"), F.lit("1995-01-02").cast("timestamp").alias("last_seen_at"),
        F.when(k % 5 == 0, "2001-08-01").when(k % 5 == 1, "2001-08-30").cast("timestamp").alias("last_success_at"), (k % 7 == 0).alias("under_review"), (k % 11 == 0).alias("eligible"), (k % 4).cast("long").alias("attempts"),
    )


@query(f"""WITH {_FEED}, {_STATE}, f AS (SELECT lower(trim(channel_id)) AS channel_key, max(published_at) AS p, max(observed_at) AS o FROM feed GROUP BY 1)
SELECT coalesce(s.channel_key, f.channel_key) AS channel_key, greatest(coalesce(p, last_published_at), coalesce(last_published_at, p)) AS last_published_at, greatest(coalesce(o, last_seen_at), coalesce(last_seen_at, o)) AS last_seen_at,
       coalesce(under_review, false) AS under_review, CASE WHEN s.channel_key IS NULL THEN true WHEN o IS NOT NULL AND NOT under_review AND (last_success_at IS NULL OR last_success_at < TIMESTAMP '{NOW}' - INTERVAL 14 DAY) THEN true ELSE eligible END AS eligible
FROM state s FULL JOIN f ON s.channel_key = f.channel_key""")
def refreshed_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = discovery.refresh_state(discovery.feed_state(_feed(spark, sf_dir)), _state(spark, sf_dir), NOW)
    return out.select("channel_key", "last_published_at", "last_seen_at", "under_review", "eligible")


@query(f"WITH {_FEED}, {_STATE} SELECT DISTINCT lower(trim(channel_id)) AS channel_key FROM feed WHERE lower(trim(channel_id)) NOT IN (SELECT channel_key FROM state)")
def new_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.new_parents(_feed(spark, sf_dir), _state(spark, sf_dir))


@query(f"WITH {_STATE} SELECT channel_key, CAST(attempts AS BIGINT) AS attempts FROM state WHERE attempts > 0 AND last_success_at IS NULL AND NOT under_review")
def pending_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.pending_work(_state(spark, sf_dir)).select("channel_key", "attempts")


@query(f"""WITH {EVIDENCE}, t AS (SELECT channel_key, matched_topic AS topic, max(confidence) AS c, count(DISTINCT video_id) AS h, count(DISTINCT seed_video_id) AS s FROM evidence WHERE matched_topic IS NOT NULL GROUP BY ALL),
q AS (SELECT channel_key, max(c) AS c, arg_max(h, topic) AS h, arg_max(s, topic) AS s FROM t GROUP BY channel_key)
SELECT channel_key, CAST(row_number() OVER (ORDER BY s DESC, h DESC, c DESC, channel_key) AS INTEGER) AS place FROM q WHERE channel_key NOT IN (SELECT 's' || s_suppkey FROM supplier WHERE s_suppkey % 4 = 0)
QUALIFY place <= 40""")
def queue_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first parents of the interest queue, those already promoted left out."""
    promoted = table(spark, sf_dir, "supplier").filter("s_suppkey % 4 = 0").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("channel_key"))
    queue = discovery.set_status(discovery.rebuild_queue(evidence(spark, sf_dir), "terms-1"), promoted, "promoted")
    head = discovery.read_queue(queue, 40)
    place = F.row_number().over(latest.Window.orderBy(F.desc("seed_count"), F.desc("hit_count"), F.desc("best_confidence"), "channel_key"))  # at most 40 rows
    return head.select("channel_key", place.alias("place"))


_TAGGED = "tagged AS (SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS video_id, CAST(o_custkey AS VARCHAR) AS channel_id, o_orderdate AS published_at, o_orderpriority = '1-URGENT' AS has FROM orders)"


@query(f"WITH {_TAGGED} SELECT video_id, channel_id, published_at FROM tagged WHERE NOT has QUALIFY row_number() OVER (PARTITION BY channel_id ORDER BY published_at DESC, video_id) <= 2")
def untagged_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("video_id"), F.col("o_custkey").cast("string").alias("channel_id"), F.col("o_orderdate").cast("timestamp").alias("published_at"), F.when(F.col("o_orderpriority") == "1-URGENT", "en").alias("default_audio_language"), F.lit(None).cast("string").alias("default_language"))
    return discovery.untagged_items(o, 2).select("video_id", "channel_id", "published_at")


@query("SELECT '@' || c_custkey AS handle FROM customer WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE contains(lower(s_name), CAST(c_custkey AS VARCHAR)))")
def unknown_handles(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = table(spark, sf_dir, "customer").select(F.concat(F.lit("@"), F.col("c_custkey").cast("string")).alias("handle"))
    return discovery.known_profile(new, table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name")))


# Joined snapshots, flags, feeds, rows of statistics


@query(f"""WITH c AS (SELECT {_ID.format(k='c_custkey')} AS channel_id, c_name AS channel_name, CAST(c_acctbal AS DOUBLE) AS subscribers FROM customer WHERE c_mktsegment <> 'BUILDING')
SELECT CAST(o_orderkey AS VARCHAR) AS video_id, {_ID.format(k='o_custkey')} AS channel_id, CAST(o_totalprice AS DOUBLE) + 1 AS views, CASE WHEN o_orderkey % 3 = 0 THEN 'de' END AS default_language, channel_name, subscribers
FROM orders LEFT JOIN c ON c.channel_id = {_ID.format(k='o_custkey')}""")
def joined_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as two snapshots each, the newest joined to its parent; a language that only the older one has stays, and a segment's customers aren't known."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").filter("c_mktsegment <> 'BUILDING'")
    snaps = o.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("n"), "*").select(
        F.col("n").alias("id"), F.col("o_orderkey").cast("string").alias("video_id"), _canonical("o_custkey").alias("channel_id"), F.concat(F.lit("2001-01-0"), (F.col("n") + 1).cast("string")).alias("collected_at"),
        (F.col("o_totalprice") + F.col("n")).cast("string").alias("views"), F.when((F.col("n") == 0) & (F.col("o_orderkey") % 3 == 0), "de").alias("default_language"), F.lit(None).cast("string").alias("title"), F.lit("bad").alias("likes"),
    )
    parents = c.select(_canonical("c_custkey").alias("channel_id"), F.col("c_name").alias("channel_name"), F.col("c_acctbal").cast("string").alias("subscribers"), F.lit("1").alias("video_count"), F.lit("xx").alias("country"), F.lit(None).cast("string").alias("channel_published_at"), F.lit("2001-01-01").alias("collected_at"), F.lit(1).alias("id"))
    out = readers.joined(readers.latest_items(snaps), readers.latest_parents(parents))
    return out.select("video_id", "channel_id", "views", "default_language", "channel_name", "subscribers")


@query(f"WITH {ITEMS} SELECT video_id, duration_seconds <= 180 AS is_short FROM items")
def short_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.add_short_flag(items(spark, sf_dir), 180).select("video_id", "is_short")


@query("""WITH f AS (SELECT user_id, event_type, ts AS observed_at, ts - CASE event_type WHEN 'click' THEN INTERVAL 3 HOUR WHEN 'view' THEN INTERVAL 14 DAY ELSE INTERVAL 0 DAY END AS published_at, (SELECT max(ts) FROM events) AS now FROM events)
SELECT user_id, event_type, observed_at, published_at FROM f WHERE observed_at >= now - INTERVAL 10 DAY QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY observed_at DESC) = 1""")
def stored_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as feed records whose age text tells the publish time, within the retention, each user's kind of event once."""
    e = table(spark, sf_dir, "events").withColumn("observed_at", F.col("ts").cast("timestamp"))
    now = e.agg(F.max("observed_at").cast("string")).first()[0]
    ages = F.when(F.col("event_type") == "click", "3 hours ago").when(F.col("event_type") == "view", "Streamed 2 weeks ago").otherwise("just now")
    return writers.feed_table(e.select("user_id", "event_type", "observed_at", ages.alias("age_text")), now, ["user_id", "event_type"], 10).select("user_id", "event_type", "observed_at", "published_at")


@query("""SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, CAST(o_orderkey % 90 AS BIGINT) * 1000 AS followers_change, CAST(o_orderkey AS BIGINT) AS followers, CAST(NULL AS BIGINT) AS views_change, CAST(o_orderkey % 7 AS BIGINT) * 1000000 + 500000 AS views,
       '$' || o_orderkey % 5 AS earnings_low, '$' || o_orderkey % 5 || 'K' AS earnings_high FROM orders WHERE o_orderkey % 4 <> 0""")
def daily_metric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as text cells of a statistics page, read back; every fourth row is no row of statistics."""
    k = F.col("o_orderkey")
    text = lambda c: c.cast("string")
    cells = F.array(F.when(k % 4 != 0, text(F.to_date("o_orderdate"))).otherwise("Total"), F.lit("Mon"), F.concat(F.lit("+"), text(k % 90), F.lit("K")), text(k), F.lit("--"), F.concat(text(k % 7), F.lit(".5M")), F.lit(""), F.concat(F.lit("$"), text(k % 5), F.lit("  -  $"), text(k % 5), F.lit("K")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", S.daily_metric_row(cells).alias("x")).filter("x IS NOT NULL")
    return rows.select("o_orderkey", "x.*").withColumn("day", F.col("day").cast("string"))


# Languages

_AUDIO = "audio AS (SELECT source AS channel_id, text AS title, lang AS a FROM documents)"


def _audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("video_id"), F.concat_ws("/", "source", "lang").alias("channel_id"), F.col("text").alias("title"), F.col("lang").alias("default_audio_language"), F.when(F.length("text") % 2 == 0, "en-IN").alias("default_language"))


@query("SELECT concat_ws('/', source, lang) AS channel_id, min(lang) AS label FROM documents GROUP BY 1 HAVING count(DISTINCT lang) = 1")
def unanimous_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.unanimous(_audio(spark, sf_dir))


@query("""WITH t AS (SELECT concat_ws('/', source, lang) AS channel_id, lang, length(text) % 2 = 0 AS other FROM documents),
c AS (SELECT channel_id, any_value(lang) AS lang, count(*) AS n, count_if(other) AS o FROM t GROUP BY 1)
SELECT channel_id, CASE WHEN lang <> 'en' THEN lang WHEN o > 0 THEN 'en-in' WHEN lang IS NULL THEN 'und' ELSE 'en' END AS channel_language,
       round(CASE WHEN lang <> 'en' THEN 1 WHEN o > 0 THEN o / (o + n) ELSE 1 END, 9) AS language_confidence, CASE WHEN lang <> 'en' THEN 'audio' WHEN o > 0 THEN 'region' ELSE 'audio' END AS language_source FROM c""")
def parent_language_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents of one language each; text tags of another English region decide for the English ones."""
    return rounded(language.parent_languages(_audio(spark, sf_dir)), ["language_confidence"], 9)


@query("SELECT count(*) AS kept FROM documents WHERE lang = 'en' AND concat_ws('/', source, lang) NOT IN (SELECT concat_ws('/', source, lang) FROM documents WHERE length(text) % 2 = 0)")
def english_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _audio(spark, sf_dir)
    return language.filter_english(language.annotate(df, language.parent_languages(df))).agg(F.count("*").alias("kept"))


@query("SELECT doc_id, CAST(length(regexp_replace(coalesce(text, ''), '[^\\p{Greek}\\p{Cyrillic}\\p{Han}\\p{Arabic}\\p{Devanagari}\\p{Hiragana}\\p{Katakana}\\p{Hangul}\\p{Hebrew}\\p{Thai}]+', '', 'g')) AS INTEGER) AS foreign_characters FROM documents")
def foreign_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.foreign_script_count(F.col("text")).alias("foreign_characters"))


# Reports


@query("SELECT o_orderpriority AS assigned_source, o_orderstatus AS digested, o_orderkey % 3 = 0 AS needs_review, count(*) AS profiles FROM orders GROUP BY ALL")
def queue_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("assigned_source"), F.col("o_orderstatus").alias("digested"), (F.col("o_orderkey") % 3 == 0).alias("needs_review"))
    return reports.queue_by_state(o)


@query("SELECT count_if(o_orderstatus = 'F') AS succeeded, count_if(o_orderstatus <> 'F' AND o_orderkey % 2 = 0) AS failed, count_if(o_orderstatus <> 'F' AND o_orderkey % 2 = 1) AS never_tried FROM orders")
def collection_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("api_success_at"), F.when(F.col("o_orderkey") % 2 == 0, 1).alias("api_failed"))
    return reports.collection_progress(o)


@query("SELECT event_id AS id, CAST(user_id AS VARCHAR) AS channel_id, event_type FROM events WHERE event_type = 'error' ORDER BY event_id DESC LIMIT 100")
def newest_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("channel_id"), "event_type")
    return reports.newest_rows(e, ["id", "channel_id", "event_type"], where=F.col("event_type") == "error")


@query(f"""WITH {ITEMS} SELECT CASE WHEN duration_seconds IS NULL THEN 'unknown' WHEN duration_seconds <= 60 THEN '<=60s' WHEN duration_seconds <= 180 THEN '61-180s' WHEN duration_seconds <= 600 THEN '3-10m' WHEN duration_seconds <= 1800 THEN '10-30m' ELSE '>30m' END AS bucket, count(*) AS videos FROM items GROUP BY 1""")
def duration_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.duration_buckets(items(spark, sf_dir))


@query(f"WITH {ENRICHED}, {BREAKOUT} SELECT category_id, count(*) AS leads FROM breakout GROUP BY 1")
def lead_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = enriched(spark, sf_dir)
    found = scoring.breakout_outliers(df).select("video_id").join(df.select("video_id", "category_id"), "video_id")
    return reports.hit_histogram(found, "category_id")


@query(f"""WITH {ITEMS}, v AS (SELECT CAST(o_orderkey AS VARCHAR) AS video_id, o_orderstatus = 'P' AS is_short FROM orders WHERE o_orderstatus <> 'O'),
top AS (SELECT * FROM items ORDER BY views DESC, video_id LIMIT 300) SELECT video_id, is_short AS is_short_confirmed FROM top LEFT JOIN v USING (video_id) WHERE coalesce(NOT is_short, true) ORDER BY views DESC, video_id LIMIT 200""")
def verified_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 200 after the labels of shorts were looked up for the best 300."""
    verdicts = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'O'").select(F.col("o_orderkey").cast("string").alias("video_id"), (F.col("o_orderstatus") == "P").alias("is_short"))
    df = items(spark, sf_dir).withColumns({"composite_score": F.col("views"), "algorithms_hit": F.lit(1), "is_short_confirmed": F.lit(None).cast("boolean")})
    return leads.top_leads(df, 200, verdicts).select("video_id", "is_short_confirmed")


@query("""WITH s AS (SELECT event_id AS id, CAST(user_id AS VARCHAR) AS video_id, CASE WHEN event_type = 'error' THEN 'de' END AS lang FROM events)
SELECT id, coalesce(lang, CASE WHEN CAST(video_id AS BIGINT) % 2 = 0 THEN 'fr' END) AS default_audio_language FROM s""")
def backfilled_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("video_id"), F.when(F.col("event_type") == "error", "de").alias("default_audio_language"), F.lit(None).cast("string").alias("default_language"))
    updates = e.select("video_id").distinct().filter("video_id % 2 = 0").withColumns({"default_audio_language": F.lit("fr"), "default_language": F.lit(None).cast("string")})
    return writers.backfilled(e, updates).select("id", "default_audio_language")


@query("SELECT user_id, count(*) AS kept FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 14 DAY GROUP BY 1")
def retained_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = snapshots(spark, sf_dir).withColumnRenamed("collected_at", "observed_at")
    now = str(s.agg(F.max("observed_at")).first()[0])
    return writers.retained(s, now).groupBy(F.col("video_id").cast("long").alias("user_id")).agg(F.count("*").alias("kept"))
