"""Queries over the given tables, one or more for each operator family, and the same in SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import text as X
from ..operators import discovery, language, latest, leads, metrics, ranking, reports, rules, scoring, taxonomy, themes
from ..operators.settle import alone, settled
from ..sources import writers
from .adapters import ENRICHED, EVIDENCE, ITEMS, NOW, SNAPSHOTS, evidence, items, ratio, snapshots, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


def rounded_scaled(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    """As `rounded`, by the product with the power of ten, as SQL does: a decimal half goes by the product's last bit."""
    return df.withColumns({c: F.round(F.col(c).cast("double") * F.lit(10.0**digits)) / F.lit(10.0**digits) for c in columns})


def r(*columns: str, digits: int = 6) -> str:
    return ", ".join(f"round(CAST({c} AS DOUBLE), {digits}) AS {c}" for c in columns)


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with all metrics, numbered for the scorers; the items alone go."""
    return alone(spark, lambda: ranking.with_number(metrics.enrich(settled(items(spark, sf_dir)), NOW)))


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As `enriched`, without what needs the parents' other items."""
    return metrics.add_classes(metrics.add_parent_metrics(metrics.add_item_metrics(ranking.numbered(items(spark, sf_dir)), NOW), NOW))


# Latest rows, metrics, baselines


@query(f"WITH {SNAPSHOTS} SELECT video_id, id, collected_at, views FROM snaps QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY collected_at DESC, id DESC) = 1")
def latest_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest.latest(snapshots(spark, sf_dir), "video_id").select("video_id", "id", "collected_at", "views")


@query(f"""WITH {SNAPSHOTS}, top AS (SELECT video_id, max(event_type) AS event_type FROM snaps GROUP BY video_id)
SELECT s.video_id, s.id, top.event_type FROM snaps s JOIN top USING (video_id) QUALIFY row_number() OVER (PARTITION BY s.video_id ORDER BY collected_at DESC, id DESC) = 1""")
def latest_with_coalesced_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest.latest_with_coalesced(snapshots(spark, sf_dir), "video_id", ["event_type"]).select("video_id", "id", "event_type")


@query(f"""WITH {ENRICHED} SELECT video_id, sub_class, video_count_class, {r('video_age_days', 'views_per_day', 'views_per_sub', 'like_rate', 'comment_rate', 'engagement_rate', 'channel_age_days', 'uploads_per_month')} FROM enriched""")
def item_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["video_age_days", "views_per_day", "views_per_sub", "like_rate", "comment_rate", "engagement_rate", "channel_age_days", "uploads_per_month"]
    out = metrics.add_classes(metrics.add_parent_metrics(metrics.add_item_metrics(items(spark, sf_dir), NOW), NOW))
    return rounded(out.select("video_id", "sub_class", "video_count_class", *names), names)


BASED = """based AS (SELECT *, count(views) OVER p AS channel_video_sample, quantile_cont(views, 0.5) OVER p AS m, quantile_cont(views, 0.9) OVER p AS q FROM enriched WINDOW p AS (PARTITION BY channel_id))"""


@query(f"""WITH {ENRICHED}, {BASED} SELECT video_id, channel_video_sample, round(CASE WHEN channel_video_sample >= 5 THEN m END, 6) AS channel_median_views,
round(CASE WHEN channel_video_sample >= 5 THEN q END, 6) AS channel_p90_views, round(CASE WHEN channel_video_sample >= 5 THEN views / m END, 6) AS channel_relative_multiple FROM based""")
def parent_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["channel_median_views", "channel_p90_views", "channel_relative_multiple"]
    return rounded(metrics.add_parent_baselines(items(spark, sf_dir)).select("video_id", "channel_video_sample", *names), names)


PCT = "(rank() OVER (PARTITION BY {g} ORDER BY {v}) + (count(*) OVER (PARTITION BY {g}, {v}) - 1) / 2.0) / count({v}) OVER (PARTITION BY {g})"


def pct(g: str, v: str) -> str:
    return f"CASE WHEN {v} IS NOT NULL THEN {PCT.format(g=g, v=v)} END"


@query(f"WITH {ENRICHED} SELECT video_id, round({pct('sub_class', 'views_per_day')}, 9) AS pct_views_per_day, round({pct('sub_class', 'comment_rate')}, 9) AS pct_comment_rate FROM enriched")
def peer_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = metrics.add_classes(metrics.add_item_metrics(items(spark, sf_dir), NOW)).select("video_id", "sub_class", "views_per_day", "comment_rate")
    out = ranking.average_rank_pct(df, ["sub_class"], {"views_per_day": "pct_views_per_day", "comment_rate": "pct_comment_rate"})
    return rounded(out.select("video_id", "pct_views_per_day", "pct_comment_rate"), ["pct_views_per_day", "pct_comment_rate"], 9)


@query("SELECT event_id, round(CASE WHEN value IS NOT NULL THEN cume_dist() OVER (ORDER BY value) END, 9) AS normalized FROM events")
def max_rank_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ranking.max_rank_pct(table(spark, sf_dir, "events"), [], "value", "normalized").select("event_id", "normalized"), ["normalized"], 9)


@query("SELECT event_id, round(coalesce((value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ()), 0), 9) AS normalized FROM events")
def min_max_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ranking.min_max(table(spark, sf_dir, "events"), "value", "normalized").select("event_id", "normalized"), ["normalized"], 9)


LOO = """
others AS (SELECT a.video_id, count(b.views) AS n, quantile_cont(b.views, 0.5) AS m, quantile_cont(b.views, 0.9) AS q
           FROM enriched a LEFT JOIN enriched b ON a.channel_id = b.channel_id AND a.video_id <> b.video_id GROUP BY a.video_id)"""


@query(f"WITH {ENRICHED}, {LOO} SELECT video_id, n AS others, round(m, 6) AS loo_median, round(q, 6) AS loo_p90 FROM others")
def leave_one_out_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ranking.leave_one_out(items(spark, sf_dir).select("video_id", "channel_id", "views"), "channel_id", "views", {"loo_median": 0.5, "loo_p90": 0.9}, "others")
    return rounded(out.select("video_id", "others", "loo_median", "loo_p90"), ["loo_median", "loo_p90"])


MAD = "SELECT {g} AS g, n, m, quantile_cont(abs(v - m), 0.5) AS d FROM (SELECT {g}, {v} AS v, count({v}) OVER w AS n, quantile_cont({v}, 0.5) OVER w AS m FROM {t} WINDOW w AS (PARTITION BY {g})) GROUP BY {g}, n, m"


@query(f"WITH {ENRICHED}, s AS ({MAD.format(g='sub_class', v='views_per_day', t='enriched')}) SELECT g AS sub_class, n, round(m, 6) AS median, round(1.4826 * d, 6) AS mad FROM s")
def group_median_mad(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = metrics.add_classes(metrics.add_item_metrics(items(spark, sf_dir), NOW))
    return rounded(ranking.median_mad(df, ["sub_class"], "views_per_day", 1.4826), ["median", "mad"])


def z_sql(v: str, out: str) -> str:
    """CTEs of the robust z-score of `v` by sub_class for enriched rows, as table {out}(video_id, z, source)."""
    valid = "coalesce({s} > greatest(1e-12, 1e-9 * greatest(abs({m}), abs(coalesce({k}, 0)))), false)"
    own = valid.format(s="1.4826 * own.d", m="own.m", k="bs")
    iqr = valid.format(s="(own.q3 - own.q1) / 1.349", m="own.m", k="bs")
    std = valid.format(s="own.sd", m="own.m", k="bs")
    rest = valid.format(s="1.4826 * rest.d", m="rest.m", k="0")
    return f"""
{out}_all AS (SELECT quantile_cont({v}, 0.5) AS m FROM enriched),
{out}_alld AS (SELECT any_value(m) AS m, quantile_cont(abs({v} - m), 0.5) AS d FROM enriched, {out}_all),
{out}_own AS (SELECT sub_class, any_value(m) AS m, count({v}) AS n, quantile_cont(abs({v} - m), 0.5) AS d, quantile_cont({v}, 0.25) AS q1, quantile_cont({v}, 0.75) AS q3, stddev_pop({v}) AS sd
             FROM (SELECT *, quantile_cont({v}, 0.5) OVER (PARTITION BY sub_class) AS m FROM enriched) GROUP BY sub_class),
{out}_pair AS (SELECT g.sub_class, e.{v} AS v FROM (SELECT DISTINCT sub_class FROM enriched) g JOIN enriched e ON e.sub_class <> g.sub_class),
{out}_rest AS (SELECT sub_class, any_value(m) AS m, quantile_cont(abs(v - m), 0.5) AS d FROM (SELECT *, quantile_cont(v, 0.5) OVER (PARTITION BY sub_class) AS m FROM {out}_pair) GROUP BY sub_class),
{out}_back AS (SELECT own.*, CASE WHEN {rest} THEN rest.m ELSE a.m END AS bm, CASE WHEN {rest} THEN 1.4826 * rest.d ELSE 1.4826 * a.d END AS bs
             FROM {out}_own own LEFT JOIN {out}_rest rest USING (sub_class), {out}_alld a),
{out}_pick AS (SELECT sub_class, CASE WHEN own.n >= 30 AND {own} THEN 'group_mad' WHEN own.n >= 30 AND {iqr} THEN 'group_iqr' WHEN own.n >= 30 AND {std} THEN 'group_std' ELSE 'global_mad' END AS source,
               CASE WHEN own.n >= 30 AND ({own} OR {iqr} OR {std}) THEN own.m ELSE bm END AS centre,
               CASE WHEN own.n >= 30 AND {own} THEN 1.4826 * own.d WHEN own.n >= 30 AND {iqr} THEN (own.q3 - own.q1) / 1.349 WHEN own.n >= 30 AND {std} THEN own.sd ELSE bs END AS scale FROM {out}_back own),
{out} AS (SELECT video_id, coalesce(({v} - centre) / scale, 0) AS z, source FROM enriched JOIN {out}_pick USING (sub_class))"""


@query(f"WITH {ENRICHED}, {z_sql('comment_rate', 'cz')} SELECT video_id, round(z, 6) AS z, source FROM cz")
def robust_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = settled(metrics.add_classes(metrics.add_item_metrics(items(spark, sf_dir), NOW)).select("video_id", "sub_class", "comment_rate"))
    return rounded(ranking.robust_z(df, "sub_class", "comment_rate", "z", "source", "center").select("video_id", "z", "source"), ["z"])


# Scorers

BREAKOUT = """breakout AS (SELECT *, ln(1 + views_per_sub) * sqrt(ln(1 + views)) AS score FROM enriched WHERE views_per_sub >= 10 AND subscribers BETWEEN 500 AND 100000
  AND views >= 50000 AND video_age_days >= 3 AND (coalesce(like_rate, 0) > 0.001 OR coalesce(comment_rate, 0) > 0.0001))"""


@query(f"WITH {ENRICHED}, {BREAKOUT} SELECT video_id, title, channel_name, subscribers, views, {r('score', 'views_per_sub')} FROM breakout")
def breakout_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scoring.breakout_outliers(enriched(spark, sf_dir))
    return rounded(out.select("video_id", "title", "channel_name", "subscribers", "views", "score", "views_per_sub"), ["score", "views_per_sub"])


_G = "sub_class, video_count_class"
_W = {"views": 0.5, "views_per_sub": 2.5, "views_per_day": 0.5, "comment_rate": 0.7}
WEIGHT_CLASS = f"""
wc AS (SELECT *, count(*) OVER (PARTITION BY {_G}) AS group_size, {", ".join(f"{pct(_G, m)} AS pct_{m}" for m in _W)} FROM enriched WHERE sub_class <> 'unknown' AND video_count_class <> 'unknown'),
wr AS (SELECT *, CASE WHEN {" + ".join(f"(pct_{m} IS NOT NULL)::INT" for m in _W)} >= 2 THEN ({" + ".join(f"coalesce(pct_{m} * {w}, 0)" for m, w in _W.items())}) / ({" + ".join(f"(CASE WHEN pct_{m} IS NOT NULL THEN {w} ELSE 0 END)" for m, w in _W.items())}) END AS raw FROM wc),
wr2 AS (SELECT *, round(raw, 12) AS rr FROM wr),
weight_class AS (SELECT * FROM (SELECT *, {pct(_G, 'rr')} AS score FROM wr2) WHERE group_size >= 30 AND score >= 0.99 AND views >= 10000)"""


@query(f"WITH {ENRICHED}, {WEIGHT_CLASS} SELECT video_id, sub_class, video_count_class, group_size, {r('score', digits=5)}, round(CAST(raw AS DOUBLE), 6) AS composite_raw FROM weight_class")
def weight_class_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scoring.weight_class_performance(measured(spark, sf_dir))
    return out.select("video_id", "sub_class", "video_count_class", "group_size", F.round("score", 5).alias("score"), F.round("composite_raw", 6).alias("composite_raw"))


CHANNEL = f"""{LOO},
channel AS (SELECT e.*, n, m, q, views / m AS mult, (ln(1 + views / m) + 0.35 * ln(1 + coalesce(views / q, 0))) * (n / (n + 10.0)) + 0.15 * ln(1 + views / 20000.0) AS score
  FROM enriched e JOIN others USING (video_id) WHERE n >= 5 AND views >= 20000 AND m >= 500 AND views / m >= 3 AND video_age_days >= 3)"""


@query(f"WITH {ENRICHED}, {CHANNEL} SELECT video_id, n AS channel_video_sample, round(score, 6) AS score, round(m, 6) AS channel_median_views, round(mult, 6) AS channel_relative_multiple FROM channel")
def channel_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scoring.channel_relative(enriched(spark, sf_dir), min_multiple=3)
    names = ["score", "channel_median_views", "channel_relative_multiple"]
    return rounded(out.select("video_id", "channel_video_sample", *names), names)


ENGAGED = f"""{z_sql('comment_rate', 'cz')}, {z_sql('like_rate', 'lz')},
eng AS (SELECT e.*, cz.z AS comment_rate_z, lz.z AS like_rate_z, cz.source AS z_scale_source, coalesce(views_per_sub, 0) >= 5 AND cz.z >= 2 AS premium_lead,
  coalesce(views >= 100000 AND engagement_rate < 0.0005 AND like_rate <= 0.0005 AND comment_rate <= 0.0001, false) AS suspicious FROM enriched e JOIN cz USING (video_id) JOIN lz USING (video_id)),
eraw AS (SELECT *, 3 * comment_rate_z + 0.5 * like_rate_z + ln(1 + coalesce(views_per_sub, 0)) + CASE WHEN premium_lead THEN 2 ELSE 0 END AS raw FROM eng),
engagement AS (SELECT *, sign(raw) * ln(1 + abs(raw)) AS score FROM eraw WHERE views >= 10000 AND comment_rate_z >= 1.5 AND comments >= 50 AND NOT suspicious
  QUALIFY row_number() OVER (PARTITION BY channel_id ORDER BY score DESC, views DESC, video_id) <= 3)"""


@query(f"WITH {ENRICHED}, {ENGAGED} SELECT video_id, {r('score', 'comment_rate_z', 'like_rate_z')}, z_scale_source, premium_lead FROM engagement")
def engagement(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scoring.engagement(measured(spark, sf_dir))
    names = ["score", "comment_rate_z", "like_rate_z"]
    return rounded(out.select("video_id", *names, "z_scale_source", "premium_lead"), names)


OBSERVED = f"""{SNAPSHOTS},
steps AS (SELECT video_id, row_number() OVER w AS k, views - lag(views) OVER w AS d, (epoch_us(collected_at) - lag(epoch_us(collected_at)) OVER w) / 86400e6 AS days, epoch_us(collected_at) AS us
          FROM snaps WINDOW w AS (PARTITION BY video_id ORDER BY collected_at, id)),
observed AS (SELECT video_id, arg_max(greatest(d, 0) / days, k) FILTER (days >= 0.5 AND d IS NOT NULL) AS rate, count(*) AS n, (max(us) - min(us)) / 86400e6 AS span, coalesce(bool_or(d < 0), false) AS fell FROM steps GROUP BY video_id)"""


@query(f"WITH {OBSERVED} SELECT video_id, round(rate, 6) AS observed_views_per_day, n AS snapshot_count, round(span, 6) AS observation_span_days, fell AS negative_delta_clipped FROM observed")
def snapshot_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.observed_velocity(snapshots(spark, sf_dir)), ["observed_views_per_day", "observation_span_days"])


VELOCITY = f"""{OBSERVED},
a AS ({MAD.format(g='sv', v='views_per_day', t="(SELECT *, sub_class || '/' || video_count_class AS sv FROM enriched)")}),
b AS ({MAD.format(g='sub_class', v='views_per_day', t='enriched')}),
c AS (SELECT any_value(m) AS m, quantile_cont(abs(views_per_day - m), 0.5) AS d FROM (SELECT views_per_day, quantile_cont(views_per_day, 0.5) OVER () AS m FROM enriched)),
lv AS (SELECT e.*, CASE WHEN a.n < 30 AND b.n >= 30 THEN b.n ELSE a.n END AS cn, CASE WHEN a.n < 30 AND b.n >= 30 THEN b.m ELSE a.m END AS cm, CASE WHEN a.n < 30 AND b.n >= 30 THEN b.d ELSE a.d END AS cd, c.m AS gm, c.d AS gd
       FROM enriched e LEFT JOIN a ON a.g = sub_class || '/' || video_count_class LEFT JOIN b ON b.g = sub_class, c),
zz AS (SELECT *, greatest(0, (views_per_day - CASE WHEN cn < 30 OR cd <= 0 THEN gm ELSE cm END) / (1.4826 * CASE WHEN cn < 30 OR cd <= 0 THEN gd ELSE cd END)) AS z FROM lv),
vs AS (SELECT zz.*, CASE WHEN video_age_days <= 9000 THEN 100 * z / (z + 25) END AS pub, CASE WHEN rate IS NOT NULL AND video_age_days >= 30 THEN 100 * (1 - exp(-log2(greatest(rate / (views / video_age_days), 1)))) ELSE 0 END AS acc,
       coalesce(observed.n, 0) AS snapshot_count FROM zz LEFT JOIN observed USING (video_id)),
vb AS (SELECT *, (coalesce(pub, 0) * 0.4 + CASE WHEN acc > 0 THEN acc * 0.6 ELSE 0 END) / nullif(CASE WHEN pub IS NOT NULL THEN 0.4 ELSE 0 END + CASE WHEN acc > 0 THEN 0.6 ELSE 0 END, 0) AS score FROM vs)"""


@query(f"WITH {ENRICHED}, {VELOCITY} SELECT video_id, snapshot_count, round(score, 5) AS score, round(pub, 5) AS publish_velocity_score, round(acc, 5) AS acceleration_score FROM vb WHERE views >= 10000 AND score >= 10")
def velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scoring.velocity(enriched(spark, sf_dir), snapshots(spark, sf_dir), max_age_days=9000, min_score=10)
    names = ["score", "publish_velocity_score", "acceleration_score"]
    return rounded(out.select("video_id", "snapshot_count", *names), names, 5)


# Leads


@query(f"""WITH {ENRICHED}, {BREAKOUT}, {CHANNEL},
stack AS (SELECT 'breakout_outliers' AS name, 1.35 AS w, video_id, score, cume_dist() OVER (ORDER BY score) AS s FROM breakout UNION ALL SELECT 'channel_relative', 1.05, video_id, score, cume_dist() OVER (ORDER BY score) FROM channel)
SELECT video_id, CAST(count(*) AS INTEGER) AS algorithms_hit, string_agg(name, ',' ORDER BY name) AS algorithms, round(CAST(sum(s * w) * (1 + 0.12 * (count(*) - 1)) AS DOUBLE), 6) AS composite_score FROM stack GROUP BY video_id""")
def combined_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = enriched(spark, sf_dir)
    found = {"breakout_outliers": scoring.breakout_outliers(df), "channel_relative": scoring.channel_relative(df, min_multiple=3)}
    out = leads.combine(leads.normalize_scores(found), df)
    return rounded(out.select("video_id", "algorithms_hit", "algorithms", "composite_score"), ["composite_score"])


@query(f"WITH {ITEMS} SELECT video_id, duration_seconds FROM items WHERE duration_seconds > 60 OR duration_seconds IS NULL")
def exclude_shorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.exclude_shorts(items(spark, sf_dir)).select("video_id", "duration_seconds")


@query(f"""WITH {ITEMS}, v AS (SELECT CAST(o_orderkey AS VARCHAR) AS video_id, o_orderstatus = 'P' AS is_short FROM orders WHERE o_orderstatus <> 'O')
SELECT video_id, coalesce(is_short, CASE WHEN duration_seconds > 180 THEN false END) AS is_short, CASE WHEN is_short IS NOT NULL THEN 'label' WHEN duration_seconds > 180 THEN 'duration' ELSE 'unknown' END AS short_source FROM items LEFT JOIN v USING (video_id)""")
def resolve_shorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'O'").select(F.col("o_orderkey").cast("string").alias("video_id"), (F.col("o_orderstatus") == "P").alias("is_short"))
    return metrics.resolve_shorts(items(spark, sf_dir), verdicts).select("video_id", "is_short", "short_source")


@query(f"""WITH {ENRICHED} SELECT video_id, sub_class, round(views_per_sub, 6) AS views_per_sub FROM enriched WHERE subscribers >= 1000 AND subscribers <= 60000 AND views >= 100000 AND sub_class IN ('1k-10k', '10k-50k')
QUALIFY row_number() OVER (PARTITION BY channel_id ORDER BY views DESC, video_id) <= 2""")
def lead_filters_and_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = metrics.add_classes(metrics.add_item_metrics(items(spark, sf_dir), NOW)).withColumns({"composite_score": F.col("views"), "algorithms_hit": F.lit(1)})
    out = leads.apply_filters(df, leads.LeadFilters(min_subscribers=1000, max_subscribers=60000, min_views=100000, sub_classes=("1k-10k", "10k-50k"), per_channel=2))
    return rounded(out.select("video_id", "sub_class", "views_per_sub"), ["views_per_sub"])


# Titles, rules, topics

_TOKENS = "list_filter(string_split(lower(coalesce(title, '')), ' '), lambda w: length(w) > 1 AND NOT w IN ('new', 'all', 'only', 'other', 'same'))"


@query(f"""WITH {ITEMS}, t AS (SELECT video_id, {_TOKENS} AS w FROM items)
SELECT video_id, array_to_string(list_sort(list_distinct(w)), ' ') AS signature, len(list_distinct(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])))) AS n_terms FROM t""")
def title_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = items(spark, sf_dir).select("video_id", X.tokens(F.col("title")).alias("w"))
    return words.select("video_id", X.signature(F.col("w")).alias("signature"), F.size(X.ngrams(F.col("w"), 1, 2)).cast("long").alias("n_terms"))


THEMES = f"""
lead AS (SELECT * FROM items WHERE views >= 300000),
tl AS (SELECT *, {_TOKENS} AS w FROM lead), ts AS (SELECT *, array_to_string(list_sort(list_distinct(w)), ' ') AS sig FROM tl),
ld AS (SELECT * FROM ts QUALIFY sig = '' OR row_number() OVER (PARTITION BY sig ORDER BY video_id) = 1),
lx AS (SELECT video_id, channel_id, views, {ratio('views', 'subscribers')} AS vps, unnest(list_distinct(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])))) AS term FROM ld),
st AS (SELECT term, count(*) AS lead_count, median(views) AS median_views, median(vps) AS mvps FROM lx GROUP BY term HAVING count(*) >= 3),
hh AS (SELECT term, sum(n * n) / (sum(n) * sum(n)) AS hhi, count(*) AS dc FROM (SELECT term, channel_id, count(*) AS n FROM lx GROUP BY ALL) GROUP BY term),
tb AS (SELECT title, published_at, {_TOKENS} AS w FROM items), tbs AS (SELECT *, array_to_string(list_sort(list_distinct(w)), ' ') AS sig FROM tb),
bd AS (SELECT * FROM tbs QUALIFY sig = '' OR row_number() OVER (PARTITION BY sig ORDER BY published_at, title) = 1),
bm AS (SELECT *, (SELECT max(published_at) FROM items) - INTERVAL 7 DAY AS rf FROM bd),
bw AS (SELECT *, published_at >= rf AS rec, published_at < rf AND published_at >= rf - INTERVAL 28 DAY AS pri FROM bm),
tot AS (SELECT count(*) AS docs, count_if(rec) AS rd, count_if(pri) AS pd FROM bw),
bx AS (SELECT rec, pri, unnest(list_distinct(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])))) AS term FROM bw),
bc AS (SELECT term, count(*) AS bc, count_if(rec) AS rc, count_if(pri) AS pc FROM bx GROUP BY term),
th AS (SELECT st.*, hhi, dc, lead_count / (SELECT count(*) FROM ld) AS lead_share, (coalesce(bc, 0) + 1) / (docs + 2.0) AS bshare, ((lead_count + 1) / ((SELECT count(*) FROM ld) + 2.0)) / ((coalesce(bc, 0) + 1) / (docs + 2.0)) AS lift,
       CASE WHEN rd > 0 AND pd > 0 THEN ((coalesce(rc, 0) + 0.5) / (rd + 1.0)) / ((coalesce(pc, 0) + 0.5) / (pd + 1.0)) ELSE 1.0 END AS burst FROM st JOIN hh USING (term) LEFT JOIN bc USING (term), tot WHERE dc >= 2)"""


@query(f"""WITH {ITEMS}, {THEMES} SELECT term, lead_count, round(lead_share, 9) AS lead_share, round(bshare, 9) AS background_share, round(lift, 6) AS lift, round(burst, 6) AS burst, round(median_views, 4) AS median_views, round(mvps, 6) AS median_views_per_sub,
dc AS distinct_channels, round(hhi, 9) AS channel_hhi FROM th""")
def title_themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = settled(items(spark, sf_dir).select("video_id", "channel_id", "title", "published_at", "views", "subscribers"))
    out = themes.extract_themes(corpus.filter("views >= 300000"), corpus)
    out = rounded(rounded(rounded(out, ["lift", "burst", "median_views_per_sub"]), ["median_views"], 4), ["lead_share", "background_share", "channel_hhi"], 9)
    return out.select("term", "lead_count", "lead_share", "background_share", "lift", "burst", "median_views", "median_views_per_sub", "distinct_channels", "channel_hhi")


@query(f"""WITH {ITEMS}, lead AS (SELECT * FROM items WHERE views >= 300000),
t AS (SELECT category_id, count(DISTINCT channel_id) AS dc, count(DISTINCT video_id) AS tv FROM items GROUP BY 1), o AS (SELECT category_id, count(DISTINCT channel_id) AS oc, count(DISTINCT video_id) AS ov, median(subscribers) AS ms FROM lead GROUP BY 1)
SELECT category_id, dc AS distinct_channels, coalesce(oc, 0) AS outlier_channels, tv AS total_videos, coalesce(ov, 0) AS outlier_videos, round(coalesce(ov, 0) / tv, 9) AS outlier_rate, round(ms, 4) AS median_outlier_subscribers, round(coalesce(ov, 0) / tv / ln(1 + greatest(dc, 1)), 9) AS saturation_score FROM t LEFT JOIN o USING (category_id)""")
def niche_saturation(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = items(spark, sf_dir)
    out = themes.niche_saturation(corpus, corpus.filter("views >= 300000"))
    return rounded(rounded(out.drop("category_name"), ["outlier_rate", "saturation_score"], 9), ["median_outlier_subscribers"], 4)


RULES = [rules.Rule(("red plate",)), rules.Rule(("giz*", "hot"), scope="corpus"), rules.Rule(("old", "small rod"))]
_HIT = {"leads:title:red plate": ["(^|[^0-9a-z])red plate([^0-9a-z]|$)"], "corpus:title:giz*&hot": ["(^|[^0-9a-z])giz", "(^|[^0-9a-z])hot([^0-9a-z]|$)"], "leads:title:old&small rod": ["(^|[^0-9a-z])old([^0-9a-z]|$)", "(^|[^0-9a-z])small rod([^0-9a-z]|$)"]}
_RULE_SQL = {k: " AND ".join(f"regexp_matches(coalesce(title, ''), '{p}')" for p in v) for k, v in _HIT.items()}


@query("WITH " + ITEMS + " " + " UNION ALL ".join(f"SELECT '{k}' AS rule, '{k.split(':')[0]}' AS scope, CAST(count_if({s}) AS BIGINT) AS matched_rows, round(count_if({s}) / count(*), 9) AS matched_share FROM items" for k, s in _RULE_SQL.items()))
def rule_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rules.reach(items(spark, sf_dir), RULES).select("rule", "scope", "matched_rows", "matched_share"), ["matched_share"], 9)


@query(f"WITH {ITEMS} SELECT video_id, CASE " + " ".join(f"WHEN {_RULE_SQL[k]} THEN '{k}'" for k in sorted(_RULE_SQL)) + " END AS matched_rule FROM items")
def first_matching_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.with_first_match(items(spark, sf_dir), RULES).select("video_id", "matched_rule")


@query(f"WITH {ITEMS} SELECT video_id FROM items WHERE NOT ({' OR '.join(f'({s})' for s in _RULE_SQL.values())})")
def rules_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.apply_rules(items(spark, sf_dir), RULES).select("video_id")


TOPICS = taxonomy.Taxonomy("terms-1", (taxonomy.Topic("tools", ("gear", "bolt*"), ("rod",), ("hot gear",)), taxonomy.Topic("ware", ("plate", "widget"), ("red", "blue"))), excluded=("old ring",), gate=("small", "hot"), supporting=("1-URGENT",), noise=("5-LOW",))
_WORD = "regexp_matches(coalesce(title, ''), '\\b({})\\b')"
LABELLED = f"""labelled AS (SELECT * FROM (
  SELECT i.*, 'tools' AS topic, 2 + CASE WHEN {_WORD.format('rod')} THEN 1 ELSE 0 END + c AS confidence FROM base i WHERE {_WORD.format('gear|bolt[a-z0-9_]*')} AND NOT {_WORD.format('hot gear')}
  UNION ALL SELECT i.*, 'ware', 2 + CASE WHEN {_WORD.format('red|blue')} THEN 1 ELSE 0 END + c FROM base i WHERE {_WORD.format('plate|widget')}) WHERE confidence >= 2)"""
BASE = f"base AS (SELECT *, CASE category_id WHEN '1-URGENT' THEN 1 WHEN '5-LOW' THEN -1 ELSE 0 END AS c FROM items WHERE NOT {_WORD.format('old ring')} AND {_WORD.format('small|hot')})"


@query(f"WITH {ITEMS}, {BASE}, {LABELLED} SELECT video_id, topic, confidence FROM labelled")
def topic_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.classify(items(spark, sf_dir), TOPICS).select("video_id", "topic", "confidence")


@query(f"""WITH {ITEMS}, {BASE}, {LABELLED}, v AS (SELECT *, {ratio('views', 'subscribers')} AS vps, row_number() OVER (PARTITION BY topic ORDER BY views) - 1 AS k, count(*) OVER (PARTITION BY topic) AS n FROM labelled)
SELECT topic, count(*) AS videos, count(DISTINCT channel_id) AS channels, median(views) AS median_views, round(median(vps), 6) AS median_views_per_sub, median(subscribers) AS median_subscribers, max(views) FILTER (k = round_even(0.9 * (n - 1), 0)) AS p90_views FROM v GROUP BY topic""")
def topic_slice_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.slice_summary(taxonomy.classify(items(spark, sf_dir), TOPICS), "topic"), ["median_views_per_sub"])


@query(f"""WITH {ITEMS}, v AS (SELECT *, {ratio('views', 'subscribers')} AS vps FROM items), m AS (SELECT median(vps) AS m FROM v)
SELECT CASE WHEN subscribers IS NULL THEN 'unknown' WHEN subscribers < 1000 THEN '<1k' WHEN subscribers < 10000 THEN '1k-10k' WHEN subscribers < 100000 THEN '10k-100k' WHEN subscribers < 1000000 THEN '100k-1M' ELSE '1M+' END AS band,
count(*) AS videos, round(median(vps), 6) AS median_views_per_sub, round(avg(CASE WHEN vps > m THEN 1.0 WHEN vps IS NOT NULL THEN 0.0 END), 9) AS above_median FROM v, m GROUP BY 1""")
def entrant_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(reports.entrant_bands(items(spark, sf_dir)), ["median_views_per_sub"]), ["above_median"], 9)


@query(f"""WITH {ITEMS}, v AS (SELECT *, {ratio('views', 'subscribers')} AS vps FROM items WHERE subscribers >= 1000)
SELECT channel_id, max(channel_name) AS channel_name, max(subscribers) AS subscribers, count(*) AS videos, round(median(vps), 6) AS median_views_per_sub FROM v GROUP BY channel_id HAVING count(*) >= 3 ORDER BY median(vps) DESC, channel_id LIMIT 15""")
def consistency_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.consistency(items(spark, sf_dir)), ["median_views_per_sub"])


# Languages


def _titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").cast("string").alias("video_id"), F.col("source").alias("channel_id"), F.col("text").alias("title"), F.col("lang").alias("default_audio_language"), F.upper("lang").alias("default_language"))


_TITLED = "titled AS (SELECT source AS channel_id, lang AS a FROM documents)"


@query(f"""WITH {_TITLED}, c AS (SELECT channel_id, a, count(*) AS n FROM titled WHERE a IS NOT NULL GROUP BY ALL)
SELECT p.channel_id, coalesce(first(a ORDER BY n DESC, a) FILTER (a <> 'en'), 'en') AS channel_language, round(coalesce(sum(n) FILTER (a <> 'en') / sum(n), 1), 9) AS language_confidence, 'audio' AS language_source FROM (SELECT DISTINCT channel_id FROM titled) p JOIN c USING (channel_id) GROUP BY p.channel_id""")
def parent_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(language.parent_languages(_titled(spark, sf_dir)), ["language_confidence"], 9)


@query("SELECT coalesce(lang, 'und') AS channel_language, count(*) AS videos, count(DISTINCT source) AS channels, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM documents GROUP BY 1")
def language_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("channel_language"), F.col("source").alias("channel_id"))
    return rounded(language.breakdown(docs), ["share"], 9)


@query("""WITH w AS (SELECT doc_id, lang, unnest(regexp_extract_all(regexp_replace(lower(nfkd_text), '[^\\x00-\\x7F]+', '', 'g'), '[a-z][a-z'']*')) AS token FROM (SELECT doc_id, lang, strip_accents(text) AS nfkd_text FROM documents WHERE text IS NOT NULL)),
k AS (SELECT DISTINCT doc_id, lang <> 'en' AS f, regexp_replace(token, '^''+|''+$', '', 'g') AS token FROM w), p AS (SELECT * FROM k WHERE length(token) >= 3),
tot AS (SELECT count_if(lang <> 'en') AS nf, count_if(lang = 'en') AS ne FROM documents),
c AS (SELECT token, count_if(f) AS "foreign", count_if(NOT f) AS english FROM p GROUP BY token HAVING count_if(f) >= 2)
SELECT token, CAST("foreign" AS BIGINT) AS "foreign", CAST(english AS BIGINT) AS english, round(("foreign" / nf) / ((english + 1) / (ne + 1)), 6) AS lift FROM c, tot WHERE ("foreign" / nf) / ((english + 1) / (ne + 1)) >= 5""")
def marker_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("channel_id"), F.col("text").alias("title"), "lang")
    return rounded(language.learn_markers(docs, docs.select("channel_id", F.col("lang").alias("label")), min_lift=5, min_parents=2), ["lift"])


# Discovery


@query(f"""WITH {ITEMS}, recent AS (SELECT * FROM items WHERE views >= 10000 AND published_at >= TIMESTAMP '{NOW}' - INTERVAL 400 DAY AND subscribers BETWEEN 100 AND 1000000
  AND video_id NOT IN (SELECT CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderstatus = 'P' AND o_orderdate >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY)),
best AS (SELECT * FROM recent QUALIFY row_number() OVER (PARTITION BY channel_id ORDER BY views DESC, published_at DESC, CAST(video_id AS BIGINT) DESC) = 1)
SELECT channel_id, video_id, round(views / subscribers, 6) AS score FROM best ORDER BY views / subscribers DESC, views DESC, video_id LIMIT 25""")
def seed_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = items(spark, sf_dir)
    parents = df.select("channel_id", "channel_name", "subscribers", F.col("video_count").alias("views"), F.col("channel_published_at").alias("collected_at"), F.lit(1).alias("id"))
    used = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").cast("string").alias("seed_video_id"), F.col("o_orderdate").cast("timestamp").alias("selected_at"))
    out = discovery.select_seeds(df.withColumn("id", F.col("video_id").cast("long")), parents, used, NOW, limit=25, lookback_days=400)
    return rounded(out.select("channel_id", "video_id", "score"), ["score"])


@query(f"""WITH {EVIDENCE}, t AS (SELECT channel_key, matched_topic AS topic, max(confidence) AS c, count(DISTINCT video_id) AS h, count(DISTINCT seed_video_id) AS s, min(depth) AS d, min(observed_at) AS f, max(observed_at) AS l FROM evidence WHERE matched_topic IS NOT NULL GROUP BY ALL)
SELECT channel_key, min(topic) AS topic, max(c) AS best_confidence, arg_max(h, topic) AS hit_count, arg_max(s, topic) AS seed_count, min(d) AS depth, arg_min(f, topic) AS first_seen_at, arg_max(l, topic) AS last_seen_at, 'pending' AS status FROM t GROUP BY channel_key""")
def queue_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.rebuild_queue(evidence(spark, sf_dir), "terms-1").drop("channel_id")


@query(f"WITH {EVIDENCE} SELECT depth, count(*) AS total, count(matched_topic) AS on_topic, count(DISTINCT seed_video_id) AS seeds, round(count(matched_topic) / count(*), 9) AS yield_rate FROM evidence GROUP BY depth")
def crawl_yield(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(discovery.crawl_yield(evidence(spark, sf_dir), "terms-1"), ["yield_rate"], 9)


@query(f"""WITH {EVIDENCE}, first AS (SELECT channel_key, seed_video_id FROM evidence QUALIFY row_number() OVER (PARTITION BY channel_key ORDER BY observed_at, seed_video_id) = 1)
SELECT seed_video_id, count(*) AS discovered FROM first WHERE channel_key NOT IN (SELECT 's' || s_suppkey FROM supplier WHERE s_suppkey % 2 = 0) GROUP BY 1""")
def seed_yield(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "supplier").filter("s_suppkey % 2 = 0").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("channel_key"))
    return discovery.seed_yield(evidence(spark, sf_dir).withColumn("seed_order", F.col("observed_at")), known)


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("string").alias("channel_key"), F.when(F.col("event_id") % 2 == 0, "first").otherwise("second").alias("source"), F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "success").otherwise("skipped").alias("outcome"), F.col("ts").cast("timestamp").alias("attempted_at"), F.col("value").alias("units"))


_ATTEMPTS = "attempts AS (SELECT CAST(user_id AS VARCHAR) AS channel_key, CASE WHEN event_id % 2 = 0 THEN 'first' ELSE 'second' END AS source, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'success' ELSE 'skipped' END AS outcome, ts AS attempted_at, value AS units FROM events)"


@query(f"""WITH {_ATTEMPTS}, s AS (SELECT channel_key, bool_or(source = 'first' AND outcome = 'failed') AS failed_0, bool_or(source = 'second' AND outcome = 'failed') AS failed_1, arg_max(outcome, attempted_at) AS last_outcome, count(*) AS attempts FROM attempts GROUP BY 1)
SELECT *, last_outcome <> 'success' AND failed_0 AND failed_1 AS under_review, CASE WHEN last_outcome <> 'success' AND failed_0 AND NOT failed_1 THEN 'second' WHEN last_outcome <> 'success' AND failed_1 AND NOT failed_0 THEN 'first' END AS next_source FROM s""")
def attempt_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.attempt_status(_attempts(spark, sf_dir), ("first", "second"))


@query(f"WITH {_ATTEMPTS} SELECT source, outcome, count(*) AS attempts, max(attempted_at) AS last_at FROM attempts GROUP BY ALL")
def attempt_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.recent_attempts(_attempts(spark, sf_dir))


@query(f"WITH {_ATTEMPTS} SELECT CAST(CAST(attempted_at - INTERVAL 8 HOUR AS DATE) AS VARCHAR) AS day, round(sum(units), 4) AS units, count(*) AS calls FROM attempts GROUP BY 1")
def usage_by_local_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.usage_by_day(_attempts(spark, sf_dir), "attempted_at"), ["units"], 4).withColumn("day", F.col("day").cast("string"))


@query(f"""WITH {ITEMS} SELECT video_id, CASE WHEN CAST('0x' || substr(sha256(channel_id), 1, 8) AS BIGINT) % 1000 < 350 THEN 'WARM' ELSE 'SEED' END AS pool FROM items""")
def hash_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("video_id", S.hash_pool(F.col("channel_id")).alias("pool"))


@query("""SELECT DISTINCT user_id, event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, sha256('{"_day":"' || CAST(ts AS DATE) || '","event_type":"' || event_type || '","user_id":' || user_id || '}') AS digest FROM events""")
def daily_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each content once a day, with its digest."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    fresh = writers.unknown_digests(e, ["user_id", "event_type"], None, {"_day": F.to_date("ts")})
    return fresh.select("user_id", "event_type", F.to_date("ts").cast("string").alias("day"), "digest")


@query("SELECT CAST(user_id AS VARCHAR) AS video_id, event_type = 'error' AS is_live, ts AS checked_at FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1")
def verdict_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("video_id"), (F.col("event_type") == "error").alias("is_live"), F.col("ts").cast("timestamp").alias("checked_at"), "event_id")
    return writers.upserted(e.filter("event_id % 2 = 0").drop("event_id"), e.filter("event_id % 2 = 1").drop("event_id"), "video_id", "is_live")


@query("SELECT 'lineitem' AS \"table\", count(*) AS rows, CAST(max(l_orderkey) AS VARCHAR) AS max_id FROM lineitem UNION ALL SELECT 'orders', count(*), CAST(max(o_orderkey) AS VARCHAR) FROM orders")
def table_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.fingerprint({"orders": (table(spark, sf_dir, "orders"), "o_orderkey"), "lineitem": (table(spark, sf_dir, "lineitem"), "l_orderkey")})


@query(f"WITH {ENRICHED} SELECT sub_class, video_count_class, count(*) AS videos FROM enriched GROUP BY ALL")
def class_cross_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.class_table(metrics.add_classes(items(spark, sf_dir)))


@query(f"""WITH {SNAPSHOTS}, {ITEMS}, t AS (SELECT sum(n) AS snapshots, count_if(n >= 2) AS items_seen_twice FROM (SELECT video_id, count(*) AS n FROM snaps GROUP BY 1))
SELECT CAST(snapshots AS BIGINT) AS snapshots, CAST(items_seen_twice AS BIGINT) AS items_seen_twice, count(*) AS items, count(DISTINCT channel_id) AS parents, min(published_at) AS first_published, max(published_at) AS last_published, round(avg((likes IS NULL)::INT), 9) AS null_likes FROM t, items GROUP BY ALL""")
def corpus_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reports.corpus_profile(snapshots(spark, sf_dir), items(spark, sf_dir))
    return rounded(out.drop("null_views", "null_comments", "null_subscribers"), ["null_likes"], 9)


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", S.json_or_raw(F.col("props"), "k bigint")["record"]["k"].alias("k"))
