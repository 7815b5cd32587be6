"""Known answers and contracts of the lead library, on small frames."""

import datetime as dt
import random
import statistics
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkleads.functions import scalars as S
from sparkleads.functions import text as X
from sparkleads.operators import discovery, language, latest, leads, metrics, ranking, reports, rules, scoring, settle, taxonomy, themes
from sparkleads.plans import collection
from sparkleads.sources import readers, writers
from sparkleads.streaming import streams

NOW = "2026-07-31 00:00:00"
ENRICHED = "video_id string, channel_id string, title string, channel_name string, published_at timestamp, duration_seconds double, category_id string, views double, likes double, comments double, subscribers double, video_count double, channel_published_at timestamp"


def one(spark, expression, **columns):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()]).select(expression.alias("x")).first()["x"]


@pytest.fixture(scope="module")
def frame(spark):
    rows = []
    for k in range(240):
        day = dt.datetime(2026, 7, 1) - dt.timedelta(days=k % 60)
        rows.append((f"v{k:03d}", f"c{k % 12}", f"red apple story part {'abc'[k % 3]} {['moon', 'river'][k % 2]}", f"name {k % 12}", day, 30.0 if k % 40 == 0 else 200.0, "27", float(1000 + (k * 37) % 900 + (900_000 if k % 24 == 5 else 0)), float(k % 50 + 40), float(500 if k % 24 == 5 else k % 9), float(800 + 300 * (k % 12)), 20.0, dt.datetime(2020, 1, 1)))
    return spark.createDataFrame(rows, ENRICHED)


def test_parsing_and_formatting(spark):
    assert one(spark, S.parse_compact_number(F.lit("1.2M views"))) == 1_200_000
    assert one(spark, S.parse_compact_number(F.lit("1,234"))) == 1234 and one(spark, S.parse_compact_number(F.lit("none"))) is None
    assert one(spark, S.iso_duration_seconds(F.lit("PT1H2M3S"))) == 3723 and one(spark, S.iso_duration_seconds(F.lit("P1D"))) is None
    assert one(spark, S.compact_number(F.lit(1_500_000.0))) == "1.5M" and one(spark, S.compact_number(F.lit(2000.0))) == "2K"
    at = F.lit("2026-07-31 12:00:00").cast("timestamp")
    assert one(spark, S.relative_age_to_time(F.lit("3 weeks ago"), at)) == dt.datetime(2026, 7, 10, 12)
    assert one(spark, S.relative_age_to_time(F.lit("new"), at)) == dt.datetime(2026, 7, 31, 12)
    assert one(spark, S.number(F.lit("N/A"))) is None and one(spark, S.safe_ratio(F.lit(1), F.lit(0))) is None and one(spark, S.safe_ratio(F.lit(1), F.lit(0), 0.0)) == 0.0
    assert one(spark, S.normal_category(F.lit("22.0"))) == "22" and one(spark, S.normal_category(F.lit("misc"))) == "misc"
    assert one(spark, S.binned(F.lit(1000), S.SUB_CLASSES)) == "1k-10k" and one(spark, S.binned(F.lit(None).cast("double"), S.SUB_CLASSES)) == "unknown"
    assert one(spark, S.acceleration_curve(F.lit(2.0), F.lit(40.0))) == pytest.approx(63.212, abs=1e-3) and one(spark, S.acceleration_curve(F.lit(2.0), F.lit(3.0))) == 0.0


def test_compact_numbers_round_halves_up_an_ulp_below(spark):
    below = 150_382.05 / 897  # 167.65 in exact numbers
    assert below < 167.65 and one(spark, S.compact_number(F.lit(below))) == "167.7" and one(spark, S.compact_number(F.lit(1000 * below))) == "167.7K"
    assert one(spark, S.compact_number(F.lit(167.6499))) == "167.6" and one(spark, S.compact_number(F.lit(1e300))).endswith("B")
    assert one(spark, S.fixed(F.lit(0.15 - 2e-16), 1, 12)) == "0.2" and one(spark, S.fixed(F.lit(-0.04))) == "0.0"


def test_labels_in_lines_and_tags(spark):
    lines = F.array(F.lit("Country"), F.lit("--"), F.lit("Rank"), F.lit("7"), F.lit("Tags"), F.lit("x"), F.lit("y"), F.lit("End"))
    assert one(spark, S.after_label(lines, "Rank")) == "7" and one(spark, S.after_label(lines, "Country")) is None and one(spark, S.before_label(lines, "Tags")) == "7"
    assert one(spark, S.between_labels(lines, "Tags", "End")) == ["x", "y"]
    assert one(spark, S.primary_language(F.lit("en-GB"))) == "en" and one(spark, S.primary_language(F.lit("zxx"))) is None and one(spark, S.language_region(F.lit("en-in"))) == "IN"
    assert one(spark, S.is_western_english(F.lit("en-IN"))) is False and one(spark, S.is_western_english(F.lit("en"))) is True
    assert one(spark, S.is_canonical_id(F.lit("UC" + "a" * 22))) is True and one(spark, S.hash_pool(F.lit(""))) == "SEED"


def test_text_forms(spark):
    assert one(spark, X.normalize_title(F.lit("WOW! [HD] Straße #tag | Channel"))) == "wow strasse"
    assert one(spark, X.normalize_text(F.lit("Bob's  don't—stop"))) == "bob dont stop"
    words = spark.range(1).select(X.tokens(F.lit("The Red_Apple, red x 4k apple!")).alias("w"))
    assert words.select(X.ngrams(F.col("w"), 1, 2).alias("x")).first()["x"] == ["red", "apple", "red apple", "apple red"]
    assert one(spark, X.foreign_script_count(F.lit("abc नमस्ते"))) >= 5 and one(spark, X.marker_tokens(F.lit("Él está 'bien' ok"))) == ["esta", "bien"]


def test_latest_rows_and_folds(spark):
    snaps = spark.createDataFrame([(1, "a", "2026-07-01T00:00:00Z", "5", None, "en"), (2, "a", "2026-07-02T00:00:00.5Z", "N/A", "x", None), (3, "a", "2026-07-02T00:00:00.5Z", "7", "y", None), (4, None, "bad", "1", "z", None)], "id long, video_id string, collected_at string, views string, title string, default_language string")
    got = readers.latest_items(snaps).collect()
    assert [(r["id"], r["views"], r["default_language"]) for r in got] == [(3, 7.0, "en")]
    ranked = spark.createDataFrame([(1, ["a"]), (2, ["a", "b"]), (3, ["a"]), (4, ["b"]), (5, []), (6, ["a", "b"])], "o long, t array<string>")
    kept = latest.fold_saturated(ranked, "o", F.struct("o"), "t", 2)
    assert sorted(r["o"] for r in kept.collect()) == [1, 2, 4, 5]
    with pytest.raises(KeyError):
        latest.require_columns(ranked, ["missing"])


def test_leave_one_out_known_answer(spark):
    df = spark.createDataFrame([(str(k), "p", v) for k, v in enumerate([1e3, 2e3, 3e3, 4e3, 1e5])] + [("x", "alone", 5.0)], "video_id string, channel_id string, views double")
    got = {r["video_id"]: (r["m"], r["n"]) for r in ranking.leave_one_out(df, "channel_id", "views", {"m": 0.5}, "n").collect()}
    assert got["4"] == (2500.0, 4) and got["x"] == (None, 0)


def test_average_and_greatest_ranks(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", None), ("b", 9.0)], "g string, v double")
    got = sorted((r["g"], r["v"] or 0, r["p"]) for r in ranking.average_rank_pct(df, ["g"], {"v": "p"}).collect() if r["v"])
    assert got == [("a", 1.0, 1 / 3), ("a", 2.0, 2.5 / 3), ("a", 2.0, 2.5 / 3), ("b", 9.0, 1.0)]
    assert sorted(r["p"] for r in ranking.max_rank_pct(df.dropna(), [], "v", "p").collect()) == [0.25, 0.75, 0.75, 1.0]


def test_scorers_keep_their_contract(spark, frame):
    enriched = metrics.enrich(frame, NOW).persist()
    columns = {"breakout_outliers": scoring.BREAKOUT_COLUMNS, "weight_class_performance": scoring.WEIGHT_CLASS_COLUMNS, "channel_relative": scoring.CHANNEL_COLUMNS, "velocity": scoring.VELOCITY_COLUMNS, "engagement": scoring.ENGAGEMENT_COLUMNS}
    for name, scorer in scoring.SCORERS.items():
        rows = scorer(enriched).collect()
        assert scorer(enriched).columns == columns[name]
        assert len({r["video_id"] for r in rows}) == len(rows) and all(r["score"] == r["score"] for r in rows)
        assert scorer(enriched.limit(0)).collect() == []
        with pytest.raises(KeyError):
            scorer(enriched.drop("views"))
    assert {r["video_id"] for r in scoring.breakout_outliers(enriched).collect()} == {f"v{k:03d}" for k in range(240) if k % 24 == 5}


def test_observed_velocity_and_its_stream(spark, tmp_path):
    rows = [(1, "a", "2026-07-01T00:00:00Z", 10.0), (2, "a", "2026-07-02T00:00:00Z", 30.0), (3, "a", "2026-07-02T06:00:00Z", 25.0), (4, "b", "2026-07-01T00:00:00Z", 5.0), (5, "c", "bad", 1.0)]
    snaps = spark.createDataFrame(rows, "id long, video_id string, collected_at string, views double")
    got = {r["video_id"]: r for r in scoring.observed_velocity(snaps).collect()}
    assert (got["a"]["observed_views_per_day"], got["a"]["snapshot_count"], got["a"]["negative_delta_clipped"]) == (20.0, 3, True)
    assert got["b"]["observed_views_per_day"] is None and got["b"]["observation_span_days"] == 0.0 and "c" not in got
    frames = [snaps.filter("id IN (1, 4)"), snaps.filter("id = 2"), snaps.filter("id = 3")]
    for k, df in enumerate(frames):
        df.coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source = spark.readStream.schema(snaps.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    query = streams.daily_usage(source.select(S.instant(F.col("collected_at")).alias("used_at"), F.col("views").alias("units"))).writeStream.outputMode("complete").format("memory").queryName("usage").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("usage").agg(F.sum("calls")).first()[0] == 4


def test_streaming_ingest_is_idempotent(spark, tmp_path):
    rows = [("a", 1.0, dt.datetime(2026, 7, 1)), ("a", 1.0, dt.datetime(2026, 7, 1, 5)), ("a", 1.0, dt.datetime(2026, 7, 2))]
    df = spark.createDataFrame(rows, "video_id string, views double, collected_at timestamp")
    append = streams.append_batches(f"{tmp_path}/out", ["video_id", "views", "collected_at"])
    append(df, 0)
    append(df, 1)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2


def test_themes_and_saturation(spark, frame):
    found = {r["term"]: r for r in themes.extract_themes(frame.filter("views > 500000"), frame, themes.ThemeParams(min_lead_count=1, min_distinct_channels=1)).collect()}
    assert found["red"]["lift"] > 0 and found["red"]["channel_hhi"] <= 1.0
    pairs = spark.createDataFrame([("t", "a"), ("t", "a"), ("t", "b"), ("u", "a"), ("u", "b"), ("u", "c")], "term string, channel_id string")
    got = {r["term"]: (r["channel_hhi"], r["effective_channels"]) for r in themes.concentration(pairs, ["term"]).collect()}
    assert got["t"] == (pytest.approx(5 / 9), pytest.approx(1.8)) and got["u"] == (pytest.approx(1 / 3), pytest.approx(3.0))
    assert themes.niche_saturation(frame, frame.filter("views > 500000")).first()["outlier_videos"] == 10


def test_term_repeats_are_capped_over_all_rows(spark):
    rng = random.Random(4)
    rows = [(k if k else None, sorted(rng.sample("abcdefghijklmnopqrstuvwxyz", rng.randrange(4)))) for k in range(400)]
    shown, want = Counter(), []
    for k, terms in rows:
        if not terms or any(shown[t] < 3 for t in terms):
            shown.update(terms)
            want.append(k)
    ranked = spark.createDataFrame(rows, "k int, t array<string>").repartition(3)
    got = latest.fold_saturated(ranked, "k", F.struct(F.coalesce("k", F.lit(0))), "t", 3).collect()
    assert sorted(r["k"] or 0 for r in got) == [k or 0 for k in want]


def test_caps_are_greedy_over_all_rows(spark):
    rng = random.Random(9)
    rows = [(k, rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") + str(k % 7), rng.choice([None, "p", "q", "r", *"abcdefghij"]), rng.choice(["x", "y", "z"]), rng.choice([1, 2, 3])) for k in range(300)]
    shown, want = Counter(), []
    for k, title, parent, topic, limit in rows:
        keys = {"title": (title, 1), "parent": (parent, limit), "topic": (topic, 25)}
        if all(shown[n, x] < most for n, (x, most) in keys.items() if x is not None):
            shown.update((n, x) for n, (x, _) in keys.items())
            want.append(k)
    df = spark.createDataFrame(rows, "k int, title string, parent string, topic string, most int").repartition(3)
    caps = {"title": (F.col("title"), F.lit(1)), "parent": (F.col("parent"), F.col("most")), "topic": (F.col("topic"), F.lit(25))}
    assert sorted(r["k"] for r in latest.fold_caps(df, [F.col("k")], caps).collect()) == want
    free = spark.createDataFrame([(1, None), (2, None)], "k int, t string")
    assert latest.fold_caps(free, [F.col("k")], {"t": (F.col("t"), F.lit(1))}).count() == 2 and latest.fold_caps(free.limit(0), [F.col("k")], {"t": (F.col("t"), F.lit(1))}).count() == 0


def test_topic_scores_keep_all_leads_without_themes(spark):
    names = F.concat(*[F.translate(F.hex(F.xxhash64("id", F.lit(k))), "0123456789", "ghijklmnop") for k in range(2)])
    leads = spark.range(5_200).select(F.col("id").cast("string").alias("video_id"), F.lit("c").alias("channel_id"), names.alias("title"), F.lit("n").alias("channel_name"), F.lit(10.0).alias("subscribers"), F.col("id").cast("double").alias("views"), F.lit("27").alias("category_id"), F.lit(NOW).cast("timestamp").alias("published_at"))
    assert themes.score_topics(leads, leads).count() == 5_200


def test_topic_scores_look_at_few_rows_of_the_corpus(spark, monkeypatch):
    """All rows of the corpus were ordered for the leads' sake, and equal titles split into words one by one."""
    title = F.when(F.col("id") % 4 == 0, F.lit("--")).when(F.col("id") % 4 == 1, F.lit(None).cast("string")).otherwise(F.concat(F.lit("red cart "), F.element_at(F.array(F.lit("ox"), F.lit("elk")), (F.col("id") % 2 + 1).cast("int"))))
    corpus = spark.range(40).select(F.col("id").cast("string").alias("video_id"), (F.col("id") % 5).cast("string").alias("channel_id"), title.alias("title"), F.lit("n").alias("channel_name"), F.lit(10.0).alias("subscribers"), F.col("id").cast("double").alias("views"), F.lit("27").alias("category_id"), F.lit(NOW).cast("timestamp").alias("published_at"))
    seen, compared, split, best = [], [], themes.with_words, themes.best_per_key
    monkeypatch.setattr(themes, "with_words", lambda df, *more: seen.append(df.count()) or split(df, *more))
    monkeypatch.setattr(themes, "best_per_key", lambda df, *more: compared.append(df.count()) or best(df, *more))
    corpus = settle.settled(corpus)
    _, whole = themes.background_counts(corpus, spark.createDataFrame([("red",)], "term string"), themes.ThemeParams(stopwords=()))
    assert tuple(whole.first()) == (22, 22, 0) and seen == [4]  # ten rows without a word, ten without a title, two titles
    leads = corpus.filter("video_id IN ('2', '3')")
    filled = themes.attach_missing(leads.drop("channel_id"), corpus).orderBy("video_id").collect()
    assert [(r["video_id"], r["channel_id"]) for r in filled] == [("2", "2"), ("3", "3")] and compared == [2]


def test_halves_of_topic_scores_go_as_in_sql(spark):
    """Scores of nine digits that SQL rounds down to six: their products with a million end below the half."""
    from sparkleads.plans.queries import rounded_scaled

    df = spark.createDataFrame([(66.4492495,), (65.5805415,), (1.5,), (None,)], "v double")
    assert [r["v"] for r in rounded_scaled(df, ["v"]).collect()] == [66.449249, 65.580541, 1.5, None]


def test_rules(spark):
    made = rules.Rule(("Red*", "bob's"), note="n")
    assert made.terms == ("bob", "red*") and rules.add_rule([made], made) == [made] and rules.remove_rule([made], made.rule_id) == []
    df = spark.createDataFrame([("Bob's reddish day",), ("bob is blue",), (None,)], "title string")
    assert rules.apply_rules(df, [made]).count() == 2 and rules.partition(df, [made])[1].count() == 1
    assert rules.reach(df, [made]).first()["matched_rows"] == 1
    with pytest.raises(ValueError):
        rules.Rule(("ab*",))
    assert len(readers.rules_from('[{"terms": ["x y"]}, "foo", {"bad": 1}, "foo"]')) == 2 and readers.rules_from("{") == []


def test_the_index_of_many_rules_finds_what_patterns_find(spark, monkeypatch):
    rng = random.Random(11)
    words = ["red", "redder", "blue", "bob's", "cart", "carts", "it’s", "plate", "x1", "ox"]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(6))) or None, rng.choice(["plate red", None, "Blue-Cart"])) for k in range(80)] + [(None, "Red plate", "x"), (None, "Red plate", "x")]
    df = spark.createDataFrame(rows, "i int, title string, name string")
    made = {rules.Rule(tuple(rng.choice(["red", "blue cart", "red*", "car*", "plate", "bob*", "its", "x1 ox", "blue ca*"]) for _ in range(rng.randrange(1, 3))), fields=rng.choice([("title",), ("title", "name"), ("gone",)])) for _ in range(40)}

    def found():
        reached = sorted(map(tuple, rules.reach(df, list(made)).collect()))
        first = sorted(map(repr, rules.with_first_match(df, list(made)).collect()))
        return reached, first, sorted(map(repr, rules.apply_rules(df, list(made)).collect()))

    monkeypatch.setattr(rules, "DIRECT", 1000)
    direct = found()
    monkeypatch.setattr(rules, "DIRECT", 0)
    assert found() == direct and any(r[3] for r in direct[0])


def test_topics(spark):
    df = spark.createDataFrame([("1", "Rye bread from one oven", "26"), ("2", "minecraft rye bread", "10"), ("3", "rye bread song", "10"), ("4", None, None), ("5", "grill test: smoked brisket", "26"), ("6", "PICKLED green tomatoes", "1")], "video_id string, title string, category_id string")
    assert sorted((r["video_id"], r["topic"], r["confidence"]) for r in taxonomy.classify(df, taxonomy.KITCHEN).collect()) == [("1", "baking", 4), ("6", "preserves", 2)]
    gated = spark.createDataFrame([("1", "PV inverter on the roof", "28"), ("2", "pv inverter", "28"), ("3", "inverter", "28"), ("4", "solar eclipse inverter", "28")], "video_id string, title string, category_id string")
    assert [r["video_id"] for r in taxonomy.classify(gated, taxonomy.SOLAR).collect()] == ["1"]


def test_scripts_are_all_but_latin_and_shared_ones(spark):
    rows = [("ABC é ﬁ 123 😀 ́", 0), ("Привет", 6), ("ᠮᠣᠩᠭᠣᠯ", 6), ("ދިވެހި", 6), ("ܣܘܪܝܝܐ", 6), ("ꆈꌠ", 2), ("ᏣᎳᎩ", 3), ("नमस्ते", 6), ("日本 ab", 2), (None, 0)]
    df = spark.createDataFrame(rows, "t string, n int")
    assert [r["got"] for r in df.select(X.foreign_script_count(F.col("t")).alias("got")).collect()] == [n for _, n in rows]


def test_stopwords_follow_the_languages_of_the_frames(spark):
    assert "und" in X.stopwords_for(["de-AT", None, "xx"]) and "und" not in X.stopwords_for(["en"])
    df = spark.createDataFrame([("1", "de"), ("2", "en-GB"), ("3", None), ("4", "zz")], "video_id string, channel_language string")
    p = themes.resolved(themes.ThemeParams(), df, None)
    assert "und" in p.stopwords and "about" in p.stopwords and themes.resolved(themes.ThemeParams(stopwords=("x",)), df).stopwords == ("x",)


def test_breakout_parameters(spark):
    rows = [("a", 100_000.0, 1000.0, None, 10.0, 0.01, 0.0), ("b", 100_000.0, 1000.0, float("nan"), 90.0, 0.0, None), ("c", 100_000.0, 1000.0, 3.0, 10.0, 0.01, 0.01)]
    df = spark.createDataFrame(rows, "video_id string, views double, subscribers double, views_per_sub double, video_age_days double, like_rate double, comment_rate double")
    df = df.withColumns({c: F.lit(None).cast("string") for c in ("title", "channel_name", "published_at")} | {"channel_id": F.lit("p"), "video_count": F.lit(1.0), "comments": F.lit(1.0), "views_per_day": F.lit(1.0)})

    def got(**p):
        return {r["video_id"]: r["views_per_sub"] for r in scoring.breakout_outliers(df, **p).collect()}

    assert got() == {"a": 100.0} and got(require_engagement=False) == {"a": 100.0, "b": 100.0} and got(require_engagement=False, max_age_days=30) == {"a": 100.0}
    with pytest.raises(ValueError):
        got(views_exponent=-1)


def test_profiles_have_the_common_columns(spark):
    df = spark.createDataFrame([("c", 5, "z")], "channel_id string, subscribers_total long, other string")
    row = S.channel_profile(df, "s").first().asDict()
    assert list(row) == list(S.PROFILE_COLUMNS) and row["source"] == "s" and row["subscribers_total"] == "5" and row["raw_rendered_text"] == [] and row["engagement"] is None


def test_ranges_change_no_rank(spark, monkeypatch):
    rows = [(g, float(v % 37) if v % 5 else None) for g in ("x", "y", None) for v in range(200)] + [("x", 7.0)] * 300
    df = spark.createDataFrame(rows, "g string, v double").withColumns({"i": F.monotonically_increasing_id(), "w": -F.col("v")})
    kept = settle.settled(df)

    def all_of_them():
        out = ranking.average_rank_pct(kept, ["g"], {"v": "p", "w": "q"}).collect()
        top = ranking.max_rank_pct(kept, [], "v", "p").collect()
        mad = ranking.median_mad(kept, ["g"], "v").collect()
        rest = ranking.leave_one_out(kept, "g", "v", {"m": 0.5, "h": 0.9}, "n").collect()
        z = ranking.robust_z(kept, "g", "v", "z", "s", "c").collect()
        shown = lambda rows: sorted(repr([round(x, 9) if isinstance(x, float) else x for x in r]) for r in rows)
        return [shown(x) for x in (out, top, mad, rest, z)]

    plain = all_of_them()
    monkeypatch.setattr(ranking, "TASK_VALUES", 25)
    monkeypatch.setattr(ranking, "DIRECT_PAIRS", 0)
    assert all_of_them() == plain


def test_positions_of_frequent_values_are_spread(spark, monkeypatch):
    monkeypatch.setattr(ranking, "TASK_VALUES", 50)
    rows = [("a", 3.0)] * 900 + [("a", float(k)) for k in range(100)] + [("b", 1.0), ("b", None), (None, 2.0)]
    placed = ranking.positions(settle.settled(spark.createDataFrame(rows, "g string, v double")), ["g"], "v")
    got = {(r["g"], r["v"]): (r["before"], r["c"], r["n"]) for r in placed.collect()}
    assert got == {("a", float(k)): (k if k <= 3 else 900 + k, 901 if k == 3 else 1, 1000) for k in range(100)} | {("b", 1.0): (0, 1, 1), ("b", None): (None,) * 3, (None, 2.0): (0, 1, 1)}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    dealt = placed.filter("v = 3").groupBy(F.spark_partition_id()).count().count()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert dealt > 1


@pytest.mark.parametrize(("task_values", "buckets"), [(200_000, 1024), (40, 16)])
def test_median_and_spread_of_all_other_groups(spark, monkeypatch, task_values, buckets):
    monkeypatch.setattr(ranking, "TASK_VALUES", task_values)
    monkeypatch.setattr(ranking, "BUCKETS", buckets)
    rng = random.Random(3)
    rows = [("big", rng.choice([1.0, 2.5, 9.0]) if k % 2 else rng.gauss(0, 5)) for k in range(300)]
    rows += [(f"g{k % 60}", round(rng.paretovariate(0.8), 1)) for k in range(240)] + [(None, 4.0), ("alone", 1e9)]
    long = settle.settled(spark.createDataFrame([("x", *r) for r in rows], "_what string, g string, v double"))
    placed = ranking.positions(ranking.positions(long, ["_what", "g"], "v", ("_bg", "_cg", "_ng")), ["_what"], "v", ("_ba", "_ca", "_na"))
    got = {r["g"]: (r["rest_median"], r["rest_mad"]) for r in ranking.rest_median_mad(settle.settled(placed), "g").collect()}
    want = {}
    for g in {g for g, _ in rows if g}:
        others = [v for h, v in rows if h != g]
        m = statistics.median(others)
        want[g] = m, statistics.median([abs(v - m) for v in others])
    assert got.keys() == want.keys()
    for g in want:
        assert got[g] == pytest.approx(want[g], rel=1e-12), g


def test_scales_of_groups_look_at_few_rows_again(spark, monkeypatch):
    """Each row used to be listed once for every group that it isn't in, and the quantiles of these lists taken."""
    monkeypatch.setattr(ranking, "TASK_VALUES", 40)
    monkeypatch.setattr(ranking, "BINS", 64)
    monkeypatch.setattr(ranking, "quantiles", None)
    rng = random.Random(5)
    rows = [(f"g{k % 4}", rng.gauss(k % 3, 1 + k % 4), rng.paretovariate(0.7)) for k in range(600)] + [("g1", 0.5, -2.0)] * 100
    rows += [("few", 3.0, 4.0), ("few", None, 8.0), (None, 1.0, None), ("far", 1e9, -1e9)]
    df = settle.settled(spark.createDataFrame(rows, "g string, a double, b double"))
    got = ranking.robust_zs(df, "g", {"a": ("za", "sa", "ca"), "b": ("zb", "sb", "cb")}).collect()
    for value, at in (("a", 1), ("b", 2)):
        known = [(r[0], r[at]) for r in rows if r[at] is not None]
        for g in {r[0] for r in rows} - {None}:
            own, others = ([v for h, v in known if (h == g) == mine] for mine in (True, False))
            peers = own if len(own) >= 30 else others
            m = statistics.median(peers)
            k = 1.4826 * statistics.median([abs(v - m) for v in peers])
            for r in got:
                if r["g"] == g and r[value] is not None:
                    assert (r[f"c{value}"], r[f"z{value}"]) == pytest.approx((m, (r[value] - m) / k), rel=1e-12, abs=1e-12), (g, value)


def test_a_query_leaves_nothing_behind(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}"
    monkeypatch.setattr(settle, "shared_folder", lambda _: folder)
    fs, path = settle.file_system(spark, folder)
    names = lambda: {x.getPath().getName() for x in fs.listStatus(path)} if fs.exists(path) else set()
    held = names()
    rows = spark.createDataFrame([(f"g{k % 3}", float(k)) for k in range(60)], "g string, v double")
    with settle.scope(spark):
        assert ranking.robust_z(settle.settled(rows), "g", "v", "z", "s", "c").count() == 60 and names() > held
        with settle.scope(spark) as inner:
            kept = settle.settled(rows)
        assert not fs.exists(settle.file_system(spark, inner.folder)[1])
        with pytest.raises(Exception):  # noqa: B017
            kept.collect()
    assert names() == held
    with pytest.raises(ZeroDivisionError), settle.scope(spark):
        settle.settled(rows)
        1 / 0  # noqa: B018
    assert names() == held
    left = settle.Scope(spark)
    rows.write.parquet(left.fresh())
    assert settle.sweep(spark, hours=1) == 0 and settle.sweep(spark, hours=-1) >= 1 and not fs.exists(settle.file_system(spark, left.folder)[1])


def test_known_handles(spark):
    new = spark.createDataFrame([("@Abc",), ("zz",), ("@",), (None,)], "handle string")
    known = spark.createDataFrame([("xABCx",), (None,)], "name string")
    assert [r[0] for r in discovery.known_profile(new, known).collect()] == ["zz", None]
    assert discovery.known_profile(new, known.limit(0)).count() == 4 and discovery.known_profile(new.limit(0), known).count() == 0


def test_known_handles_of_long_names_equal_brute_force(spark):
    rng = random.Random(8)
    names = ["".join(rng.choice("abcd ") for _ in range(rng.choice([3, 40, 200]))) for _ in range(30)] + [None, "", "Ab"]
    handles = ["@" + "".join(rng.choice("abcdE") for _ in range(n)) for n in (0, 1, 2, 2, 3, 4, 5, 6, 7) for _ in range(8)] + [names[3][:20], names[5][10:30], None, "@" + names[2]]
    got = discovery.known_profile(spark.createDataFrame([(h,) for h in handles], "handle string"), spark.createDataFrame([(n,) for n in names], "name string"))
    low = [n.lower() for n in names if n is not None]
    want = [h for h in handles if h is None or not any((h[1:] if h.startswith("@") else h).lower() in n for n in low)]
    assert sorted((r["handle"] or "~") for r in got.collect()) == sorted((h or "~") for h in want)
    assert discovery.known_profile(got, spark.createDataFrame([], "name string")).count() == len(want)


def test_language_tiers(spark):
    rows = [("f", "x", "de", None), ("f", "y", "en", None), ("r", "x", "en-IN", None), ("e", "x", "en-GB", "es"), ("u", "x", None, None), ("w", "x", "en-US", None)]
    items = spark.createDataFrame(rows, "channel_id string, title string, default_audio_language string, default_language string")
    got = {r["channel_id"]: (r["channel_language"], r["language_source"]) for r in language.parent_languages(items).collect()}
    assert got == {"f": ("de", "audio"), "r": ("en-in", "region"), "e": ("es", "text"), "u": ("und", "unavailable"), "w": ("en", "audio")}
    kept = language.filter_english(language.annotate(items, language.parent_languages(items)))
    assert {r["channel_id"] for r in kept.collect()} == {"u", "w"}


def test_leads_end_to_end(spark, frame, tmp_path):
    stages = writers.Stages(spark, str(tmp_path))
    verdicts = spark.createDataFrame([("v005", True), ("v029", False)], "video_id string, is_short boolean")
    out = leads.generate_leads(frame, NOW, verdicts=verdicts, top_n=5, materialise=stages, params={"channel_relative": {"min_multiple": 3}})
    rows = out.collect()
    assert len(rows) == 5 and "v005" not in {r["video_id"] for r in rows} and rows[0]["algorithms_hit"] >= 2
    assert [r["composite_score"] for r in rows] == sorted((r["composite_score"] for r in rows), reverse=True)
    broken = leads.run_scorers(leads.AnalysisFrame(metrics.enrich(frame, NOW), None), scorers={"bad": lambda df: df.select("nope")}, topics=False)
    assert "bad" in broken.failures and broken.frames["bad"].count() == 0
    writers.export_csv(out, f"{tmp_path}/csv", one_file=True)
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").count() == 5


def test_composite_is_the_plain_blend_of_all_scorers(spark, frame):
    history = spark.createDataFrame([("v005", f"2026-07-{d:02} 00:00:00", float(d * 9000), d) for d in (1, 5, 9)] + [("v029", "2026-07-02 00:00:00", 5.0, 4)], "video_id string, collected_at string, views double, id long")
    made = leads.analysis_frame(frame, NOW, history)
    options = {"breakout_outliers": {"min_views": 5_000}, "channel_relative": {"min_views": 5_000}, "velocity": {"min_views": 100, "min_score": 1}, "engagement": {"min_comment_z": 0.1, "min_comments": 1}, "weight_class_performance": {"min_score": 0.5, "min_views": 500}}
    results = leads.run_scorers(made, options)
    assert not results.failures and all(n in results.frames for n in leads.WEIGHTS)
    want = {}
    for n in leads.WEIGHTS:
        rows = results.frames[n].collect()
        for r in rows:
            share = sum(x["score"] <= r["score"] for x in rows) / len(rows)
            want.setdefault(r["video_id"], []).append((n, share, r["score"], r["reason"]))
    got = leads.combine(leads.normalize_scores(results.frames), made.items).collect()
    assert {r["video_id"] for r in got} == want.keys() and len(got) == len(want)
    titles = {r["video_id"]: (r["title"], r["channel_id"], r["views"]) for r in frame.collect()}
    for r in got:
        hits = want[r["video_id"]]
        total = sum(share * leads.WEIGHTS[n] for n, share, _, _ in hits) * (1 + leads.CORROBORATION * (len(hits) - 1))
        assert r["composite_score"] == pytest.approx(total) and r["algorithms_hit"] == len(hits) and r["algorithms"] == ",".join(n for n, *_ in hits)
        assert r["reasons"] == " | ".join(reason for *_, reason in hits) and all(r[f"raw_{n}"] == raw for n, _, raw, _ in hits)
        assert (r["title"], r["channel_id"], r["views"]) == titles[r["video_id"]]
    order = [(r["composite_score"], r["algorithms_hit"], r["views"]) for r in leads.ordered(leads.combine(leads.normalize_scores(results.frames), made.items)).collect()]
    assert order == sorted(order, reverse=True)


def test_discovery(spark):
    e = spark.createDataFrame([(dt.datetime(2026, 7, 1), "s1", "v1", "c1", "k1", "health", 3, 1, "t"), (dt.datetime(2026, 7, 2), "s2", "v2", "c1", "k1", None, 0, 1, "t"), (dt.datetime(2026, 7, 3), "s1", "v3", "c2", "k2", None, 0, 1, "t"), (dt.datetime(2026, 7, 4), "s3", "v4", "c3", "k3", None, 0, 1, "t")], "observed_at timestamp, seed_video_id string, video_id string, channel_id string, channel_key string, matched_topic string, confidence int, depth int, classifier_version string")
    assert discovery.crawl_yield(e, "t").first()["yield_rate"] == 0.25
    queue = discovery.rebuild_queue(e, "t")
    again = discovery.rebuild_queue(e, "t", discovery.set_status(queue, queue.select("channel_key"), "rejected"))
    assert [r["status"] for r in again.collect()] == ["rejected"]
    with pytest.raises(ValueError):
        discovery.set_status(queue, queue, "odd")


def test_payloads_and_writers(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"items": [{"id": "UC1", "snippet": {"title": "n"}, "statistics": {"subscriberCount": "5", "hiddenSubscriberCount": true, "viewCount": ""}}]}')
    row = readers.channel_rows(readers.payload(spark, str(tmp_path / "p.json"), readers.CHANNEL_PAYLOAD)).first()
    assert row["channel_name"] == "n" and row["subscribers"] is None and row["views"] is None
    verdicts = spark.createDataFrame([("a", True, dt.datetime(2026, 1, 1)), ("a", False, dt.datetime(2026, 1, 2))], "video_id string, is_live boolean, checked_at timestamp")
    assert writers.upserted(None, verdicts, "video_id", "is_live").first()["is_live"] is False
    with pytest.raises(ValueError):
        writers.upserted(None, verdicts.withColumn("is_live", F.lit(None).cast("boolean")), "video_id", "is_live")
    with pytest.raises(ValueError):
        writers.append_valid(verdicts.withColumn("o", F.lit("odd")), f"{tmp_path}/log", "o", writers.OUTCOMES)
    writers.save_rules(spark, [rules.Rule(("foo",))], f"{tmp_path}/rules")
    assert [r.terms for r in readers.read_rules(spark, f"{tmp_path}/rules")] == [("foo",)]


def test_writers_of_labels_evidence_bands_and_lexicons(spark, tmp_path):
    for version, topic in (("t1", "a"), ("t2", "b"), ("t1", "c")):
        writers.write_labels(spark.createDataFrame([("v", topic, version)], "video_id string, topic string, classifier_version string"), f"{tmp_path}/labels")
    assert sorted((r["classifier_version"], r["topic"]) for r in spark.read.parquet(f"{tmp_path}/labels").collect()) == [("t1", "c"), ("t2", "b")]
    for _ in range(2):
        writers.append_evidence(spark.createDataFrame([(1,)], "x int"), f"{tmp_path}/evidence")
    assert spark.read.parquet(f"{tmp_path}/evidence").count() == 2
    leads_ = spark.createDataFrame([("a", 5.0), ("b", 900.0), ("c", 70.0), ("d", None)], "video_id string, views double")
    writers.export_bands(leads_, f"{tmp_path}/bands", F.when(F.col("views") > 50, "big").otherwise("small"), "views")
    assert [r["video_id"] for r in spark.read.option("header", True).csv(f"{tmp_path}/bands/band=big").collect()] == ["b", "c"]
    writers.write_lexicon(spark.createDataFrame([("b",), ("a",), ("b",)], "token string"), f"{tmp_path}/lexicon")
    assert [r[0] for r in spark.read.text(f"{tmp_path}/lexicon").collect()] == ["a", "b"]
    old = spark.createDataFrame([("v", None, "fr"), ("w", "de", None), ("x", None, None)], "video_id string, default_audio_language string, default_language string")
    new = spark.createDataFrame([("v", "en", "en"), ("w", "en", "en")], old.schema)
    assert sorted(map(tuple, writers.backfilled(old, new).collect()), key=str) == [("v", "en", "fr"), ("w", "de", "en"), ("x", None, None)]


def test_files_of_uploads_and_csv(spark, tmp_path):
    (tmp_path / "page.json").write_text('{"items": [{"contentDetails": {"videoId": "v1"}}, {"contentDetails": {}}, {}]}')
    assert [r[0] for r in readers.upload_ids(readers.payload(spark, str(tmp_path / "page.json"), readers.UPLOADS_PAYLOAD)).collect()] == ["v1"]
    (tmp_path / "languages.json").write_text('{"items": [{"id": "v1", "snippet": {"defaultLanguage": "de"}}, {"id": "v2", "snippet": {}}, {"snippet": {"defaultLanguage": "fr"}}]}')
    assert [tuple(r) for r in readers.language_rows(readers.payload(spark, str(tmp_path / "languages.json"), readers.VIDEO_PAYLOAD)).collect()] == [("v1", None, "de")]
    for k in range(2):
        (tmp_path / f"{k}.csv").write_text("a,b\n1,x\n2,y\n")
    assert readers.csv_union(spark, [str(tmp_path / "0.csv"), str(tmp_path / "1.csv")]).count() == 2


def test_reports_over_tables_plots_and_topics(spark, frame):
    frame.select("video_id", F.lit(1).alias("id")).createOrReplaceTempView("seen_items")
    seen = reports.catalog_overview(spark)["seen_items"]
    assert seen["rows"] == 240 and seen["newest"].count() == 5
    spark.catalog.dropTempView("seen_items")
    drawn = reports.plot_sample(metrics.add_classes(frame), most=50, per_class=20)
    assert drawn.count() <= 50 and max(drawn.groupBy("sub_class").count().toPandas()["count"]) <= 20 and "log10_views" in drawn.columns
    named = frame.withColumn("title", F.when(F.col("video_id") < "v100", "rye bread").otherwise("none"))
    report = reports.topic_report(named, taxonomy.KITCHEN)
    assert report["share"].first()["labelled"] == 100 and [r["videos"] for r in report["topics"].collect()] == [100]
    assert sum(r["videos"] for r in report["bands"].collect()) == 100 and report["consistency"].count() <= 15


def test_missing_columns_come_from_the_corpus_and_best_rows_stay(spark, frame):
    given = spark.createDataFrame([("v001", 0.5, "own"), ("v001", 0.9, None), ("zzz", 0.1, None)], "video_id string, score double, title string")
    filled = {(r["video_id"], r["score"]): (r["title"], r["channel_id"]) for r in themes.attach_missing(given, frame).collect()}
    assert filled["v001", 0.5] == ("own", "c1") and filled["v001", 0.9][0].startswith("red apple") and filled["zzz", 0.1] == (None, None)
    assert sorted((r["video_id"], r["score"]) for r in leads.best_by_result(given).collect()) == [("v001", 0.9), ("zzz", 0.1)]


def test_language_detector_sees_pooled_titles(spark):
    items = spark.createDataFrame([("a", "bonjour le monde", None, None), ("a", "encore", None, None), ("b", None, None, None), ("c", "Привет мир", None, None)], "channel_id string, title string, default_audio_language string, default_language string")
    detect = lambda c: F.struct(F.when(F.contains(c, F.lit("bonjour")), "fr").when(c.isNotNull(), "ru").alias("tag"), F.lit(0.7).alias("confidence"))
    got = {r["channel_id"]: (r["channel_language"], r["language_source"]) for r in language.parent_languages(items, None, detect).collect()}
    assert got == {"a": ("fr", "detected"), "b": ("und", "detected"), "c": ("ru", "script")}


def test_rollups_of_queue_and_logs(spark):
    queue = spark.createDataFrame([("a", None, 0, "2026-01-01", None), ("a", None, 0, None, 1), ("b", 1, 0, None, None)], "assigned_source string, digested int, needs_review int, api_success_at string, api_failed int")
    assert [tuple(r) for r in reports.queue_by_state(queue).collect()] == [("a", None, 0, 2), ("b", 1, 0, 1)]
    assert tuple(reports.collection_progress(queue).first()) == (1, 1, 1) and tuple(reports.collection_progress(queue.limit(0)).first()) == (0, 0, 0)
    log = spark.createDataFrame([(k, "e" if k % 2 else "w") for k in range(10)], "id long, kind string")
    assert [r["id"] for r in reports.newest_rows(log, ["id"], 2, where=F.col("kind") == "e").collect()] == [9, 7]


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
    assert reports.class_table(spark.createDataFrame([("a", "b")], "sub_class string, video_count_class string")).count() == 1


def test_positions_over_many_ranges(spark, monkeypatch, capsys):
    monkeypatch.setattr(ranking, "TASK_VALUES", 50)
    draw = random.Random(5)
    rows = [(k, "a" if k % 5 else "b", 7.0 if k % 3 == 0 else None if k % 11 == 0 else float(draw.randrange(400))) for k in range(2000)]
    rows += [(2000 + k, None, 1.0) for k in range(300)] + [(2300, "c", 3.0), (2301, "d", None)]
    df = settle.settled(spark.createDataFrame(rows, "id long, g string, v double"))
    found = ranking.positions(df, ["g"], "v")
    for r in found.collect():
        own = [v for _, g, v in rows if g == r["g"] and v is not None]
        expected = (None, None, None) if r["v"] is None else (sum(v < r["v"] for v in own), own.count(r["v"]), len(own))
        assert (r["before"], r["c"], r["n"]) == expected, r
    assert found.count() == len(rows)
    found.explain(True)
    assert "lambda" not in capsys.readouterr().out  # no row looks through a list of cuts, which grows with the table


@pytest.mark.parametrize("sketch", [10_000, 3])
def test_quantiles_of_large_groups_come_between_brackets(spark, monkeypatch, sketch):
    monkeypatch.setattr(ranking, "TASK_VALUES", 400)
    monkeypatch.setattr(ranking, "SKETCH", sketch)
    rng = random.Random(5)
    held = {"a": [rng.gauss(0, 5) for _ in range(1501)], "same": [3.0] * 900, "few": [1.0, 4.0], None: [rng.choice([-1.0, -0.0, 0.0, 2.0]) for _ in range(800)], "steps": [float(k % 7) for k in range(602)]}
    rows = settle.settled(spark.createDataFrame([(g, v) for g, vs in held.items() for v in [*vs, None]], "g string, v double"))
    ranked = []
    monkeypatch.setattr(ranking, "positions", lambda *a, _of=ranking.positions, **k: ranked.append(1) or _of(*a, **k))
    got = {r["g"]: tuple(r)[1:] for r in ranking.quantiles(rows, ["g"], "v", {"m": 0.5, "lo": 0.0, "q": 0.9}).collect()}
    for g, vs in held.items():
        assert got[g] == pytest.approx((len(vs), *np.quantile(vs, [0.5, 0.0, 0.9])), abs=1e-12), g
    everything = [v for vs in held.values() for v in vs]
    assert tuple(ranking.quantiles(rows, [], "v", {"m": 0.5}).first()) == pytest.approx((len(everything), np.median(everything)), abs=1e-12)
    assert sketch < 10_000 or not ranked  # large groups aren't ordered


def test_titles_are_collapsed_in_one_scan(spark):
    rows = settle.settled(spark.createDataFrame([(1, "a b"), (2, "a b"), (3, ""), (4, ""), (5, None), (6, None), (7, "c")], "i int, sig string"))
    out = latest.collapse_titles(rows, "sig", [F.col("i")])
    assert out._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert sorted(map(tuple, out.collect()), key=lambda r: r[0]) == [(1, "a b"), (3, ""), (4, ""), (5, None), (6, None), (7, "c")]


def test_every_range_is_one_task(spark, monkeypatch):
    monkeypatch.setattr(ranking, "TASK_VALUES", 50)
    rows = settle.settled(spark.createDataFrame([("a" if k % 3 else "b", float(k % 500)) for k in range(2000)], "g string, v double"))
    held = []
    monkeypatch.setattr(ranking, "_within", lambda df, *a, _of=ranking._within: held.append(df) or _of(df, *a))
    placed = ranking.positions(rows, ["g"], "v")
    assert placed.filter("before IS NULL OR before >= n").isEmpty() and placed.count() == 2000
    ranges = held[0].groupBy(F.spark_partition_id()).agg(F.countDistinct("_part")).collect()
    assert len(ranges) > 20 and {r[1] for r in ranges} == {1}


def test_ranked_scorers_settle_numbers_not_rows(spark, frame, monkeypatch):
    with settle.scope(spark):
        rows = ranking.numbered(metrics.enrich(frame, NOW))
        scorers = {"weight_class_performance": {"min_score": 0.5, "min_views": 500}, "velocity": {"min_views": 100, "min_score": 1}}
        plain = {n: sorted(map(repr, scoring.SCORERS[n](rows, **options).collect())) for n, options in scorers.items()}
        written, write = [], settle.settled
        for module in (settle, ranking, scoring):
            monkeypatch.setattr(module, "settled", lambda df, *home: written.append(df.columns) or write(df, *home))
        monkeypatch.setattr(ranking, "TASK_VALUES", 25)
        for n, options in scorers.items():
            assert plain[n] and sorted(map(repr, scoring.SCORERS[n](rows, **options).collect())) == plain[n]
        assert len(written) > 10 and not [c for c in written if "title" in c]


def test_only_the_last_table_of_a_step_stays(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(settle, "shared_folder", lambda _: f"file://{tmp_path}")
    rows = spark.range(100)
    setting = spark.conf.get(settle.SHORT_LIVED, None)
    with settle.scope(spark) as own:
        made = settle.alone(spark, lambda: settle.settled(settle.settled(rows).groupBy((F.col("id") % 7).alias("k")).count()))
        held = [x.name for folder in tmp_path.iterdir() for x in folder.iterdir() if x.is_dir()]
        assert made.count() == 7 and held == [made._settled_at.rsplit("/", 1)[-1]] and made._settled_at.startswith(own.folder)
    assert not [x for x in tmp_path.iterdir() if x.is_dir()] and spark.conf.get(settle.SHORT_LIVED, None) == setting


def _tables(folder):
    return [x.name for own in folder.iterdir() for x in own.iterdir() if x.is_dir()]


def test_leads_are_all_that_stays_of_their_making(spark, frame, tmp_path, monkeypatch):
    monkeypatch.setattr(settle, "shared_folder", lambda _: f"file://{tmp_path}")
    with settle.scope(spark):
        out = leads.generate_leads(frame, NOW, params={"channel_relative": {"min_multiple": 3}})
        assert len(_tables(tmp_path)) == 1 and out.count() > 5


def test_topic_input_takes_whole_rows_of_the_chosen(spark):
    held = {"a": [("x", 3.0, "ax"), ("y", 1.0, "ay"), ("z", 0.5, "az")], "b": [("y", 2.0, "by"), ("w", 0.1, "bw")]}
    results = {n: spark.createDataFrame(rows, "video_id string, score double, title string") for n, rows in held.items()}
    got = {most: sorted(tuple(r) for r in leads.topic_input(results, most).select("video_id", "score", "title").collect()) for most in (2, 3, None)}
    assert got == {2: [("x", 3.0, "ax"), ("y", 2.0, "by")], 3: [("x", 3.0, "ax"), ("y", 2.0, "by"), ("z", 0.5, "az")], None: [("w", 0.1, "bw"), ("x", 3.0, "ax"), ("y", 2.0, "by"), ("z", 0.5, "az")]}


def test_blended_leads_keep_a_table_for_each_scorer(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(settle, "shared_folder", lambda _: f"file://{tmp_path}")
    with settle.scope(spark):
        out = collection.blended_leads(spark, "/root/testdata/sf0.001")
        assert len(_tables(tmp_path)) <= 7 and out.count() > 0  # items, five results, the blend


def test_a_failing_scorer_is_no_lead_list(spark, frame, monkeypatch):
    good = leads.SCORERS["breakout_outliers"]
    monkeypatch.setattr(leads, "SCORERS", {"breakout_outliers": good, "bad": lambda df: df.select("nope")})
    with settle.scope(spark), pytest.raises(RuntimeError, match="scorer bad failed"):
        leads.generate_leads(frame, NOW)
    monkeypatch.setattr(leads, "SCORERS", {"breakout_outliers": good})
    with settle.scope(spark), pytest.raises(RuntimeError, match="scorer topics failed"):
        leads.generate_leads(frame, NOW, params={"topics": {"no_such_option": 1}})


def test_themes_are_all_terms_unless_the_caller_limits_them(spark):
    title = F.translate(F.concat(F.lit("w"), F.floor(F.col("id") / 2).cast("string")), "0123456789", "abcdefghij")  # words with digits are no terms
    rows = settle.settled(spark.range(10_400).select(F.col("id").cast("string").alias("video_id"), (F.col("id") % 7).cast("string").alias("channel_id"), title.alias("title"), F.lit(1.0).alias("views"), F.lit(2.0).alias("subscribers")))
    wide = {"most_words": 1, "min_lead_count": 2, "dedupe_titles": False, "stopwords": ()}
    assert themes.extract_themes(rows, None, themes.ThemeParams(**wide)).count() == 5_200
    assert themes.extract_themes(rows, None, themes.ThemeParams(**wide, max_terms=50)).count() == 50
    named = spark.createDataFrame([(str(k), str(k % 3), t, 1.0, 2.0) for k, t in enumerate(["Ünder ring", "ring ünder", "ünder gear", "ünder rod"])], "video_id string, channel_id string, title string, views double, subscribers double")
    assert {r["term"]: r["lead_count"] for r in themes.extract_themes(named, None, themes.ThemeParams(stopwords=(), min_lead_count=1, min_distinct_channels=1, most_words=1)).collect()} == {"ünder": 3, "ring": 1, "gear": 1, "rod": 1}
