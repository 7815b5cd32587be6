"""Each stream against its batch form, over files that come one at a time."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sparkleads.operators import discovery, scoring, taxonomy
from sparkleads.sources import buckets
from sparkleads.streaming import streams


@pytest.fixture
def files(spark, tmp_path):
    """Writes rows as three files, every third in each, and gives the stream over them and the rows as a frame."""
    def make(rows, schema):
        for k in range(3):
            spark.createDataFrame(rows[k::3], schema).coalesce(1).write.json(f"{tmp_path}/in/{k}")
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(f"{tmp_path}/in")
        return source, spark.createDataFrame(rows, schema)

    return make


def run(writer, tmp_path):
    query = writer.option("checkpointLocation", f"{tmp_path}/progress").trigger(availableNow=True).start()
    assert query.awaitTermination(180) and query.exception() is None


def test_velocity_takes_late_snapshots_in_order(spark, files, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng = random.Random(4)
    rows = {(str(rng.randrange(5)), rng.randrange(2000)): float(rng.randrange(1000)) for _ in range(60)}
    rows = [(i, (dt.datetime(2026, 1, 1) + dt.timedelta(hours=h)).isoformat(), v, k) for k, ((i, h), v) in enumerate(rows.items())]
    source, frame = files([*rows, ("9", "bad", 1.0, 99), (None, rows[0][1], 1.0, 98)], "video_id string, collected_at string, views double, id long")
    newest = {}

    def take(batch, _):
        newest.update({r["video_id"]: tuple(r) for r in batch.collect()})

    run(streams.velocity_stream(source, delay="400 days").writeStream.outputMode("update").foreachBatch(take), tmp_path)
    assert newest == {r["video_id"]: tuple(r) for r in scoring.observed_velocity(frame).collect()}


def test_state_is_that_of_all_batches_merged(spark, files, tmp_path):
    rng = random.Random(5)
    rows = [(rng.choice([" Ann", "bob", "UC" + "x" * 22, None]), f"2026-01-{1 + k % 28:02} 00:00:00", f"2026-02-{1 + k % 28:02} 00:00:00", f"n{k}") for k in range(30)]
    source, frame = files(rows, "channel_id string, published_at timestamp_ntz, observed_at timestamp_ntz, channel_name string".replace("timestamp_ntz", "string"))
    typed = lambda df: df.withColumns({c: F.col(c).cast("timestamp") for c in ("published_at", "observed_at")})
    run(typed(source).writeStream.foreachBatch(streams.state_batches(f"{tmp_path}/state", lambda: "2026-03-01 00:00:00")), tmp_path)
    got = streams.state_table(spark, f"{tmp_path}/state").read().select("channel_key", "canonical_id", "last_published_at", "last_seen_at", "eligible")
    want = discovery.feed_state(typed(frame)).select("channel_key", "canonical_id", "last_published_at", "last_seen_at", F.lit(True).alias("eligible"))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_deduplicated_labels_and_yields(spark, files, tmp_path):
    rows = [(f"v{k % 7}", f"2026-01-01 0{k % 3}:00:00", "Rye bread oven" if k % 2 else "none", "26") for k in range(42)]
    source, frame = files(rows, "video_id string, collected_at string, title string, category_id string")
    timed = source.withColumn("collected_at", F.col("collected_at").cast("timestamp"))
    made = streams.labelled(streams.deduplicated(timed, ["video_id", "title", "collected_at"]), taxonomy.KITCHEN)
    run(made.writeStream.format("parquet").option("path", f"{tmp_path}/labels"), tmp_path)
    got = sorted((r["video_id"], r["topic"]) for r in spark.read.parquet(f"{tmp_path}/labels").collect())
    want = sorted((r["video_id"], r["topic"]) for r in taxonomy.classify(frame.dropDuplicates(["video_id", "title"]), taxonomy.KITCHEN).collect())
    assert got == want and want


def test_recent_feed_keeps_each_row_once(spark, files, tmp_path):
    rows = [(f"d{k % 5}", f"2026-01-0{1 + k % 4} 00:00:00") for k in range(30)]
    source, frame = files(rows, "digest string, observed_at string")
    run(streams.recent_feed(source.withColumn("observed_at", F.col("observed_at").cast("timestamp"))).writeStream.format("parquet").option("path", f"{tmp_path}/feed"), tmp_path)
    assert spark.read.parquet(f"{tmp_path}/feed").count() == frame.select("digest").distinct().count()


def test_yields_are_those_of_all_evidence(spark, files, tmp_path):
    rows = [("x" if k % 3 else None, f"s{k % 4}", k % 2, "t1" if k % 5 else "t0") for k in range(40)]
    source, frame = files(rows, "matched_topic string, seed_video_id string, depth int, classifier_version string")
    run(source.writeStream.foreachBatch(streams.yield_batches(f"{tmp_path}/evidence", f"{tmp_path}/yields", "t1", buckets=4)), tmp_path)
    assert sorted(map(tuple, streams.yields(spark, f"{tmp_path}/yields").collect())) == sorted(map(tuple, discovery.crawl_yield(frame, "t1").collect()))


def test_a_batch_that_breaks_off_or_repeats_adds_once(spark, tmp_path, monkeypatch):
    frame = lambda *rows: spark.createDataFrame(rows, "matched_topic string, seed_video_id string, depth int, classifier_version string")
    add = streams.yield_batches(f"{tmp_path}/evidence", f"{tmp_path}/yields", "t1", buckets=4)
    first, second = frame(("x", "a", 1, "t1"), (None, "b", 1, "t1"), ("x", None, None, "t1")), frame(("x", "a", 1, "t1"), ("x", "c", 1, "t1"), ("x", "c", 2, "t0"))
    add(first, 0)
    add(first, 0)
    commit = buckets.BucketTable._commit

    def broken(table, version, content):
        if table.path.endswith("totals"):
            raise RuntimeError("broken off")
        commit(table, version, content)

    monkeypatch.setattr(buckets.BucketTable, "_commit", broken)
    with pytest.raises(RuntimeError):
        add(second, 1)
    assert {r["depth"]: (r["total"], r["seeds"]) for r in streams.yields(spark, f"{tmp_path}/yields").collect()} == {1: (2, 2), None: (1, 0)}
    monkeypatch.setattr(buckets.BucketTable, "_commit", commit)
    add(second, 1)
    assert {r["depth"]: (r["total"], r["seeds"]) for r in streams.yields(spark, f"{tmp_path}/yields").collect()} == {1: (4, 3), None: (1, 0)}


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    state = streams.state_table(spark, f"{tmp_path}/state", buckets=8)
    feed = lambda keys: spark.createDataFrame([(k, dt.datetime(2026, 1, 1), dt.datetime(2026, 2, 1), k) for k in keys], "channel_id string, published_at timestamp, observed_at timestamp, channel_name string")
    merge = streams.state_batches(f"{tmp_path}/state", lambda: "2026-03-01 00:00:00", buckets=8)
    merge(feed([f"c{k}" for k in range(100)]), 0)
    before = state.manifest()["parts"]
    merge(feed(["c1", "new"]), 1)
    after, touched = state.manifest()["parts"], set(state.touched(spark.createDataFrame([("c1",), ("new",)], "channel_key string")))
    assert len(touched) <= 2 and all((before.get(p) != after[p]) == (p in touched) for p in after) and state.read().count() == 101
    merge(feed(["c1", "other"]), 1)
    assert state.read().count() == 101
    assert state.vacuum() == 0 or state.read().count() == 101


def test_upserts_and_backfills_write_what_they_touch(spark, tmp_path):
    verdicts = lambda *rows: spark.createDataFrame(rows, "video_id string, is_live boolean, checked_at string")
    table = buckets.BucketTable(spark, f"{tmp_path}/verdicts", ["video_id"], 4)
    buckets.upsert(table, verdicts(*[(f"v{k}", True, "2026-01-02") for k in range(40)], (None, False, "2026-01-02")), "is_live")
    buckets.upsert(table, verdicts(("v1", False, "2026-01-03"), ("v2", False, "2026-01-01"), ("v3", False, "2026-01-02"), ("w", True, "2026-01-01")), "is_live")
    got = {r["video_id"]: r["is_live"] for r in table.read().collect()}
    assert len(got) == 42 and (got["v1"], got["v2"], got["v3"], got["w"], got[None]) == (False, True, False, True, False)
    with pytest.raises(ValueError):
        buckets.upsert(table, verdicts(("v9", None, "2026-02-01")), "is_live")
    version = table.manifest()["version"]
    table.spark._jvm.org.apache.commons.io.FileUtils.writeStringToFile(spark._jvm.java.io.File(f"{tmp_path}/verdicts/manifest/{version + 1:012}.json"), '{"version": 3, "pa', "UTF-8")
    assert table.manifest()["version"] == version and table.read().count() == 42
    buckets.upsert(table, verdicts(("last", True, "2026-01-01")), "is_live")
    assert table.read().count() == 43

    snaps = buckets.BucketTable(spark, f"{tmp_path}/snaps", ["video_id"], 2, day="at")
    rows = spark.createDataFrame([(f"v{k % 5}", dt.datetime(2026, 1, 1 + k % 3), "en" if k % 2 else None) for k in range(30)], "video_id string, at timestamp, default_language string")
    snaps.merge(rows, lambda old, new: old.unionByName(new))
    before = snaps.manifest()["parts"]
    assert len(before) == 6
    parts = buckets.backfill(snaps, spark.createDataFrame([("v1", "fr"), ("gone", "de")], "video_id string, default_language string"), ["default_language"])
    after = snaps.manifest()["parts"]
    assert {p for p in after if after[p] != before[p]} == set(parts) and 0 < len(parts) <= 3
    want = [(v, str(a), tag or ("fr" if v == "v1" else None)) for v, a, tag in map(tuple, rows.collect())]
    assert sorted(((v, str(a), tag) for v, a, tag in map(tuple, snaps.read().collect())), key=repr) == sorted(want, key=repr)
    assert buckets.backfill(snaps, spark.createDataFrame([("v1", "xx")], "video_id string, default_language string"), ["default_language"]) == []
