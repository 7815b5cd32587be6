"""Structured Streaming forms of ingest, state, velocity, usage, labels and yields."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.scalars import content_digest, instant, local_day, number, safe_ratio
from ..operators.discovery import feed_state, refresh_state
from ..operators.taxonomy import Taxonomy, classify
from ..sources.buckets import BUCKETS, BucketTable
from ..sources.writers import append_daily


def deduplicated(stream: DataFrame, columns: Sequence[str], time: str = "collected_at", delay: str = "2 days") -> DataFrame:
    """One row per content and day; repeats within the watermark's delay go."""
    kept = [c for c in columns if c != time]
    keyed = stream.withColumn("_day", F.to_date(F.col(time))).withColumn("digest", content_digest([*kept, "_day"])).drop("_day")
    return keyed.withWatermark(time, delay).dropDuplicatesWithinWatermark(["digest"])


def append_batches(path: str, columns: Sequence[str], time: str = "collected_at") -> Callable[[DataFrame, int], None]:
    """For foreachBatch: appends contents that the table doesn't have for that day, however late they repeat."""
    return lambda batch, _: append_daily(batch, path, columns, time)


def recent_feed(stream: DataFrame, time: str = "observed_at", days: int = 14) -> DataFrame:
    """Feed rows once each; rows later than the retention are dropped by the watermark."""
    return stream.withWatermark(time, f"{days} days").dropDuplicatesWithinWatermark(["digest"])


STATE = "channel_key string, canonical_id string, last_published_at timestamp, last_seen_at timestamp, last_success_at timestamp, under_review boolean, eligible boolean"


def state_table(spark: SparkSession, path: str, buckets: int = BUCKETS) -> BucketTable:
    """The parent state that `state_batches` keeps."""
    return BucketTable(spark, path, ["channel_key"], buckets)


def state_batches(path: str, now: Callable[[], str], buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: merges each feed batch into the parent state. Only the buckets of parents that the batch names are read and written; a repeated batch does nothing."""

    def merge(batch: DataFrame, number_: int) -> None:
        def renewed(old: DataFrame, fresh: DataFrame) -> DataFrame:
            state = old if "eligible" in old.columns else batch.sparkSession.createDataFrame([], STATE)
            return refresh_state(fresh, state, now())

        state_table(batch.sparkSession, path, buckets).merge(feed_state(batch), renewed, number_)

    return merge


VELOCITY = "video_id string, observed_views_per_day double, snapshot_count long, observation_span_days double, negative_delta_clipped boolean"


class VelocityProcessor(StatefulProcessor):
    """Running form of `observed_velocity`. Snapshots newer than the watermark wait in order of time, so that late ones take their place among
    them; older ones are folded into the last snapshot, the rate of the latest long enough interval, count, first time and whether views
    ever fell. An item without news for `idle_days` of event time is forgotten."""

    def __init__(self, min_interval_days: float = 0.5, idle_days: float = 365) -> None:
        self.least, self.idle_ms = min_interval_days, int(idle_days * 86_400_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.folded = handle.getValueState("folded", "first_us long, last_us long, last_views double, rate double, n long, fell boolean")
        self.waiting = handle.getListState("waiting", "us long, views double")

    def _step(self, state: tuple, us: int, value: float) -> tuple:
        first, last, views, rate, n, fell = state
        if last is not None:
            days = (us - last) / 86_400e6
            fell = fell or value < views
            if days >= self.least:
                rate = max(value - views, 0.0) / days
        return (us if first is None else first, us, value, rate, n + 1, fell)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        found = pd.concat(list(rows))
        waiting = sorted([*((int(x[0]), float(x[1])) for x in self.waiting.get()), *zip(found["us"].astype(int), found["views"].astype(float), strict=True)])
        state = tuple(self.folded.get()) if self.folded.exists() else (None, None, None, None, 0, False)
        behind = timerValues.getCurrentWatermarkInMs() * 1000
        while waiting and waiting[0][0] <= behind:
            state = self._step(state, *waiting.pop(0))
        if state[4]:
            self.folded.update(state)
        self.waiting.put([(int(us), float(views)) for us, views in waiting])
        for us, views in waiting:
            state = self._step(state, us, views)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(state[1] // 1000 + self.idle_ms)
        yield pd.DataFrame({"video_id": [key[0]], "observed_views_per_day": [state[3]], "snapshot_count": [state[4]], "observation_span_days": [(state[1] - state[0]) / 86_400e6], "negative_delta_clipped": [state[5]]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.folded.clear()
        self.waiting.clear()
        return iter([])

    def close(self) -> None:
        pass


def velocity_stream(snapshots: DataFrame, min_interval_days: float = 0.5, delay: str = "7 days", idle_days: float = 365) -> DataFrame:
    """Newest velocity of every item that a batch touches; snapshots up to `delay` late count as in time. Needs the RocksDB state store."""
    clean = snapshots.select(F.col("video_id").cast("string").alias("video_id"), instant(F.col("collected_at")).alias("at"), number(F.col("views")).alias("views")).dropna()
    timed = clean.withWatermark("at", delay).withColumn("us", F.unix_micros("at"))
    return timed.groupBy("video_id").transformWithStateInPandas(VelocityProcessor(min_interval_days, idle_days), VELOCITY, "Update", "EventTime")


def daily_usage(stream: DataFrame, time: str = "used_at", units: str = "units") -> DataFrame:
    return stream.groupBy(local_day(F.col(time)).alias("day")).agg(F.sum(units).alias("units"), F.count("*").alias("calls"))


def labelled(stream: DataFrame, taxonomy: Taxonomy) -> DataFrame:
    return classify(stream, taxonomy)


def yield_tables(spark: SparkSession, path: str, buckets: int = BUCKETS) -> tuple[BucketTable, BucketTable]:
    """The pairs of depth and seed seen so far, and the totals by depth, of `yield_batches`."""
    return BucketTable(spark, f"{path}/pairs", ["depth", "seed_video_id"], buckets), BucketTable(spark, f"{path}/totals", ["depth"], 1)


def yields(spark: SparkSession, path: str) -> DataFrame:
    """As `crawl_yield`, from the totals."""
    totals = yield_tables(spark, path)[1].read().select("depth", "total", "on_topic", "seeds")
    return totals.withColumn("yield_rate", safe_ratio(F.col("on_topic"), F.col("total"), 0.0)).orderBy("depth")


def yield_batches(evidence_path: str, out_path: str, version: str, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: appends the evidence and adds it to the yields. Seeds are counted exactly: a pair of depth and seed counts in the batch that first had it. A batch
    reads its own rows and the buckets of its pairs; each table knows its last batch, so a batch that is repeated after a break adds only what is missing."""

    def add(batch: DataFrame, number_: int) -> None:
        spark = batch.sparkSession
        batch.withColumn("_batch", F.lit(number_)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_batch").parquet(evidence_path)
        rows = spark.read.schema(batch.schema).parquet(f"{evidence_path}/_batch={number_}").filter(F.col("classifier_version") == version)
        pairs, totals = yield_tables(spark, out_path, buckets)
        seen = rows.filter(F.col("seed_video_id").isNotNull()).select("depth", "seed_video_id").distinct().withColumn("first_batch", F.lit(number_).cast("long"))
        pairs.merge(seen, lambda old, new: old.unionByName(new).groupBy("depth", "seed_video_id").agg(F.min("first_batch").alias("first_batch")), number_)
        news = pairs.read(pairs.touched(seen), seen.schema).filter(F.col("first_batch") == number_).groupBy("depth").agg(F.count("*").alias("seeds"))
        counted = rows.groupBy("depth").agg(F.count("*").alias("total"), F.count_if(F.col("matched_topic").isNotNull()).alias("on_topic"), F.lit(0).cast("long").alias("seeds"))
        parts = counted.unionByName(news.select("depth", *[F.lit(0).cast("long").alias(c) for c in ("total", "on_topic")], "seeds"))
        sums = [F.sum(c).alias(c) for c in ("total", "on_topic", "seeds")]
        totals.merge(parts.groupBy("depth").agg(*sums), lambda old, new: old.unionByName(new).groupBy("depth").agg(*sums), number_)

    return add
