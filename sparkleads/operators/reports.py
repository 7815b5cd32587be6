"""Rollups and reports over items, labels, logs and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import local_day, number, safe_ratio
from .ranking import cumulative, histogram, medians
from .settle import settled
from .taxonomy import Taxonomy, classify

# Subscriber bands of the entrant report.
BANDS = [(1_000, "<1k"), (10_000, "1k-10k"), (100_000, "10k-100k"), (1_000_000, "100k-1M"), (None, "1M+")]


def nearest_rank(df: DataFrame, keys: list[str], value: str, q: float, out: str) -> DataFrame:
    """(keys, out): the value at index round(q * (n - 1)), halves to even, of the sorted values."""
    ranked = cumulative(histogram(df, keys, value), keys)
    at = F.bround(F.lit(q) * (F.col("n") - 1), 0)
    return ranked.groupBy(*keys, "n").agg(F.min(F.when(F.col("before") + F.col("c") > at, F.col("v"))).alias(out)).drop("n")


def slice_summary(df: DataFrame, key: str) -> DataFrame:
    """Items, parents, median and nearest-rank 90th percentile of views, median views per subscriber and subscribers by `key`."""
    rows = settled(df.withColumn("_vps", safe_ratio(F.col("views"), F.col("subscribers"))))
    main = rows.groupBy(key).agg(F.count("*").alias("videos"), F.countDistinct("channel_id").alias("channels"))
    middle = medians(rows, [key], {"views": "median_views", "_vps": "median_views_per_sub", "subscribers": "median_subscribers"})
    named = middle.join(nearest_rank(rows, [key], "views", 0.9, "p90_views"), [key], "left").withColumnRenamed(key, "_key")
    joined = main.join(named, F.col(key).eqNullSafe(F.col("_key")), "left")
    return joined.select(key, "videos", "channels", "median_views", "median_views_per_sub", "median_subscribers", "p90_views").orderBy(F.desc("videos"), key)


def _band(c: Column) -> Column:
    out = F.when(c.isNull(), F.lit("unknown"))
    for bound, name in BANDS:
        out = out.when(c < bound, name) if bound else out.otherwise(name)
    return out


def entrant_bands(df: DataFrame) -> DataFrame:
    """(band, videos, median_views_per_sub, above_median): chances of small parents, against the median of all rows."""
    rows = settled(df.select(safe_ratio(F.col("views"), F.col("subscribers")).alias("_vps"), _band(F.col("subscribers")).alias("band")))
    whole = medians(rows, [], {"_vps": "_m"})
    counted = rows.join(F.broadcast(whole), how="left").groupBy("band").agg(F.count("*").alias("videos"), F.avg((F.col("_vps") > F.col("_m")).cast("double")).alias("above_median"))
    return counted.join(medians(rows, ["band"], {"_vps": "median_views_per_sub"}), "band", "left").select("band", "videos", "median_views_per_sub", "above_median").orderBy("band")


def consistency(df: DataFrame, least: int = 3, min_subscribers: float = 1_000, top: int = 15) -> DataFrame:
    """Parents with at least `least` items by median views per subscriber, the best `top`."""
    rows = df.filter(F.col("subscribers") >= min_subscribers).withColumn("_vps", safe_ratio(F.col("views"), F.col("subscribers")))
    rows = settled(rows.select("channel_id", "channel_name", "subscribers", "_vps"))
    by = rows.groupBy("channel_id").agg(F.max("channel_name").alias("channel_name"), F.max("subscribers").alias("subscribers"), F.count("*").alias("videos"))
    middle = medians(rows, ["channel_id"], {"_vps": "median_views_per_sub"}).withColumnRenamed("channel_id", "_key")
    by = by.filter(F.col("videos") >= least).join(middle, F.col("channel_id").eqNullSafe(F.col("_key")), "left").drop("_key")
    return by.orderBy(F.desc_nulls_last("median_views_per_sub"), "channel_id").limit(top)


def topic_report(items: DataFrame, taxonomy: Taxonomy) -> dict[str, DataFrame]:
    """Labels, share of labelled items, and the three reports over them."""
    labels = classify(items, taxonomy)
    share = items.agg(F.count("*").alias("items")).crossJoin(F.broadcast(labels.agg(F.countDistinct("video_id").alias("labelled")))).withColumn("share", safe_ratio(F.col("labelled"), F.col("items"), 0.0))
    return {"labels": labels, "share": share, "topics": slice_summary(labels, "topic"), "bands": entrant_bands(labels), "consistency": consistency(labels)}


def corpus_profile(snapshots: DataFrame, latest_items: DataFrame) -> DataFrame:
    """One row: snapshots, items, items seen twice, parents, publish range and null rates."""
    twice = snapshots.groupBy("video_id").agg(F.count("*").alias("n")).agg(F.sum("n").alias("snapshots"), F.count_if(F.col("n") >= 2).alias("items_seen_twice"))
    rates = [F.avg(F.col(c).isNull().cast("double")).alias(f"null_{c}") for c in ("views", "likes", "comments", "subscribers") if c in latest_items.columns]
    one = latest_items.agg(F.count("*").alias("items"), F.countDistinct("channel_id").alias("parents"), F.min("published_at").alias("first_published"), F.max("published_at").alias("last_published"), *rates)
    return twice.crossJoin(F.broadcast(one))


def class_table(df: DataFrame) -> DataFrame:
    return df.groupBy("sub_class", "video_count_class").agg(F.count("*").alias("videos")).orderBy("sub_class", "video_count_class")


def duration_buckets(df: DataFrame) -> DataFrame:
    s = number(F.col("duration_seconds"))
    label = F.when(s.isNull(), "unknown").when(s <= 60, "<=60s").when(s <= 180, "61-180s").when(s <= 600, "3-10m").when(s <= 1800, "10-30m").otherwise(">30m")
    return df.groupBy(label.alias("bucket")).agg(F.count("*").alias("videos")).orderBy("bucket")


def hit_histogram(leads: DataFrame, column: str) -> DataFrame:
    return leads.groupBy(column).agg(F.count("*").alias("leads")).orderBy(column)


def usage_by_day(usage: DataFrame, time: str = "used_at", units: str = "units") -> DataFrame:
    return usage.groupBy(local_day(F.col(time)).alias("day")).agg(F.sum(units).alias("units"), F.count("*").alias("calls")).orderBy("day")


def recent_attempts(attempts: DataFrame) -> DataFrame:
    """(source, outcome, attempts, last_at) of the attempt log."""
    return attempts.groupBy("source", "outcome").agg(F.count("*").alias("attempts"), F.max("attempted_at").alias("last_at")).orderBy("source", "outcome")


def queue_by_state(queue: DataFrame, keys: tuple[str, ...] = ("assigned_source", "digested", "needs_review")) -> DataFrame:
    """(keys, profiles): the work queue by source and flags; null is a value of its own."""
    return queue.groupBy(*keys).agg(F.count("*").alias("profiles")).orderBy(*keys)


def collection_progress(queue: DataFrame, succeeded_at: str = "api_success_at", failed: str = "api_failed") -> DataFrame:
    """One row: parents with a success, failed ones without, and those never tried. An empty queue has zeros."""
    done, bad = F.col(succeeded_at).isNotNull(), F.coalesce(F.col(failed).cast("int"), F.lit(0))
    return queue.agg(F.count_if(done).alias("succeeded"), F.count_if(~done & (bad == 1)).alias("failed"), F.count_if(~done & (bad == 0)).alias("never_tried"))


def newest_rows(df: DataFrame, columns: list[str], n: int = 100, order: str = "id", where: Column | None = None) -> DataFrame:
    """The newest `n` rows of a log by `order`: errors, attempts, snapshots, or those that `where` picks."""
    rows = df if where is None else df.filter(where)
    return rows.orderBy(F.desc_nulls_last(order)).limit(n).select(*columns)


def fingerprint(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(table, rows, max_id) of each named (frame, id column)."""
    out = None
    for name, (df, key) in sorted(tables.items()):
        one = df.agg(F.count("*").alias("rows"), F.max(key).cast("string").alias("max_id")).select(F.lit(name).alias("table"), "rows", "max_id")
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no tables")
    return out


def catalog_overview(spark: SparkSession, preview: int = 5) -> dict[str, dict]:
    """Of each table of the session: schema, number of rows and its newest rows by the first time or id column."""
    found = {}
    for t in spark.catalog.listTables():
        df = spark.table(t.name)
        order = next((c for c in ("collected_at", "observed_at", "id") if c in df.columns), df.columns[0])
        found[t.name] = {"schema": df.schema, "rows": df.count(), "newest": df.orderBy(F.desc(order)).limit(preview)}
    return found


def plot_sample(df: DataFrame, most: int = 50_000, per_class: int = 20_000, seed: int = 7) -> DataFrame:
    """Rows for a plot, at most `per_class` of each sub_class and `most` in all, drawn by a hash, with log10 of views and subscribers."""
    k = F.row_number().over(Window.partitionBy("sub_class").orderBy(F.xxhash64("video_id", F.lit(seed)), "video_id"))
    drawn = df.withColumn("_k", k).filter(F.col("_k") <= per_class).drop("_k").orderBy(F.xxhash64("video_id", F.lit(seed)), "video_id").limit(most)
    return drawn.withColumns({f"log10_{c}": F.when(F.col(c) > 0, F.log10(c)) for c in ("views", "subscribers")})
