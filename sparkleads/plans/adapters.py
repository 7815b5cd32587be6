"""The given star tables in the roles of items, parents, snapshots, evidence and logs; each with the same SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import in_tasks
from ..operators.settle import BROADCAST_ROWS, small

NOW = "2001-09-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as items of customers: price as views, four times the quantity as likes, part names as title."""
    lines, parts, orders, customers = (table(spark, sf_dir, name) for name in ("lineitem", "part", "orders", "customer"))
    rows = orders.count()  # an order has a few lines
    names = small(parts.select("p_partkey", "p_name"))
    few_parts = parts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS  # then lines stay where they are
    dealt = lines if few_parts else in_tasks(lines, rows, "l_partkey")
    named = dealt.join(names if few_parts else names.hint("shuffle_hash"), lines["l_partkey"] == parts["p_partkey"], "left")
    listed = F.sort_array(F.collect_list(F.struct("l_linenumber", "p_name", "l_partkey")))
    per_order = in_tasks(named, rows, "l_orderkey").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"), F.count("*").alias("n"), F.array_join(listed["p_name"], " ").alias("title"))
    counts = orders.groupBy("o_custkey").agg(F.count("*").alias("video_count"))
    owned = in_tasks(orders, rows, "o_custkey").join(customers.hint("shuffle_hash"), orders["o_custkey"] == customers["c_custkey"], "left").join(counts.hint("shuffle_hash"), "o_custkey", "left")
    out = in_tasks(owned, rows, "o_orderkey").join(per_order.hint("shuffle_hash"), F.col("o_orderkey") == per_order["l_orderkey"], "left")
    return out.select(
        F.col("o_orderkey").cast("string").alias("video_id"), F.col("o_custkey").cast("string").alias("channel_id"), "title", F.col("o_orderdate").cast("timestamp").alias("published_at"), F.col("o_orderpriority").alias("category_id"),
        F.col("o_totalprice").alias("views"), (4 * F.col("q")).alias("likes"), (F.col("n") * (1 + F.col("o_orderkey") % 97)).cast("double").alias("comments"), (F.col("n") * 45).cast("double").alias("duration_seconds"),
        F.col("c_name").alias("channel_name"), F.floor(F.abs("c_acctbal") * 10).cast("double").alias("subscribers"), F.col("video_count").cast("double").alias("video_count"),
        F.expr("timestamp '1990-01-01 00:00:00' + make_dt_interval(cast(o_custkey % 1000 as int))").cast("timestamp").alias("channel_published_at"),
    )


ITEMS = """
li AS (SELECT l_orderkey, sum(l_quantity) AS q, count(*) AS n, string_agg(p_name, ' ' ORDER BY l_linenumber, p_name, l_partkey) AS title
       FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey),
cnt AS (SELECT o_custkey AS k, count(*) AS video_count FROM orders GROUP BY o_custkey),
items AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS video_id, CAST(o_custkey AS VARCHAR) AS channel_id, title, o_orderdate AS published_at, o_orderpriority AS category_id,
         o_totalprice AS views, 4 * q AS likes, CAST(n * (1 + o_orderkey % 97) AS DOUBLE) AS comments, CAST(n * 45 AS DOUBLE) AS duration_seconds,
         c_name AS channel_name, CAST(floor(abs(c_acctbal) * 10) AS DOUBLE) AS subscribers, CAST(video_count AS DOUBLE) AS video_count,
         TIMESTAMP '1990-01-01' + to_days(CAST(o_custkey % 1000 AS INTEGER)) AS channel_published_at
  FROM orders LEFT JOIN li ON l_orderkey = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN cnt ON k = o_custkey)
"""

_RATIO = "CASE WHEN {d} <> 0 THEN {n} / {d} END"


def ratio(n: str, d: str) -> str:
    return _RATIO.format(n=n, d=d)


def binned(c: str, bins: list) -> str:
    return f"CASE WHEN {c} IS NULL THEN 'unknown' " + " ".join(f"WHEN {c} < {b} THEN '{name}'" if b is not None else f"ELSE '{name}'" for b, name in bins) + " END"


def _enriched() -> str:
    from ..functions.scalars import COUNT_CLASSES, SUB_CLASSES

    return f"""{ITEMS},
aged AS (SELECT *, greatest(epoch_us(TIMESTAMP '{NOW}') - epoch_us(published_at), 43200000000) / 86400e6 AS video_age_days,
                greatest(epoch_us(TIMESTAMP '{NOW}') - epoch_us(channel_published_at), 43200000000) / 86400e6 AS channel_age_days FROM items),
enriched AS (
  SELECT *, {ratio('views', 'video_age_days')} AS views_per_day, {ratio('views', 'subscribers')} AS views_per_sub, {ratio('likes', 'views')} AS like_rate,
         {ratio('comments', 'views')} AS comment_rate, {ratio('(likes + comments)', 'views')} AS engagement_rate,
         video_count / (channel_age_days / 30.44) AS uploads_per_month,
         {binned('subscribers', SUB_CLASSES)} AS sub_class, {binned('video_count', COUNT_CLASSES)} AS video_count_class FROM aged)
"""


ENRICHED = _enriched()


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as snapshots of users."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("video_id"), F.col("ts").cast("timestamp").alias("collected_at"), F.col("value").alias("views"), "event_type")


SNAPSHOTS = "snaps AS (SELECT event_id AS id, CAST(user_id AS VARCHAR) AS video_id, ts AS collected_at, value AS views, event_type FROM events)"


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as crawl evidence: suppliers are parents, orders seeds, parts items; return flags other than N are topics."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(
        F.col("l_shipdate").cast("timestamp").alias("observed_at"), F.col("l_orderkey").cast("string").alias("seed_video_id"), F.col("l_partkey").cast("string").alias("video_id"), F.col("l_suppkey").cast("string").alias("channel_id"),
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("channel_key"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("matched_topic"), F.col("l_quantity").cast("int").alias("confidence"),
        F.col("l_linenumber").cast("int").alias("depth"), F.lit("terms-1").alias("classifier_version"),
    )


EVIDENCE = """evidence AS (SELECT l_shipdate AS observed_at, CAST(l_orderkey AS VARCHAR) AS seed_video_id, CAST(l_partkey AS VARCHAR) AS video_id, CAST(l_suppkey AS VARCHAR) AS channel_id,
  's' || CAST(l_suppkey AS VARCHAR) AS channel_key, CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS matched_topic, CAST(l_quantity AS INTEGER) AS confidence, CAST(l_linenumber AS INTEGER) AS depth FROM lineitem)"""
