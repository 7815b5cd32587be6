"""Rates, peer classes and baselines of items: what every scorer reads."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import COUNT_CLASSES, MONTH_DAYS, SUB_CLASSES, binned, days_between, number, safe_ratio
from .ranking import baselines

SHORT_SECONDS, POSSIBLE_SHORT_SECONDS, BASELINE_ITEMS = 60, 180, 5


def at(now: datetime | str) -> Column:
    return F.lit(str(now)).cast("timestamp")


def add_item_metrics(df: DataFrame, now: datetime | str) -> DataFrame:
    """Age in days (half a day at least), views per day and per subscriber, and like, comment and engagement rates."""
    age = F.when(F.col("published_at").isNotNull(), F.greatest(days_between(at(now), F.col("published_at")), F.lit(0.5)))
    out = df.withColumn("video_age_days", age)
    return out.withColumns({
        "views_per_day": safe_ratio(F.col("views"), F.col("video_age_days")), "views_per_sub": safe_ratio(F.col("views"), F.col("subscribers")),
        "like_rate": safe_ratio(F.col("likes"), F.col("views")), "comment_rate": safe_ratio(F.col("comments"), F.col("views")),
        "engagement_rate": safe_ratio(F.col("likes") + F.col("comments"), F.col("views")),
    })


def add_parent_metrics(df: DataFrame, now: datetime | str) -> DataFrame:
    age = F.greatest(days_between(at(now), F.col("channel_published_at")), F.lit(0.5))
    out = df.withColumn("channel_age_days", F.when(F.col("channel_published_at").isNotNull(), age))
    return out.withColumn("uploads_per_month", safe_ratio(F.col("video_count"), F.col("channel_age_days") / MONTH_DAYS))


def add_classes(df: DataFrame) -> DataFrame:
    return df.withColumns({"sub_class": binned(F.col("subscribers"), SUB_CLASSES), "video_count_class": binned(F.col("video_count"), COUNT_CLASSES)})


def add_parent_baselines(df: DataFrame, least: int = BASELINE_ITEMS) -> DataFrame:
    """Median and 90th percentile of the views of the parent's items, and the item's multiple of the median."""
    out = baselines(df, "channel_id", "views", least)
    out = out.withColumnsRenamed({"views_median": "channel_median_views", "views_p90": "channel_p90_views", "views_count": "channel_video_sample"})
    return out.withColumn("channel_relative_multiple", safe_ratio(F.col("views"), F.col("channel_median_views")))


def enrich(df: DataFrame, now: datetime | str, least: int = BASELINE_ITEMS) -> DataFrame:
    return add_classes(add_parent_baselines(add_parent_metrics(add_item_metrics(df, now), now), least))


def add_short_flag(df: DataFrame, most: int = SHORT_SECONDS) -> DataFrame:
    return df.withColumn("is_short", number(F.col("duration_seconds")) <= most)


def exclude_shorts(df: DataFrame, most: int = SHORT_SECONDS, drop_unknown: bool = False) -> DataFrame:
    return df.filter(~F.coalesce(number(F.col("duration_seconds")) <= most, F.lit(drop_unknown)))


def resolve_shorts(df: DataFrame, verdicts: DataFrame, ceiling: int = POSSIBLE_SHORT_SECONDS) -> DataFrame:
    """Adds is_short (null if unknown) and short_source: a stored verdict first, else items above the ceiling aren't short."""
    v = verdicts.select("video_id", F.col("is_short").alias("_v"))
    long_item = number(F.col("duration_seconds")) > ceiling
    out = df.join(v, "video_id", "left").withColumn("is_short", F.coalesce("_v", F.when(long_item, F.lit(False))))
    return out.withColumn("short_source", F.when(F.col("_v").isNotNull(), "label").when(long_item, "duration").otherwise("unknown")).drop("_v")


def new_short_verdicts(resolved: DataFrame) -> DataFrame:
    """Verdicts that the duration decided and no label holds yet."""
    return resolved.filter("short_source = 'duration'").select("video_id", "is_short", F.lit("duration").alias("method"))


def drop_known(df: DataFrame, verdicts: DataFrame, flag: str, drop_value: bool, drop_unknown: bool = False) -> DataFrame:
    """Drops items whose verdict `flag` is `drop_value`; those without verdict stay unless `drop_unknown`."""
    v = verdicts.select("video_id", F.col(flag).alias("_v"))
    return df.join(v, "video_id", "left").filter(F.coalesce(F.col("_v") != drop_value, F.lit(not drop_unknown))).drop("_v")


def usable_liveness(verdicts: DataFrame, now: datetime | str, max_age_days: float) -> DataFrame:
    """Verdicts still to be trusted: dead ones for ever, live ones up to an age."""
    return verdicts.filter(~F.col("is_live") | (days_between(at(now), F.col("checked_at")) <= max_age_days))


def recent(df: DataFrame, time: str, now: datetime | str, days: float, keep_unknown: bool) -> DataFrame:
    inside = F.col(time) >= at(now) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(days * 86400.0).cast("decimal(18,6)"))
    return df.filter(F.coalesce(inside, F.lit(keep_unknown)))


def restrict_to(history: DataFrame, survivors: DataFrame, key: str = "video_id") -> DataFrame:
    return history.join(survivors.select(key).distinct(), key, "left_semi")
