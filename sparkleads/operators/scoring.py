"""Five item scorers. Each takes the enriched frame and returns its own fixed columns, one row per item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import acceleration_curve, compact_number, days_between, finite, fixed, instant, item_url, log_compress, number, parent_url, safe_ratio, weighted_mean
from .latest import best_per_key, require_columns, top_per_key
from .metrics import restrict_to
from .ranking import ROW, average_rank_pct, average_rank_pcts, average_rank_tables, leave_one_out, median_mad, numbered, robust_zs
from .settle import alone, settled, small

# Output columns, in order.
_HEAD = ["video_id", "score", "reason", "title", "channel_name", "subscribers", "video_count", "views", "comments"]
BREAKOUT_COLUMNS = [*_HEAD, "views_per_sub", "views_per_day", "comment_rate", "published_at", "video_url", "channel_url"]
WEIGHT_CLASS_COLUMNS = [*_HEAD, "views_per_sub", "comment_rate", "sub_class", "video_count_class", "group_size", "composite_raw", "pct_views", "pct_views_per_day", "pct_comment_rate", "pct_views_per_sub", "published_at", "video_url", "channel_url"]
CHANNEL_COLUMNS = [*_HEAD, "channel_median_views", "channel_p90_views", "channel_video_sample", "channel_relative_multiple", "p90_multiple", "views_per_sub", "comment_rate", "published_at", "video_url", "channel_url", "sample_confidence", "video_age_days"]
VELOCITY_COLUMNS = [*_HEAD, "views_per_day", "observed_views_per_day", "lifetime_views_per_day", "acceleration_ratio", "snapshot_count", "observation_span_days", "video_age_days", "sub_class", "published_at", "video_url", "channel_url", "publish_velocity_score", "publish_percentile", "acceleration_score", "negative_delta_clipped"]
ENGAGEMENT_COLUMNS = ["video_id", "score", "reason", "title", "channel_name", "subscribers", "video_count", "views", "likes", "comments", "comment_rate", "like_rate", "engagement_rate", "comment_rate_z", "like_rate_z", "z_scale_source", "views_per_sub", "premium_lead", "suspicious_engagement", "sub_class", "published_at", "video_url", "channel_url"]


def _finished(df: DataFrame, reason: Column, columns: list[str]) -> DataFrame:
    """One row per item, the best; with reason and addresses. Ties go by the rest of the ranking keys, then the id."""
    out = df.withColumns({"reason": reason, "video_url": item_url(F.col("video_id")), "channel_url": parent_url(F.col("channel_id"))})
    return best_per_key(out, ["video_id"], [F.desc_nulls_last("score"), F.desc_nulls_last("views")]).select(*columns)


def ranked(result: DataFrame) -> DataFrame:
    """A scorer's rows in order, the id last so that the order is fixed."""
    return result.orderBy(F.desc_nulls_last("score"), F.desc_nulls_last("views"), "video_id")


def breakout_outliers(df: DataFrame, min_views_per_sub: float = 10, min_subscribers: float = 500, max_subscribers: float = 100_000, min_views: float = 50_000,
                      min_age_days: float = 3, max_age_days: float | None = None, require_engagement: bool = True, min_like_rate: float = 0.001, min_comment_rate: float = 0.0001,
                      views_exponent: float = 0.5) -> DataFrame:
    """Items of small parents that far outgrew their audience: ln(1 + views per subscriber) * ln(1 + views)^exponent.

    Views per subscriber come from views and subscribers where they are missing. With `require_engagement` one of the two rates must be above its least.
    """
    if views_exponent < 0:
        raise ValueError("views_exponent must not be negative")
    require_columns(df, ["video_id", "channel_id", "views", "subscribers", "views_per_sub", "video_age_days", "like_rate", "comment_rate"])
    df = df.withColumn("views_per_sub", F.coalesce(finite(F.col("views_per_sub")), safe_ratio(F.col("views"), F.col("subscribers"))))
    wanted = (F.col("views_per_sub") >= min_views_per_sub) & F.col("subscribers").between(min_subscribers, max_subscribers) & (F.col("views") >= min_views) & (F.col("video_age_days") >= min_age_days)
    if max_age_days is not None:
        wanted = wanted & (F.col("video_age_days") <= max_age_days)
    if require_engagement:
        wanted = wanted & ((F.coalesce("like_rate", F.lit(0.0)) > min_like_rate) | (F.coalesce("comment_rate", F.lit(0.0)) > min_comment_rate))
    score = finite(F.log1p("views_per_sub") * F.pow(F.log1p("views"), F.lit(views_exponent)))
    found = df.filter(wanted).withColumn("score", score).filter("score > 0")
    reason = F.concat(compact_number(F.col("views_per_sub")), F.lit("x views/sub: "), compact_number(F.col("views")), F.lit(" views on "), compact_number(F.col("subscribers")), F.lit(" subscribers"))
    return _finished(found, reason, BREAKOUT_COLUMNS)


def weight_class_performance(df: DataFrame, min_group: int = 30, min_score: float = 0.99, min_views: float = 10_000, least_metrics: int = 2, weights: dict[str, float] | None = None) -> DataFrame:
    """Items at the top of their peer class: percentile of the weighted mean of four percentiles within (sub_class, video_count_class)."""
    keys = ["sub_class", "video_count_class"]
    require_columns(df, ["video_id", *keys, "views", "views_per_day", "comment_rate", "views_per_sub"])
    weights = weights or {"views": 0.5, "views_per_sub": 2.5, "views_per_day": 0.5, "comment_rate": 0.7}
    spark = df.sparkSession
    out = numbered(df).filter((F.col("sub_class") != "unknown") & (F.col("video_count_class") != "unknown"))
    sizes = settled(out.groupBy(*keys).agg(F.count("*").alias("group_size")))

    def blended() -> DataFrame:
        placed = average_rank_pct(out.select(ROW, *keys, *weights), keys, {m: f"pct_{m}" for m in weights})
        blend = weighted_mean([(F.col(f"pct_{m}"), w) for m, w in weights.items()], least_metrics)
        return placed.select(ROW, *keys, *[f"pct_{m}" for m in weights], F.round(blend, 12).alias("composite_raw"))  # rounded: equal blends tie whatever the order of their sums

    def topmost() -> DataFrame:
        raw = alone(spark, blended)
        (score,) = average_rank_tables(raw, [("composite_raw", keys, "score")])
        return raw.drop(*keys).join(small(score.filter(F.col("score") >= min_score)), ROW)

    # Only numbers and ranks are settled on the way; the few rows found are looked up at the end.
    found = out.join(small(alone(spark, topmost)), ROW).join(small(sizes), keys).filter((F.col("group_size") >= min_group) & (F.col("views") >= min_views))
    top = F.greatest(F.lit(0.1), (1 - F.col("score")) * 100)
    reason = F.concat(F.lit("top "), fixed(top, 1, 12), F.lit("% of "), F.col("sub_class"), F.lit(" subscribers / "), F.col("video_count_class"), F.lit(" videos"))
    return _finished(found, reason, WEIGHT_CLASS_COLUMNS)


def channel_relative(df: DataFrame, min_sample: int = 5, min_views: float = 20_000, min_median: float = 500, min_multiple: float = 10, min_age_days: float = 3,
                     p90_weight: float = 0.35, views_weight: float = 0.15, confidence_items: float = 10) -> DataFrame:
    """Items far above their parent's other items: leave-one-out median and 90th percentile."""
    require_columns(df, ["video_id", "channel_id", "views", "video_age_days"])
    stripped = df.drop("channel_median_views", "channel_p90_views", "channel_video_sample", "channel_relative_multiple")
    based = leave_one_out(stripped, "channel_id", "views", {"channel_median_views": 0.5, "channel_p90_views": 0.9}, "channel_video_sample")
    based = based.withColumns({"channel_relative_multiple": safe_ratio(F.col("views"), F.col("channel_median_views")), "p90_multiple": safe_ratio(F.col("views"), F.col("channel_p90_views"))})
    n = F.col("channel_video_sample")
    wanted = (n >= min_sample) & (F.col("views") >= min_views) & (F.col("channel_median_views") >= min_median) & (F.col("channel_relative_multiple") >= min_multiple) & (F.col("video_age_days") >= min_age_days)
    blend = F.log1p("channel_relative_multiple") + p90_weight * F.log1p(F.coalesce("p90_multiple", F.lit(0.0)))
    found = based.filter(wanted).withColumn("sample_confidence", n / (n + confidence_items))
    found = found.withColumn("score", finite(blend * F.col("sample_confidence") + views_weight * F.log1p(F.col("views") / min_views)))
    reason = F.concat(compact_number(F.col("channel_relative_multiple")), F.lit("x the channel's median of "), compact_number(F.col("channel_median_views")), F.lit(" over "), n.cast("string"), F.lit(" other videos"))
    return _finished(found, reason, CHANNEL_COLUMNS)


def observed_velocity(snapshots: DataFrame, min_interval_days: float = 0.5, tie: str | None = "id") -> DataFrame:
    """(video_id, observed_views_per_day, snapshot_count, observation_span_days, negative_delta_clipped) of each item's snapshots.

    Bad rows go first. The rate is that of the latest interval of at least `min_interval_days`, a fall counting as 0; the flag
    tells of any fall. Snapshots at one time go by `tie`, if that column is there.
    """
    keep = [tie] if tie and tie in snapshots.columns else []
    snap = snapshots.select(F.col("video_id").cast("string").alias("video_id"), instant(F.col("collected_at")).alias("t"), number(F.col("views")).alias("views"), *keep).dropna(subset=["video_id", "t", "views"])
    order = Window.partitionBy("video_id").orderBy("t", *(keep or ["views"]))
    steps = snap.withColumns({"d": F.col("views") - F.lag("views").over(order), "days": days_between(F.col("t"), F.lag("t").over(order)), "k": F.row_number().over(order)})
    rate = F.when(F.col("days") >= min_interval_days, F.greatest(F.col("d"), F.lit(0.0)) / F.col("days"))
    return steps.withColumn("rate", rate).groupBy("video_id").agg(
        F.max_by("rate", F.when(F.col("rate").isNotNull(), F.col("k"))).alias("observed_views_per_day"), F.count("*").alias("snapshot_count"),
        days_between(F.max("t"), F.min("t")).alias("observation_span_days"), F.coalesce(F.bool_or(F.col("d") < 0), F.lit(False)).alias("negative_delta_clipped"),
    )


def publish_velocity(df: DataFrame, max_age_days: float = 90, min_group: int = 30) -> DataFrame:
    """Adds publish_velocity_score, publish_percentile and publish_group: views per day against the peer class, falling back to
    sub_class and the whole table where a class is small or has no spread."""
    levels = [(["sub_class", "video_count_class"], "a"), (["sub_class"], "b"), ([], "c")]
    df = numbered(df)
    none = F.lit(None).cast("string")
    classes = F.array(*[F.struct(F.lit(tag).alias("_level"), *[(F.col(g).cast("string") if g in keys else none).alias(f"_l_{g}") for g in levels[0][0]]) for keys, tag in levels])
    long = df.select(F.explode(classes).alias("_x"), "views_per_day").select("_x.*", "views_per_day")
    of_levels = alone(df.sparkSession, lambda: median_mad(long, ["_level", "_l_sub_class", "_l_video_count_class"], "views_per_day"))
    out = average_rank_pcts(df, [("views_per_day", keys, f"_p{tag}") for keys, tag in levels])
    for keys, tag in levels:
        stats = of_levels.filter(F.col("_level") == tag).select(*[F.col(f"_l_{g}").alias(g) for g in keys], F.col("n").alias(f"_n{tag}"), F.col("median").alias(f"_m{tag}"), F.col("mad").alias(f"_s{tag}"))
        out = out.join(small(stats), keys, "left") if keys else out.join(F.broadcast(stats), how="left")  # one row
    n, nb = F.coalesce("_na", F.lit(0)), F.coalesce("_nb", F.lit(0))
    use_b = (n < min_group) & (nb >= min_group)

    def either(tag: str) -> Column:
        return F.when(use_b, F.col(f"_{tag}b")).otherwise(F.col(f"_{tag}a"))

    count = F.when(use_b, nb).otherwise(n)
    use_c = (count < min_group) | F.coalesce(either("s") <= 0, F.lit(True))
    global_scale = F.when(F.coalesce("_sc", F.lit(0.0)) > 0, F.col("_sc")).otherwise(F.lit(1.0))
    middle = F.when(use_c, F.coalesce("_mc", F.lit(0.0))).otherwise(either("m"))
    scale = 1.4826 * F.when(use_c, global_scale).otherwise(either("s"))
    z = F.greatest(safe_ratio(F.col("views_per_day") - middle, scale, 0.0), F.lit(0.0))
    score = F.when(F.col("video_age_days") <= max_age_days, 100 * z / (z + 25))
    pct = F.coalesce(F.when(use_c, F.coalesce("_pc", F.lit(0.0))).otherwise(either("p")), F.lit(0.0))
    label = F.when(use_c, "global").when(use_b, F.col("sub_class")).otherwise(F.concat_ws("/", "sub_class", "video_count_class"))
    made = out.withColumns({"publish_velocity_score": score, "publish_percentile": pct, "publish_group": label})
    return made.drop(*[f"_{x}{tag}" for x in "nmsp" for _, tag in levels])


def velocity(df: DataFrame, snapshots: DataFrame | None = None, max_age_days: float = 90, min_group: int = 30, min_interval_days: float = 0.5, evergreen_days: float = 30,
             min_views: float = 10_000, min_score: float = 80, publish_weight: float = 0.4, acceleration_weight: float = 0.6) -> DataFrame:
    """Items that grow fast now: publish velocity among peers blended with acceleration over the lifetime rate.

    Without `snapshots` only the first counts; an empty history gives no rows.
    """
    require_columns(df, ["video_id", "channel_id", "views", "views_per_day", "video_age_days", "sub_class", "video_count_class"])
    out = publish_velocity(df, max_age_days, min_group)
    out = out.withColumn("video_age_days", F.greatest(F.col("video_age_days"), F.lit(0.5))).withColumn("lifetime_views_per_day", safe_ratio(F.col("views"), F.col("video_age_days")))
    if snapshots is not None:
        require_columns(snapshots, ["video_id", "collected_at", "views"], "snapshots")
        history = observed_velocity(restrict_to(snapshots.withColumn("video_id", F.col("video_id").cast("string")), df), min_interval_days)
        any_row = snapshots.limit(1).select(F.lit(1).alias("_any"))
        out = out.join(history, "video_id", "left").crossJoin(F.broadcast(any_row)).drop("_any")
    else:
        out = out.selectExpr("*", "cast(null AS double) AS observed_views_per_day", "cast(null AS bigint) AS snapshot_count", "cast(null AS double) AS observation_span_days", "cast(null AS boolean) AS negative_delta_clipped")
    out = out.withColumns({"snapshot_count": F.coalesce("snapshot_count", F.lit(0)), "observation_span_days": F.coalesce("observation_span_days", F.lit(0.0)), "negative_delta_clipped": F.coalesce("negative_delta_clipped", F.lit(False))})
    out = out.withColumn("acceleration_ratio", safe_ratio(F.col("observed_views_per_day"), F.col("lifetime_views_per_day")))
    out = out.withColumn("acceleration_score", acceleration_curve(F.col("acceleration_ratio"), F.col("video_age_days"), evergreen_days))
    blend = weighted_mean([(F.col("publish_velocity_score"), publish_weight), (F.when(F.col("acceleration_score") > 0, F.col("acceleration_score")), acceleration_weight)])
    found = out.withColumn("score", blend).filter((F.col("views") >= min_views) & (F.col("score") >= min_score))
    faster = (F.col("acceleration_ratio") > 1) & (F.col("acceleration_score") > 0)
    accelerating = F.format_string("accelerating: %.1fx its lifetime rate across %d snapshots over %.0fd", F.col("acceleration_ratio"), F.col("snapshot_count"), F.col("observation_span_days"))
    top = F.greatest(F.lit(1), F.ceil((1 - F.col("publish_percentile")) * 100)).cast("string")
    reason = F.when(faster, accelerating).otherwise(F.concat(F.lit("top "), top, F.lit("% views/day in "), F.col("publish_group"), F.lit(" class")))
    return _finished(found, reason, VELOCITY_COLUMNS)


def engagement(df: DataFrame, group: str = "sub_class", min_group: int = 30, comment_weight: float = 3.0, like_weight: float = 0.5, premium_views_per_sub: float = 5, premium_z: float = 2,
               premium_bonus: float = 2.0, drop_suspicious: bool = True, suspicious_penalty: float = 8.0, suspicious_views: float = 100_000, suspicious_like_rate: float = 0.0005,
               suspicious_comment_rate: float = 0.0001, suspicious_engagement_rate: float = 0.0005, min_views: float = 10_000, min_comment_z: float = 1.5, min_comments: float = 50, per_channel: int = 3) -> DataFrame:
    """Items whose audience comments and likes far more than its class: robust z-scores, at most `per_channel` rows a parent. `df` is settled or cheap to read."""
    require_columns(df, ["video_id", "channel_id", "views", "likes", "comments", "subscribers", group])
    out = df.withColumns({
        "comment_rate": safe_ratio(F.col("comments"), F.col("views")), "like_rate": safe_ratio(F.col("likes"), F.col("views")),
        "engagement_rate": safe_ratio(F.col("likes") + F.col("comments"), F.col("views")), "views_per_sub": safe_ratio(F.col("views"), F.col("subscribers")),
    })
    out = robust_zs(out, group, {"comment_rate": ("comment_rate_z", "z_scale_source", "_center"), "like_rate": ("like_rate_z", "_source", "_like_center")}, min_group)
    low = (F.col("engagement_rate") < suspicious_engagement_rate) & (F.col("like_rate") <= suspicious_like_rate) & (F.col("comment_rate") <= suspicious_comment_rate)
    out = out.withColumns({
        "premium_lead": (F.coalesce("views_per_sub", F.lit(0.0)) >= premium_views_per_sub) & (F.col("comment_rate_z") >= premium_z),
        "suspicious_engagement": F.coalesce((F.col("views") >= suspicious_views) & low, F.lit(False)),
    })
    raw = comment_weight * F.col("comment_rate_z") + like_weight * F.col("like_rate_z") + F.log1p(F.greatest(F.coalesce("views_per_sub", F.lit(0.0)), F.lit(0.0))) + F.col("premium_lead").cast("double") * premium_bonus
    raw = raw if drop_suspicious else raw - F.col("suspicious_engagement").cast("double") * suspicious_penalty
    wanted = (F.col("views") >= min_views) & (F.col("comment_rate_z") >= min_comment_z) & (F.col("comments") >= min_comments)
    wanted = wanted & ~F.col("suspicious_engagement") if drop_suspicious else wanted
    found = out.withColumn("score", log_compress(raw, -25.0)).filter(wanted)
    reason = F.format_string("comments %.1f deviations above %s, %.2f%% of views", F.col("comment_rate_z"), F.col(group), F.col("comment_rate") * 100)
    unique = best_per_key(found, ["video_id"], [F.desc("score"), F.desc_nulls_last("views")])
    capped = top_per_key(unique, ["channel_id"], [F.desc("score"), F.desc_nulls_last("views"), F.col("video_id")], per_channel, drop_null_keys=True)
    return _finished(capped, reason, ENGAGEMENT_COLUMNS)


#: Scorers by name; users may add theirs: (enriched frame, **parameters) -> DataFrame with video_id, score and reason.
SCORERS = {
    "breakout_outliers": breakout_outliers, "weight_class_performance": weight_class_performance,
    "channel_relative": channel_relative, "velocity": velocity, "engagement": engagement,
}
