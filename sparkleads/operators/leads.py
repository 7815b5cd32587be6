"""From snapshots to one ranked lead list: load, filter, enrich, score, normalise, combine, cap, verify."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import finite, item_url, parent_url
from . import language as lang
from .latest import best_per_key, top_per_key
from .metrics import SHORT_SECONDS, drop_known, enrich, exclude_shorts, restrict_to
from .ranking import max_rank_pct, min_max, with_number
from .rules import Rule, apply_rules, apply_to_results, for_scope
from .scoring import SCORERS
from .settle import alone, settled, small
from .themes import ThemeParams, score_topics

# Weights of the scorers in the blend, in the order of their columns.
WEIGHTS = {"breakout_outliers": 1.35, "weight_class_performance": 1.35, "channel_relative": 1.05, "velocity": 0.85, "engagement": 0.60, "topics": 0.35}
IDENTITY = ["title", "channel_id", "channel_name", "subscribers", "video_count", "views", "comments", "views_per_sub", "channel_relative_multiple", "comment_rate", "published_at", "video_age_days", "sub_class", "video_count_class", "category_id", "channel_language", "language_source", "video_url", "channel_url"]
CORROBORATION, TOPIC_INPUT = 0.12, 5_000


@dataclass
class AnalysisFrame:
    items: DataFrame
    history: DataFrame | None
    languages: DataFrame | None = None


@dataclass
class Results:
    """Results by scorer, and what went wrong with those that failed: they have an empty result."""

    frames: dict[str, DataFrame]
    failures: dict[str, str] = field(default_factory=dict)


def analysis_frame(items: DataFrame, now: datetime | str, history: DataFrame | None = None, rules: list[Rule] = (), english_only: bool = False, keep_unknown: bool = True,
                   lexicon: DataFrame | None = None, detector: Callable | None = None, short_seconds: int | None = SHORT_SECONDS, drop_unknown_shorts: bool = False) -> AnalysisFrame:
    """Latest items joined to parents -> language, corpus rules and length filters -> enriched. Filters come before baselines
    and change them; the history keeps only survivors."""
    languages = None
    out = items
    if english_only:
        languages = lang.parent_languages(items, lexicon, detector)
        out = lang.filter_english(lang.annotate(out, languages), keep_unknown)
    out = apply_rules(out, for_scope(list(rules), "corpus"))
    if short_seconds is not None:
        out = exclude_shorts(out, short_seconds, drop_unknown_shorts)
    enriched = alone(items.sparkSession, lambda: with_number(enrich(settled(out), now)))  # every scorer reads it
    return AnalysisFrame(enriched, restrict_to(history, enriched) if history is not None else None, languages)


def union_leads(results: dict[str, DataFrame]) -> DataFrame | None:
    """One row per item over all results: that of the highest raw score, whichever scorer gave it."""
    union = None
    for name, df in sorted(results.items()):
        tagged = df.withColumn("_from", F.lit(name))
        union = tagged if union is None else union.unionByName(tagged, allowMissingColumns=True)
    return None if union is None else best_per_key(union, ["video_id"], [F.desc_nulls_last("score"), F.col("_from")]).drop("_from")


def topic_input(results: dict[str, DataFrame], most: int | None = TOPIC_INPUT) -> DataFrame | None:
    """The union, or a balanced part of it: each scorer's best `most / scorers`, filled up from the union by score. `most` is a limit of the feature; None lifts it.

    Which items these are is decided by ids and scores alone; their rows are looked up at the end."""
    if not results or most is None:
        return union_leads(results)
    scored = {n: df.select("video_id", "score") for n, df in results.items()}
    union = union_leads(scored)
    quota = max(1, most // max(1, len(results)))
    best = union_leads({n: df.orderBy(F.desc_nulls_last("score"), "video_id").limit(quota) for n, df in scored.items()})
    ranked = union.join(best.select("video_id", F.lit(0).alias("_first")), "video_id", "left").withColumn("_first", F.coalesce("_first", F.lit(1)))
    chosen = settled(ranked.orderBy("_first", F.desc_nulls_last("score"), "video_id").limit(most).select("video_id"))
    return union_leads({n: df.join(small(chosen), "video_id", "left_semi") for n, df in results.items()})


def run_scorers(frame: AnalysisFrame, params: dict[str, dict] | None = None, scorers: dict[str, Callable] | None = None, topics: bool = True, materialise: Callable[[str, DataFrame], DataFrame] | None = None, columns: list[str] | None = None, strict: bool = False) -> Results:
    """Every scorer over the frame, then topics over their union. A scorer that fails leaves an empty result and its error, for callers that look at `failures`,
    and the topics go without it; with `strict` it is an error of the run.

    `materialise` (name, df) -> df, say a Parquet stage, computes each result within its guard; by default it is settled, and what its scorer settles on the way
    goes. `columns` of the results are kept, by default all.
    """
    params, scorers = params or {}, scorers or SCORERS
    out = Results({})
    spark = frame.items.sparkSession

    def guarded(name: str, make: Callable[[], DataFrame]) -> None:
        try:
            kept = (lambda: make().select(*columns)) if columns else make
            out.frames[name] = materialise(name, kept()) if materialise else alone(spark, kept)
        except Exception as error:  # noqa: BLE001  one failing scorer must not take the others along
            if strict:
                raise RuntimeError(f"scorer {name} failed: {type(error).__name__}: {error}") from error
            out.failures[name] = f"{type(error).__name__}: {error}"
            out.frames[name] = spark.createDataFrame([], "video_id string, score double, reason string")

    for name, scorer in scorers.items():
        extra = {"snapshots": frame.history} if name == "velocity" and frame.history is not None else {}
        guarded(name, lambda scorer=scorer, extra=extra, name=name: scorer(frame.items, **extra, **params.get(name, {})))
    if topics:
        options = dict(params.get("topics", {}))
        most = options.pop("max_input_leads", TOPIC_INPUT)
        usable = {n: df for n, df in out.frames.items() if n not in out.failures}
        guarded("topics", lambda: score_topics(frame.items, topic_input(usable, most), ThemeParams(**options)))
    return out


def normalize_scores(results: dict[str, DataFrame], method: str = "rank") -> dict[str, DataFrame]:
    """Adds normalized_score: the share of a scorer's rows with at most this score, or the score between least and greatest."""
    if method not in ("rank", "minmax"):
        raise ValueError(f"no method {method!r}")
    make = (lambda df: max_rank_pct(df, [], "score", "normalized_score")) if method == "rank" else (lambda df: min_max(df, "score", "normalized_score"))
    return {n: make(df).withColumn("normalized_score", F.coalesce("normalized_score", F.lit(0.0))) for n, df in results.items()}


def combine(results: dict[str, DataFrame], source: DataFrame | None = None, weights: dict[str, float] | None = None, bonus: float = CORROBORATION) -> DataFrame:
    """One row per item: weighted sum of normalised scores times 1 + bonus * (scorers that hit - 1), with their names and reasons.

    The results are stacked and aggregated once, in place of a join for each scorer; the blend is settled before it meets the items' wide rows.
    """
    if bonus < 0:
        raise ValueError("bonus must not be negative")
    weights = {**WEIGHTS, **(weights or {})}
    names = [n for n in WEIGHTS if n in results] + sorted(n for n in results if n not in WEIGHTS)
    stacked = None
    for k, n in enumerate(names):
        df = results[n]
        one = best_per_key(df, ["video_id"], [F.desc_nulls_last("score")]).select(F.col("video_id").cast("string").alias("video_id"), F.lit(k).alias("k"), F.lit(n).alias("name"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), "normalized_score")).alias("s"), F.col("score").cast("double").alias("raw"), F.coalesce("reason", F.lit("")).alias("reason"))
        stacked = one if stacked is None else stacked.unionByName(one)
    if stacked is None:
        raise ValueError("no results to combine")
    per = [F.coalesce(F.max(F.when(F.col("name") == n, F.col("s"))), F.lit(0.0)).alias(f"score_{n}") for n in [*WEIGHTS, *[x for x in names if x not in WEIGHTS]]]
    raws = [F.max(F.when(F.col("name") == n, F.col("raw"))).alias(f"raw_{n}") for n in [*WEIGHTS, *[x for x in names if x not in WEIGHTS]]]
    listed = F.array_sort(F.collect_list(F.struct("k", "name", "reason")))
    blend = stacked.groupBy("video_id").agg(F.count("*").cast("int").alias("algorithms_hit"), *per, *raws, listed.alias("_l"))
    total = sum((F.col(f"score_{n}") * float(weights.get(n, 1.0)) for n in names), F.lit(0.0))
    reasons = F.filter(F.col("_l.reason"), lambda r: F.trim(r) != "")
    blend = blend.withColumns({"composite_score": F.coalesce(finite(total * (1 + bonus * (F.col("algorithms_hit") - 1))), F.lit(0.0)), "algorithms": F.array_join("_l.name", ","), "reasons": F.array_join(reasons, " | "), "is_short_confirmed": F.lit(None).cast("boolean")}).drop("_l")
    out = settled(blend)
    identity = source if source is not None else union_leads(results)
    have = [c for c in IDENTITY if c in identity.columns]
    newest = [F.desc_nulls_last("published_at")] if "published_at" in have else [F.col("video_id")]
    known = best_per_key(identity.select(F.col("video_id").cast("string").alias("video_id"), *have), ["video_id"], newest)
    out = out.join(known, "video_id", "left").withColumns({c: F.lit(None).cast("string") for c in IDENTITY if c not in have})
    out = out.withColumns({"video_url": F.coalesce("video_url", item_url(F.col("video_id"))), "channel_url": F.coalesce("channel_url", F.when(F.col("channel_id").isNotNull(), parent_url(F.col("channel_id"))))})
    scores = [c for n in [*WEIGHTS, *[x for x in names if x not in WEIGHTS]] for c in (f"score_{n}",)]
    return out.select("video_id", "composite_score", "algorithms_hit", "algorithms", "reasons", "is_short_confirmed", *scores, *[c.replace("score_", "raw_", 1) for c in scores], *IDENTITY)



def ordered(leads: DataFrame) -> DataFrame:
    return leads.orderBy(F.desc("composite_score"), F.desc("algorithms_hit"), F.desc_nulls_last("views"), "video_id")


@dataclass(frozen=True)
class LeadFilters:
    min_subscribers: float | None = None
    max_subscribers: float | None = None
    min_views: float | None = None
    max_age_days: float | None = None
    sub_classes: tuple[str, ...] | None = None
    categories: tuple[str, ...] | None = None
    per_channel: int | None = None


def apply_filters(leads: DataFrame, f: LeadFilters) -> DataFrame:
    """Rows within all given bounds; a null value is outside a bound. The cap per parent comes last; rows without parent are one group."""
    out = leads
    for column, bound, above in (("subscribers", f.min_subscribers, True), ("subscribers", f.max_subscribers, False), ("views", f.min_views, True), ("video_age_days", f.max_age_days, False)):
        if bound is not None:
            out = out.filter(F.col(column) >= bound if above else F.col(column) <= bound)
    if f.sub_classes is not None:
        out = out.filter(F.col("sub_class").isin(list(f.sub_classes)))
    if f.categories is not None:
        out = out.filter(F.col("category_id").isin(list(f.categories)))
    if f.per_channel is not None:
        out = top_per_key(out, ["channel_id"], [F.desc("composite_score"), F.desc("algorithms_hit"), F.desc_nulls_last("views"), F.col("video_id")], f.per_channel)
    return out


def verified(leads: DataFrame, verdicts: DataFrame, drop_confirmed: bool = True) -> DataFrame:
    """Sets is_short_confirmed from the verdict table; confirmed shorts go, unknown ones stay."""
    v = verdicts.select("video_id", F.col("is_short").alias("_v"))
    out = leads.join(v, "video_id", "left").withColumn("is_short_confirmed", F.col("_v")).drop("_v").select(*leads.columns)
    return out.filter(~F.coalesce("is_short_confirmed", F.lit(False))) if drop_confirmed else out


def top_leads(leads: DataFrame, n: int, verdicts: DataFrame | None = None, over_fetch: float = 1.5) -> DataFrame:
    """The best `n` leads; with verdicts, the best n * over_fetch are looked up, shorts dropped and the rest cut to n."""
    if verdicts is None:
        return ordered(leads).limit(n)
    return ordered(verified(ordered(leads).limit(math.ceil(n * over_fetch)), verdicts)).limit(n)


def generate_leads(items: DataFrame, now: datetime | str, history: DataFrame | None = None, rules: list[Rule] = (), params: dict[str, dict] | None = None, weights: dict[str, float] | None = None,
                   filters: LeadFilters | None = None, verdicts: DataFrame | None = None, top_n: int | None = None, materialise: Callable[[str, DataFrame], DataFrame] | None = None, **frame_options) -> DataFrame:
    """The whole path from latest items and history to ranked leads. A blend without one of its scorers would look like any other, so a scorer that fails is an
    error here."""
    def blended() -> DataFrame:
        frame = analysis_frame(items, now, history, rules, **frame_options)
        if materialise:
            frame.items = materialise("enriched", frame.items)
        # Rules look at titles, and stages are the caller's; else the blend and the topics take all else from the frame.
        columns = None if rules or materialise else ["video_id", "score", "reason"]
        results = run_scorers(frame, params, materialise=materialise, columns=columns, strict=True)
        kept = apply_to_results(results.frames, list(rules)) if rules else results.frames
        return apply_filters(combine(normalize_scores(kept), frame.items, weights), filters or LeadFilters())

    combined = alone(items.sparkSession, blended)  # the leads are put in order when all else has gone
    if verdicts is not None and top_n is None:
        return ordered(verified(combined, verdicts))
    return top_leads(combined, top_n, verdicts) if top_n is not None else ordered(combined)


def best_by_result(df: DataFrame) -> DataFrame:
    return best_per_key(df, ["video_id"], [F.desc_nulls_last("score")])


def drop_confirmed_shorts(leads: DataFrame, verdicts: DataFrame) -> DataFrame:
    return drop_known(leads, verdicts, "is_short", True)
