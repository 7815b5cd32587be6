"""Discovery rounds: parent state, interest queue, yields, seeds and warm items."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import hash_pool, is_canonical_id, number, parent_key, safe_ratio
from .latest import best_per_key, fold_caps, latest, top_per_key
from .metrics import at
from .rules import Rule, with_first_match
from .settle import settled, small

QUEUE_STATUSES = ("pending", "promoted", "rejected")
SEED_COLUMNS = ["channel_id", "channel_name", "subscribers", "channel_views", "video_id", "title", "published_at", "video_views", "score"]


def _days_before(now: datetime | str, days: float) -> Column:
    return F.timestamp_micros(F.unix_micros(at(now)) - F.lit(int(days * 86_400_000_000)))


def feed_state(feed: DataFrame) -> DataFrame:
    """One row per parent key of the feed: newest publish and observation times, canonical id, and the id and name last seen."""
    canonical = F.when(is_canonical_id(F.col("channel_id")), F.col("channel_id"))
    return feed.filter(F.coalesce(parent_key(F.col("channel_id")), F.lit("")) != "").groupBy(parent_key(F.col("channel_id")).alias("channel_key")).agg(
        F.max("published_at").alias("last_published_at"), F.max("observed_at").alias("last_seen_at"), F.max(canonical).alias("canonical_id"),
        F.max_by("channel_id", F.struct("observed_at", "channel_id")).alias("channel_id"), F.max_by("channel_name", F.struct("observed_at", "channel_name")).alias("channel_name"),
    )


def refresh_state(fresh: DataFrame, state: DataFrame, now: datetime | str, again_days: float = 14) -> DataFrame:
    """`state` (channel_key, canonical_id, last_published_at, last_seen_at, last_success_at, under_review, eligible) with a feed's news merged in.

    New keys are eligible; seen ones become so unless under review, if their last success is null or older than `again_days`.
    """
    f = fresh.select("channel_key", F.col("canonical_id").alias("f_id"), F.col("last_published_at").alias("f_pub"), F.col("last_seen_at").alias("f_seen"))
    both = state.join(f, "channel_key", "full_outer")
    seen, new = F.col("f_seen").isNotNull(), F.col("last_seen_at").isNull() & F.col("under_review").isNull()
    due = ~F.coalesce("under_review", F.lit(False)) & (F.col("last_success_at").isNull() | (F.col("last_success_at") < _days_before(now, again_days)))
    return both.select(
        "channel_key", F.coalesce("canonical_id", "f_id").alias("canonical_id"), F.greatest("last_published_at", "f_pub").alias("last_published_at"), F.greatest("last_seen_at", "f_seen").alias("last_seen_at"),
        "last_success_at", F.coalesce("under_review", F.lit(False)).alias("under_review"), F.when(new, True).when(seen & due, True).otherwise(F.coalesce("eligible", F.lit(False))).alias("eligible"),
    )


def attempt_status(attempts: DataFrame, sources: tuple[str, str]) -> DataFrame:
    """Status of each parent by its attempts (channel_key, source, outcome, attempted_at): failed at one source -> the other is next; failed at
    both -> review; a later success clears review and what is pending, not the failure flags."""
    first, second = sources
    failed = [F.coalesce(F.bool_or((F.col("source") == s) & (F.col("outcome") == "failed")), F.lit(False)).alias(f"failed_{k}") for k, s in enumerate(sources)]
    last = F.max_by("outcome", F.struct("attempted_at", "source")).alias("last_outcome")
    out = attempts.groupBy("channel_key").agg(*failed, last, F.count("*").alias("attempts"))
    open_ = F.coalesce(F.col("last_outcome") != "success", F.lit(True))
    return out.select("channel_key", F.col("failed_0"), F.col("failed_1"), "last_outcome", "attempts", (open_ & F.col("failed_0") & F.col("failed_1")).alias("under_review"),
                      F.when(open_ & F.col("failed_0") & ~F.col("failed_1"), second).when(open_ & F.col("failed_1") & ~F.col("failed_0"), first).alias("next_source"))


def pending_work(state: DataFrame, limit: int | None = None) -> DataFrame:
    """Tried, not succeeded and not under review, newest first."""
    out = state.filter("attempts > 0 AND last_success_at IS NULL AND NOT under_review").orderBy(F.desc_nulls_last("last_seen_at"), "channel_key")
    return out.limit(limit) if limit else out


def new_parents(feed: DataFrame, state: DataFrame) -> DataFrame:
    keys = feed.select(parent_key(F.col("channel_id")).alias("channel_key")).filter("channel_key <> ''").distinct()
    return keys.join(state.select("channel_key"), "channel_key", "left_anti")


def rebuild_queue(evidence: DataFrame, version: str, previous: DataFrame | None = None) -> DataFrame:
    """The interest queue from crawl evidence: per parent the topic (first in order), confidence, hits, seeds, depth and times.

    Of a parent with several topics confidence is the greatest and depth the least of all, hits and seeds are those of the last topic in
    order, and first_seen_at that of the first. Status and promotion of `previous` stay; its parents that have no evidence now stay as they were.
    """
    key = F.coalesce("channel_key", "channel_id")
    by_topic = evidence.filter((F.col("classifier_version") == version) & F.col("matched_topic").isNotNull() & key.isNotNull()).groupBy(key.alias("channel_key"), F.col("matched_topic").alias("topic")).agg(
        F.max("channel_id").alias("channel_id"), F.max("confidence").alias("c"), F.countDistinct("video_id").alias("h"), F.countDistinct("seed_video_id").alias("s"), F.min("depth").alias("d"), F.min("observed_at").alias("f"), F.max("observed_at").alias("l"))
    fresh = by_topic.groupBy("channel_key").agg(
        F.max_by("channel_id", F.when(F.col("channel_id").isNotNull(), F.col("topic"))).alias("channel_id"), F.min("topic").alias("topic"), F.max("c").alias("best_confidence"), F.max_by("h", "topic").alias("hit_count"),
        F.max_by("s", "topic").alias("seed_count"), F.coalesce(F.min("d"), F.lit(1)).alias("depth"), F.min_by("f", "topic").alias("first_seen_at"), F.max_by("l", "topic").alias("last_seen_at"))
    if previous is None:
        return fresh.withColumn("status", F.lit("pending"))
    old = previous.select("channel_key", *[F.col(c).alias(f"o_{c}") for c in fresh.columns if c != "channel_key"], "status")
    both = fresh.join(old, "channel_key", "full_outer")
    pick = {c: F.coalesce(c, f"o_{c}") for c in ("channel_id", "hit_count", "seed_count", "last_seen_at")} | {c: F.coalesce(f"o_{c}", c) for c in ("topic", "first_seen_at")} | {"best_confidence": F.greatest("best_confidence", "o_best_confidence"), "depth": F.least("depth", "o_depth")}
    return both.select("channel_key", *[pick[c].alias(c) for c in fresh.columns if c != "channel_key"], F.coalesce("status", F.lit("pending")).alias("status"))


def read_queue(queue: DataFrame, limit: int | None = None, status: str = "pending") -> DataFrame:
    out = queue.filter(F.col("status") == status).orderBy(F.desc("seed_count"), F.desc("hit_count"), F.desc("best_confidence"), "channel_key")
    return out.limit(limit) if limit else out


def set_status(queue: DataFrame, keys: DataFrame, status: str) -> DataFrame:
    if status not in QUEUE_STATUSES:
        raise ValueError(f"no status {status!r}")
    return queue.join(keys.select("channel_key", F.lit(status).alias("_s")).distinct(), "channel_key", "left").withColumn("status", F.coalesce("_s", "status")).drop("_s")


def crawl_yield(evidence: DataFrame, version: str) -> DataFrame:
    """(depth, total, on_topic, seeds, yield_rate) by depth."""
    out = evidence.filter(F.col("classifier_version") == version).groupBy("depth").agg(F.count("*").alias("total"), F.count_if(F.col("matched_topic").isNotNull()).alias("on_topic"), F.countDistinct("seed_video_id").alias("seeds"))
    return out.withColumn("yield_rate", safe_ratio(F.col("on_topic"), F.col("total"), 0.0)).orderBy("depth")


def seed_yield(found: DataFrame, known: DataFrame) -> DataFrame:
    """(seed_video_id, discovered): parents (channel_key) not known before, each counted for the seed of the least seed_order that found it."""
    first = found.groupBy("channel_key").agg(F.min_by("seed_video_id", F.struct("seed_order", "seed_video_id")).alias("seed_video_id"))
    return first.join(known.select("channel_key").distinct(), "channel_key", "left_anti").groupBy("seed_video_id").agg(F.count("*").alias("discovered"))


def select_seeds(items: DataFrame, parents: DataFrame, history: DataFrame, now: datetime | str, limit: int = 5, min_subscribers: int = 100, max_subscribers: int = 1_000_000, min_views: int = 10_000,
                 lookback_days: float = 90, cooldown_days: float = 7, rules: list[Rule] = (), over_fetch: int = 5) -> DataFrame:
    """The best recent item of each small parent by views per subscriber, without items used as seeds lately, and without what rules exclude.

    Item snapshots aren't reduced to the latest first; the parent's newest snapshot counts.
    """
    if limit < 1 or min_subscribers < 1 or max_subscribers < min_subscribers or min_views < 1 or lookback_days < 1 or cooldown_days < 1:
        raise ValueError("bounds of seed selection must be at least one and in order")
    newest = latest(parents, "channel_id").select("channel_id", "channel_name", "subscribers", F.col("views").alias("channel_views"))
    newest = newest.filter(number(F.col("subscribers")).between(min_subscribers, max_subscribers))
    used = history.filter(F.col("selected_at") >= _days_before(now, cooldown_days)).select(F.col("seed_video_id").alias("video_id")).distinct()
    fresh = items.filter((number(F.col("views")) >= min_views) & (F.col("published_at") >= _days_before(now, lookback_days))).join(used, "video_id", "left_anti")
    best = best_per_key(fresh, ["channel_id"], [number(F.col("views")).desc(), F.col("published_at").desc(), F.col("id").desc()]) if "channel_id" in fresh.columns else fresh
    joined = best.select("channel_id", "video_id", "title", "published_at", F.col("views").alias("video_views")).join(newest, "channel_id")
    scored = joined.withColumn("score", safe_ratio(F.col("video_views"), F.col("subscribers"))).select(*SEED_COLUMNS).orderBy(F.desc("score"), F.desc(number(F.col("video_views"))), "video_id")
    if not rules:
        return scored.limit(limit)
    return with_first_match(scored.limit(limit * over_fetch), rules).filter("matched_rule IS NULL").drop("matched_rule").orderBy(F.desc("score"), F.desc(number(F.col("video_views"))), "video_id").limit(limit)


def warm_items(labelled: DataFrame, items: DataFrame, verdicts: DataFrame, version: str, least_confidence: int = 3, min_views: int = 10_000, warm_share: float = 0.35, per_channel: int = 2,
               per_channel_high: int = 3, high_confidence: int = 4, per_topic: int = 50, n: int | None = 20, seed: int = 7) -> DataFrame:
    """Items to warm a profile with: labels (video_id, topic, confidence, classifier_version) joined to their items, in the WARM pool and no
    shorts by title, length or verdict, greedily capped by title, parent and topic over all of them, then `n` drawn with a seed (None: all).

    The order of the caps is confidence, views, item, topic. Items without a parent or topic aren't capped by it.
    """
    wanted = labelled.filter((F.col("classifier_version") == version) & (F.col("confidence") >= least_confidence)).select("video_id", "topic", "confidence")
    title = F.lower(F.trim("title"))
    seen = items.select("video_id", "channel_id", "title", "views", "duration_seconds").filter((F.col("views") >= min_views) & (number(F.col("duration_seconds")) > 60))
    pooled = seen.filter(~F.coalesce(title.contains("#shorts"), F.lit(False)) & (hash_pool(F.col("channel_id"), warm_share) == "WARM"))
    known = wanted.join(pooled, "video_id").join(verdicts.filter("is_short").select("video_id"), "video_id", "left_anti")
    per_parent = F.when(F.col("confidence") >= high_confidence, per_channel_high).otherwise(per_channel)
    caps = {"title": (title, F.lit(1)), "parent": (F.col("channel_id"), per_parent), "topic": (F.col("topic"), F.lit(per_topic))}
    kept = fold_caps(known, [-F.col("confidence"), -F.col("views"), F.col("video_id"), F.col("topic")], caps)
    return kept if n is None else kept.orderBy(F.xxhash64("video_id", F.lit(seed)), "video_id", "topic").limit(n)


def untagged_items(items: DataFrame, per_parent: int) -> DataFrame:
    """Items of which no snapshot has a language, the newest `per_parent` of each parent."""
    one = items.groupBy("video_id", "channel_id").agg(F.max("default_audio_language").alias("a"), F.max("default_language").alias("t"), F.max("published_at").alias("published_at"))
    return top_per_key(one.filter("a IS NULL AND t IS NULL").drop("a", "t"), ["channel_id"], [F.desc_nulls_last("published_at"), F.col("video_id")], per_parent)


#: Characters of the pieces by which known names are found.
GRAM = 3


def _grams(text: Column, n: Column) -> Column:
    """The distinct pieces of `n` characters; none of shorter texts."""
    starts = F.when(F.char_length(text) >= n, F.sequence(F.lit(1), F.char_length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, n)))


def known_profile(new: DataFrame, known: DataFrame) -> DataFrame:
    """New handles that no known name contains, case aside; an empty handle is in any name, a null one in none.

    An index of the names' pieces of GRAM characters brings the candidates: a handle is looked for only in names with its rarest piece, and one with a
    piece that no name has in none. Handles shorter than a piece are equal to a piece of their length.
    """
    handle = F.lower(F.regexp_replace("handle", "^@", ""))
    wanted = settled(new.withColumn("_handle", handle))
    names = settled(known.filter("name IS NOT NULL").select(F.lower("name").alias("_name")).distinct())
    handles = wanted.select("_handle").filter("_handle IS NOT NULL").distinct()
    short = handles.filter(F.char_length("_handle") < GRAM).select("_handle", F.char_length("_handle").alias("_n"))
    sizes = [n for n in range(1, GRAM)]
    pieces = names.select(F.explode(F.flatten(F.array(*[_grams(F.col("_name"), F.lit(n)) for n in sizes]))).alias("_handle")).distinct()
    in_short = short.filter("_n > 0").select("_handle").join(pieces, "_handle", "left_semi")
    if not names.isEmpty():
        in_short = in_short.unionByName(short.filter("_n = 0").select("_handle"))
    grams = settled(handles.filter(F.char_length("_handle") >= GRAM).select("_handle", F.explode(_grams(F.col("_handle"), F.lit(GRAM))).alias("_gram")))
    held = names.select("_name", F.explode(_grams(F.col("_name"), F.lit(GRAM))).alias("_gram"))
    counts = settled(held.join(small(settled(grams.select("_gram").distinct())), "_gram", "left_semi").groupBy("_gram").agg(F.count("*").alias("_c")))
    anchored = grams.join(small(counts), "_gram", "left").groupBy("_handle").agg(F.min_by("_gram", F.struct(F.coalesce("_c", F.lit(0)), "_gram")).alias("_gram"))
    met = held.join(small(settled(anchored)), "_gram").filter(F.contains("_name", F.col("_handle"))).select("_handle")
    return wanted.join(small(settled(met.unionByName(in_short).distinct())), "_handle", "left_anti").drop("_handle")
