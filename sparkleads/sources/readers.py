"""Readers: snapshots, parents with fallback sources, landed API payloads, CSV files and rule files."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import instant, is_canonical_id, iso_duration_seconds, parent_key, typed
from ..operators.latest import best_per_key, latest, latest_with_coalesced
from ..operators.rules import Rule, canonical

# Columns of items and parents.
ITEM_COLUMNS = ["id", "video_id", "channel_id", "title", "published_at", "collected_at", "duration_seconds", "category_id", "views", "likes", "comments", "default_audio_language", "default_language"]
PARENT_COLUMNS = ["channel_id", "channel_name", "subscribers", "video_count", "country", "channel_published_at"]
LANGUAGES = ["default_audio_language", "default_language"]


def typed_items(df: DataFrame) -> DataFrame:
    return typed(df, ["duration_seconds", "views", "likes", "comments"], ["published_at", "collected_at"], ["video_id", "channel_id", "title", "category_id"])


def typed_parents(df: DataFrame) -> DataFrame:
    return typed(df, ["subscribers", "subscribers_change", "views", "video_count"], ["collected_at", "channel_published_at"], ["channel_id", "channel_name", "country"])


def item_snapshots(df: DataFrame) -> DataFrame:
    """All snapshots, typed; the tie column id stays."""
    return typed_items(df.select(*[c for c in ITEM_COLUMNS if c in df.columns]))


def latest_items(snapshots: DataFrame) -> DataFrame:
    """Newest snapshot of each item; its languages are the greatest of any snapshot."""
    rows = item_snapshots(snapshots).filter("video_id IS NOT NULL")
    return latest_with_coalesced(rows, "video_id", [c for c in LANGUAGES if c in rows.columns])


def fallback_parents(missing: DataFrame, profiles: DataFrame, stats: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rows of PARENT_COLUMNS for `missing` (channel_id) out of two fallback tables keyed by a handle or an id.

    `mapping` (channel_key, channel_id) gives a key's canonical id; without one a key that is a canonical id stands for itself.
    The row that knows the parent's first day wins.
    """
    both = profiles.unionByName(stats, allowMissingColumns=True)
    raw = F.coalesce("channel_key", "channel_id") if "channel_key" in both.columns else F.col("channel_id")
    keyed = both.withColumns({"_key": parent_key(raw), "_own": F.when(is_canonical_id(F.col("channel_id")), F.col("channel_id"))}).drop("channel_id", "channel_key")
    to = mapping.select(parent_key(F.col("channel_key")).alias("_key"), F.col("channel_id").alias("_mapped")).dropDuplicates(["_key"])
    named = keyed.join(to, "_key", "left").withColumn("channel_id", F.coalesce("_mapped", "_own")).join(missing.select("channel_id").distinct(), "channel_id")
    for c in PARENT_COLUMNS:
        if c not in named.columns:
            named = named.withColumn(c, F.lit(None).cast("string"))
    return best_per_key(typed_parents(named), ["channel_id"], [F.desc_nulls_last("channel_published_at"), F.desc_nulls_last("subscribers"), F.col("_key")]).select(*PARENT_COLUMNS)


def latest_parents(snapshots: DataFrame, items: DataFrame | None = None, profiles: DataFrame | None = None, stats: DataFrame | None = None, mapping: DataFrame | None = None) -> DataFrame:
    """Newest snapshot of each parent, and fallback rows for parents of `items` that have none."""
    found = latest(typed_parents(snapshots), "channel_id").select(*PARENT_COLUMNS)
    if items is None or profiles is None or stats is None or mapping is None:
        return found
    missing = items.select("channel_id").distinct().join(found, "channel_id", "left_anti")
    return found.unionByName(fallback_parents(missing, profiles, stats, mapping))


def joined(items: DataFrame, parents: DataFrame) -> DataFrame:
    return items.join(parents, "channel_id", "left")


_SNIPPET = "struct<title:string,publishedAt:string,channelId:string,categoryId:string,country:string,customUrl:string,defaultLanguage:string,defaultAudioLanguage:string>"
CHANNEL_PAYLOAD = f"items array<struct<id:string,snippet:{_SNIPPET},statistics:struct<subscriberCount:string,viewCount:string,videoCount:string,hiddenSubscriberCount:boolean>,contentDetails:struct<relatedPlaylists:struct<uploads:string>>>>"
VIDEO_PAYLOAD = f"items array<struct<id:string,snippet:{_SNIPPET},statistics:struct<viewCount:string,likeCount:string,commentCount:string>,contentDetails:struct<duration:string>>>"
UPLOADS_PAYLOAD = "items array<struct<contentDetails:struct<videoId:string>>>"


def payload(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Landed JSON documents, one or many lines each, by a fixed schema."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def _count(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit("")).try_cast("long")


def channel_rows(pages: DataFrame) -> DataFrame:
    """Parents of API payloads; hidden or empty counts are null."""
    x = pages.select(F.explode("items").alias("i")).filter("i.id IS NOT NULL")
    subscribers = F.when(F.coalesce("i.statistics.hiddenSubscriberCount", F.lit(False)), None).otherwise(_count(F.col("i.statistics.subscriberCount")))
    return x.select(
        F.col("i.id").alias("channel_id"), F.col("i.snippet.title").alias("channel_name"), subscribers.alias("subscribers"), _count(F.col("i.statistics.viewCount")).alias("views"), _count(F.col("i.statistics.videoCount")).alias("video_count"),
        F.col("i.snippet.country").alias("country"), instant(F.col("i.snippet.publishedAt")).alias("channel_published_at"), F.col("i.snippet.customUrl").alias("handle"), F.col("i.contentDetails.relatedPlaylists.uploads").alias("uploads_playlist"),
    )


def video_rows(pages: DataFrame) -> DataFrame:
    """Items of API payloads; rows without item or parent id go."""
    x = pages.select(F.explode("items").alias("i")).filter("i.id IS NOT NULL AND i.snippet.channelId IS NOT NULL")
    return x.select(
        F.col("i.id").alias("video_id"), F.col("i.snippet.channelId").alias("channel_id"), F.col("i.snippet.title").alias("title"), instant(F.col("i.snippet.publishedAt")).alias("published_at"), F.col("i.snippet.categoryId").alias("category_id"),
        iso_duration_seconds(F.col("i.contentDetails.duration")).alias("duration_seconds"), _count(F.col("i.statistics.viewCount")).alias("views"), _count(F.col("i.statistics.likeCount")).alias("likes"), _count(F.col("i.statistics.commentCount")).alias("comments"),
        F.col("i.snippet.defaultAudioLanguage").alias("default_audio_language"), F.col("i.snippet.defaultLanguage").alias("default_language"),
    )


def language_rows(pages: DataFrame) -> DataFrame:
    """(video_id, default_audio_language, default_language) of API payloads, for a backfill; items without an id or any language go."""
    x = pages.select(F.explode("items").alias("i")).filter("i.id IS NOT NULL")
    rows = x.select(F.col("i.id").alias("video_id"), F.col("i.snippet.defaultAudioLanguage").alias("default_audio_language"), F.col("i.snippet.defaultLanguage").alias("default_language"))
    return rows.filter(F.coalesce(*LANGUAGES).isNotNull())


def upload_ids(pages: DataFrame) -> DataFrame:
    return pages.select(F.explode("items.contentDetails.videoId").alias("video_id")).filter("video_id IS NOT NULL")


def csv_union(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Rows of CSV files with headers, each once."""
    return spark.read.option("header", True).csv(paths if isinstance(paths, str) else list(paths)).dropDuplicates()


def rules_from(text: str | None) -> list[Rule]:
    """Rules of a JSON text: an object with `rules`, a list, or bare strings; invalid entries go, a malformed text gives none."""
    try:
        data = json.loads(text or "")
    except ValueError:
        return []
    entries = data.get("rules", []) if isinstance(data, dict) else data
    found = []
    for e in entries if isinstance(entries, list) else []:
        try:
            if isinstance(e, str):
                found.append(Rule((e,)))
            else:
                found.append(Rule(tuple(e["terms"]), e.get("scope", "leads"), tuple(e.get("fields", ["title"])), e.get("note") or "", e.get("added")))
        except (KeyError, TypeError, ValueError, AttributeError):
            continue
    return canonical(found)


def read_rules(spark: SparkSession, path: str) -> list[Rule]:
    """Rules of a small JSON file, read by Spark so that any store will do; a missing file gives none."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs_path):
        return []
    row = spark.read.option("wholetext", True).text(path).first()
    return rules_from(row[0] if row else None)
