"""Writers: idempotent appends, upserts, backfills, exports and staged frames."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import content_digest, relative_age_to_time
from ..operators.latest import best_per_key
from ..operators.metrics import recent
from ..operators.reports import fingerprint
from ..operators.rules import Rule, canonical

LANGUAGES = ("default_audio_language", "default_language")
OUTCOMES = ("success", "failed", "skipped")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def unknown_digests(fresh: DataFrame, columns: Sequence[str], known: DataFrame | None, extra: dict[str, Column] | None = None) -> DataFrame:
    """Rows of `fresh` with their digest, each content once and none that `known` (digest) has."""
    keyed = fresh.withColumns(extra or {}).withColumn("digest", content_digest([*columns, *(extra or {})])).drop(*(extra or {})).dropDuplicates(["digest"])
    return keyed if known is None else keyed.join(known.select("digest"), "digest", "left_anti")


def append_new(fresh: DataFrame, path: str, columns: Sequence[str], extra: dict[str, Column] | None = None) -> None:
    """Appends contents that the table at `path` doesn't have."""
    spark = fresh.sparkSession
    known = spark.read.parquet(path) if exists(spark, path) else None
    unknown_digests(fresh, columns, known, extra).write.mode("append").parquet(path)


def append_daily(fresh: DataFrame, path: str, columns: Sequence[str], time: str = "collected_at") -> None:
    """As `append_new`, with equal contents once a day; languages don't count as content. The table is kept by day, and only the days of
    `fresh` are read."""
    spark, day = fresh.sparkSession, F.to_date(F.col(time))
    kept = [c for c in columns if c not in (*LANGUAGES, time)]
    known = None
    if exists(spark, path):
        days = [r[0] for r in fresh.select(day.alias("_day")).distinct().collect()]
        known = spark.read.parquet(path).filter(F.col("_day").isin(days))
    unknown_digests(fresh, kept, known, {"_day": day}).withColumn("_day", day).write.mode("append").partitionBy("_day").parquet(path)


def feed_rows(records: DataFrame, observed: str = "observed_at", age: str = "age_text") -> DataFrame:
    """Feed records with the publish time that their age text tells."""
    return records.withColumn("published_at", relative_age_to_time(F.col(age), F.col(observed)))


def feed_table(records: DataFrame, now: datetime | str, columns: Sequence[str], days: float = 14, known: DataFrame | None = None) -> DataFrame:
    """Feed records as they are stored: with the publish time that their age text tells, within the retention, each content of `columns` once and none that
    `known` (digest) has; of equal contents the one seen last stays. Unknown times go."""
    rows = retained(feed_rows(records), now, days).withColumn("digest", content_digest(list(columns)))
    once = best_per_key(rows, ["digest"], [F.desc_nulls_last("observed_at"), F.desc_nulls_last("published_at")])
    return once if known is None else once.join(known.select("digest").distinct(), "digest", "left_anti")


def retained(feed: DataFrame, now: datetime | str, days: float = 14) -> DataFrame:
    return recent(feed, "observed_at", now, days, keep_unknown=False)


def write_labels(labels: DataFrame, path: str) -> None:
    """Writes labels by classifier version; versions in `labels` are replaced, others stay."""
    labels.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("classifier_version").parquet(path)


def append_valid(rows: DataFrame, path: str, column: str, allowed: Sequence[str]) -> None:
    """Appends log rows; a value that isn't allowed fails the whole write before it begins."""
    bad = rows.filter(~F.coalesce(F.col(column).isin(list(allowed)), F.lit(False)))
    if not bad.isEmpty():
        raise ValueError(f"{column} must be one of {', '.join(allowed)}")
    rows.write.mode("append").parquet(path)


def append_evidence(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def upserted(old: DataFrame | None, fresh: DataFrame, key: str, verdict: str, time: str = "checked_at") -> DataFrame:
    """The newest verdict of each key. Unknown verdicts are refused."""
    if not fresh.filter(F.col(verdict).isNull()).isEmpty():
        raise ValueError(f"{verdict} must be known")
    both = fresh.withColumn("_new", F.lit(1)) if old is None else fresh.withColumn("_new", F.lit(1)).unionByName(old.withColumn("_new", F.lit(0)))
    return best_per_key(both, [key], [F.desc(time), F.desc("_new")]).drop("_new")


def backfilled(snapshots: DataFrame, updates: DataFrame, key: str = "video_id", columns: Sequence[str] = LANGUAGES) -> DataFrame:
    """Snapshots with missing values of `columns` filled from `updates`; what is there stays."""
    u = updates.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    return snapshots.join(u, key, "left").withColumns({c: F.coalesce(c, f"_{c}") for c in columns}).select(*snapshots.columns)


def export_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).csv(path)


def export_bands(df: DataFrame, path: str, band: Column, metric: str) -> None:
    """CSV files by size band, each sorted by `metric`, highest first."""
    df.withColumn("band", band).repartition("band").sortWithinPartitions("band", F.desc_nulls_last(metric)).write.mode("overwrite").option("header", True).partitionBy("band").csv(path)


def write_lexicon(markers: DataFrame, path: str) -> None:
    markers.select("token").distinct().orderBy("token").write.mode("overwrite").text(path)


def save_rules(spark: SparkSession, rules: Sequence[Rule], path: str) -> None:
    """Rules as one JSON document, read back by `read_rules`."""
    data = {"rules": [{"terms": list(r.terms), "scope": r.scope, "fields": list(r.fields), "note": r.note, "added": r.added} for r in canonical(rules)]}
    spark.createDataFrame([(json.dumps(data),)], "value string").coalesce(1).write.mode("overwrite").text(path)


class Stages:
    """Named frames kept as Parquet and reused while the tables they come from have the same numbers of rows and greatest ids."""

    def __init__(self, spark: SparkSession, folder: str, tables: dict[str, tuple[DataFrame, str]] | None = None) -> None:
        self.spark = spark
        mark = "fixed"
        if tables:
            row = fingerprint(tables).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "table", "rows", "max_id"))), ","), 256)).first()
            mark = row[0][:16]
        self.folder = f"{folder.rstrip('/')}/{mark}"

    def frame(self, key: str, compute: Callable[[], DataFrame], refresh: bool = False) -> DataFrame:
        path = f"{self.folder}/{key}"
        if refresh or not exists(self.spark, f"{path}/_SUCCESS"):
            compute().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def __call__(self, key: str, df: DataFrame) -> DataFrame:
        return self.frame(key, lambda: df)
