"""Small helpers shared by the operators: shared scratch space, words, checked broadcasts, numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.settle import BROADCAST_ROWS, file_system, fresh_folder, small  # noqa: F401  the operators take `small` from here

#: A word: a run of characters other than space, tab, newline, vertical tab, form feed, carriage return.
BLANKS = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A fresh folder under the session's shared folder; it goes with the scope it is made in, or at the end of the run."""
    return fresh_folder(spark)


def written(df: DataFrame, folder: str, name: str) -> DataFrame:
    """The same rows, written to the shared folder and read again: lineage ends here and lost executors cost nothing."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, folder: str, *names: str) -> None:
    """Removes tables that nothing reads any more; names that aren't there are passed over."""
    for name in names:
        fs, path = file_system(spark, f"{folder}/{name}")
        fs.delete(path, True)


def left_join_spread(rows: DataFrame, right: DataFrame, key: str, most: int = 1000) -> DataFrame:
    """`rows` left-joined with `right`, whose keys are unique. Keys that more than `most` rows share are dealt to so many parts by the place
    of a row in its input, and their row of `right` is repeated for each part, so that no task holds all rows of a key, exact repeats or not.
    Null keys match nothing and are dealt to as many parts as there may be. `rows` come from files, so a task that runs again deals alike."""
    counts = rows.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > most)
    hot = small(written(counts.select(key, F.ceil(F.col("_n") / most).cast("int").alias("_parts")), scratch(rows.sparkSession), "hot"))
    parts = F.coalesce("_parts", F.when(F.col(key).isNull(), F.lit(1 << 20)).otherwise(1))
    placed = rows.withColumn("_place", F.xxhash64(F.monotonically_increasing_id()))
    left = placed.join(hot, key, "left").withColumn("_part", F.pmod("_place", parts).cast("int")).drop("_parts", "_place")
    repeated = right.join(hot, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return left.join(repeated, [key, "_part"], "left").drop("_part")


def left_join_any(rows: DataFrame, right: DataFrame, key: str, most: int = BROADCAST_ROWS) -> DataFrame:
    """`rows` left-joined with `right`, whose keys are unique: broadcast if it is small, else with hot keys spread. `right` is cheap to count."""
    if right.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(right), key, "left")
    return left_join_spread(rows, right, key)


def hash_sample(df: DataFrame, rows: int, total: int, *key: str, salt: int = 0) -> DataFrame:
    """About `rows` of the `total` rows of `df`: those whose key hashes below a share, so that nothing is sorted or collected
    and all data are drawn from alike. All rows if there are no more."""
    if total <= rows:
        return df
    return df.filter(F.pmod(F.xxhash64(*key, F.lit(salt)), F.lit(1 << 31)) < int(rows / total * (1 << 31)))


def words(text: Column) -> Column:
    """The words of a text in order; none for null."""
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x09-\\x0D]+", " ")
    return F.filter(F.split(spaced, " ", -1), lambda w: w != "")  # a split at one character needs no pattern


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_key(text: Column) -> Column:
    """Content address of a text; null counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def text_id(text: Column) -> Column:
    """128-bit address of a text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def utf8_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def unsigned_crc32(text: Column) -> Column:
    """crc32 of the UTF-8 bytes, 0 for null."""
    return F.coalesce(F.crc32(F.encode(text, "UTF-8")), F.lit(0)).cast("long")


def number_within(df: DataFrame, group: str, out: str, rows_per_task: int = 20_000) -> DataFrame:
    """Adds `out`: 0, 1, 2, ... without gaps within each `group`, even where a group holds most rows.

    Rows are written and dealt by their place there, `rows_per_task` at most together, exact repeats or not; each part numbers its
    own rows and starts after those of the parts before it. Only (group, part) counts are brought together.
    """
    dealt = written(df.withColumn("_at", F.monotonically_increasing_id()), scratch(df.sparkSession), "numbered").withColumn("_b", F.floor(F.col("_at") / rows_per_task))
    sizes = dealt.groupBy(group, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select(group, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    ranked = dealt.withColumn("_k", F.row_number().over(Window.partitionBy(group, "_b").orderBy("_at")) - 1)
    joined = ranked.join(first, [ranked[group].eqNullSafe(first[group]), ranked["_b"] == first["_b"]], "inner").drop(first[group]).drop(first["_b"])
    return joined.withColumn(out, (F.col("_first") + F.col("_k")).cast("long")).drop("_at", "_b", "_k", "_first")
