"""Newest rows, caps by group, and de-duplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .settle import settled, small, unsettle


def require_columns(df: DataFrame, columns: Sequence[str], name: str = "df") -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"{name} lacks {', '.join(missing)}")


def best_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in `order`; null keys are one key."""
    return top_per_key(df, keys, order, 1)


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, drop_null_keys: bool = False) -> DataFrame:
    """The first `n` rows of each key in `order`. Spark cuts groups before the shuffle, so large keys are cheap."""
    rows = df.dropna(subset=list(keys)) if drop_null_keys else df
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_rank") <= n).drop("_rank")


def latest(df: DataFrame, key: str, time: str = "collected_at", tie: str = "id") -> DataFrame:
    """Newest row of each key; equal times go to the greatest `tie`."""
    return best_per_key(df, [key], [F.col(time).desc_nulls_last(), F.col(tie).desc_nulls_last()])


def latest_with_coalesced(df: DataFrame, key: str, attributes: Sequence[str], time: str = "collected_at", tie: str = "id") -> DataFrame:
    """As `latest`, with each attribute the greatest that any row of the key has. One aggregation, no join."""
    rest = [c for c in df.columns if c != key and c not in attributes]
    newest = F.max_by(F.struct(*rest), F.struct(F.col(time), F.col(tie))).alias("_newest")
    found = df.groupBy(key).agg(newest, *[F.max(a).alias(a) for a in attributes])
    return found.select(*[F.col(f"_newest.{c}").alias(c) if c in rest else F.col(c) for c in df.columns])


def collapse_titles(df: DataFrame, signature: str, order: Sequence[Column]) -> DataFrame:
    """First row of each title signature in `order`; rows with an empty signature all stay."""
    blank = F.when(F.coalesce(F.col(signature), F.lit("")) == "", F.monotonically_increasing_id())
    return best_per_key(df.withColumn("_blank", blank), [signature, "_blank"], order).drop("_blank")


def fold_caps(df: DataFrame, order: Sequence[Column], caps: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Greedy selection in `order` over all rows: a row stays unless one of its keys was shown as often as the row's limit for it.

    `caps`: name -> (key, limit); a null key caps nothing. Rows equal in `order` go by their place in the settled input. The rows are decided in rounds on the
    executors. A row whose place among the rows kept or waiting is within the limit for each key stays for certain; one that
    comes after as many kept rows of a key as its limit goes for certain, which a join on the used-up keys finds; the others wait. The first row
    that waits is decided in any round, and most are in a few. A frequent key costs nothing: only its first places are looked at.
    """
    rows = settled(df.withColumn("_id", F.monotonically_increasing_id()))
    place = F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)], F.col("_id").alias("i"))
    held = F.filter(F.array(*[F.struct(F.lit(name).alias("name"), key.cast("string").alias("key"), limit.cast("int").alias("limit")) for name, (key, limit) in caps.items()]), lambda x: x["key"].isNotNull())
    listed = rows.select("_id", place.alias("_at"), held.alias("_held"))
    keyed = ["_id", "_at", "name", "key", "limit", "_keys"]
    waiting = settled(listed.select("_id", "_at", F.size("_held").alias("_keys"), F.explode("_held").alias("_x")).select("_id", "_at", "_x.*", "_keys"))
    most = waiting.agg(F.max("limit")).first()[0] or 0
    kept = settled(waiting.limit(0))
    nth = F.row_number().over(Window.partitionBy("name", "key").orderBy("_at"))
    while not waiting.isEmpty():
        both = kept.select(*keyed, F.lit(True).alias("_in")).unionByName(waiting.select(*keyed, F.lit(False).alias("_in")))
        fits = both.withColumn("_nth", nth).filter(F.col("_nth") <= most).filter((F.col("_nth") <= F.col("limit")) & ~F.col("_in"))
        stay = settled(fits.groupBy("_id", "_keys").agg(F.count("*").alias("_fit")).filter("_fit = _keys").select("_id"))
        before, kept = kept, settled(kept.unionByName(waiting.join(stay, "_id", "left_semi")))
        full = kept.withColumn("_nth", nth).filter(F.col("_nth") <= most).groupBy("name", "key").agg(F.array_sort(F.collect_list("_at")).alias("_shown"))
        later = waiting.join(stay, "_id", "left_anti")
        used = later.join(small(settled(full)), ["name", "key"]).filter((F.col("limit") <= 0) | (F.get("_shown", F.col("limit") - 1) < F.col("_at"))).select("_id")
        decided, waiting = waiting, settled(later.filter("limit > 0").join(used.distinct(), "_id", "left_anti"))
        unsettle(before, decided, stay)
    free = listed.filter(F.size("_held") == 0).select("_id")
    return rows.join(kept.select("_id").distinct().unionByName(free), "_id", "left_semi").drop("_id")


def fold_saturated(df: DataFrame, key: str, order: Column, keys: str, limit: int) -> DataFrame:
    """Greedy selection over all rows, least `order` first: a row goes if it has `keys` and each of them was shown `limit` times.

    `key` is unique (null may be one) and `order`, a struct, has no ties. Rows without keys stay. The first `limit` rows of a key all
    stay, as it can't be used up before them, and after them it is. So a row stays if and only if it is among the first `limit` rows of one of its keys:
    nothing is sequential, and a window finds these rows, of a frequent key too without moving the others.
    """
    rows = settled(df)
    held = rows.select(F.col(key).alias("_key"), order.alias("_at"), F.explode(_held(keys)).alias("_term"))
    first = F.row_number().over(Window.partitionBy("_term").orderBy("_at"))
    stay = held.withColumn("_nth", first).filter(F.col("_nth") <= limit).select("_key").distinct()
    capped = rows.filter(F.size(_held(keys)) > 0).join(stay, F.col(key).eqNullSafe(F.col("_key")), "left_semi")
    return capped.unionByName(rows.filter(F.size(_held(keys)) == 0))


def _held(keys: str) -> Column:
    return F.array_sort(F.array_distinct(F.array_compact(F.coalesce(F.col(keys), F.array().cast("array<string>")))))
