"""Rank and order statistics that hold when a few peer classes, or a few values, hold most rows.

`positions` is the base: for every row, how many values of its group are less, equal, and known. Where a group is above `TASK_VALUES` rows, Spark deals
all rows by ranges of group, value and place; each range ranks its own rows, and the ranges' totals are the offsets. A value that reaches
over several ranges stands at the ends of their parts, which one small table compares, so neither a large class nor a frequent value is one task's
work, and a row costs the same however many ranges there are. Only a row's number, its groups and one value are dealt; wide rows stay where they are and
meet their ranks by number.

Quantiles of large groups rank nothing: a sketch of each group brackets every wanted place, one aggregation counts the rows between the brackets and each
value within, and the counts tell the value that stands there. Rows aren't shuffled, only counts.

Where each of a few groups is compared with all others (`robust_zs`), a row is binned once. The counts of a group's bins, and what is left of all
without them, tell the few bins that may hold a wanted value or distance, and only their rows are looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import safe_ratio
from .settle import alone, settled, small

#: Values, about, that one task orders.
TASK_VALUES = 200_000
#: Wide rows, about, of one task that joins or sorts them.
TASK_ROWS = 50_000
#: Ranges, at most.
MOST_RANGES = 10_000
#: Rows times groups, or groups of one kind of value, up to which every group's others are simply listed; beyond, rank subtraction finds their statistics.
DIRECT_PAIRS, DIRECT_GROUPS = 10_000_000, 16
#: Accuracy of the sketches: a rank is off by a SKETCH-th of the group's rows at most.
SKETCH = 10_000
#: Buckets of positions that narrow down the median distance of all other groups.
BUCKETS = 1024
#: Bins of about as many rows each of a whole table's values.
BINS = 2048
#: A row's number in a settled table.
ROW = "_row_id"


def histogram(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """(groups, v, c) of the values that aren't null."""
    return settled(df.filter(F.col(value).isNotNull()).groupBy(*groups, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c")))


def cumulative(hist: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Adds `before` (rows of the group with a lesser value) and `n` (rows of the group) to a settled histogram."""
    ranges = -(-hist.count() // TASK_VALUES)
    if ranges <= 1:
        whole = Window.partitionBy(*groups)
        before = F.sum("c").over(whole.orderBy("v").rowsBetween(Window.unboundedPreceding, -1))
        return hist.withColumns({"before": F.coalesce(before, F.lit(0)), "n": F.sum("c").over(whole)})
    dealt = settled(hist.repartitionByRange(ranges, *groups, "v").withColumn("_b", F.spark_partition_id()))
    totals = dealt.groupBy(*groups, "_b").agg(F.sum("c").alias("_t"))
    offset = totals.withColumns({
        "_first": F.coalesce(F.sum("_t").over(Window.partitionBy(*groups).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "n": F.sum("_t").over(Window.partitionBy(*groups)),
    }).drop("_t")
    inside = Window.partitionBy(*groups, "_b").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = dealt.withColumn("_in", F.coalesce(F.sum("c").over(inside), F.lit(0)))
    return _null_safe_join(ranked, offset, [*groups, "_b"], "inner").withColumn("before", F.col("_first") + F.col("_in")).drop("_b", "_first", "_in")


def _null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join on equal keys, null being equal to null; the keys of `left` stay."""
    if not keys:
        return left.crossJoin(F.broadcast(right))  # one row
    r = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(small(r), on, how).drop(*[f"_r_{k}" for k in keys])


def _within(rows: DataFrame, keys: Sequence[str], value: str, out: Sequence[str]) -> DataFrame:
    """`positions` by windows: one shuffle by the keys and one sort, nulls first."""
    whole = Window.partitionBy(*keys)
    known, nulls = F.col(value).isNotNull(), F.count(F.lit(1)).over(whole) - F.count(value).over(whole)
    made = [F.rank().over(whole.orderBy(value)) - 1 - nulls, F.count(F.lit(1)).over(Window.partitionBy(*keys, value)), F.count(value).over(whole)]
    return rows.withColumns({name: F.when(known, c).cast("long") for name, c in zip(out, made, strict=True)})


def in_tasks(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """`df`, which has `rows` rows, by the keys in as many tasks as keep each one small; few rows are left to Spark."""
    return df.repartition(-(-rows // TASK_ROWS), *keys) if keys and rows > TASK_VALUES else df


def _heavy(known: DataFrame, groups: Sequence[str]) -> DataFrame:
    """(groups, _n) of the groups with more than TASK_VALUES rows."""
    return settled(known.groupBy(*groups).agg(F.count("*").alias("_n")).filter(F.col("_n") > TASK_VALUES))


def positions(rows: DataFrame, groups: Sequence[str], value: str, out: Sequence[str] = ("before", "c", "n"), total: int | None = None) -> DataFrame:
    """Adds how many rows of the group have a lesser value, this value, and any value; null where the value is null.

    `value` is a double; null is a group of its own. `rows` is settled or cheap to read; `total`, its number of rows, spares a count.
    """
    total = rows.count() if total is None else total
    if total <= TASK_VALUES:
        return _within(rows, groups, value, out)
    known = rows.filter(F.col(value).isNotNull()).select(*groups)
    if _heavy(known, groups).isEmpty():
        return _within(in_tasks(rows, total, *groups), groups, value, out)
    ranges = min(MOST_RANGES, -(-total // TASK_VALUES))
    # Rows of one value, or of none, are told apart by their place, so that they fill as many ranges as they need.
    turned = rows.withColumn("_turn", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(ranges, *groups, value, "_turn").drop("_turn")
    dealt = turned.withColumn("_part", F.spark_partition_id()).repartitionById(ranges, F.col("_part"))
    ranked = settled(_within(dealt, [*groups, "_part"], value, ("_b", "_c", "_m")))
    offsets = settled(_offsets(ranked, groups, value))
    joined = _null_safe_join(ranked, offsets, [*groups, "_part"], "left")
    earlier = F.when(F.col(value) == F.col("_lo"), F.col("_earlier")).otherwise(0)
    later = F.when(F.col(value) == F.col("_hi"), F.col("_later")).otherwise(0)
    made = [F.col("_first") + F.col("_b") - earlier, F.col("_c") + earlier + later, F.col("_n")]
    done = joined.withColumns({name: F.when(F.col(value).isNotNull(), c).cast("long") for name, c in zip(out, made, strict=True)})
    return done.select(*rows.columns, *out)


def _offsets(ranked: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """For each group's part of a range: its ends, how many of the group's rows come in ranges before, how many of these hold its least value, how many
    rows in later ranges hold its greatest, and the group's rows. Only the ends of a part can reach into other ranges."""
    ends = ranked.filter(F.col(value).isNotNull()).groupBy(*groups, "_part").agg(  # of numbers alone, so that nothing is sorted
        F.count("*").alias("_t"), F.min(value).alias("_lo"), F.min_by("_c", value).alias("_clo"), F.max(value).alias("_hi"), F.max_by("_c", value).alias("_chi"),
    )
    marks = ends.select(*groups, "_part", "_t", F.explode(F.array_distinct(F.array(*[F.struct(F.col(f"_{end}").alias("_v"), F.col(f"_c{end}").alias("_c")) for end in ("lo", "hi")]))).alias("_x")).select(*groups, "_part", "_t", "_x.*")
    same = Window.partitionBy(*groups, "_v").orderBy("_part")
    marks = marks.withColumns({
        "_before": F.coalesce(F.sum("_c").over(same.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "_after": F.coalesce(F.sum("_c").over(same.rowsBetween(1, Window.unboundedFollowing)), F.lit(0)),
    })
    parts = marks.groupBy(*groups, "_part").agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.max("_t").alias("_t"), F.min_by("_before", "_v").alias("_earlier"), F.max_by("_after", "_v").alias("_later"))
    first = F.sum("_t").over(Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    return parts.withColumns({"_first": F.coalesce(first, F.lit(0)), "_n": F.sum("_t").over(Window.partitionBy(*groups))}).drop("_t")


def stacked(df: DataFrame, keep: Sequence[str], values: dict[str, str]) -> DataFrame:
    """(keep, _what, v): a row for each named value column that isn't null."""
    each = F.array(*[F.struct(F.lit(name).alias("_what"), F.col(value).cast("double").alias("v")) for value, name in values.items()])
    return df.select(*keep, F.explode(each).alias("_x")).select(*keep, "_x._what", "_x.v").filter("v IS NOT NULL")


def average_rank_pct(df: DataFrame, groups: Sequence[str], values: dict[str, str]) -> DataFrame:
    """Adds, for each value column, the named output: the mean rank of equal values over the number of values in the group. Null stays null.

    `df` is settled or cheap to read.
    """
    return average_rank_pcts(df, [(value, groups, name) for value, name in values.items()])


def average_rank_pcts(df: DataFrame, wanted: Sequence[tuple[str, Sequence[str], str]]) -> DataFrame:
    """As `average_rank_pct` for several (value, groups, output)."""
    return _with_ranks(df, wanted, _average_rank)


def average_rank_tables(rows: DataFrame, wanted: Sequence[tuple[str, Sequence[str], str]]) -> list[DataFrame]:
    """As `average_rank_pcts` of `numbered` rows, as a settled table (ROW, output) for each of `wanted`; rows whose value is null are left out."""
    return _rank_tables(rows, wanted, _average_rank, rows.count())


def _average_rank() -> Column:
    return (F.col("_before") + (F.col("_c") + 1) / 2) / F.col("_n")


def numbered(df: DataFrame) -> DataFrame:
    """`df` from a settled table with ROW, by which narrow tables about its rows find back to them. A frame that has it is taken as it is."""
    return df if ROW in df.columns else settled(with_number(df))


def with_number(df: DataFrame) -> DataFrame:
    """`df` with ROW; it has to be settled before it is read twice."""
    return df.withColumn(ROW, F.monotonically_increasing_id())


def _rank_tables(rows: DataFrame, wanted: Sequence[tuple[str, Sequence[str], str]], rank: Callable[[], Column], total: int) -> list[DataFrame]:
    """One ranking after the other, each of a number, the groups and one value: what a ranking shuffles and settles goes before the next begins."""
    names = ("_before", "_c", "_n")

    def one(value: str, groups: Sequence[str], name: str) -> DataFrame:
        known = rows.select(ROW, *groups, F.col(value).cast("double").alias("_v")).filter("_v IS NOT NULL")
        return positions(known, groups, "_v", names, total).select(ROW, rank().alias(name))

    return [alone(rows.sparkSession, lambda each=each: one(*each)) for each in wanted]


def _with_ranks(df: DataFrame, wanted: Sequence[tuple[str, Sequence[str], str]], rank: Callable[[], Column]) -> DataFrame:
    names = ("_before", "_c", "_n")
    rows = df.count()
    outputs = [name for *_, name in wanted]
    if rows <= TASK_VALUES and len({tuple(groups) for _, groups, _ in wanted}) == 1:  # in place: one shuffle by group, a sort for each value
        out = df
        for value, groups, name in wanted:
            out = _within(out.withColumn("_v", F.col(value).cast("double")), groups, "_v", names).withColumn(name, rank()).drop("_v", *names)
        return out.select(*df.columns, *outputs)
    kept = numbered(df)
    out = in_tasks(kept, rows, ROW)
    for ranks in _rank_tables(kept, wanted, rank, rows):
        out = out.join(in_tasks(ranks, rows, ROW).hint("shuffle_hash"), ROW, "left")
    return out.select(*df.columns, *outputs)


def max_rank_pct(df: DataFrame, groups: Sequence[str], value: str, out: str) -> DataFrame:
    """Adds `out`: the share of the group's values that are at most this one (the greatest rank of equal values). Null stays null."""
    return _with_ranks(df, [(value, groups, out)], lambda: (F.col("_before") + F.col("_c")) / F.col("_n"))


def min_max(df: DataFrame, value: str, out: str) -> DataFrame:
    """Adds `out`: the value from 0 to 1 between least and greatest; 1 if all are equal, 0 for null."""
    bounds = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    scaled = F.when(F.col(value).isNull(), 0.0).when(F.col("_hi") == F.col("_lo"), 1.0).otherwise((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    return df.crossJoin(F.broadcast(bounds)).withColumn(out, scaled).drop("_lo", "_hi")


def picked(placed: DataFrame, groups: Sequence[str], at: dict[str, Column], value: str = "v", more: Sequence[Column] = (), names: Sequence[str] = ("before", "c", "n")) -> DataFrame:
    """(groups, n, the named order statistics, `more`) of rows with positions; `at` are indices from 0, in terms of n."""
    before, c, n = names
    wanted = [F.min(F.when(F.col(before) + F.col(c) > k, F.col(value))).alias(name) for name, k in at.items()]
    return placed.groupBy(*groups, n).agg(*wanted, *more)


def _ends(wanted: dict[str, float], n: Column) -> dict[str, Column]:
    """The indices on either side of each quantile."""
    return {f"_{end}_{name}": (F.floor if end == "lo" else F.ceil)((n - 1) * F.lit(q)) for name, q in wanted.items() for end in ("lo", "hi")}


def _between(name: str, q: float, n: Column) -> Column:
    at, lo, hi = (n - 1) * F.lit(q), F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
    return lo + (hi - lo) * (at - F.floor(at))


def quantiles(rows: DataFrame, groups: Sequence[str], value: str, wanted: dict[str, float], count: str = "n", sizes: DataFrame | None = None) -> DataFrame:
    """(groups, count, the named quantiles, interpolated) of the values that aren't null. `rows` is settled or cheap to read; settled `sizes` (groups, _n),
    if they are known, spare counts."""
    known = rows.filter(F.col(value).isNotNull()).select(*groups, F.col(value).cast("double").alias("_v"))
    total = known.count() if sizes is None else sizes.agg(F.sum("_n")).first()[0] or 0
    if total <= TASK_VALUES:
        return _of_whole_groups(known, groups, wanted, count)
    heavy = _heavy(known, groups) if sizes is None else settled(sizes.filter(F.col("_n") > TASK_VALUES))
    in_heavy = heavy.agg(F.sum("_n")).first()[0] or 0
    if not in_heavy:
        return _of_whole_groups(known, groups, wanted, count)
    if in_heavy == total:
        return _between_brackets(known, groups, wanted, count)
    heavy = heavy.select(*groups)
    light = _of_whole_groups(_null_safe_join(known, heavy, groups, "left_anti"), groups, wanted, count)
    return light.unionByName(_between_brackets(_null_safe_join(known, heavy, groups, "left_semi"), groups, wanted, count))


def _of_whole_groups(known: DataFrame, groups: Sequence[str], wanted: dict[str, float], count: str) -> DataFrame:
    """`quantiles` where a task may hold any whole group."""
    found = known.groupBy(*groups).agg(F.count("*").alias(count), F.percentile("_v", list(wanted.values())).alias("_q"))
    return found.filter(F.col(count) > 0).select(*groups, count, *[F.get("_q", F.lit(k)).alias(name) for k, name in enumerate(wanted)])


def _between_brackets(known: DataFrame, groups: Sequence[str], wanted: dict[str, float], count: str) -> DataFrame:
    """`quantiles` of groups of more than TASK_VALUES rows, exact. A place that its bracket misses, which the counts tell, has its group ranked."""
    apart = 2 / SKETCH + 2 / TASK_VALUES
    shares = [min(1.0, max(0.0, q + d)) for q in sorted(set(wanted.values())) for d in (-apart, apart)]
    marks = settled(known.groupBy(*groups).agg(F.percentile_approx("_v", shares, SKETCH).alias("_marks")))
    low, high = ([F.get("_marks", F.lit(k)) for k in range(first, len(shares), 2)] for first in (0, 1))
    inside, passed = F.lit(False), F.lit(0)
    for a, z in zip(low, high, strict=True):
        inside, passed = inside | F.col("_v").between(a, z), passed + (F.col("_v") > z).cast("int")
    # Rows outside of brackets are one count after the bracket that they follow.
    at = F.when(inside, F.col("_v")).otherwise(F.get("_marks", 2 * passed - 1))
    counts = settled(_null_safe_join(known, marks, groups, "inner").groupBy(*groups, at.alias("_at"), (~inside).alias("_out")).agg(F.count("*").alias("_c")))
    whole = Window.partitionBy(*groups)
    before = F.sum("_c").over(whole.orderBy("_at", "_out").rowsBetween(Window.unboundedPreceding, -1))
    placed = counts.withColumns({"_before": F.coalesce(before, F.lit(0)), "_n": F.sum("_c").over(whole)})

    def stands(k: Column) -> Column:
        return ~F.col("_out") & (F.col("_before") <= k) & (F.col("_before") + F.col("_c") > k)

    ends = _ends(wanted, F.col("_n"))
    found = settled(placed.groupBy(*groups, "_n").agg(*[F.max(F.when(stands(k), F.col("_at"))).alias(name) for name, k in ends.items()]))
    missed = F.greatest(*[F.col(name).isNull() for name in ends], F.lit(False))
    again = found.filter(missed)
    if not again.isEmpty():
        rows = _null_safe_join(known, again.select(*groups), groups, "left_semi") if groups else known
        ranked = picked(positions(settled(rows), groups, "_v", ("_before", "_c", "_n")), groups, ends, "_v", names=("_before", "_c", "_n"))
        found = found.filter(~missed).unionByName(ranked)
    return found.select(*groups, F.col("_n").alias(count), *[_between(name, q, F.col("_n")).alias(name) for name, q in wanted.items()])


def leave_one_out(df: DataFrame, group: str, value: str, quantiles: dict[str, float], count: str) -> DataFrame:
    """Adds, for each name, that quantile of the other values of the row's group, interpolated, and `count`, the number of others.

    A row's own value leaves its group's order statistics as they are below it and shifts those above it by one, so
    four statistics of a group give the quantile for all its rows. Rows without value or without others have null.
    """
    known = df.filter(F.col(group).isNotNull() & F.col(value).isNotNull()).select(group, F.col(value).cast("double").alias("v"))
    at = {}
    for name, q in quantiles.items():
        k = (F.col("n") - 2) * F.lit(q)
        at |= {f"_{name}_lo": F.floor(k), f"_{name}_lo1": F.floor(k) + 1, f"_{name}_hi": F.ceil(k), f"_{name}_hi1": F.ceil(k) + 1}
    stats = picked(positions(known, [group], "v").filter("n >= 2"), [group], at).withColumnRenamed("n", "_n")
    out = df.join(stats, group, "left")
    for name, q in quantiles.items():
        def pick(tag: str, name: str = name) -> Column:
            return F.when(F.col(value) <= F.col(f"_{name}_{tag}"), F.col(f"_{name}_{tag}1")).otherwise(F.col(f"_{name}_{tag}"))
        k = (F.col("_n") - 2) * F.lit(q)
        out = out.withColumn(name, F.when(F.col(value).isNotNull(), pick("lo") + (pick("hi") - pick("lo")) * (k - F.floor(k))))
    others = F.coalesce(F.when(F.col(value).isNotNull(), F.col("_n") - 1), F.lit(0)).cast("long")
    return out.withColumn(count, others).drop("_n", *[f"_{name}_{tag}" for name in quantiles for tag in ("lo", "lo1", "hi", "hi1")])


def baselines(df: DataFrame, group: str, value: str, least: int) -> DataFrame:
    """Adds <value>_median, <value>_p90 and <value>_count of the row's group; medians are null below `least` values."""
    rows = df.count()
    if rows <= TASK_VALUES:  # few enough for a task to hold a whole group: no join back
        whole = Window.partitionBy(group)
        found = df.withColumns({"_n": F.count(value).over(whole), "_x": F.percentile(value, [0.5, 0.9]).over(whole)})
        joined = found.withColumns({"_m": F.get("_x", F.lit(0)), "_p": F.get("_x", F.lit(1))}).drop("_x")
    else:
        found = quantiles(df.filter(F.col(group).isNotNull()), [group], value, {"_m": 0.5, "_p": 0.9}, "_n")
        joined = in_tasks(df, rows, group).join(in_tasks(found, rows, group), group, "left")  # both: else Spark takes the groups' few tasks
    enough, count = F.col(group).isNotNull() & (F.col("_n") >= least), F.when(F.col(group).isNotNull(), F.coalesce("_n", F.lit(0)))
    return joined.withColumns({f"{value}_count": count, f"{value}_median": F.when(enough, F.col("_m")), f"{value}_p90": F.when(enough, F.col("_p"))}).drop("_n", "_m", "_p")


def medians(df: DataFrame, groups: Sequence[str], values: dict[str, str]) -> DataFrame:
    """(groups, the named medians) of the value columns, ranked together; a group without any value has no row."""
    long = settled(stacked(df, groups, values))
    found = quantiles(long, ["_what", *groups], "v", {"_q": 0.5})
    return settled(found.groupBy(*groups).agg(*[F.max(F.when(F.col("_what") == name, F.col("_q"))).alias(name) for name in values.values()]))


def median_mad(df: DataFrame, groups: Sequence[str], value: str, scale: float = 1.0) -> DataFrame:
    """(groups, n, median, mad) of the values that aren't null; mad is `scale` times the median distance from the median."""
    rows = settled(df.filter(F.col(value).isNotNull()).select(*groups, F.col(value).cast("double").alias("v")))
    middle = settled(quantiles(rows, groups, "v", {"median": 0.5}))
    apart = _null_safe_join(rows, middle.drop("n"), groups, "inner").withColumn("v", F.abs(F.col("v") - F.col("median")))
    spread = quantiles(apart, groups, "v", {"_mad": 0.5}).select(*groups, (F.col("_mad") * F.lit(scale)).alias("mad"))
    return _null_safe_join(middle, settled(spread), groups, "inner")


def at_positions(values: DataFrame, keys: Sequence[str], queries: DataFrame) -> DataFrame:
    """(keys, p, v) for queries (keys, p): the value that stands at position `p` from 0 when all values of the keys are sorted.

    `values`: keys, v, before, c; repeats are alike. Positions are cut into stretches; a value goes to each stretch that it reaches, and a query
    takes the last value that begins at or before it.
    """
    once = values.groupBy(*keys, "v").agg(F.first("before").alias("before"), F.first("c").alias("c"))
    first, last = F.floor(F.col("before") / TASK_VALUES), F.floor((F.col("before") + F.col("c") - 1) / TASK_VALUES)
    begun = once.select(*keys, F.explode(F.sequence(first, last)).alias("_s"), F.col("before").alias("p"), "v", F.lit(0).alias("_q"))
    asked = queries.select(*keys, "p").distinct().select(*keys, F.floor(F.col("p") / TASK_VALUES).alias("_s"), "p", F.lit(None).cast("double").alias("v"), F.lit(1).alias("_q"))
    order = Window.partitionBy(*keys, "_s").orderBy("p", "_q").rowsBetween(Window.unboundedPreceding, 0)
    return begun.unionByName(asked).withColumn("v", F.last("v", ignorenulls=True).over(order)).filter("_q = 1").select(*keys, "p", "v")


def _rest_at(base_all: Column, base_own: Column, before_all: str, before_own: str, c_own: str, k: str) -> Column:
    """The position, among the values of all groups, of the `k`-th value of the others: k and as many of the group's own as come before it.
    An own value comes before it if at most `k` others are less."""
    others = base_all + F.col(before_all) - base_own - F.col(before_own)
    return F.col(k) + F.greatest(base_own, F.coalesce(F.max(F.when(others <= F.col(k), base_own + F.col(before_own) + F.col(c_own))), F.lit(0)))


def _looked_up(asked: DataFrame, values: DataFrame, keys: list[str], out: str) -> DataFrame:
    """`asked` (keys, _plo, _phi, _k) with `out`, interpolated between the values at both positions."""
    queries = asked.select(*keys, F.explode(F.array("_plo", "_phi")).alias("p"))
    found = settled(at_positions(values, keys, queries))
    for end in ("lo", "hi"):
        one = found.select(*keys, F.col("p").alias(f"_p{end}"), F.col("v").alias(f"_v{end}"))
        asked = asked.join(small(one), [*keys, f"_p{end}"], "left")
    return asked.withColumn(out, F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * (F.col("_k") - F.floor("_k"))).drop("_plo", "_phi", "_vlo", "_vhi")


def rest_median_mad(placed: DataFrame, group: str) -> DataFrame:
    """(_what, group, rest_median, rest_mad) over the values of all other groups, in space and time linear in rows and groups.

    `placed`: settled rows (_what, group, v) with positions in their group (_bg, _cg, _ng) and among all (_ba, _ca, _na). Both statistics come by rank
    subtraction. For distances from a group's median of the others, which few groups have apart, only buckets of values are ranked that may hold the wanted
    one: what lies nearer for certain is counted, what lies further is left out.
    """
    keys = ["_what", group]
    sized = placed.filter(F.col(group).isNotNull()).withColumn("_k", (F.col("_na") - F.col("_ng") - 1) / 2).withColumns({"_klo": F.floor("_k"), "_khi": F.ceil("_k")})
    zero = F.lit(0).cast("long")
    ends = {f"_p{end}": _rest_at(zero, zero, "_ba", "_bg", "_cg", f"_k{end}") for end in ("lo", "hi")}
    asked = sized.filter(F.col("_na") > F.col("_ng")).groupBy(*keys, "_ng", "_k", "_klo", "_khi").agg(*[c.alias(name) for name, c in ends.items()])
    middle = _looked_up(settled(asked), placed.select("_what", "v", F.col("_ba").alias("before"), F.col("_ca").alias("c")), ["_what"], "rest_median")
    middle = settled(middle)
    bucketed = placed.withColumn("_bucket", F.floor(F.col("_ba") * BUCKETS / F.col("_na")).cast("int"))
    edges = bucketed.groupBy("_what", "_bucket").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("c"))
    # At most BUCKETS structs for each kind of value.
    edges = edges.groupBy("_what").agg(F.array_sort(F.collect_list(F.struct("_bucket", "lo", "hi", "c"))).alias("_edges"))
    centers = middle.groupBy("_what", "rest_median").agg(F.min("_klo").alias("_kmin"), F.max(F.col("_khi") + F.col("_ng")).alias("_kmax"))
    narrowed = settled(centers.join(F.broadcast(edges), "_what").mapInPandas(_narrow, _NARROWED))
    near = narrowed.select("_what", "rest_median", F.explode("_buckets").alias("_bucket"))
    apart = settled(bucketed.select("_what", "_bucket", group, "v").join(small(near), ["_what", "_bucket"]).select("_what", "rest_median", group, F.abs(F.col("v") - F.col("rest_median")).alias("v")))
    ranked = settled(positions(apart, ["_what", "rest_median"], "v", ("before", "c", "n")))
    own_center = middle.select(*keys, "rest_median", "_k", "_klo", "_khi").join(small(narrowed.drop("_buckets")), ["_what", "rest_median"])
    own_center = settled(own_center)
    inner = F.col("_bucket").between(F.col("_in_lo"), F.col("_in_hi"))
    counted = bucketed.select(*keys, "_bucket").join(small(own_center.select(*keys, "_in_lo", "_in_hi")), keys).groupBy(*keys).agg(F.count_if(inner).alias("_own"))
    own_center = settled(own_center.join(small(settled(counted)), keys))
    own = ranked.join(small(own_center.select(*keys, "rest_median")), [*keys, "rest_median"]).select(*keys, "v", "before")
    own = positions(settled(own), keys, "v", ("_bo", "_co", "_no"))
    joined = own_center.join(own, keys, "left")
    ends = {f"_p{end}": _rest_at(F.col("_base"), F.col("_own"), "before", "_bo", "_co", f"_k{end}") for end in ("lo", "hi")}
    asked = joined.groupBy(*keys, "rest_median", "_k", "_klo", "_khi", "_base", "_own").agg(*[c.alias(name) for name, c in ends.items()])
    based = ranked.join(small(narrowed.select("_what", "rest_median", "_base")), ["_what", "rest_median"]).select("_what", "rest_median", "v", (F.col("before") + F.col("_base")).alias("before"), "c")
    return _looked_up(settled(asked), based, ["_what", "rest_median"], "rest_mad").select(*keys, "rest_median", "rest_mad")


_NARROWED = "_what string, rest_median double, _in_lo int, _in_hi int, _base long, _buckets array<int>"


def _narrow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For centres with the edges of the buckets of all values: the buckets that hold only distances below the least wanted one and how many rows these
    have, and the others that may hold a wanted one."""
    for batch in batches:
        out = []
        for what, m, kmin, kmax, edges in batch[["_what", "rest_median", "_kmin", "_kmax", "_edges"]].itertuples(index=False):
            number, lo, hi, c = (np.array([e[k] for e in edges]) for k in ("_bucket", "lo", "hi", "c"))
            sums = np.concatenate([[0], np.cumsum(c)])
            d = np.unique(np.abs(np.concatenate([lo, hi]) - m))
            meets = np.searchsorted(hi, m - d, "left"), np.searchsorted(lo, m + d, "right")
            holds = np.searchsorted(lo, m - d, "left"), np.searchsorted(hi, m + d, "right")
            below = np.flatnonzero(sums[meets[1]] - sums[meets[0]] <= kmin)
            above = np.flatnonzero(sums[np.maximum(holds[1], holds[0])] - sums[holds[0]] > kmax)
            # A bucket less within and one more around, as m - d and m + d are rounded.
            a, z = (holds[0][below[-1]] + 1, holds[1][below[-1]] - 1) if len(below) else (0, 0)
            z = max(a, z)
            first, last = (max(0, meets[0][above[0]] - 1), min(len(number), meets[1][above[0]] + 1)) if len(above) else (0, len(number))
            buckets = [int(number[k]) for k in range(first, last) if not a <= k < z]
            inner = (int(number[a]), int(number[z - 1]), int(sums[z] - sums[a])) if z > a else (1, 0, 0)
            out.append((what, m, *inner, buckets))
        yield pd.DataFrame(out, columns=["_what", "rest_median", "_in_lo", "_in_hi", "_base", "_buckets"])


def _levels(sized: DataFrame, group: str, others: bool) -> DataFrame:
    """(_k, _what, _of, group, _n): what the values of each kind are ranked in: the whole table, each group and, with `others`, all that isn't of a group;
    with a number and the count of values. `sized`: (_what, group, _rows)."""
    whole = sized.groupBy("_what").agg(F.sum("_rows").alias("_all"))
    named = sized.filter(F.col(group).isNotNull()).join(small(whole), "_what")
    made = whole.select("_what", F.lit("whole").alias("_of"), F.lit(None).cast(sized.schema[group].dataType).alias(group), F.col("_all").alias("_n"))
    made = made.unionByName(named.select("_what", F.lit("own").alias("_of"), group, F.col("_rows").alias("_n")))
    if others:
        made = made.unionByName(named.select("_what", F.lit("rest").alias("_of"), group, (F.col("_all") - F.col("_rows")).alias("_n")).filter("_n > 0"))
    return made.withColumn("_k", F.monotonically_increasing_id())


def _levelled(long: DataFrame, levels: DataFrame, group: str, on: Sequence[str] = ("_what",)) -> DataFrame:
    """Every row of `long` under the number of each level that it belongs to, with what else `levels` holds; null groups are others to all."""
    same = F.col(group).eqNullSafe(F.col("_for"))
    belongs = F.when(F.col("_of") == "own", same).when(F.col("_of") == "rest", ~same).otherwise(True)
    named = levels.withColumnsRenamed({group: "_for", **{c: f"_on{c}" for c in on}})
    for c in on:
        belongs = belongs & (F.col(c) == F.col(f"_on{c}"))
    return long.join(small(named), belongs).drop("_for", "_of", *[f"_on{c}" for c in on])


def _binned(df: DataFrame, group: str, values: dict[str, str]) -> DataFrame:
    """`stacked` with `_bin`, the bin of the value among about BINS that hold as many rows each. Equal values share a bin, and bins are in the order of values."""
    shares = [k / BINS for k in range(1, BINS)]
    number = {value: F.col(value).cast("double") for value in values}
    bounds = df.agg(*[F.percentile_approx(c, shares, SKETCH).alias(values[value]) for value, c in number.items()]).first()  # BINS numbers for each kind

    def in_bins(name: str) -> Callable:
        edges = np.unique(np.array(bounds[name] or [], "float64"))

        @F.pandas_udf("int")
        def place(v: pd.Series) -> pd.Series:
            return pd.Series(np.searchsorted(edges, v.to_numpy("float64", na_value=np.nan), "right").astype("int32"))

        return place

    placed = df.select(group, *[c.alias(f"_v{values[value]}") for value, c in number.items()])
    placed = placed.withColumns({f"_b{name}": in_bins(name)(F.col(f"_v{name}")) for name in values.values()})
    each = F.array(*[F.struct(F.lit(name).alias("_what"), F.col(f"_v{name}").alias("v"), F.col(f"_b{name}").alias("_bin")) for name in values.values()])
    return placed.select(group, F.explode(each).alias("_x")).select(group, "_x.*").filter("v IS NOT NULL")


def _middles_by_bins(long: DataFrame, levels: DataFrame, group: str) -> tuple[DataFrame, DataFrame]:
    """(_k, _n, _m, _q1, _q3) and (_k, _mad) of the levels, exact, of a settled `_binned` frame."""
    counts = settled(long.groupBy("_what", group, "_bin").agg(F.count("*").alias("_c"), F.min("v").alias("lo"), F.max("v").alias("hi")))
    bins = settled(_levelled(counts, levels, group).groupBy("_k", "_n", F.col("_bin").alias("_bucket")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("_c").alias("c")))
    wanted = {"_m": 0.5, "_q1": 0.25, "_q3": 0.75}
    ends, before, here = _ends(wanted, F.col("_n")), F.col("_before"), F.col("_before") + F.col("c")

    def after(first: Column, *keys: str, by: str) -> Column:
        return first + F.coalesce(F.sum("c").over(Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    def of_levels(near: DataFrame) -> DataFrame:
        """Rows of bins under the levels that look for a value there."""
        return _levelled(long, settled(levels.drop("_n").join(small(near), "_k")), group, ("_what", "_bin"))

    placed = bins.withColumn("_before", after(F.lit(0), "_k", by="_bucket"))
    stands = F.greatest(*[(before <= k) & (here > k) for k in ends.values()])
    near = of_levels(settled(placed.filter(stands).select("_k", "_n", F.col("_bucket").alias("_bin"), F.col("_before").alias("_first"))))
    held = near.groupBy("_k", "_n", "_first", "v").agg(F.count("*").alias("c")).withColumn("_before", after(F.col("_first"), "_k", "_first", by="v"))
    found = settled(held.groupBy("_k", "_n").agg(*[F.max(F.when((before <= k) & (here > k), F.col("v"))).alias(name) for name, k in ends.items()]))
    middle = settled(found.select("_k", "_n", *[_between(name, q, F.col("_n")).alias(name) for name, q in wanted.items()]))

    edges = bins.groupBy("_k").agg(F.array_sort(F.collect_list(F.struct("_bucket", "lo", "hi", "c"))).alias("_edges"))  # BINS structs at most
    half = (F.col("_n") - 1) / 2
    centers = middle.join(edges, "_k").select(F.col("_k").cast("string").alias("_what"), F.col("_m").alias("rest_median"), F.floor(half).alias("_kmin"), F.ceil(half).alias("_kmax"), "_edges")
    narrowed = settled(centers.mapInPandas(_narrow, _NARROWED)).select(F.col("_what").cast("long").alias("_k"), "_base", "_buckets")
    near = of_levels(settled(middle.select("_k", "_n", "_m").join(narrowed, "_k").select("_k", "_n", "_m", "_base", F.explode("_buckets").alias("_bin"))))
    held = near.groupBy("_k", "_n", "_base", F.abs(F.col("v") - F.col("_m")).alias("v")).agg(F.count("*").alias("c")).withColumn("_before", after(F.col("_base"), "_k", by="v"))
    ends = _ends({"_mad": 0.5}, F.col("_n"))
    found = settled(held.groupBy("_k", "_n").agg(*[F.max(F.when((before <= k) & (here > k), F.col("v"))).alias(name) for name, k in ends.items()]))
    return middle, found.select("_k", _between("_mad", 0.5, F.col("_n")).alias("_mad"))


def _valid(scale: Column, *references: Column) -> Column:
    largest = F.greatest(*[F.abs(F.coalesce(r, F.lit(0.0))) for r in (*references, F.lit(0.0))])
    return F.coalesce(scale > F.greatest(F.lit(1e-12), 1e-9 * largest), F.lit(False))


def robust_z(df: DataFrame, group: str, value: str, z: str, source: str, center: str, min_group: int = 30) -> DataFrame:
    """`robust_zs` of one value."""
    return robust_zs(df, group, {value: (z, source, center)}, min_group)


def robust_zs(df: DataFrame, group: str, values: dict[str, tuple[str, str, str]], min_group: int = 30) -> DataFrame:
    """Adds z-scores of the value columns by a cascade of scales: the group's MAD, IQR, standard deviation, the rest's MAD, else 0; with source and centre.

    Groups below `min_group` values use the rest. If the whole table's MAD is degenerate every z is 0. A null value has z 0;
    a null group is scored as degenerate around the whole table's median. All values are ranked together; `df` is settled or cheap to read.
    """
    keys = ["_what", group]
    names = {value: str(k) for k, value in enumerate(values)}
    many = df.count() * len(values) > TASK_VALUES
    long = settled(_binned(df, group, names) if many else stacked(df, [group], names))
    sized = settled(long.groupBy(*keys).agg(F.count("*").alias("_rows"), F.stddev_pop("v").alias("_sd")))
    own, rows = sized.filter(F.col(group).isNotNull()).select(*keys, "_sd"), sized.agg(F.sum("_rows")).first()[0] or 0
    few = own.count()
    direct = few <= DIRECT_GROUPS * len(values) or few * rows <= DIRECT_PAIRS
    levels = settled(_levels(sized, group, direct))
    if direct and many:
        middle, spread = _middles_by_bins(long, levels, group)
    else:
        levelled, sizes = _levelled(long, levels.drop("_n"), group), settled(levels.select("_k", "_n"))
        middle = settled(quantiles(levelled, ["_k"], "v", {"_m": 0.5, "_q1": 0.25, "_q3": 0.75}, "_n", sizes))
        apart = levelled.join(small(middle.select("_k", "_m")), "_k").withColumn("v", F.abs(F.col("v") - F.col("_m")))
        spread = quantiles(apart, ["_k"], "v", {"_mad": 0.5}, "_n", sizes)
    spread = settled(spread.select("_k", (1.4826 * F.col("_mad")).alias("_s")))
    both = settled(levels.drop("_n").join(small(middle), "_k").join(small(spread), "_k").drop("_k"))
    own = own.join(small(both.filter("_of = 'own'").drop("_of")), keys)
    whole = both.filter("_of = 'whole'").select("_what", F.col("_m").alias("_gm"), F.col("_s").alias("_gs"))
    if direct:
        rest = both.filter("_of = 'rest'").select(*keys, F.col("_m").alias("rest_median"), F.col("_s").alias("rest_mad"))
    else:
        in_group = settled(positions(long, keys, "v", ("_bg", "_cg", "_ng")))
        placed = settled(positions(in_group, ["_what"], "v", ("_ba", "_ca", "_na")))
        rest = settled(rest_median_mad(placed, group).withColumn("rest_mad", 1.4826 * F.col("rest_mad")))
    stats = own.join(small(rest), keys, "left").join(small(whole), "_what")
    outside = _valid(F.col("rest_mad"), F.col("rest_median"))
    back_m, back_s = F.when(outside, F.col("rest_median")).otherwise(F.col("_gm")), F.when(outside, F.col("rest_mad")).otherwise(F.col("_gs"))
    iqr = (F.col("_q3") - F.col("_q1")) / 1.349
    big = F.coalesce(F.col("_n") >= min_group, F.lit(False))
    dead = ~_valid(F.col("_gs"), F.col("_gm"))

    def choice(name: str, m: Column, k: Column | None = None) -> Column:
        return F.struct(F.lit(name).alias("s"), m.alias("m"), (F.lit(None).cast("double") if k is None else k).alias("k"))

    pick = (
        F.when(dead, choice("degenerate", F.col("_gm"))).when(big & _valid(F.col("_s"), F.col("_m"), back_s), choice("group_mad", F.col("_m"), F.col("_s")))
        .when(big & _valid(iqr, F.col("_m"), back_s), choice("group_iqr", F.col("_m"), iqr)).when(big & _valid(F.col("_sd"), F.col("_m"), back_s), choice("group_std", F.col("_m"), F.col("_sd")))
        .when(_valid(back_s, back_m), choice("global_mad", back_m, back_s)).otherwise(choice("degenerate", F.lit(0.0)))
    )
    chosen = stats.select(*keys, pick.alias("_p")).groupBy(group).agg(*[F.max(F.when(F.col("_what") == k, F.col("_p"))).alias(f"_p{k}") for k in names.values()])
    medians_of = {r["_what"]: r["_gm"] for r in whole.collect()}  # a row for each kind of value
    out = df.join(small(settled(chosen)), group, "left")
    for value, (z, source, center) in values.items():
        p, gm = f"_p{names[value]}", F.lit(medians_of.get(names[value])).cast("double")
        score = F.coalesce(safe_ratio(F.col(value) - F.col(f"{p}.m"), F.col(f"{p}.k")), F.lit(0.0))
        out = out.withColumns({z: score, source: F.coalesce(f"{p}.s", F.lit("degenerate")), center: F.coalesce(F.col(f"{p}.m"), gm)})
    return out.select(*df.columns, *[name for triple in values.values() for name in triple])
