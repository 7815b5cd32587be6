"""Spans of regular expressions in whole texts, with DataFrame functions only.

A span is (start, end) in code points, end exclusive. `split` gives the gaps between
the matches and `regexp_extract_all` the matches; the running sum of both lengths is
the position, so no Python sees a text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import left_join_spread, scratch, written


@dataclass(frozen=True)
class SpanRule:
    """`pattern`: leftmost, non-overlapping matches. `prefilter`: a cheap pattern that any text with a match has.
    `keep`: from the column of matches to the condition under which a match counts; failing ones are dropped, not retried."""

    kind: str
    pattern: str
    prefilter: str
    keep: object = None


HIT = "array<struct<kind:string,kind_order:int,k:int,gap:int,hit:string,before:string,after:string>>"


def _row(kind: str, order: int, context: int) -> Callable[[Column, Column], Column]:
    """From a zipped match and its index to a struct like those of HIT."""

    def row(x: Column, i: Column) -> Column:
        before = F.right(x["1"], F.lit(context)) if context else F.lit(None).cast("string")
        after = F.substring(x["2"], 1, context) if context else F.lit(None).cast("string")
        names = {"kind": F.lit(kind), "kind_order": F.lit(order), "k": i, "gap": F.char_length(x["1"]), "hit": x["0"], "before": before, "after": after}
        return F.struct(*[c.alias(name) for name, c in names.items()])

    return row


def hits(df: DataFrame, key: str, text: str, rules: list[SpanRule], context: int = 0) -> DataFrame:
    """One row for each match: key, kind, kind_order, start, end, hit and, with `context`, up to so many
    characters `before` and `after` it. Texts with one key must be equal; equal keys count once. Null texts have none.
    """
    c = F.col(text)
    arrays = []
    for order, rule in enumerate(rules):
        gaps = F.split(c, rule.pattern, -1)
        zipped = [F.regexp_extract_all(c, F.lit(rule.pattern), F.lit(0)), gaps] + ([F.slice(gaps, 2, 1 << 30)] if context else [])
        arrays.append(F.when(c.rlike(rule.prefilter), F.transform(F.arrays_zip(*zipped), _row(rule.kind, order, context))).otherwise(F.array().cast(HIT)))
    # explode_outer: for explode Spark adds a filter that runs all patterns once more.
    found = df.select(key, F.explode_outer(F.concat(*arrays)).alias("x")).select(key, "x.*").filter("hit IS NOT NULL")
    found = found.dropDuplicates([key, "kind", "k"])
    so_far = Window.partitionBy(key, "kind").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    placed = found.withColumn("end", F.sum(F.col("gap") + F.char_length("hit")).over(so_far)).withColumn("start", F.col("end") - F.char_length("hit"))
    wanted = F.lit(False)
    for rule in rules:
        wanted = wanted | ((F.col("kind") == rule.kind) & (rule.keep(F.col("hit")) if rule.keep else F.lit(True)))
    return placed.filter(wanted).select(key, "kind", "kind_order", F.col("start").cast("long"), F.col("end").cast("long"), "hit", "before", "after")


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined by start, then the order of kinds."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame, key: str, base: list[str]) -> DataFrame:
    """One row for each key with spans: n_<kind> of the base kinds, base_sha256, spans, and `found_spans` as structs."""
    span = F.struct("start", "kind_order", "kind", "end")
    counts = [F.count_if(F.col("kind") == kind).alias(f"n_{kind}") for kind in base]
    lists = found.groupBy(key).agg(*counts, F.collect_list(F.when(F.col("kind").isin(base), span)).alias("_base"), F.array_sort(F.collect_list(span)).alias("found_spans"))
    return lists.withColumn("base_sha256", F.sha2(joined(F.col("_base")), 256)).withColumn("spans", joined(F.col("found_spans"))).drop("_base")


def attach(rows: DataFrame, found: DataFrame, key: str, base: list[str]) -> DataFrame:
    """`rows` with the digest of their key; rows without spans get zeros, the digest of "" and no spans. Columns of `rows`
    with the added names are replaced."""
    digests = written(digest(found, key, base), scratch(rows.sparkSession), "digests")
    out = left_join_spread(rows.drop(*[c for c in digests.columns if c != key]), digests, key)
    for kind in base:
        out = out.withColumn(f"n_{kind}", F.coalesce(F.col(f"n_{kind}"), F.lit(0)).cast("long"))
    return out.withColumn("base_sha256", F.coalesce("base_sha256", F.sha2(F.lit(""), 256))).withColumn("spans", F.coalesce("spans", F.lit("")))
