"""Connected components by alternating large and small stars; each round is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def _mins(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _clean(edges: DataFrame) -> DataFrame:
    return edges.filter("a <> b").dropDuplicates(["a", "b"])


def components(edges: DataFrame, folder: str, rounds: int = 60) -> DataFrame:
    """(node, root) of every node of `edges` (columns a, b of one ordered type); the root is the component's least node.

    Edges to itself or with a null are dropped. No edges: no rows.
    """
    edges = written(_clean(edges.select("a", "b").filter("a IS NOT NULL AND b IS NOT NULL")), folder, "edges-0")
    before = None
    for k in range(1, rounds + 1):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _clean(both.join(_mins(both), "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")))
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        near = _mins(down)
        small = down.join(near, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).union(near.select(F.col("u").alias("a"), F.col("m").alias("b")))
        edges = written(_clean(small), folder, f"edges-{k}")
        discard(edges.sparkSession, folder, f"edges-{k - 1}")
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
