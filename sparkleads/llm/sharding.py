"""Sharding as vector bin packing.

Groups of equal texts are kept together and placed, largest first, where the dot product of their
(bytes, tokens, rows) with the shard's residual capacity is highest. Groups above `LARGE` of a shard, a number that the shards bound, are
placed first, all together; one that exceeds a whole shard is split by the place of its rows. What is left open of every shard is the
capacity for the other groups. These are dealt to tasks by their key; each task packs its
groups into its share of that capacity, so shards stay near equal and no task grows with the input. What packing leaves
uneven is evened out by swaps between shards, over all three sizes at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import number_within, scratch, small, text_key, unsigned_crc32, utf8_bytes, words, written

ROW_BYTES = 16
#: Groups in a task, about.
GROUPS_PER_TASK = 20_000
#: Share of a shard, in bytes, tokens or rows, above which a group is placed with the large ones: at most 3 / LARGE groups a shard are.
LARGE = 1 / 400
#: Parts of a group that exceeds a shard, for each shard that it would fill: small ones, so that they fit beside other groups.
SPLIT = 8
#: Swaps end when open shards lie within this share of a mean shard of each other in bytes, tokens and rows.
LEVEL = 1e-3
#: Least share of what two shards could gain at best that a swap between them must gain.
GAIN = 0.02
#: Swaps, at most, for each shard: what is still uneven then stays so.
SWAPS = 40


def capacities(load: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """What each shard should still take of `rest` (bytes, tokens, rows) so that all end level. A shard that is already above that level in
    any size takes nothing, and the others share it."""
    open_ = np.ones(len(load), dtype=bool)
    while True:
        level = (load[open_].sum(axis=0) + rest) / open_.sum()
        over = open_ & (load > level * (1 + 1e-12)).any(axis=1)
        if not over.any() or over.sum() == open_.sum():
            return np.where(open_[:, None], np.maximum(level - load, 0), 0.0)
        open_ &= ~over


def place(sizes: np.ndarray, capacity: np.ndarray, first: int = 0) -> np.ndarray:
    """The shard of each row of `sizes` (bytes, tokens, rows), given how much each shard should take. `first` turns the order in which ties
    are broken."""
    mean = np.maximum(capacity.mean(axis=0), 1e-9)
    demand, residual = sizes / mean, capacity / mean
    shards, closed = len(capacity), ~(capacity > 0).any(axis=1)
    out = np.zeros(len(sizes), dtype=np.int32)
    turn = (np.arange(shards) + first) % shards
    for k in np.lexsort((np.arange(len(sizes)), -demand.max(axis=1))):
        wanted = demand[k]
        score = residual @ wanted
        score[(residual < wanted).any(axis=1) & (residual.min(axis=1) < residual.min(axis=1).max())] -= 1e6  # no room left: last resort
        score[closed] -= 1e9
        s = turn[np.argmax(score[turn])]
        out[k] = s
        residual[s] -= wanted
    _level(demand, out, -residual, ~closed)
    return out


def _level(demand: np.ndarray, out: np.ndarray, load: np.ndarray, open_: np.ndarray) -> None:
    """Evens out all sizes: swaps groups between two open shards, or moves one, where that lowers the sum of squared distances most.

    `load` is what a shard has beyond its capacity, in mean shards. The shard furthest from the mean of those not yet done is tried with the others,
    furthest apart first; a swap must gain GAIN of what the pair would gain if it became equal. A shard without such a swap is done, so one with an
    indivisible giant doesn't hold up the others. It ends when all are done or level, or after SWAPS for each shard.
    """
    todo = set(np.flatnonzero(open_).tolist())
    for _ in range(SWAPS * len(load)):
        swapped = False
        while todo and not swapped:
            left = np.array(sorted(todo))
            away = load[left] - load[left].mean(axis=0)
            if np.abs(away).max() <= LEVEL / 2:
                return
            s = int(left[(away**2).sum(axis=1).argmax()])
            own = np.flatnonzero(out == s)
            for t in left[np.argsort(-((load[left] - load[s]) ** 2).sum(axis=1), kind="stable")]:
                apart = load[t] - load[s]
                if np.abs(apart).max() <= LEVEL / 2:
                    break
                other = np.flatnonzero(out == t)
                mine, theirs = np.vstack([demand[own], np.zeros(3)]), np.vstack([demand[other], np.zeros(3)])  # the last: nothing in return
                # Moving v from s to t changes the sum by 2 v (load[t] - load[s]) + 2 v v, v being what one gives less what it takes.
                change = (mine @ apart + (mine**2).sum(axis=1))[:, None] - (theirs @ apart)[None, :] + (theirs**2).sum(axis=1)[None, :] - 2 * mine @ theirs.T
                a, b = np.unravel_index(int(np.argmin(change)), change.shape)
                if 2 * change[a, b] < -GAIN * (apart**2).sum() / 2:
                    moved = mine[a] - theirs[b]
                    if a < len(own):
                        out[own[a]] = t
                    if b < len(other):
                        out[other[b]] = s
                    load[s] -= moved
                    load[t] += moved
                    swapped = True
                    break
            else:
                todo.discard(s)
                continue
            if not swapped:
                todo.discard(s)
        if not swapped:
            return


def sharded(docs: DataFrame, shards: int = 40, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of `docs`: doc_id, size, tokens, text_crc32, shard and slot (0, 1, ... in each shard).

    Size is the text's UTF-8 bytes and 16; tokens are words. Null texts are empty, one group with the empty
    ones. Repeated rows are placed each. An empty table has no shards. Shards are near equal in bytes, tokens
    and rows, but for one that an indivisible text overfills; equal texts share a shard unless together they exceed one in bytes, tokens or rows.
    """
    folder = scratch(docs.sparkSession)
    c = F.col(f"`{text}`")
    rows = written(docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), text_key(c).alias("group"), (utf8_bytes(c) + ROW_BYTES).alias("size"), F.size(words(c)).cast("long").alias("tokens"),
        unsigned_crc32(c).alias("text_crc32"), F.monotonically_increasing_id().alias("place"),
    ), folder, "rows")
    total = rows.agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("r")).first()
    if not total["r"]:
        return rows.select("doc_id", "size", "tokens", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    in_shards = F.greatest(*[F.col(x) * shards / F.lit(max(total[x], 1)) for x in "btr"])
    part: Column = F.when(in_shards <= 1, 1).otherwise(F.least(F.ceil(SPLIT * in_shards), F.col("r"))).cast("int")
    sums = [F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("r")]
    groups = rows.groupBy("group").agg(*sums).withColumn("parts", part)
    split = small(written(groups.filter("parts > 1").select("group", "parts"), folder, "split"))  # each exceeds a shard: at most three of them a shard
    parted = written(rows.join(split, "group", "left").withColumn("part", F.pmod(F.xxhash64("place"), F.coalesce("parts", F.lit(1)))).drop("parts"), folder, "parted")
    pieces = written(parted.groupBy("group", "part").agg(*sums), folder, "pieces")
    above = in_shards > LARGE
    whole = np.array([total[x] for x in "btr"], dtype=float)

    def packed(capacity: np.ndarray):
        def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = [x for x in batches if len(x)]
            if held:
                for bucket, found in pd.concat(held).groupby("bucket"):
                    found = found.sort_values(["group", "part"], ignore_index=True)
                    sizes = found[["b", "t", "r"]].to_numpy(dtype=float)
                    share = capacity * (sizes.sum(axis=0) / np.maximum(capacity.sum(axis=0), 1e-9))
                    found["shard"] = place(sizes, share, int(bucket) * 7)
                    yield found[["group", "part", "b", "t", "r", "shard"]]

        return task

    schema = "group string, part long, b long, t long, r long, shard int"
    # At most 3 * shards / LARGE groups, whatever the input: one task.
    large = written(pieces.filter(above).withColumn("bucket", F.lit(0)).repartition(1).mapInPandas(packed(np.tile(whole / shards, (shards, 1))), schema), folder, "large")
    load = np.zeros((shards, 3))
    for r in large.groupBy("shard").agg(*[F.sum(x).alias(x) for x in "btr"]).collect():
        load[r["shard"]] = r["b"], r["t"], r["r"]
    others = pieces.filter(~above)
    tasks = max(1, -(-others.count() // GROUPS_PER_TASK))
    dealt = others.withColumn("bucket", F.pmod(F.xxhash64("group", "part"), F.lit(tasks))).repartition(tasks, "bucket")
    rest = written(dealt.mapInPandas(packed(capacities(load, whole - load.sum(axis=0))), schema), folder, "rest")
    placed = large.unionByName(rest).select("group", "part", "shard")
    out = parted.join(placed, ["group", "part"]).select("doc_id", "size", "tokens", "text_crc32", "shard")
    return number_within(out, "shard", "slot")
