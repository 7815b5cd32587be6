"""N-gram Jaccard self-join by chosen paths.

A text's set of word five-grams is embedded as minhash values. A run starts from one sampled
coordinate: texts that share its value share a node. Nodes above a limit are split again on two
coordinates that the node samples, level by level, as joins of (node, text) rows; small nodes are
compared by brute force. Runs repeat until a pair at the threshold is found with the target recall.
A node that splitting doesn't shrink (a large group of near copies) is compared in blocks of pairs
of parts, so no task holds it whole and no pair is skipped.

Nodes are compared twice. First by their texts' signatures alone: texts that agree with no other of the node in
enough coordinates leave it, and of nodes with the same texts one stays. Then by the sets themselves, so that hardly
any text is sent that has no partner. What the first comparison may lose is part of the recall.

A pair that shares several nodes counts in the least of them only; a node's comparison returns each
text's number of partners and a spanning forest, never its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, scratch, text_id, words, written
from .components import components

WIDTH = 5
COORDINATES = 32
BRANCHES = 2
#: Nodes up to this size aren't split further.
LIMIT = 192
#: Texts and shingles, about, of a part of a node; pairs of parts are compared in one task each.
PART_TEXTS, PART_SHINGLES = 2048, 1_000_000
DEPTH = 8
#: A node whose largest child has at least this share of it isn't split further.
STUCK = 0.7
_SLICE = 400_000
_MIX = np.random.default_rng(20240501).integers(1, 2**63, size=(COORDINATES, 2), dtype=np.uint64) | np.uint64(1)


#: Coordinates in which two texts of a node must agree to be compared by their sets. At similarity 0.8 fewer agree once in ten million pairs.
AGREEING = 12


def lost_share(similarity: float, runs: int, depth: int = DEPTH) -> float:
    """The chance that a pair at `similarity` meets in no compared node of `runs` runs, if every node is split `depth` times, or agrees in too few coordinates.

    All runs and levels draw from the same coordinates, so runs are independent only given the number of coordinates
    in which the pair agrees; the chance is the mean over that number. `lost` is the chance that all branches below a node die out.
    """
    turns, more = divmod(runs, COORDINATES)
    chance = 0.0
    for agree in range(COORDINATES + 1):
        weight = math.comb(COORDINATES, agree) * similarity**agree * (1 - similarity) ** (COORDINATES - agree)
        if agree < AGREEING:
            chance += weight
            continue
        # The coordinates of a node's branches differ.
        kept = [math.comb(agree, k) * math.comb(COORDINATES - agree, BRANCHES - k) / math.comb(COORDINATES, BRANCHES) for k in range(BRANCHES + 1)]
        lost = 0.0
        for _ in range(depth):
            lost = sum(p * lost**k for k, p in enumerate(kept))
        for roots in range(max(0, more - COORDINATES + agree), min(more, agree) + 1):
            share = math.comb(agree, roots) * math.comb(COORDINATES - agree, more - roots) / math.comb(COORDINATES, more)
            chance += weight * share * lost ** (turns * agree + roots)
    return chance


def runs_needed(similarity: float, recall: float) -> int:
    """Least runs after which a pair at `similarity` has met in a compared node with probability `recall`, however its nodes are split."""
    for runs in range(1, 8 * COORDINATES):
        if lost_share(similarity, runs) <= 1 - recall:
            return runs
    raise ValueError(f"no number of runs reaches recall {recall} at {similarity} with {COORDINATES} coordinates")


def shingles(hashes: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of `width` words and their offsets by text. A text of fewer words has one window, all of it; one without words none."""
    n = np.diff(offsets)
    with np.errstate(over="ignore"):
        value = np.zeros(len(hashes), dtype=np.uint64)
        for k in range(width):
            shifted = np.zeros(len(hashes), dtype=np.uint64)
            shifted[: len(hashes) - k] = hashes[k:]
            value = (value ^ shifted) * np.uint64(0x9E3779B97F4A7C15)
            value ^= value >> np.uint64(32)
        position = np.arange(len(hashes)) - np.repeat(offsets[:-1], n)
        keep = position <= np.repeat(np.maximum(n - width, 0), n)
        keep &= (np.repeat(n, n) >= width) | (position == 0)
        for d in np.flatnonzero((n > 0) & (n < width)):
            short = np.uint64(n[d])
            for h in hashes[offsets[d] : offsets[d + 1]]:
                short = (short ^ h) * np.uint64(0xC2B2AE3D27D4EB4F)
                short ^= short >> np.uint64(31)
            value[offsets[d]] = short
    counts = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    return value[keep], np.concatenate([[0], np.cumsum(counts)])


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    offsets = lists.offsets.to_numpy().astype(np.int64)
    values = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    return values.view(np.uint64), offsets - offsets[0]


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes, offsets = _flat(batch.column("hashes"))
        out = np.zeros((batch.num_rows, COORDINATES), dtype=np.uint32)
        sizes = np.zeros(batch.num_rows, dtype=np.int64)
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + _SLICE, side="right")) - 1)
            value, at = shingles(hashes[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
            sizes[first:last] = np.diff(at)
            full = np.flatnonzero(np.diff(at)) + first
            if len(full):
                starts = at[full - first]
                with np.errstate(over="ignore"):
                    for c in range(COORDINATES):
                        mixed = (value * _MIX[c, 0] + _MIX[c, 1]) >> np.uint64(32)
                        out[full, c] = np.minimum.reduceat(mixed, starts).astype(np.uint32)
            first = last
        flat = np.arange(0, (batch.num_rows + 1) * COORDINATES, COORDINATES, dtype=np.int32)
        signature = pa.ListArray.from_arrays(pa.array(flat), pa.array(out.view(np.int32).ravel()))
        yield pa.RecordBatch.from_arrays([batch.column("row_id"), batch.column("text_id"), pa.array(sizes), signature], names=["row_id", "text_id", "size", "signature"])


def word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def _sizes(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("text_id")).alias("who"))


def chosen_paths(texts: DataFrame, runs: int, folder: str, limit: int = LIMIT, depth: int = DEPTH) -> DataFrame:
    """(node, text_id, n) of all nodes to compare, n being the node's size. Of nodes with the same texts one stays."""
    roots = F.array(*[F.xxhash64(F.lit(r), F.get("signature", r % COORDINATES)) for r in range(runs)])
    rows = written(texts.select("text_id", F.explode(roots).alias("node")), folder, "level-1")
    sizes = written(_sizes(rows, ["node"]).filter("n > 1"), folder, "sizes-1")
    done_sizes = sizes.filter(F.col("n") <= limit)
    done_rows = rows.join(done_sizes.select("node"), "node", "left_semi")
    large, large_sizes = rows, sizes.filter(F.col("n") > limit)
    for level in range(2, depth + 2):
        if large_sizes.isEmpty():
            break
        at_large = large.join(large_sizes, "node")
        if level > depth:
            done_sizes, done_rows = done_sizes.unionByName(large_sizes), done_rows.unionByName(at_large.select("text_id", "node"))
            break
        first = F.pmod(F.xxhash64("node", F.lit(1)), F.lit(COORDINATES))
        second = F.pmod(first + 1 + F.pmod(F.xxhash64("node", F.lit(2)), F.lit(COORDINATES - 1)), F.lit(COORDINATES))
        child = [F.xxhash64("node", c, F.get("signature", c.cast("int"))) for c in (first, second)]
        split = at_large.join(texts.select("text_id", "signature"), "text_id").select("text_id", "node", F.col("n").alias("parent_n"), F.explode(F.array(*child)).alias("child"))
        split = written(split, folder, f"level-{level}")
        children = written(_sizes(split.withColumnRenamed("node", "parent"), ["parent", "parent_n", "child"]), folder, f"sizes-{level}")
        stuck = written(children.groupBy("parent", "parent_n").agg(F.max("n").alias("most")).filter(F.col("most") >= STUCK * F.col("parent_n")).select(F.col("parent").alias("node")), folder, f"stuck-{level}")
        done_sizes = done_sizes.unionByName(large_sizes.join(stuck, "node", "left_semi"))
        done_rows = done_rows.unionByName(large.join(stuck, "node", "left_semi"))
        on = children.filter("n > 1").join(stuck.withColumnRenamed("node", "parent"), "parent", "left_anti").select(F.col("child").alias("node"), "n", "who")
        below = split.select("text_id", F.col("child").alias("node"))
        small = on.filter(F.col("n") <= limit)
        done_sizes, done_rows = done_sizes.unionByName(small), done_rows.unionByName(below.join(small.select("node"), "node", "left_semi"))
        large, large_sizes = below, on.filter(F.col("n") > limit)
    kept = done_sizes.groupBy("n", "who").agg(F.min("node").alias("node"))
    nodes = written(done_rows.join(kept.select("node", "n"), "node").dropDuplicates(["node", "text_id"]), folder, "nodes")
    discard(texts.sparkSession, folder, *[f"{name}-{k}" for name in ("level", "sizes", "stuck") for k in range(1, depth + 2)])
    return nodes


def _cells(batches: Iterator[pa.RecordBatch], lists: str) -> Iterator[tuple[int, bool, dict[str, list], list[np.ndarray]]]:
    """(node, whether it is a pair of different parts, columns, the values of `lists` by row) of each cell; its rows follow each other."""
    at, held, rows = None, {}, []
    for batch in batches:
        offsets = batch.column(lists).offsets.to_numpy().astype(np.int64)
        values = batch.column(lists).values.to_numpy(zero_copy_only=False)
        node, i, j = (batch.column(c).to_numpy() for c in ("node", "i", "j"))
        turns = np.flatnonzero((np.diff(node) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
        others = [c for c in batch.schema.names if c not in (lists, "node", "i", "j")]
        for first, last in zip([0, *turns], [*turns, batch.num_rows], strict=True):
            if first == last:
                continue
            key = (int(node[first]), int(i[first]), int(j[first]))
            if key != at:
                if at:
                    yield at[0], at[1] != at[2], held, rows
                at, held, rows = key, {c: [] for c in others}, []
            for c in others:
                held[c] += batch.column(c).slice(first, last - first).to_pylist()
            rows += [values[offsets[r] : offsets[r + 1]].copy() for r in range(first, last)]
    if at:
        yield at[0], at[1] != at[2], held, rows


def _agree(signatures: np.ndarray, parts: np.ndarray, across: bool) -> np.ndarray:
    """Whether each text of a cell agrees with another (of the other part) in AGREEING coordinates."""
    k = len(signatures)
    found = np.zeros(k, dtype=bool)
    for first in range(0, k, 256):
        block = signatures[first : first + 256]
        same = np.zeros((len(block), k), dtype=np.uint8)
        for c in range(COORDINATES):
            same += block[:, c, None] == signatures[None, :, c]
        near = same >= AGREEING
        if across:
            near &= parts[first : first + 256, None] != parts[None, :]
        else:
            near[np.arange(len(block)), first + np.arange(len(block))] = False
        found[first : first + 256] = near.any(axis=1)
    return found


def _screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    nodes, keys = [], []
    for node, across, held, rows in _cells(batches, "signature"):
        if len(rows) > 1:
            near = np.flatnonzero(_agree(np.array(rows), np.array(held["part"]), across))
            keys += [held["text_id"][r] for r in near]
            nodes += [node] * len(near)
        if len(keys) > 5000:
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(keys, pa.binary())], names=["node", "text_id"])
            nodes, keys = [], []
    if keys:
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(keys, pa.binary())], names=["node", "text_id"])


def _near(sets: list[np.ndarray], similarity: Fraction) -> np.ndarray:
    """Which pairs of sets are similar, as a symmetric matrix; no set is similar to itself."""
    k, size = len(sets), np.array([len(x) for x in sets])
    _, token, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(k), size)
    shared = df[token] > 1
    _, token = np.unique(token[shared], return_inverse=True)
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[shared][order]
    common = np.zeros((k, k), dtype=np.float32)
    total, width = (int(token[-1]) + 1 if len(token) else 0), max(64, (1 << 22) // k)
    for start in range(0, total, width):
        a, b = np.searchsorted(token, [start, start + width])
        grid = np.zeros((k, min(width, total - start)), dtype=np.float32)
        grid[owner[a:b], token[a:b] - start] = 1
        common += grid @ grid.T
    near = np.zeros((k, k), dtype=bool)
    for first in range(0, k, 256):
        c = common[first : first + 256].astype(np.int64)
        near[first : first + 256] = similarity.denominator * c >= similarity.numerator * (size[first : first + 256, None] + size[None, :] - c)
    np.fill_diagonal(near, False)
    return near


def _links(node: int, across: bool, held: dict[str, list], sets: list[np.ndarray], similarity: Fraction) -> list[tuple[bytes, bytes, int]]:
    """(text, root of its tree here, documents it links to), of the texts of a cell with a link that counts here."""
    if len(sets) < 2:
        return []
    near = _near(sets, similarity)
    parts = np.array(held["part"])
    if across:
        near &= parts[:, None] != parts[None, :]
    shared: dict[int, list[int]] = {}
    for r, nodes in enumerate(held["nodes"]):
        for x in nodes:
            if x < node:
                shared.setdefault(x, []).append(r)
    for rows in shared.values():  # such pairs count in the lesser node
        near[np.ix_(rows, rows)] = False
    count = near @ np.array(held["copies"], dtype=np.int64)
    root = np.arange(len(sets))
    while True:
        least = np.array([min(root[r], root[row].min(initial=len(root))) for r, row in enumerate(near)])
        if (least == root).all():
            break
        root = least
    names = held["text_id"]
    return [(names[r], names[root[r]], int(count[r])) for r in np.flatnonzero(near.any(axis=1))]


def _compare(similarity: Fraction):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[bytes, bytes, int]] = []

        def batch_of() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.binary(), pa.int64()), strict=True)], names=["text_id", "root", "links"])

        for node, across, held, hashes in _cells(batches, "hashes"):
            first = {key: r for r, key in reversed(list(enumerate(held["text_id"])))}  # repeated rows with one id come repeatedly
            if len(first) < len(hashes):
                rows = sorted(first.values())
                held, hashes = {c: [x[r] for r in rows] for c, x in held.items()}, [hashes[r] for r in rows]
            sets = [np.unique(shingles(x.view(np.uint64), np.array([0, len(x)]))[0]) for x in hashes]
            out += _links(node, across, held, sets, similarity)
            if len(out) > 5000:
                yield batch_of()
                out.clear()
        if out:
            yield batch_of()

    return task


def _in_cells(rows: DataFrame, texts_in_part: int) -> DataFrame:
    """Rows (node, text_id, n, weight, ...), once for each pair (i, j) of parts that holds their part, sorted by cells."""
    parts = F.ceil(F.greatest(F.col("n") / texts_in_part, F.col("weight") / PART_SHINGLES)).cast("int")
    parted = rows.withColumn("m", parts).withColumn("part", F.pmod(F.xxhash64("text_id", F.lit(7)), F.col("m")).cast("int"))
    paired = parted.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    cells = paired.withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")}).drop("m", "other", "n", "weight")
    return cells.repartition("node", "i", "j").sortWithinPartitions("node", "i", "j")


def screened(nodes: DataFrame, texts: DataFrame, folder: str) -> DataFrame:
    """(node, text_id, n, weight) of the texts that agree with another of their node, n and weight being the texts and shingles left there."""
    held = nodes.select("node", "text_id", "n", F.lit(0).alias("weight")).join(texts.select("text_id", "signature"), "text_id")
    left = written(_in_cells(held, PART_TEXTS).select("node", "i", "j", "text_id", "part", "signature").mapInArrow(_screen, "node long, text_id binary"), folder, "screened")
    left = left.distinct().join(texts.select("text_id", "size"), "text_id")
    left = written(left, folder, "left")
    sizes = left.groupBy("node").agg(F.count("*").alias("n"), F.sum("size").alias("weight"), F.bit_xor(F.xxhash64("text_id")).alias("who"))
    kept = sizes.groupBy("n", "who").agg(F.min(F.struct("node", "weight")).alias("x")).select("x.node", "n", "x.weight")
    kept = written(left.select("node", "text_id").join(kept, "node"), folder, "kept")
    discard(texts.sparkSession, folder, "nodes", "screened", "left")
    return kept


def text_classes(docs: DataFrame, similarity: float = 0.8, recall: float = 0.9995, row_id: str = "doc_id", text: str = "text", limit: int = LIMIT) -> tuple[DataFrame, DataFrame]:
    """(row_id, text_id) of each row of `docs`, and (text_id, root, first_id, class_id, links) of each text.

    root names the text's class and first_id is the text's least id; the others are as in `joined`.
    """
    folder = scratch(docs.sparkSession)
    share = Fraction(similarity).limit_denominator(1000)
    c = F.col(f"`{text}`")
    source = docs.select(F.col(f"`{row_id}`").alias("row_id"), c.alias("text"))
    narrow = source.select("row_id", text_id(F.col("text")).alias("text_id"), word_hashes(F.col("text")).alias("hashes"))
    id_type = narrow.schema["row_id"].dataType.simpleString()
    signed = written(narrow.mapInArrow(_signatures, f"row_id {id_type}, text_id binary, size long, signature array<int>"), folder, "signed")
    texts = written(signed.groupBy("text_id").agg(F.min("row_id").alias("first_id"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("signature").alias("signature")), folder, "texts")
    nodes = screened(chosen_paths(texts.filter("size > 0"), runs_needed(similarity, recall), folder, limit), texts, folder)
    held = nodes.groupBy("text_id").agg(F.collect_list(F.struct("node", "n", "weight")).alias("held"))
    wanted = texts.select(F.col("text_id").alias("w_id"), "first_id", "copies").join(held.withColumnRenamed("text_id", "w_id"), "w_id")
    keyed = source.withColumn("text_id", text_id(F.col("text")))
    found = keyed.join(wanted, (F.col("text_id") == F.col("w_id")) & F.col("row_id").eqNullSafe(F.col("first_id")))
    placed = found.select("text_id", "text", "copies", F.col("held.node").alias("nodes"), F.explode("held").alias("h")).select("text_id", "text", "copies", "nodes", "h.*")
    dealt = _in_cells(placed, PART_TEXTS)
    compared = dealt.select("node", "i", "j", "text_id", "part", "nodes", "copies", word_hashes(F.col("text")).alias("hashes")).mapInArrow(_compare(share), "text_id binary, root binary, links long")
    compared = written(compared, folder, "compared")
    roots = components(compared.select(F.col("text_id").alias("a"), F.col("root").alias("b")), folder)
    links = compared.groupBy("text_id").agg(F.sum("links").alias("near"))
    rooted = texts.select("text_id", "first_id", "copies").join(roots.withColumnRenamed("node", "text_id"), "text_id", "left").join(links, "text_id", "left")
    rooted = written(rooted.withColumn("root", F.coalesce("root", "text_id")), folder, "rooted")
    discard(docs.sparkSession, folder, "texts", "kept", "compared")
    classes = rooted.groupBy("root").agg(F.min("first_id").alias("class_id"))
    by_text = rooted.join(classes, "root").select("text_id", "root", "first_id", "class_id", (F.coalesce("near", F.lit(0)) + F.col("copies") - 1).alias("links"))
    return signed.select("row_id", "text_id"), by_text


def joined(docs: DataFrame, similarity: float = 0.8, recall: float = 0.9995, row_id: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row for each row of `docs`: its id as `row_id`, class_id and links.

    Two rows link if their texts are equal or their sets of word five-grams have a Jaccard similarity of at
    least `similarity`; links is the number of rows a row links to, copies included. class_id is the least id
    of the rows connected by links. A text of one to four words has itself as its only five-gram; null texts
    are empty, and texts without words link to equal texts only. Repeated rows count each; null ids stay null
    and name a class only if all its ids are null. An empty table has no rows.
    """
    rows, by_text = text_classes(docs, similarity, recall, row_id, text, limit)
    return rows.join(by_text, "text_id").select("row_id", "class_id", "links")
