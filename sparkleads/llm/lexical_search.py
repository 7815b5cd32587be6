"""Ranked lexical search by Block-Max MaxScore.

The index has shards of up to `SHARD_DOCS` documents, built where the documents are read. A shard's list of a term holds document
numbers and counts in compressed blocks of `BLOCK` postings; next to each block stands, uncompressed, the greatest impact in it.
A query goes through a shard in windows of documents. Lists are ordered by their bound, weight times greatest impact; those whose bounds
together stay below the score to beat are non-essential: they bring no document of their own. The documents of the essential lists are
scored, and for each non-essential list, greatest bound first, a document stays only while its score, the maximum of the block that
may hold it and the bounds of the lists to come reach the score to beat. Blocks that no document needs are never decompressed. The
best documents of each shard meet in one ranking.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import ascii_lower, scratch, written

#: Documents and postings of a shard, at most but for one piece of text: they bound a task's memory.
SHARD_DOCS, SHARD_POSTINGS = 16_384, 1_000_000
#: Bytes of text that are cut to terms at a time.
PIECE_BYTES = 1_000_000
#: Postings in a block.
BLOCK = 128
#: Documents of the first window, and of the largest.
FIRST_WINDOW, LAST_WINDOW = 512, 8192
#: Queries, and their terms, that are searched together: these go to every task.
QUERIES, QUERY_TERMS = 1000, 200_000
#: Whatever isn't part of a term, once A-Z are lower-cased.
GAPS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def terms(text: Column) -> Column:
    """The terms of a text in order; none for null."""
    spaced = F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), GAPS, " ")
    return F.filter(F.split(spaced, " ", -1), lambda t: t != "")


@dataclass(frozen=True)
class Index:
    """Blocks and documents by shard, the documents with a term (N) and all their terms (L)."""

    rows: DataFrame
    documents: int
    terms: int


def lengths(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """m of documents with `n` terms, in exact integers however large the collection."""
    exact = n.astype(object) if len(n) and 75 * int(n.max()) * documents >= 1 << 63 else n
    return (25 + (75 * exact * documents) // max(total, 1)).astype(np.int64)


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def packed_numbers(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers in groups of seven bits, low ones first, the high bit on all but the last; and where each begins."""
    size = np.ones(len(values), dtype=np.int64)
    for k in range(1, 10):
        size += values >= 1 << 7 * k if k < 9 else 0
    start = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(int(start[-1]), dtype=np.uint8)
    for k in range(int(size.max(initial=0))):
        has = size > k
        out[start[:-1][has] + k] = (values[has] >> 7 * k & 127) | np.where(size[has] > k + 1, 128, 0)
    return out, start


def unpacked_numbers(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, dtype=np.uint8)
    ends = np.flatnonzero(raw < 128)
    starts = np.concatenate([[0], ends[:-1] + 1])
    out, size = np.zeros(len(ends), dtype=np.int64), ends - starts + 1
    for k in range(int(size.max(initial=0))):
        has = size > k
        out[has] |= (raw[starts[has] + k].astype(np.int64) & 127) << 7 * k
    return out


class ShardBuilder:
    """Gathers the postings of documents, piece by piece, and cuts them into blocks."""

    def __init__(self) -> None:
        self.ids: list = []
        self.sizes: list[np.ndarray] = []
        self.codes: dict[str, int] = {}
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.postings = 0

    def full(self) -> bool:
        return len(self.ids) >= SHARD_DOCS or self.postings >= SHARD_POSTINGS

    def add(self, ids: list, texts: pa.Array) -> None:
        """Documents with their texts; null texts have no terms."""
        own = texts.take(pa.array(np.arange(len(texts)))).cast(pa.large_string())  # a copy: ascii_lower misreads slices
        lower = pc.replace_substring_regex(pc.ascii_lower(own.fill_null("")), pattern=GAPS, replacement=" ")
        lists = pc.split_pattern(lower, pattern=" ")
        doc, flat = pc.list_parent_indices(lists).to_numpy(), pc.list_flatten(lists)
        full = pc.not_equal(flat, "")
        doc, coded = doc[full.to_numpy(zero_copy_only=False)], pc.dictionary_encode(pc.filter(flat, full))
        known = [self.codes.setdefault(t, len(self.codes)) for t in coded.dictionary.to_pylist()]
        code = np.array(known, dtype=np.int64)[coded.indices.to_numpy()] if known else np.zeros(0, dtype=np.int64)
        held, tf = np.unique(code * len(ids) + doc, return_counts=True)
        self.parts.append((held // max(len(ids), 1), held % max(len(ids), 1) + len(self.ids), tf.astype(np.int64)))
        self.sizes.append(np.bincount(doc, minlength=len(ids)).astype(np.int64))
        self.ids += ids
        self.postings += len(held)

    def blocks(self, documents: int, total: int) -> tuple[np.ndarray, pa.Array, dict[str, np.ndarray], pa.Array]:
        """Terms in each document; of each block its term, numbers (block, count, first, last, top) and packed data."""
        sizes = np.concatenate(self.sizes)
        code, doc, tf = (np.concatenate([p[k] for p in self.parts]) for k in range(3))
        order = np.lexsort((doc, code))
        code, doc, tf = code[order], doc[order], tf[order]
        news = np.flatnonzero(np.diff(code, prepend=-1))
        rank = np.arange(len(code)) - np.repeat(news, np.diff(np.append(news, len(code))))
        start = np.flatnonzero(rank % BLOCK == 0)
        count = np.diff(np.append(start, len(code)))
        gap = np.diff(doc, prepend=0)
        gap[start] = doc[start]
        data, at = packed_numbers(np.stack([gap, tf], axis=1).ravel())
        bounds = at[np.append(2 * start, 2 * len(code))].astype(np.int32)
        top = np.maximum.reduceat(impacts(tf, lengths(sizes, documents, total)[doc]), start) if len(start) else np.zeros(0, dtype=np.int64)
        numbers = {"block": rank[start] // BLOCK, "count": count, "first": doc[start], "last": doc[start + count - 1], "top": top}
        names = pa.array(list(self.codes), type=pa.string()).take(pa.array(code[start]))
        return sizes, names, numbers, pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(data.tobytes())])


NUMBERS = ["block", "count", "first", "last", "top"]


def built(docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text") -> Index:
    """The index of all documents, written to `folder`, a shared one.

    Null texts and texts without terms count in neither statistic and match nothing. Repeated rows and rows with the same id are documents
    of their own; null ids are kept. An empty table gives an empty index. Other columns aren't read.
    """
    plain = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    stats = plain.select(F.size(terms(F.col("text"))).cast("long").alias("n")).agg(F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").alias("terms")).first()
    documents, total = stats["documents"], stats["terms"] or 0
    id_type = docs.schema[doc_id].dataType
    id_arrow = to_arrow_type(id_type)
    names = ["shard", "term", *NUMBERS, "data", "doc_ids", "sizes"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number = ShardBuilder(), TaskContext.get().partitionId() << 32

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal shard, number
            sizes, terms_of, numbers, data = shard.blocks(documents, total)
            none, ids = pa.nulls(1, pa.int64()), pa.array([shard.ids], type=pa.list_(id_arrow))
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.nulls(1, pa.string()), *[none] * 5, pa.nulls(1, pa.binary()), ids, pa.array([sizes])], names=names)
            for k in range(0, len(terms_of), 50_000):
                part = slice(k, k + 50_000)
                rows = len(terms_of[part])
                cols = [pa.array(np.full(rows, number)), terms_of[part], *[pa.array(numbers[x][part].astype(np.int64)) for x in NUMBERS], data[part]]
                yield pa.RecordBatch.from_arrays([*cols, pa.nulls(rows, pa.list_(id_arrow)), pa.nulls(rows, pa.list_(pa.int64()))], names=names)
            shard, number = ShardBuilder(), number + 1

        for batch in batches:
            ids, texts, first = batch.column(0).to_pylist(), batch.column(1), 0
            sizes = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
            while first < len(ids):
                last, held = first, 0
                while last < len(ids) and held < PIECE_BYTES and len(shard.ids) + last - first < SHARD_DOCS:
                    held += int(sizes[last])
                    last += 1
                shard.add(ids[first:last], texts.slice(first, last - first))
                first = last
                if shard.full():
                    yield from flush()
        if shard.ids:
            yield from flush()

    schema = f"shard long, term string, block long, count long, first long, last long, top long, data binary, doc_ids array<{id_type.simpleString()}>, sizes array<long>"
    return Index(written(plain.mapInArrow(task, schema), folder, "index"), documents, total)


class PostingList:
    """One term's blocks in a shard, by block; `m` are the lengths of the shard's documents."""

    def __init__(self, block: np.ndarray, first: np.ndarray, last: np.ndarray, top: np.ndarray, data: list[bytes], m: np.ndarray) -> None:
        order = np.argsort(block)
        self.first, self.last, self.top, self.m = first[order], last[order], top[order], m
        self.data = [data[k] for k in order]
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def read(self, block: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of a block, decompressed once."""
        if block not in self.open:
            pairs = unpacked_numbers(self.data[block]).reshape(-1, 2)
            docs = np.cumsum(pairs[:, 0])
            self.open[block] = docs, impacts(pairs[:, 1], self.m[docs])
        return self.open[block]

    def between(self, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for b in range(int(np.searchsorted(self.last, low)), int(np.searchsorted(self.first, high))):
            docs, impact = self.read(b)
            a, z = np.searchsorted(docs, (low, high))
            yield docs[a:z], impact[a:z]


def best_of_shard(query: list[tuple[PostingList, int]], place: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The best `k` (document number, score) of a shard for lists with weights; ties by `place`, the order of the documents' ids."""
    lists = sorted(query, key=lambda x: x[1] * int(x[0].top.max()))
    bound = np.array([w * int(p.top.max()) for p, w in lists], dtype=np.int64)
    sums = np.cumsum(bound)
    docs, scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    low, width, beat = 0, FIRST_WINDOW, 0
    while low < len(place):
        high = min(len(place), low + width)
        essential = int(np.searchsorted(sums, beat))  # lists before it stay below the score to beat, all together
        if essential == len(lists):
            break
        score = np.zeros(high - low, dtype=np.int64)
        for plist, w in lists[essential:]:
            for d, impact in plist.between(low, high):
                score[d - low] += w * impact
        found = np.flatnonzero(score)
        for t in range(essential - 1, -1, -1):
            found = found[score[found] + sums[t] >= beat]
            if not len(found):
                break
            plist, w = lists[t]
            rest = int(sums[t] - bound[t])
            b = np.searchsorted(plist.last, found + low)
            inside = b < len(plist.last)
            inside[inside] = plist.first[b[inside]] <= found[inside] + low
            top = np.zeros(len(found), dtype=np.int64)
            top[inside] = w * plist.top[b[inside]]
            stays = score[found] + top + rest >= beat
            found, b, inside = found[stays], b[stays], inside[stays]
            for block in np.unique(b[inside]):
                d, impact = plist.read(int(block))
                wanted = found[inside & (b == block)]
                at = np.minimum(np.searchsorted(d, wanted + low), len(d) - 1)
                score[wanted] += w * np.where(d[at] == wanted + low, impact[at], 0)
        found = found[score[found] >= max(beat, 1)]
        docs, scores = np.append(docs, found + low), np.append(scores, score[found])
        best = np.lexsort((place[docs], -scores))[:k]
        docs, scores = docs[best], scores[best]
        beat = int(scores[-1]) if len(scores) == k else 0
        low, width = high, min(2 * width, LAST_WINDOW)
    return list(zip(docs.tolist(), scores.tolist(), strict=True))


def searched(index: Index, items: DataFrame, k: int = 10, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, rank, doc_id and score of the `k` best documents of each row of `items`, equal scores by ascending doc_id, null ids last.

    Only scores above 0 count; items with null text or without such documents have no row. Repeated items are ranked each. Queries go
    through the index in blocks of at most `QUERIES` rows and about `QUERY_TERMS` terms.
    """
    spark, folder = items.sparkSession, scratch(items.sparkSession)
    asked = items.select(F.monotonically_increasing_id().alias("query"), F.col(f"`{item_id}`").alias("item_id"), terms(F.col(f"`{text}`")).alias("terms"))
    asked = written(asked.filter(F.size("terms") > 0), folder, "queries")
    size = asked.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.size("terms")).alias("terms")).first()
    blocks = max(1, -(-size["rows"] // QUERIES), -(-(size["terms"] or 0) // QUERY_TERMS))
    id_type = index.rows.schema["doc_ids"].dataType.elementType
    for n in range(blocks):
        block = asked.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == n)
        _search_block(index, block, k, id_type).write.parquet(f"{folder}/found/block={n}")
    found = spark.read.schema(f"query long, doc_id {id_type.simpleString()}, score long").parquet(*[f"{folder}/found/block={n}" for n in range(blocks)])
    ranks = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(ranks)).filter(F.col("rank") <= k)
    return ranked.join(asked.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")


def _search_block(index: Index, block: DataFrame, k: int, id_type) -> DataFrame:
    spark = block.sparkSession
    wanted = block.select(F.explode("terms").alias("term")).distinct()
    hits = index.rows.join(F.broadcast(wanted), "term")  # at most QUERY_TERMS rows
    weights = {
        r["term"]: math.floor(1000 * math.log((2 * index.documents + 2) / (2 * r["df"] + 1))) for r in hits.groupBy("term").agg(F.sum("count").alias("df")).collect()
    }
    queries = [(r["query"], [(t, c * weights[t]) for t, c in Counter(r["terms"]).items() if weights.get(t)]) for r in block.collect()]
    sent = spark.sparkContext.broadcast([(q, found) for q, found in queries if found])
    documents, total, id_arrow = index.documents, index.terms, to_arrow_type(id_type)

    def shard(table: pa.Table) -> pa.Table:
        head = table.filter(pc.is_null(table["term"]))
        ids = head["doc_ids"][0].as_py()
        m = lengths(np.array(head["sizes"][0].as_py(), dtype=np.int64), documents, total)
        place = np.empty(len(ids), dtype=np.int64)
        place[sorted(range(len(ids)), key=lambda d: (ids[d] is None, ids[d] if ids[d] is not None else 0))] = np.arange(len(ids))
        rows = table.filter(pc.is_valid(table["term"])).sort_by("term")
        names, numbers = rows["term"].to_pylist(), {x: rows[x].to_numpy() for x in ("block", "first", "last", "top")}
        data, lists, a = rows["data"].to_pylist(), {}, 0
        for z in [k for k in range(1, len(names) + 1) if k == len(names) or names[k] != names[k - 1]]:
            lists[names[a]] = PostingList(*[numbers[x][a:z] for x in ("block", "first", "last", "top")], data[a:z], m)
            a = z
        out: list[tuple] = []
        for query, weighted in sent.value:
            held = [(lists[t], w) for t, w in weighted if t in lists]
            out += [(query, ids[d], score) for d, score in (best_of_shard(held, place, k) if held else [])]
        kinds = [pa.int64(), id_arrow, pa.int64()]
        cols = list(zip(*out, strict=True)) or [[], [], []]
        return pa.table([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["query", "doc_id", "score"])

    columns = ["shard", "term", "block", "first", "last", "top", "data", "doc_ids", "sizes"]
    both = hits.select(*columns).unionByName(index.rows.filter("term IS NULL").select(*columns))
    return both.groupBy("shard").applyInArrow(shard, f"query long, doc_id {id_type.simpleString()}, score long")
