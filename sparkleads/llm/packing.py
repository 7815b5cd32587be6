"""Cost-balanced packing of token sequences.

Each task packs the documents of its own input split in chunks, so nothing is shuffled. In a
chunk, whole sequences' worth of a document fill sequences alone; what remains of the documents
goes, longest first, to the sequence of the lowest cost (linear plus quadratic attention) that
has room. What fits nowhere whole is cut in two or gets a sequence more.
"""

from __future__ import annotations

import functools
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

LENGTH = 1024
#: Documents that are packed together; also bounds a task's memory.
CHUNK_DOCS = 4096
CHUNK_TOKENS = 8_000_000
CHUNK_CHARS = 8_000_000
#: Cost of n tokens of one document in a sequence: LINEAR * n + QUADRATIC * n * n.
LINEAR, QUADRATIC = 1.0, 1.0 / 1024

PIECES = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


#: Cuts, at most, of what is left of a document longer than a sequence. Shorter documents are cut once at most.
LONG_CUTS = 3


def cost(n: int) -> float:
    return LINEAR * n + QUADRATIC * n * n


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 for itself, the others from 256 on in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Encoder:
    """Ids of a byte-level vocabulary, a file of the library tokenizers, as little-endian unsigned 32-bit bytes, for many texts at once.

    A space after a character that isn't white space always begins a pre-token of such vocabularies. So texts
    are cut at spaces, the stretches not met before are encoded together, and each text joins the ids of its
    stretches. Texts with a space after white space are encoded whole. Both are done by tiktoken over the file's own vocabulary,
    several times faster and with the same ids; texts that hold an added token go to the library tokenizers.
    """

    #: Stretches that are remembered, and characters that are encoded together.
    MOST, TOGETHER = 600_000, 1_000_000

    def __init__(self, vocabulary: str, pattern: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        letters = byte_letters()
        ranks = {bytes(letters[c] for c in token): k for token, k in self.tokenizer.get_vocab(with_added_tokens=False).items() if token not in self.added}
        self.encoding = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.token_bytes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, k in ranks.items():
            self.token_bytes[k] = len(token)
        self.known: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        if any(a in text for a in self.added):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = self.encoding.encode_ordinary(text)
        return np.array(ids, dtype="<u4").tobytes()

    def learn(self, stretches: set[str]) -> None:
        """Encodes stretches as they stand after a space. Those that end in white space are left out."""
        fresh = [x for x in stretches if x and not x[-1].isspace()]
        sizes = np.cumsum([len(x.encode()) + 1 for x in fresh])
        first = 0
        while first < len(fresh):
            before = int(sizes[first - 1]) if first else 0
            last = max(first + 1, int(np.searchsorted(sizes, before + self.TOGETHER, side="right")))
            ids = np.array(self.encoding.encode_ordinary(" " + " ".join(fresh[first:last])), dtype="<u4")
            data, stops, start = ids.tobytes(), np.cumsum(self.token_bytes[ids]), 0
            for x, end in zip(fresh[first:last], (4 * np.searchsorted(stops, sizes[first:last] - before, side="right")).tolist(), strict=True):
                self.known[x] = data[start:end]
                start = end
            first = last

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [text.split(" ") for text in texts]
        stretches: set[str] = set()
        for parts in cut:
            stretches.update(parts)
        fresh = stretches.difference(self.known)
        if len(self.known) + len(fresh) > self.MOST:
            self.known.clear()
            fresh = stretches
        self.learn(fresh)
        find, out = self.known.__getitem__, []
        for text, parts in zip(texts, cut, strict=True):
            try:
                after = None if any(a in text for a in self.added) else b"".join(map(find, parts[1:]))
            except KeyError:
                after = None
            out.append(self.whole(text) if after is None else (self.whole(parts[0]) if parts[0] else b"") + after)
        return out


@functools.cache
def encoder(vocabulary: str, pattern: str) -> Encoder:
    """One for each Python worker, kept from task to task."""
    return Encoder(vocabulary, pattern)


def pack(sizes: list[int], length: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """(document, start, tokens, sequence, offset) of each piece. Sequences number from 0.

    Whole sequences' worth of a document stand alone. Shorter documents, the longest first, and then what is left of the long ones go whole to the cheapest
    sequence with room. What fits nowhere is cut: a short document into two pieces, for the largest room and the cheapest that takes the rest, what is left of a
    long one into a few for the largest rooms. Only where that can't be it gets one more sequence. Ties in size go by position, ties in cost by sequence. Documents without tokens have no piece.
    """
    pieces, bins, rest = [], 0, []
    for d, size in enumerate(sizes):
        whole, left = divmod(size, length)
        for k in range(whole):
            pieces.append((d, k * length, length, bins, 0))
            bins += 1
        if left:
            rest.append((left, d, whole * length))
    rest.sort(key=lambda x: (-x[0], x[1]))
    used: list[int] = []
    spent: list[float] = []
    # By the room that sequences have left: a heap of (cost, sequence) for each room, and the least cost of each heap.
    heaps: list[list[tuple[float, int]]] = [[] for _ in range(length + 1)]
    least = np.full(length + 1, np.inf)

    def more() -> None:
        heapq.heappush(heaps[length], (0.0, len(used)))
        least[length] = 0.0
        used.append(0)
        spent.append(0.0)

    def room(n: int) -> int:
        """The room of the cheapest sequence that takes `n` tokens; of equally cheap ones, the one with the least room. 0 if none does."""
        at = n + int(np.argmin(least[n:]))
        return at if np.isfinite(least[at]) else 0

    def put(d: int, start: int, n: int, left: int) -> None:
        """Puts `n` tokens into the cheapest sequence with `left` of room."""
        _, b = heapq.heappop(heaps[left])
        least[left] = heaps[left][0][0] if heaps[left] else np.inf
        pieces.append((d, start, n, bins + b, used[b]))
        used[b] += n
        spent[b] += cost(n)
        if left > n:
            heapq.heappush(heaps[left - n], (spent[b], b))
            least[left - n] = heaps[left - n][0][0]

    needed = sum(x[0] for x in rest) // length
    for _ in range(needed):
        more()
    unplaced = []
    for left, d, start in sorted(rest, key=lambda x: x[2] > 0):  # whole documents before what is left of long ones
        if at := room(left):
            put(d, start, left, at)
        else:
            unplaced.append((left, d, start))
    for left, d, start in unplaced:
        cuts, most = 0, LONG_CUTS if start else 1
        while not (at := room(left)):
            with_room = np.flatnonzero(np.isfinite(least))
            n = int(with_room[-1]) if len(with_room) else 0
            if not n or cuts == most:
                more()
            elif most > 1 or _fits_beside(heaps, least, n, left - n):
                put(d, start, n, n)
                start, left, cuts = start + n, left - n, cuts + 1
            else:
                more()
        put(d, start, left, at)
    return pieces


def _fits_beside(heaps: list[list[tuple[float, int]]], least: np.ndarray, taken: int, n: int) -> bool:
    """Whether a sequence other than one with `taken` of room takes `n` tokens."""
    return bool(np.isfinite(least[n:taken]).any() or np.isfinite(least[max(n, taken + 1) :]).any() or (n <= taken and len(heaps[taken]) > 1))


def packed(docs: DataFrame, vocabulary: str, pattern: str, end_id: int = 0, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of all documents: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    A document is its text's ids and then `end_id`; null texts are empty, so every row has at least one
    token, and repeated rows are packed each. Sequence ids are unique, not gapless. An empty table has no
    pieces. `vocabulary`, a byte-level file of the library tokenizers with that `pattern`, must be readable on every executor; strings of its added tokens have
    their ids. Ids of documents keep their type.
    """
    id_type = docs.schema[doc_id].dataType
    id_arrow = to_arrow_type(id_type)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, pattern).encode
        end = end_id.to_bytes(4, "little")
        next_id = TaskContext.get().partitionId() << 40
        docs: list[tuple[int | None, bytes]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal next_id, docs
            pieces = pack([len(x) // 4 for _, x in docs], length)
            rows = [(docs[d][0], s, n, docs[d][1][4 * s : 4 * (s + n)], len(docs[d][1]) // 4, next_id + b, o) for d, s, n, b, o in pieces]
            next_id += max((x[3] for x in pieces), default=-1) + 1
            docs = []
            for k in range(0, len(rows), 5000):
                cols = list(zip(*rows[k : k + 5000], strict=True))
                kinds = [id_arrow, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        held = 0
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), [x or "" for x in batch.column(1).to_pylist()]
            first = 0
            while first < len(texts):
                last, chars = first, 0
                while last < len(texts) and last - first < CHUNK_DOCS and chars < CHUNK_CHARS:
                    chars += len(texts[last])
                    last += 1
                for key, ids in zip(keys[first:last], encode(texts[first:last]), strict=True):
                    docs.append((key, ids + end))
                    held += len(ids) // 4 + 1
                first = last
                if len(docs) >= CHUNK_DOCS or held >= CHUNK_TOKENS:
                    yield from flush()
                    held = 0
        if docs:
            yield from flush()

    narrow = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return narrow.mapInArrow(task, f"doc_id {id_type.simpleString()}, {PIECES}")


def ids_crc32(pieces: DataFrame) -> DataFrame:
    """The pieces with `ids_crc32` in place of their ids."""
    return pieces.withColumn("ids_crc32", F.crc32("ids").cast("long")).drop("ids")
