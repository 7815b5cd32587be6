"""Repair of conversations' structure by an automaton that all conversations share.

Each conversation is spelt as a signature, one symbol a row: the role's initial and the row's fault. Signatures are minimised from the end:
a node stands for one suffix, whatever conversations end in it. Sorted by their reversed text, signatures that end alike are
neighbours, so one walk builds each node once, on top of the node of the shorter suffix. A node knows, for each state of the
grammar, the least cost to go and the first letter of the best audit suffix, whose rest the next node knows. Spark sorts the rows of conversations and the
signatures; tasks stream through them and hold one conversation's symbols, never its texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import scratch, written

BLANKS = " \t\n\x0b\x0c\r"
#: A row that must go; other rows have their role's initial, upper-case if truncated, or `o` for any other role.
GOES = "x"
#: Costs of edits: keep, give another role, delete, insert, and what an undeleted truncated row adds.
KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
#: The grammar's states: at the start, after system, after user, after assistant. What must follow is an assistant after user, else a user; a
#: system row may open. A conversation may end at the start or after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
STATS = ["gaps", "blank", "duplicate", "truncated", "illegal"]


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with conv_id, turn, role, text and `copies`, how often the row stands there, after a damage that follows from conv_id and turn. Nulls
    of role and text become one space. Repeated rows and rows with equal turns are damaged alike."""
    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.pmod(F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")), F.lit(20))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), shown("role").alias("role"), shown("text").alias("text"), kind.alias("_kind"))
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("_kind") == 0, 0).when(F.col("_kind") == 3, 2).otherwise(1).alias("copies"))


def spelt(rows: DataFrame) -> DataFrame:
    """The rows of every conversation in order, each with its fault and symbol: conv_id, turn, role, text, there, fault, symbol.

    The order is that of turn, nulls first, then role and text. A row that has gone (`copies` 0) comes last with `there` false, so that
    its conversation is known. One shuffle by conversation serves the search for duplicates, the order and the walk.
    """
    there = F.col("copies") > 0
    dealt = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.greatest("copies", F.lit(1))))).withColumn("there", there).repartition("conv_id")
    same = Window.partitionBy("conv_id", "there", "role", F.md5("text")).orderBy(F.asc_nulls_first("turn"))
    kept = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = (
        F.when(kept == "", "blank").when(F.col("_nth") > 1, "duplicate").when(~F.right(kept, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("")
    )
    initial = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("o")
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), GOES).when(F.col("fault") == "truncated", F.upper(initial)).otherwise(initial)
    marked = dealt.withColumn("_nth", F.row_number().over(same)).withColumn("fault", fault).withColumn("symbol", symbol).withColumn("initial", initial)
    order = ["conv_id", F.desc("there"), F.asc_nulls_first("turn"), "role", "text", "_nth"]
    return marked.sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "there", "fault", "symbol", "initial")


class Spelling:
    """What one conversation's rows add up to, one symbol a row held."""

    def __init__(self, conv_id: object) -> None:
        self.conv_id, self.symbols, self.last, self.turn = conv_id, bytearray(), "", None
        self.first_turn, self.turns = None, 0
        self.counts = dict.fromkeys(STATS, 0)

    def add(self, turn: int | None, fault: str, symbol: str, initial: str) -> None:
        if self.symbols and self.last + initial not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        self.last = initial
        self.symbols += symbol.encode()
        if fault:
            self.counts[fault] += 1
        if turn is not None:
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.turns += turn != self.turn
            self.turn = turn

    def row(self) -> tuple:
        if self.turn is not None:
            self.counts["gaps"] = self.turn - self.first_turn + 1 - self.turns
        return (self.conv_id, -1, None, None, self.symbols.decode(), *[self.counts[x] for x in STATS])


def signatures(rows: DataFrame) -> DataFrame:
    """The rows of `spelt` with `at`, their place, and after those of each conversation one with `at` -1, its signature and statistics."""
    id_type = rows.schema["conv_id"].dataType
    kinds = [to_arrow_type(id_type), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.int64()] * 5]
    names = ["conv_id", "at", "role", "text", "signature", *STATS]

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names=names)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Spelling | None = None
        for batch in batches:
            cols = {x: batch.column(x).to_pylist() for x in ("conv_id", "turn", "there", "fault", "symbol", "initial")}
            at, done = [], []
            for conv_id, turn, there, fault, symbol, initial in zip(*cols.values(), strict=True):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        done.append(now.row())
                    now = Spelling(conv_id)
                at.append(len(now.symbols))
                if there:
                    now.add(turn, fault, symbol, initial)
            keep = batch.column("there")
            part = [batch.column("conv_id"), pa.array(at, pa.int64()), batch.column("role"), batch.column("text"), pa.nulls(len(at), pa.string())]
            yield pa.RecordBatch.from_arrays([*part, *[pa.nulls(len(at), pa.int64())] * 5], names=names).filter(keep)
            if done:
                yield batch_of(done)
        if now is not None:
            yield batch_of([now.row()])

    schema = f"conv_id {id_type.simpleString()}, at long, role string, text string, signature string, {', '.join(f'{x} long' for x in STATS)}"
    return rows.select("conv_id", "turn", "role", "text", "there", "fault", "symbol", "initial").mapInArrow(task, schema)


#: Least cost to go and first letter of the audit, by state.
Node = tuple[tuple[int, str], ...]
END: Node = ((0, ""), (2 * INSERT, "I"), (INSERT, "I"), (0, ""))


def following(state: int) -> int:
    """The state after the user or assistant row that `state` asks for."""
    return ASSISTANT if state == USER else USER


def node(symbol: str, rest: Node) -> Node:
    """The node of a suffix that begins with `symbol` and goes on with `rest`. Edits have different letters, so the cheapest, then the
    ASCII-least letter gives the least audit among the cheapest."""
    best: list[tuple[int, str]] = []
    for state in range(4):
        options = [(DELETE + rest[state][0], "D")]
        if symbol != GOES:
            extra, initial = CUT if symbol.isupper() else 0, symbol.lower()
            options.append((REROLE + extra + rest[following(state)][0], "R"))
            if initial == ("a" if state == USER else "u"):
                options.append((KEEP + extra + rest[following(state)][0], "K"))
            elif initial == "s" and state == START:
                options.append((KEEP + extra + rest[SYSTEM][0], "K"))
        best.append(min(options))
    for _ in range(2):  # a third insertion in a row leads back to a state that was cheaper before
        best = [min(best[state], (INSERT + best[following(state)][0], "I")) for state in range(4)]
    return tuple(best)


class SuffixPath:
    """The nodes of one signature's suffixes, shortest first. The next signature keeps those of its common ending."""

    def __init__(self) -> None:
        self.symbols, self.nodes, self.made = "", [END], 0

    def solve(self, signature: str) -> tuple[int, str]:
        """Least cost and best audit of a whole signature."""
        backwards = signature[::-1]
        common = 0
        for a, b in zip(self.symbols, backwards, strict=False):
            if a != b:
                break
            common += 1
        del self.nodes[common + 1 :]
        for symbol in backwards[common:]:
            self.nodes.append(node(symbol, self.nodes[-1]))
            self.made += 1
        self.symbols = backwards
        left, state, audit = len(signature), START, []
        while letter := self.nodes[left][state][1]:
            audit.append(letter)
            if letter == "I":
                state = following(state)
                continue
            left -= 1
            if letter != "D":
                opens = letter == "K" and signature[len(signature) - left - 1] in "sS"
                state = SYSTEM if opens else following(state)
        return self.nodes[-1][START][0], "".join(audit)


def audited(spelling: DataFrame) -> DataFrame:
    """The rows of conversations (conv_id, signature and what else is there) with cost and audit.

    They are sorted by reversed signature; a hash of the id lets a signature that very many conversations share spread over tasks.
    """
    columns = spelling.columns
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spelling.schema) + ", cost long, audit string"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = SuffixPath()
        for batch in batches:
            solved = [path.solve(s) for s in batch.column("signature").to_pylist()]
            more = [pa.array([c for c, _ in solved], pa.int64()), pa.array([a for _, a in solved], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*columns, "cost", "audit"])

    backwards = F.reverse("signature")
    return spelling.repartitionByRange(backwards, F.xxhash64("conv_id")).sortWithinPartitions(backwards).mapInArrow(task, schema)


class Repair:
    """Digests a conversation's repaired rows as they pass."""

    def __init__(self, conv_id: object, audit: str, stats: tuple) -> None:
        self.conv_id, self.audit, self.stats, self.at, self.state = conv_id, audit, stats, 0, START
        self.hash, self.begun = hashlib.sha256(), False

    def _out(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) if self.begun else ''}{role}:{text}".encode())
        self.begun = True

    def _insertions(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self._follow("")
            self.at += 1

    def _follow(self, text: str) -> None:
        self._out("assistant" if self.state == USER else "user", text)
        self.state = following(self.state)

    def add(self, role: str, text: str) -> None:
        self._insertions()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "R":
            self._follow(text)
        elif letter == "K":
            self._out(role, text)
            self.state = SYSTEM if role.startswith("s") else following(self.state)

    def row(self) -> tuple:
        self._insertions()
        return (self.conv_id, *self.stats, self.audit, self.hash.hexdigest())


def repaired(rows: DataFrame) -> DataFrame:
    """One row for each conversation of `rows` (conv_id, turn, role, text and `copies`): its faults, least cost, audit and the digest of its repaired rows.

    Roles and texts mustn't be null. A null conv_id is a conversation of its own; null turns come first and count for no gap; equal turns are ordered by role and
    text; a conversation whose rows have all gone has zeros, an empty audit and the digest of nothing; an empty table gives no rows. A conversation's digest is a
    sequence by nature: its rows pass one task in order, sorted on disk, and only its symbols are held.
    """
    folder = scratch(rows.sparkSession)
    plain = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", "copies")
    lines = written(signatures(spelt(plain)), folder, "lines")
    solved = written(audited(lines.filter("at < 0").select("conv_id", "signature", *STATS)).drop("signature"), folder, "audits")
    id_type = lines.schema["conv_id"].dataType
    kinds = [to_arrow_type(id_type), *[pa.int64()] * 6, pa.string(), pa.string()]
    names = ["conv_id", *STATS, "cost", "audit", "repaired_sha256"]
    heads = solved.select("conv_id", F.lit(-1).cast("long").alias("at"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), *STATS, "cost", "audit")
    body = lines.filter("at >= 0").select("conv_id", "at", "role", "text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Repair | None = None
        for batch in batches:
            done = []
            cols = [batch.column(x).to_pylist() for x in ("conv_id", "at", "role", "text", *STATS, "cost", "audit")]
            for conv_id, at, role, text, *stats, audit in zip(*cols, strict=True):
                if at < 0:
                    if now is not None:
                        done.append(now.row())
                    now = Repair(conv_id, audit, tuple(stats))
                else:
                    now.add(role, text)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], names=names)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(now.row(), kinds, strict=True)], names=names)

    schema = f"conv_id {id_type.simpleString()}, {', '.join(f'{x} long' for x in [*STATS, 'cost'])}, audit string, repaired_sha256 string"
    both = heads.unionByName(body, allowMissingColumns=True).select("conv_id", "at", "role", "text", *STATS, "cost", "audit")
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "at").mapInArrow(task, schema)
