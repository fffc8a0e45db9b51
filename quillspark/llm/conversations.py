"""Conversation structure repair: a forward Viterbi search over a grammar of turns.

A conversation's turns should read `s?(ua)+`, or be none: an optional system turn, then user and assistant in alternation. The
states of that grammar are START, after a SYSTEM turn, after a USER turn and after an ASSISTANT turn. Each row is kept,
reroled or deleted, which takes a state to a state at a cost, and after each row up to two insertions follow (a third would
come back to a state at a higher cost). Of all ways into a state the cheapest stays, of equally cheap ones that with the
smallest audit, the string of the edits' initials.

Rows of all conversations are range-sorted, so a long conversation goes over several tasks. As nobody knows there in which
state it begins, a block of rows is searched from each state; blocks are combined in order by the same rule. Only the digests
of texts take part in that. The repaired texts are hashed in a second pass, in which rows follow their conversation's audit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop

START, SYSTEM, USER, ASSISTANT = range(4)
#: Costs of edits; an undeleted row that is truncated costs TRUNCATED more.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Rows of one block.
BLOCK = 512
#: Where a turn of a role leads from a state, by its initial.
NEXT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
LEGAL = ("su", "ua", "au")
#: Where insertions lead from each state: edits and the state that they end in.
INSERTIONS = {s: [(INSERT, "I", USER), (2 * INSERT, "II", ASSISTANT)] for s in (START, SYSTEM, ASSISTANT)} | {USER: [(INSERT, "I", ASSISTANT), (2 * INSERT, "II", USER)]}
#: A row's faults.
FINE, BLANK, DUPLICATE, CUT_OFF = range(4)
Ways = dict[int, tuple[int, str]]


def closed(ways: Ways) -> Ways:
    """ways, with up to two insertions after each."""
    out = dict(ways)
    for state, (cost, audit) in ways.items():
        for more, edits, to in INSERTIONS[state]:
            way = cost + more, audit + edits
            if to not in out or way < out[to]:
                out[to] = way
    return out


def step(ways: Ways, initial: str, fault: int) -> Ways:
    """ways after one row, by state."""
    out: Ways = {}

    def offer(to: int, cost: int, audit: str) -> None:
        if to not in out or (cost, audit) < out[to]:
            out[to] = cost, audit

    extra = TRUNCATED if fault == CUT_OFF else 0
    for state, (cost, audit) in ways.items():
        offer(state, cost + DELETE, audit + "D")
        if fault in (BLANK, DUPLICATE):
            continue
        keep = NEXT.get(initial, {}).get(state)
        if keep is not None:
            offer(keep, cost + extra, audit + "K")
        for role in "ua":
            if role != initial and state in NEXT[role]:
                offer(NEXT[role][state], cost + REROLE + extra, audit + "R")
    return closed(out)


def joined(ways: Ways, block: dict[int, Ways]) -> Ways:
    """ways, continued by a block's ways from each state."""
    out: Ways = {}
    for state, (cost, audit) in ways.items():
        for to, (more, edits) in block[state].items():
            way = cost + more, audit + edits
            if to not in out or way < out[to]:
                out[to] = way
    return out


_LONG, _TEXT = pa.int64(), pa.string()
_PIECE = [("part", pa.int32()), ("number", _LONG), ("lo", _LONG), ("hi", _LONG), ("turns", _LONG), ("blank", _LONG), ("duplicate", _LONG), ("truncated", _LONG), ("illegal", _LONG), ("first", _TEXT), ("last", _TEXT), ("ways", pa.list_(pa.struct([("state", pa.int32()), ("to", pa.int32()), ("cost", _LONG), ("audit", _TEXT)])))]
PIECE = "part int, number long, lo long, hi long, turns long, blank long, duplicate long, truncated long, illegal long, first string, last string, ways array<struct<state: int, to: int, cost: long, audit: string>>"


class _Block:
    """A run of rows of one conversation."""

    def __init__(self) -> None:
        self.ways: dict[int, Ways] = {s: {s: (0, "")} for s in range(4)}
        self.rows = 0
        self.lo = self.hi = self.first = self.last = None
        self.turns = self.illegal = 0
        self.faults = [0, 0, 0, 0]

    def add(self, turn: int | None, initial: str, fault: int) -> None:
        if turn is not None and turn != self.hi:
            self.turns += 1
            self.lo, self.hi = turn if self.lo is None else self.lo, turn
        if self.rows:
            self.illegal += self.last + initial not in LEGAL
        else:
            self.first = initial
        self.last = initial
        self.faults[fault] += 1
        self.rows += 1
        self.ways = {s: step(w, initial, fault) for s, w in self.ways.items()}

    def piece(self, part: int, number: int) -> dict:
        ways = [{"state": s, "to": t, "cost": c, "audit": a} for s, w in self.ways.items() for t, (c, a) in w.items()]
        values = (part, number, self.lo, self.hi, self.turns, *self.faults[1:], self.illegal, self.first, self.last, ways)
        return dict(zip((n for n, _ in _PIECE), values))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (conv_id, turn, initial, fault, again, copies) to pieces with their conversation. A row has `copies` equal
    ones, of which the first has its own fault and the others `again`; none stand for a conversation that has no row here."""
    part, number = TaskContext.get().partitionId(), 0
    ids: list = []
    pieces: list[dict] = []
    now, block = object(), None
    for b in batches:
        for conv_id, turn, initial, fault, again, copies in zip(*(c.to_pylist() for c in b.columns)):
            if conv_id != now or block is None:
                if block is not None:
                    ids.append(now)
                    pieces.append(block.piece(part, number))
                    number += 1
                now, block = conv_id, _Block()
            for i in range(copies):
                if block.rows == BLOCK:
                    ids.append(now)
                    pieces.append(block.piece(part, number))
                    number += 1
                    block = _Block()
                block.add(turn, initial, again if i else fault)
        if len(pieces) >= 1024:
            yield _pieces(ids, pieces)
            ids, pieces = [], []
    if block is not None:
        ids.append(now)
        pieces.append(block.piece(part, number))
    yield _pieces(ids, pieces)


def _pieces(ids: list, pieces: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *[pa.array([p[n] for p in pieces], k) for n, k in _PIECE]], ["conv_id", *[n for n, _ in _PIECE]])


RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


class _Whole:
    """A conversation as its pieces come, in order."""

    def __init__(self) -> None:
        self.ways = closed({START: (0, "")})
        self.lo = self.hi = self.last = None
        self.turns = self.illegal = self.blank = self.duplicate = self.truncated = 0

    def add(self, lo, hi, turns, blank, duplicate, truncated, illegal, first, last, ways) -> None:
        if first is None:  # no rows
            return
        if lo is not None:
            self.turns += turns - (lo == self.hi)
            self.lo, self.hi = lo if self.lo is None else self.lo, hi
        self.illegal += illegal + (self.last is not None and self.last + first not in LEGAL)
        self.last = last
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + duplicate, self.truncated + truncated
        block: dict[int, Ways] = {s: {} for s in range(4)}
        for w in ways:
            block[w["state"]][w["to"]] = w["cost"], w["audit"]
        self.ways = joined(self.ways, block)

    def row(self, conv_id) -> tuple:
        gaps = 0 if self.lo is None else self.hi - self.lo + 1 - self.turns
        cost, audit = min(self.ways[s] for s in (START, ASSISTANT) if s in self.ways)
        return conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces, sorted by conversation and place, to a row for each conversation."""
    names, kinds = zip(*((n, {"long": _LONG, "string": _TEXT}[k]) for n, k in (x.split() for x in RESULT.split(", "))))
    rows: list[tuple] = []
    now, whole = object(), None
    for b in batches:
        for conv_id, _, _, *rest in zip(*(c.to_pylist() for c in b.columns)):
            if whole is None or conv_id != now:
                if whole is not None:
                    rows.append(whole.row(now))
                now, whole = conv_id, _Whole()
            whole.add(*rest)
        if len(rows) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], list(names))
            rows = []
    if whole is not None:
        rows.append(whole.row(now))
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * len(kinds), kinds)], list(names))


class _Repaired:
    """The repaired turns of a conversation, hashed as its rows come by its audit."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state = audit, 0, START
        self.hash, self.some = hashlib.sha256(), False

    def turn(self, role: str | None, text: str) -> None:
        initial = role[:1] if role else "a" if self.state == USER else "u"
        if role is None:
            role = {"u": "user", "a": "assistant"}[initial]
        self.state = NEXT[initial][self.state]
        self.hash.update((("\n" if self.some else "") + f"{role}:{text}").encode())
        self.some = True

    def insertions(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.turn(None, "")
            self.at += 1

    def add(self, role: str, text: str) -> None:
        self.insertions()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.turn(role, text)
        elif edit == "R":
            self.turn(None, text)

    def digest(self) -> str:
        self.insertions()
        return self.hash.hexdigest()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, audit, role, text), each conversation's audit before its rows in order, to (conv_id, repaired_sha256)."""
    ids: list = []
    digests: list[str] = []
    now, repaired = None, None
    for b in batches:
        for conv_id, audit, role, text in zip(*(c.to_pylist() for c in b.columns)):
            if audit is not None:
                if repaired is not None:
                    ids.append(now)
                    digests.append(repaired.digest())
                now, repaired = conv_id, _Repaired(audit)
            else:
                repaired.add(role, text)
        if len(ids) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(ids, _LONG), pa.array(digests, _TEXT)], ["conv_id", "repaired_sha256"])
            ids, digests = [], []
    if repaired is not None:
        ids.append(now)
        digests.append(repaired.digest())
    yield pa.RecordBatch.from_arrays([pa.array(ids, _LONG), pa.array(digests, _TEXT)], ["conv_id", "repaired_sha256"])


def damaged(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) with planted faults, by crc32 of `conv_id:turn` modulo 20: 0 has no copies left, 1 an
    empty text, 2 a text without `[.!?]`, 3 two copies, 4 the role user. Nulls count as one space, in roles and texts for good."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    kind = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce("role", blank), F.coalesce("text", blank)
    new = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), new.alias("text"), copies.alias("copies"))


def _fault(text: Column) -> Column:
    return F.when(~text.rlike(r"[^\x20\x09-\x0D]"), BLANK).when(~text.rlike(r"[.!?][\x20\x09-\x0D]*\z"), CUT_OFF).otherwise(FINE)


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation of rows
    (conv_id, turn, role, text, copies), where copies (0 for none) says how often the row is there.

    A conversation's rows go by turn, nulls first; rows of one turn by role and by the MD5 digest of their text, so equal rows
    are next to one another. gaps are the turns missing between the first and the last one. A row's fault is blank (nothing
    but ASCII white space), else duplicate (role and text were there before), else truncated (its last character but white
    space is none of `.!?`); illegal are the neighbours whose roles' initials are none of LEGAL. cost and audit are of the
    cheapest repair (of equal ones the smallest audit); the digest is of its turns, `role:text`, with line feeds between.

    Null ids are one conversation. A conversation of no copies has zeros, an empty audit and the digest of nothing. Null roles
    and texts are one space, roles may be anything, texts and conversations of any length: no task holds a conversation's
    texts, its audit has about a letter for each row. Only the digest is taken row by row in one task, as SHA-256 is. Other
    columns are left out; no rows give none.
    """
    blank = F.lit(" ")
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), F.col("copies").cast("long").alias("copies"))
    rows = rows.withColumn("digest", F.unhex(F.md5("text")))
    there = F.col("copies") > 0
    small = rows.select("conv_id", *[F.when(there, c).alias(n) for c, n in ((F.col("turn"), "turn"), (F.col("role"), "role"), (F.col("digest"), "digest"), (_fault(F.col("text")), "fault"))], "copies")
    keys = ("conv_id", "turn", "role", "digest", "fault")
    distinct = cut(small.groupBy(*keys).agg(F.sum("copies").alias("copies")), "turns-distinct")
    # turns in which a role says a text, the first and how many there are: nulls come first
    said = distinct.where("copies > 0").groupBy("conv_id", "role", "digest").agg(F.min(F.struct(F.col("turn").isNotNull().alias("some"), "turn")).alias("first"), F.count(F.lit(1)).alias("turns")).where("turns > 1")
    said = cut(said.select(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("digest").alias("_digest"), F.col("first.turn").alias("_turn")), "turns-said")
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest"))
    late = F.col("_role").isNotNull() & ~F.col("turn").eqNullSafe(F.col("_turn"))
    again = F.when(F.col("fault") == BLANK, BLANK).otherwise(DUPLICATE)
    marked = distinct.join(said, same, "left").select("conv_id", "turn", "role", "digest", F.coalesce(F.substring("role", 1, 1), F.lit("")).alias("initial"), F.when(late, again).otherwise(F.col("fault")).alias("fault"), again.alias("again"), "copies")
    marked = cut(marked, "turns-marked")
    order = ("conv_id", "turn", "role", "digest")
    pieces = marked.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "initial", "fault", "again", "copies").mapInArrow(_blocks, f"conv_id long, {PIECE}")
    told = cut(pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "number").mapInArrow(_combine, RESULT), "turns-told")
    texts = _copied(rows)
    by_conv = told.select("conv_id", "audit", *[F.lit(None).cast(k).alias(c) for c, k in (("turn", "long"), ("role", "string"), ("digest", "binary"), ("text", "string"))])
    order = (F.col("conv_id"), F.col("audit").desc_nulls_last(), F.col("turn"), F.col("role"), F.col("digest"))
    hashed = by_conv.unionByName(texts).repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "audit", "role", "text").mapInArrow(_hashed, "conv_id long, repaired_sha256 string")
    out = told.join(hashed.toDF("_conv", "repaired_sha256"), F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    drop(distinct, said, marked)
    return out


def _copied(rows: DataFrame) -> DataFrame:
    """A row for each copy, without an audit."""
    each = F.explode(F.array_repeat(F.lit(None).cast("string"), F.col("copies").cast("int")))
    return rows.where("copies > 0").select("conv_id", each.alias("audit"), "turn", "role", "digest", "text")
