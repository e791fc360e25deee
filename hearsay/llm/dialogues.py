"""Conversation structure repair by Knuth's lightest derivations.

Rows of a conversation are in order of ``turn`` (null first), role and the md5 of the
text.  A repair edits them so that the role initials read ``(s?(ua)+)?``: Keep costs 0,
Rerole to user or assistant 2, Delete 3, Insert of an empty user or assistant row 2, and
a truncated row that is not deleted 1 more; blank and duplicate rows have to be deleted.
The audit is the string of the edits' initials.

Items are ``(row, state)``: the lightest repair of all rows from there on, entered in a
state of the pattern (nothing, s, u or a read).  Every edit is a deduction with a weight
function that adds a cost and puts a letter before the audit; blocks of rows are joined
by deductions with two premises.  Weights compare by cost, rows covered, audit: every
function is superior (a step costs something or covers a row) and monotone (repairs of
the same rows and cost differ before either audit ends).  The agenda pops the least, which
is then final, until the goal is.

A conversation of any length is worked in parts: rows are dealt by ranges of the order;
a task repairs whole conversations at once and turns one that other tasks share, or a
long one, into blocks that state their weights for every pair of states.  The blocks of a
conversation are a few rows.  Texts travel once, to the task that applies the audit row
by row as a stream.

Defined cases: null roles and texts count as one space, null conversation ids are one
conversation; equal rows are duplicates of the first; a role whose initial is none of
s, u, a cannot be kept; an empty table gives an empty table; other columns are left out.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Hashable, Iterable, Iterator, Sequence
from dataclasses import astuple, dataclass
from functools import lru_cache
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearsay.llm.words import same
from hearsay.session import cut_lineage

VISIBLE = r"[^\x20\x09-\x0D]"
ENDED = r"[.!?][\x20\x09-\x0D]*\z"
ENDS = "[.!?]"
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
BLOCK = 256            # rows of one block of a long or shared conversation
KNOWN = 50_000         # patterns of whole conversations that a task remembers
ROLES = {"u": "user", "a": "assistant"}
#: state after reading an initial: 0 nothing, 1 s, 2 u, 3 a
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
FROM = {(s, x): [p for (p, y), q in NEXT.items() if q == s and y == x] for s in range(4) for x in "sua"}
FINAL = (0, 3)
LEGAL = frozenset({"su", "ua", "au"})

Weight = tuple[int, int, str]     # cost, rows covered, audit
OK, CUT, GONE = 0, 1, 2           # faults of a row: none, truncated, blank or duplicate


# ---------------------------------------------------------------- the agenda

def lightest(axioms: Iterable[tuple[Hashable, Weight]],
             conclude: Callable[[Hashable, Weight], Iterable[tuple[Hashable, Weight]]],
             goals: frozenset) -> dict[Hashable, Weight]:
    """Final weights of the goals that can be derived; stops with the last of them."""
    agenda = [(w, item) for item, w in axioms]
    heapq.heapify(agenda)
    final: dict[Hashable, Weight] = {}
    missing = set(goals)
    while agenda and missing:
        weight, item = heapq.heappop(agenda)
        if item in final:
            continue
        final[item] = weight
        missing.discard(item)
        for new, w in conclude(item, weight):
            if new not in final:
                heapq.heappush(agenda, (w, new))
    return {g: final[g] for g in goals if g in final}


def edits(rows: Sequence[tuple[str, int]]) -> Callable:
    """Deductions over ``(initial, fault)`` rows, from the end to the start."""
    def conclude(item, weight):
        (i, state), (cost, size, audit) = item, weight
        for x in "ua":
            for before in FROM[state, x]:
                yield (i, before), (cost + INSERT, size, "I" + audit)
        if i == 0:
            return
        initial, fault = rows[i - 1]
        yield (i - 1, state), (cost + DELETE, size + 1, "D" + audit)
        if fault == GONE:
            return
        extra = TRUNCATED if fault == CUT else 0
        for before in FROM.get((state, initial), ()):
            yield (i - 1, before), (cost + extra, size + 1, "K" + audit)
        for x in "ua":
            for before in FROM[state, x]:
                yield (i - 1, before), (cost + REROLE + extra, size + 1, "R" + audit)
    return conclude


@lru_cache(maxsize=KNOWN)
def repair(rows: tuple[tuple[str, int], ...]) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    goal = (0, 0)
    found = lightest([((len(rows), s), (0, 0, "")) for s in FINAL], edits(rows), frozenset([goal]))[goal]
    return found[0], found[2]


def block_weights(rows: Sequence[tuple[str, int]]) -> dict[tuple[int, int], Weight]:
    """Lightest repair of a block for every pair of entry and exit state."""
    out = {}
    for leave in range(4):
        goals = frozenset((0, s) for s in range(4))
        for (_, enter), w in lightest([((len(rows), leave), (0, 0, ""))], edits(rows), goals).items():
            out[enter, leave] = w
    return out


def joined(blocks: list[dict[tuple[int, int], Weight]]) -> tuple[int, str]:
    """Cost and audit of a conversation from its blocks in order."""
    def conclude(item, weight):
        b, state = item
        if b:
            for (enter, leave), w in blocks[b - 1].items():
                if leave == state:
                    yield (b - 1, enter), (w[0] + weight[0], w[1] + weight[1], w[2] + weight[2])

    goal = (0, 0)
    found = lightest([((len(blocks), s), (0, 0, "")) for s in FINAL], conclude, frozenset([goal]))[goal]
    return found[0], found[2]


# ---------------------------------------------------------------- rows

def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with seeded faults: one row in twenty dropped, emptied, stripped of its
    sentence ends, repeated, or given the role ``user``, by crc32 of ``conv_id:turn``."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    kind = F.crc32(F.concat(named[0], F.lit(":"), named[1])) % 20
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(named[2]).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(named[3], ENDS, "")).otherwise(named[3]).alias("text"),
        kind.alias("_kind")).where("_kind <> 0")
    return rows.withColumn("_copy", F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1)))
                                              .otherwise(F.array(F.lit(0))))).drop("_kind", "_copy")


def _ordered(turns: DataFrame) -> DataFrame:
    clean = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"))
    return clean.withColumn("digest", F.md5("text"))


def faults(turns: DataFrame) -> DataFrame:
    """Distinct rows with how often they are there, their faults and whether the first of
    them is the first of its role and text in the conversation."""
    rows = _ordered(turns).select(
        "conv_id", "turn", "role", "digest", (~F.col("text").rlike(VISIBLE)).alias("blank"),
        (~F.col("text").rlike(ENDED)).alias("cut"))
    rows = rows.groupBy("conv_id", "turn", "role", "digest", "blank", "cut").agg(F.count(F.lit(1)).alias("n"))
    first = rows.groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn")).alias("_first"))
    return (same(rows, first, ["conv_id", "role", "digest"])
            .withColumn("first", F.struct("turn").eqNullSafe(F.col("_first"))).drop("_first"))


_KINDS = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def _schema(text: str) -> pa.Schema:
    return pa.schema([(name, _KINDS[kind]) for name, kind in (part.split() for part in text.split(", "))])


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns])


def _batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 5_000) -> Iterator[pa.RecordBatch]:
    rows = iter(rows)
    while some := list(islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), schema)], schema=schema)


_FAULTS = ("conv_id", "turn", "role", "blank", "cut", "first", "n")
_INFO = "n_blank bigint, n_duplicate bigint, n_truncated bigint, n_illegal bigint, n_turns bigint, low bigint, high bigint, head string, tail string"
_BLOCK = f"conv_id bigint, no bigint, enter int, leave int, cost bigint, covered bigint, audit string, {_INFO}"
RESULT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
_RESULT = ("conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
           "cost bigint, audit string")


@dataclass(frozen=True)
class Info:
    """Counts of neighbouring rows, with what counts across the border of two blocks need."""
    blank: int
    duplicate: int
    truncated: int
    illegal: int
    turns: int
    low: int | None
    high: int | None
    head: str
    tail: str


def block_info(rows: list[tuple]) -> Info:
    """``rows`` are (turn, initial, fault, blank) in order."""
    marks = [r[1] for r in rows]
    told = [r[0] for r in rows if r[0] is not None]
    return Info(sum(r[3] for r in rows), sum(r[2] == GONE and not r[3] for r in rows),
                sum(r[2] == CUT for r in rows), sum(a + b not in LEGAL for a, b in zip(marks, marks[1:])),
                sum(a != b for a, b in zip(told, told[1:])) + bool(told), told[0] if told else None,
                told[-1] if told else None, marks[0], marks[-1])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per conversation one row with its repair, or blocks where others share or follow it."""
    def stated(conv, no: int, rows: list[tuple], whole: bool) -> Iterator[tuple]:
        info = astuple(block_info(rows))
        pairs = tuple((r[1], r[2]) for r in rows)
        if whole:
            cost, audit = repair(pairs)
            yield (conv, no, None, None, cost, len(rows), audit, *info)
        else:
            for (enter, leave), (cost, size, audit) in block_weights(pairs).items():
                yield (conv, no, enter, leave, cost, size, audit, *info)

    def run() -> Iterator[tuple]:
        current, held, no, begun = None, [], 0, True
        for conv, turn, role, blank, cut, first, n in _rows(batches):
            if current != (conv,):
                if current is not None:
                    # the first conversation of a task may have begun in another one
                    yield from stated(current[0], no, held, not begun and no == 0)
                    begun = False
                current, held, no = (conv,), [], 0
            for k in range(n):
                if len(held) == BLOCK:
                    yield from stated(conv, no, held, False)
                    held, no = [], no + 1
                gone = blank or not (first and k == 0)
                held.append((turn, role[:1], GONE if gone else CUT if cut else OK, blank))
        if current is not None:
            yield from stated(current[0], no, held, False)   # and the last may go on

    return _batches(run(), _schema(_BLOCK))


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks in order of conversation and place -> one row per conversation."""
    def closed(conv, blocks: list[dict], infos: list[Info]) -> tuple:
        if (None, None) in blocks[0]:
            cost, _, audit = blocks[0][None, None]
        else:
            cost, audit = joined(blocks)
        told = [i for i in infos if i.low is not None]
        turns = sum(i.turns for i in told) - sum(a.high == b.low for a, b in zip(told, told[1:]))
        return (conv, told[-1].high - told[0].low + 1 - turns if told else 0,
                sum(i.blank for i in infos), sum(i.duplicate for i in infos), sum(i.truncated for i in infos),
                sum(i.illegal for i in infos) + sum(a.tail + b.head not in LEGAL for a, b in zip(infos, infos[1:])),
                cost, audit)

    def run() -> Iterator[tuple]:
        current, place, blocks, infos = None, None, [], []
        for conv, part, no, enter, leave, cost, size, audit, *info in _rows(batches):
            if current != (conv,):
                if current is not None:
                    yield closed(current[0], blocks, infos)
                current, place, blocks, infos = (conv,), None, [], []
            if place != (part, no):
                place = (part, no)
                blocks.append({})
                infos.append(Info(*info))
            blocks[-1][enter, leave] = (cost, size, audit)
        if current is not None:
            yield closed(current[0], blocks, infos)

    return _batches(run(), _schema(_RESULT))


def repairs(turns: DataFrame) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit)`` of every
    conversation that has a row."""
    order = ["conv_id", "turn", "role", "digest"]
    dealt = faults(turns).repartitionByRange(*order).sortWithinPartitions(*order).select(*_FAULTS)
    blocks = dealt.mapInArrow(_blocks, _BLOCK).withColumn("part", F.spark_partition_id())
    head = ["conv_id", "part", "no"]
    return (blocks.select(*head, *[c for c in blocks.columns if c not in head])
            .repartition("conv_id").sortWithinPartitions(*head).mapInArrow(_whole, _RESULT))


def _applied(whole: bool, schema: str):
    """Streams a conversation's audit and rows; emits repaired rows or their digest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        conv, audit, at, state, place, digest = None, "", 0, 0, 0, None

        def put(role: str, text: str, letter: str) -> tuple | None:
            nonlocal place, state
            state = NEXT[state, role[:1]]
            place += 1
            if not whole:
                return (conv, place - 1, role, text, letter)
            digest.update(f"{chr(10) if place > 1 else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
            return None

        def wanted() -> str:
            return ROLES["a" if state == 2 else "u"]

        def inserts() -> list[tuple]:
            nonlocal at
            start = at
            while at < len(audit) and audit[at] == "I":
                at += 1
            return [put(wanted(), "", "I") for _ in range(at - start)]

        def close() -> list[tuple]:
            rows = inserts()
            return rows if not whole else [(conv, digest.hexdigest())] if digest else []

        for c, told, role, text in _rows(batches):
            if told is not None:     # comes before the rows of its conversation
                yield from (r for r in close() if r)
                conv, audit, at, state, place, digest = c, told, 0, 0, 0, hashlib.sha256()
                continue
            yield from (r for r in inserts() if r)
            letter = audit[at]
            at += 1
            if letter != "D":
                row = put(role if letter == "K" else wanted(), text, letter)
                if row:
                    yield row
        yield from (r for r in close() if r)

    return lambda batches: _batches(run(batches), _schema(schema))


def _with_audits(turns: DataFrame, found: DataFrame) -> DataFrame:
    rows = _ordered(turns).select("conv_id", F.lit(1).alias("_kind"), "turn", "role", "digest", "text",
                                  F.lit(None).cast("string").alias("audit"))
    told = found.select("conv_id", F.lit(0), F.lit(None).cast("long"), F.lit(None).cast("string"),
                        F.lit(None).cast("string"), F.lit(None).cast("string"), "audit")
    return (rows.union(told).repartition("conv_id")
            .sortWithinPartitions("conv_id", "_kind", "turn", "role", "digest")
            .select("conv_id", "audit", "role", "text"))


def repaired_rows(turns: DataFrame, found: DataFrame) -> DataFrame:
    """``(conv_id, place, role, text, edit)``: the rows after the repairs in ``found``."""
    schema = "conv_id bigint, place bigint, role string, text string, edit string"
    return _with_audits(turns, found).mapInArrow(_applied(False, schema), schema)


def repaired_digests(turns: DataFrame, found: DataFrame) -> DataFrame:
    """``(conv_id, repaired_sha256)`` of the lines ``role:text``, by streaming."""
    schema = "conv_id bigint, repaired_sha256 string"
    return _with_audits(turns, found).mapInArrow(_applied(True, schema), schema)


def report(conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """One row per conversation id of ``conversations``: its counts, repair and digest over
    ``turns``; zeros, an empty audit and the digest of nothing where it has no row there."""
    found = cut_lineage(repairs(turns))
    told = same(found, repaired_digests(turns, found), ["conv_id"])
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    nothing = hashlib.sha256(b"").hexdigest()
    return (same(every, told, ["conv_id"], "left")
            .select("conv_id", *[F.coalesce(c, F.lit("" if c == "audit" else 0)).alias(c) for c in RESULT],
                    F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256")))
