"""Substring de-duplication through prefix-partitioned suffix trees.

A window is ``length`` consecutive words; every word is removed that a window covers
which also starts in a document with a smaller id.

1. Candidates.  Of the word runs of ``ANCHOR`` words inside a window, the one with the
   least hash is its anchor; neighbouring windows mostly share it and make one slice.  A
   window can only be in two documents if its anchor is, so slices whose anchor one
   document alone has are dropped before any text moves.  This loses nothing.
2. Slices of equal words collapse: the smallest id that has the slice stands for it, and
   every other document loses it whole.  Spark groups by the words themselves.
3. What stands and shares its anchor with another slice is cut into suffixes, one per
   window.  A suffix goes to the group of its first words: the shortest of the prefix
   lengths ``PREFIXES`` whose group holds at most ``GROUP`` suffixes.  A group fits into
   memory and becomes one suffix tree, built from the sorted suffixes and their common
   prefixes; an internal node of at least ``length`` words is a repeat, and all suffixes
   below it but those of its smallest document lose their window.  Where even the longest
   prefix has more, the suffixes are grouped by their whole window: its smallest document
   comes from an aggregation with partial results, without a tree.

Hashes only choose candidates; what is removed was compared word by word.  Rows are told
apart by id and a 64-bit hash of the text, rows of one id are never copies of each other.

Defined cases: a null text has no words; a text shorter than a window keeps all of
them; a null id counts as larger than every id; an empty table gives an empty table;
columns of the input stay out of the result but for the id.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearsay.session import cut_lineage, release

LENGTH = 13
ANCHOR = 6
PREFIXES = (2, 4, 8)      # words of a prefix; after them the whole window
GROUP = 4_000             # suffixes that one tree may hold
HOT_WINDOWS = 1_000       # windows that may hold more than this part of all suffixes
MOST_IN_RUN = 200         # windows in one slice; longer runs are several slices
PIECE = 1 << 22           # bytes of text in one pass of the hashes
NO_ID = (1 << 63) - 1
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)


# ---------------------------------------------------------------- candidates

class WordHashes:
    """64-bit hashes of the words of a piece of text, all at once: differences of a running
    polynomial over the bytes, brought back to the start of the word."""

    def __init__(self) -> None:
        self.power = self.inverse = np.ones(1, dtype=np.uint64)

    def _grow(self, size: int) -> None:
        if len(self.power) < size:
            size = max(size, 1 << 16)
            self.power, self.inverse = (np.full(size, base, dtype=np.uint64) for base in (_BASE, pow(_BASE, -1, 1 << 64)))
            for steps in (self.power, self.inverse):
                steps[0] = 1
                np.cumprod(steps, out=steps)

    def of(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(hash, start)`` of the words between white space in UTF-8 bytes."""
        self._grow(len(data) + 1)
        edge = np.diff(np.concatenate([[False], ~((data == 32) | ((data >= 9) & (data <= 13))), [False]]).astype(np.int8))
        starts, ends = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
        upto = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.power[:len(data)], out=upto[1:])
        h = (upto[ends] - upto[starts]) * self.inverse[starts]
        h = (h ^ (h >> np.uint64(29))) * _MIX
        return h ^ (h >> np.uint64(32)), starts


def _window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbouring values, by doubling."""
    done, low = 1, values
    while done < width:
        step = min(done, width - done)
        low = np.minimum(low[:len(low) - step], low[step:])
        done += step
    return low


def anchored_slices(texts: Sequence[bytes], hashes: WordHashes, length: int = LENGTH,
                    anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(text, anchor, start, n)``: runs of windows of one text that share their anchor."""
    data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    h, starts = hashes.of(data)
    ends = np.cumsum([len(t) + 1 for t in texts])
    upto = np.searchsorted(starts, ends)                  # words up to the end of each text
    none = np.zeros(0, dtype=np.int64)
    if len(h) < length:
        return none, none, none, none
    gram = np.zeros(len(h) - anchor + 1, dtype=np.uint64)
    for j in range(anchor):
        gram = gram * np.uint64(_BASE) + h[j:len(h) - anchor + 1 + j]
    gram = (gram ^ (gram >> np.uint64(32))) * _MIX
    gram ^= gram >> np.uint64(32)
    low = _window_minimum(gram, length - anchor + 1)
    owner = np.repeat(np.arange(len(texts)), np.diff(np.concatenate([[0], upto])))
    at = np.flatnonzero(owner[:len(low)] == owner[length - 1:])      # windows inside one text
    if not len(at):
        return none, none, none, none
    value, own = low[at], owner[at]
    new = np.concatenate([[True], (value[1:] != value[:-1]) | (own[1:] != own[:-1])])
    place = np.arange(len(at))
    first = np.maximum.accumulate(np.where(new, place, 0))
    cut = np.flatnonzero(new | ((place - first) % MOST_IN_RUN == 0))
    n = np.diff(np.concatenate([cut, [len(at)]]))
    begin = np.concatenate([[0], upto])[own[cut]]
    return own[cut], value[cut].view(np.int64), at[cut] - begin, n


def _pieces(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t) + 1
        if held >= PIECE:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _slices(length: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            ids, marks = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            for a, b in _pieces(texts):
                own, value, start, n = anchored_slices(texts[a:b], hashes, length, anchor)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(value, pa.int64()), pa.array(ids[a:b][own], pa.int64()),
                     pa.array(marks[a:b][own], pa.int64()), pa.array(start, pa.int32()), pa.array(n, pa.int16())],
                    names=["anchor", "_id", "_mark", "start", "n"])

    return run


# ---------------------------------------------------------------- words of slices

def _listed(column: pa.ListArray) -> tuple[np.ndarray, pa.StructArray]:
    """Where the list of each row begins among all entries, and the entries."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(sizes)]), column.flatten()


def _spoken(length: int):
    """Words of the slices of every text, joined by blanks."""
    names = ["anchor", "words", "_id", "_mark", "start", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            at, runs = _listed(batch.column(3))
            first, size = 0, 0
            spans = list(zip(runs.field("start").to_pylist(), runs.field("n").to_pylist()))
            said: list[bytes] = []
            for i in range(batch.num_rows):
                words = texts[i].as_py().split()
                said += [b" ".join(words[s:s + n + length - 1]) for s, n in spans[at[i]:at[i + 1]]]
                size += len(texts[i].as_py())
                if size > PIECE or i + 1 == batch.num_rows:
                    owner = np.repeat(np.arange(first, i + 1), np.diff(at[first:i + 2]))
                    part = runs.slice(at[first], at[i + 1] - at[first])
                    yield pa.RecordBatch.from_arrays(
                        [part.field("anchor"), pa.array(said, pa.binary()), batch.column(0).take(pa.array(owner)),
                         batch.column(1).take(pa.array(owner)), part.field("start"), part.field("n")], names=names)
                    first, size, said = i + 1, 0, []

    return run


def _suffixes(length: int):
    """One row per window of a standing slice."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slices, places, least, said, size = [], [], [], [], 0
            for number, low, text in zip(*[c.to_pylist() for c in batch.columns]):
                words = text.split(b" ")
                for i in range(len(words) - length + 1):
                    slices.append(number)
                    places.append(i)
                    least.append(low)
                    said.append(b" ".join(words[i:i + length]))
                    size += len(said[-1])
                if size > PIECE:
                    yield _batch(slices, places, least, said)
                    slices, places, least, said, size = [], [], [], [], 0
            if slices:
                yield _batch(slices, places, least, said)

    def _batch(slices, places, least, said) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(slices, pa.int64()), pa.array(places, pa.int32()), pa.array(least, pa.int64()),
             pa.array(said, pa.binary()).cast(pa.string())], names=["slice", "place", "least", "suffix"])

    return run


# ---------------------------------------------------------------- trees

def common_words(a: list[str], b: list[str]) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def deep_nodes(suffixes: list[list[str]], depth: int) -> Iterator[tuple[int, int, int]]:
    """Internal nodes ``(words, from, to)`` of the tree over sorted suffixes that have at
    least ``depth`` words, children before their parents."""
    open_nodes: list[tuple[int, int]] = []        # (words, first suffix), deeper ones later
    for i in range(1, len(suffixes) + 1):
        shared = common_words(suffixes[i - 1], suffixes[i]) if i < len(suffixes) else 0
        start = i - 1
        while open_nodes and open_nodes[-1][0] > shared:
            words, start = open_nodes.pop()
            yield words, start, i
        if shared >= depth and (not open_nodes or open_nodes[-1][0] < shared):
            open_nodes.append((shared, start))


def _trees(length: int):
    """Windows of standing slices that an earlier document has; rows come group by group."""
    def repeats(group: list[tuple]) -> list[tuple[int, int]]:
        group.sort(key=lambda row: row[0])
        gone = set()
        for _, a, b in deep_nodes([row[0] for row in group], length):
            least = min(row[1] for row in group[a:b])
            gone.update((row[2], row[3]) for row in group[a:b] if row[1] > least)
        return sorted(gone)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefix, group = None, []
        for batch in batches:
            out: list[tuple[int, int]] = []
            for own, suffix, least, number, place in zip(*[c.to_pylist() for c in batch.columns]):
                if own != prefix:
                    out += repeats(group)
                    prefix, group = own, []
                group.append((suffix.split(" "), least, number, place))
            yield _batch(out)
        yield _batch(repeats(group))

    def _batch(rows: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()),
                                           pa.array([r[1] for r in rows], pa.int32())], names=["slice", "place"])

    return run


def _prefix(words: int) -> Column:
    return F.substring_index("suffix", " ", words)


def grouped(suffixes: DataFrame, prefixes: Sequence[int] = PREFIXES, group: int = GROUP) -> DataFrame:
    """Adds ``prefix``: the shortest one whose group holds at most ``group`` suffixes, null
    where none does."""
    prefix = F.lit(None).cast("string")
    rows = suffixes
    for k in reversed(prefixes):
        crowded = cut_lineage(suffixes.groupBy(_prefix(k).alias(f"_p{k}")).agg(F.count(F.lit(1)).alias("_c"))
                              .where(F.col("_c") > group).select(f"_p{k}", F.lit(True).alias(f"_x{k}")))
        rows = rows.withColumn(f"_p{k}", _prefix(k)).join(crowded, f"_p{k}", "left")
        prefix = F.when(F.col(f"_x{k}").isNull(), F.col(f"_p{k}")).otherwise(prefix)
    return rows.select(*suffixes.columns, prefix.alias("prefix"))


def repeated_windows(suffixes: DataFrame, length: int = LENGTH, prefixes: Sequence[int] = PREFIXES,
                     group: int = GROUP) -> DataFrame:
    """``(slice, place)`` of the windows that a slice with a smaller ``least`` has as well."""
    rows = grouped(suffixes, prefixes, group)
    trees = (rows.where("prefix IS NOT NULL").select("prefix", "suffix", "least", "slice", "place")
             .repartition("prefix").sortWithinPartitions("prefix")
             .mapInArrow(_trees(length), "slice bigint, place int"))
    crowded = rows.where("prefix IS NULL")
    lowest = cut_lineage(crowded.groupBy("suffix").agg(F.min("least").alias("_lowest"), F.count(F.lit(1)).alias("_rows")))
    # at most HOT_WINDOWS windows have more than this share of the suffixes: they travel with the tasks
    share = suffixes.count() // HOT_WINDOWS
    hot = lowest.where(F.col("_rows") > share).select("suffix", F.col("_lowest").alias("_hot"))
    told = crowded.join(F.broadcast(hot), "suffix", "left")
    rest = told.where("_hot IS NULL").join(lowest.where(F.col("_rows") <= share).select("suffix", "_lowest"), "suffix")
    return (trees.union(told.where("least > _hot").select("slice", "place"))
            .union(rest.where("least > _lowest").select("slice", "place")))


# ---------------------------------------------------------------- whole job

def later_windows(rows: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, prefixes: Sequence[int] = PREFIXES,
                  group: int = GROUP, code_bits: int = 64) -> DataFrame:
    """``(_id, _mark, _starts)``: runs of windows to remove; ``rows`` is ``(_id, _mark, _text)``."""
    code = F.shiftrightunsigned(F.xxhash64("words"), 64 - code_bits)
    every = cut_lineage(rows.mapInArrow(_slices(length, anchor),
                                        "anchor bigint, _id bigint, _mark bigint, start int, n smallint"))
    shared = cut_lineage(every.groupBy("anchor").agg(F.min("_id").alias("_low"), F.max("_id").alias("_high"))
                         .where("_low < _high").select("anchor"))
    wanted = cut_lineage(every.join(shared, "anchor", "left_semi").groupBy("_id", "_mark")
                         .agg(F.collect_set(F.struct("anchor", "start", "n")).alias("runs")))
    release(every, shared)
    spoken = cut_lineage(rows.join(wanted, ["_id", "_mark"]).mapInArrow(
        _spoken(length), "anchor bigint, words binary, _id bigint, _mark bigint, start int, n smallint"))
    release(wanted)
    standing = cut_lineage(spoken.groupBy("anchor", "words").agg(F.min("_id").alias("least"), F.max("_id").alias("_high"))
                           .withColumn("slice", F.monotonically_increasing_id()))
    several = standing.groupBy("anchor").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select("anchor")
    suffixes = cut_lineage(standing.join(several, "anchor", "left_semi").select("slice", "least", "words").mapInArrow(
        _suffixes(length), "slice bigint, place int, least bigint, suffix string"))
    inner = cut_lineage(repeated_windows(suffixes, length, prefixes, group).groupBy("slice")
                        .agg(F.collect_set("place").alias("places")))
    release(suffixes)
    # a 64-bit code stands for the words of a slice where no other slice has it; the few slices
    # that share one are joined by their words
    coded = standing.join(inner, "slice", "left").withColumn("code", code)
    clash = cut_lineage(coded.groupBy("code").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select("code"))
    judged = coded.where("_high > least OR places IS NOT NULL")
    said = spoken.withColumn("code", code)
    alone = (said.drop("words").join(judged.select("code", "least", "places").join(clash, "code", "left_anti"), "code"))
    shared_code = (said.join(clash, "code", "left_semi").drop("code")
                   .join(judged.select("words", "least", "places"), "words"))
    needed = ("_id", "_mark", "start", "n", "least", "places")
    whole = F.array(F.struct("start", F.col("n").cast("int").alias("n")))
    single = F.transform(F.coalesce("places", F.array().cast("array<int>")), lambda p: F.struct(
        (F.col("start") + p).alias("start"), F.lit(1).alias("n")))
    found = cut_lineage(alone.select(*needed).union(shared_code.select(*needed)).select("_id", "_mark", F.inline(
        F.when(F.col("_id") > F.col("least"), whole).otherwise(single))).groupBy("_id", "_mark")
        .agg(F.collect_set(F.struct("start", "n")).alias("_starts")))
    release(spoken, standing, inner, clash)
    return found


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            at, runs = _listed(batch.column(2))
            starts, ends = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in (runs.field("start"), runs.field("n")))
            ends = starts + ends + length - 1
            totals, removed, kept = [], [], []
            for i in range(batch.num_rows):
                words = texts[i].as_py().split()
                totals.append(len(words))
                a, b = at[i], at[i + 1]
                if a < b:
                    edges = np.bincount(starts[a:b], minlength=len(words) + 1) - np.bincount(ends[a:b], minlength=len(words) + 1)
                    words = [words[k] for k in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()]
                removed.append(totals[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(kept, pa.binary()).cast(pa.string())],
                names=[batch.schema.names[0], "n_words", "n_removed", "kept_text"])

    return run


def _row_key(id_col: str, text_col: str) -> tuple[Column, Column, Column]:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return (F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_id"), F.xxhash64(text).alias("_mark"),
            text.alias("_text"))


def without_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id",
                    text_col: str = "text", **options) -> DataFrame:
    """``(id, n_words, n_removed, kept_text)`` for every row."""
    starts = later_windows(docs.select(*_row_key(id_col, text_col)), length, **options)
    named = docs.select(F.col(id_col), *_row_key(id_col, text_col))
    kind = docs.schema[id_col].dataType.simpleString()
    return (named.join(starts, ["_id", "_mark"], "left").select(id_col, "_text", "_starts")
            .mapInArrow(_cut(length), f"{id_col} {kind}, n_words bigint, n_removed bigint, kept_text string"))
