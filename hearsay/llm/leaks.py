"""Benchmark decontamination by edit distance.

Texts and items are sequences of lower-case words (letters, digits, underscores).  An
item leaks into a text if some stretch of the text is within ``1 - similarity`` of
the item's length in word edits.

Windows of an item's size are embedded by the CGK random walk: a pointer walks over
the window, each step writes the word under it and moves on or stays by a random bit
of the word and the step, so that a few edits change a few places of the embedding
however they shift the words.  Sampled places of the embedding are the keys of hash
tables; enough tables are used to reach the target recall at the allowed distance.
Windows that meet an item in a table are verified by the exact edit distance.

An item of n words with at most k edits keeps at least n - q + 1 - k * q of its runs of q
words, shifted against each other by at most k.  Windows are embedded only where a
text holds that many; this loses no leak (``prefilter=False`` embeds every window, for
comparison).  Which item a window may leak is always asked of the tables.

Items travel with the tasks in blocks of a checked number of words.  A benchmark of one
block is searched in one pass.  A larger one takes a pass per block: a block is sent,
the leaks of its pass are written by the text's SHA-256, the block is dropped, and the
next one follows, so driver and tasks hold one block at a time.

Defined cases: null or empty texts and items leak nothing; repeated items are
reported under each id; repeated rows are judged one by one; empty tables leak
nothing; other columns stay, ``leaks`` is replaced.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from itertools import chain, repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearsay.session import cut_lineage

SIMILARITY = 0.8
RECALL = 0.99
BLOCK_WORDS = 1_000_000   # words of items in one block; a block travels with the tasks
WALKS = 4                 # embeddings with their own random bits
SAMPLED = 2               # places of the embedding in one key
STEPS_PER_WORD = 3
MOST_GRAM = 3
#: places of an embedding that differ at the allowed distance, as measured on edited items
DIFFERENT = 0.65
WORD = re.compile(r"\w+")
RESULT = "array<struct<item_id:bigint,distance:int,start:int>>"


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def embed(windows: np.ndarray, walks: int, steps: int) -> np.ndarray:
    """The first steps of the CGK embeddings, as (step, walk, row), of equally long rows
    of word numbers (0 or more); -1 pads the end."""
    rows, size = windows.shape
    padded = np.concatenate([windows, np.full((rows, 1), -1, dtype=np.int64)], axis=1)
    out = np.empty((steps, walks, rows), dtype=np.int64)
    at, every = np.zeros((walks, rows), dtype=np.int64), np.arange(rows)
    first = np.arange(walks, dtype=np.uint64)[:, None] * np.uint64(1_000_003)
    for step in range(steps):
        out[step] = padded[every, at]
        seed = (first + np.uint64(step)) * np.uint64(2) + np.uint64(1)
        bit = _mixed(_mixed(out[step].astype(np.uint64) + seed) * seed) >> np.uint64(63)
        at = np.minimum(at + bit.astype(np.int64), size)
    return out


def tables_for(recall: float = RECALL, sampled: int = SAMPLED, different: float = DIFFERENT) -> int:
    """Tables so that a window at the allowed distance meets its item in one of them."""
    return math.ceil(math.log(1 - recall) / math.log(1 - (1 - different) ** sampled))


def fitting_distance(item: Sequence[int], text: np.ndarray) -> tuple[int, int]:
    """Least word edits between the item and any stretch of the text, and where it ends."""
    row = np.zeros(len(text) + 1, dtype=np.int64)
    steps = np.arange(len(text) + 1)
    for i, word in enumerate(item, 1):
        best = np.minimum(row[1:] + 1, row[:-1] + (text != word))
        full = np.concatenate([[i], best])
        row = np.minimum.accumulate(full - steps) + steps  # insertions, left to right
    end = int(row.argmin())
    return int(row[end]), end


class ItemBlock:
    """Hash tables over the items of one block; built on the driver, used in tasks."""

    def __init__(self, items: Sequence[tuple[int, list[str]]], similarity: float = SIMILARITY,
                 recall: float = RECALL) -> None:
        self.items = [(i, w) for i, w in items if w]
        self.vocabulary: dict[str, int] = {}
        self.coded = [np.array([self.vocabulary.setdefault(x, len(self.vocabulary)) for x in w],
                               dtype=np.int64) for _, w in self.items]
        self.allowed = [int((1 - similarity) * len(w) + 1e-9) for _, w in self.items]
        self.gram = min([MOST_GRAM, *[len(w) // (k + 1) for (_, w), k in zip(self.items, self.allowed)]])
        self.n_tables = tables_for(recall)
        self._index()

    def _index(self) -> None:
        self.base = len(self.vocabulary) + 1
        places: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gram -> (item, offset)
        for number, code in enumerate(self.coded):
            for offset, gram in enumerate(self._grams(code).tolist()):
                places[gram].append((number, offset))
        self.grams = np.array(sorted(places), dtype=np.int64)
        held = [places[g] for g in self.grams.tolist()]
        self.count = np.array([len(h) for h in held], dtype=np.int64)
        self.first = np.cumsum(self.count) - self.count
        flat = np.array([x for h in held for x in h], dtype=np.int64).reshape(-1, 2)
        self.at_item, self.at_offset = flat[:, 0], flat[:, 1]
        # each edit breaks at most ``gram`` runs, so this many stay in a leaked item
        self.needed = np.array([max(1, len(c) - self.gram + 1 - k * self.gram)
                                for c, k in zip(self.coded, self.allowed)], dtype=np.int64)
        by_size = defaultdict(list)
        for number, code in enumerate(self.coded):
            by_size[len(code)].append(number)
        self.places: dict[int, list[np.ndarray]] = {}  # size -> sampled places of each table
        self.tables: dict[tuple, list[int]] = defaultdict(list)
        for size, numbers in by_size.items():
            self.places[size] = [np.sort(np.random.default_rng([size, table]).choice(
                STEPS_PER_WORD * size // 2, size=SAMPLED, replace=False)) for table in range(self.n_tables)]
            for table, keys in self._keys(np.stack([self.coded[n] for n in numbers])):
                for key, number in zip(keys, numbers):
                    self.tables[size, table, key].append(number)

    def _grams(self, code: np.ndarray) -> np.ndarray:
        q = self.gram
        if len(code) < q:
            return np.empty(0, dtype=np.int64)
        total = np.zeros(len(code) - q + 1, dtype=np.int64)
        for j in range(q):
            total = total * self.base + code[j:len(code) - q + 1 + j]
        return total

    def _keys(self, windows: np.ndarray) -> Iterator[tuple[int, list[bytes]]]:
        places = self.places[windows.shape[1]]
        # all walks take their steps together, up to the last place that a table samples
        embedded = embed(windows, WALKS, 1 + max(int(chosen[-1]) for chosen in places))
        for table, chosen in enumerate(places):
            picked = np.ascontiguousarray(embedded[chosen, table % WALKS].T)
            yield table, [row.tobytes() for row in picked]

    def find(self, text: str | None, prefilter: bool = True) -> list[tuple[int, int, int]]:
        """``(item_id, distance, start)`` of every item that leaks into the text."""
        if not text or not self.items:
            return []
        words, q = words_of(text), self.gram
        code = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        if not prefilter:
            every: dict[int, tuple[int, int]] = {}
            for size in sorted({len(c) for c in self.coded}):
                self._verify(code, size, list(range(1 - size, len(code))), every)
            return sorted((self.items[n][0], d, s) for n, (d, s) in every.items())
        held = np.flatnonzero(code >= 0)
        if len(held) < q:
            return []
        run = np.flatnonzero(held[q - 1:] - held[:len(held) - q + 1] == q - 1)
        if not len(run):
            return []
        at = held[run]
        grams = np.zeros(len(at), dtype=np.int64)
        for j in range(q):
            grams = grams * self.base + code[at + j]
        place = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        hits = np.flatnonzero(self.grams[place] == grams)
        begin, count = self.first[place[hits]], self.count[place[hits]]
        spot = np.repeat(begin - np.cumsum(count) + count, count) + np.arange(count.sum())
        item = self.at_item[spot]
        start = np.repeat(at[hits], count) - self.at_offset[spot]
        starts: dict[int, set[int]] = defaultdict(set)
        for n in np.flatnonzero(np.bincount(item, minlength=len(self.items)) >= self.needed).tolist():
            own, t = np.sort(start[item == n]), int(self.needed[n])
            close = np.flatnonzero(own[t - 1:] - own[:len(own) - t + 1] <= self.allowed[n])
            if len(close):  # the runs that stay are shifted against each other by at most the edits
                near = np.unique((close[:, None] + np.arange(t)).ravel())
                starts[len(self.coded[n])].update(np.unique(own[near]).tolist())
        best: dict[int, tuple[int, int]] = {}
        for size, where in starts.items():
            self._verify(code, size, sorted(where), best)
        return sorted((self.items[n][0], d, s) for n, (d, s) in best.items())

    def _verify(self, code: np.ndarray, size: int, starts: list[int],
                best: dict[int, tuple[int, int]]) -> None:
        # words that no item holds get numbers of their own, so that they never agree
        marked = np.where(code >= 0, code, self.base + np.arange(len(code)))
        reach = np.concatenate([np.full(size, self.base - 1), marked, np.full(size, self.base - 1)])
        for part in range(0, len(starts), 4096):
            some = np.array(starts[part:part + 4096], dtype=np.int64)
            some = some[(some > -size) & (some < len(code))]
            if not len(some):
                continue
            windows = reach[(some + size)[:, None] + np.arange(size)]
            met = {(row, n) for table, keys in self._keys(windows) for row, key in enumerate(keys)
                   for n in self.tables.get((size, table, key), ())}
            for row, n in sorted(met):
                slack = self.allowed[n]
                low = max(0, int(some[row]) - slack)
                region = code[low:max(0, int(some[row]) + size + slack)]
                distance, end = fitting_distance(self.coded[n], region)
                if distance <= slack and distance < best.get(n, (slack + 1, 0))[0]:
                    best[n] = (distance, max(0, low + end - size))


def item_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS,
                similarity: float = SIMILARITY, recall: float = RECALL) -> Iterator[ItemBlock]:
    """The items in blocks of a bounded number of words, read one partition at a time."""
    block: list[tuple[int, list[str]]] = []
    held = 0
    for row in benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        item = words_of(row["text"])
        if block and held + len(item) > block_words:
            yield ItemBlock(block, similarity, recall)
            block, held = [], 0
        block.append((row["item_id"], item))
        held += len(item)
    if block:
        yield ItemBlock(block, similarity, recall)


def _search(shared):
    @F.pandas_udf(RESULT)
    def search(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"item_id": i, "distance": d, "start": s} for i, d, s in shared.value.find(t)]
                          for t in texts], dtype=object)

    return search


def with_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text",
               similarity: float = SIMILARITY, recall: float = RECALL,
               block_words: int = BLOCK_WORDS) -> DataFrame:
    """Adds ``leaks``: items within the distance, with their least distance and its place."""
    context = docs.sparkSession.sparkContext
    blocks = item_blocks(benchmark, block_words, similarity, recall)
    named, none = docs.drop("leaks"), F.expr(f"cast(array() as {RESULT})")
    first, second = next(blocks, None), next(blocks, None)
    if second is None:
        if first is None:
            return named.withColumn("leaks", none)
        return named.withColumn("leaks", _search(context.broadcast(first))(F.col(text_col)))

    found = None
    for block in chain((first, second), blocks):
        first = second = None
        shared = context.broadcast(block)
        told = docs.select(F.col(text_col).alias("_t")).withColumn("_l", _search(shared)("_t")).where(F.size("_l") > 0)
        part = cut_lineage(told.select(F.sha2("_t", 256).alias("_sha"), F.inline("_l")).distinct())
        shared.destroy()
        found = part if found is None else found.unionByName(part)
    # one row per item that leaks into a text
    leaks = found.groupBy("_sha").agg(F.array_sort(F.collect_set(F.struct("item_id", "distance", "start"))).alias("_l"))
    keyed = named.withColumn("_sha", F.sha2(F.col(text_col), 256))
    return (keyed.join(leaks, "_sha", "left").select(*named.columns, F.coalesce("_l", none).alias("leaks")))


def leaked_items(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row ``(id, item_id, distance, start)`` per text and item."""
    return with_leaks(docs, benchmark, **options).select(id_col, F.inline("leaks"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows into which no item leaks."""
    return with_leaks(docs, benchmark, **options).where(F.size("leaks") == 0).select(*docs.columns)
