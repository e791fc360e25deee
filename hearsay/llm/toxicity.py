"""Toxicity by a bidirectional gated recurrent network with attention pooling.

Input of a word: an embedding of the word plus the mean embedding of its character
n-grams (with word ends), both from hashed tables, so unseen spellings still have an
input.  Two gated recurrent layers read a window of words forwards and backwards, an
attention layer weighs the positions, and a logistic unit scores the weighted state.
A text is cut into overlapping windows that cover all of it; its score is the
highest window score.

Training (numpy, on the driver) uses a bounded, documented sample of labelled texts:
at most ``TRAIN_ROWS`` of each class, in order of a hash of the id (of rows with one id
the text of least hash), rows with crc32(id) mod 3 = 1 or a null id left out, and of
each text at most ``TRAIN_WINDOWS`` windows, in order of a hash of their place.  Ids are
chosen before any text moves, and only the windows of the chosen texts reach the driver.
Labels are those of whole texts, so from the third epoch on a toxic text is represented
by its highest-scoring window.  Scoring runs over every whole text in tasks; the fitted
tables have a fixed size and travel with them.

Defined cases: a null or wordless text scores 0; labels that are null or for unknown
ids are not used; repeated label rows count once; without both classes in the sample
every text with words scores 0; a null id is not held out; columns named like the added
ones (``score``, ``predicted``, in the query ``held_out``) are replaced.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from hearsay.llm.words import hash_order

TRAIN_ROWS = 1_200
TRAIN_WINDOWS = 160
WINDOW, STRIDE = 48, 24
WORD_ROWS, GRAM_ROWS = 1 << 13, 1 << 14
GRAMS = (3, 4, 5)
INPUT, HIDDEN = 16, 12
EPOCHS, BATCH, RATE = 6, 64, 0.01
SEED = 17
THRESHOLD = 0.7
WORDS_AT_ONCE = 20_000    # words whose n-grams are hashed together
KNOWN_WORDS = 200_000     # word inputs that a task remembers
WINDOWS_AT_ONCE = 2_048   # windows whose words are looked up together
WINDOWS_A_STEP = 384      # windows of one pass through the layers
TOKEN = re.compile(r"\w+")


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall(text.lower()) if text else []


@dataclass
class WordTable:
    """Rows of the word table, and rows of the character table one word after another."""
    words: np.ndarray
    grams: np.ndarray
    starts: np.ndarray      # where each word's grams start, and their number at the end

    def take(self, some: np.ndarray) -> "WordTable":
        sizes = self.sizes[some]
        starts = np.concatenate([[0], np.cumsum(sizes)])
        at = np.arange(starts[-1]) + np.repeat(self.starts[some] - starts[:-1], sizes)
        return WordTable(self.words[some], self.grams[at], starts)

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.starts)


def word_features(words: list[str]) -> WordTable:
    """Table rows of whole words and of all their character n-grams, ends marked by < and >."""
    if not words:
        return WordTable(np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(1, np.int64))
    if len(words) > WORDS_AT_ONCE:      # the memory of a pass is bounded
        parts = [word_features(words[k:k + WORDS_AT_ONCE]) for k in range(0, len(words), WORDS_AT_ONCE)]
        sizes = np.concatenate([p.sizes for p in parts])
        return WordTable(np.concatenate([p.words for p in parts]), np.concatenate([p.grams for p in parts]),
                         np.concatenate([[0], np.cumsum(sizes)]))
    own = np.array([zlib.crc32(w.encode("utf-8", "replace")) % WORD_ROWS for w in words], dtype=np.int64)
    codes = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"),
                          dtype=np.uint32).astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words])
    owner = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))    # characters to the end of the word
    rows, owners = [], []
    for n in GRAMS:
        if len(codes) < n:
            continue
        h = np.full(len(codes) - n + 1, n, dtype=np.uint64)
        for k in range(n):
            h = (h ^ codes[k:len(codes) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        inside = left[:len(h)] >= n
        rows.append((h[inside] % np.uint64(GRAM_ROWS)).astype(np.int32))
        owners.append(owner[:len(h)][inside])
    owners = np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    counts = np.bincount(owners, minlength=len(words))       # at least one, as <a> has three characters
    return WordTable(own, np.concatenate(rows)[order], np.concatenate([[0], np.cumsum(counts)]))


def cut_windows(n: int) -> list[tuple[int, int]]:
    """Overlapping ``[start, end)`` that cover n words."""
    if n <= WINDOW:
        return [(0, n)] if n else []
    starts = list(range(0, n - WINDOW, STRIDE)) + [n - WINDOW]
    return [(s, s + WINDOW) for s in starts]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + np.float32(0.5)


class Network:
    """Parameters are float32 arrays in ``p``; gates are in the order update, reset, state."""

    def __init__(self, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.p = {"words": draw(WORD_ROWS, INPUT, scale=0.1), "grams": draw(GRAM_ROWS, INPUT, scale=0.3)}
        for side in ("f", "b"):
            self.p[f"W{side}"] = draw(INPUT, 3 * HIDDEN, scale=0.4)
            self.p[f"U{side}"] = draw(HIDDEN, 3 * HIDDEN, scale=0.25)
            self.p[f"c{side}"] = np.zeros(3 * HIDDEN, dtype=np.float32)
        self.p["look"] = draw(2 * HIDDEN, scale=0.3)
        self.p["out"] = draw(2 * HIDDEN, scale=0.3)
        self.p["bias"] = np.zeros(1, dtype=np.float32)

    def inputs(self, table: WordTable) -> np.ndarray:
        if not len(table.words):
            return np.zeros((0, INPUT), dtype=np.float32)
        kind = self.p["grams"].dtype
        return (self.p["words"][table.words] + np.add.reduceat(self.p["grams"][table.grams], table.starts[:-1], axis=0)
                / table.sizes[:, None].astype(kind))

    def _read(self, side: str, gates: np.ndarray, rows: np.ndarray, keep: list | None) -> np.ndarray:
        """States (position, window, hidden); ``rows`` are rows of ``gates``, -1 past the end."""
        count, size = rows.shape
        u = self.p[f"U{side}"]
        h = np.zeros((count, HIDDEN), dtype=u.dtype)
        states = np.zeros((size, count, HIDDEN), dtype=u.dtype)
        for t in (range(size) if side == "f" else range(size - 1, -1, -1)):
            x, here = gates[rows[:, t]], (rows[:, t] >= 0).astype(u.dtype)[:, None]
            hu = h @ u
            zr = _sigmoid(x[:, :2 * HIDDEN] + hu[:, :2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = np.tanh(x[:, 2 * HIDDEN:] + r * hu[:, 2 * HIDDEN:])
            new = h + here * (1 - z) * (n - h)
            if keep is not None:
                keep.append((t, h, z, r, n, hu[:, 2 * HIDDEN:], here))
            states[t] = h = new
        return states

    def forward(self, x: np.ndarray, rows: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Log odds of windows; ``x`` are word inputs, ``rows`` their place per window."""
        both = []
        for side in ("f", "b"):
            # one spare row at the end is what -1 points at
            g = np.concatenate([x @ self.p[f"W{side}"] + self.p[f"c{side}"], np.zeros((1, 3 * HIDDEN), np.float32)])
            steps = [] if keep is not None else None
            both.append(self._read(side, g, rows, steps))
            if keep is not None:
                keep[side] = steps
        states = np.concatenate(both, axis=2)
        look = states @ self.p["look"] + np.where(rows.T >= 0, np.float32(0), np.float32(-1e9))
        weight = np.exp(look - look.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = (states * weight[:, :, None]).sum(axis=0)
        if keep is not None:
            keep |= {"states": states, "weight": weight, "pooled": pooled}
        return pooled @ self.p["out"] + self.p["bias"][0]

    def gradients(self, x: np.ndarray, rows: np.ndarray, labels: np.ndarray) -> tuple:
        keep: dict = {}
        logits = self.forward(x, rows, keep)
        kind = self.p["bias"].dtype
        err = ((_sigmoid(logits) - labels) / len(labels)).astype(kind)
        grad = {"out": keep["pooled"].T @ err, "bias": np.array([err.sum()], dtype=kind)}
        d_pooled = err[:, None] * self.p["out"]
        states, weight = keep["states"], keep["weight"]
        d_weight = (states * d_pooled).sum(axis=2)
        d_look = weight * (d_weight - (weight * d_weight).sum(axis=0))
        grad["look"] = (states * d_look[:, :, None]).sum(axis=(0, 1))
        d_states = weight[:, :, None] * d_pooled + d_look[:, :, None] * self.p["look"]
        dx = np.zeros_like(x)
        for s, side in enumerate(("f", "b")):
            u, own = self.p[f"U{side}"], d_states[:, :, s * HIDDEN:(s + 1) * HIDDEN]
            du, d_gates = np.zeros_like(u), np.zeros((len(x) + 1, 3 * HIDDEN), dtype=kind)
            dh = np.zeros((len(rows), HIDDEN), dtype=kind)
            for t, h, z, r, n, hn, here in reversed(keep[side]):
                dh = dh + own[t]
                dn = dh * here * (1 - z) * (1 - n * n)
                dz = dh * here * (h - n) * z * (1 - z)
                dr = dn * hn * r * (1 - r)
                from_h = np.concatenate([dz, dr, dn * r], axis=1)
                du += h.T @ from_h
                np.add.at(d_gates, rows[:, t], np.concatenate([dz, dr, dn], axis=1))
                dh = dh * (1 - here * (1 - z)) + from_h @ u.T
            d_gates = d_gates[:-1]
            grad[f"U{side}"], grad[f"W{side}"], grad[f"c{side}"] = du, x.T @ d_gates, d_gates.sum(axis=0)
            dx += d_gates @ self.p[f"W{side}"].T
        return grad, dx, logits


class Adam:
    def __init__(self, rate: float) -> None:
        self.rate, self.t, self.m, self.v = rate, 0, {}, {}

    def step(self, params: dict, grads: dict) -> None:
        self.t += 1
        for k, g in grads.items():
            m = self.m[k] = 0.9 * self.m.get(k, 0) + 0.1 * g
            v = self.v[k] = 0.999 * self.v.get(k, 0) + 0.001 * g * g
            params[k] -= (self.rate * (m / (1 - 0.9 ** self.t))
                          / (np.sqrt(v / (1 - 0.999 ** self.t)) + 1e-6)).astype(np.float32)


def windows_of(text: str | None) -> list[list[str]]:
    words = tokens(text)
    return [words[a:b] for a, b in cut_windows(len(words))]


def fit(texts: list[str], labels: list[int], seed: int = SEED, epochs: int = EPOCHS) -> Network | None:
    """A network fitted to whole-text labels; None unless both classes are there."""
    return fit_windows([windows_of(t) for t in texts], labels, seed, epochs)


def fit_windows(texts: Iterable[list[list[str]]], labels: list[int], seed: int = SEED,
                epochs: int = EPOCHS) -> Network | None:
    """``fit`` for texts that are given as their windows."""
    words: dict[str, int] = {}
    cut = [[np.array([words.setdefault(w, len(words)) for w in window], dtype=np.int64) for window in windows]
           for windows in texts]
    usable = [i for i, c in enumerate(cut) if c]
    if len({labels[i] for i in usable}) < 2:
        return None
    features = word_features(list(words))
    rng, net, adam = np.random.default_rng(seed), Network(seed), Adam(RATE)

    def padded(windows: list[np.ndarray]) -> np.ndarray:
        out = np.full((len(windows), max(map(len, windows))), -1, dtype=np.int64)
        for i, w in enumerate(windows):
            out[i, :len(w)] = w
        return out

    def local(windows: list[np.ndarray]) -> tuple[WordTable, np.ndarray]:
        """The words of some windows, and the windows as places among them."""
        rows = padded(windows)
        used, at = np.unique(rows, return_inverse=True)
        gap = int(used[0] < 0)
        return features.take(used[gap:]), at.reshape(rows.shape) - gap

    for epoch in range(epochs):
        chosen = []
        for i in usable:
            c = cut[i]
            if labels[i] and epoch >= 2:
                own, rows = local(c)
                chosen.append((c[int(net.forward(net.inputs(own), rows).argmax())], 1))
            else:
                few = 3 if labels[i] else 2
                chosen += [(c[k], labels[i]) for k in rng.permutation(len(c))[:few]]
        order = rng.permutation(len(chosen))
        for at in range(0, len(order), BATCH):
            some = [chosen[k] for k in order[at:at + BATCH]]
            own, rows = local([w for w, _ in some])
            grad, dx, _ = net.gradients(net.inputs(own), rows, np.array([y for _, y in some], np.float32))
            grad["words"], grad["grams"] = np.zeros_like(net.p["words"]), np.zeros_like(net.p["grams"])
            np.add.at(grad["words"], own.words, dx)
            np.add.at(grad["grams"], own.grams, np.repeat(dx / own.sizes[:, None].astype(np.float32), own.sizes, axis=0))
            adam.step(net.p, grad)
    return net


class Scorer:
    """Scores whole texts; gate inputs of words are remembered up to a bound.

    Gates are kept with the factors of the logistic function folded in, and a step works on
    arrays of (hidden, window), so that every gate is one block of memory.
    """

    def __init__(self, net: Network) -> None:
        self.net = net
        half = np.ones(3 * HIDDEN, dtype=np.float32)
        half[:2 * HIDDEN] = 0.5          # logistic(x) = tanh(x / 2) / 2 + 1 / 2
        self.inner = {s: np.ascontiguousarray((net.p[f"U{s}"] * half).T.astype(np.float32)) for s in ("f", "b")}
        self.outer = {s: ((net.p[f"W{s}"] * half).astype(np.float32), (net.p[f"c{s}"] * half).astype(np.float32))
                      for s in ("f", "b")}
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.gates = {s: np.zeros((1 << 12, 3 * HIDDEN), dtype=np.float32) for s in ("f", "b")}

    def _learn(self, fresh: list[str]) -> None:
        start = len(self.known)
        self.known.update(zip(fresh, range(start, start + len(fresh))))
        x = self.net.inputs(word_features(fresh)).astype(np.float32)
        for side, (weight, bias) in self.outer.items():
            held = self.gates[side]
            if len(held) < len(self.known):
                bigger = np.zeros((max(2 * len(held), len(self.known)), 3 * HIDDEN), dtype=np.float32)
                bigger[:start] = held[:start]
                held = self.gates[side] = bigger
            held[start:len(self.known)] = x @ weight + bias

    def score(self, texts: list[str | None]) -> np.ndarray:
        """The highest window score of every text; equal texts are scored once."""
        place: dict[str | None, int] = {}
        back = [place.setdefault(t, len(place)) for t in texts]
        out = np.zeros(len(place))
        at, group, held = [], [], 0
        for i, text in enumerate(place):
            at.append(i)
            group.append(tokens(text))
            held += len(group[-1])
            if held >= WINDOWS_AT_ONCE * STRIDE:
                out[at] = self._score(group)
                at, group, held = [], [], 0
        if at:
            out[at] = self._score(group)
        return out[back] if len(texts) else out

    def _score(self, group: list[list[str]]) -> np.ndarray:
        if len(self.known) > KNOWN_WORDS:
            self._forget()
        known = self.known
        fresh = list(dict.fromkeys(w for g in group for w in g if w not in known))
        if fresh:
            self._learn(fresh)
        best = np.zeros(len(group))
        whole, owner = [], []
        for i, g in enumerate(group):
            code = np.fromiter(map(known.__getitem__, g), dtype=np.int64, count=len(g))
            starts = np.array([a for a, _ in cut_windows(len(g))], dtype=np.int64)
            if len(g) >= WINDOW:
                whole.append(code[starts[:, None] + np.arange(WINDOW)])
                owner.append(np.full(len(starts), i))
            elif len(g):
                best[i] = self._odds(code[None, :])[0]       # a short text is one window
        if whole:
            np.maximum.at(best, np.concatenate(owner), self._odds(np.concatenate(whole)))
        return best

    def _odds(self, rows: np.ndarray) -> np.ndarray:
        logits = np.concatenate([self.logits(rows[k:k + WINDOWS_A_STEP]) for k in range(0, len(rows), WINDOWS_A_STEP)])
        return 1 / (1 + np.exp(-np.clip(logits.astype(float), -30, 30)))

    def logits(self, rows: np.ndarray) -> np.ndarray:
        """``Network.forward`` for windows of one size without gaps."""
        count, size = rows.shape
        states = np.empty((size, 2 * HIDDEN, count), dtype=np.float32)
        hu = np.empty((3 * HIDDEN, count), dtype=np.float32)
        for i, side in enumerate(("f", "b")):
            gates = np.ascontiguousarray(self.gates[side][rows].transpose(1, 2, 0))
            h = np.zeros((HIDDEN, count), dtype=np.float32)
            for t in (range(size) if side == "f" else range(size - 1, -1, -1)):
                x = gates[t]
                np.matmul(self.inner[side], h, out=hu)
                zr, n = x[:2 * HIDDEN], hu[2 * HIDDEN:]
                zr += hu[:2 * HIDDEN]
                np.tanh(zr, out=zr)
                zr *= np.float32(0.5)
                zr += np.float32(0.5)
                n *= zr[HIDDEN:]
                n += x[2 * HIDDEN:]
                np.tanh(n, out=n)
                h -= n                   # n + z (h - n)
                h *= zr[:HIDDEN]
                h += n
                states[t, i * HIDDEN:(i + 1) * HIDDEN] = h
        look = np.tensordot(self.net.p["look"].astype(np.float32), states, axes=(0, 1))
        weight = np.exp(look - look.max(axis=0))
        weight /= weight.sum(axis=0)
        value = np.tensordot(self.net.p["out"].astype(np.float32), states, axes=(0, 1))
        return (value * weight).sum(axis=0) + self.net.p["bias"][0]


def is_held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def _sampled_windows(most: int):
    """Windows of a text, words joined by blanks: all, or ``most`` in order of a hash."""
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for text in texts:
                words = tokens(text)
                spans = cut_windows(len(words))
                if len(spans) > most:
                    keep = sorted(range(len(spans)), key=lambda i: (zlib.crc32(str(i).encode()), i))[:most]
                    spans = [spans[i] for i in sorted(keep)]
                out.append([" ".join(words[a:b]) for a, b in spans])
            yield pd.Series(out)

    cut.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(cut, "array<string>")


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  rows: int = TRAIN_ROWS, windows: int = TRAIN_WINDOWS) -> list:
    """``(toxic, windows)`` of at most ``rows`` labelled texts of each class."""
    known = (labels.where(F.col("toxic").isin(0, 1) & F.col(id_col).isNotNull())
             .where(~is_held_out(id_col)).groupBy(id_col).agg(F.max("toxic").alias("toxic")))
    there = docs.select(id_col).where(F.col(id_col).isNotNull() & ~is_held_out(id_col)).distinct()
    labelled = known.join(there, id_col, "left_semi").withColumn("_key", hash_order(F.col(id_col)))
    chosen = {}
    for toxic in (0, 1):
        for r in (labelled.where(F.col("toxic") == toxic).orderBy("_key").limit(rows)
                  .select(F.col(id_col).alias("id"), "toxic", "_key").collect()):
            chosen[r["id"]] = (r["toxic"], r["_key"])
    if not chosen:
        return []
    ids = docs.sparkSession.createDataFrame([(i, *v) for i, v in chosen.items()], known.select(
        F.col(id_col).alias("_id"), "toxic", F.lit("").alias("_key")).schema)
    text = F.coalesce(F.col(text_col), F.lit(""))
    # at most 2 * rows ids; of rows with one id the text of least hash stands for it
    found = (docs.select(F.col(id_col).alias("_id"), text.alias("_text")).join(F.broadcast(ids), "_id")
             .withColumn("_w", _sampled_windows(windows)("_text"))
             .groupBy("_id", "toxic", "_key").agg(F.min_by("_w", F.xxhash64("_text")).alias("windows")))
    return found.orderBy("toxic", "_key").select("toxic", "windows").collect()


def train(docs: DataFrame, labels: DataFrame, **options) -> Network | None:
    rows = training_rows(docs, labels, **options)
    return fit_windows(([w.split(" ") for w in r["windows"]] for r in rows), [int(r["toxic"]) for r in rows])


def _scoring(net: Network):
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(net)
        for texts in batches:
            yield pd.Series(scorer.score(texts.tolist()))

    score.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(score, DoubleType())


def with_scores(docs: DataFrame, net: Network | None, text_col: str = "text",
                threshold: float = THRESHOLD) -> DataFrame:
    """Adds ``score`` and ``predicted`` to every row."""
    named = docs.drop("score", "predicted")
    score = _scoring(net)(F.col(text_col)) if net else F.lit(0.0)
    return (named.withColumn("score", score)
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))
