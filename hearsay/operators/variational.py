"""Online variational Bayes of many topic models at once, over Arrow.

Spark's online optimiser runs one model at a time: each of its iterations reads all documents
for a twentieth of them, and its bound takes the exponential of the whole topic matrix once
per document.  Here one pass over the documents serves an iteration of all models, and one
more their bounds.  Models, samples and starting points are those of Spark: models of one
seed draw the same numbers there, so they share the sample of an iteration, and the numbers
of k topics are the first k of one stream.

Documents of similar length are inferred together as padded blocks; a task holds one Arrow
batch and the sums of all models (topics x terms).
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Settings and constants of Spark's online optimiser; its models draw the starting
# points of a bound from a seed of their own, the hash of their class name.
SUBSAMPLING, OFFSET, DECAY, SHAPE, SETTLED, LEAST = 0.05, 1024.0, 0.51, 100.0, 1e-3, 1e-100
BOUND_SEED = 1421925485
CELLS = 1 << 15                 # cells of one padded block


# ---------------------------------------------------------------- special functions

def _shifted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``x + 6`` and x(x+1)...(x+5) with its derivative."""
    p = x * (x * (x * (x * (x * (x + 15) + 85) + 225) + 274) + 120)
    return x + 6, p, x * (x * (x * (x * (6 * x + 75) + 340) + 675) + 548) + 120


def digamma(x: np.ndarray) -> np.ndarray:
    y, p, slope = _shifted(x)
    s = 1 / (y * y)
    return np.log(y) - 0.5 / y - s * (1 / 12 - s * (1 / 120 - s * (1 / 252 - s * (1 / 240 - s * (
        1 / 132 - s * (691 / 32760 - s / 12)))))) - slope / p


def lgamma(x: np.ndarray) -> np.ndarray:
    y, p, _ = _shifted(x)
    s = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + (1 / 12 - s * (1 / 360 - s * (1 / 1260 - s * (
        1 / 1680 - s * (1 / 1188 - s * (691 / 360360 - s / 156)))))) / y - np.log(p)


def trigamma(x: np.ndarray) -> np.ndarray:
    y = x + 6
    s = 1 / (y * y)
    return 1 / y + s / 2 + (1 / 6 - s * (1 / 30 - s * (1 / 42 - s * (1 / 30 - s * (5 / 66 - s * (
        691 / 2730 - s * 7 / 6)))))) * s / y + sum(1 / (x + i) ** 2 for i in range(6))


def expectation(a: np.ndarray) -> np.ndarray:
    """E[log p] of Dirichlet rows."""
    return digamma(a) - digamma(a.sum(axis=-1, keepdims=True))


# ---------------------------------------------------------------- random numbers

class JavaRandom:
    """``java.util.Random``."""

    def __init__(self, seed: int):
        self.state = (seed ^ 0x5DEECE66D) & ((1 << 48) - 1)

    def _word(self) -> int:
        self.state = (self.state * 0x5DEECE66D + 0xB) & ((1 << 48) - 1)
        word = self.state >> 16
        return word - (1 << 32) if word >> 31 else word

    def long(self) -> int:
        """A signed number of 64 bits."""
        value = ((self._word() << 32) + self._word()) & ((1 << 64) - 1)
        return value - (1 << 64) if value >> 63 else value


def _murmur(data: bytes, seed: int) -> int:
    h, m = seed, 0xFFFFFFFF
    for i in range(0, len(data), 4):
        k = int.from_bytes(data[i:i + 4], "little") * 0xCC9E2D51 & m
        h ^= (k << 15 | k >> 17) * 0x1B873593 & m
        h = ((h << 13 | h >> 19) & m) * 5 + 0xE6546B64 & m
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & m
    h = (h ^ h >> 13) * 0xC2B2AE35 & m
    return h ^ h >> 16


def sampled(seed: int, fraction: float) -> Iterator[tuple[int, int]]:
    """Rows of a partition that ``RDD.sample`` takes with replacement, by the seed of the
    partition, and how often."""
    data, m = (seed & ((1 << 64) - 1)).to_bytes(8, "big"), (1 << 64) - 1
    low = _murmur(data, 0x3C074A61)
    state = _murmur(data, low) << 32 | low

    def bits(n: int) -> int:
        nonlocal state
        state ^= state << 21 & m
        state ^= state >> 35
        state ^= state << 4 & m
        return state & ((1 << n) - 1)

    def double() -> float:
        return ((bits(26) << 27) + bits(27)) * 2.0 ** -53

    at, least = 0, math.exp(-fraction)
    while True:
        at += int(math.log(max(double(), 5e-11)) / -fraction)
        times, left = 1, (least + (1 - least) * double()) * double()
        while left > least:
            times, left = times + 1, left * double()
        yield at, times
        at += 1


def uniforms(seeds: np.ndarray, count: int) -> np.ndarray:
    """``count`` doubles of a Mersenne twister per seed, one row per double."""
    key = ((seeds >> np.uint64(32)).astype(np.uint32), seeds.astype(np.uint32))
    start = [19650218]
    for i in range(1, 624):
        start.append((1812433253 * (start[-1] ^ start[-1] >> 30) + i) & 0xFFFFFFFF)
    mt = np.repeat(np.array(start, np.uint32)[:, None], len(seeds), axis=1)
    at = 1
    for step in range(624 + 623):
        mixed = (mt[at - 1] ^ mt[at - 1] >> np.uint32(30)) * np.uint32(1664525 if step < 624 else 1566083941)
        mt[at] ^= mixed
        mt[at] += key[step % 2] + np.uint32(step % 2) if step < 624 else np.uint32(2 ** 32 - at)
        at += 1
        if at == 624:
            mt[0] = mt[623]
            at = 1
    mt[0] = 0x80000000
    words = []
    while 624 * len(words) < 2 * count:
        new = np.empty_like(mt)
        turn = lambda a, b: (lambda y: y >> np.uint32(1) ^ (y & np.uint32(1)) * np.uint32(0x9908B0DF))(
            a & np.uint32(0x80000000) | b & np.uint32(0x7FFFFFFF))
        most = 2 * count - 624 * len(words)      # words past the last one asked for are left out
        new[:227] = mt[397:] ^ turn(mt[:227], mt[1:228])
        if most > 227:
            new[227:454] = new[:227] ^ turn(mt[227:454], mt[228:455])
            new[454:623] = new[227:396] ^ turn(mt[454:623], mt[455:])
            new[623] = new[396] ^ turn(mt[623], new[0])
        mt = new
        y = new[:min(most, 624)].copy()
        y ^= y >> np.uint32(11)
        y ^= y << np.uint32(7) & np.uint32(0x9D2C5680)
        y ^= y << np.uint32(15) & np.uint32(0xEFC60000)
        words.append(y ^ y >> np.uint32(18))
    words = np.concatenate(words)[:2 * count] >> np.uint32(6)
    return (words[::2].astype(np.float64) * 2.0 ** 26 + words[1::2]) * 2.0 ** -52


def gammas(seeds: np.ndarray, count: int, spare: int = 16) -> np.ndarray:
    """``count`` draws per seed from the gamma distribution of mean one (Marsaglia and Tsang)."""
    stream = uniforms(seeds, 2 * count + spare)
    d = SHAPE - 1 / 3
    c = 1 / math.sqrt(9 * d)
    out = np.empty((len(seeds), count))
    at = np.zeros(len(seeds), np.int64)
    saved = np.full(len(seeds), np.nan)          # normal numbers come in pairs
    for j in range(count):
        todo = np.arange(len(seeds))
        while len(todo):
            if at.max() + 3 > len(stream):
                return gammas(seeds, count, 4 * spare)
            x = saved[todo].copy()
            saved[todo] = np.nan
            new = np.isnan(x)
            which = todo[new]
            angle, size = 2 * math.pi * stream[at[which], which], np.sqrt(-2 * np.log(stream[at[which] + 1, which]))
            x[new], saved[which] = size * np.cos(angle), size * np.sin(angle)
            at[which] += 2
            v = 1 + c * x
            right = v > 0
            todo, x, v = todo[right], x[right], v[right] ** 3
            again = np.arange(0) if right.all() else np.flatnonzero(~right)
            assert not len(again), "a normal number of 30 deviations"
            u = stream[at[todo], todo]
            at[todo] += 1
            ok = (u < 1 - 0.0331 * x ** 4) | (np.log(u) < 0.5 * x * x + d * (1 - v + np.log(v)))
            out[todo[ok], j] = d * v[ok] / SHAPE
            todo = todo[~ok]
    return out


# ---------------------------------------------------------------- inference of documents

def blocks(terms: list[np.ndarray], counts: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(documents, terms, counts)`` of documents of similar length, padded by counts of zero."""
    sizes = np.array([len(t) for t in terms])
    order = np.argsort(sizes, kind="stable")
    start, made = 0, []
    for stop in range(1, len(order) + 1):
        if stop == len(order) or (stop + 1 - start) * sizes[order[stop]] > CELLS:
            own = order[start:stop]
            t = np.zeros((len(own), sizes[own[-1]]), np.int64)
            n = np.zeros(t.shape)
            for i, j in enumerate(own):
                t[i, :sizes[j]], n[i, :sizes[j]] = terms[j], counts[j]
            made.append((own, t, n))
            start = stop
    return made


def _advance(beta: np.ndarray, counts: np.ndarray, alpha: np.ndarray, gamma: np.ndarray, most: int) -> np.ndarray:
    """Moves ``gamma``, rows of topic weights, until at most ``most`` documents have not settled;
    tells which.  ``beta`` has the exponential of E[log beta] of the documents' terms."""
    theta = np.exp(expectation(gamma))
    total = digamma(alpha.sum() + counts.sum(axis=1, keepdims=True))    # the weights add up to that from now on
    left = np.arange(len(gamma))
    now, running = gamma.copy(), np.ones(len(gamma), bool)
    while running.sum() > most:
        phi = (beta @ theta[:, :, None])[:, :, 0] + LEAST
        new = theta * ((counts / phi)[:, None, :] @ beta)[:, 0, :] + alpha
        theta = np.exp(digamma(new) - total)
        settled = running & ~(np.abs(new - now).sum(axis=1) / len(alpha) > SETTLED)
        now = new
        if settled.any():
            gamma[left[settled]] = now[settled]
            running &= ~settled
            if 4 * running.sum() <= 3 * len(left):
                left, beta, counts, now, theta, total = (a[running] for a in (left, beta, counts, now, theta, total))
                running = np.ones(len(left), bool)
    gamma[left[running]] = now[running]
    return left[running]


def infer(made: list[tuple[np.ndarray, np.ndarray, np.ndarray]], beta: np.ndarray, alpha: np.ndarray,
          gamma: np.ndarray) -> None:
    """Moves ``gamma``, the topic weights of all documents of the blocks, until every one has
    settled by itself.  The last ones of each block, which take long, go on together."""
    while made:
        late: list[tuple[np.ndarray, np.ndarray]] = []
        ids = []
        for own, t, n in made:
            some = gamma[own]
            for i in _advance(beta[t], n, alpha, some, len(own) // 8 if len(made) > 1 else 0):
                ids.append(own[i])
                late.append((t[i, n[i] > 0], n[i, n[i] > 0]))
            gamma[own] = some
        ids = np.array(ids, np.int64)
        made = [(ids[own], t, n) for own, t, n in blocks([t for t, _ in late], [n for _, n in late])]


def shares(beta: np.ndarray, gamma: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """E[log theta] and the likelihood of every term of a block."""
    theta = expectation(gamma)
    return theta, (beta @ np.exp(theta)[:, :, None])[:, :, 0] + LEAST


def _documents(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Terms and counts of every row; a dense vector has all terms."""
    column = batch.column(0)
    indices, values = column.field("indices"), column.field("values")
    ends, own = values.offsets.to_numpy(), values.values.to_numpy(zero_copy_only=False)
    i_ends, i_own = indices.offsets.to_numpy(), indices.values.to_numpy(zero_copy_only=False)
    for k, sparse in enumerate((column.field("type").to_numpy(zero_copy_only=False) == 0).tolist()):
        n = own[ends[k]:ends[k + 1]]
        yield (i_own[i_ends[k]:i_ends[k + 1]] if sparse else np.arange(len(n))), n


# ---------------------------------------------------------------- models

@dataclass
class Topics:
    """One model: topics x terms, document weights, prior of the terms."""
    lam: np.ndarray
    alpha: np.ndarray
    eta: float

    def log_beta(self) -> np.ndarray:
        return np.ascontiguousarray(expectation(self.lam).T)

    def update(self, stats: np.ndarray, log_theta: np.ndarray, used: int, weight: float, share: float) -> None:
        self.lam = (1 - weight) * self.lam + weight * (stats * np.exp(self.log_beta()).T * share + self.eta)
        slope = used * (log_theta / used - expectation(self.alpha))
        c, q = used * trigamma(self.alpha.sum()), -used * trigamma(self.alpha)
        step = self.alpha - weight * (slope - (slope / q).sum() / (1 / c + (1 / q).sum())) / q
        if (step > 0).all():
            self.alpha = step

    def bound(self, documents: float) -> float:
        """The bound of the corpus from that of its documents."""
        with np.errstate(all="ignore"):
            prior = np.array(self.eta * self.lam.shape[1])
            return float(documents + ((self.eta - self.lam) * self.log_beta().T).sum()
                         + (lgamma(self.lam) - lgamma(np.array(self.eta))).sum()
                         + (lgamma(prior) - lgamma(self.lam.sum(axis=1))).sum())


def _folded(docs: DataFrame, work) -> np.ndarray:
    """Sum over the tasks of the arrays that ``work(batches)`` returns, in a tree."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([work(batches).tobytes()], pa.binary())], names=["sums"])

    return docs.mapInArrow(rows, "sums binary").rdd.map(lambda r: np.frombuffer(r[0])).treeReduce(np.add)


def _iteration(models: list[Topics], sample: int, start: int, parts: int):
    """Work of a task in an iteration: documents sampled and used, then per model the sums of
    E[log theta] and of the terms of its topics."""
    betas = [np.exp(m.log_beta()) for m in models]
    alphas = [m.alpha for m in models]
    draws = JavaRandom(sample)
    seeds = [draws.long() for _ in range(parts)]

    def work(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        part = TaskContext.get().partitionId()
        taken = sampled(seeds[part], SUBSAMPLING)
        (following, times), row, seen, used = next(taken), 0, 0, 0
        first = gammas(np.array([(start + part) % 2 ** 64], np.uint64), max(map(len, alphas)))[0]
        logs = [np.zeros(len(a)) for a in alphas]
        sums = [np.zeros((len(a), len(b))) for a, b in zip(alphas, betas)]
        for batch in batches:
            terms, counts = [], []
            for t, n in _documents(batch):
                if row == following:
                    seen += times
                    if n.any():
                        terms += [t] * times
                        counts += [n] * times
                    following, times = next(taken)
                row += 1
            used += len(terms)
            made = blocks(terms, counts)
            for alpha, beta, log, total in zip(alphas, betas, logs, sums):
                gamma = np.tile(first[:len(alpha)], (len(terms), 1))
                infer(made, beta, alpha, gamma)
                for own, t, n in made:
                    theta, phi = shares(beta[t], gamma[own])
                    log += theta.sum(axis=0)
                    weights = np.exp(theta)
                    for j in range(len(alpha)):
                        total[j] += np.bincount(t.ravel(), (weights[:, j, None] * (n / phi)).ravel(), len(beta))
        return np.concatenate([[seen, used], *logs, *(s.ravel() for s in sums)])

    return work


def _bounds(models: list[Topics]):
    """Work of a task for the bounds: tokens, then the bound of its documents per model."""
    logs = [m.log_beta() for m in models]
    alphas = [m.alpha for m in models]

    def work(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        betas = [np.exp(b) for b in logs]
        row = TaskContext.get().partitionId() << 33
        out = np.zeros(1 + len(logs))
        for batch in batches:
            terms, counts, ids = [], [], []
            for t, n in _documents(batch):
                if n.any():
                    terms.append(t)
                    counts.append(n)
                    ids.append(BOUND_SEED + row)
                row += 1
            if not ids:
                continue
            first = gammas(np.array(ids, np.uint64), max(map(len, alphas)))
            made = blocks(terms, counts)
            out[0] += sum(n.sum() for _, _, n in made)
            for j, (alpha, beta, log) in enumerate(zip(alphas, betas, logs), 1):
                gamma = first[:, :len(alpha)].copy()
                infer(made, beta, alpha, gamma)
                for own, t, n in made:
                    theta, phi = shares(beta[t], gamma[own])
                    words = np.log(phi)
                    low = np.nonzero(phi < 1e-80)        # the exponentials have lost it
                    if len(low[0]):
                        x = theta[low[0]] + log[t[low]]
                        most = x.max(axis=1)
                        words[low] = most + np.log(np.exp(x - most[:, None]).sum(axis=1))
                    out[j] += (n * words).sum() + ((alpha - gamma[own]) * theta).sum()
                out[j] += (lgamma(gamma).sum() - lgamma(gamma.sum(axis=1)).sum()
                           + len(gamma) * (lgamma(alpha.sum()) - lgamma(alpha).sum()))
        return out

    return work


def fit(docs: DataFrame, ks: Sequence[int], max_iter: int, seed: int) -> list[Topics]:
    """A model for each of ``ks`` from the unwrapped vectors, all iterations in lock-step."""
    size, corpus = docs.agg(F.first(F.coalesce("v.size", F.size("v.values"))), F.count(F.lit(1))).first()
    if not corpus:
        raise ValueError("no documents")
    parts = docs.rdd.getNumPartitions()
    draws = JavaRandom(seed)
    first = gammas(np.array([draws.long() % 2 ** 64], np.uint64), max(ks) * size)[0].reshape(max(ks), size)
    models = [Topics(first[:k], np.full(k, 1 / k), 1 / k) for k in ks]
    step = 0
    for _ in range(max_iter):
        sample = draws.long()
        state = draws.state
        sums = _folded(docs, _iteration(models, sample, draws.long(), parts))
        if not sums[0]:                 # nothing was sampled: Spark draws no starting point and counts no step
            draws.state = state
            continue
        step += 1
        if not sums[1]:                 # no document with a term was sampled
            continue
        at = 2 + sum(ks)
        logs = np.split(sums[2:at], np.cumsum(ks)[:-1])
        for model, log in zip(models, logs):
            k = len(log)
            model.update(sums[at:at + k * size].reshape(k, size), log, int(sums[1]), (OFFSET + step) ** -DECAY,
                         corpus / math.ceil(SUBSAMPLING * corpus))
            at += k * size
    return models


def bounds(vectors: DataFrame, ks: Sequence[int], max_iter: int, seed: int, features: str
           ) -> tuple[float, list[float]]:
    """Tokens of the corpus, and the bound of the log-likelihood of a model for each of ``ks``.

    ``vectors`` must deal its rows the same way in every pass, as a persisted table does.
    """
    docs = vectors.select(F.unwrap_udt(features).alias("v"))
    models = fit(docs, ks, max_iter, seed)
    tokens, *found = _folded(docs, _bounds(models))
    return float(tokens), [m.bound(x) for m, x in zip(models, found)]
