"""Gradient-boosted trees for any number of classes, many models in lock-step.

Every round grows one tree per class on the gradients of the softmax loss.  Features are
binned once; a level of all trees of all models (settings, folds) is one job: tasks turn
their rows into histograms per tree and block of features, a shuffle brings the
histograms of one block together, and each block offers its best split per node.  The
driver sees one row per open node, never rows of the data.

Most cells of padded rows lie in the first bin, so a histogram counts the others only; the
first bin of a feature is what is left of the sums of the node.  A task holds the cells of
``CELLS_AT_ONCE`` at a time and sends a histogram as a list of its filled cells where that
is shorter.

Gradients are rounded to multiples of 1 / ``SCALE`` and summed as integers, so the trees
do not depend on how rows are dealt over tasks or on a task that is run again.  Ties go
to the lower feature, then to the lower bin.

Margins are written every ``REFRESH`` rounds; in between a task adds the newer trees.
``staged`` reads the margins after every round from one pass over the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearsay.session import cut_lineage

SCALE = 1 << 24          # gradients are multiples of 1 / SCALE
BLOCK_FEATURES = 64      # features of one histogram
CELLS_AT_ONCE = 1 << 24  # cells outside the first bin behind one histogram of a task
ROWS_AT_ONCE = 1 << 16   # and rows, at most, up to one Arrow batch more
REFRESH = 8              # rounds between two writes of the margins
DIGITS = 9               # gains are compared after rounding

_SPLIT = "tree int, node int, gain double, feature int, cut int, gl bigint, hl bigint, g bigint, h bigint"
_HISTOGRAM = "tree int, block int, totals binary, places binary, sums binary, wide boolean"
TREES = "model int, round int, cls int, node int, feature int, cut int, value double"


@dataclass(frozen=True)
class Setting:
    """One model: ``leave`` is the fold that it does not see."""
    model: int = 0
    rounds: int = 100
    depth: int = 6
    rate: float = 0.3
    columns: float = 1.0
    ridge: float = 1.0
    least: float = 1.0     # sum of second derivatives on either side of a split
    leave: int | None = None
    seed: int = 42


@dataclass
class Tree:
    """A heap of nodes: the children of i are 2i + 1 (bin <= cut) and 2i + 2; feature -1 is a leaf."""
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @classmethod
    def root(cls, depth: int) -> "Tree":
        size = (1 << (depth + 1)) - 1
        return cls(np.full(size, -1, np.int32), np.zeros(size, np.int32), np.zeros(size))

    def nodes(self, bins: np.ndarray, levels: int | None = None) -> np.ndarray:
        """Node of every row, after at most ``levels`` steps."""
        at = np.zeros(len(bins), dtype=np.int64)
        rows = np.arange(len(bins))
        deepest = len(self.feature).bit_length() - 1
        for _ in range(deepest if levels is None else levels):
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                break
            right = bins[rows, np.maximum(f, 0)] > self.cut[at]
            at = np.where(inner, 2 * at + 1 + right, at)
        return at

    def output(self, bins: np.ndarray) -> np.ndarray:
        return self.value[self.nodes(bins)]


@dataclass
class Forest:
    """Trees by (model, round, class)."""
    n_classes: int
    trees: dict[tuple[int, int, int], Tree] = field(default_factory=dict)

    def rounds(self, model: int) -> int:
        return 1 + max((r for m, r, _ in self.trees if m == model), default=-1)

    def margins(self, model: int, bins: np.ndarray) -> np.ndarray:
        """(row, round, class): running sums of the trees' outputs."""
        n = self.rounds(model)
        out = np.zeros((len(bins), n, self.n_classes))
        for r in range(n):
            for k in range(self.n_classes):
                out[:, r, k] = self.trees[model, r, k].output(bins)
        return np.cumsum(out, axis=1)

    def rows(self) -> Iterator[tuple]:
        for (model, r, k), t in sorted(self.trees.items()):
            there = [0]
            for i in there:
                leaf = t.feature[i] < 0
                yield (model, r, k, i, int(t.feature[i]), int(t.cut[i]), float(t.value[i]))
                if not leaf:
                    there += [2 * i + 1, 2 * i + 2]

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rows()), TREES)

    @classmethod
    def from_rows(cls, rows: Sequence, n_classes: int) -> "Forest":
        """From rows of ``table``; a forest is as large as its settings allow."""
        grouped: dict[tuple, list] = {}
        for r in rows:
            grouped.setdefault((r["model"], r["round"], r["cls"]), []).append(r)
        forest = cls(n_classes)
        for key, nodes in grouped.items():
            depth = (max(r["node"] for r in nodes) + 1).bit_length() - 1
            tree = forest.trees[key] = Tree.root(depth)
            for r in nodes:
                tree.feature[r["node"]], tree.cut[r["node"]], tree.value[r["node"]] = r["feature"], r["cut"], r["value"]
        return forest


# ---------------------------------------------------------------- bins

def even_cuts(top: int, bins: int) -> list[float]:
    """Cuts of the integers [0, top) into ranges of equal width: bin = x * bins // top."""
    return [float(-(-top * i // bins)) for i in range(1, bins)]


def quantile_cuts(df: DataFrame, features: str, bins: int) -> list[list[float]]:
    """Cuts per feature at approximate quantiles; one small row per feature."""
    cells = df.select(F.posexplode(features).alias("f", "x"))
    asked = [i / bins for i in range(1, bins)]
    rows = cells.groupBy("f").agg(F.percentile_approx("x", asked, 1_000).alias("q")).orderBy("f").collect()
    return [sorted({float(v) for v in r["q"]}) for r in rows]


def bin_numbers(values: np.ndarray, cuts: Sequence) -> np.ndarray:
    """How many cuts are at or below each value; ``cuts`` is one list, or one per feature."""
    if cuts and isinstance(cuts[0], (list, tuple)):
        return np.stack([np.searchsorted(c, values[:, j], side="right") for j, c in enumerate(cuts)], axis=1) \
            if values.shape[1] else values.astype(np.int16)
    return np.searchsorted(np.asarray(cuts, dtype=float), values, side="right")


def _matrix(column: pa.Array) -> np.ndarray:
    """An Arrow column of equally long lists as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(column) and len(flat) % len(column):
        raise ValueError("rows differ in their number of features")
    return flat.reshape(len(column), -1)


def binned(features: Column, cuts: Sequence) -> Column:
    """Feature values (array of numbers) -> bin numbers (array of smallint)."""
    def number(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for values in batches:
            cells = _matrix(values)
            bins = np.empty(cells.shape, dtype=np.int16)
            for i in range(0, len(cells), 512):
                bins[i:i + 512] = bin_numbers(cells[i:i + 512], cuts)
            ends = np.arange(len(bins) + 1, dtype=np.int32) * bins.shape[1]
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(bins.ravel()))

    number.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(number, "array<smallint>")(features.cast("array<double>"))


# ---------------------------------------------------------------- one level

def softmax(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def drawn(setting: Setting, round_: int, cls: int, features: int) -> np.ndarray | None:
    """Which features a tree may use, by hash; None for all."""
    if setting.columns >= 1:
        return None
    limit = setting.columns * 16 ** 8
    return np.array([int(hashlib.md5(f"{setting.seed}|{round_}|{cls}|{f}".encode()).hexdigest()[:8], 16) < limit
                     for f in range(features)], dtype=bool)


@dataclass
class _Round:
    """What a task needs: trees newer than the written margins, trees that grow, open nodes."""
    settings: list[Setting]
    n_classes: int
    n_bins: int
    newer: Forest
    growing: dict[tuple[int, int], Tree]
    level: int
    open: dict[tuple[int, int], np.ndarray]      # node -> place among the open ones, or -1


def _bin_kind(n_bins: int) -> type:
    return np.uint8 if n_bins <= 1 << 8 else np.uint16


def _packed(n_bins: int) -> Column:
    """The bins of a row as bytes: tasks read every row once per level."""
    def pack(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield pa.array([row.tobytes() for row in _matrix(column).astype(_bin_kind(n_bins))], pa.binary())

    pack.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(pack, "binary")("bins")


def _unpacked(column: pa.Array, n_bins: int, features: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=_bin_kind(n_bins)).reshape(len(column), features)


def _chunks(batches: Iterator[pa.RecordBatch], n_bins: int, features: int) -> Iterator[tuple]:
    """Bins, labels, folds and margins of so many rows as a task works on together."""
    held, cells, rows = [], 0, 0

    def joined() -> tuple:
        one = tuple(np.concatenate(parts) for parts in zip(*held))
        held.clear()
        return one

    for batch in batches:
        bins = _unpacked(batch.column("bins"), n_bins, features)
        held.append((bins, *[batch.column(c).to_numpy(zero_copy_only=False) for c in ("label", "fold")],
                     _matrix(batch.column("margins"))))
        cells, rows = cells + np.count_nonzero(bins), rows + len(bins)
        if cells >= CELLS_AT_ONCE or rows >= ROWS_AT_ONCE:
            yield joined()
            cells = rows = 0
    if rows:
        yield joined()


def _filled(bins: np.ndarray, n_bins: int) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """Per block of features (first feature, width, cells per row, places) the cells outside the first bin."""
    out = []
    for block in range(0, bins.shape[1], BLOCK_FEATURES):
        part = np.ascontiguousarray(bins[:, block:block + BLOCK_FEATURES])
        at = np.flatnonzero(part)
        place = at % part.shape[1] * (n_bins - 1) + (part.ravel()[at] - 1)
        out.append((block, part.shape[1], np.count_nonzero(part, axis=1), place.astype(np.int32)))
    return out


def _sent(tree: int, block: int, totals: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    """One row of ``_HISTOGRAM``; ``sums`` holds the cells outside the first bin."""
    wide = bool(max(sums.max(initial=0), -sums.min(initial=0)) >= 1 << 31)
    kind = np.int64 if wide else np.int32
    at = np.flatnonzero(sums[1])            # second derivatives of rows are never zero
    short = len(at) * (4 + 2 * kind().itemsize) < sums.size * kind().itemsize
    places = at.astype(np.int32).tobytes() if short else None
    body = (sums[:, at] if short else sums).astype(kind).tobytes()
    return pa.RecordBatch.from_arrays(
        [pa.array([tree], pa.int32()), pa.array([block], pa.int32()), pa.array([totals.astype(np.int64).tobytes()], pa.binary()),
         pa.array([places], pa.binary()), pa.array([body], pa.binary()), pa.array([wide])],
        names=[c.split()[0] for c in _HISTOGRAM.split(", ")])


def _histograms(job: _Round, features: int):
    classes, b = job.n_classes, job.n_bins

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bins, label, fold, margins in _chunks(batches, b, features):
            margins = margins.reshape(len(bins), -1, classes)
            blocks = _filled(bins, b)
            for m, s in enumerate(job.settings):
                grown = [k for k in range(classes) if (m, k) in job.open]
                if not grown:
                    continue
                total = margins[:, m]
                if job.newer.trees:
                    told = job.newer.margins(s.model, bins)
                    if told.shape[1]:
                        total = total + told[:, -1]
                p = softmax(total)
                for k in grown:
                    g = np.rint((p[:, k] - (label == k)) * SCALE)
                    h = np.rint(np.maximum(2 * p[:, k] * (1 - p[:, k]), 1e-6) * SCALE)
                    places = job.open[m, k]
                    q = places[job.growing[m, k].nodes(bins, job.level)]
                    if s.leave is not None:
                        q = np.where(fold != s.leave, q, -1)
                    inside = q >= 0
                    share = inside.mean()
                    if not share:
                        continue
                    nodes = int(places.max()) + 1
                    q, g, h = (np.where(inside, v, 0) for v in (q, g, h))
                    totals = np.stack([np.bincount(q, v, nodes) for v in (g, h)])
                    for block, width, filled, place in blocks:
                        if share < 0.5:     # others add nothing, but take time
                            place, filled = place[np.repeat(inside, filled)], np.where(inside, filled, 0)
                        size = width * (b - 1)
                        cell = np.repeat(q * size, filled) + place
                        sums = np.stack([np.bincount(cell, np.repeat(v, filled), nodes * size) for v in (g, h)])
                        yield _sent(m * classes + k, block, totals, sums)

    return run


def best_splits(g: np.ndarray, h: np.ndarray, setting: Setting, block: int, allowed: np.ndarray | None):
    """Per node the best split of a block; ``g`` and ``h`` are integers (node, feature, bin)."""
    gl, hl = g.cumsum(axis=2), h.cumsum(axis=2)
    total_g, total_h = gl[:, :1, -1:], hl[:, :1, -1:]
    a, c, t = gl / SCALE, hl / SCALE, total_g / SCALE
    ht = total_h / SCALE
    score = lambda x, y: x * x / (y + setting.ridge)
    gain = np.round(score(a, c) + score(t - a, ht - c) - score(t, ht), DIGITS)
    gain[(c < setting.least) | (ht - c < setting.least)] = -1
    if allowed is not None:
        gain[:, ~allowed[block:block + g.shape[1]]] = -1
    flat = gain.reshape(len(g), -1)
    at = flat.argmax(axis=1)
    f, cut = at // g.shape[2], at % g.shape[2]
    rows = np.arange(len(g))
    return (flat[rows, at], f + block, cut, gl[rows, f, cut], hl[rows, f, cut],
            total_g[:, 0, 0], total_h[:, 0, 0])


def _offers(job: _Round, round_: int, features: int):
    classes, b = job.n_classes, job.n_bins
    masks = {(m, k): drawn(job.settings[m], round_, k, features) for m, k in job.open}

    def offer(tree: int, block: int, totals: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
        m, k = divmod(tree, classes)
        places = job.open[m, k]
        nodes = int(places.max()) + 1
        filled = sums.reshape(2, nodes, min(BLOCK_FEATURES, features - block), b - 1)
        first = totals.reshape(2, nodes, 1) - filled.sum(axis=3)
        g, h = np.concatenate([first[..., None], filled], axis=3)
        found = best_splits(g, h, job.settings[m], block, masks[m, k])
        node = np.flatnonzero(places >= 0)
        kinds = (pa.float64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array([tree] * nodes, pa.int32()), pa.array(node[np.argsort(places[node])], pa.int32()),
             *[pa.array(c, t) for c, t in zip(found, kinds)]],
            names=[c.split()[0] for c in _SPLIT.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, totals, sums = None, None, None
        for batch in batches:
            for i in range(batch.num_rows):
                tree, block, total, at, body, wide = (c[i] for c in batch.columns)
                tree, block = tree.as_py(), block.as_py()
                if key != (tree, block):
                    if key is not None:
                        yield offer(*key, totals, sums)
                    key, totals = (tree, block), np.zeros(len(total.as_buffer()) // 8, dtype=np.int64)
                    sums = np.zeros((2, len(totals) // 2 * min(BLOCK_FEATURES, features - block) * (b - 1)), dtype=np.int64)
                totals += np.frombuffer(total.as_buffer(), dtype=np.int64)
                part = np.frombuffer(body.as_buffer(), dtype=np.int64 if wide.as_py() else np.int32).reshape(2, -1)
                if at.is_valid:
                    filled = np.frombuffer(at.as_buffer(), dtype=np.int32).astype(np.int64)
                    sums[0, filled] += part[0]
                    sums[1, filled] += part[1]
                else:
                    sums += part
        if key is not None:
            yield offer(*key, totals, sums)

    return run


# ---------------------------------------------------------------- fitting

def _with_margins(rows: DataFrame, settings: list[Setting], n_classes: int, n_bins: int, features: int,
                  newer: Forest) -> DataFrame:
    """Adds the outputs of ``newer`` to the margins and writes the rows."""
    def add(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for margins, bins in batches:
            own = _unpacked(bins, n_bins, features)
            total = _matrix(margins).reshape(len(own), -1, n_classes).copy()
            for m, s in enumerate(settings):
                told = newer.margins(s.model, own)
                if told.shape[1]:
                    total[:, m] += told[:, -1]
            ends = np.arange(len(own) + 1, dtype=np.int32) * (total.shape[1] * n_classes)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(total.ravel()))

    add.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return cut_lineage(rows.withColumn("margins", F.arrow_udf(add, "array<double>")("margins", "bins")))


def fit(rows: DataFrame, n_classes: int, settings: Sequence[Setting], n_bins: int) -> Forest:
    """Fits all ``settings`` in lock-step; ``rows`` has ``bins``, ``label`` (0, 1, ...) and,
    where a setting leaves one out, ``fold``.  Rows without a label are not used."""
    settings = list(settings)
    forest = Forest(n_classes)
    fold = F.col("fold").cast("int") if "fold" in rows.columns else F.lit(-1)
    zero = F.array_repeat(F.lit(0.0), len(settings) * n_classes)
    data = cut_lineage(rows.where(F.col("label").isNotNull()).select(
        _packed(n_bins).alias("bins"), F.col("label").cast("int").alias("label"), F.coalesce(fold, F.lit(-1)).alias("fold"),
        zero.alias("margins")))
    first = data.select(F.length("bins").alias("n")).first()
    if first is None:
        raise ValueError("no labelled rows")
    features = first["n"] // _bin_kind(n_bins)().itemsize
    newer = Forest(n_classes)
    for round_ in range(max(s.rounds for s in settings)):
        at_work = [m for m, s in enumerate(settings) if round_ < s.rounds]
        growing = {(m, k): Tree.root(settings[m].depth) for m in at_work for k in range(n_classes)}
        _grow(data, forest.n_classes, settings, n_bins, round_, features, newer, growing)
        for (m, k), tree in growing.items():
            key = (settings[m].model, round_, k)
            forest.trees[key] = tree
            newer.trees[settings[m].model, round_ % REFRESH, k] = tree
        if (round_ + 1) % REFRESH == 0:
            data = _with_margins(data, settings, n_classes, n_bins, features, newer)
            newer = Forest(n_classes)
    return forest


def _grow(data: DataFrame, n_classes: int, settings: list[Setting], n_bins: int, round_: int, features: int,
          newer: Forest, growing: dict[tuple[int, int], Tree]) -> None:
    open_nodes = {key: [0] for key in growing}
    level = 0
    while open_nodes:
        places = {}
        for key, nodes in open_nodes.items():
            places[key] = np.full(len(growing[key].feature), -1, dtype=np.int64)
            places[key][nodes] = np.arange(len(nodes))
        job = _Round(settings, n_classes, n_bins, newer, growing, level, places)
        offers = (data.mapInArrow(_histograms(job, features), _HISTOGRAM)
                  .repartition("tree", "block").sortWithinPartitions("tree", "block")
                  .mapInArrow(_offers(job, round_, features), _SPLIT))
        chosen = (offers.groupBy("tree", "node")
                  .agg(F.max(F.struct("gain", (-F.col("feature")).alias("f"), (-F.col("cut")).alias("c"),
                                      "gl", "hl", "g", "h")).alias("s")).select("tree", "node", "s.*").collect())
        following: dict[tuple[int, int], list[int]] = {}
        for r in sorted(chosen):                      # one row per open node
            m, k = divmod(r["tree"], n_classes)
            s, tree, node = settings[m], growing[m, k], r["node"]
            leaf = lambda g, h: -(g / SCALE) / (h / SCALE + s.ridge) * s.rate
            if r["gain"] <= 0 or level >= s.depth:
                tree.value[node] = leaf(r["g"], r["h"])
                continue
            tree.feature[node], tree.cut[node] = -r["f"], -r["c"]
            for child, g, h in ((2 * node + 1, r["gl"], r["hl"]), (2 * node + 2, r["g"] - r["gl"], r["h"] - r["hl"])):
                tree.value[child] = leaf(g, h)
                # neither side of a node that light could hold the least sum
                if level + 1 < s.depth and h / SCALE >= 2 * s.least:
                    following.setdefault((m, k), []).append(child)
        open_nodes = {key: sorted(nodes) for key, nodes in following.items()}
        level += 1


# ---------------------------------------------------------------- scoring

def probabilities(bins: Column, forest: Forest, model: int = 0) -> Column:
    """Probabilities of the classes after the last round, as an array."""
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            own = _matrix(column)
            told = forest.margins(model, own)
            p = softmax(told[:, -1]) if told.shape[1] else np.full((len(own), forest.n_classes), 1 / forest.n_classes)
            yield pa.array(list(p), pa.list_(pa.float64()))

    score.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(score, "array<double>")(bins)


def staged(rows: DataFrame, forest: Forest, settings: Sequence[Setting]) -> DataFrame:
    """One row per input row, model that left its fold out (or saw no folds) and round:
    ``(..., model, rounds, p)`` with the probabilities after that many rounds."""
    settings = list(settings)

    def score(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("model", pa.int32()), ("rounds", pa.int32()), ("p", pa.list_(pa.float64()))]))
        for bins, folds in batches:
            own = _matrix(bins)
            fold = np.array([-1 if f is None else f for f in folds.to_pylist()])
            out: list[list] = [[] for _ in range(len(own))]
            for s in settings:
                at = np.arange(len(own)) if s.leave is None else np.flatnonzero(fold == s.leave)
                if not len(at):
                    continue
                p = softmax(forest.margins(s.model, own[at]))
                for i, one in zip(at.tolist(), p):
                    out[i] += [{"model": s.model, "rounds": r + 1, "p": x} for r, x in enumerate(one)]
            yield pa.array(out, kind)

    score.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    made = F.arrow_udf(score, "array<struct<model: int, rounds: int, p: array<double>>>")
    fold = F.col("fold").cast("int") if "fold" in rows.columns else F.lit(-1)
    kept = [c for c in rows.columns if c not in ("bins", "model", "rounds", "p")]
    return rows.withColumn("_s", made("bins", fold)).select(*kept, F.inline("_s"))
