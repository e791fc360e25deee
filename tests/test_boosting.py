"""Boosted trees for several classes, search and curve in lock-step, saved bundles."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from hearsay.operators import boosting as B
from hearsay.operators import models as M
from hearsay.operators.bundle import BoostedTrees, text_bundle


def toy_rows(n=150, features=4, classes=3, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        x = [rng.randrange(6) for _ in range(features)]
        y = (x[0] > 2) + (x[1] + x[0] > 6) if rng.random() < 0.85 else rng.randrange(classes)
        out.append((i, min(int(y), classes - 1), i % 5, x))
    return out


@pytest.fixture(scope="module")
def toy(spark):
    return spark.createDataFrame(toy_rows(), "id bigint, label int, fold int, bins array<smallint>").cache()


def plain_round(rows, margins, k, s, n_bins):
    """One tree by trying every split, as nested dicts."""
    g, h = {}, {}
    for i, y, _, _ in rows:
        e = [math.exp(v - max(margins[i])) for v in margins[i]]
        p = e[k] / sum(e)
        g[i], h[i] = round((p - (y == k)) * B.SCALE), round(max(2 * p * (1 - p), 1e-6) * B.SCALE)

    def grow(some, level):
        tg, th = sum(g[r[0]] for r in some) / B.SCALE, sum(h[r[0]] for r in some) / B.SCALE
        best = None
        if level < s.depth:
            for f in range(len(rows[0][3])):
                for cut in range(n_bins):
                    gl = sum(g[r[0]] for r in some if r[3][f] <= cut) / B.SCALE
                    hl = sum(h[r[0]] for r in some if r[3][f] <= cut) / B.SCALE
                    if hl < s.least or th - hl < s.least:
                        continue
                    score = lambda a, b: a * a / (b + s.ridge)
                    gain = round(score(gl, hl) + score(tg - gl, th - hl) - score(tg, th), B.DIGITS)
                    if gain > 0 and (best is None or gain > best[0]):
                        best = (gain, f, cut)
        if best is None:
            return -tg / (th + s.ridge) * s.rate
        _, f, cut = best
        return (f, cut, grow([r for r in some if r[3][f] <= cut], level + 1), grow([r for r in some if r[3][f] > cut], level + 1))

    return grow(rows, 0)


def plain_output(tree, x):
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


@pytest.mark.parametrize("leave", [None, 2])
def test_trees_against_plain_search(toy, leave):
    s = B.Setting(rounds=10, depth=3, rate=0.4, leave=leave)     # more rounds than between two writes of margins
    forest = B.fit(toy.repartition(5), 3, [s], 6)
    rows = [r for r in toy_rows() if r[2] != leave]
    margins = {r[0]: [0.0] * 3 for r in rows}
    for _ in range(s.rounds):
        trees = [plain_round(rows, margins, k, s, 6) for k in range(3)]
        for r in rows:
            margins[r[0]] = [m + plain_output(t, r[3]) for m, t in zip(margins[r[0]], trees)]
    told = forest.margins(0, np.array([r[3] for r in rows]))[:, -1]
    assert np.allclose(told, [margins[r[0]] for r in rows], atol=1e-9)


def test_dealing_of_rows_changes_nothing(toy):
    settings = [B.Setting(0, 3, 3, 0.3), B.Setting(1, 2, 2, 1.0, 0.5, leave=1)]
    one, many = (sorted(B.fit(toy.repartition(n, "id"), 3, settings, 6).rows()) for n in (1, 7))
    assert one == many and {r[0] for r in one} == {0, 1}
    alone = B.fit(toy, 3, [settings[1]], 6)
    assert sorted(alone.rows()) == [r for r in one if r[0] == 1]


def test_columns_drawn_and_rate(toy):
    shares = B.Setting(rounds=2, depth=2, columns=0.5)
    forest = B.fit(toy, 3, [shares], 6)
    for (_, r, k), tree in forest.trees.items():
        mask = B.drawn(shares, r, k, 4)
        assert all(mask[f] for f in tree.feature if f >= 0)
    slow, fast = (B.fit(toy, 3, [B.Setting(rounds=1, depth=2, rate=x)], 6) for x in (0.1, 1.0))
    for key in slow.trees:
        assert np.allclose(slow.trees[key].value * 10, fast.trees[key].value)


def test_staged_and_probabilities(toy):
    settings = [B.Setting(f, 3, 2, leave=f) for f in range(5)]
    forest = B.fit(toy, 3, settings, 6)
    rows = B.staged(toy, forest, settings).collect()
    assert len(rows) == 150 * 3 and all(r["fold"] == r["model"] and abs(sum(r["p"]) - 1) < 1e-12 for r in rows)
    last = {r["id"]: r["p"] for r in rows if r["rounds"] == 3 and r["model"] == 2}
    for r in toy.where("fold = 2").withColumn("p", B.probabilities(F.col("bins"), forest, 2)).collect():
        assert r["p"] == pytest.approx(last[r["id"]])


def test_tasks_hold_filled_cells_only(toy, monkeypatch):
    """A task works on so many cells at a time; sums are the same for short, long and wide histograms."""
    whole = sorted(B.fit(toy, 3, [B.Setting(rounds=2, depth=3)], 6).rows())
    bins = np.array([r[3] for r in toy_rows()], dtype=np.uint8)
    assert sum(len(f[3]) for f in B._filled(bins, 6)) == np.count_nonzero(bins) < bins.size
    batch = pa.RecordBatch.from_arrays(
        [pa.array([r.tobytes() for r in bins], pa.binary()), pa.array([1] * 150, pa.int32()), pa.array([0] * 150, pa.int32()),
         pa.array([[0.0] * 3] * 150, pa.list_(pa.float64()))], names=["bins", "label", "fold", "margins"])
    monkeypatch.setattr(B, "CELLS_AT_ONCE", 200)
    sizes = [len(c[0]) for c in B._chunks(iter(batch.slice(i, 10) for i in range(0, 150, 10)), 6, 4)]
    assert sum(sizes) == 150 and max(sizes) < 100
    for kind, value in ((False, 5.0), (True, 2.0 ** 40)):
        sums = np.zeros((2, 100))
        sums[:, 7] = value
        assert B._sent(0, 0, np.zeros((2, 1)), sums).to_pylist()[0]["wide"] is kind
        assert B._sent(0, 0, np.zeros((2, 1)), sums).to_pylist()[0]["places"] is not None
        assert B._sent(0, 0, np.zeros((2, 1)), sums + 1).to_pylist()[0]["places"] is None
    assert sorted(B.fit(toy.repartition(3), 3, [B.Setting(rounds=2, depth=3)], 6).rows()) == whole


def test_bins():
    cuts = B.even_cuts(10, 4)
    assert [int(b) for b in B.bin_numbers(np.arange(10.0)[:, None], cuts)[:, 0]] == [x * 4 // 10 for x in range(10)]
    own = B.bin_numbers(np.array([[1.0, 5.0], [3.0, 7.0]]), [[2.0], [6.0, 7.0]])
    assert own.tolist() == [[0, 0], [1, 2]]


def test_no_rows_and_one_class(spark, toy):
    with pytest.raises(ValueError):
        B.fit(toy.limit(0), 3, [B.Setting(rounds=1)], 6)
    forest = B.fit(toy.withColumn("label", F.lit(1)), 3, [B.Setting(rounds=2, depth=2)], 6)
    p = toy.withColumn("p", B.probabilities(F.col("bins"), forest)).first()["p"]
    assert p[1] == max(p) and sum(p) == pytest.approx(1)
    assert B.staged(toy.limit(0), forest, [B.Setting(rounds=2)]).count() == 0


def test_three_class_estimator(spark, tmp_path):
    rows = spark.createDataFrame(toy_rows(300), "id bigint, label int, fold int, x array<int>").select(
        "id", "label", array_to_vector(F.col("x").cast("array<double>")).alias("features"))
    model = M.train_trees(rows, 3, maxIter=5, maxDepth=3, stepSize=0.3, maxBins=6)
    scored = model.transform(rows)
    assert scored.where("prediction = label").count() > 240
    total = scored.select(F.aggregate(vector_to_array("probability"), F.lit(0.0), lambda a, b: a + b).alias("t"))
    assert total.where(F.abs(F.col("t") - 1) > 1e-9).count() == 0
    model.write().overwrite().save(f"{tmp_path}/trees")
    again = PipelineModel.load(f"{tmp_path}/trees")
    same = scored.select("id", "probability").join(again.transform(rows).select("id", F.col("probability").alias("p")), "id")
    assert same.where("probability <> p").count() == 0 and same.count() == 300
    curve = M.boosting_curve(rows, 3, 4, n_folds=3, maxDepth=2, maxBins=6).orderBy("rounds").collect()
    assert [r["rounds"] for r in curve] == [1, 2, 3, 4] and curve[-1]["auc_mean"] > 0.8
    found = M.search_trees(rows, 3, {"maxDepth": [1, 3], "maxIter": [1, 4]}, n_folds=3, maxBins=6).orderBy("rank").collect()
    assert len(found) == 4 and found[0]["maxIter"] == 4 and found[0]["mean_metric"] >= found[-1]["mean_metric"]


def test_text_bundle_round_trip(spark, tmp_path):
    rng = random.Random(9)
    words = [["red", "rose"], ["blue", "sea"], ["green", "leaf"]]
    rows = [(i, " ".join([rng.choice(words[i % 3])] + [rng.choice("a b c d".split()) for _ in range(i % 4)]), i % 3) for i in range(90)]
    df = spark.createDataFrame(rows + [(90, None, 0), (91, "", 1)], "id bigint, text string, label int")
    fitted = text_bundle(df, BoostedTrees(nClasses=3, maxIter=4, maxDepth=3, maxBins=32))
    fitted.write().overwrite().save(f"{tmp_path}/bundle")
    again = PipelineModel.load(f"{tmp_path}/bundle")
    new = spark.createDataFrame([(1, "rose unseen a"), (2, "sea"), (3, None)], "id bigint, text string")
    before, after = ({r["id"]: tuple(r["probability"]) for r in m.transform(new).collect()} for m in (fitted, again))
    assert before == after and len(after) == 3 and np.argmax(after[1]) == 0 and np.argmax(after[2]) == 1
    lengths = sorted(len((t or "").split()) for _, t, _ in rows + [(90, None, 0), (91, "", 1)])
    assert again.stages[1].getOrDefault("length") == lengths[int(92 * 0.95)]
