"""Exact evaluation: golden example, brute force, skewed scores."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearsay.operators import evaluation as E

S = ["s_0", "s_1", "s_2"]
# six labels with three scores each; expected metrics are known by hand
Y = [1, 0, 1, 2, 2, 0]


def brute_auc(y, s):
    pos, neg = [a for a, b in zip(s, y) if b], [a for a, b in zip(s, y) if not b]
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(3)
    n = 400
    y = rng.integers(0, 3, n)
    s = rng.integers(0, 12, (n, 3)) / 12.0
    s[rng.random(n) < 1 / 3] = [0.5, 0.25, 0.25]   # a third of all rows shares one score
    rows = [(i, int(y[i]), *map(float, s[i])) for i in range(n)]
    return spark.createDataFrame(rows, "id int, y int, s_0 double, s_1 double, s_2 double").cache(), y, s


def test_golden_example(spark):
    scores = [(0.16, 0.69, 0.15), (0.25, 0.47, 0.28), (0.20, 0.75, 0.05), (0.0, 0.08, 0.92),
              (0.05, 0.1, 0.85), (0.1, 0.2, 0.1)]
    pred = spark.createDataFrame([(y, int(np.argmax(s))) for y, s in zip(Y, scores)], "y int, pred int")
    row = E.accuracy_f1(pred, 3).first()
    assert [r["pred"] for r in pred.collect()] == [1, 1, 1, 2, 2, 1]
    assert row["accuracy"] == pytest.approx(4 / 6)
    fixed = spark.createDataFrame(list(zip(Y, [1, 0, 1, 2, 2, 1])), "y int, pred int")
    row = E.accuracy_f1(fixed, 3).first()
    assert row["accuracy"] == pytest.approx(0.833333, abs=1e-6)
    assert [row[f"f1_{i}"] for i in range(3)] == pytest.approx([0.666667, 0.8, 1.0], abs=1e-6)
    assert row["macro_f1"] == pytest.approx(0.822222, abs=1e-6)
    hard = spark.createDataFrame([(y, *[float(p == i) for i in range(3)]) for y, p in zip(Y, [1, 0, 1, 2, 2, 1])],
                                 "y int, s_0 double, s_1 double, s_2 double")
    areas = {r["cls"]: r["auc"] for r in E.auc_per_class(hard, S).collect()}
    assert areas == pytest.approx({0: 0.75, 1: 0.875, 2: 1.0})
    assert E.auc_hardened(hard, S).first()[0] == pytest.approx(0.875)


def test_confusion(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1)], "y int, pred int")
    assert sorted(tuple(r) for r in E.confusion(df, 3).collect()) == [(0, 1, 1, 0), (1, 0, 1, 0), (2, 0, 0, 0)]
    norm = {r["y"]: tuple(r)[1:] for r in E.confusion_norm(df, 3).collect()}
    assert norm[0] == (0.5, 0.5, 0.0) and norm[2] == (None, None, None)


def test_areas_match_brute_force(sample):
    df, y, s = sample
    per_class = {r["cls"]: r["auc"] for r in E.auc_per_class(df, S).collect()}
    expect = {i: brute_auc(y == i, s[:, i]) for i in range(3)}
    assert per_class == pytest.approx(expect)
    assert E.auc_ovr(df, S).first()[0] == pytest.approx(np.mean(list(expect.values())))
    onehot = np.eye(3)[y].astype(bool)
    assert E.auc_micro(df, S).first()[0] == pytest.approx(brute_auc(onehot.ravel(), s.ravel()))
    pairs = []
    for a, b in ((0, 1), (0, 2), (1, 2)):
        m = (y == a) | (y == b)
        pairs.append((brute_auc(y[m] == a, s[m, a]) + brute_auc(y[m] == b, s[m, b])) / 2)
    assert E.auc_ovo(df, S).first()[0] == pytest.approx(np.mean(pairs))
    flipped = df.select("id", "y", *[(-F.col(c)).alias(c) for c in S])
    swapped = {r["cls"]: r["auc"] for r in E.auc_per_class(flipped, S).collect()}
    assert swapped == pytest.approx({k: 1 - v for k, v in expect.items()})


def brute_roc(pos, s):
    order = sorted(set(s), reverse=True)
    tps = [sum(p for p, v in zip(pos, s) if v >= t) for t in order]
    fps = [sum((not p) for p, v in zip(pos, s) if v >= t) for t in order]
    keep = [0 < i < len(order) - 1 and tps[i + 1] - 2 * tps[i] + tps[i - 1] == 0
            and fps[i + 1] - 2 * fps[i] + fps[i - 1] == 0 for i in range(len(order))]
    x = [0.0] + [f / fps[-1] for f, k in zip(fps, keep) if not k]
    t = [0.0] + [f / tps[-1] for f, k in zip(tps, keep) if not k]
    return x, t


def test_roc_and_macro_curve(sample):
    df, y, s = sample
    points = E.roc(E.one_vs_rest(df, S)).cache()
    curves = {}
    for i in range(3):
        x, t = brute_roc(list(y == i), list(s[:, i]))
        got = sorted((r["fpr"], r["tpr"]) for r in points.where(f"cls = {i}").collect())
        assert np.allclose(got, sorted(zip(x, t)))
        curves[i] = (x, t)
    grid = np.unique(np.concatenate([curves[i][0] for i in range(3)]))
    mean = sum(np.interp(grid, *curves[i]) for i in range(3)) / 3
    macro = E.macro_roc(points, 3)
    got = sorted((r["fpr"], r["tpr"]) for r in macro.collect())
    assert [g[0] for g in got] == pytest.approx(list(grid))
    assert [g[1] for g in got] == pytest.approx(list(mean))
    assert E.curve_auc(macro).first()[0] == pytest.approx(np.trapezoid(mean, grid))


def test_compare_and_report(sample):
    df, y, s = sample
    both = df.withColumn("model", F.lit("m")).unionByName(df.withColumn("model", F.lit("n")))
    rows = E.compare(both, S).collect()
    assert len(rows) == 2 and rows[0]["auc_ovr"] == pytest.approx(rows[1]["auc_ovr"])
    report = E.report(df, S)
    total = report["confusion"].agg(F.sum(F.col("pred_0") + F.col("pred_1") + F.col("pred_2"))).first()[0]
    assert total == 400
    assert report["scores"].first()["accuracy"] == pytest.approx(np.mean(s.argmax(1) == y))


def test_bootstrap(sample):
    df, _, _ = sample
    scored = E.with_prediction(df, S)
    row = E.bootstrap(scored, 3, n_resamples=20).first()
    assert row["low"] <= row["score"] + 0.1 and row["score"] <= row["high"] + 0.1
    assert 0 < row["standard_error"] < 0.1
    assert tuple(row) == tuple(E.bootstrap(scored, 3, n_resamples=20).first())
