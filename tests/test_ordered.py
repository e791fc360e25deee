"""Distributed order operators against brute force, with a hot group and hot values."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearsay.operators import datasets as D
from hearsay.operators import features as FE
from hearsay.operators import ordered as O


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(11)
    groups = ["hot" if rng.random() < 0.4 else f"g{int(rng.integers(0, 5))}" for _ in range(900)]
    values = [7.0 if rng.random() < 0.35 else float(rng.integers(0, 200)) for _ in range(900)]
    data = [(i, groups[i], values[i]) for i in range(900)] + [(900, None, 1.0), (901, None, 2.0)]
    return spark.createDataFrame(data, "id int, g string, v double").cache(), data


def hashed(i, seed=42):
    return hashlib.md5(f"{i}|{seed}".encode()).hexdigest()


def test_split_by_hash_is_exact(rows):
    df, data = rows
    cuts = F.array(F.lit(0), F.lit(3), F.floor(F.col("n") * 0.5), F.col("n") + 5)
    got = {r["id"]: r["segment"] for r in O.split_by_hash(df, ["id"], cuts, ["g"]).collect()}
    assert len(got) == len(data)
    for g in {d[1] for d in data}:
        ids = sorted((d[0] for d in data if d[1] == g), key=hashed)
        edges = [0, 3, math.floor(len(ids) * 0.5), len(ids) + 5]
        for pos, i in enumerate(ids):
            assert got[i] == sum(pos >= e for e in edges)


def test_hash_sample(rows):
    df, data = rows
    got = {r["id"] for r in O.hash_sample(df, 100, ["id"]).collect()}
    assert got == set(sorted((d[0] for d in data), key=hashed)[:100])


def test_top_n_per_group(rows):
    df, data = rows
    got = sorted((r["g"], r["id"]) for r in O.top_n_per_group(
        df.where("g IS NOT NULL"), ["g"], [F.desc("v"), F.col("id")], 4).collect())
    expect = []
    for g in {d[1] for d in data if d[1]}:
        best = sorted((d for d in data if d[1] == g), key=lambda d: (-d[2], d[0]))[:4]
        expect += [(g, d[0]) for d in best]
    assert got == sorted(expect)


@pytest.mark.parametrize("ranges", [1, 3, 16])
def test_running_totals_next_and_fill(rows, ranges):
    df, data = rows
    counts = O.value_counts(df, "v")
    got = {r["v"]: r["upto"] for r in O.running_totals(counts, "v", {"upto": "_count"}, ranges=ranges).collect()}
    values = [d[2] for d in data]
    assert got == {v: sum(x <= v for x in values) for v in set(values)}
    ahead = {r["v"]: r["nv"] for r in O.next_row(counts, "v", {"nv": "v"}, ranges=ranges).collect()}
    order = sorted(set(values))
    assert ahead == dict(zip(order, order[1:] + [None]))
    known = counts.withColumn("k", F.when(F.col("v") % 5 == 0, F.col("v")))
    filled = O.fill_between(known, "v", "k", ranges=ranges).collect()
    fives = [v for v in order if v % 5 == 0]
    for r in filled:
        assert r["prev"] == max((f for f in fives if f <= r["v"]), default=None)
        assert r["next"] == min((f for f in fives if f >= r["v"]), default=None)


def test_order_statistics(rows):
    df, data = rows
    values = sorted(d[2] for d in data)
    assert O.order_statistic(df, "v", 0.95).first()[0] == values[int(len(values) * 0.95)]
    got = O.quantiles(df, "v", {"a": 0.25, "b": 0.5, "c": 0.99}).first()
    assert tuple(got) == pytest.approx(tuple(np.quantile(values, [0.25, 0.5, 0.99])))


@pytest.mark.parametrize("bracket_rows", [5, 40, 10_000])
def test_values_at_narrows_to_the_exact_value(rows, bracket_rows):
    df, data = rows
    values = sorted(d[2] for d in data)
    asked = [0, 1, 300, 301, 450, 899, len(values) - 1, len(values), -1]
    n, found = O.values_at(df.repartition(5), "v", lambda n: asked, bracket_rows)
    assert n == len(values) and found == {p: values[p] for p in asked if 0 <= p < n}


def test_values_at_odd_columns(spark):
    df = spark.createDataFrame([(1, "b", None), (2, None, None)], "i int, t string, v double")
    assert O.values_at(df, "v", lambda n: [0]) == (0, {})
    assert O.order_statistic(df, "v", 0.5).first()[0] is None and O.order_statistic(df, "i", 0.5).first()[0] == 2
    assert tuple(O.quantiles(df, "v", {"a": 0.5}).first()) == (None,)
    wild = spark.createDataFrame([(float(x),) for x in ("nan", "inf", "-inf", 0, 1, 1)], "v double")
    assert O.values_at(wild, "v", lambda n: range(n), 2)[1][0] == float("-inf")
    big = spark.range(200_000).select((F.col("id") * 7919 % 200_003).alias("v"))
    want = sorted(i * 7919 % 200_003 for i in range(200_000))
    assert O.values_at(big, "v", lambda n: [n // 3, n - 1], 1_000)[1] == {66_666: want[66_666], 199_999: want[-1]}


def test_splits(rows):
    df, data = rows
    parts = D.stratified_split(df, "g").collect()
    for g in {d[1] for d in data}:
        n = sum(d[1] == g for d in data)
        assert sum(r["g"] == g and r["split"] == "test" for r in parts) == math.ceil(n * 0.2)
    labelled = df.withColumn("label", F.when(F.col("g") == "hot", 0).when(F.col("g") == "g1", 1))
    parts = D.balanced_split(labelled, "label", 20, {0: 15, 1: 5}, {0: 30}).collect()
    size = lambda lab, s: sum(r["label"] == lab and r["split"] == s for r in parts)
    n1 = sum(d[1] == "g1" for d in data)
    assert [size(0, s) for s in ("train", "valid", "test")] == [20, 15, 30]
    assert [size(1, s) for s in ("train", "valid", "test")] == [20, 5, n1 - 25]
    assert len({r["id"] for r in parts}) == len(parts)


def test_complement_modes(spark):
    every = spark.createDataFrame([(1,), (2,), (2,), (3,)], "id int")
    sample = spark.createDataFrame([(1,)], "id int")
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert ids(D.complement(every, sample)) == [2, 2, 3]
    assert ids(D.complement(every, sample, mode="unique")) == [3]


def test_padding(spark):
    df = spark.createDataFrame([(1, [1, 2, 3, 4, 5]), (2, [1]), (3, [])], "id int, a array<bigint>")
    got = {r["id"]: r["p"] for r in df.select("id", FE.pad(F.col("a"), 3).alias("p")).collect()}
    assert got == {1: [3, 4, 5], 2: [1, 0, 0], 3: [0, 0, 0]}


def test_vocabulary_and_encoding(spark):
    train = spark.createDataFrame([(1, ["b", "a", "the"]), (2, ["the", "them", "é"])],
                                  "id int, tokens array<string>")
    vocab = FE.vocabulary(train)
    words = {r["word"]: r["word_id"] for r in vocab.collect()}
    assert words == {w: i + 2 for i, w in enumerate(sorted(["a", "b", "the", "them", "é"]))}
    texts = spark.createDataFrame([(7, ["the", "new", "the", "a"]), (8, [])], "id int, tokens array<string>")
    got = {r["id"]: r["ids"] for r in FE.encode(texts, vocab).collect()}
    assert got == {7: [words["the"], 1, words["the"], words["a"]], 8: []}
    labels = FE.label_index(train.select(F.lit("z").alias("label")), train.select(F.lit("b").alias("label")))
    assert {r["label"]: r["label_id"] for r in labels.collect()} == {"b": 0, "z": 1}


def test_unflatten(spark):
    flat = spark.createDataFrame([(i, float(i)) for i in range(6)], "pos long, value double")
    assert sorted(tuple(r) for r in FE.unflatten(flat, 3).collect()) == [(0, 0.0, 1.0, 2.0), (1, 3.0, 4.0, 5.0)]


def test_infinite_values(spark):
    rows = [(float("inf"),), (float("-inf"),), (1.0,), (2.0,), (float("inf"),)]
    df = spark.createDataFrame(rows, "v double")
    assert O.order_statistic(df, "v", 0.5).first()[0] == 2.0
