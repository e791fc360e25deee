"""Golden values and properties of the network operators."""

import math
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearsay.functions.stats import binomial_cdf_array
from hearsay.operators import backbone as B
from hearsay.operators import graph as G

G1 = [("a", "b", 4.0), ("a", "c", 1.0), ("a", "d", 1.0), ("b", "c", 2.0), ("c", "a", 3.0),
      ("d", "a", 1.0), ("b", "b", 2.0)]


@pytest.fixture(scope="module")
def g1(spark):
    return spark.createDataFrame(G1, "src string, trg string, nij double").cache()


def table(df, *cols):
    return {(r["src"], r["trg"]): tuple(r[c] for c in cols) for r in df.collect()}


def test_noise_corrected(g1):
    got = table(B.noise_corrected(g1, return_self_loops=True), "score", "sdev_cij")
    expect = {("a", "b"): (0.217391, 0.007977), ("a", "c"): (-0.125, 0.277703),
              ("a", "d"): (0.4, 0.030830), ("b", "c"): (0.4, 0.005284), ("c", "a"): (0.555556, 0.073446),
              ("d", "a"): (0.555556, 0.046107), ("b", "b"): (0.076923, 0.090374)}
    assert got.keys() == expect.keys()
    for k, v in expect.items():
        assert got[k] == pytest.approx(v, abs=1e-6)
    assert ("b", "b") not in table(B.noise_corrected(g1), "score")
    assert set(table(B.noise_corrected(g1, undirected=True), "score")) == {
        ("a", "b"), ("a", "c"), ("a", "d"), ("b", "c")}


def test_noise_corrected_p_value(g1):
    got = table(B.noise_corrected(g1, p_value=True), "score")
    expect = {("a", "b"): 0.902700, ("a", "c"): 0.627110, ("a", "d"): 0.933173, ("b", "c"): 0.949752,
              ("c", "a"): 0.991444, ("d", "a"): 0.967793, ("b", "b"): 0.758995}
    for k, v in expect.items():
        assert got[k][0] == pytest.approx(v, abs=1e-6)


def test_binomial_cdf_against_sums():
    for n, p in ((1, 0.3), (10, 0.5), (40, 0.01), (300, 0.2), (300, 0.999)):
        exact, total, q = [0.0], Fraction(0), Fraction(p)
        for j in range(n + 1):
            total += math.comb(n, j) * q**j * (1 - q)**(n - j)
            exact.append(float(total))
        ks = np.arange(-1, n + 1)
        got = binomial_cdf_array(ks, np.full(len(ks), n), np.full(len(ks), p))
        assert np.allclose(got, exact, rtol=1e-8, atol=1e-300)
    assert binomial_cdf_array([5e8], [1e9], [0.5])[0] == pytest.approx(0.5, abs=1e-4)


def test_disparity(g1):
    got = table(B.disparity(g1, return_self_loops=True), "score", "variance")
    expect = {("a", "b"): (0.888889, 0.15), ("a", "c"): (0.305556, 0.15), ("a", "d"): (0.305556, 0.15),
              ("b", "c"): (0.5, 0.088889), ("c", "a"): (0, 0), ("d", "a"): (0, 0),
              ("b", "b"): (0.5, 0.088889)}
    for k, v in expect.items():
        assert got[k] == pytest.approx(v, abs=1e-6)
    both = table(B.disparity(g1, undirected=True), "score", "variance")
    assert both[("a", "c")] == pytest.approx((0.305556, 0.0), abs=1e-6)


def test_alpha_undirected(spark):
    edges = spark.createDataFrame([("a", "b", 4.0), ("a", "c", 1.0), ("a", "d", 1.0), ("b", "c", 2.0),
                                   ("x", "y", 1.0)], "src string, trg string, nij double")
    got = table(B.alpha_undirected(edges), "alpha")
    assert {k: v[0] for k, v in got.items()} == {
        ("a", "b"): 0.1111, ("a", "c"): 0.6667, ("a", "d"): 0.6944, ("b", "c"): 0.3333}
    assert set(table(B.alpha_cut(B.alpha_undirected(edges), 0.4), "nij")) == {("a", "b"), ("b", "c")}


def test_alpha_directed(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("c", "d", 1.0), ("c", "e", 3.0), ("f", "e", 1.0)],
                                  "src string, trg string, nij double")
    got = table(B.alpha_directed(edges), "alpha_out", "alpha_in")
    assert got[("a", "b")] == (0.0, 0.0)
    assert got[("c", "d")] == (0.75, None)
    assert got[("c", "e")] == (0.25, 0.25)
    assert got[("f", "e")] == (None, 0.75)
    scored = B.alpha_directed(edges)
    assert set(table(B.alpha_cut(scored, 0.3, "or"), "nij")) == {("a", "b"), ("c", "e")}
    assert set(table(B.alpha_cut(scored, 0.8, "and"), "nij")) == {("a", "b"), ("c", "e")}
    with pytest.raises(ValueError):
        B.alpha_cut(scored, 0.3, "xor")


def test_salience(g1):
    got = {k: v[0] for k, v in table(B.salience(g1), "score").items()}
    assert got == {("a", "b"): 0.75, ("a", "c"): 0.0, ("a", "d"): 0.75, ("b", "c"): 0.75,
                   ("c", "a"): 0.5, ("d", "a"): 0.25}
    both = {k: v[0] for k, v in table(B.salience(g1, undirected=True), "score").items()}
    assert both[("a", "d")] == 0.5 and both[("a", "c")] == 0.25


def test_salience_by_joins_is_the_same(spark):
    rng = np.random.default_rng(8)
    rows = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 30, 160), rng.integers(0, 30, 160), rng.integers(1, 5, 160))]
    edges = spark.createDataFrame(rows, "src int, trg int, nij double").groupBy("src", "trg").agg(F.max("nij").alias("nij"))
    own, joined = (table(B.salience(edges, links_at_once=n), "score") for n in (10_000, 0))
    assert own == joined and len({v for v in own.values()}) > 3


def test_naive_and_names_with_dashes(spark):
    edges = spark.createDataFrame([("a-b", "c", 1.0), ("a", "b-c", 2.0), ("c", "a-b", 5.0)],
                                  "src string, trg string, nij double")
    got = table(B.naive(edges, undirected=True), "nij", "score")
    assert got == {("a-b", "c"): (1.0, 3.0), ("a", "b-c"): (2.0, 1.0)}


def test_prepare(spark):
    raw = spark.createDataFrame([("a", "b", "2"), ("b", "a", "3"), ("a", "a", "1"), ("a", "c", "0")],
                                "src string, trg string, w string")
    assert table(B.prepare(raw, "w"), "nij") == {("a", "b"): (2.0,), ("b", "a"): (3.0,), ("a", "a"): (1.0,)}
    kept = B.prepare(raw, "w", drop_zeroes=False, self_loops=False, triangular=True)
    assert table(kept, "nij") == {("a", "b"): (2.0,), ("b", "a"): (3.0,), ("a", "c"): (0.0,), ("c", "a"): (0.0,)}
    assert tuple(G.size(kept, undirected=True).first()) == (3, 2.0)


@pytest.mark.parametrize("self_loops", [True, False])
def test_prepare_holds_an_edge_once(spark, self_loops):
    """Repeated rows, missing ends and weights; one pass over the edges, no sort of a whole task."""
    rows = [(1, 2, 5.0), (1, 2, 3.0), (2, 1, 4.0), (3, 1, 2.0), (3, 3, 7.0), (3, 3, 6.0), (None, 4, 1.0), (5, None, 2.0),
            (None, None, 9.0), (6, 7, None), (6, 7, 1.0), (7, 6, 2.0), (8, 9, None), (9, 9, 0.0)]
    edges = spark.createDataFrame(rows, "src bigint, trg int, nij double")
    got = B.prepare(edges, drop_zeroes=False, self_loops=self_loops, triangular=True)
    best = {}
    for src, trg, w in rows:
        if self_loops or (src is not None and trg is not None and src != trg):
            for given, key in ((0, (src, trg)), (1, (trg, src))):
                best.setdefault(key, []).append((given, w is not None, w or 0.0, w))
    assert sorted(got.collect(), key=str) == sorted([(*k, min(v)[3]) for k, v in best.items()], key=str)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "Union" not in plan


def test_density_sweep(g1):
    scored = B.naive(g1)
    rows = [tuple(r) for r in B.density_sweep(scored, 0.0, 4.0, 2.0).orderBy("threshold").collect()]
    assert [r[:2] + (r[3],) for r in rows] == [(0.0, 4, 6), (2.0, 3, 2), (4.0, 0, 0)]
    assert rows[1][5] == pytest.approx(4 / 3) and rows[2][5] is None
    with pytest.raises(ValueError):
        B.density_sweep(scored, 1.0, 0.0, 0.1)


def test_stability(spark, g1):
    other = g1.where("nij > 1").withColumn("nij", F.col("nij") * 2)
    assert B.stability_jaccard(g1, other).first()[0] == pytest.approx(4 / 7)
    assert B.stability_corr(g1, other).first()[0] == pytest.approx(1.0)
    assert B.stability_corr(g1, other, "pearson", log=True).first()[0] == pytest.approx(1.0)
    ties_a = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate([1, 1, 2, 3])],
                                   "src int, trg int, nij double")
    ties_b = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate([1, 2, 2, 1])],
                                   "src int, trg int, nij double")
    ra, rb = [1.5, 1.5, 3, 4], [1.5, 3.5, 3.5, 1.5]
    assert B.stability_corr(ties_a, ties_b).first()[0] == pytest.approx(np.corrcoef(ra, rb)[0, 1])


def random_edges(seed, n, m):
    rng = np.random.default_rng(seed)
    seen = {}
    while len(seen) < m:
        a, b = (int(x) for x in rng.integers(0, n, 2))
        if a != b and (b, a) not in seen:
            seen[(a, b)] = float(rng.integers(1, 6))
    return [(a, b, w) for (a, b), w in seen.items()]


def union_find(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    picked = []
    for a, b, w in edges:
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            picked.append((a, b, w))
    return {x: find(x) for x in parent}, picked


@pytest.mark.parametrize("seed,n,m", [(1, 40, 30), (2, 60, 90)])
def test_components_and_tree(spark, seed, n, m):
    rows = random_edges(seed, n, m)
    edges = spark.createDataFrame(rows + [(999, 999, 1.0)], "src int, trg int, nij double")
    labels, _ = union_find(rows)
    labels[999] = 999
    assert {r["node"]: r["component"] for r in G.components(edges).collect()} == labels
    tree = B.spanning_tree(edges).collect()
    _, best = union_find(sorted(rows, key=lambda e: -e[2]))
    assert len(tree) == len(labels) - len(set(labels.values()))
    assert sum(r["score"] for r in tree) == sum(e[2] for e in best)
    assert {(r["src"], r["trg"]) for r in tree} <= {(a, b) for a, b, _ in rows}


def plans_written(monkeypatch):
    """Plans of the tables that the graph operators write between steps."""
    plans, write = [], G.cut_lineage

    def noted(df, *options):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, *options)

    monkeypatch.setattr(G, "cut_lineage", noted)
    return plans


def test_spanning_forest_never_sorts_to_aggregate(spark, monkeypatch):
    rows = [(f"n{a}", f"n{b}", w) for a, b, w in random_edges(3, 30, 200)]
    plans = plans_written(monkeypatch)
    tree = B.spanning_tree(spark.createDataFrame(rows, "src string, trg string, nij double")).collect()
    assert plans and not any("SortAggregate" in p for p in plans)
    pairs = [(min(a, b), max(a, b), w) for a, b, w in rows]
    _, best = union_find(sorted(pairs, key=lambda e: (e[2], e[0], e[1]), reverse=True))
    assert {tuple(sorted((r["src"], r["trg"]))) for r in tree} == {(a, b) for a, b, _ in best}


@pytest.mark.parametrize("seed,n,m", [(4, 50, 600), (5, 80, 100), (6, 12, 60)])
def test_spanning_forest_from_the_heaviest_edges_down(spark, monkeypatch, seed, n, m):
    rows = [(min(a, b), max(a, b), w) for a, b, w in random_edges(seed, n, m)] + [(900, 901, 1.0), (900, 902, -1.0), (903, 904, None)]
    pairs = spark.createDataFrame(rows, "lo int, hi int, nij double")
    contracted, contract = [], G._contract
    monkeypatch.setattr(G, "_contract", lambda live: (contracted.append(live.count()), contract(live))[1])
    monkeypatch.setattr(F, "approx_count_distinct", lambda c: F.lit(1))     # small batches
    got = {(r["lo"], r["hi"], r["nij"]) for r in G.spanning_rows(pairs, 4).collect()}
    _, best = union_find(sorted(rows, key=lambda e: (e[2] is not None, e[2] or 0, e[0], e[1]), reverse=True))
    assert got == set(best)
    assert len(contracted) > 1 and (sum(contracted) < len(rows) or m < 2 * n)


def test_spanning_tree_keeps_the_row_of_the_smaller_source(spark):
    rows = [("a", "b", 1.0), ("b", "a", 3.0), ("c", "b", 2.0), ("a", "c", 1.0), ("c", "c", 9.0), (None, "a", 5.0), ("d", "a", 0.0)]
    tree = B.spanning_tree(spark.createDataFrame(rows, "src string, trg string, nij double"))
    assert tree.columns == ["src", "trg", "nij", "score"]
    assert {tuple(r) for r in tree.collect()} == {("a", "b", 1.0, 3.0), ("c", "b", 2.0, 2.0)}


@pytest.mark.parametrize("seed,n,m", [(7, 60, 40), (8, 90, 90), (9, 20, 60)])
def test_components_join_once_per_table(spark, monkeypatch, seed, n, m):
    """One join or one aggregate at a time, so that a task never holds the rows of several."""
    rows = [(f"n{a}", f"n{b}") for a, b, _ in random_edges(seed, n, m)]
    labels, _ = union_find([(a, b, 0.0) for a, b in rows])
    odd = [(b, a) for a, b in rows[:9]] + rows[:9] + [(rows[0][0], rows[0][0]), ("alone", "alone"), ("z", None), (None, None)]
    plans = plans_written(monkeypatch)
    found = G.components(spark.createDataFrame(rows + odd, "src string, trg string"))
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    got = [tuple(r) for r in found.select("node", "component").collect()]
    assert len(got) == len(labels) + 1 and dict(got) == labels | {"alone": "alone"}
    assert max(len(re.findall(r"(?:SortMerge|BroadcastHash|ShuffledHash)Join", p)) for p in plans) == 1


def test_components_of_families(spark, monkeypatch):
    """Stars settle in one round: tables of pairs, moved pairs, labels and the nodes they name."""
    rows = [(f"{o}{k}", f"{o}1") for o in range(30) for k in range(2, 7)]
    plans = plans_written(monkeypatch)
    found = G.components(spark.createDataFrame(rows, "src string, trg string"))
    assert {tuple(r) for r in found.collect()} == set(rows) | {(b, b) for _, b in rows}
    assert len(plans) == 4 and not any("Union" in p for p in plans)
    assert not re.search("Join", found._jdf.queryExecution().executedPlan().toString())


def test_components_of_nothing(spark):
    assert G.components(spark.createDataFrame([], "src string, trg string")).collect() == []


def test_components_of_a_long_path(spark):
    rows = [(i, i + 1, 1.0) for i in range(120)]
    edges = spark.createDataFrame(rows, "src int, trg int, nij double")
    assert {r["component"] for r in G.components(edges).collect()} == {0}
    assert G.is_connected(edges)


def test_doubly_stochastic(spark):
    rng = np.random.default_rng(5)
    n = 5
    # all cells but one: scaling settles in few rounds
    weights = {(i, j): float(rng.integers(3, 9)) for i in range(n) for j in range(n)
               if (i, j) != (0, 3)}
    dense = np.full((n, n), 0.001)
    for (i, j), w in weights.items():
        dense[i, j] += w
    for _ in range(2000):
        dense /= dense.sum(axis=1, keepdims=True)
        dense /= dense.sum(axis=0, keepdims=True)
        if dense.sum(axis=1).std() <= 1e-12:
            break
    cells = sorted(((dense[i, j], i, j) for i in range(n) for j in range(i + 1, n)), reverse=True)
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    expect = {}
    for v, i, j in cells:
        if (i, j) in weights:
            expect[(i, j)] = v
        parent[find(i)] = find(j)
        if len({find(x) for x in range(n)}) == 1:
            break
    edges = spark.createDataFrame([(i, j, w) for (i, j), w in weights.items()],
                                  "src int, trg int, nij double")
    got = {k: v[0] for k, v in table(B.doubly_stochastic(edges), "score").items()}
    assert got.keys() == expect.keys()
    for k in expect:
        assert got[k] == pytest.approx(expect[k], rel=1e-6)


def test_doubly_stochastic_needs_blank_cells(spark):
    # two groups without any edge between them
    rows = [(0, 1, 5.0), (1, 0, 5.0), (2, 3, 5.0), (3, 2, 5.0)]
    edges = spark.createDataFrame(rows, "src int, trg int, nij double")
    got = table(B.doubly_stochastic(edges), "nij")
    assert set(got) == {(0, 1), (2, 3)}


def test_spanning_cut_with_blank_cells(spark):
    """Any factors: the cut is the weakest edge of the tree over all cells above the diagonal."""
    rng = np.random.default_rng(2)
    for n, keep in ((9, 0.5), (14, 0.2)):
        r, c = rng.random(n) + 0.1, rng.random(n) + 0.1
        real = {(i, j): float(r[i] * c[j] * (rng.integers(1, 30) + B.SINKHORN_SHIFT))
                for i in range(n) for j in range(i + 1, n) if rng.random() < keep}
        cells = {(i, j): real.get((i, j), float(r[i] * B.SINKHORN_SHIFT * c[j])) for i in range(n) for j in range(i + 1, n)}
        label, weakest = list(range(n)), None
        for (i, j), v in sorted(cells.items(), key=lambda x: -x[1]):
            if label[i] != label[j]:
                a, b = label[i], label[j]
                label, weakest = [a if x == b else x for x in label], v
        frame = lambda rows, schema: spark.createDataFrame(rows, schema)
        got = B._spanning_cut(frame([(i, j, v) for (i, j), v in real.items()], "src int, trg int, value double"),
                              frame([(i, float(r[i])) for i in range(n)], "src int, r double"),
                              frame([(j, float(c[j])) for j in range(n)], "trg int, c double"),
                              frame([(i,) for i in range(n)], "node int"))
        assert got == pytest.approx(weakest)


def test_best_blanks_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    rows = [(i, int(rng.integers(0, 4)), float(rng.random()), float(rng.random())) for i in range(60)]
    rows += [(60, 9, None, 0.5), (61, 1, 0.5, None)]
    found = B._best_blanks(spark.createDataFrame(rows, "node int, label int, r double, c double")).collect()
    got = sorted((r["e"]["lo"], r["e"]["hi"], r["ca"], r["cb"], round(r["e"]["nij"], 12)) for r in found)
    want = []
    for i, a, r, c in rows:
        after = max(((x[3], x[0], x[1]) for x in rows if x[0] > i and x[1] != a and x[3] is not None), default=None)
        before = max(((x[2], x[0], x[1]) for x in rows if x[0] < i and x[1] != a and x[2] is not None), default=None)
        want += [(i, after[1], a, after[2], round(r * 0.001 * after[0], 12))] if after and r is not None else []
        want += [(before[1], i, a, before[2], round(c * 0.001 * before[0], 12))] if before and c is not None else []
    assert got == sorted(want)


def test_two_cliques_of_equal_factors_make_no_pairs(spark, monkeypatch):
    """40 nodes in two cliques, no edge between: no table beyond edges and nodes."""
    rows = [(a, b, 5.0) for half in (range(20), range(20, 40)) for a in half for b in half if a != b]
    edges = spark.createDataFrame(rows, "src int, trg int, nij double")
    sizes, real = [], B.cut_lineage

    def counted(df):
        out = real(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(B, "cut_lineage", counted)
    kept = B.doubly_stochastic(edges)
    assert kept.count() == 2 * 190 and max(sizes) <= len(rows) + 2 * 40


def test_label_propagation_ends_on_a_long_path(spark):
    edges = spark.range(5_000).select(F.col("id").alias("src"), (F.col("id") + 1).alias("trg"), F.lit(1.0).alias("nij"))
    labels = {r["node"]: r["label"] for r in G.propagate_labels(edges).collect()}
    assert len(labels) == 5_001
    for i in range(1, 5_000):       # nobody would gain by moving
        own = sum(labels[i] == labels[j] for j in (i - 1, i + 1))
        assert own >= max(sum(labels[k] == labels[j] for j in (i - 1, i + 1)) for k in (i - 1, i + 1))


def test_label_propagation_and_modularity(spark):
    clique = lambda ids: [(a, b, 5.0) for a in ids for b in ids if a < b]
    edges = spark.createDataFrame(clique(range(5)) + clique(range(5, 10)) + [(4, 5, 1.0)],
                                  "src int, trg int, nij double")
    labels = {r["node"]: r["label"] for r in G.propagate_labels(edges).collect()}
    assert len(set(labels[i] for i in range(5))) == 1
    assert len(set(labels[i] for i in range(5, 10))) == 1
    assert labels[0] != labels[9]
    part = spark.createDataFrame([(i, int(i > 4)) for i in range(10)], "node int, label int")
    m, inside, degree = 101.0, 50.0, 101.0
    expect = 2 * (inside / m - (degree / (2 * m)) ** 2)
    assert G.modularity(edges, part).first()[0] == pytest.approx(expect)


def test_subgraph_and_degree(spark, g1):
    degree = {r["node"]: r["weighted_degree"] for r in G.weighted_degree(g1).collect()}
    assert degree == {"a": 10.0, "b": 10.0, "c": 6.0, "d": 2.0}
    kept = G.subgraph(g1, G.top_nodes(g1, 2))
    assert set(table(kept, "nij")) == {("a", "b"), ("b", "b")}


def test_thresholds_shrink(g1):
    scored = B.noise_corrected(g1)
    sizes = [B.threshold(scored, t).count() for t in (0.0, 1.0, 2.0, 50.0)]
    assert sizes == sorted(sizes, reverse=True)
    assert B.threshold(scored, 1.0).columns == ["src", "trg", "nij", "score"]


def test_zero_weights_have_no_score(spark):
    edges = spark.createDataFrame([("a", "b", 0.0), ("b", "c", 2.0), ("c", "a", 1.0)], "src string, trg string, nij double")
    for scored in (B.noise_corrected(edges), B.disparity(edges)):
        rows = {(r["src"], r["trg"]): r["score"] for r in scored.collect()}
        assert len(rows) == 3 and rows["a", "b"] is None and rows["b", "c"] is not None
