"""Network operators over edge tables ``(src, trg, nij)``.

Loops keep only tables between rounds and materialise them reliably.  A hub node
is combined on the map side in every ``groupBy``; joins on node ids rely on
adaptive skew splitting, so no window ever holds the edges of one node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearsay.session import cut_lineage

SPLIT_BYTES = 16 << 20      # of a file, for a task that sorts or hashes whole edges
BATCH_ROWS = 1_000_000      # heaviest edges that a spanning forest begins with, at least


def as_undirected(edges: DataFrame, how: str = "max") -> DataFrame:
    """One row per unordered pair ``(lo, hi, nij)``; ``how`` combines both directions."""
    combine = {"max": F.max, "sum": F.sum, "min": F.min}[how]
    return (edges.where(F.col("src").isNotNull() & F.col("trg").isNotNull())
            .groupBy(F.least("src", "trg").alias("lo"), F.greatest("src", "trg").alias("hi"))
            .agg(combine("nij").alias("nij")))


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(
        edges.select(F.col("trg").alias("node"))).where("node IS NOT NULL").distinct()


def size(edges: DataFrame, undirected: bool = False) -> DataFrame:
    """Node and edge count; edges are halved for a mirrored undirected table."""
    ends = edges.select(F.explode(F.array("src", "trg")).alias("node"))
    n_edges = edges.agg(F.count(F.lit(1)).alias("n")).scalar()
    return ends.agg(F.count_distinct("node").alias("n_nodes")).withColumn(
        "n_edges", n_edges / F.lit(2.0) if undirected else n_edges.cast("double"))


def weighted_degree(edges: DataFrame) -> DataFrame:
    """Sum of the weights of all edges at a node; a self loop counts at both ends."""
    ends = edges.select(F.explode(F.array("src", "trg")).alias("node"), "nij")
    return ends.groupBy("node").agg(F.sum("nij").alias("weighted_degree"),
                                    F.count(F.lit(1)).alias("degree"))


def subgraph(edges: DataFrame, keep: DataFrame) -> DataFrame:
    """Edges with both ends among the kept nodes."""
    kept = keep.select("node").distinct()
    return (edges.join(kept.withColumnRenamed("node", "src"), "src", "left_semi")
            .join(kept.withColumnRenamed("node", "trg"), "trg", "left_semi")
            .select(*edges.columns))


def top_nodes(edges: DataFrame, k: int) -> DataFrame:
    return (weighted_degree(edges).orderBy(F.desc("weighted_degree"), "node")
            .limit(k).select("node"))


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Connected components ``(node, component)``; the label is the smallest node.

    Alternates the large-star and small-star steps of Kiveris et al. (2014), which
    need about log(n) rounds instead of one per hop of the diameter.  A pair points
    from its greater node to its smaller one, so the least neighbour of a node is the
    least of the nodes it points at, and pairs are never mirrored.  Each step is a table
    of its own that reads small splits, so a task holds few rows of one join or one aggregate.
    """
    # one pass over the input; self loops stay in, so that lonely nodes are known
    base = cut_lineage(
        edges.where("src IS NOT NULL AND trg IS NOT NULL")
        .select(F.greatest("src", "trg").alias("hi"), F.least("src", "trg").alias("lo")).distinct(), SPLIT_BYTES)
    pairs = base.where("hi <> lo")
    for _ in range(max_rounds):
        ahead = pairs.groupBy(F.col("hi").alias("lo")).agg(F.min("lo").alias("m"))
        large = cut_lineage(pairs.join(ahead, "lo", "left").select(
            "hi", F.coalesce("m", "lo").alias("lo"), F.col("m").isNotNull().alias("moved")), SPLIT_BYTES)
        least = cut_lineage(large.groupBy("hi").agg(
            F.min("lo").alias("m"), (F.min("lo") < F.max("lo")).alias("many")), SPLIT_BYTES)
        pairs = least.select("hi", F.col("m").alias("lo"))
        if not least.where("many").isEmpty():
            # the other nodes it points at point at the least one too
            pairs = pairs.union(cut_lineage(
                large.join(least.where("many"), "hi").where("lo <> m")
                .select(F.col("lo").alias("hi"), F.col("m").alias("lo")).distinct(), SPLIT_BYTES))
        elif large.where("moved").isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    # stars: every node that points has its label, and the nodes pointed at are the labels
    labels = pairs.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(
        cut_lineage(pairs.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct(), SPLIT_BYTES))
    lonely = base.where("hi = lo").select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    if lonely.isEmpty():
        return labels
    return labels.union(lonely.join(labels.select("node"), "node", "left_anti"))


def is_connected(edges: DataFrame) -> bool:
    """Whether all nodes form one weakly connected component."""
    return components(edges).agg(F.count_distinct("component")).first()[0] == 1


def _jump(pointers: DataFrame) -> DataFrame:
    ahead = pointers.select(F.col("c").alias("p"), F.col("p").alias("q"))
    return pointers.join(ahead, "p").select("c", F.col("q").alias("p"))


def roots(pointers: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Root of every node of a pointer forest whose roots point at each other.

    Of a mutual pair the smaller one is the root and points at itself; pointers then
    multiply their reach with every materialisation, whose last step also tells whether
    all of them have arrived.
    """
    back = pointers.select(F.col("c").alias("p"), F.col("p").alias("q"))
    tree = pointers.join(back, "p").select("c", F.when(
        (F.col("q") == F.col("c")) & (F.col("c") < F.col("p")), F.col("c")).otherwise(F.col("p"))
        .alias("p"))
    for _ in range(max_rounds):
        ahead = tree.select(F.col("c").alias("p"), F.col("p").alias("q"))
        far = cut_lineage(_jump(_jump(tree)).join(ahead, "p").select(
            "c", F.col("q").alias("p"), (F.col("q") == F.col("p")).alias("arrived")))
        tree = far.select("c", "p")
        if far.where("NOT arrived").isEmpty():
            return tree
    raise RuntimeError(f"pointers did not settle in {max_rounds} rounds")


def _contract(live: DataFrame) -> tuple[DataFrame | None, list[DataFrame]]:
    """Boruvka rounds over ``(w, ca, cb)``: the ``w`` of the forest and the labels of each round.

    ``w`` orders the edges without ties; it and the component ids are numbers, so the
    aggregates of a round hash and never sort.
    """
    chosen, labels = None, []
    while not live.isEmpty():  # every round at least halves the components that still grow
        ends = live.select(F.explode(F.array(F.struct(F.col("ca").alias("c"), F.col("cb").alias("p")),
                                             F.struct(F.col("cb").alias("c"), F.col("ca").alias("p")))).alias("x"), "w")
        best = cut_lineage(ends.groupBy("x.c").agg(F.max_by("x.p", "w").alias("p"), F.max("w").alias("w")))
        chosen = best.select("w") if chosen is None else chosen.unionByName(best.select("w"))
        label = roots(best.select("c", "p"))
        labels.append(label)
        # the heaviest edge between two contracted components is all that can matter
        a, b = F.least("na", "nb"), F.greatest("na", "nb")
        live = cut_lineage(
            live.join(label.select(F.col("c").alias("ca"), F.col("p").alias("na")), "ca")
            .join(label.select(F.col("c").alias("cb"), F.col("p").alias("nb")), "cb")
            .where("na <> nb").groupBy(a.alias("ca"), b.alias("cb")).agg(F.max("w").alias("w")))
    return chosen, labels


def _heaviest(rows: DataFrame, least_rows: int) -> tuple[float | None, int]:
    """A weight that about ``least_rows`` rows, or four per node if that is more, reach;
    ``None`` if cutting does not pay.  The second value is the number of rows aimed at."""
    steps = 256
    seen = rows.agg(F.count(F.lit(1)).alias("n"), (F.approx_count_distinct("a") + F.approx_count_distinct("b")).alias("nodes"),
                    F.percentile_approx("nij", F.array(*[F.lit(k / steps) for k in range(steps)]), 10_000).alias("cuts")).first()
    aim = max(least_rows, 4 * seen["nodes"])
    if seen["n"] <= 4 * aim or not seen["cuts"]:
        return None, aim
    return seen["cuts"][int(steps * (1 - aim / seen["n"]))], aim


def spanning_rows(pairs: DataFrame, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """The rows of ``pairs`` that form its maximum spanning forest, with all their columns.

    ``pairs`` has one row per unordered pair ``(lo, hi)`` of different nodes and its weight
    ``nij``.  Rows are totally ordered by (nij, lo, hi), so the forest is unique.  It grows
    from the heaviest rows down: their forest is part of the whole one, and of the lighter
    rows only those between its components go on, which in a dense network are few.
    Batches at least double, so there are few of them whatever the weights are.
    """
    rest = cut_lineage(pairs.select(F.col("lo").alias("a"), F.col("hi").alias("b"), *pairs.columns), SPLIT_BYTES)
    found = None
    while True:
        cut, batch_rows = _heaviest(rest, batch_rows)
        heavy = F.lit(True) if cut is None else F.coalesce(F.col("nij") >= cut, F.lit(False))
        batch = cut_lineage(rest.where(heavy).orderBy("nij", "lo", "hi").withColumn("w", F.monotonically_increasing_id()))
        ids = cut_lineage(batch.select(F.explode(F.array("a", "b")).alias("node")).distinct()
                          .withColumn("id", F.monotonically_increasing_id()))
        chosen, labels = _contract(cut_lineage(
            batch.join(ids.select(F.col("node").alias("a"), F.col("id").alias("ca")), "a")
            .join(ids.select(F.col("node").alias("b"), F.col("id").alias("cb")), "b").select("w", "ca", "cb")))
        if chosen is not None:
            part = batch.join(chosen, "w", "left_semi").select(*pairs.columns)
            found = part if found is None else found.unionByName(part)
        if cut is None:
            return pairs.limit(0) if found is None else found
        where = ids.withColumn("c", F.col("id"))
        for label in labels:
            where = where.join(label, "c", "left").select("node", "id", F.coalesce("p", "c").alias("c"))
        # a component goes on under the name of one of its nodes
        where = cut_lineage(where.join(ids.select(F.col("id").alias("c"), F.col("node").alias("to")), "c").select("node", "to"))
        light = rest.where(~heavy)
        for end in ("a", "b"):
            light = light.join(where.select(F.col("node").alias(end), F.col("to").alias(f"to_{end}")), end, "left")
        rest = cut_lineage(light.select(F.coalesce("to_a", "a").alias("a"), F.coalesce("to_b", "b").alias("b"), *pairs.columns)
                           .where("a <> b"), SPLIT_BYTES)
        batch_rows *= 2


def max_spanning_forest(edges: DataFrame) -> DataFrame:
    """Maximum spanning forest ``(lo, hi, nij)``; see ``spanning_rows``."""
    return spanning_rows(as_undirected(edges.where("src <> trg")))


def propagate_labels(edges: DataFrame) -> DataFrame:
    """Communities by weighted label propagation ``(node, label)``.

    A node wants the label with the greatest weight among its neighbours, the smallest one
    on a tie, if that weight is greater than the weight of its own label.  Of the nodes that
    want to move, an independent set does (those that come before all their neighbours that
    want to, by md5 of the node), so every move raises the total weight inside labels and
    the loop ends by itself, without a bound.  Weights are compared to nine digits.
    """
    pair = as_undirected(edges, "sum").where("lo <> hi")
    both = cut_lineage(
        pair.select(F.col("lo").alias("node"), F.col("hi").alias("other"), "nij").union(
            pair.select(F.col("hi").alias("node"), F.col("lo").alias("other"), "nij")))
    labels = cut_lineage(nodes(edges).withColumn("label", F.col("node")))
    while True:
        votes = (both.join(labels.select(F.col("node").alias("other"), "label"), "other")
                 .groupBy("node", "label").agg(F.round(F.sum("nij"), 9).alias("w"))
                 .join(labels.select("node", F.col("label").alias("own")), "node"))
        best = votes.groupBy("node").agg(
            F.max("w").alias("w"), F.min_by("label", F.struct((-F.col("w")).alias("w"), "label")).alias("new"),
            F.coalesce(F.max(F.when(F.col("label") == F.col("own"), F.col("w"))), F.lit(0.0)).alias("held"))
        wanting = cut_lineage(best.where("w > held").select(
            "node", "new", F.struct(F.md5(F.col("node").cast("string")).alias("h"), "node").alias("turn")))
        if wanting.isEmpty():
            return labels
        ahead = (both.select("node", "other")
                 .join(wanting.select(F.col("node").alias("other"), F.col("turn").alias("t")), "other")
                 .groupBy("node").agg(F.min("t").alias("t")))
        movers = (wanting.join(ahead, "node", "left").where("t IS NULL OR turn < t").select("node", "new"))
        labels = cut_lineage(labels.join(movers, "node", "left").select(
            "node", F.coalesce("new", "label").alias("label")))


def modularity(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """Modularity of a partition ``(node, label)`` on the undirected sum network."""
    pair = as_undirected(edges, "sum")
    lab = lambda end: partition.select(F.col("node").alias(end), F.col("label").alias(f"l_{end}"))
    labelled = pair.join(lab("lo"), "lo").join(lab("hi"), "hi")
    inside = labelled.where("l_lo = l_hi").groupBy(F.col("l_lo").alias("label")).agg(
        F.sum("nij").alias("w_in"))
    degree = (labelled.select(F.explode(F.array("l_lo", "l_hi")).alias("label"), "nij")
              .groupBy("label").agg(F.sum("nij").alias("deg")))
    m = pair.agg(F.sum("nij")).scalar()
    return (degree.join(inside, "label", "left")
            .agg(F.sum(F.coalesce("w_in", F.lit(0.0)) / m
                       - F.pow(F.col("deg") / (m * 2), F.lit(2))).alias("modularity")))
