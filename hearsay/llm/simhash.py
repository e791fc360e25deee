"""SimHash near-duplicates through BK-trees.

A fingerprint bit is the majority of that bit over the hashes of a text's word
shingles.  Equal fingerprints are one node; nodes that differ in at most ``radius``
bits are linked, and a component is what links reach.

Two fingerprints within the radius agree in at least one of ``radius + 1`` blocks of
bits, so the fingerprints with one block value form a shard and only they are
searched against each other.  A shard is a BK-tree: a child hangs on its parent by
their Hamming distance, and a search follows only the edges whose distance is within
the radius of the query's.  A shard above the size of a tree is cut into several
trees, and its fingerprints search every one of them.  Fingerprints are sent to the
trees that can hold a partner; broadcasting all trees would grow with the corpus.  A
tree keeps the groups that it has joined, so it emits a spanning forest, never all
pairs of a group.

Defined cases: a null or wordless text has fingerprint zero, linked like any other;
fewer words than a shingle make one shingle; rows with equal ids are documents of
their own; a null id never names a component unless nothing else does; an empty
table gives an empty table; columns named like the added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from hearsay.llm.words import words
from hearsay.operators.graph import components
from hearsay.session import cut_lineage

BITS = 64
SHINGLE = 3
RADIUS = 2
HOT_GROUPS = 200      # more rows than this part of all make a fingerprint hot
TREE_SIZE = 4096
HASHES_AT_ONCE = 1 << 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@F.pandas_udf(LongType())
def majority_bits(hashes: pd.Series) -> pd.Series:
    """Bits that are set in over half of the hashes of each row."""
    out = np.zeros(len(hashes), dtype=np.uint64)
    for row, values in enumerate(hashes):
        counts = np.zeros(BITS, dtype=np.int64)
        for at in range(0, len(values), HASHES_AT_ONCE):
            part = np.asarray(values[at:at + HASHES_AT_ONCE], dtype=np.int64)
            counts += np.unpackbits(part.astype(">i8").view(np.uint8).reshape(-1, 8), axis=1).sum(
                axis=0, dtype=np.int64)
        out[row] = np.packbits(2 * counts > len(values)).view(">u8")[0]
    return pd.Series(out.astype(np.int64))


def shingle_hashes(docs: DataFrame, text_col: str, shingle: int, out: str) -> DataFrame:
    """Adds the XXH64 hashes (seed 42, the seed of Spark's function) of all word shingles."""
    low = F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER)
    cut = docs.withColumn("_words", words(low))
    n = F.size("_words")
    several = F.transform(
        F.sequence(F.lit(0), F.greatest(n - shingle, F.lit(0))),
        lambda i: F.xxhash64(F.concat_ws(" ", *[F.get("_words", i + j) for j in range(shingle)])))
    one = F.array(F.xxhash64(F.array_join("_words", " ")))
    none = F.expr("cast(array() as array<bigint>)")
    return cut.withColumn(out, F.when(n == 0, none).when(n < shingle, one).otherwise(several)).drop("_words")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``(id, fp)`` with the fingerprint as a signed 64-bit number."""
    hashed = shingle_hashes(docs.select(id_col, text_col), text_col, shingle, "_hashes")
    return hashed.select(id_col, majority_bits("_hashes").alias("fp"))


class BKTree:
    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        node = len(self.values)
        if node:
            at = 0
            while True:
                distance = (value ^ self.values[at]).bit_count()
                below = self.children[at].get(distance)
                if below is None:
                    self.children[at][distance] = node
                    break
                at = below
        self.values.append(value)
        self.children.append({})

    def near(self, value: int, radius: int) -> list[int]:
        """Numbers of the nodes within the radius."""
        found, stack = [], [0] if self.values else []
        while stack:
            at = stack.pop()
            distance = (value ^ self.values[at]).bit_count()
            if distance <= radius:
                found.append(at)
            edges = self.children[at]
            for edge in range(distance - radius, distance + radius + 1):
                if edge in edges:
                    stack.append(edges[edge])
        return found


def _search(radius: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, tree, parent = None, BKTree(), []

        def root(node: int) -> int:
            while parent[node] != node:
                parent[node] = parent[parent[node]]
                node = parent[node]
            return node

        for batch in batches:
            src, trg = [], []
            rows = zip(batch["block"], batch["value"], batch["tree"], batch["query"], batch["fp"])
            for block, value, number, query, fp in rows:
                if (block, value, number) != shard:
                    shard, tree, parent = (block, value, number), BKTree(), []
                bits = fp & (2 ** BITS - 1)
                roots = {root(n) for n in tree.near(bits, radius)}
                for r in roots:
                    src.append(fp)
                    trg.append(tree.values[r] - (tree.values[r] >> 63 << BITS))
                if not query:
                    node = len(parent)
                    tree.add(bits)
                    parent.append(node)
                    for r in roots:
                        parent[r] = node
            yield pd.DataFrame({"src": np.array(src, dtype=np.int64), "trg": np.array(trg, dtype=np.int64)})

    return run


def near_links(nodes: DataFrame, radius: int = RADIUS, tree_size: int = TREE_SIZE) -> DataFrame:
    """Links ``(src, trg)`` that join the distinct fingerprints ``fp`` within the radius."""
    width = -(-BITS // (radius + 1))
    blocks = F.array(*[
        F.struct(F.lit(b).alias("block"), F.shiftrightunsigned("fp", b * width).bitwiseAND(
            F.lit((1 << min(width, BITS - b * width)) - 1)).alias("value")) for b in range(radius + 1)])
    placed = nodes.select("fp", F.inline(blocks))
    shards = (placed.groupBy("block", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
              .select("block", "value", F.ceil(F.col("n") / tree_size).alias("trees")))
    own = F.pmod(F.xxhash64("fp"), F.col("trees"))
    sent = (placed.join(shards, ["block", "value"]).withColumn("own", own)
            .withColumn("tree", F.explode(F.sequence(F.col("own"), F.col("trees") - 1)))
            .select("block", "value", "tree", (F.col("tree") != F.col("own")).alias("query"), "fp"))
    return (sent.repartition("block", "value", "tree")
            .sortWithinPartitions("block", "value", "tree", "query", "fp")
            .mapInPandas(_search(radius), "src bigint, trg bigint"))


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS,
                    id_col: str = "doc_id", text_col: str = "text",
                    tree_size: int = TREE_SIZE) -> DataFrame:
    """``(id, fingerprint, component_id)`` for every row; the component is its smallest id."""
    marked = cut_lineage(fingerprints(docs, shingle, id_col, text_col))
    nodes = cut_lineage(marked.groupBy("fp").agg(F.min(id_col).alias("_least"), F.count(F.lit(1)).alias("_rows")))
    linked = components(near_links(nodes.select("fp"), radius, tree_size))
    grouped = linked.select(F.col("node").alias("fp"), F.col("component").alias("_group"))
    smallest = (grouped.join(nodes, "fp").groupBy("_group").agg(F.min("_least").alias("_smallest")))
    named = cut_lineage(nodes.join(grouped.join(smallest, "_group"), "fp", "left")
                        .select("fp", F.coalesce("_smallest", "_least").alias("component_id"), "_rows"))
    # fewer than HOT_GROUPS fingerprints can have more than this share of the rows: they travel
    # with the tasks, so no task reads the rows of a hot one
    share = (named.agg(F.sum("_rows")).first()[0] or 0) // HOT_GROUPS
    hot = named.where(F.col("_rows") > share).select("fp", F.col("component_id").alias("_hot"), F.lit(True).alias("_is_hot"))
    told = marked.join(F.broadcast(hot), "fp", "left")
    rest = (told.where("_is_hot IS NULL").drop("_hot", "_is_hot")
            .join(named.where(F.col("_rows") <= share).select("fp", "component_id"), "fp"))
    every = told.where("_is_hot").select(id_col, "fp", F.col("_hot").alias("component_id")).unionByName(
        rest.select(id_col, "fp", "component_id"))
    return every.select(id_col, hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS,
             id_col: str = "doc_id", text_col: str = "text",
             tree_size: int = TREE_SIZE) -> DataFrame:
    """The rows of ``docs`` that name their component: one document of each group.

    Where several rows share the id that stays, one of them does.
    """
    rows = docs.withColumn("_row", F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))))
    found = near_duplicates(rows.select(id_col, text_col), shingle, radius, id_col, text_col, tree_size)
    ids = found.groupBy("component_id").agg(F.count(F.lit(1)).alias("_n"))
    same_id = rows.groupBy(id_col).agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_times"))
    kept = same_id.join(ids.select(F.col("component_id").alias("_id")),
                        same_id[id_col].eqNullSafe(F.col("_id")), "left_semi")
    stay = rows.join(kept.withColumnRenamed(id_col, "_id"),
                     (rows[id_col].eqNullSafe(F.col("_id"))) & (F.col("_row") == F.col("_first")))
    once = stay.where("_times = 1").select(*docs.columns)
    often = stay.where("_times > 1").select(*docs.columns).dropDuplicates([id_col])
    return once.unionByName(often)
