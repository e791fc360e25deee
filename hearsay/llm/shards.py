"""Sharding by a hierarchical weighted hash tree.

A row descends region, rack and shard.  At every level each child draws
``-ln(u) / weight`` with ``u`` from a hash of the row's id and the child's name, and
the smallest draw wins, so a child gets rows in proportion to its weight and a draw
does not depend on the other children.  A changed weight therefore moves rows only
between the subtrees on its path and their siblings: a new region takes rows only
into itself, a new shard in an old rack moves rows only into the subtrees whose
weights grew.  The law is ``key``: id and tree decide, nothing else.

Defined cases: a null id hashes like an empty text; a null text has no bytes; rows
that share an id share the shard and are told apart by size and check sum in the
order of slots; an empty table gives an empty table.  Columns of the input that
carry one of the added names are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearsay.llm.words import bucket_digits, bucket_offsets, hash_order, same, uniform
from hearsay.session import cut_lineage

SHARDS_PER_RACK = 5
RACKS_PER_REGION = 4
ROW_BYTES = 16

#: region -> rack -> shard -> weight
Tree = dict[int, dict[int, dict[int, float]]]


def even_tree(shards: int) -> Tree:
    """Shards 0 .. n-1 of weight 1, five to a rack, four racks to a region."""
    tree: Tree = {}
    for shard in range(shards):
        rack = shard // SHARDS_PER_RACK
        tree.setdefault(rack // RACKS_PER_REGION, {}).setdefault(rack, {})[shard] = 1.0
    return tree


def in_new_region(tree: Tree, shard: int, weight: float = 1.0) -> Tree:
    """The tree with one more shard, alone in a rack of a region of its own."""
    region = max(tree, default=-1) + 1
    rack = max((r for racks in tree.values() for r in racks), default=-1) + 1
    return {**tree, region: {rack: {shard: weight}}}


def _children(weights: dict[int, float]) -> Column:
    return F.array(*[F.struct(F.lit(c).alias("child"), F.lit(float(w)).alias("weight"))
                     for c, w in sorted(weights.items())])


def _pick(id_col: Column, level: str, children: Column) -> Column:
    """The child with the smallest draw."""
    return F.array_min(F.transform(children, lambda c: F.struct(
        (-F.log(uniform(hash_order(id_col, F.lit(level), c["child"]))) / c["weight"]).alias("draw"),
        c["child"].alias("child"))))["child"]


def _below(parent: Column, branches: dict[int, dict[int, float]]) -> Column:
    """The children of a node, out of a constant map."""
    return F.element_at(F.create_map(*[x for name, weights in sorted(branches.items())
                                       for x in (F.lit(name), _children(weights))]), parent)


def descend(df: DataFrame, id_col: str, tree: Tree, out: str) -> DataFrame:
    """Adds the shard of every row; only the children on a row's path draw."""
    key = F.col(id_col)
    racks = {g: {r: sum(s.values()) for r, s in rs.items()} for g, rs in tree.items()}
    regions = {g: sum(rs.values()) for g, rs in racks.items()}
    shards = {r: s for rs in tree.values() for r, s in rs.items()}
    return (df.withColumn("_region", _pick(key, "region", _children(regions)))
            .withColumn("_rack", _pick(key, "rack", _below(F.col("_region"), racks)))
            .withColumn(out, _pick(key, "shard", _below(F.col("_rack"), shards)).cast("int"))
            .drop("_region", "_rack"))


def assign(docs: DataFrame, tree: Tree, grown: Tree | None = None, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """Adds ``size``, ``text_crc32``, ``law``, ``shard``, ``slot`` and, with ``grown``,
    ``grown_shard``.

    Slots are gapless per shard: buckets of the hash order are counted, the counts of
    earlier buckets are added to the place inside the bucket.
    """
    added = ["size", "text_crc32", "law", "shard", "slot"] + ["grown_shard"] * (grown is not None)
    digits = bucket_digits(docs.count())
    named = docs.drop(*[c for c in added if c in docs.columns])
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = (descend(named, id_col, tree, "shard")
             .withColumn("size", (F.octet_length(text) + ROW_BYTES).cast("long"))
             .withColumn("text_crc32", F.crc32(text))
             .withColumn("_key", hash_order(F.col(id_col)))
             .withColumn("_bucket", F.substring("_key", 1, digits)))
    # the check sum is part of the order but not of the counts, so this pass reads ids only
    totals = cut_lineage(keyed.groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("_rows")))
    offsets = bucket_offsets(totals, ["shard"], "_bucket", {"_before": "_rows"})
    inside = Window.partitionBy("shard", "_bucket").orderBy("_key", id_col, "size", "text_crc32")
    placed = same(keyed.withColumn("_place", F.row_number().over(inside)), offsets,
                  ["shard", "_bucket"])
    out = (placed.withColumn("slot", (F.col("_before") + F.col("_place") - 1).cast("long"))
           .withColumn("law", F.lit("key")))
    if grown is not None:
        out = descend(out, id_col, grown, "grown_shard")
    return out.select(*named.columns, *added)


def shards_of(tree: Tree) -> Sequence[int]:
    return sorted(s for racks in tree.values() for shards in racks.values() for s in shards)
