"""Mixing sources to target weights.

Words of a document count as its size.  The sources, in order of their names by
code point and null last, weigh 5, 2, 1 and so on again.  Their targets share all
words of the input; a target stops at three times its source's size, and what is
left goes to the others by weight.  Inside a source the documents are in order of a
hash of their id; sums over earlier hash buckets plus sums inside the bucket give
every document its place in the running word count, and the source's budget is cut
exactly there: whole epochs repeat every document, the rest of the budget takes the
documents before the cut and the first words of the document that holds it.

Defined cases: a null text has size 0 and is taken 0 times; a null source is a
source of its own; rows that share an id are ordered by size and text; an empty
table gives an empty table.  Columns of the input stay unless they carry one of
the names that this operator adds, which it replaces.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearsay.llm.words import bucket_digits, bucket_offsets, hash_order, same, words
from hearsay.session import cut_lineage

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS,
            most: int = MOST_EPOCHS) -> DataFrame:
    """``(source, source_size)`` -> the same with ``weight`` and ``target``.

    Filling by weight up to a cap: in order of cap over weight, the sources before the
    first one that stays under its cap are full, and the rest share what is left.  The
    table has one row per source, so the windows over all of it are small.
    """
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.asc_nulls_last("source"))
    all_rows = Window.partitionBy(F.lit(0))
    listed = F.array(*[F.lit(int(w)) for w in weights])
    ranked = sizes.withColumn("weight", F.element_at(
        listed, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("long"))
    by_cap = all_rows.orderBy(
        F.col("source_size") * F.lit(float(most)) / F.col("weight"), F.asc_nulls_last("source"))
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    cap = F.col("source_size") * most
    level = ((F.sum("source_size").over(all_rows)
              - F.coalesce(F.sum(cap).over(before), F.lit(0))).cast("double")
             / F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing)))
    shared = ranked.withColumn("_level", level).withColumn(
        "_fits", F.col("_level") * F.col("weight") <= cap)
    water = F.min(F.when(F.col("_fits"), F.struct(
        (F.col("source_size") * F.lit(float(most)) / F.col("weight")).alias("at"),
        F.col("_level").alias("level")))).over(all_rows)["level"]
    return (shared.withColumn("_water", water)
            .withColumn("target", F.least(cap.cast("double"),
                                          F.coalesce(F.col("_water") * F.col("weight"),
                                                     cap.cast("double"))))
            .drop("_level", "_fits", "_water"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_EPOCHS,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Adds ``size``, ``source_size``, ``target``, ``epochs`` (whole ones) and ``taken`` (words)."""
    added = ("size", "source_size", "target", "epochs", "taken")
    digits = bucket_digits(docs.count())
    named = docs.drop(*[c for c in added if c in docs.columns])
    keyed = (named.withColumn("size", F.size(words(F.col(text_col))).cast("long"))
             .withColumn("_key", hash_order(F.col(id_col)))
             .withColumn("_bucket", F.substring("_key", 1, digits))
             .withColumn("_source", F.col(source_col)))
    totals = cut_lineage(keyed.groupBy("_source", "_bucket").agg(F.sum("size").alias("_words")))
    per_source = totals.groupBy(F.col("_source").alias("source")).agg(
        F.sum("_words").alias("source_size"))
    goals = (targets(per_source, weights, most)
             .select(F.col("source").alias("_source"), "source_size", "target"))
    plan = same(bucket_offsets(totals, ["_source"], "_bucket", {"_before": "_words"}),
                goals, ["_source"])
    inside = (Window.partitionBy("_source", "_bucket")
              .orderBy("_key", id_col, "size", F.crc32(F.coalesce(F.col(text_col), F.lit(""))))
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = same(keyed.withColumn("_upto", F.sum("size").over(inside)), plan,
                  ["_source", "_bucket"])
    budget = F.round("target").cast("long")
    start = F.col("_before") + F.col("_upto") - F.col("size")
    rest = F.when(F.col("source_size") > 0, budget % F.nullif(F.col("source_size"), F.lit(0)))
    return (placed
            .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(
                budget / F.nullif(F.col("source_size"), F.lit(0)))).otherwise(0).cast("long"))
            .withColumn("_part", F.greatest(F.lit(0), F.least(
                F.col("size"), F.coalesce(rest, F.lit(0)) - start)))
            .withColumn("taken", F.col("size") * F.col("epochs") + F.col("_part"))
            .select(*named.columns, *added))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of the mix: a document comes once per whole epoch, and the one at the cut
    once more with its first words.  ``n_chars``, where there is one, follows the text."""
    text = options.get("text_col", "text")
    mixed = mix(docs, **options).withColumn("_part", F.col("taken") - F.col("size") * F.col("epochs"))
    cut = (F.col("_part") > 0) & (F.col("_part") < F.col("size"))
    times = F.col("epochs") + (F.col("_part") >= F.greatest("size", F.lit(1))).cast("long") + cut.cast("long")
    copies = mixed.where(times > 0).withColumn(
        "_copy", F.explode(F.sequence(F.lit(1).cast("long"), times)))
    last = cut & (F.col("_copy") > F.col("epochs"))
    head = F.array_join(F.slice(words(F.col(text)), F.lit(1), F.greatest(
        F.col("_part"), F.lit(1)).cast("int")), " ")
    out = copies.withColumn("_cut", last).withColumn(text, F.when(F.col("_cut"), head).otherwise(F.col(text)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_cut"), F.length(text)).otherwise(
            F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
