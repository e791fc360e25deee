"""Sampling, splits and labelled data sets, all by deterministic hash order."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearsay.functions import scalar as S
from hearsay.operators.ordered import hash_fraction, hash_key, hash_sample, split_by_hash

# Names of the annotation labels and their classes.
ANNOTATION_CLASSES = {"Anti-Vaccine": "0", "Neutral": "1", "Pro-Vaccine": "2", "Non-Covid": "3"}


def fixed_sample(df: DataFrame, n: int, id_cols: Sequence[str] = ("id",),
                 group_cols: Sequence[str] = (), seed: int = 42) -> DataFrame:
    """Exactly n rows (of every group)."""
    return hash_sample(df, n, id_cols, group_cols, seed)


def fraction_sample(df: DataFrame, fraction: float, id_cols: Sequence[str] = ("id",),
                    seed: int = 42) -> DataFrame:
    """About ``fraction`` of the rows of every community; no shuffle."""
    return df.where(hash_fraction(id_cols, seed) < fraction)


def stratified_sample(df: DataFrame, col: str, fractions: Mapping[int, float],
                      id_cols: Sequence[str] = ("id",), seed: int = 42) -> DataFrame:
    """A fraction per class; classes without a fraction are left out."""
    part = S.lookup(F.col(col), {k: float(v) for k, v in fractions.items()})
    return df.where(hash_fraction(id_cols, seed) < F.coalesce(part, F.lit(0.0)))


def shuffle(df: DataFrame, id_cols: Sequence[str] = ("id",), seed: int = 42) -> DataFrame:
    return df.orderBy(hash_key(id_cols, seed), *id_cols)


def complement(df: DataFrame, sample: DataFrame, id_cols: Sequence[str] = ("id",),
               mode: str = "anti") -> DataFrame:
    """Rows outside the sample.

    ``anti`` compares ids.  ``unique`` compares whole rows and also drops rows
    that occur more than once in ``df``.
    """
    if mode == "anti":
        return df.join(sample.select(*id_cols).distinct(), list(id_cols), "left_anti")
    if mode != "unique":
        raise ValueError(f"unknown mode {mode!r}")
    tagged = df.withColumn("_n", F.lit(1)).unionByName(
        sample.select(*df.columns).withColumn("_n", F.lit(2)))
    return (tagged.groupBy(*df.columns).agg(F.sum("_n").alias("_n"))
            .where("_n = 1").drop("_n"))


def split(df: DataFrame, test_fraction: float = 0.2, id_cols: Sequence[str] = ("id",),
          group_cols: Sequence[str] = (), seed: int = 42) -> DataFrame:
    """Random split; ``ceil(fraction * n)`` rows (per group) are the test part."""
    cut = F.array(F.ceil(F.col("n") * F.lit(test_fraction)))
    parts = split_by_hash(df, id_cols, cut, group_cols, seed, "_seg")
    return parts.withColumn("split", F.when(F.col("_seg") == 0, "test").otherwise("train")).drop("_seg")


def stratified_split(df: DataFrame, label: str, test_fraction: float = 0.2,
                     id_cols: Sequence[str] = ("id",), seed: int = 42) -> DataFrame:
    return split(df, test_fraction, id_cols, [label], seed)


def balanced_split(df: DataFrame, label: str, train: int, valid: Mapping[int, int],
                   test: Mapping[int, int | None] | None = None,
                   id_cols: Sequence[str] = ("id",), seed: int = 42) -> DataFrame:
    """Equal training size per class, validation from the rest, the remainder as test.

    ``test`` may cap the remainder of a class; rows beyond the cap belong to no part.
    """
    n_valid = S.lookup(F.col(label), {k: int(v) for k, v in valid.items()})
    first = F.lit(train).cast("long")
    second = first + F.coalesce(n_valid, F.lit(0))
    caps = {k: int(v) for k, v in (test or {}).items() if v is not None}
    third = second + (F.coalesce(S.lookup(F.col(label), caps), F.col("n")) if caps else F.col("n"))
    parts = split_by_hash(df.where(F.col(label).isNotNull()), id_cols,
                          F.array(first, second, third), [label], seed, "_seg")
    names = F.array(F.lit("train"), F.lit("valid"), F.lit("test"))
    return (parts.where("_seg < 3").withColumn("split", F.get(names, F.col("_seg").cast("int")))
            .drop("_seg"))


def map_labels(df: DataFrame, mapping: Mapping[str, int], key: str = "subreddit",
               out_col: str = "label") -> DataFrame:
    """Label by dictionary; unmatched keys become null."""
    return df.withColumn(out_col, S.lookup(F.col(key), mapping))


def map_labels_by_table(df: DataFrame, table: DataFrame, key: str = "subreddit") -> DataFrame:
    """Label by a table ``(key, label)`` of any size; Spark broadcasts it when small."""
    return df.join(table, key, "left")


def unified_text(posts: DataFrame, comments: DataFrame, post_text: str = "cleanText",
                 comment_text: str = "cleanBody", label: str = "label") -> DataFrame:
    """Posts and comments under one ``text`` column."""
    part = lambda df, c: df.select(F.col(c).alias("text"), label)
    return part(posts, post_text).unionByName(part(comments, comment_text))


def assemble(annotated: DataFrame, pool: DataFrame, off_topic_n: int, label: str = "label",
             off_topic_label: int = 0, test_fraction: float = 0.2,
             id_cols: Sequence[str] = ("id",), seed: int = 42) -> DataFrame:
    """Split annotated rows and add sampled off-topic rows to the training part.

    Pool rows that are annotated already are not drawn; rows without a label go.
    """
    base = split(annotated.where(F.col(label).isNotNull()), test_fraction, id_cols, seed=seed)
    extra = (fixed_sample(complement(pool, annotated, id_cols), off_topic_n, id_cols, seed=seed)
             .withColumn(label, F.lit(off_topic_label)).withColumn("split", F.lit("train")))
    return base.unionByName(extra.select(*base.columns))


def annotation_rows(df: DataFrame, text: Column) -> DataFrame:
    """Text with a default label, as the annotation tool reads it."""
    return df.select(text.alias("text")).withColumn("label", F.lit(0))
