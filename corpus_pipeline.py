"""The corpus pipeline: five stages over ``documents``, each one operator of hearsay.llm.

Every stage takes ``(spark, docs, sf_dir)``, works on all rows its predecessor kept and
returns a DataFrame; the driver of the pipeline writes it as Parquet and reads it again
for the next stage.  All stages but the last return the columns of ``documents``.

Defined cases: an empty ``docs`` passes through every stage; columns beyond those of
``documents`` are kept by the filtering stages; null texts pass toxicity (score 0), are
near-duplicates of each other (fingerprint zero), leak nothing and have size 0, so the
mix takes none of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hearsay.llm import leaks, mixing, shards, simhash, toxicity
from hearsay.session import cut_lineage

SHARDS = 40


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows below the toxicity threshold; the model learns from the labels of the table."""
    net = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.with_scores(docs, net).where("predicted = 0").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints, the one with the smallest id."""
    return simhash.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows into which no benchmark item leaks."""
    return leaks.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources; documents of further epochs are further rows."""
    return mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and its slot there."""
    return shards.assign(docs, shards.even_tree(SHARDS))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_leaks),
    ("source_mixing", mix_sources),
    ("sharding", shard),
]

#: the network of the first stage cannot be said in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
