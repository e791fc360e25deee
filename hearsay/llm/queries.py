"""Registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearsay.llm import (
    chat, dialogues, fim, html, langid, leaks, mixing, quality, repeats, shards, simhash, toxicity, urls)

SHARDS = 40


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(_table(spark, folder, "documents")).select(
        "doc_id", *quality.COUNTS, "base_failed", "kept")


def op2_chat_windows(spark: SparkSession, folder: str) -> DataFrame:
    turns = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.windows(turns.union(chat.control_conversation(spark))))


def op3_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, folder, "documents"))


def op4_hash_tree_shards(spark: SparkSession, folder: str) -> DataFrame:
    tree = shards.even_tree(SHARDS)
    placed = shards.assign(_table(spark, folder, "documents").select("doc_id", "text"), tree,
                           shards.in_new_region(tree, SHARDS))
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op5_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = repeats.without_repeats(_table(spark, folder, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    net = toxicity.train(docs, _table(spark, folder, "labels"))
    scored = toxicity.with_scores(docs, net).withColumn("held_out", toxicity.is_held_out("doc_id"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op7_benchmark_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaked_items(_table(spark, folder, "documents").select("doc_id", "text"),
                              _table(spark, folder, "benchmark"))


def op8_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(_table(spark, folder, "pages").select("page_id", "url")).select(
        "page_id", "host", "path", "rule", "verdict")


def op9_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op10_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return html.extract(_table(spark, folder, "pages")).select("page_id", "url", "text", "n_chars")


def op11_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text", "lang")
    found = langid.identify(docs.select("doc_id", "text"), langid.learn(docs))
    return found.withColumn("held_out", langid.is_held_out("doc_id")).select(
        "doc_id", "held_out", "lang_pred", "score", "accepted")


def op12_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    made = fim.digests(fim.transform(_table(spark, folder, "documents").select("doc_id", "text")))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    turns = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return dialogues.report(turns, dialogues.damaged(turns))


QUERIES = {f.__name__: f for f in (
    op1_quality_rules, op2_chat_windows, op3_simhash_near_dedup, op4_hash_tree_shards,
    op5_substring_dedup, op6_toxicity, op7_benchmark_leaks, op8_url_filters, op9_source_mix, op10_html_extraction,
    op11_language_id, op12_fill_in_middle, op13_conversation_repair)}


def queries():
    return dict(QUERIES)


def oracles():
    from hearsay.llm.twins import TWINS

    return dict(TWINS)
