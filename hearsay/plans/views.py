"""Canonical views: the driver tables seen as forum data.

Each view exists twice, as a DataFrame and as SQL text, with the same columns.
Everything is an expression over whole tables; nothing is sampled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearsay.functions.scalar import epoch_of
from hearsay.session import spread

# Landing grid of the coverage queries: 24 slices over the years of the tables.
LAND_START = 788_918_400     # 1995-01-01 UTC
LAND_END = 1_009_756_800     # 2001-12-31 UTC
LAND_SLICES = 24


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def posts(spark: SparkSession, d: str) -> DataFrame:
    """``events`` as scored posts."""
    k = F.get_json_object("props", "$.k").cast("int")
    a, b, c = (k * 7) % 10, (k * 3) % 10, (k + 5) % 10
    total = (a + b + c).cast("double")
    return table(spark, d, "events").select(
        F.col("event_id").alias("id"),
        F.when(F.col("user_id") % 50 == 0, F.lit("[deleted]"))
        .otherwise(F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("author"),
        F.col("event_type").alias("subreddit"),
        epoch_of(F.col("ts")).alias("created_utc"),
        F.col("value").alias("score"),
        (k % 7).alias("num_comments"),
        (k >= 20).cast("int").alias("class_I"),
        (k % 3).alias("class_II"),
        (a / total).alias("label_0"), (b / total).alias("label_1"), (c / total).alias("label_2"),
        k.alias("k"),
    )


def texts(spark: SparkSession, d: str) -> DataFrame:
    """``documents`` as posts with a title and a body, labelled where ``labels`` knows them."""
    return spread(table(spark, d, "documents").select("doc_id", "source", "text", "lang")).select(
        F.col("doc_id").alias("id"), F.col("source").alias("subreddit"),
        F.substring("text", 1, 80).alias("title"),
        F.when(F.col("doc_id") % 10 != 0, F.col("text")).alias("selftext"),
        "text", "lang")


def comments(spark: SparkSession, d: str) -> DataFrame:
    """``conversations`` as comments."""
    return table(spark, d, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        F.col("conv_id").alias("parent_id"),
        F.concat(F.lit("c"), (F.col("conv_id") % 20).cast("string")).alias("subreddit"),
        F.col("role").alias("author"), F.col("text").alias("body"),
        (F.lit(1_583_020_800) + F.col("conv_id") * 20_000 + F.col("turn") * 60)
        .cast("long").alias("created_utc"),
        F.length("text").cast("long").alias("score"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Shipments between nations as a weighted directed network."""
    line = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    order = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    cust = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("trg"))
    supp = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("src"))
    return (
        line.join(order, line.l_orderkey == order.o_orderkey)
        .join(cust, F.col("o_custkey") == cust.c_custkey)
        .join(supp, F.col("l_suppkey") == supp.s_suppkey)
        .groupBy("src", "trg").agg(F.count(F.lit(1)).cast("double").alias("nij"))
    )


def edges_wide(spark: SparkSession, d: str) -> DataFrame:
    """Shipments from suppliers to customers, whole: degrees vary, ids overlap, so there
    are self loops and edges of both directions."""
    line = table(spark, d, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("src"), "l_quantity")
    order = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("trg"))
    return (line.join(order, line.l_orderkey == order.o_orderkey)
            .groupBy("src", "trg").agg(F.sum("l_quantity").alias("nij")))


def edges_big(spark: SparkSession, d: str) -> DataFrame:
    """Supplier x part bipartite network: many nodes, few repeats."""
    return (table(spark, d, "lineitem")
            .groupBy((F.concat(F.lit("s"), F.col("l_suppkey"))).alias("src"),
                     (F.concat(F.lit("p"), F.col("l_partkey"))).alias("trg"))
            .agg(F.sum("l_quantity").alias("nij")))


def discovery(spark: SparkSession, d: str) -> DataFrame:
    """``lineitem`` as discovery posts with nested cross-post parents."""
    line, order, part, supp = (F.col(c) for c in
                               ("l_linenumber", "l_orderkey", "l_partkey", "l_suppkey"))
    text = lambda c: c.cast("string")
    parent = F.struct(
        F.when(part % 10 == 0, F.concat(F.lit("u_"), text(part)))
        .otherwise(F.concat(F.lit("n"), text(part % 40))).alias("subreddit"),
        part.alias("subreddit_subscribers"),
        (line % 4).cast("long").alias("num_crossposts"))
    return table(spark, d, "lineitem").select(
        text(order * 10 + line).alias("id"),
        F.concat(F.lit("http://x/"), text(part)).alias("url"),
        F.concat(F.lit("title "), text(part)).alias("title"),
        F.when(supp % 10 == 0, F.concat(F.lit("u_"), text(supp)))
        .otherwise(F.concat(F.lit("n"), text(supp % 25))).alias("subreddit"),
        F.lit("").alias("selftext"),
        (supp * 10 + line).alias("subreddit_subscribers"),
        F.when(line > 1, F.concat(F.lit("t3_"), text(order * 10 + 1))).alias("crosspost_parent"),
        F.when(line == 1, F.lit(None)).when(order % 10 == 1, F.array().cast(
            "array<struct<subreddit:string,subreddit_subscribers:bigint,num_crossposts:bigint>>"))
        .otherwise(F.array(parent)).alias("crosspost_parent_list"),
        (line % 3).cast("long").alias("num_crossposts"),
        epoch_of(F.col("l_shipdate")).alias("created_utc"),
        F.concat(F.lit("a"), text(part % 500)).alias("author"),
        F.lit(0).cast("long").alias("num_comments"),
        F.col("l_quantity").cast("long").alias("score"))


def landed_posts(spark: SparkSession, d: str) -> DataFrame:
    """``orders`` as landed posts; three communities hold a third of all rows."""
    key = F.col("o_custkey")
    return table(spark, d, "orders").select(
        F.concat(F.lit("c"), F.when(key % 3 == 0, key % 9).otherwise(key % 150)
                 .cast("string")).alias("subreddit"),
        epoch_of(F.col("o_orderdate")).alias("created_utc"))


def landed_comments(spark: SparkSession, d: str) -> DataFrame:
    """``lineitem`` as landed comments; three communities hold a third of all rows."""
    key = F.col("l_orderkey")
    return table(spark, d, "lineitem").select(
        F.concat(F.lit("c"), F.when(key % 3 == 0, key % 9).otherwise(key % 155)
                 .cast("string")).alias("subreddit"),
        epoch_of(F.col("l_shipdate")).alias("created_utc"))


def preds(spark: SparkSession, d: str) -> DataFrame:
    """``embeddings`` as three-class predictions: soft-max of the first components."""
    e = [F.exp(F.col("embedding")[i].cast("double") * 4) for i in range(3)]
    total = e[0] + e[1] + e[2]
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("id"), (F.col("label") % 3).alias("y"),
        *[F.round(e[i] / total, 6).alias(f"s_{i}") for i in range(3)])


def preds_binary(spark: SparkSession, d: str) -> DataFrame:
    """Document length as a score for the quality label."""
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    labels = table(spark, d, "labels").select("doc_id", F.col("quality").alias("y"))
    return docs.join(labels, "doc_id").select(
        F.col("doc_id").alias("id"), "y", F.col("n_chars").cast("double").alias("s"))


def daily(spark: SparkSession, d: str) -> DataFrame:
    """``orders`` as an external daily statistic."""
    return (table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("date"))
            .agg(F.count(F.lit(1)).alias("new_cases"),
                 F.round(F.sum("o_totalprice"), 2).alias("amount")))


def labelled_posts(spark: SparkSession, d: str) -> DataFrame:
    """``documents`` labelled by community, as weak supervision does it."""
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("id"), F.col("source").alias("subreddit"), "text")


SQL_NEEDS = {
}

SQL_VIEWS = {
    "posts": """
        SELECT event_id AS id,
               CASE WHEN user_id % 50 = 0 THEN '[deleted]' ELSE 'u' || user_id END AS author,
               event_type AS subreddit, epoch_us(ts) // 1000000 AS created_utc, value AS score,
               k % 7 AS num_comments, CAST(k >= 20 AS INTEGER) AS class_I, k % 3 AS class_II,
               ((k * 7) % 10) / CAST(t AS DOUBLE) AS label_0,
               ((k * 3) % 10) / CAST(t AS DOUBLE) AS label_1,
               ((k + 5) % 10) / CAST(t AS DOUBLE) AS label_2, k
        FROM (SELECT *, (k * 7) % 10 + (k * 3) % 10 + (k + 5) % 10 AS t
              FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k
                    FROM events))""",
    "texts": """
        SELECT doc_id AS id, source AS subreddit, substring(text, 1, 80) AS title,
               CASE WHEN doc_id % 10 <> 0 THEN text END AS selftext, text, lang
        FROM documents""",
    "comments": """
        SELECT conv_id * 1000 + turn AS id, conv_id AS parent_id,
               'c' || (conv_id % 20) AS subreddit, role AS author, text AS body,
               1583020800 + conv_id * 20000 + turn * 60 AS created_utc,
               CAST(length(text) AS BIGINT) AS score
        FROM conversations""",
    "edges": """
        SELECT s_nationkey AS src, c_nationkey AS trg, CAST(count(*) AS DOUBLE) AS nij
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
        GROUP BY 1, 2""",
    "edges_wide": """
        SELECT l_suppkey AS src, o_custkey AS trg, sum(l_quantity) AS nij
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2""",
    "edges_big": """
        SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS trg, sum(l_quantity) AS nij
        FROM lineitem GROUP BY 1, 2""",
    "discovery": """
        SELECT CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) AS id,
               'http://x/' || l_partkey AS url, 'title ' || l_partkey AS title,
               CASE WHEN l_suppkey % 10 = 0 THEN 'u_' || l_suppkey
                    ELSE 'n' || (l_suppkey % 25) END AS subreddit,
               '' AS selftext, l_suppkey * 10 + l_linenumber AS subreddit_subscribers,
               CASE WHEN l_linenumber > 1 THEN 't3_' || (l_orderkey * 10 + 1) END
                   AS crosspost_parent,
               CASE WHEN l_linenumber = 1 OR l_orderkey % 10 = 1 THEN NULL
                    WHEN l_partkey % 10 = 0 THEN 'u_' || l_partkey
                    ELSE 'n' || (l_partkey % 40) END AS parent_subreddit,
               l_partkey AS parent_subscribers, CAST(l_linenumber % 4 AS BIGINT) AS parent_num,
               CAST(l_linenumber % 3 AS BIGINT) AS num_crossposts,
               epoch_us(l_shipdate) // 1000000 AS created_utc,
               'a' || (l_partkey % 500) AS author, CAST(0 AS BIGINT) AS num_comments,
               CAST(l_quantity AS BIGINT) AS score
        FROM lineitem""",
    "landed_posts": """
        SELECT 'c' || (CASE WHEN o_custkey % 3 = 0 THEN o_custkey % 9 ELSE o_custkey % 150 END)
               AS subreddit,
               epoch_us(o_orderdate) // 1000000 AS created_utc FROM orders""",
    "landed_comments": """
        SELECT 'c' || (CASE WHEN l_orderkey % 3 = 0 THEN l_orderkey % 9 ELSE l_orderkey % 155 END)
               AS subreddit,
               epoch_us(l_shipdate) // 1000000 AS created_utc FROM lineitem""",
    "preds": """
        SELECT id, y, round(e0 / (e0 + e1 + e2), 6) AS s_0, round(e1 / (e0 + e1 + e2), 6) AS s_1,
               round(e2 / (e0 + e1 + e2), 6) AS s_2
        FROM (SELECT vec_id AS id, label % 3 AS y, exp(CAST(embedding[1] AS DOUBLE) * 4) AS e0,
                     exp(CAST(embedding[2] AS DOUBLE) * 4) AS e1,
                     exp(CAST(embedding[3] AS DOUBLE) * 4) AS e2 FROM embeddings)""",
    "preds_binary": """
        SELECT doc_id AS id, quality AS y, CAST(n_chars AS DOUBLE) AS s
        FROM documents JOIN labels USING (doc_id)""",
    "daily": """
        SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS new_cases,
               round(sum(o_totalprice), 2) AS amount FROM orders GROUP BY 1""",
    "labelled_posts": """
        SELECT doc_id AS id, source AS subreddit, text FROM documents""",
}
