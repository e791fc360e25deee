"""Queries that write a table through a sink into the shared folder and scan it back."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from hearsay.functions import text as X
from hearsay.operators import datasets as D
from hearsay.operators import features as FE
from hearsay.operators import topics as TP
from hearsay.plans import model_queries as MQ
from hearsay.plans import text_queries as TQ
from hearsay.plans import views as V
from hearsay.plans.registry import query
from hearsay.session import cut_lineage, shared_folder
from hearsay.sources import posts as P
from hearsay.sources import tabular as TB

WINDOW = (1_704_500_000, 1_705_500_000)
FIELDS = ("id", "author", "subreddit", "created_utc", "score")


def fresh_path(spark) -> str:
    return f"{shared_folder(spark)}/hearsay-{uuid.uuid4().hex}"


@query("partitioned_slice", "S06 S01 S15", "posts",
       f"SELECT {', '.join(FIELDS)} FROM posts WHERE subreddit = 'click' AND created_utc "
       f"BETWEEN {WINDOW[0]} AND {WINDOW[1]}")
def partitioned_slice(spark, d):
    path = fresh_path(spark)
    P.write_partitioned(V.posts(spark, d), path)
    return P.slice_scan(P.scan_posts(spark, path, "*.parquet"), "click", *WINDOW, FIELDS)


@query("separated_texts", "S07 S08", "texts", "SELECT id, subreddit, title, md5(text) AS text_md5 FROM texts")
def separated_texts(spark, d):
    rows, path = V.texts(spark, d).select("id", "subreddit", "title", "text"), fresh_path(spark)
    TB.write_separated(rows, path)
    return TB.read_separated(spark, path, rows.schema).select(
        "id", "subreddit", "title", F.md5("text").alias("text_md5"))


@query("separated_parts", "S07", "texts", "SELECT id, subreddit, title, md5(text) AS text_md5 FROM texts")
def separated_parts(spark, d):
    """Values with line breaks, every file read by several tasks."""
    rows, path = V.texts(spark, d).select("id", "subreddit", "title", "text"), fresh_path(spark)
    TB.write_separated(rows, path)
    return TB.read_separated_in_parts(spark, path, rows.schema).select(
        "id", "subreddit", "title", F.md5("text").alias("text_md5"))


@query("separated_counts", "S09 S15", "posts",
       "SELECT author, class_II, count(*) AS n, avg(num_comments) AS mean FROM posts GROUP BY 1, 2")
def separated_counts(spark, d):
    counts, path = (V.posts(spark, d).groupBy("author", "class_II")
                    .agg(F.count(F.lit(1)).alias("n"), F.avg("num_comments").alias("mean"))), fresh_path(spark)
    TB.write_separated(counts, path, sep=",")
    return TB.read_separated(spark, path, counts.schema, sep=",", multi_line=False)


@query("name_list", "S10 S11", "posts", "SELECT DISTINCT author AS name FROM posts")
def name_list(spark, d):
    path = fresh_path(spark)
    TB.write_names(V.posts(spark, d), path, "author")
    return TB.read_names(spark, path, "name")


ZEROED = """z AS (SELECT CAST(src AS VARCHAR) AS src, CAST(trg AS VARCHAR) AS trg, CASE WHEN (src + trg) % 7 = 0
    THEN 0 ELSE CAST(nij AS DOUBLE) END AS nij FROM edges_wide),
    given AS (SELECT * FROM z WHERE nij > 0 AND src <> trg)"""


@query("edge_file", "S12 S13 N04", "edges_wide",
       "SELECT src, trg, nij FROM (SELECT *, row_number() OVER (PARTITION BY src, trg ORDER BY g, nij) AS rn "
       "FROM (SELECT src, trg, nij, 0 AS g FROM given UNION ALL SELECT trg, src, nij, 1 FROM given)) "
       "WHERE rn = 1", ZEROED)
def edge_file(spark, d):
    zero = (F.col("src") + F.col("trg")) % 7 == 0
    edges = V.edges_wide(spark, d).withColumn(
        "nij", F.when(zero, F.lit(0.0)).otherwise(F.col("nij").cast("double")))
    path = fresh_path(spark)
    TB.write_edges(edges, path)
    return TB.read_edges(spark, path, "nij", triangular=True, self_loops=False)[0]


@query("converted_posts", "S14 S15", "posts", f"SELECT {', '.join(FIELDS)} FROM posts")
def converted_posts(spark, d):
    rows, raw, path = V.posts(spark, d).select(*FIELDS), fresh_path(spark), fresh_path(spark)
    rows.write.json(raw)
    P.convert_to_parquet(spark, raw, path, "json", rows.schema)
    return P.scan_posts(spark, path)


@query("named_communities", "S05 S06 S15", "posts",
       "SELECT id, subreddit, score FROM posts WHERE subreddit LIKE 'c%' AND subreddit LIKE '%k'")
def named_communities(spark, d):
    """Folders chosen by prefix and suffix, beside a report in another format."""
    path = fresh_path(spark)
    P.write_partitioned(V.posts(spark, d).select("id", "subreddit", "score"), path)
    V.posts(spark, d).groupBy("subreddit").count().write.mode("append").partitionBy("subreddit").json(path)
    return P.scan_communities(spark, path, "c", "k").select("id", "subreddit", "score")


COMMENTS = ("id", "author", "body", "subreddit", "created_utc", "score")
SPAN = (1_583_500_000, 1_584_500_000)


@query("landed_comments", "S02 S06 P11", "comments",
       f"SELECT id, author, md5(body) AS body_md5, subreddit, created_utc, score FROM comments WHERE subreddit = 'c3' "
       f"AND created_utc BETWEEN {SPAN[0]} AND {SPAN[1]}")
def landed_comments(spark, d):
    """Comments landed by community; the slice prunes folders, row groups and columns."""
    path = fresh_path(spark)
    P.write_partitioned(V.comments(spark, d), path)
    found = P.slice_scan(P.scan_communities(spark, path, "c3", "c3"), "c3", *SPAN, COMMENTS)
    return found.select("id", "author", F.md5("body").alias("body_md5"), "subreddit", "created_utc", "score")


@query("topic_json", "S16", "posts", """
    SELECT 'phi' AS part, topic AS i, k AS j, NULL AS term, round(w, 9) AS value FROM m
    UNION ALL SELECT 'theta', topic, k, NULL, round(w, 9) FROM m
    UNION ALL SELECT DISTINCT 'doc.length', topic, NULL, NULL, n::DOUBLE FROM m
    UNION ALL SELECT 'vocab', k, NULL, 'label_' || k, sum(n)::DOUBLE FROM m GROUP BY k""",
       "m AS (SELECT row_number() OVER (ORDER BY subreddit) - 1 AS topic, unnest([0, 1, 2])::BIGINT AS k, "
       "unnest([avg(label_0), avg(label_1), avg(label_2)]) AS w, count(*) AS n FROM posts GROUP BY subreddit)")
def topic_json(spark, d):
    """A stored model with all its parts: one topic and document per community."""
    rows = V.posts(spark, d).groupBy("subreddit").agg(
        F.array(*[F.avg(f"label_{i}") for i in range(3)]).alias("w"), F.count(F.lit(1)).alias("n"))
    numbered = cut_lineage(rows.withColumn("topic", F.row_number().over(
        Window.partitionBy(F.lit(0)).orderBy("subreddit")) - 1))      # one row per community
    cells = numbered.select("topic", "n", F.posexplode("w").alias("k", "weight"))
    words = cells.groupBy("k").agg(F.sum("n").alias("tf")).select(
        F.col("k").alias("term_id"), F.concat(F.lit("label_"), F.col("k").cast("string")).alias("term"), "tf")
    path = fresh_path(spark)
    TB.write_topic_json(spark, path, cells.select("topic", F.col("k").alias("term_id"), "weight"),
                        cells.select(F.col("topic").alias("doc"), F.col("k").alias("topic"), "weight"),
                        numbered.select(F.col("topic").alias("doc"), F.col("n").alias("length")), words)
    t = TB.read_topic_json(spark, path)
    rows = lambda name, table, i, j, term, value: table.select(
        F.lit(name).alias("part"), F.col(i).cast("long").alias("i"), (F.col(j) if j else F.lit(None)).cast("long").alias("j"),
        (F.col(term) if term else F.lit(None)).cast("string").alias("term"), F.round(F.col(value).cast("double"), 9).alias("value"))
    return (rows("phi", t["topic_term"], "topic", "term_id", None, "weight")
            .unionByName(rows("theta", t["doc_topic"], "doc", "topic", None, "weight"))
            .unionByName(rows("doc.length", t["doc_length"], "doc", None, None, "length"))
            .unionByName(rows("vocab", t["vocabulary"], "term_id", None, "term", "tf")))


@query("term_lines", "S17", "texts", "SELECT CAST(term_id AS BIGINT) AS term_id, term FROM voc",
       f"{MQ.TOK}, {MQ.VOC}")
def term_lines(spark, d):
    path = fresh_path(spark)
    TB.write_lines(TP.vocabulary(MQ._tokens(spark, d), 1000, 3.0, 0.3), path, "term", "term_id")
    return TB.read_lines(spark, path, "term")


@query("flat_scores", "S18 F05", "posts",
       'SELECT row_number() OVER (ORDER BY id) - 1 AS "row", label_0 AS s_0, label_1 AS s_1, label_2 AS s_2 FROM posts')
def flat_scores(spark, d):
    path = fresh_path(spark)
    TB.write_flat_numbers(V.posts(spark, d), path, ["label_0", "label_1", "label_2"], "id")
    return FE.unflatten(TB.read_flat_numbers(spark, path), 3)


@query("report_file", "S19", "posts", "SELECT class_II, count(*) AS n, max(num_comments) AS most FROM posts GROUP BY 1")
def report_file(spark, d):
    report = V.posts(spark, d).groupBy("class_II").agg(
        F.count(F.lit(1)).alias("n"), F.max("num_comments").alias("most"))
    path = fresh_path(spark)
    TB.write_report(report, path)
    return spark.read.schema(report.schema).json(path)


@query("annotation_file", "S20 P17", "texts", f"SELECT md5({TQ.SKIP}) AS text_md5, 0 AS label FROM texts")
def annotation_file(spark, d):
    rows = D.annotation_rows(V.texts(spark, d), X.compose(F.col("title"), F.col("selftext")))
    path = fresh_path(spark)
    TB.write_separated(rows, path, sep=",")
    return TB.read_separated(spark, path, rows.schema, sep=",").select(F.md5("text").alias("text_md5"), "label")


@query("saved_vocabulary", "S22 M02", "texts", """
    SELECT 'word_ids' AS part, word AS key, word_id AS value, NULL AS label FROM vocab
    UNION ALL SELECT 'label_ids', label, id, NULL FROM labs UNION ALL SELECT 'id_labels', CAST(id AS VARCHAR), NULL, label FROM labs""",
       f"{TQ.TOKENS}, {TQ.TRAIN}, {TQ.VOCAB}, labs AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS id FROM "
       "(SELECT DISTINCT lang AS label FROM texts WHERE lang IS NOT NULL))")
def saved_vocabulary(spark, d):
    """The three dictionaries of a classifier, written and read back."""
    path = fresh_path(spark)
    labels = FE.label_index(V.texts(spark, d).select(F.col("lang").alias("label")))
    TB.save_dictionaries(FE.vocabulary(TQ._train(spark, d)), labels, path)
    t = TB.load_dictionaries(spark, path)
    none = F.lit(None)
    return (t["word_ids"].select(F.lit("word_ids").alias("part"), F.col("word").alias("key"), F.col("word_id").cast("long").alias("value"),
                                 none.cast("string").alias("label"))
            .union(t["label_ids"].select(F.lit("label_ids"), "label", F.col("label_id").cast("long"), none.cast("string")))
            .union(t["id_labels"].select(F.lit("id_labels"), F.col("id").cast("string"), none.cast("long"), "label")))


@query("corpus_by_stance", "T02 S06", "posts",
       "SELECT id, class_II FROM posts WHERE class_I = 1 AND class_II IN (0, 2)")
def corpus_by_stance(spark, d):
    path = fresh_path(spark)
    TP.write_by_stance(TP.corpus(V.posts(spark, d)), path)
    stances = [spark.read.parquet(path).where(F.col("class_II") == s) for s in (0, 2)]
    return stances[0].unionByName(stances[1]).select("id", "class_II")
