"""Training, scoring and topic-model queries."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from hearsay.functions import text as X
from hearsay.operators import datasets as D
from hearsay.operators import evaluation as E
from hearsay.operators import features as FE
from hearsay.operators import models as M
from hearsay.operators import topics as TP
from hearsay.plans import views as V
from hearsay.plans.network_queries import r9
from hearsay.plans.registry import query
from hearsay.plans.text_queries import LABELS, STOPS, split
from hearsay.session import cut_lineage

TOPICS = 4


def _labelled(spark, d):
    """Labelled documents with tokens and a hash split."""
    docs = V.texts(spark, d).select("id", "subreddit", "text", X.tokens(F.col("text")).alias("tokens"))
    labels = V.table(spark, d, "labels").select(F.col("doc_id").alias("id"),
                                                F.col("quality").alias("label"))
    return D.stratified_split(docs.join(labels, "id"), "label", 0.2)


def _featured(spark, d):
    """Train and test vectors; vocabulary and padded length come from the training part only."""
    rows = _labelled(spark, d)
    return M.fitted_features(rows.drop("text"), F.col("split") == "train")


def stance_model():
    """A stand-in for a loaded model: class scores from character counts."""
    def score(texts):
        n = np.fromiter((len(t or "") for t in texts), dtype=np.int64, count=len(texts))
        parts = np.stack([n % 7 + 1, n % 5 + 1, n % 3 + 1], axis=1)
        return parts / parts.sum(axis=1, keepdims=True)
    return score


SCORED = """sc AS (SELECT id, a / CAST(a + b + c AS DOUBLE) AS label_0, b / CAST(a + b + c AS DOUBLE)
    AS label_1, c / CAST(a + b + c AS DOUBLE) AS label_2 FROM (SELECT id, length(text) % 7 + 1 AS a,
    length(text) % 5 + 1 AS b, length(text) % 3 + 1 AS c FROM texts))"""


@query("score_batches", "M13 D05", "texts", "SELECT * FROM sc", SCORED)
def score_batches(spark, d):
    texts = V.texts(spark, d).select("id", "text")
    return M.score_batches(texts, "text", stance_model, 3).drop("text")


@query("score_top_label", "M14 F16", "texts",
       "SELECT id, CASE greatest(label_0, label_1, label_2) WHEN label_0 THEN 0 WHEN label_1 THEN 1 "
       "ELSE 2 END AS pred_1, greatest(label_0, label_1, label_2) AS conf_1 FROM sc", SCORED)
def score_top_label(spark, d):
    texts = V.texts(spark, d).select("id", "text")
    scored = M.score_batches(texts, "text", stance_model, 3)
    return M.top_label(scored, 3).select("id", "pred_1", "conf_1")


@query("train_logreg", "M07 M12 M06")
def train_logreg(spark, d):
    rows, _ = _featured(spark, d)
    model = M.train_logreg(rows.where("split = 'train'"), max_iter=30)
    scored = M.class_columns(model.transform(rows.where("split = 'test'")), 2, "s_")
    named = E.with_prediction(scored.withColumn("y", F.col("label")), ["s_0", "s_1"])
    return E.accuracy_f1(named, 2)


# ---------------------------------------------------------------- topics

LETTERS = "list_filter(list_transform({t}, lambda x: regexp_replace(x, '[^\\p{{L}}]', '', 'g')), " \
          "lambda x: x <> '' AND NOT list_contains({s}, lower(x)))"
TOK = f"tok AS (SELECT id, subreddit, {LETTERS.format(t=split('text'), s=STOPS)} AS tokens FROM texts)"
VOC = """every AS (SELECT term, count(*) AS tf, count(DISTINCT id) AS df FROM
      (SELECT id, unnest(tokens) AS term FROM tok) GROUP BY 1),
    voc AS (SELECT CAST(row_number() OVER (ORDER BY tf DESC, term) - 1 AS INTEGER) AS term_id, term, tf, df
      FROM every WHERE df >= 3 AND df <= 0.3::DOUBLE * (SELECT count(*) FROM tok)
      ORDER BY tf DESC, term LIMIT 1000)"""


def _tokens(spark, d):
    return TP.tokens(V.texts(spark, d).select("id", "subreddit", "text"), "text", STOPS).drop("text")


def _vectors(spark, d, *columns):
    words = cut_lineage(_tokens(spark, d))      # read by the vocabulary and by the vectors
    vocab = cut_lineage(TP.vocabulary(words, 1000, 3.0, 0.3))
    vectors = TP.vectorizer(vocab).transform(words)
    return cut_lineage(vectors.select(*columns) if columns else vectors), vocab


def _model(spark, d):
    vectors, vocab = _vectors(spark, d)
    return TP.fit(vectors, TOPICS, 10, topic_concentration=0.5, subsampling_rate=0.2), vectors, vocab


@query("topic_corpus", "T01", "posts",
       "SELECT id, score, author, created_utc, class_II, subreddit FROM posts WHERE class_I = 1")
def topic_corpus(spark, d):
    return TP.corpus(V.posts(spark, d))


@query("topic_tokens", "T03", "texts",
       "SELECT id, len(tokens) AS n, md5(array_to_string(tokens, ' ')) AS tokens_md5 FROM tok", TOK)
def topic_tokens(spark, d):
    return _tokens(spark, d).select("id", F.size("tokens").cast("long").alias("n"),
                                    F.md5(F.array_join("tokens", " ")).alias("tokens_md5"))


@query("topic_vocabulary", "T04", "texts", "SELECT * FROM voc", f"{TOK}, {VOC}")
def topic_vocabulary(spark, d):
    return TP.vocabulary(_tokens(spark, d), 1000, 3.0, 0.3)


@query("term_frequency", "T11 F25 S17", "texts", "SELECT term_id, term, tf FROM voc", f"{TOK}, {VOC}")
def term_frequency(spark, d):
    words = cut_lineage(_tokens(spark, d))
    return TP.term_frequency(words, TP.vocabulary(words, 1000, 3.0, 0.3))


@query("doc_length", "T10 J16 F25", "texts", "SELECT id, subreddit, CAST(len(tokens) AS INTEGER) AS doc_len FROM tok", TOK)
def doc_length(spark, d):
    return TP.doc_length(_tokens(spark, d), ["id", "subreddit"])


@query("bag_of_words", "T04 F24", "texts",
       "SELECT id, term_id, count(*) AS n FROM (SELECT id, unnest(tokens) AS term FROM tok) "
       "JOIN voc USING (term) GROUP BY 1, 2", f"{TOK}, {VOC}")
def bag_of_words(spark, d):
    vectors, _ = _vectors(spark, d)
    cells = F.filter(F.transform(vector_to_array("features"), lambda n, i: F.struct(
        i.alias("term_id"), n.cast("long").alias("n"))), lambda x: x["n"] > 0)
    return vectors.select("id", F.inline(cells))


@query("lda_sweep", "T05 T06 S19")
def lda_sweep(spark, d):
    vectors, _ = _vectors(spark, d)
    return TP.sweep(vectors, [2, 3, 4], max_iter=5)


@query("topic_words", "T07 J15")
def topic_words(spark, d):
    model, _, vocab = _model(spark, d)
    return TP.describe(model, vocab, 10)


@query("topic_term", "T08 F24")
def topic_term(spark, d):
    model, _, vocab = _model(spark, d)
    return TP.wide_topic_term(TP.topic_term(model, vocab), TOPICS)


@query("topic_top_words", "T14 L04")
def topic_top_words(spark, d):
    model, _, vocab = _model(spark, d)
    return TP.top_words(TP.topic_term(model, vocab), 30)


@query("doc_topic", "T09 T12 P15")
def doc_topic(spark, d):
    model, vectors, vocab = _model(spark, d)
    return TP.browser_tables(model, vectors, vocab)["doc_topic"]


@query("topic_mix_by_community", "T13 A26 P07 L05")
def topic_mix_by_community(spark, d):
    model, vectors, _ = _model(spark, d)
    docs = TP.valid_documents(TP.doc_topic(model, vectors, ["id", "subreddit"]), TOPICS)
    return TP.mix_by(docs, TOPICS, members=list(LABELS))


@query("topic_mix_of_scores", "A26 T13", "posts",
       "SELECT subreddit, " + ", ".join(f"round(avg(label_{i}), 9) AS topic_{i}" for i in range(3))
       + " FROM posts WHERE subreddit IN ('click', 'view', 'error') GROUP BY 1")
def topic_mix_of_scores(spark, d):
    docs = V.posts(spark, d).select("subreddit", *[F.col(f"label_{i}").alias(f"topic_{i}") for i in range(3)])
    return r9(TP.mix_by(docs, 3, members=["click", "view", "error"]), "topic_0", "topic_1", "topic_2")


@query("top_weights_per_topic", "L04 T14", "posts",
       "SELECT subreddit AS topic, id AS term, weight, rn AS rank FROM (SELECT subreddit, id, score AS weight, "
       "CAST(row_number() OVER (PARTITION BY subreddit ORDER BY score DESC, id) AS INTEGER) AS rn FROM posts) WHERE rn <= 30")
def top_weights_per_topic(spark, d):
    cells = V.posts(spark, d).select(F.col("subreddit").alias("topic"), F.col("id").alias("term"),
                                     F.col("score").alias("weight"))
    return TP.top_words(cells, 30)


# ---------------------------------------------------------------- what is determined about a fitted topic model

HELD = "held AS (SELECT DISTINCT id FROM (SELECT id, unnest(tokens) AS term FROM tok) JOIN voc USING (term))"


@query("topic_model_tables", "T05 T07 T08 T09 T12 J15", "texts", f"""
    SELECT 'topic_words' AS part, CAST(t AS VARCHAR) AS key, 10::BIGINT AS n, 1.0::DOUBLE AS total FROM range(0, {TOPICS}) r(t)
    UNION ALL SELECT 'topic_term', CAST(t AS VARCHAR), (SELECT count(*) FROM voc), 1.0 FROM range(0, {TOPICS}) r(t)
    UNION ALL SELECT 'doc_topic', CAST(id AS VARCHAR), {TOPICS}, 1.0 FROM held
    UNION ALL SELECT 'doc_length', CAST(id AS VARCHAR), len(tokens), 1.0 FROM tok JOIN held USING (id)
    UNION ALL SELECT 'vocabulary', term, tf, 1.0 FROM voc""", f"{TOK}, {VOC}, {HELD}")
def topic_model_tables(spark, d):
    """All tables of a fitted model, as far as the corpus determines them: words per topic
    (ranks without gaps, words of the vocabulary), weights that sum to one, documents."""
    model, vectors, vocab = _model(spark, d)
    t = TP.browser_tables(model, vectors, vocab)
    words = (TP.describe(model, vocab, 10).groupBy("topic").agg(
        F.count_distinct("rank", "term").alias("n"), (F.max("rank") - F.min("rank") + 1 - F.count_distinct("rank") + 1.0).alias("total")))
    terms = t["topic_term"].groupBy("topic").agg(F.count_distinct("term").alias("n"), F.round(F.sum("weight"), 6).alias("total"))
    docs = t["doc_topic"].select("id", F.lit(TOPICS).alias("n"), F.round(F.expr(" + ".join(
        f"topic_{i}" for i in range(TOPICS))), 6).alias("total"))
    rows = lambda name, table, key, n, total: table.select(
        F.lit(name).alias("part"), F.col(key).cast("string").alias("key"), F.col(n).cast("long").alias("n"), total.cast("double").alias("total"))
    one = F.lit(1.0)
    return (rows("topic_words", words, "topic", "n", F.col("total")).union(rows("topic_term", terms, "topic", "n", F.col("total")))
            .union(rows("doc_topic", docs, "id", "n", F.col("total"))).union(rows("doc_length", t["doc_length"], "id", "doc_len", one))
            .union(rows("vocabulary", t["vocabulary"], "term", "tf", one)))


@query("lda_sweep_bounds", "T05 T06", "texts", """
    SELECT CAST(k AS INTEGER) AS k, (SELECT sum(n) FROM (SELECT count(*) AS n FROM (SELECT unnest(tokens) AS term FROM tok) JOIN voc USING (term)))::BIGINT
      AS tokens, true AS negative FROM range(2, 13) r(k)""", f"{TOK}, {VOC}")
def lda_sweep_bounds(spark, d):
    """The published sweep, 2 to 12 topics in 10 iterations: the perplexity is the bound per token,
    so the quotient gives the tokens of the corpus back."""
    vectors, _ = _vectors(spark, d, "features")
    found = TP.sweep(vectors, TP.SWEEP["k"], max_iter=TP.SWEEP["max_iter"])
    return found.select("k", F.round(-F.col("log_likelihood") / F.col("log_perplexity")).cast("long").alias("tokens"),
                        (F.col("log_likelihood") < 0).alias("negative"))
