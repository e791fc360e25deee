"""Topic modelling: tokens, bag of words, LDA and the tables around it.

Every table is keyed by ``term_id`` or the document id, never by row position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import LDA, LDAModel
from pyspark.ml.feature import CountVectorizerModel, StopWordsRemover
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearsay.functions import text as X
from hearsay.operators import variational
from hearsay.operators.ordered import top_n_per_group

# Corpus columns; vocabulary and model settings of the two runs.
CORPUS_COLUMNS = ("selftext", "title", "id", "score", "author", "created_utc", "class_II",
                  "conf_II", "subreddit")
SWEEP = {"vocab_size": 1000, "min_df": 3.0, "max_df": 1.0, "k": range(2, 13), "max_iter": 10}
FINAL = {"vocab_size": 5000, "min_df": 3.0, "max_df": 0.3, "topic_concentration": 0.5}


# ---------------------------------------------------------------- corpus

def corpus(posts: DataFrame, columns: Sequence[str] = CORPUS_COLUMNS) -> DataFrame:
    """On-topic posts with the corpus columns."""
    return posts.where("class_I = 1").select(*[c for c in columns if c in posts.columns])


def write_by_stance(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).partitionBy("class_II").parquet(path)


def tokens(df: DataFrame, text_col: str, stop_words: Sequence[str] | None = None,
           out_col: str = "tokens", letters: bool = True) -> DataFrame:
    """Whitespace tokens, letters only, without stop words in any case."""
    words = X.letter_tokens(F.col(text_col)) if letters else X.tokens(F.col(text_col))
    stops = list(stop_words) if stop_words is not None else \
        StopWordsRemover.loadDefaultStopWords("english")
    return df.withColumn(out_col, X.remove_stop_words(words, stops))


# ---------------------------------------------------------------- bag of words

def vocabulary(df: DataFrame, vocab_size: int, min_df: float = 1.0, max_df: float = 1.0,
               token_col: str = "tokens") -> DataFrame:
    """Most frequent terms ``(term_id, term, tf, df)``.

    Document frequency limits are counts, or shares of all documents when at or
    below one (``min_df`` below one).  Ties of the frequency break by term, so
    the vocabulary does not depend on partitioning.
    """
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    # one pass: a text lists its tokens for the frequency and its distinct tokens for df
    cell = lambda tf, df_: lambda t: F.struct(t.alias("term"), F.lit(tf).alias("tf"), F.lit(df_).alias("df"))
    cells = F.concat(F.transform(token_col, cell(1, 0)),
                     F.transform(F.array_distinct(token_col), cell(0, 1)))
    every = df.select(F.inline(cells)).groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
    low = F.lit(min_df) * total if min_df < 1 else F.lit(min_df)
    high = F.lit(max_df) * total if max_df <= 1 else F.lit(max_df)
    kept = every.where((F.col("df") >= low) & (F.col("df") <= high))
    best = kept.orderBy(F.desc("tf"), "term").limit(vocab_size)
    ranked = best.agg(F.array_sort(F.collect_list(F.struct((-F.col("tf")).alias("o"), "term", "tf", "df")))
                      .alias("v"))  # at most vocab_size entries
    return ranked.select(F.posexplode("v").alias("term_id", "v")).select(
        "term_id", "v.term", "v.tf", "v.df")


def vectorizer(vocab: DataFrame, token_col: str = "tokens",
               out_col: str = "features") -> CountVectorizerModel:
    """Bag-of-words model over a vocabulary table; the table is capped in size."""
    words = [r["term"] for r in vocab.orderBy("term_id").collect()]
    return CountVectorizerModel.from_vocabulary(words, inputCol=token_col, outputCol=out_col)


def vocabulary_table(df: DataFrame, model: CountVectorizerModel) -> DataFrame:
    return df.sparkSession.createDataFrame(list(enumerate(model.vocabulary)), "term_id int, term string")


# ---------------------------------------------------------------- models

def fit(vectors: DataFrame, k: int, max_iter: int = 10, seed: int = 42,
        topic_concentration: float | None = None, features: str = "features",
        subsampling_rate: float | None = None) -> LDAModel:
    lda = LDA(k=k, maxIter=max_iter, seed=seed, featuresCol=features)
    if topic_concentration is not None:
        lda = lda.setTopicConcentration(topic_concentration)
    if subsampling_rate is not None:
        lda = lda.setSubsamplingRate(subsampling_rate)
    return lda.fit(vectors)


def sweep(vectors: DataFrame, ks: Sequence[int], max_iter: int = 10, seed: int = 42,
          features: str = "features") -> DataFrame:
    """Log-likelihood and log-perplexity bounds by number of topics.

    The vectors are kept between the passes, so the token pipeline runs once.  The models are
    those of ``fit``, all in lock-step: a pass over the vectors is one iteration of every
    model, and the last one gives the bounds, which infer the topics of every document, and
    the tokens.  The perplexity is the bound per token.
    """
    kept = vectors.select(features).persist()
    tokens, found = variational.bounds(kept, list(ks), max_iter, seed, features) if len(ks) else (0.0, [])
    kept.unpersist()
    rows = [(k, bound, -bound / tokens if tokens else float("nan")) for k, bound in zip(ks, found)]
    return vectors.sparkSession.createDataFrame(
        rows, "k int, log_likelihood double, log_perplexity double")


# ---------------------------------------------------------------- tables of a model

def topic_term(model: LDAModel, vocab: DataFrame) -> DataFrame:
    """Long topic-term matrix with words ``(topic, term_id, term, weight)``."""
    long = model.describeTopics(model.vocabSize()).select(
        "topic", F.explode(F.arrays_zip("termIndices", "termWeights")).alias("e"))
    flat = long.select("topic", F.col("e.termIndices").alias("term_id"),
                       F.col("e.termWeights").alias("weight"))
    return flat.join(vocab.select("term_id", "term"), "term_id").select(
        "topic", "term_id", "term", "weight")


def describe(model: LDAModel, vocab: DataFrame, n: int = 10) -> DataFrame:
    """Top-n terms of every topic ``(topic, rank, term, weight)``."""
    long = model.describeTopics(n).select(
        "topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("rank", "e"))
    return (long.select("topic", (F.col("rank") + 1).alias("rank"),
                        F.col("e.termIndices").alias("term_id"), F.col("e.termWeights").alias("weight"))
            .join(vocab.select("term_id", "term"), "term_id").select("topic", "rank", "term", "weight"))


def top_words(topic_terms: DataFrame, n: int = 30) -> DataFrame:
    """Top-n words per topic from a long matrix."""
    return top_n_per_group(topic_terms, ["topic"], [F.desc("weight"), F.col("term")], n, salts=1,
                           out_col="rank")


def doc_topic(model: LDAModel, vectors: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Topic weights of every document, one column per topic."""
    p = vector_to_array("topicDistribution")
    k = n_topics(model)
    return model.transform(vectors).select(*keep, *[p[i].alias(f"topic_{i}") for i in range(k)])


def wide_topic_term(topic_terms: DataFrame, k: int) -> DataFrame:
    """Long matrix -> one row per term, one column per topic."""
    return (topic_terms.groupBy("term_id", "term").pivot("topic", list(range(k)))
            .agg(F.first("weight")).select("term_id", "term", *[
                F.col(str(i)).alias(f"topic_{i}") for i in range(k)]))


def doc_length(df: DataFrame, keep: Sequence[str], token_col: str = "tokens") -> DataFrame:
    return df.select(*keep, F.size(token_col).alias("doc_len"))


def term_frequency(df: DataFrame, vocab: DataFrame, token_col: str = "tokens") -> DataFrame:
    """Corpus frequency of the vocabulary terms ``(term_id, term, tf)``."""
    counts = df.select(F.explode(token_col).alias("term")).groupBy("term").agg(
        F.count(F.lit(1)).alias("tf"))
    return vocab.select("term_id", "term").join(counts, "term")


def valid_documents(doc_topics: DataFrame, k: int, tolerance: float = 1e-6) -> DataFrame:
    """Documents whose topic weights sum to one (empty documents sum to zero)."""
    total = F.expr(" + ".join(f"topic_{i}" for i in range(k)))
    return doc_topics.where(F.abs(total - 1) < tolerance)


def browser_tables(model: LDAModel, vectors: DataFrame, vocab: DataFrame, id_col: str = "id",
                   token_col: str = "tokens") -> dict[str, DataFrame]:
    """Keyed inputs of a topic browser: matrices, lengths, vocabulary with frequencies."""
    k = n_topics(model)
    lengths = doc_length(vectors, [id_col], token_col)
    docs = valid_documents(doc_topic(model, vectors, [id_col]), k).join(lengths, id_col)
    return {
        "topic_term": topic_term(model, vocab),
        "doc_topic": docs.drop("doc_len"),
        "doc_length": docs.select(id_col, "doc_len"),
        "vocabulary": term_frequency(vectors, vocab, token_col),
    }


def n_topics(model: LDAModel) -> int:
    return int(model.topicsMatrix().numCols)


def mix_by(doc_topics: DataFrame, k: int, key: str = "subreddit",
           members: Sequence[str] | None = None, sort_by: str | None = "topic_0") -> DataFrame:
    """Mean topic weights per community, optionally of a sub-cluster, sorted."""
    if members is not None:
        doc_topics = doc_topics.where(F.col(key).isin(list(members)))
    mean = doc_topics.groupBy(key).agg(*[F.avg(f"topic_{i}").alias(f"topic_{i}") for i in range(k)])
    return mean.orderBy(sort_by, key) if sort_by else mean
