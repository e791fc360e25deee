"""Vocabulary and encoding with hot prefixes and long texts."""

from pyspark.sql import functions as F

from hearsay.operators import features as FE
from hearsay.operators import models as M


def test_vocabulary_with_one_prefix_on_most_words(spark):
    words = [f"http{i:04d}" for i in range(900)] + [f"w{i:03d}" for i in range(100)] + ["", "é", "Z"]
    rows = [(i, words[i::7] * 2) for i in range(7)]
    found = FE.vocabulary(spark.createDataFrame(rows, "id long, tokens array<string>")).collect()
    order = sorted(words, key=lambda w: w.encode())
    assert {r["word"]: r["word_id"] for r in found} == {w: n + 2 for n, w in enumerate(order)}


def test_only_the_kept_words_are_looked_up(spark):
    texts = [(1, [f"w{i % 50}" for i in range(5000)]), (2, ["w1", "never"]), (3, []), (4, None)]
    df = spark.createDataFrame(texts, "id long, tokens array<string>")
    vocab = FE.vocabulary(df.where("id = 1"))
    tail = {r["id"]: r["ids"] for r in FE.encode(df, vocab, last=10).collect()}
    whole = {r["id"]: r["ids"] for r in FE.encode(df, vocab).collect()}
    assert len(tail[1]) == 10 and tail == {k: v[-10:] for k, v in whole.items()}
    assert whole[2][1] == FE.UNKNOWN_ID and whole[3] == whole[4] == []
    featured = M.with_features(df, vocab, 10)
    padded = FE.encode(df, vocab).select("id", FE.pad(F.col("ids"), 10).alias("p"))
    want = {r["id"]: [float(x) for x in r["p"]] for r in padded.collect()}
    assert {r["id"]: list(r["features"].toArray()) for r in featured.collect()} == want
