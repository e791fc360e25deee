"""Text, aggregates, coverage, cross-posts, sources, scoring and topics on small fixtures."""

import datetime
import json
import math
import random

import numpy as np
import pytest
from pyspark.ml.clustering import LDAModel
from pyspark.sql import functions as F

from hearsay.functions import scalar as S
from hearsay.functions import text as X
from hearsay.operators import aggregates as A
from hearsay.operators import coverage as C
from hearsay.operators import crosspost as CP
from hearsay.operators import models as M
from hearsay.operators import topics as TP
from hearsay.operators import variational
from hearsay.sources import posts as P
from hearsay.sources import tabular as TB


# ---------------------------------------------------------------- text and scalars

def test_normalize_and_compose(spark):
    df = spark.createDataFrame([("CAFÉ http://t.co/9 {HTML} 12,5", None), ("a_b!", "x 3")], "t string, b string")
    rows = df.select(X.normalize(F.col("t")).alias("n"), X.compose(F.col("t"), F.col("b")).alias("s"),
                     X.compose(F.col("t"), F.col("b"), "propagate").alias("p")).collect()
    assert rows[0]["n"] == "café [URL]  [NUM]" and rows[1]["n"] == "a_b"
    assert rows[0]["s"].startswith("CAFÉ") and rows[0]["p"] == "nan"
    assert rows[1]["s"] == rows[1]["p"] == "a_b! x 3"
    masked = df.select(X.repair_masks(F.lit("a [ NUM ] b")).alias("m")).first()["m"]
    assert masked == "a [NUM] b"


def test_tokens_and_lemmas(spark):
    df = spark.createDataFrame([(1, " The  mice ran "), (2, None), (3, "")], "id int, t string")
    words = df.select("id", X.tokens(F.col("t")).alias("tokens"))
    assert {r["id"]: r["tokens"] for r in words.collect()} == {1: ["The", "mice", "ran"], 2: [], 3: []}
    lexicon = spark.createDataFrame([("mice", "mouse"), ("ran", "run")], "word string, lemma string")
    kept = words.select("id", X.remove_stop_words(F.col("tokens"), ["the"]).alias("tokens"))
    out = X.lemmatize(kept, "id", "tokens", lexicon)
    assert {r["id"]: r["lemmas"] for r in out.collect()} == {1: ["mouse", "run"], 2: [], 3: []}
    small = kept.select(X.map_lemmas(F.col("tokens"), {"mice": "mouse"}).alias("l")).first()["l"]
    assert small == ["mouse", "ran"]


def test_scalar_helpers(spark):
    one = spark.range(1)
    row = one.select(
        S.argmax(F.array(F.lit(0.4), F.lit(0.4), F.lit(0.2))).alias("arg"),
        S.is_max(F.array(F.lit(0.4), F.lit(0.4), F.lit(0.2))).alias("hot"),
        S.strip_id_prefix(F.lit("t3_abc")).alias("id"),
        S.slice_file_name(F.lit("/x/a-b-1593960600.pickle")).alias("name"),
        S.slice_file_start(F.lit("/x/a-b-1593960600.pickle")).alias("start"),
        S.date_of(F.lit(1593989999), "UTC").alias("utc"),
        S.date_of(F.lit(1593989999), "Asia/Tokyo").alias("tokyo"),
        S.epoch_of_date(F.lit("2020-03-01")).alias("epoch"),
        S.recode(F.lit("b"), {"a": "1"}).alias("same"),
        S.share(F.lit(1), F.lit(0)).alias("none")).first()
    assert row["arg"] == 0 and row["hot"] == [1, 1, 0] and row["id"] == "abc"
    assert (row["name"], row["start"]) == ("a-b", 1593960600)
    assert row["utc"] == datetime.date(2020, 7, 5) and row["tokyo"] == datetime.date(2020, 7, 6)
    assert row["epoch"] == 1583020800 and row["same"] == "b" and row["none"] is None


# ---------------------------------------------------------------- aggregates

POSTS = [("u1", "a", 0, 0, 1, 5), ("u1", "a", 1, 0, 1, 5), ("u2", "b", 2, 0, 1, None),
         (None, "b", 1, 86400, 0, 1), ("[deleted]", "a", 0, 90000, 1, 2)]


@pytest.fixture(scope="module")
def posts(spark):
    return spark.createDataFrame(POSTS, "author string, subreddit string, class_II int, created_utc long, "
                                        "class_I int, score long").cache()


def test_class_db(posts):
    wide = {r["author"]: tuple(r)[1:] for r in A.class_db(posts, ["author"]).collect()}
    assert wide == {"u1": (1, 1, 0), "u2": (0, 0, 0), "[deleted]": (1, 0, 0)}
    holes = {r["author"]: tuple(r)[1:] for r in A.class_db(posts, ["author"], fill=None).collect()}
    assert holes["u1"] == (1, 1, None) and holes["u2"] == (None, None, 0)
    long = A.class_counts(posts, ["author"])
    assert long.agg(F.sum("n")).first()[0] == 3
    half = A.class_db(posts.where("subreddit = 'a'"), ["author"]), A.class_db(posts.where("subreddit = 'b'"), ["author"])
    merged = A.merge_counts(half, ["author"], ["n_anti", "n_neutral", "n_pro"])
    assert {r["author"]: tuple(r)[1:] for r in merged.collect()} == wide
    assert A.with_shares(A.class_db(posts, ["author"])).where("author = 'u2'").first()["p_anti"] is None


def test_community_stats(posts):
    plain = {r["subreddit"]: (r["posts"], r["authors"]) for r in A.community_stats(posts, "none").collect()}
    assert plain == {"a": (3, 2), "b": (2, 1)}
    nulls = {r["subreddit"]: r["authors"] for r in A.community_stats(posts, "none", count_null_author=True).collect()}
    assert nulls == {"a": 2, "b": 2}
    with pytest.raises(ValueError):
        A.community_stats(posts, "other")


def test_daily(posts):
    daily = A.daily_counts(posts, keys=())
    spine = {str(r["date"]): r["n"] for r in A.date_spine(daily, ["n"], end="1970-01-04").collect()}
    assert spine == {"1970-01-01": 3, "1970-01-02": 2, "1970-01-03": 0, "1970-01-04": 0}
    assert A.peaks(daily, "n").first()["n"] == 3
    assert A.between_days(daily, "1970-01-01", "1970-01-03").count() == 1
    other = A.exclude_series(daily, daily.where("n = 2"), ["n"])
    assert sorted(r["n"] for r in other.collect()) == [0, 3]


def test_histogram_and_summary(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 1, 9, 10, 10)], "v double")
    assert [r["n"] for r in A.histogram(df, "v", 5).orderBy("bin").collect()] == [3, 0, 0, 0, 3]
    row = A.summary(df, "v").first()
    assert (row["count"], row["min"], row["max"], row["q50"]) == (6, 0.0, 10.0, 5.0)


# ---------------------------------------------------------------- coverage

def test_slices(spark):
    one = spark.createDataFrame([("c",)], "subreddit string")
    grid = [tuple(r)[1:] for r in C.time_slices(one, 0, 100, 4).orderBy("slice_start").collect()]
    assert grid == [(0, 24), (25, 49), (50, 74), (75, 86499)]
    seconds = spark.range(0, 86502).select(F.lit("c").alias("subreddit"), F.col("id").alias("created_utc"))
    landed = {r["slice_start"]: r["n_rows"] for r in C.landed_slices(seconds, 0, 101, 4).collect()}
    starts = [int(i * 101 / 4) for i in range(4)]
    assert landed == {s: (starts[i + 1] if i < 3 else 86501) - s for i, s in enumerate(starts)}


def test_coverage(spark):
    grid = C.time_slices(spark.createDataFrame([("x",), ("y",), ("z",)], "subreddit string"), 0, 100, 4)
    landed = spark.createDataFrame([("x", 0, 1), ("x", 25, 2), ("x", 50, 1), ("x", 75, 1), ("y", 0, 1),
                                    ("y", 50, 3), ("z", 0, 0)], "subreddit string, slice_start long, n_rows long")
    gaps = {(r["subreddit"], r["slice_start"]) for r in C.missing_slices(grid, landed).collect()}
    assert gaps == {("y", 25), ("y", 75), ("z", 0), ("z", 25), ("z", 50), ("z", 75)}
    assert [r["subreddit"] for r in C.complete(landed, 4).collect()] == ["x"]
    flat = {r["subreddit"]: r["contiguous"] for r in C.contiguous(landed, 25.0).collect()}
    assert flat == {"x": True, "y": False, "z": True}
    wanted = grid.select("subreddit").distinct()
    assert C.not_landed(wanted, landed.where("subreddit <> 'z'")).collect()[0]["subreddit"] == "z"
    assert C.already_landed(wanted, landed.where("subreddit <> 'z'")).count() == 2
    close = spark.range(1).select(C.is_close(F.lit(1_583_000_000), F.lit(1_583_500_000)).alias("a"),
                                  C.is_close(F.lit(1_583_000_000), F.lit(1_584_000_000)).alias("b")).first()
    assert close["a"] and not close["b"]


# ---------------------------------------------------------------- cross-posts

NESTED = "array<struct<subreddit:string,subreddit_subscribers:bigint,num_crossposts:bigint>>"


@pytest.fixture(scope="module")
def found(spark):
    rows = [("p1", "u1", "A", 10, None, [("B", 7, 2)], 1, 100, "x"), ("p2", "u1", "A", 20, None, [("B", 8, 3)], 0, 90, "y"),
            ("p3", "u2", "A", 30, None, [], 0, 80, "z"), ("p4", "u3", "A", 30, None, None, 2, 70, "w"),
            ("p5", "u3", "u_me", 30, None, [("B", 1, 1)], 0, 60, "z"), ("p6", "u4", "A", 30, None, [("u_you", 1, 1)], 0, 50, "x"),
            ("p7", "u1", "C", 5, "t3_p1", None, 0, 40, None), ("p8", "u3", "D", 6, "t3_p4", None, 0, 30, "q"),
            ("p9", "u3", "E", 6, "t3_p8", None, 0, 20, "q"), ("p0", "u9", "B", 6, None, [("F", 2, 2)], 0, 10, "q")]
    return spark.createDataFrame(rows, "id string, url string, subreddit string, subreddit_subscribers long, "
                                 f"crosspost_parent string, crosspost_parent_list {NESTED}, num_crossposts long, "
                                 "created_utc long, author string").cache()


def test_parents_children_ratio(found):
    up = {(r["subreddit"], r["crosspost_parent"]): tuple(r)[2:] for r in CP.parents(found).collect()}
    assert up == {("A", "B"): (15.0, 7, 2, 5, 2), ("B", "F"): (6.0, 2, 1, 2, 1)}
    down = {(r["subreddit"], r["crosspost_parent"]): tuple(r)[2:] for r in CP.children(found, found).collect()}
    assert down == {("C", "A"): (5.0, 10, 1, 1, 2), ("D", "A"): (6.0, 30, 1, 2, 2)}
    row = CP.ratio(found).where("subreddit = 'A'").first()
    assert (row["crosspost_parent"], row["crosspost_child"], row["total"]) == (0, 2, 5)


def test_landed_posts_are_not_shuffled(spark, found):
    landed = CP.land_by_url(found, 4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = CP.lookup_urls(landed, CP.crossposted_urls(found))._jdf.queryExecution().executedPlan().toString()
        join = plan[plan.index("SortMergeJoin"):]
        posts_side = join[:join.index("Scan parquet")]       # the first child, down to its scan
        assert "Exchange" not in posts_side and "Exchange" in join
        rows = lambda df: sorted(map(tuple, df.collect()))
        assert rows(CP.children(found, landed)) == rows(CP.children(found, found))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_expand(spark, found):
    seeds = spark.createDataFrame([("A",)], "subreddit string")
    one = CP.expand(found, seeds, 0, 1000, depth=2)
    assert {r["subreddit"] for r in one.communities.collect()} == {"A", "B", "C", "D"}
    two = CP.expand(found, seeds, 0, 1000, depth=3)
    assert {r["subreddit"] for r in two.communities.collect()} == {"A", "B", "C", "D", "F"}
    assert {(r["subreddit"], r["crosspost_parent"], r["round"]) for r in two.edges.collect()} == {
        ("A", "B", 1), ("C", "A", 1), ("D", "A", 1), ("B", "F", 2)}
    pages = CP.scan_windows(found, seeds, 0, 1000, limit=2, repeat=50)
    whole = CP.scan_windows(found, seeds, 0, 1000)
    assert sorted(r["id"] for r in pages.collect()) == sorted(r["id"] for r in whole.collect())
    latest = P.latest_per_community(found, 0, 95, 2).where("subreddit = 'A'")
    assert sorted(r["id"] for r in latest.collect()) == ["p2", "p3"]


# ---------------------------------------------------------------- sources

def test_text_sources(spark, tmp_path):
    text = spark.createDataFrame([("a|b", 'say "x"\nline', 1), ("c", None, 2)], "id string, text string, label int")
    TB.write_separated(text, f"{tmp_path}/pipe")
    back = TB.read_separated(spark, f"{tmp_path}/pipe", text.schema)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, text.collect()), key=str)
    (tmp_path / "names.csv").write_text("news\nart,music\n\n")
    names = TB.read_names(spark, f"{tmp_path}/names.csv")
    assert sorted(r[0] for r in names.collect()) == ["art", "music", "news"]
    TB.write_names(names.union(names), f"{tmp_path}/names")
    assert TB.read_names(spark, f"{tmp_path}/names").count() == 3


def test_edge_source(spark, tmp_path):
    (tmp_path / "e.tsv").write_text("src\ttrg\tw\na\tb\t2\nb\ta\t3\na\ta\t1\na\tc\t0\n")
    edges, size = TB.read_edges(spark, f"{tmp_path}/e.tsv", "w")
    assert edges.count() == 3 and tuple(size.first()) == (2, 3.0)
    assert TB.write_edges(edges, f"{tmp_path}/out")
    assert TB.read_edges(spark, f"{tmp_path}/out", "nij")[0].count() == 3
    assert not TB.write_edges(edges.limit(0), f"{tmp_path}/none") and not (tmp_path / "none").exists()
    with pytest.raises(ValueError):
        TB.write_edges(edges.select("src"), f"{tmp_path}/none")


def test_flat_numbers_and_lines(spark, tmp_path):
    values = [i / 7 for i in range(500)]
    (tmp_path / "flat.txt").write_text(" ".join(map(str, values)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")  # the one line is split over tasks
    try:
        got = TB.read_flat_numbers(spark, f"{tmp_path}/flat.txt").orderBy("pos").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r["value"] for r in got] == values and [r["pos"] for r in got] == list(range(500))
    vocab = spark.createDataFrame([(i, f"w{i}") for i in range(50)], "term_id int, term string")
    TB.write_lines(vocab, f"{tmp_path}/vocab", "term", "term_id")
    read = TB.read_lines(spark, f"{tmp_path}/vocab", "term").collect()
    assert {(r["term_id"], r["term"]) for r in read} == {(i, f"w{i}") for i in range(50)}


def test_topic_json(spark, tmp_path):
    model = {"phi": [[0.5, 0.5], [0.1, 0.9]], "theta": [[0.2, 0.8]], "doc.length": [4],
             "vocab": ["x", "y"], "term.frequency": [3, 1]}
    (tmp_path / "m.json").write_text(json.dumps(model))
    tables = TB.read_topic_json(spark, f"{tmp_path}/m.json")
    assert {tuple(r) for r in tables["topic_term"].collect()} == {(0, 0, 0.5), (0, 1, 0.5), (1, 0, 0.1), (1, 1, 0.9)}
    assert {tuple(r) for r in tables["vocabulary"].collect()} == {(0, "x", 3), (1, "y", 1)}
    assert tables["doc_length"].first()["length"] == 4 and tables["doc_topic"].count() == 2


def test_partitioned_posts(spark, posts, tmp_path):
    P.write_partitioned(posts, f"{tmp_path}/posts", files_per_key=2)
    back = P.scan_posts(spark, f"{tmp_path}/posts")
    one = P.slice_scan(back, "a", 0, 86400, ["author", "created_utc"])
    assert one.count() == 2
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(subreddit" in plan
    assert "GreaterThanOrEqual(created_utc,0)" in plan and "class_II" not in plan


# ---------------------------------------------------------------- scoring and topics

def test_scoring(spark):
    def load():
        return lambda texts: [[0.2, 0.2, 0.6] if "x" in (t or "") else [0.5, 0.3, 0.2] for t in texts]
    df = spark.createDataFrame([(1, "x y"), (2, "z"), (3, None)], "id int, text string")
    out = M.top_label(M.stage_two(M.score_batches(df, "text", load, 3, batch_size=2)), 3)
    got = {r["id"]: (r["class_II"], r["conf_II"], r["pred_1"], r["conf_1"]) for r in out.collect()}
    assert got == {1: (2, 0.6, 2, 0.6), 2: (0, 0.5, 0, 0.5), 3: (0, 0.5, 0, 0.5)}


def test_topics(spark):
    docs = [(i, "s" + str(i % 2), "cat dog cat" if i % 2 else "sun moon sun the") for i in range(20)] + [(99, "s0", "")]
    words = TP.tokens(spark.createDataFrame(docs, "id int, subreddit string, text string"), "text", ["the"])
    vocab = TP.vocabulary(words, 10, 3.0, 1.0)
    assert [tuple(r) for r in vocab.orderBy("term_id").collect()] == [
        (0, "cat", 20, 10), (1, "sun", 20, 10), (2, "dog", 10, 10), (3, "moon", 10, 10)]
    vectors = TP.vectorizer(vocab).transform(words).cache()
    model = TP.fit(vectors, 2, 5, subsampling_rate=0.9)
    weights = TP.doc_topic(model, vectors, ["id", "subreddit"])
    assert TP.valid_documents(weights, 2).count() == 20
    assert TP.mix_by(TP.valid_documents(weights, 2), 2, members=["s0"]).count() == 1
    assert TP.describe(model, vocab, 2).count() == 4
    assert TP.wide_topic_term(TP.topic_term(model, vocab), 2).count() == 4
    tables = TP.browser_tables(model, vectors, vocab)
    assert tables["doc_length"].count() == 20 and tables["vocabulary"].agg(F.sum("tf")).first()[0] == 60
    assert TP.sweep(vectors, [2, 3], 2).count() == 2


def test_sweep_infers_the_documents_once_per_model(spark, monkeypatch):
    docs = [(i, "cat dog cat bird" if i % 2 else "sun moon sun") for i in range(30)] + [(99, "")]
    words = TP.tokens(spark.createDataFrame(docs, "id int, text string"), "text", [])
    vectors = TP.vectorizer(TP.vocabulary(words, 10, 1.0, 1.0)).transform(words).cache()
    models = [TP.fit(vectors, k, 3) for k in (2, 3)]
    told = [(k, m.logLikelihood(vectors), m.logPerplexity(vectors)) for k, m in zip((2, 3), models)]

    def twice(*_):
        raise AssertionError("a second inference over all documents")

    monkeypatch.setattr(LDAModel, "logPerplexity", twice)
    for row, (k, bound, perplexity) in zip(TP.sweep(vectors, [2, 3], 3).orderBy("k").collect(), told):
        assert row["k"] == k and abs(row["log_likelihood"] / bound - 1) < 1e-9
        assert abs(row["log_perplexity"] / perplexity - 1) < 1e-9


def test_sweep_runs_all_models_in_the_same_passes(spark, monkeypatch):
    """As many passes for three models as for one, with the bounds of Spark's own models."""
    rng = random.Random(5)
    docs = [(i, " ".join(f"w{int(rng.random() ** 2 * 40) + 20 * (i % 3)}" for _ in range(rng.randrange(0, 60)))) for i in range(400)]
    words = TP.tokens(spark.createDataFrame(docs, "id int, text string").repartition(3), "text", [], letters=False)
    vectors = TP.vectorizer(TP.vocabulary(words, 100, 1.0, 1.0)).transform(words).cache()
    told = {k: TP.fit(vectors, k, 4).logLikelihood(vectors) for k in (2, 3, 7)}
    passes = []
    monkeypatch.setattr(variational, "_folded", lambda *a, run=variational._folded: passes.append(1) or run(*a))
    found = TP.sweep(vectors, [7, 2, 3], 4).collect()
    assert [r["k"] for r in found] == [7, 2, 3] and len(passes) == 4 + 1
    for r in found:
        assert abs(r["log_likelihood"] / told[r["k"]] - 1) < 1e-7
        tokens = sum(len(t.split()) for _, t in docs)
        assert abs(r["log_perplexity"] * tokens / -told[r["k"]] - 1) < 1e-7
    with pytest.raises(ValueError):
        TP.sweep(vectors.limit(0), [2], 1)
    assert TP.sweep(vectors, [], 1).count() == 0


def test_special_functions_of_the_sweep():
    x = np.array([0.01, 0.09, 0.5, 1.0, 2.5, 40.0, 3e4])
    assert np.allclose(variational.lgamma(x), [math.lgamma(v) for v in x], rtol=1e-10, atol=1e-10)
    assert np.allclose(variational.digamma(x + 1) - variational.digamma(x), 1 / x, rtol=1e-8, atol=1e-10)
    assert np.allclose(variational.trigamma(x) - variational.trigamma(x + 1), 1 / x ** 2, rtol=1e-8, atol=1e-10)
    assert abs(variational.digamma(np.array([1.0]))[0] + 0.5772156649015329) < 1e-10
    assert abs(variational.trigamma(np.array([1.0]))[0] - math.pi ** 2 / 6) < 1e-10
