"""The operators of the corpus pipeline on small cases and against plain versions."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hearsay.llm import chat, html, leaks, mixing, quality, queries, repeats, shards, simhash, toxicity, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, source string, n_chars bigint, size string, score string, leaks string, shard string, kept string"


def docs_of(spark, rows):
    """Rows (doc_id, text, source) with further columns whose names the operators add."""
    return spark.createDataFrame([(i, t, s, len(t or ""), "a", "b", "c", "d", "e") for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Null id, null source, null, empty and blank texts, repeated rows, one very long text."""
    long_text = " ".join(f"w{i % 977}" for i in range(30_000))
    return docs_of(spark, [(1, "one two three", "a"), (1, "one two three", "a"), (2, None, "a"), (3, "", None),
                           (4, " \n\t ", "b"), (None, "four five", None), (5, long_text, "b"), (6, "x", "c")])


@pytest.fixture(scope="module")
def none(spark):
    return docs_of(spark, [])


def wordy(seed, n, size, words):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(size))), "s") for i in range(n)]


# ------------------------------------------------------------------ quality

def test_quality_counts(spark, odd, none):
    text = "a b c a b c\n\na b c a b c\n# x"
    rows = {r["doc_id"]: r for r in quality.judge(docs_of(spark, [(9, text, "a")])).collect()}
    assert rows[9]["n_words"] == 14 and rows[9]["n_dup_lines"] == 1 and rows[9]["n_symbols"] == 1
    assert rows[9]["n_repeat_words"] == 12 and rows[9]["word_chars"] == 14 and rows[9]["base_failed"]
    found = quality.judge(odd).collect()
    assert len(found) == 8 and not any(r["kept"] for r in found if r["n_words"] < 50)
    assert quality.judge(none).count() == 0


def test_quality_follows_labels(spark):
    folder = "/root/testdata/sf0.1"
    got = queries.op1_quality_rules(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    by = {(r["quality"], r["kept"]): r["n"] for r in got.where("not base_failed").groupBy("quality", "kept").agg(
        F.count("*").alias("n")).collect()}
    assert by.get((0, True), 0) <= 0.1 * by.get((0, False), 0) and by[1, True] >= 0.98 * (by[1, True] + by.get((1, False), 0))


# ------------------------------------------------------------------ chat

def test_chat_round_trip(spark):
    rng = random.Random(5)
    said = ["", "\\", "</turn>\n", "<turn>", "\\l\\b", "hello there, you", "a" * 3000, "x\ny", None, "é😀 <b>"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "a\nb<"]), " ".join(
        str(rng.choice(said) or "") for _ in range(rng.randrange(40)))) for c in range(12) for t in range(rng.randrange(1, 25))]
    rows += [(99, 0, "user", "same"), (99, 0, "user", "same"), (None, None, "assistant", None)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    made = chat.windows(turns).cache()
    got = {r["conv_id"]: r for r in chat.digests(made).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for conv in {r[0] for r in rows}:
        own = sorted(((t if t is not None else -1, r or "", x or "") for c, t, r, x in rows if c == conv))
        assert got[conv]["n_turns"] == len(own)
        assert got[conv]["turns_sha256"] == sha("".join(f"{r}\n{x}\n" for _, r, x in own))
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), sha(loss))
    within_budget(made)
    assert made.where("n_context > 0").count() > 0 and chat.windows(turns.limit(0)).count() == 0


def within_budget(made, budget=chat.BUDGET):
    """Only a window whose one new turn is too long alone exceeds the budget."""
    for r in made.collect():
        lines = re.findall(re.escape(chat.OPEN) + ".*?" + re.escape(chat.CLOSE), r["text"], re.S)
        sizes = [len(re.findall(chat.TOKEN, x)) for x in lines]
        assert "".join(lines) == r["text"] and len(lines) == r["n_turns"]
        assert sum(sizes) <= budget or (r["n_turns"] == 1 and r["n_context"] == 0 and sizes[0] > budget)


def test_chat_budget(spark):
    short = [(1, t, "assistant" if t % 2 else "user", f"w{t}") for t in range(400)]
    system = [(2, 0, "system", "s " * 380), *[(2, t, "assistant" if t % 2 else "user", "x < y " * (t % 9)) for t in range(1, 90)]]
    huge = [(3, 0, "system", "s " * 700), *[(3, t, "user", "a " * (t * 40 % 600)) for t in range(1, 60)]]
    turns = spark.createDataFrame(short + system + huge, "conv_id bigint, turn bigint, role string, text string")
    made = chat.windows(turns.withColumn("window", F.lit("clash")).withColumn("loss", F.lit(1)))
    within_budget(made)
    within_budget(chat.windows(turns, budget=120, history=30), 120)
    assert made.where("conv_id = 1").count() <= 400 * 10 / (chat.BUDGET - chat.HISTORY) * 2 + 1
    later = made.where("conv_id = 2 AND window > 20")
    assert later.count() and later.where(~F.col("text").startswith(f"{chat.OPEN}system\n")).count() == 0
    assert made.agg(F.sum(F.col("n_turns") - F.col("n_context"))).first()[0] == 400 + 90 + 60


# ------------------------------------------------------------------ simhash

def plain_xxh64(data: bytes, seed: int) -> int:
    """XXH64 by its published description."""
    p1, p2, p3, p4, p5 = (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
    m = (1 << 64) - 1
    rotl = lambda x, r: (x << r | x >> (64 - r)) & m
    step = lambda acc, lane: rotl((acc + lane * p2) & m, 31) * p1 & m
    lanes = lambda a, b: [int.from_bytes(data[k:k + 8], "little") for k in range(a, b, 8)]
    n, at = len(data), 0
    if n >= 32:
        acc = [(seed + p1 + p2) & m, (seed + p2) & m, seed, (seed - p1) & m]
        while at + 32 <= n:
            acc = [step(a, x) for a, x in zip(acc, lanes(at, at + 32))]
            at += 32
        h = sum(rotl(a, r) for a, r in zip(acc, (1, 7, 12, 18))) & m
        for a in acc:
            h = ((h ^ step(0, a)) * p1 + p4) & m
    else:
        h = (seed + p5) & m
    h = (h + n) & m
    while at + 8 <= n:
        h = (rotl(h ^ step(0, lanes(at, at + 8)[0]), 27) * p1 + p4) & m
        at += 8
    if at + 4 <= n:
        h = (rotl(h ^ int.from_bytes(data[at:at + 4], "little") * p1 & m, 23) * p2 + p3) & m
        at += 4
    for byte in data[at:]:
        h = rotl(h ^ byte * p5 & m, 11) * p1 & m
    h = (h ^ h >> 33) * p2 & m
    h = (h ^ h >> 29) * p3 & m
    return h ^ h >> 32


def test_plain_hash(spark):
    texts = ["", "a", "abcd", "abcdefgh", "é" * 7, "x" * 31, "x" * 32, "word " * 9, "0123456789abcdef" * 5 + "xyz"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.xxhash64("t").alias("h")).collect()
    assert all(r["h"] & (1 << 64) - 1 == plain_xxh64(r["t"].encode(), 42) for r in rows)


def plain_fingerprint(text):
    w = WORD.findall((text or "").translate(str.maketrans(simhash.UPPER, simhash.LOWER)))
    grams = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
    hashes = [plain_xxh64(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("tree_size", [4096, 2])
def test_simhash_against_all_pairs(spark, tree_size):
    base = wordy(3, 25, 60, "ab cd ef gh ij kl mn".split())
    rng, rows = random.Random(1), list(base)
    for i, t, s in base:  # near copies: a few words changed
        w = t.split()
        for _ in range(2):
            if w:
                w[rng.randrange(len(w))] = "ZZ"
            rows.append((len(rows), " ".join(w), s))
    rows += [(len(rows), None, "s"), (len(rows) + 1, "", "s"), (0, rows[0][1], "s")]
    marks = [plain_fingerprint(t) for _, t, _ in rows]
    label = [i for i, _, _ in rows]
    for _ in rows:  # plain relaxation until nothing changes
        label = [min(label[k] for k in range(len(rows)) if (marks[k] ^ m).bit_count() <= 2) for m in marks]
    got = simhash.near_duplicates(docs_of(spark, rows), tree_size=tree_size).collect()
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == sorted(
        (i, f"{m:016x}", c) for (i, _, _), m, c in zip(rows, marks, label))
    kept = simhash.keep_one(docs_of(spark, rows), tree_size=tree_size)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(label))


def test_bk_tree_follows_edges():
    rng = random.Random(2)
    tree, values = simhash.BKTree(), [rng.getrandbits(10) for _ in range(300)]
    for v in values:
        tree.add(v)
    for q in range(0, 1024, 37):
        assert sorted(tree.near(q, 2)) == [k for k, v in enumerate(values) if (v ^ q).bit_count() <= 2]


def test_simhash_odd(odd, none):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == 8 and {r["component_id"] for r in rows if r["fingerprint"] == "0" * 16} == {2}
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0
    assert simhash.keep_one(odd).columns == odd.columns


# ------------------------------------------------------------------ shards

def test_shards_move_only_into_new_region(odd, none):
    tree = shards.even_tree(40)
    grown = shards.in_new_region(tree, 40)
    rows = shards.assign(odd, tree, grown).collect()
    assert all(r["grown_shard"] in (r["shard"], 40) for r in rows)
    assert {r["size"] for r in rows if r["doc_id"] == 2} == {16}
    assert shards.assign(none, tree, grown).count() == 0


def test_shards_weights_and_slots(spark):
    ids = spark.range(20_000).withColumnRenamed("id", "doc_id").withColumn("text", F.lit("a"))
    tree = {0: {0: {0: 1.0, 1: 3.0}}, 1: {1: {2: 4.0}}}
    rows = shards.assign(ids, tree).groupBy("shard").agg(
        F.count("*").alias("n"), F.min("slot").alias("a"), F.max("slot").alias("b"),
        F.count_distinct("slot").alias("d")).collect()
    assert all(r["a"] == 0 and r["b"] == r["n"] - 1 and r["d"] == r["n"] for r in rows)
    share = {r["shard"]: r["n"] / 20_000 for r in rows}
    assert abs(share[0] - 0.125) < 0.02 and abs(share[1] - 0.375) < 0.02 and abs(share[2] - 0.5) < 0.02
    heavier = {0: {0: {0: 1.0, 1: 5.0}}, 1: {1: {2: 4.0}}}
    moved = shards.assign(ids, tree, heavier).where("shard <> grown_shard")
    assert {r["grown_shard"] for r in moved.select("grown_shard").distinct().collect()} <= {0, 1}


# ------------------------------------------------------------------ repeats

@pytest.mark.parametrize("group, code_bits", [(20_000, 64), (3, 5), (0, 64)])
def test_repeats_against_all_windows(spark, group, code_bits):
    rng = random.Random(7)
    rows = wordy(7, 40, 80, "a b c d e f g h i j k l m n o p q r s t".split())
    passage = [f"p{i}" for i in range(40)]
    for k in range(30):
        at = rng.randrange(20)
        w = (rows[k][1].split() + passage[at:at + rng.randrange(5, 30)] + rows[-k][1].split())
        rows.append((len(rows), "\t".join(w), "s"))
    rows += [(len(rows) + k, rows[3][1], "s") for k in range(3)] + [(500, None, "s"), (501, "a a a " * 300, "s"), (502, "a a a " * 300, "s")]
    first = {}
    for i, t, _ in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - 12):
            key = tuple(w[k:k + 13])
            first[key] = min(first.get(key, i), i)
    want = {}
    for i, t, _ in rows:
        w = WORD.findall(t or "")
        gone = {k + j for k in range(len(w) - 12) if first[tuple(w[k:k + 13])] < i for j in range(13)}
        want[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    got = repeats.without_repeats(docs_of(spark, rows), group=group, code_bits=code_bits).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in got} == want


def test_repeats_many_rows_without_id(spark):
    """Rows of one id are told apart: clean rows lose nothing, repeating ones their copies of id 1."""
    passage = " ".join(f"p{k}" for k in range(20))
    rows = spark.range(16_000).select(
        F.lit(None).cast("bigint").alias("doc_id"),
        F.when(F.col("id") % 2 == 0, F.concat(F.lit("c"), F.col("id").cast("string"))).otherwise(
            F.concat(F.col("id").cast("string"), F.lit(" " + passage))).alias("text"))
    first = spark.createDataFrame([(1, passage)], rows.schema)
    got = repeats.without_repeats(rows.union(first)).groupBy("n_words", "n_removed").count().collect()
    assert sorted(map(tuple, got)) == [(1, 0, 8000), (20, 0, 1), (21, 20, 8000)]


def test_repeats_tree_nodes():
    rng = random.Random(5)
    suffixes = sorted([rng.choice("ab") for _ in range(rng.randrange(1, 7))] for _ in range(60))
    found = {(w, a, b) for w, a, b in repeats.deep_nodes(suffixes, 2)}
    want = set()
    for a in range(60):
        for b in range(a + 2, 61):
            w = min(repeats.common_words(x, y) for x, y in zip(suffixes[a:b], suffixes[a + 1:b]))
            left = repeats.common_words(suffixes[a - 1], suffixes[a]) if a else -1
            right = repeats.common_words(suffixes[b - 1], suffixes[b]) if b < 60 else -1
            if w >= 2 and left < w and right < w:
                want.add((w, a, b))
    assert found == want


def test_repeats_word_hashes():
    hashes = repeats.WordHashes()
    texts = ["é b\t\tc é", "", " \n", "b", "x" * 70_000 + " b"]
    h, starts = hashes.of(np.frombuffer(" ".join(texts).encode(), dtype=np.uint8))
    words = WORD.findall(" ".join(texts))
    assert len(h) == len(words) and len(set(h.tolist())) == len(set(words))
    assert all((h[i] == h[j]) == (words[i] == words[j]) for i in range(len(words)) for j in range(len(words)))


def test_repeats_odd(odd, none):
    rows = repeats.without_repeats(odd).collect()
    assert len(rows) == 8 and all(r["n_removed"] == 0 for r in rows) and repeats.without_repeats(none).count() == 0


# ------------------------------------------------------------------ toxicity

def test_toxicity_gradients():
    net = toxicity.Network(3)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    rng = np.random.default_rng(0)
    x, rows, y = rng.standard_normal((7, toxicity.INPUT)), np.array([[0, 1, 2, 3], [4, 5, -1, -1]]), np.array([1.0, 0.0])
    loss = lambda: float(np.mean(np.logaddexp(0, net.forward(x, rows)) - y * net.forward(x, rows)))
    grad, dx, _ = net.gradients(x, rows, y)
    for name, at in (("Uf", (1, 30)), ("Wb", (2, 5)), ("cf", (13,)), ("look", (3,)), ("out", (20,)), ("bias", (0,))):
        keep, net.p[name][at] = net.p[name][at], net.p[name][at] + 1e-4
        up = loss()
        net.p[name][at] = keep - 1e-4
        down = loss()
        net.p[name][at] = keep
        assert grad[name][at] == pytest.approx((up - down) / 2e-4, rel=2e-2, abs=1e-5)


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.1"
    got = queries.op6_toxicity(spark, folder).where("held_out").join(
        spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").select("score", "predicted", "toxic").toPandas()
    rank = got.score.rank().to_numpy()
    pos = (got.toxic == 1).to_numpy()
    auc = (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())
    assert auc > 0.93 and (got.predicted[~pos] == 1).mean() < 0.03 and (got.predicted[pos] == 1).mean() > 0.8


def test_toxicity_scores_against_plain_windows():
    rng = random.Random(4)
    pool = ["".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 9))) for _ in range(400)] + ["x" * 300, "é" * 90]
    net = toxicity.fit([" ".join(rng.choice(pool) for _ in range(60)) for _ in range(8)], [0, 1] * 4, epochs=1)
    texts = [" ".join(rng.choice(pool) for _ in range(n)) for n in (0, 1, 2, 47, 48, 49, 96, 1000, 47, 3000)] + [None, "?!"]
    texts += texts[:6]
    plain = []
    for t in texts:
        words = re.findall(r"\w+", (t or "").lower())
        starts = [0] if len(words) <= 48 else [*range(0, len(words) - 48, 24), len(words) - 48]
        odds = [0.0]
        for a in starts if words else []:
            w = words[a:a + 48]
            own = [toxicity.word_features([x]) for x in w]
            x = np.stack([net.p["words"][f.words[0]] + net.p["grams"][f.grams].mean(axis=0) for f in own])
            odds.append(1 / (1 + math.exp(-float(net.forward(x, np.arange(len(w))[None, :])[0]))))
        plain.append(max(odds))
    assert np.allclose(toxicity.Scorer(net).score(texts), plain, atol=1e-5)


def test_toxicity_word_features():
    words = ["a", "ab", "x" * 50, "é😀z"]
    table = toxicity.word_features(words)
    assert table.sizes.tolist() == [sum(max(len(w) + 2 - n + 1, 0) for n in toxicity.GRAMS) for w in words]
    one = toxicity.word_features(["x" * 50])
    some = table.take(np.array([2, 0]))
    assert some.words[0] == one.words[0] and (some.grams[:some.sizes[0]] == one.grams).all()
    middle = toxicity.word_features(["x" * 25 + "qqq" + "x" * 25, "x" * 25 + "rrr" + "x" * 25])
    assert (middle.grams[:middle.sizes[0]] != middle.grams[middle.sizes[0]:]).any()     # inner n-grams of long words count


def test_toxicity_training_sample(spark):
    docs = spark.createDataFrame([(i, f"doc {i} " + "w " * (i % 7) * 400) for i in range(60)] + [(None, "null"), (3, "other text")],
                                 "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(80)] + [(3, 0, 1), (None, 0, 1)], "doc_id bigint, quality int, toxic int")
    rows = toxicity.training_rows(docs, labels, rows=10, windows=5)
    assert [r["toxic"] for r in rows] == [0] * 10 + [1] * 10 and max(len(r["windows"]) for r in rows) == 5
    assert toxicity.training_rows(docs.limit(0), labels) == [] and toxicity.training_rows(docs, labels.limit(0)) == []


def test_toxicity_odd(odd, none):
    assert toxicity.fit(["a"], [1]) is None
    net = toxicity.fit(["bad words here", "good words here"] * 4, [1, 0] * 4, epochs=1)
    rows = toxicity.with_scores(odd, net).collect()
    assert len(rows) == 8 and all(r["score"] == 0 for r in rows if not (r["text"] or "").strip())
    assert toxicity.with_scores(none, net).count() == 0
    assert toxicity.with_scores(odd, None).where("predicted = 1").count() == 0
    assert all(a[1] > b[0] for n in (49, 100, 1001) for a, b in zip(toxicity.cut_windows(n), toxicity.cut_windows(n)[1:]))


# ------------------------------------------------------------------ leaks

def plain_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_leaks_against_plain_distance(spark, odd, none):
    rng = random.Random(11)
    pool = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(pool) for _ in range(rng.randrange(8, 50)))) for i in range(30)]
    items += [(90, None), (91, ""), (92, items[0][1])]
    rows = []
    for k in range(120):
        w = rng.choice(items[:30])[1].split()
        for _ in range(rng.randrange(0, max(1, int(0.3 * len(w))))):
            at, kind = rng.randrange(len(w)), rng.randrange(3)
            w[at:at + 1] = [[], [rng.choice(pool)], [w[at], rng.choice(pool)]][kind]
        pad = lambda: [rng.choice(pool) for _ in range(rng.randrange(30))]
        rows.append((k, " ".join(pad() + w + pad()), "s"))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in leaks.leaked_items(docs_of(spark, rows), bench).collect()}
    small = {(r["doc_id"], r["item_id"]) for r in leaks.leaked_items(docs_of(spark, rows), bench, block_words=100).collect()}
    want = {}
    for i, t, _ in rows:
        for n, x in items:
            w = leaks.words_of(x)
            if w and (d := plain_distance(w, leaks.words_of(t))) <= int(0.2 * len(w) + 1e-9):
                want[i, n] = d
    assert set(got) <= set(want) and small <= set(want)
    assert len(got) >= 0.97 * len(want) and len(small) >= 0.97 * len(want)
    assert all((i, n) in got for (i, n), d in want.items() if d == 0)
    assert leaks.leaked_items(odd, bench).count() == 0 and leaks.leaked_items(none, bench).count() == 0
    assert leaks.without_leaks(odd, bench.limit(0)).count() == 8 and leaks.without_leaks(odd, bench).columns == odd.columns


def test_leaks_without_the_run_filter():
    rng = random.Random(3)
    pool = [f"w{i}" for i in range(120)]
    items = [(i, [rng.choice(pool) for _ in range(rng.randrange(6, 30))]) for i in range(25)]
    block = leaks.ItemBlock(items)
    filtered, every = [], []
    for _ in range(60):
        w = list(rng.choice(items)[1])
        for _ in range(rng.randrange(0, max(1, len(w) // 4))):
            w[rng.randrange(len(w))] = rng.choice(pool)
        text = " ".join([rng.choice(pool) for _ in range(rng.randrange(20))] + w + [rng.choice(pool) for _ in range(rng.randrange(20))])
        filtered.append([(i, d) for i, d, _ in block.find(text)])
        every.append([(i, d) for i, d, _ in block.find(text, prefilter=False)])
    assert filtered == every and sum(map(len, every)) > 30


def test_leaks_walks_stop_at_the_last_sampled_step(monkeypatch):
    item, most, mixed, calls = [f"w{k}" for k in range(40)], 2 ** 64 - 1, leaks._mixed, []
    block = leaks.ItemBlock([(1, item)])

    def mix(x):
        x = (x ^ x >> 31) * 0x9E3779B97F4A7C15 & most
        return x ^ x >> 29

    def walk(number):
        at, out = 0, []
        for step in range(60):
            out.append(at if at < 40 else -1)  # words of the item are numbered in order
            seed = (number * 1_000_003 + step) * 2 + 1
            at = min(40, at + (mix(mix(out[-1] + seed & most) * seed & most) >> 63))
        return out

    for table in range(block.n_tables):
        chosen = sorted(np.random.default_rng([40, table]).choice(60, size=2, replace=False))
        key = np.array([walk(table % leaks.WALKS)[c] for c in chosen], dtype=np.int64).tobytes()
        assert block.tables[40, table, key] == [0]
    monkeypatch.setattr(leaks, "_mixed", lambda x: calls.append(x.shape) or mixed(x))
    assert block.find(" ".join(["x y", *item[:20], "z", *item[20:], "x"])) == [(1, 1, 3)]
    assert 0 < len(calls) <= 2 * 60  # twice a step, for all walks at once


def test_leaks_one_block_at_a_time(spark, odd):
    items = [(i, " ".join(f"i{i}w{k}" for k in range(12))) for i in range(9)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    rows = docs_of(spark, [(k, f"x y {items[k % 9][1]} z {items[(k + 3) % 9][1]}", "s") for k in range(20)] * 2 + [(99, None, "s"), (None, "", "s")])
    one, many = (leaks.with_leaks(rows, bench, block_words=n) for n in (10_000, 24))
    key = lambda df: sorted((str(r["doc_id"]), [tuple(x) for x in sorted(r["leaks"])]) for r in df.collect())
    assert key(one) == key(many) and one.columns == many.columns and sum(len(x) for _, x in key(one)) == 80
    assert leaks.without_leaks(odd, bench, block_words=24).count() == 8


# ------------------------------------------------------------------ urls

def test_urls(spark):
    cases = {
        "https://A.Example.NET/en/1?x#y": ("a.example.net", "/en/1", "example.net/en/", "allow"),
        "http://x.net/": ("x.net", "/", "net/", "block"), "http://x.net": ("x.net", "", None, "allow"),
        "http://notexample.com/de/": ("notexample.com", "/de/", None, "allow"),
        "http://spam-farm.example.org/fr/2": ("spam-farm.example.org", "/fr/2", "org/fr/", "allow"),
        "http://spam-farm.example.org/en/2": ("spam-farm.example.org", "/en/2", None, "block"),
        "http://10.0.0.1/a": ("10.0.0.1", "/a", None, "block"), "nothing": ("", "", None, "allow"),
        "http://spamfarm.example.org/": ("spamfarm.example.org", "/", None, "allow"), "": ("", "", None, "allow")}
    pages = spark.createDataFrame([(k, u, "old") for k, u in enumerate([*cases, None])], "page_id bigint, url string, host string")
    rows = urls.judge(pages).orderBy("page_id").collect()
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in rows] == [*cases.values(), ("", "", None, "allow")]
    assert urls.rule_index(urls.PATTERN_RULES, {"free": 9, "bets": 2})["bets"] == [1]
    assert urls.judge(pages.limit(0)).count() == 0


def test_url_literals_follow_from_the_expression():
    tokens = urls.literal_tokens
    assert {r.name: r.literals for r in urls.PATTERN_RULES} == {
        "casino": ("casino",), "bets": ("free", "bets"), "pills": ("cheap", "pills"), "spam_farm": ("spam", "farm"),
        "ad_tracking": ("ads", "track"), "poker": ("poker",), "replica": ("replica",), "loans": ("payday",),
        "cracks": ("download",), "click_id": ("redirect",), "numeric_host": ()}
    assert tokens("abc") == () and tokens("/abc/") == ("abc",) and tokens("/abc") == () and tokens("^abc/") == ("abc",)
    assert tokens("/ab?c/x/") == ("x",) and tokens("/(ab|cd)/e/") == ("e",) and tokens("/a[bc]/d$") == ("d",)
    assert tokens(r"/a\wb/") == () and tokens(r"/ab(-cd-)/") == ("ab", "cd") and tokens("(?i)/abc/") == ()
    assert tokens("/[^a]abc/") == () and tokens("/(x/)*abc/") == ("abc",) and tokens("(x/)*abc/") == () and tokens("(x/)+abc/") == ("abc",)


def test_many_url_rules_against_running_all(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randrange(1, 4)))
    forms = [lambda: f"||{word()}.{word()}^", lambda: f"/{word()}-{word()}/", lambda: f"*{word()}*{word()}^", lambda: f"|http://{word()}.{word()}/{word()}",
             lambda: f"^{word()}^{word()}|", lambda: f"/[/.]{word()}[0-9]+[/.]/", lambda: f"{word()}={word()}&"]
    lines = [rng.choice(forms)() for _ in range(10_000)] + ["! comment", "", None]
    rules = urls.parse_rules(spark.createDataFrame([(x,) for x in lines], "rule string"))
    assert len(rules) == 10_000 and sum(bool(r.literals) for r in rules) > 3_000
    pages = [f"http{rng.choice(['', 's'])}://{word()}.{word()}.{word()}/{word()}-{word()}/{word()}{rng.randrange(20)}?{word()}={word()}&{word()}".upper()
             if rng.random() < 0.1 else f"http://{word()}.{word()}/{word()}/{word()}" for _ in range(150)] + [None, "", "x"]
    table = spark.createDataFrame(list(enumerate(pages)), "page_id bigint, url string")
    got = {r["page_id"]: r["pattern"] for r in urls.judge(table, (), rules).collect()}
    compiled = [(r.name, re.compile(r.pattern)) for r in rules]
    for k, url in enumerate(pages):
        want = None if url is None else next((n for n, p in compiled if p.search(url.lower())), None)
        assert got[k] == want
    assert urls.judge(table, (), rules).where("url = ''").first()["verdict"] in ("allow", "block")


# ------------------------------------------------------------------ mixing

def test_mixing_exact_budget(spark, odd, none):
    rows = [(i, "w " * (i % 40), f"s{i % 7 if i % 3 else 0}") for i in range(700)]
    got = mixing.mix(docs_of(spark, rows)).select("source", "size", "source_size", "target", "taken").toPandas()
    by = got.groupby("source").agg(size=("size", "sum"), told=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (by["size"] == by.told).all() and (abs(by.target - by.taken) <= 1).all()
    assert by.target.sum() == pytest.approx(got["size"].sum()) and (got.taken <= 3 * got["size"]).all()
    assert (by.target <= 3 * by["size"] + 1e-6).all()
    again = mixing.mix(docs_of(spark, rows[::-1])).select("taken").toPandas()
    assert sorted(again.taken) == sorted(got.taken)
    words = {r["source"]: r["n"] for r in mixing.mixed_documents(docs_of(spark, rows)).groupBy("source").agg(
        F.sum(F.size(F.array_remove(F.split("text", " "), ""))).alias("n")).collect()}
    assert words == {s: t for s, t in by.taken.items() if t}
    assert mixing.mix(odd).count() == 8 and mixing.mix(none).count() == 0
    assert mixing.mixed_documents(odd).columns == odd.columns


# ------------------------------------------------------------------ html

def test_html_blocks():
    page = ('<title>t</title><nav><a href=x>Menu</a></nav><article class="post"><h1>A &amp; B</h1><p>one\n two<p>three '
            '<b>four<br>five</p><script>var a = "</p>"</script><ul><li>x<li>y</ul><!-- no --></article>')
    blocks = html.leaf_blocks(page)
    assert [b.text for b in blocks] == ["Menu", "A & B", "one two", "three four five", "x", "y"]
    assert blocks[0].linked == 4 and blocks[2].tags == ["article", "p"]
    assert html.leaf_blocks(None) == [] and html.leaf_blocks("<p") == html.leaf_blocks("<p")


@pytest.mark.parametrize("piece, times", [
    ("<div><p>", 125_000), ("<a ", 333_000), ('<a "', 250_000), ("<a '\"", 200_000), ("<b><h1>x</h1>", 77_000), ("<b>", 333_000),
    ("</i>", 250_000), ("<div class=a b c>y", 60_000), ("<", 1_000_000), ("<!", 500_000), ("<title>x", 125_000), ("<aaaa", 200_000),
    ("<ul><li>", 125_000), ("<table><tr><td>", 66_000)])
def test_html_long_broken_pages(piece, times):
    import time

    field = html.Field().fit([[["bias"], ["in:p"]]], [[0, 1]], epochs=1)
    for tail in ("", " end</p>", '"', ">"):
        begin = time.process_time()
        html.main_text(field, piece * times + tail)
        assert time.process_time() - begin < 5


def test_html_deep_unclosed_names():
    page = "".join(f"<div class='n{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}x c{chr(97 + k // 676 % 26)}'>t{k}" for k in range(20_000))
    blocks = html.leaf_blocks(page, {"in:div", "name:ax"})
    assert len(blocks) == 20_000 and len(blocks[-1].element.has) == 1 and len(blocks[-1].tags) == 20_000


def test_html_field_is_exact():
    field = html.Field().fit([[["a"], ["b"]], [["b"], ["a"], ["a"]]], [[1, 0], [0, 1, 1]], epochs=3)
    rng = np.random.default_rng(1)
    field.move, field.first, field.last = rng.standard_normal((2, 2)), rng.standard_normal(2), rng.standard_normal(2)
    page = [["a"], ["b"], ["zz"], ["a"], ["b"]]
    s = field.scores(page)
    path = lambda y: field.first[y[0]] + field.last[y[-1]] + sum(s[i][v] for i, v in enumerate(y)) + sum(
        field.move[a][b] for a, b in zip(y, y[1:]))
    every = [[k >> i & 1 for i in range(5)] for k in range(32)]
    assert field.decode(page) == max(every, key=path)
    share, _ = field._expect(s)
    total = sum(math.exp(path(y)) for y in every)
    assert share[2][1] == pytest.approx(sum(math.exp(path(y)) for y in every if y[2]) / total)


def test_html_held_out_layouts(spark):
    folder = "/root/testdata/sf0.01"
    lines = html.sample_lines(spark.read.parquet(f"{folder}/pages.parquet"))
    field = html.Field().fit(*html.labelled_pages(lines))
    pages, labels = html.labelled_pages(lines, 120, seed=999)
    right = [a == b for p, y in zip(pages, labels) for a, b in zip(field.decode(p), y)]
    assert sum(right) / len(right) > 0.93


def test_html_query(spark, data_dir):
    import html as std

    raw = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{data_dir}/pages.parquet").collect()}
    for r in queries.op10_html_extraction(spark, data_dir).collect():
        body = re.search(r"<article>(.*?)(</article>|<footer>|$)", raw[r["page_id"]], re.S)[1]
        parts = [" ".join(std.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1|div)\b[^>]*>", body)]
        assert r["text"] == "\n".join(x for x in parts if x) and r["n_chars"] == len(r["text"])
    few = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (2, "", "x")], "page_id bigint, html string, text string")
    assert [r["text"] for r in html.extract(few).collect()] == ["", "", ""] and html.extract(few.limit(0)).count() == 0


# ------------------------------------------------------------------ pipeline

def test_pipeline_against_plain_version(spark, data_dir):
    table = lambda n: [r.asDict() for r in spark.read.parquet(f"{data_dir}/{n}.parquet").collect()]
    docs, bench = table("documents"), table("benchmark")
    net = toxicity.train(spark.read.parquet(f"{data_dir}/documents.parquet"), spark.read.parquet(f"{data_dir}/labels.parquet"))
    score = toxicity.Scorer(net).score([d["text"] for d in docs])
    docs = [d for d, s in zip(docs, score) if s < toxicity.THRESHOLD]
    marks = [plain_fingerprint(d["text"]) for d in docs]
    label = [d["doc_id"] for d in docs]
    while True:
        new = [min(l for l, k in zip(label, marks) if (k ^ m).bit_count() <= 2) for m in marks]
        if new == label:
            break
        label = new
    docs = [d for d, l in zip(docs, label) if d["doc_id"] == l]
    items = [leaks.words_of(b["text"]) for b in bench]

    def leaked(d):
        w = leaks.words_of(d["text"])
        grams = {tuple(w[i:i + 3]) for i in range(len(w) - 2)}
        return any(plain_distance(x, w) <= int(0.2 * len(x) + 1e-9) for x in items
                   if sum(tuple(x[i:i + 3]) in grams for i in range(len(x) - 2)) >= 1)

    docs = [d for d in docs if not leaked(d)]
    md5 = lambda s: hashlib.md5(str(s).encode()).hexdigest()
    taken, names = [], sorted({d["source"] for d in docs})
    size = lambda d: len(WORD.findall(d["text"]))
    totals = [sum(size(d) for d in docs if d["source"] == n) for n in names]
    weight, free, left, goal = [(5, 2, 1)[k % 3] for k in range(len(names))], set(range(len(names))), sum(totals), {}
    while True:
        level = left / sum(weight[k] for k in free)
        full = {k for k in free if level * weight[k] > 3 * totals[k]}
        if not full:
            break
        goal |= {k: 3 * totals[k] for k in full}
        left, free = left - sum(3 * totals[k] for k in full), free - full
    goal |= {k: level * weight[k] for k in free}
    for k, n in enumerate(names):
        budget, before = round(goal[k]), 0
        for d in sorted((d for d in docs if d["source"] == n), key=lambda d: (md5(d["doc_id"]), d["doc_id"])):
            part = max(0, min(size(d), budget % totals[k] - before))
            before += size(d)
            taken += [d["text"]] * (budget // totals[k])
            taken += [d["text"] if part == size(d) else " ".join(WORD.findall(d["text"])[:part])] if part else []
    got = corpus_pipeline.run(spark, data_dir).collect()
    assert sorted(zlib.crc32(t.encode()) for t in taken) == sorted(r["text_crc32"] for r in got)
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


def test_stages_keep_columns(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, data_dir).columns == docs.columns
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), data_dir).count() == 0


@pytest.mark.parametrize("name", ["op1_quality_rules", "op2_chat_windows", "op4_hash_tree_shards", "op9_source_mix"])
def test_native_queries_run_no_python(spark, data_dir, name):
    plan = queries.queries()[name](spark, data_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|InArrow|CartesianProduct|NestedLoop", plan)
