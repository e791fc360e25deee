"""Language identification, fill-in-the-middle and conversation repair against plain versions."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearsay.llm import dialogues, fim, langid, queries

SHA = lambda s: hashlib.sha256(s.encode()).hexdigest()


# ------------------------------------------------------------------ language models

def plain_normal(text):
    return " ".join(re.findall(r"[^\W\d_]+", (text or "").lower()))


def plain_model(texts, order=langid.ORDER):
    """Kneser-Ney by dictionaries: counts by order and the probability of a character."""
    counts = {order: Counter()}
    for t in texts:
        s = " " * (order - 1) + t + " "
        counts[order].update(s[i:i + order] for i in range(len(s) - order + 1))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    discount = {}
    for k, c in counts.items():
        one, two = (sum(v == x for v in c.values()) for x in (1, 2))
        discount[k] = min(max(one / (one + 2 * two), 0.1), 0.9) if one else 0.5
    return counts, discount


def plain_probability(model, alphabet, gram):
    counts, discount = model
    k = len(gram)
    if k == 0:
        return 1 / alphabet
    own = {g: c for g, c in counts[k].items() if g[:-1] == gram[:-1]}
    lower = plain_probability(model, alphabet, gram[1:])
    if not own:
        return lower
    total = sum(own.values())
    return max(own.get(gram, 0) - discount[k], 0) / total + discount[k] * len(own) / total * lower


@pytest.fixture(scope="module")
def tongues(spark):
    rng = random.Random(4)
    parts = {"aa": "ka to mi ra lo".split(), "bb": "sch ung ein er ü".split(), "cc": "é aux que le ou".split()}
    rows = [(i, " ".join("".join(rng.choice(parts[n]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(1, 30))), n)
            for i, n in enumerate(rng.choice(sorted(parts)) for _ in range(400))]
    return rows, spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)


def test_models_against_plain_kneser_ney(tongues):
    rows, docs = tongues
    models = langid.learn(docs)
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    fold = {r["doc_id"]: r["f"] for r in spark.createDataFrame([(i,) for i, _, _ in rows], "doc_id bigint").select(
        "doc_id", F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(langid.CALIBRATION)).alias("f")).collect()}
    used = [(plain_normal(t), n) for i, t, n in rows if zlib.crc32(str(i).encode()) % 4 != 2 and fold[i] != 0]
    plain = {n: plain_model([t for t, m in used if m == n]) for n in models.names}
    alphabet = len({g for c, _ in plain.values() for g in c[1]}) + 1
    tests = [plain_normal(t) for _, t, _ in rows[:25]] + ["", "zzz qq", "ka zü"]
    got = models.cross_entropies(tests)
    for i, t in enumerate(tests):
        s = " " * (langid.ORDER - 1) + t + " "
        for j, n in enumerate(models.names):
            want = -sum(math.log(plain_probability(plain[n], alphabet, s[k:k + langid.ORDER])) for k in range(len(s) - langid.ORDER + 1))
            assert got[i, j] == pytest.approx(want / (len(t) + 1), rel=1e-4)


def test_probabilities_sum_to_one(tongues):
    _, docs = tongues
    model = langid.learn(docs).languages[1]
    letters = sorted({chr(c) for c in range(97, 123)} | set("üé "))
    alphabet = round(math.exp(-model.unknown))
    own = len(model.grams[0][0])
    for context in (" ei", "ung", "xyz", "   "):
        grams = langid.as_points([context + x for x in letters], 4)
        seen = np.exp(model.log_probability(grams))
        known = np.isin(langid.hashes(grams[:, 3:]), model.grams[0][0])
        # characters that this language lacks share what is left evenly
        rest = np.exp(model.log_probability(langid.as_points([context + "一"], 4)))[0]
        assert seen[known].sum() + rest * (alphabet - own) == pytest.approx(1, abs=1e-3)


def test_language_held_out_and_cases(spark, tongues):
    rows, docs = tongues
    models = langid.learn(docs)
    found = langid.identify(docs, models).collect()
    held = [r for r in found if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 and len(r["text"]) > 20]
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.98
    assert all(0 <= r["score"] <= 1 for r in found)
    odd = spark.createDataFrame([(1, None, "x"), (1, "", "x"), (None, "12 34 !?", None), (5, "ka to " * 50_000, "y"), (5, "ka to " * 50_000, "y"),
                                 (6, "".join(map(chr, range(0x4e00, 0x9fff))) + "".join(map(chr, range(0x20000, 0x2a6df))) * 2, None)],
                                "doc_id bigint, text string, score string")
    told = langid.identify(odd, models).collect()
    assert [r["lang_pred"] for r in told if not re.search(r"[^\W\d_]", r["text"] or "")] == ["und"] * 3
    assert {r["lang_pred"] for r in told if r["doc_id"] == 5} == {"aa"} and len(told) == 6
    assert langid.identify(docs.limit(0), models).count() == 0
    none = langid.learn(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in langid.identify(docs, none).collect()} == {"und"}
    wide = langid.distinct_grams(["".join(map(chr, itertools.chain(range(0x3000, 0xd000), range(0x20000, 0x2a6df))))])
    assert len(wide[0]) == len(wide[2]) and wide[1].sum() == len(wide[3])


def test_language_bound_keeps_frequent(tongues):
    _, docs = tongues
    small = langid.learn(docs, entries=600)
    assert sum(len(g) for m in small.languages for g, _ in m.grams) <= 600
    assert set(small.names) == {"aa", "bb", "cc"}
    texts = ["katomi ralo", "schungein", "quéaux leou"]
    assert [small.names[k] for k in small.cross_entropies(texts).argmin(axis=1)] == small.names


def test_language_keeps_every_gram(spark, monkeypatch):
    """More n-grams of one order than any bound that once held, all of one class of counts."""
    counts = spark.range(600_000).select(F.lit("xx").alias("lang"), F.lit(4).alias("k"), F.lpad(
        F.conv("id", 10, 36), 4, "0").alias("gram"), F.lit(1).cast("long").alias("n"))
    kept = langid.model_rows(counts)
    assert kept.count() == 600_000 and kept.where("total = 36 AND types = 36").count() > 599_900
    table = spark.createDataFrame([(lang, k, "", True, float(i), float(-k), 7 * i % 11 - 5, i % 3)
                                   for lang, k in itertools.product(("a", "b"), range(1, 5)) for i in range(k + 4)],
                                  "lang string, k int, gram string, keep boolean, value float, weight float, h bigint, c bigint")
    monkeypatch.setattr(langid, "HELD_ROWS", 9)       # several groups of orders
    names, stored = langid.store(table, 5)
    assert names == ["a", "b"]
    for language, k in itertools.product(stored.languages(), range(1, 5)):
        keys, values = language.grams[k - 1]
        want = sorted((np.uint64((7 * i % 11 - 5) % 2**64), i) for i in range(k + 4))
        assert list(zip(keys, values)) == want and language.unknown == -math.log(5)
        assert list(zip(*language.contexts[k - 1])) == [(0, -k), (1, -k), (2, -k)]


def test_language_query(spark):
    folder = "/root/testdata/sf0.01"
    got = queries.op11_language_id(spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = got.collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == 1000 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.98
    assert sum(r["accepted"] for r in rows) / len(rows) > 0.98


# ------------------------------------------------------------------ fill in the middle

def plain_fim(i, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k:8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(text) + 1), h2 % (len(text) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("frame", [fim.FRAME, 3])
def test_fim_against_plain_cut(spark, frame):
    rng = random.Random(8)
    made = lambda n: "".join(rng.choice("aé😀<PSM>\n ") for _ in range(n))
    rows = [(i, made(rng.randrange(60)), "x") for i in range(120)] + [(i, made(2)[:1] + "z" * rng.randrange(20_000), "x") for i in range(200, 215)]
    rows += [(5, None, "x"), (None, "null id", "x"), (None, "null id", "x"), (7, "", "x"), (8, "a<P>b", "x"), (9, "é" * 300_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, form string")
    done = fim.transform(docs, frame=frame)
    got = fim.digests(done.withColumn("output", fim.as_text(F.col("frames")))).collect()
    want = sorted((str(i), *plain_fim(i, t), SHA(t or ""), len(t or "")) for i, t, _ in rows)
    assert sorted((str(r["doc_id"]), r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["restored_sha256"], r["n"])
                  for r in got) == want
    assert all(r["output_sha256"] == SHA(r["output"]) for r in got)
    assert fim.digests(fim.transform(docs.limit(0))).count() == 0


def test_fim_opens_only_cut_frames():
    out = fim.FrameWriter(10)
    out.put("0123456789" * 50)
    text = fim.FrameReader(out.done())
    assert text.units == 500 and [f["start"] for f in text.frames] == list(range(0, 500, 10))
    frames = fim.rearrange(text, "psm", 123, 456, out)
    assert text.opened == 4      # both sides of the two cuts, none of the 48 whole frames
    back = fim.FrameReader(frames)
    assert "".join(back.read(0, back.units)) == f"<P>{('0123456789' * 50)[:123]}<S>{('0123456789' * 50)[456:]}<M>{('0123456789' * 50)[123:456]}"
    assert "".join(itertools.chain.from_iterable(back.read(a, b) for a, b in fim.parts(back, "psm"))) == "0123456789" * 50
    assert fim.FrameReader([]).units == 0 and list(fim.FrameReader([]).read(0, 0)) == []


# ------------------------------------------------------------------ conversation repair

def every_repair(rows):
    """Least (cost, audit) by trying all edits, with at most two rows added at a place."""
    best = None

    def go(i, seq, cost, audit, added):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if added < 2:
            for x in "ua":
                go(i, seq + x, cost + 2, audit + "I", added + 1)
        if i == len(rows):
            if re.fullmatch("(s?(ua)+)?", seq) and (best is None or (cost, audit) < best):
                best = (cost, audit)
            return
        mark, fault = rows[i]
        go(i + 1, seq, cost + 3, audit + "D", 0)
        if fault != dialogues.GONE:
            more = int(fault == dialogues.CUT)
            if mark in "sua" and mark:
                go(i + 1, seq + mark, cost + more, audit + "K", 0)
            for x in "ua":
                go(i + 1, seq + x, cost + 2 + more, audit + "R", 0)

    go(0, "", 0, "", 0)
    return best


def test_agenda_against_every_repair():
    rng = random.Random(6)
    cases = [tuple((rng.choice("suax"), rng.choice([0, 0, 0, 1, 2])) for _ in range(rng.randrange(5))) for _ in range(150)]
    for rows in cases:
        want = every_repair(rows)
        assert dialogues.repair(rows) == want
        for size in (1, 2):
            blocks = [dialogues.block_weights(rows[k:k + size]) for k in range(0, len(rows), size)]
            assert dialogues.joined(blocks) == want


def plain_report(rows):
    """One conversation after damage: rows (turn, role, text) in order."""
    seen, faults = set(), []
    for _, role, text in rows:
        fault = "ok"
        if not re.search(r"[^\x20\x09-\x0D]", text):
            fault = "blank"
        elif (role, text) in seen:
            fault = "duplicate"
        elif re.sub(r"[\x20\x09-\x0D]+\Z", "", text)[-1] not in ".!?":
            fault = "truncated"
        seen.add((role, text))
        faults.append(fault)
    code = {"ok": 0, "truncated": 1, "blank": 2, "duplicate": 2}
    cost, audit = dialogues.repair(tuple((r[1][:1], code[f]) for r, f in zip(rows, faults)))
    turns = [r[0] for r in rows if r[0] is not None]
    marks = [r[1][:1] for r in rows]
    left, said, state = list(rows), [], ""
    for x in audit:
        row = None if x == "I" else left.pop(0)
        if x == "D":
            continue
        role = row[1] if x == "K" else "assistant" if state == "u" else "user"
        said.append(f"{role}:{row[2] if row else ''}")
        state = role[:1]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"),
            faults.count("truncated"), sum(a + b not in ("su", "ua", "au") for a, b in zip(marks, marks[1:])), cost, audit, SHA("\n".join(said)))


def test_repair_report(spark, monkeypatch):
    rng = random.Random(3)
    said = ["one.", "two", " three! ", "", " \n", "x?", None, "é😀."]
    rows = [(c, rng.choice([None, t, t, t + 1]), rng.choice(["user", "assistant", "system", None, "tool", ""]), rng.choice(said))
            for c in [*range(40), None] for t in range(rng.randrange(9))]
    rows += [(77, t, rng.choice(["user", "assistant"]), rng.choice(["a.", "b", f"{t}."])) for t in range(900)]     # spans tasks and blocks
    rows += [(78, 1, "user", "same.")] * 20
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    fill = lambda s: " " if s is None else s
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t, fill(r), fill(x)))
    want = {c: plain_report(sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1], md5(r[2])))) for c, own in by.items()}
    got = dialogues.report(turns.repartition(3), turns)
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == want
    found = dialogues.repairs(turns)
    lines = {}
    for r in sorted(dialogues.repaired_rows(turns, found).collect(), key=lambda r: r["place"]):
        lines.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    assert all(SHA("\n".join(lines.get(c, []))) == want[c][-1] for c in want)
    assert dialogues.report(turns.limit(0), turns.limit(0)).count() == 0
    gone = dialogues.report(turns.where("conv_id = 78"), turns.limit(0)).collect()
    assert [tuple(r) for r in gone] == [(78, 0, 0, 0, 0, 0, 0, "", SHA(""))]


def test_damage(spark):
    rows = [(c, t, "assistant", "a.b!?") for c in range(30) for t in range(4)] + [(None, None, None, None)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    want = []
    for c, t, r, x in rows:
        n = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{n(c)}:{n(t)}".encode()) % 20
        role, text = n(r), n(x)
        if kind:
            want += [(c, t, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)] * (2 if kind == 3 else 1)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, dialogues.damaged(turns).collect()), key=key) == sorted(want, key=key)
