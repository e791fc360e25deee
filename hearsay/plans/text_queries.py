"""Text, data-set and feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearsay.functions import scalar as S
from hearsay.functions import text as X
from hearsay.operators import datasets as D
from hearsay.operators import features as FE
from hearsay.operators import ordered as O
from hearsay.plans import views as V
from hearsay.plans.registry import query

STOPS = ["the", "a", "an", "of", "to", "and", "in", "on", "that", "le", "la", "de", "et"]
# community -> class of the weak labels; other communities stay unlabelled
LABELS = {f"src{i}": i % 3 for i in range(12)}

# Unicode white space beyond ASCII, which the SQL engine's \s does not know
WS = r"\t\n\x0b\f\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
CLEAN = (r"regexp_replace(regexp_replace(regexp_replace(replace(lower({t}), '{{html}}', ''), "
         rf"'[^\p{{L}}\p{{N}}_{WS}]', '', 'g'), 'http[^{WS}]+', '[URL]', 'g'), '[0-9]+', '[NUM]', 'g')")
CLEAN = CLEAN.replace("{{html}}", "{html}")
SPLIT = "list_filter(regexp_split_to_array({t}, '[" + WS + "]+'), lambda x: x <> '')"


def clean(t: str) -> str:
    return CLEAN.replace("{t}", t)


def split(t: str) -> str:
    return SPLIT.replace("{t}", t)


def order_by(ids: str, seed: int = 42) -> str:
    return f"md5(concat_ws('|', {ids}, '{seed}')), {ids}"


SKIP = "CASE WHEN selftext IS NULL THEN title ELSE title || ' ' || selftext END"
TOKENS = f"tok AS (SELECT id, subreddit, {split('text')} AS tokens FROM texts)"
LABEL_CASE = "CASE subreddit " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in LABELS.items()) + " END"


@query("compose_text", "F03 Q5", "texts",
       f"SELECT id, md5({SKIP}) AS skip_md5, md5(coalesce(title || ' ' || selftext, 'nan')) "
       "AS propagate_md5 FROM texts")
def compose_text(spark, d):
    title, body = F.col("title"), F.col("selftext")
    return V.texts(spark, d).select(
        "id", F.md5(X.compose(title, body)).alias("skip_md5"),
        F.md5(X.compose(title, body, "propagate")).alias("propagate_md5"))


@query("preprocess_text", "F01 F03 D01", "texts",
       f"SELECT id, md5({clean(SKIP)}) AS clean_md5, length({clean(SKIP)}) AS n_chars FROM texts")
def preprocess_text(spark, d):
    cleaned = X.normalize(X.compose(F.col("title"), F.col("selftext")))
    return V.texts(spark, d).select("id", cleaned.alias("t")).select(
        "id", F.md5("t").alias("clean_md5"), F.length("t").cast("long").alias("n_chars"))


@query("preprocess_comments", "F01 D01", "comments",
       f"SELECT id, md5({clean('body')}) AS clean_md5 FROM comments")
def preprocess_comments(spark, d):
    return V.comments(spark, d).select("id", F.md5(X.normalize(F.col("body"))).alias("clean_md5"))


@query("mask_links", "F01 F27", "pages_view",
       f"SELECT page_id, md5({clean('html')}) AS clean_md5 FROM pages")
def mask_links(spark, d):
    cleaned = X.repair_masks(X.normalize(F.col("html")))
    return V.table(spark, d, "pages").select("page_id", F.md5(cleaned).alias("clean_md5"))


LEXICON = f"""lex AS (SELECT DISTINCT w AS word, substring(w, 1, length(w) - 1) AS lemma FROM
      (SELECT unnest({split(clean('text'))}) AS w FROM benchmark) WHERE w LIKE '%es'),
    words AS (SELECT id, unnest(t) AS w, generate_subscripts(t, 1) AS i FROM
      (SELECT id, {split(clean('text'))} AS t FROM texts)),
    kept AS (SELECT id, i, coalesce(lemma, w) AS w FROM words LEFT JOIN lex ON word = w
      WHERE lower(w) NOT IN {tuple(STOPS)})"""


@query("clean_lemmas", "F02", "texts",
       "SELECT t.id, md5(coalesce(k.s, '')) AS lemmas_md5 FROM texts t LEFT JOIN "
       "(SELECT id, string_agg(w, ' ' ORDER BY i) AS s FROM kept GROUP BY 1) k ON k.id = t.id", LEXICON)
def clean_lemmas(spark, d):
    known = X.tokens(X.normalize(F.col("text")))
    lexicon = (V.table(spark, d, "benchmark").select(F.explode(known).alias("word"))
               .where(F.col("word").endswith("es")).distinct()
               .withColumn("lemma", F.expr("substring(word, 1, length(word) - 1)")))
    words = V.texts(spark, d).select("id", X.remove_stop_words(known, STOPS).alias("tokens"))
    out = X.lemmatize(words, "id", "tokens", lexicon)
    return out.select("id", F.md5(F.array_join("lemmas", " ")).alias("lemmas_md5"))


@query("tokens_count", "F20 F25", "texts",
       f"SELECT id, len({split('text')}) AS n_words, length(text) AS n_chars FROM texts")
def tokens_count(spark, d):
    text = F.col("text")
    return V.texts(spark, d).select("id", X.word_count(text).cast("long").alias("n_words"),
                                    X.char_count(text).cast("long").alias("n_chars"))


@query("text_prefix", "F19", "texts", "SELECT id, md5(substring(text, 1, 500)) AS prefix_md5 FROM texts")
def text_prefix(spark, d):
    return V.texts(spark, d).select("id", F.md5(X.prefix(F.col("text"), 500)).alias("prefix_md5"))


def _tokens(spark, d):
    return V.texts(spark, d).select("id", "subreddit", X.tokens(F.col("text")).alias("tokens"))


TRAIN = "train AS (SELECT tok.* FROM tok JOIN labels ON doc_id = id WHERE quality = 1)"
VOCAB = ("vocab AS (SELECT w AS word, row_number() OVER (ORDER BY w) + 1 AS word_id FROM "
         "(SELECT DISTINCT unnest(tokens) AS w FROM train))")


def _train(spark, d):
    good = V.table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    return _tokens(spark, d).join(good, "id", "left_semi")


@query("vocab_ids", "M01 S22", "texts", "SELECT word, word_id FROM vocab", f"{TOKENS}, {TRAIN}, {VOCAB}")
def vocab_ids(spark, d):
    return FE.vocabulary(_train(spark, d))


ENCODED = f"""{TOKENS}, {TRAIN}, {VOCAB}, enc AS (SELECT id, list(coalesce(word_id, 1) ORDER BY i) AS ids
    FROM (SELECT id, unnest(tokens) AS w, generate_subscripts(tokens, 1) AS i FROM tok)
    LEFT JOIN vocab ON word = w GROUP BY id)"""


@query("encode_pad", "M03 M04 M06", "texts",
       "SELECT t.id, coalesce(len(ids), 0) AS n_ids, array_to_string(CASE WHEN len(ids) >= 78 "
       "THEN ids[-78:] ELSE list_concat(coalesce(ids, []), [0 FOR i IN range(78 - "
       "coalesce(len(ids), 0))]) END, ' ') AS padded FROM texts t LEFT JOIN enc ON enc.id = t.id",
       ENCODED)
def encode_pad(spark, d):
    words = _tokens(spark, d).select("id", "tokens", F.size("tokens").cast("long").alias("n_ids"))
    coded = FE.encode(words, FE.stored_vocabulary(_train(spark, d)), last=FE.PADDED_LENGTH)
    return coded.select("id", "n_ids", F.array_join(FE.pad(F.col("ids")).cast("array<string>"), " ").alias("padded"))


@query("max_len_p95", "M05 W08", "texts",
       "SELECT n AS max_length FROM (SELECT len(tokens) AS n, row_number() OVER (ORDER BY len(tokens)) "
       "AS rn, count(*) OVER () AS c FROM train) WHERE rn = CAST(floor(c * 0.95) AS BIGINT) + 1",
       f"{TOKENS}, {TRAIN}")
def max_len_p95(spark, d):
    sizes = _train(spark, d).select(F.size("tokens").cast("long").alias("n"))
    return FE.max_length(sizes, "n")


@query("label_index", "M02", "labels_view",
       "SELECT label, row_number() OVER (ORDER BY label) - 1 AS label_id FROM "
       "(SELECT DISTINCT lang AS label FROM documents)")
def label_index(spark, d):
    docs = V.table(spark, d, "documents").select(F.col("lang").alias("label"))
    return FE.label_index(docs).select("label", F.col("label_id").cast("long").alias("label_id"))


# ---------------------------------------------------------------- samples and splits

@query("fixed_sample", "U07", "posts", f"SELECT id FROM posts ORDER BY {order_by('id')} LIMIT 500")
def fixed_sample(spark, d):
    return D.fixed_sample(V.posts(spark, d).select("id"), 500)


@query("fixed_sample_per_community", "U07", "posts",
       "SELECT id, subreddit FROM (SELECT id, subreddit, row_number() OVER (PARTITION BY subreddit "
       f"ORDER BY {order_by('id')}) AS rn FROM posts) WHERE rn <= 120")
def fixed_sample_per_community(spark, d):
    return D.fixed_sample(V.posts(spark, d).select("id", "subreddit"), 120, group_cols=["subreddit"])


HEX = "('0x' || substring(md5(concat_ws('|', id, '42')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"


@query("fraction_sample", "U08", "posts", f"SELECT id, subreddit FROM posts WHERE {HEX} < 0.1")
def fraction_sample(spark, d):
    return D.fraction_sample(V.posts(spark, d).select("id", "subreddit"), 0.1)


@query("stratified_sample", "U09", "posts",
       f"SELECT id, class_II FROM posts WHERE {HEX} < CASE class_II WHEN 0 THEN 0.5 WHEN 1 THEN 0.2 ELSE 0 END")
def stratified_sample(spark, d):
    return D.stratified_sample(V.posts(spark, d).select("id", "class_II"), "class_II",
                               {0: 0.5, 1: 0.2})


@query("complement", "U06", "posts",
       f"SELECT id FROM posts WHERE id NOT IN (SELECT id FROM posts ORDER BY {order_by('id')} LIMIT 700)")
def complement(spark, d):
    ids = V.posts(spark, d).select("id")
    return D.complement(ids, D.fixed_sample(ids, 700))


@query("complement_unique", "U06 Q9", "texts",
       "SELECT md5(text) AS text_md5 FROM (SELECT text FROM documents UNION ALL SELECT text FROM s "
       "UNION ALL SELECT text FROM s) GROUP BY text HAVING count(*) = 1",
       f"s AS (SELECT text FROM texts ORDER BY {order_by('id')} LIMIT 100)")
def complement_unique(spark, d):
    texts = V.texts(spark, d).select("id", "text")
    sample = D.fixed_sample(texts, 100).select("text")
    rest = D.complement(texts.select("text"), sample, mode="unique")
    return rest.select(F.md5("text").alias("text_md5"))


@query("random_split", "U10", "posts",
       "SELECT id, CASE WHEN rn <= ceil(n * 0.2) THEN 'test' ELSE 'train' END AS split FROM "
       f"(SELECT id, row_number() OVER (ORDER BY {order_by('id')}) AS rn, count(*) OVER () AS n FROM posts)")
def random_split(spark, d):
    return D.split(V.posts(spark, d).select("id"))


@query("stratified_split", "U11", "posts",
       "SELECT id, class_II, CASE WHEN rn <= ceil(n * 0.2) THEN 'test' ELSE 'train' END AS split FROM "
       f"(SELECT id, class_II, row_number() OVER (PARTITION BY class_II ORDER BY {order_by('id')}) AS rn, "
       "count(*) OVER (PARTITION BY class_II) AS n FROM posts)")
def stratified_split(spark, d):
    return D.stratified_split(V.posts(spark, d).select("id", "class_II"), "class_II")


@query("balanced_split", "U12 J11", "posts",
       "SELECT id, label, CASE WHEN rn <= 800 THEN 'train' WHEN rn <= 800 + v THEN 'valid' ELSE 'test' "
       "END AS split FROM (SELECT *, CASE label WHEN 1 THEN 160 ELSE 300 END AS v, row_number() OVER "
       f"(PARTITION BY label ORDER BY {order_by('id')}) AS rn FROM (SELECT id, CASE subreddit WHEN 'click' "
       "THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 END AS label FROM posts) WHERE label IS NOT NULL) "
       "WHERE label <> 2 OR rn <= 1800")
def balanced_split(spark, d):
    labelled = D.map_labels(V.posts(spark, d).select("id", "subreddit"),
                            {"click": 0, "error": 1, "purchase": 2}).drop("subreddit")
    return D.balanced_split(labelled, "label", 800, {0: 300, 1: 160, 2: 300}, {2: 700})


@query("assembled_set", "U13 P04 U01", "posts",
       "SELECT id, label, CASE WHEN rn <= ceil(n * 0.2) THEN 'test' ELSE 'train' END AS split FROM "
       f"(SELECT id, k % 2 AS label, row_number() OVER (ORDER BY {order_by('id')}) AS rn, "
       "count(*) OVER () AS n FROM posts WHERE class_I = 1 AND subreddit = 'click') "
       "UNION ALL SELECT id, 0 AS label, 'train' AS split FROM (SELECT id FROM posts WHERE id NOT IN "
       f"(SELECT id FROM posts WHERE class_I = 1 AND subreddit = 'click') ORDER BY {order_by('id')} LIMIT 900)")
def assembled_set(spark, d):
    posts = V.posts(spark, d)
    annotated = posts.where("class_I = 1 AND subreddit = 'click'").select(
        "id", (F.col("k") % 2).alias("label"))
    return D.assemble(annotated, posts.select("id"), 900)


@query("shuffle_head", "L07", "posts",
       f"SELECT id FROM posts ORDER BY {order_by('id', 7)} LIMIT 50")
def shuffle_head(spark, d):
    return D.shuffle(V.posts(spark, d).select("id"), seed=7).limit(50)


@query("label_map", "J11", "texts", f"SELECT id, subreddit, {LABEL_CASE} AS label FROM texts")
def label_map(spark, d):
    return D.map_labels(V.texts(spark, d).select("id", "subreddit"), LABELS)


@query("label_map_table", "J11", "texts",
       "SELECT id, texts.subreddit, label FROM texts LEFT JOIN (SELECT subreddit, min(lang) AS label "
       "FROM texts WHERE lang <> 'en' GROUP BY 1) USING (subreddit)")
def label_map_table(spark, d):
    texts = V.texts(spark, d).select("id", "subreddit", "lang")
    table = texts.where("lang <> 'en'").groupBy("subreddit").agg(F.min("lang").alias("label"))
    return D.map_labels_by_table(texts.drop("lang"), table)


@query("label_recode", "F17", "posts",
       "SELECT id, CASE subreddit WHEN 'click' THEN '0' WHEN 'view' THEN '1' ELSE subreddit END AS label FROM posts")
def label_recode(spark, d):
    return V.posts(spark, d).select("id", S.recode(F.col("subreddit"), {"click": "0", "view": "1"})
                                    .alias("label"))


@query("label_swap", "F18", "posts",
       "SELECT id, CASE class_II WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE class_II END AS label FROM posts")
def label_swap(spark, d):
    return V.posts(spark, d).select("id", S.swap_01(F.col("class_II")).alias("label"))


@query("label_from_name", "F16", "posts",
       "SELECT id, CAST(right('LABEL_' || class_II, 1) AS INTEGER) AS label FROM posts")
def label_from_name(spark, d):
    name = F.concat(F.lit("LABEL_"), F.col("class_II").cast("string"))
    return V.posts(spark, d).select("id", S.label_from_name(name).alias("label"))


@query("onehot", "F15", "posts",
       "SELECT id, CAST(class_II = 0 AS INTEGER) AS c_0, CAST(class_II = 1 AS INTEGER) AS c_1, "
       "CAST(class_II = 2 AS INTEGER) AS c_2 FROM posts")
def onehot(spark, d):
    hot = S.one_hot(F.col("class_II"), 3)
    return V.posts(spark, d).select("id", *S.array_columns(hot, ["c_0", "c_1", "c_2"]))


BEST = "greatest(label_0, label_1, label_2)"


@query("is_max_onehot", "F14 F23", "posts",
       f"SELECT id, CAST(label_0 = {BEST} AS INTEGER) AS m_0, CAST(label_1 = {BEST} AS INTEGER) AS m_1, "
       f"CAST(label_2 = {BEST} AS INTEGER) AS m_2 FROM posts")
def is_max_onehot(spark, d):
    flags = S.is_max(F.array("label_0", "label_1", "label_2"))
    return V.posts(spark, d).select("id", *S.array_columns(flags, ["m_0", "m_1", "m_2"]))


@query("argmax_label", "F13 M16", "posts",
       f"SELECT id, CASE {BEST} WHEN label_0 THEN 0 WHEN label_1 THEN 1 ELSE 2 END AS class_II, "
       f"{BEST} AS conf_II FROM posts")
def argmax_label(spark, d):
    scores = F.array("label_0", "label_1", "label_2")
    return V.posts(spark, d).select("id", S.argmax(scores).alias("class_II"),
                                    F.array_max(scores).alias("conf_II"))


@query("row_sum_valid", "P15 F26", "posts",
       "SELECT id FROM posts WHERE abs(label_0 + label_1 + label_2 - 1) < 1e-9")
def row_sum_valid(spark, d):
    total = S.row_sum([F.col(f"label_{i}") for i in range(3)])
    return V.posts(spark, d).where(F.abs(total - 1) < 1e-9).select("id")


@query("unflatten_scores", "F05 S18", "posts",
       'SELECT id // 2 AS "row", max(CASE WHEN id % 2 = 0 THEN score END) AS s_0, '
       "max(CASE WHEN id % 2 = 1 THEN score END) AS s_1 FROM posts GROUP BY 1")
def unflatten_scores(spark, d):
    return FE.unflatten(V.posts(spark, d).select(F.col("id").alias("pos"), F.col("score").alias("value")), 2)


@query("embedding_long", "F24 F23", "embeddings_view",
       "SELECT i - 1 AS dim, count(*) AS n, round(sum(CAST(v AS DOUBLE)), 6) AS total FROM (SELECT "
       "unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1")
def embedding_long(spark, d):
    long = V.table(spark, d, "embeddings").select(F.posexplode("embedding").alias("dim", "v"))
    return (long.groupBy(F.col("dim").cast("long").alias("dim"))
            .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("v").cast("double")), 6).alias("total")))


@query("union_text", "U03 U02", "texts comments",
       "SELECT md5(text) AS text_md5, label FROM (SELECT text, 0 AS label FROM texts UNION ALL "
       "SELECT body AS text, 1 AS label FROM comments)")
def union_text(spark, d):
    posts = V.texts(spark, d).select("text", F.lit(0).alias("label"))
    comments = V.comments(spark, d).select("body", F.lit(1).alias("label"))
    both = D.unified_text(posts, comments, "text", "body")
    return both.select(F.md5("text").alias("text_md5"), "label")


@query("annotation_export", "S20 P17", "texts",
       f"SELECT md5({SKIP}) AS text_md5, 0 AS label FROM texts")
def annotation_export(spark, d):
    rows = D.annotation_rows(V.texts(spark, d), X.compose(F.col("title"), F.col("selftext")))
    return rows.select(F.md5("text").alias("text_md5"), "label")
