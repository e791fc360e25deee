"""Queries on boosted trees, each with a twin that grows the same trees in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from hearsay.functions import text as X
from hearsay.operators import boosting as B
from hearsay.operators import models as M
from hearsay.operators.bundle import BoostedTrees, text_bundle
from hearsay.plans import views as V
from hearsay.plans.model_queries import SCORED, stance_model
from hearsay.plans.registry import query
from hearsay.plans.text_queries import SPLIT
from hearsay.session import shared_folder

CLASSES, BINS, FOLDS = 3, 16, 5
TREES = {"maxIter": 6, "maxDepth": 3, "stepSize": 0.3}
CURVE = {"maxDepth": 8, "stepSize": 1.0}                    # fixed values: depth and rate of the published curve
CURVE_ROUNDS = 5
GRID = {"maxDepth": [2, 3], "stepSize": [0.05, 0.1], "featureSubsetStrategy": ["0.5"], "maxIter": [1, 3]}
BUNDLE = {"maxIter": 3, "maxDepth": 4, "stepSize": 0.5}
STANCE = "CASE WHEN toxic = 1 THEN 0 WHEN quality = 0 THEN 1 ELSE 2 END"


def _rows(spark, d):
    """Labelled documents with three classes and a fold; the last fold is the test set."""
    labels = V.table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.expr(STANCE).alias("label"))
    docs = V.texts(spark, d).select("id", "text").join(labels, "id")
    return M.with_folds(docs, FOLDS)


def _features(spark, d):
    """All labelled rows as vectors by vocabulary and length of the training folds, and the
    number of ids."""
    rows = _rows(spark, d).withColumn("tokens", X.tokens(F.col("text"))).drop("text")
    return M.fitted_features(rows, F.col("fold") < FOLDS - 1)


# ---------------------------------------------------------------- the same trees in SQL

SPLIT_SQL = SPLIT.replace("{t}", "text")
FOLD = f"CAST(floor(('0x' || substr(md5(id || '|42'), 1, 13))::BIGINT / {float(16 ** 13)!r}::DOUBLE * {FOLDS}) AS INTEGER)"


def _data(raw: str) -> str:
    """CTEs of the binned features of the rows ``raw`` (id, y, tokens, fold)."""
    return f"""raw AS ({raw}),
  known AS (SELECT w AS word, row_number() OVER (ORDER BY w) + 1 AS word_id FROM
    (SELECT DISTINCT unnest(tokens) AS w FROM raw WHERE fold < {FOLDS - 1})),
  lim AS (SELECT n AS l, (SELECT count(*) + 2 FROM known) AS top FROM
    (SELECT len(tokens) AS n, row_number() OVER (ORDER BY len(tokens)) AS rn, count(*) OVER () AS c FROM raw WHERE fold < {FOLDS - 1})
    WHERE rn = CAST(floor(c * 0.95) AS BIGINT) + 1),
  coded AS (SELECT id, list(coalesce(word_id, 1) ORDER BY i) AS ids FROM
    (SELECT id, unnest(tokens) AS w, generate_subscripts(tokens, 1) AS i FROM raw) LEFT JOIN known ON word = w GROUP BY id),
  cells AS MATERIALIZED (SELECT id, f, x * {BINS} // top AS b FROM (SELECT id, top, f, CASE WHEN len(ids) >= l
      THEN ids[len(ids) - l + f + 1] ELSE coalesce(ids[f + 1], 0) END AS x
    FROM (SELECT raw.id, top, l, coalesce(ids, []) AS ids, unnest(range(0, l)) AS f FROM lim, raw LEFT JOIN coded USING (id)))),
  base AS MATERIALIZED (SELECT id, y, fold FROM raw)"""


LABELLED = f"SELECT id, {STANCE} AS y, {SPLIT_SQL} AS tokens, {FOLD} AS fold FROM texts JOIN labels ON doc_id = id"


def grown(settings: Sequence[B.Setting], classes: int = CLASSES, raw: str = LABELLED) -> str:
    """CTEs up to ``z0 z1 ...``: margins (m, id, k, z) after so many rounds of all models."""
    rounds, depth = max(s.rounds for s in settings), max(s.depth for s in settings)
    models = ", ".join(f"({s.model}, {s.rounds}, {s.depth}, {s.rate}::DOUBLE, {-1 if s.leave is None else s.leave}, "
                       f"{s.columns}::DOUBLE)" for s in settings)
    ridge, least, seed = settings[0].ridge, settings[0].least, settings[0].seed
    ctes = [_data(raw), f"models(m, rounds, depth, rate, leave, share) AS (VALUES {models})",
            f"z0 AS (SELECT m, id, k, 0.0::DOUBLE AS z FROM models, base, range(0, {classes}) r(k))"]
    for r in range(rounds):
        ctes.append(
            f"n{r}_0 AS MATERIALIZED (SELECT m, id, k, 0 AS node, fold <> leave AS train, round((p - CASE WHEN y = k THEN 1 ELSE 0 END) "
            f"* {B.SCALE})::BIGINT AS g, round(greatest(2 * p * (1 - p), 1e-6) * {B.SCALE})::BIGINT AS h FROM "
            f"(SELECT *, e / sum(e) OVER (PARTITION BY m, id) AS p FROM (SELECT *, exp(z - max(z) OVER (PARTITION BY m, id)) AS e "
            f"FROM z{r})) JOIN models USING (m) JOIN base USING (id) WHERE rounds > {r})")
        done = []
        for level in range(depth + 1):
            n = f"n{r}_{level}"
            ctes.append(f"t{n} AS MATERIALIZED (SELECT m, k, node, sum(g)::BIGINT AS tg, sum(h)::BIGINT AS th FROM {n} WHERE train GROUP BY ALL)")
            s = f"/ {B.SCALE}::DOUBLE"
            ctes.append(
                f"s{n} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY m, k, node ORDER BY gain DESC, f, b) AS rn FROM "
                f"(SELECT m, k, node, f, b, round((gl {s}) * (gl {s}) / (hl {s} + {ridge}) + (tg {s} - gl {s}) * (tg {s} - gl {s}) / "
                f"(th {s} - hl {s} + {ridge}) - (tg {s}) * (tg {s}) / (th {s} + {ridge}), {B.DIGITS}) AS gain FROM "
                f"(SELECT m, k, node, f, b, sum(g) OVER w AS gl, sum(h) OVER w AS hl FROM (SELECT m, k, node, f, b, sum(g) AS g, sum(h) AS h "
                f"FROM {n} JOIN models USING (m) JOIN cells USING (id) WHERE train AND depth > {level} AND (share >= 1 OR "
                f"('0x' || substr(md5('{seed}|{r}|' || k || '|' || f), 1, 8))::BIGINT < share * {16 ** 8}) GROUP BY m, k, node, f, b) "
                f"WINDOW w AS (PARTITION BY m, k, node, f ORDER BY b)) JOIN t{n} USING (m, k, node) "
                f"WHERE hl {s} >= {least} AND th {s} - hl {s} >= {least}) WHERE gain > 0) WHERE rn = 1)")
            done.append(f"SELECT a.m, a.id, a.k, -(tg {s}) / (th {s} + {ridge}) * rate AS v FROM {n} a JOIN t{n} USING (m, k, node) "
                        f"JOIN models USING (m) ANTI JOIN s{n} USING (m, k, node)")
            if level < depth:
                ctes.append(f"n{r}_{level + 1} AS MATERIALIZED (SELECT a.m, a.id, a.k, 2 * a.node + 1 + CASE WHEN c.b > s.b THEN 1 ELSE 0 END AS node, "
                            f"train, g, h FROM {n} a JOIN s{n} s USING (m, k, node) JOIN cells c ON c.id = a.id AND c.f = s.f)")
        ctes.append(f"z{r + 1} AS MATERIALIZED (SELECT m, id, k, z + v AS z FROM z{r} JOIN ({' UNION ALL '.join(done)}) USING (m, id, k))")
    return ", ".join(ctes)


def chances(settings: Sequence[B.Setting], stops: Sequence[int], classes: int = CLASSES, raw: str = LABELLED) -> str:
    """CTE ``scores``: (m, rounds, id, k, p) after each of ``stops`` rounds."""
    steps = " UNION ALL ".join(f"SELECT {r} AS rounds, * FROM z{r}" for r in stops)
    return (f"{grown(settings, classes, raw)}, scores AS MATERIALIZED (SELECT m, rounds, id, k, e / sum(e) OVER (PARTITION BY m, rounds, id) AS p FROM "
            f"(SELECT *, exp(z - max(z) OVER (PARTITION BY m, rounds, id)) AS e FROM ({steps})))")


def _one(params: dict) -> list[B.Setting]:
    return [BoostedTrees(nClasses=CLASSES, **params).setting(0, FOLDS - 1)]


WIDE = ("SELECT id, y AS label, " + ", ".join(f"round(max(p) FILTER (k = {k}), 6) AS s_{k}" for k in range(CLASSES))
        + "{more} FROM scores JOIN base USING (id) WHERE fold = " + str(FOLDS - 1) + " GROUP BY id, y")


@query("train_trees", "M08 M12", "texts", WIDE.replace("{more}", ""), chances(_one(TREES), [TREES["maxIter"]]))
def train_trees(spark, d):
    rows, ids = _features(spark, d)
    model = M.train_trees(rows.where(F.col("fold") < FOLDS - 1), CLASSES, maxBins=BINS, valuesBelow=ids, **TREES)
    scored = M.class_columns(model.transform(rows.where(F.col("fold") == FOLDS - 1)), CLASSES, "s_")
    return scored.select("id", "label", *[F.round(f"s_{k}", 6).alias(f"s_{k}") for k in range(CLASSES)])


AREAS = f"""pairs AS (SELECT a.m, a.rounds, a.k, o.k AS other, round(a.p, 9) AS s, (y = a.k)::INTEGER AS pos
    FROM scores a JOIN base USING (id) JOIN models USING (m), range(0, {CLASSES}) o(k)
    WHERE fold = leave AND o.k <> a.k AND y IN (a.k, o.k)),
  ranked AS (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY m, rounds, k, other, s) - 1) / 2.0 AS r FROM pairs
    WINDOW w AS (PARTITION BY m, rounds, k, other ORDER BY s)),
  area AS (SELECT m, rounds, k, other, (sum(r) FILTER (pos = 1) - sum(pos) * (sum(pos) + 1) / 2.0)
    / nullif(sum(pos) * (count(*) - sum(pos)), 0) AS auc FROM ranked GROUP BY ALL),
  sides AS (SELECT m, rounds, least(k, other) AS k, greatest(k, other) AS other, avg(auc) AS auc FROM area GROUP BY ALL),
  per_model AS (SELECT m, rounds, avg(auc) AS auc FROM sides GROUP BY ALL)"""


def _curve_settings() -> list[B.Setting]:
    base = BoostedTrees(nClasses=CLASSES, maxIter=CURVE_ROUNDS, **CURVE)
    return [base.setting(fold, fold) for fold in range(FOLDS)]


@query("boosting_curve", "M09", "texts",
       "SELECT rounds, round(avg(auc), 6) AS auc_mean, round(stddev_samp(auc), 6) AS auc_std FROM per_model GROUP BY rounds",
       f"{chances(_curve_settings(), range(1, CURVE_ROUNDS + 1))}, {AREAS}")
def boosting_curve(spark, d):
    rows, ids = _features(spark, d)
    curve = M.boosting_curve(rows.drop("fold"), CLASSES, CURVE_ROUNDS, n_folds=FOLDS, maxBins=BINS, valuesBelow=ids, **CURVE)
    return curve.select("rounds", F.round("auc_mean", 6).alias("auc_mean"), F.round("auc_std", 6).alias("auc_std"))


def _grid_settings() -> list[B.Setting]:
    return M.grid_settings(BoostedTrees(nClasses=CLASSES, maxIter=max(GRID["maxIter"])), GRID, FOLDS)[1]


_TOLD = " ".join(f"WHEN {i} THEN '{M.setting_name(c)}'" for i, c in enumerate(M.combinations(GRID)))


@query("train_trees_cv", "M10 M11 W07 D06", "texts",
       f"SELECT params, maxIter, mean_metric, CAST(rank() OVER (ORDER BY mean_metric DESC) AS INTEGER) AS rank FROM "
       f"(SELECT CASE m // {FOLDS} {_TOLD} END AS params, rounds AS maxIter, round(avg(auc), 6) AS mean_metric FROM per_model GROUP BY ALL)",
       f"{chances(_grid_settings(), GRID['maxIter'])}, {AREAS}")
def train_trees_cv(spark, d):
    rows, ids = _features(spark, d)
    return M.search_trees(rows.drop("fold"), CLASSES, GRID, n_folds=FOLDS, maxBins=BINS, valuesBelow=ids)


@query("saved_bundle", "S21 M06 S22", "texts", WIDE.replace("{more}", ", true AS same"),
       chances(_one(BUNDLE), [BUNDLE["maxIter"]]))
def saved_bundle(spark, d):
    """Fits tokens, vocabulary, length and trees as one pipeline, writes it, reads it into a
    fresh object and scores the test fold with both."""
    rows = _rows(spark, d)
    fitted = text_bundle(rows.where(F.col("fold") < FOLDS - 1), BoostedTrees(nClasses=CLASSES, maxBins=BINS, **BUNDLE))
    path = f"{shared_folder(spark)}/bundle-{uuid.uuid4().hex}"
    fitted.write().overwrite().save(path)
    test = rows.where(F.col("fold") == FOLDS - 1)
    told = M.class_columns(PipelineModel.load(path).transform(test), CLASSES, "s_")
    before = fitted.transform(test).select("id", F.col("probability").alias("_before"))
    return told.join(before, "id").select(
        "id", "label", *[F.round(f"s_{k}", 6).alias(f"s_{k}") for k in range(CLASSES)],
        (F.col("probability") == F.col("_before")).alias("same"))


# ---------------------------------------------------------------- cascade

TOPIC = {"maxIter": 4, "maxDepth": 3, "stepSize": 0.5}
#: every text; only labelled ones outside the last fold are learned from
EVERY = (f"SELECT id, quality AS y, {SPLIT_SQL} AS tokens, CASE WHEN quality IS NULL THEN {FOLDS - 1} ELSE {FOLD} END AS fold "
         "FROM texts LEFT JOIN labels ON doc_id = id")


@query("score_cascade", "M15 M16 M17 F13", "texts",
       "SELECT id, subreddit, 1 AS class_I, round(p1, 6) AS conf_I, CASE greatest(label_0, label_1, label_2) WHEN label_0 THEN 0 "
       "WHEN label_1 THEN 1 ELSE 2 END AS class_II, greatest(label_0, label_1, label_2) AS conf_II FROM "
       "(SELECT id, max(p) FILTER (k = 0) AS p0, max(p) FILTER (k = 1) AS p1 FROM scores GROUP BY id) JOIN sc USING (id) "
       "JOIN texts USING (id) WHERE p1 > p0",
       f"{chances([BoostedTrees(nClasses=2, **TOPIC).setting(0, FOLDS - 1)], [TOPIC['maxIter']], 2, EVERY)}, {SCORED}")
def score_cascade(spark, d):
    """Stage I by boosted trees over all texts, stage II by a supplied model on what is on topic."""
    labels = V.table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    posts = V.texts(spark, d).select("id", "subreddit", "text", X.tokens(F.col("text")).alias("tokens"))
    train = M.with_folds(posts.join(labels, "id"), FOLDS).where(F.col("fold") < FOLDS - 1)
    vocab, length, ids = M.fitted_words(train)
    model = M.train_trees(M.with_features(train, vocab, length), 2, maxBins=BINS, valuesBelow=ids, **TOPIC)
    scored = M.cascade(posts, vocab, model, "text", stance_model, length=length)
    return scored.select("id", "subreddit", "class_I", F.round("conf_I", 6).alias("conf_I"), "class_II", "conf_II")


@query("logreg_scores", "M07 M12", "texts",
       f"SELECT id, y AS label, 1.0::DOUBLE AS total, true AS best FROM raw WHERE fold = {FOLDS - 1}", f"raw AS ({LABELLED})")
def logreg_scores(spark, d):
    """Logistic regression on the test fold: probabilities sum to one, the prediction is the best."""
    rows, _ = _features(spark, d)
    model = M.train_logreg(rows.where(F.col("fold") < FOLDS - 1), max_iter=15)
    scored = M.class_columns(model.transform(rows.where(F.col("fold") == FOLDS - 1)), CLASSES, "s_")
    names = [f"s_{k}" for k in range(CLASSES)]
    best = F.element_at(F.array(*names), (F.col("prediction") + 1).cast("int")) == F.greatest(*names)
    return scored.select("id", "label", F.round(F.expr(" + ".join(names)), 9).alias("total"), best.alias("best"))
