"""Classifier evaluation queries."""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from hearsay.operators import evaluation as E
from hearsay.operators import models as M
from hearsay.plans import views as V
from hearsay.plans.network_queries import r9
from hearsay.plans.registry import query

SCORES = ["s_0", "s_1", "s_2"]
PRED = """p AS (SELECT *, CASE greatest(s_0, s_1, s_2) WHEN s_0 THEN 0 WHEN s_1 THEN 1 ELSE 2 END AS pred
    FROM preds)"""
LONG = """cells AS (SELECT 0 AS cls, s_0 AS s, CAST(y = 0 AS INTEGER) AS pos FROM preds UNION ALL
    SELECT 1, s_1, CAST(y = 1 AS INTEGER) FROM preds UNION ALL
    SELECT 2, s_2, CAST(y = 2 AS INTEGER) FROM preds)"""
# exact area by ranks: (sum of positive ranks - P (P + 1) / 2) / (P N), ties at the mean rank
RANKED = """rk AS (SELECT *, rank() OVER (PARTITION BY {g} ORDER BY s)
    + (count(*) OVER (PARTITION BY {g}, s) - 1) / 2.0 AS r FROM {t}),
    area AS (SELECT {g}, (sum(r * pos) - sum(pos) * (sum(pos) + 1) / 2.0)
      / (sum(pos) * (count(*) - sum(pos))) AS auc FROM rk GROUP BY {g})"""
PAIRS = "pairs AS (" + " UNION ALL ".join(
    f"SELECT {a} AS a, {b} AS b, s_{a} AS s, CAST(y = {a} AS INTEGER) AS pos FROM preds WHERE y IN ({a}, {b})"
    for a in range(3) for b in range(3) if a != b) + ")"


def curve(cells: str, g: str) -> str:
    """Exact ROC points with points on straight lines dropped, in SQL."""
    return f"""cnt AS (SELECT {g}, s, sum(pos) AS pos, count(*) - sum(pos) AS neg FROM {cells} GROUP BY {g}, s),
    run AS (SELECT *, sum(pos) OVER w AS tps, sum(neg) OVER w AS fps, lead(pos) OVER o AS np,
      lead(neg) OVER o AS nn, row_number() OVER o AS rn, sum(pos) OVER (PARTITION BY {g}) AS p,
      sum(neg) OVER (PARTITION BY {g}) AS n FROM cnt WINDOW o AS (PARTITION BY {g} ORDER BY s DESC),
      w AS (PARTITION BY {g} ORDER BY s DESC ROWS UNBOUNDED PRECEDING)),
    roc AS (SELECT {g}, CAST(fps AS DOUBLE) / n AS fpr, CAST(tps AS DOUBLE) / p AS tpr FROM run
      WHERE rn = 1 OR np IS NULL OR np <> pos OR nn <> neg
      UNION ALL SELECT DISTINCT {g}, 0.0::DOUBLE, 0.0::DOUBLE FROM run)"""


def _preds(spark, d):
    return E.with_prediction(V.preds(spark, d), SCORES)


@query("confusion", "E01", "preds",
       "SELECT c.y, count(CASE WHEN pred = 0 THEN 1 END) AS pred_0, count(CASE WHEN pred = 1 THEN 1 END) "
       "AS pred_1, count(CASE WHEN pred = 2 THEN 1 END) AS pred_2 FROM (SELECT CAST(unnest(range(3)) AS "
       "INTEGER) AS y) c LEFT JOIN p ON p.y = c.y GROUP BY 1", PRED)
def confusion(spark, d):
    return E.confusion(_preds(spark, d), 3)


@query("confusion_norm", "E02", "preds",
       "SELECT y, " + ", ".join(f"round(count(CASE WHEN pred = {j} THEN 1 END) / count(*)::DOUBLE, 9) "
                               f"AS pred_{j}" for j in range(3)) + " FROM p GROUP BY 1", PRED)
def confusion_norm(spark, d):
    return r9(E.confusion_norm(_preds(spark, d), 3), "pred_0", "pred_1", "pred_2")


@query("accuracy_f1", "E03 E04", "preds",
       "SELECT round((SELECT avg(CAST(y = pred AS INTEGER)) FROM p), 9) AS accuracy, "
       + ", ".join(f"round(max(CASE WHEN c = {i} THEN f END), 9) AS f1_{i}" for i in range(3))
       + ", round(avg(f), 9) AS macro_f1 FROM (SELECT c, coalesce(2.0 * (SELECT count(*) FROM p WHERE "
       "y = c AND pred = c) / nullif((SELECT count(*) FROM p WHERE y = c) + (SELECT count(*) FROM p "
       "WHERE pred = c), 0), 0)::DOUBLE AS f FROM (SELECT unnest(range(3)) AS c))", PRED)
def accuracy_f1(spark, d):
    out = E.accuracy_f1(_preds(spark, d), 3)
    return r9(out, *out.columns)


@query("roc_points", "E05 W09", "preds",
       "SELECT cls, round(fpr, 9) AS fpr, round(tpr, 9) AS tpr FROM roc", LONG + ", " + curve("cells", "cls"))
def roc_points(spark, d):
    points = E.roc(E.one_vs_rest(V.preds(spark, d), SCORES))
    return r9(points.select("cls", "fpr", "tpr"), "fpr", "tpr")


@query("roc_binary", "E05 W09", "preds_binary",
       "SELECT round(fpr, 9) AS fpr, round(tpr, 9) AS tpr FROM roc",
       "cells AS (SELECT 0 AS one, s, y AS pos FROM preds_binary), " + curve("cells", "one"))
def roc_binary(spark, d):
    points = E.roc(E.binary(V.preds_binary(spark, d)), ())
    return r9(points.select("fpr", "tpr"), "fpr", "tpr")


@query("auc_binary", "E06", "preds_binary", "SELECT round(auc, 9) AS auc FROM area",
       "cells AS (SELECT 0 AS one, s, y AS pos FROM preds_binary), " + RANKED.format(g="one", t="cells"))
def auc_binary(spark, d):
    return r9(E.auc(E.binary(V.preds_binary(spark, d))), "auc")


@query("auc_per_class", "E06", "preds", "SELECT cls, round(auc, 9) AS auc FROM area",
       LONG + ", " + RANKED.format(g="cls", t="cells"))
def auc_per_class(spark, d):
    return r9(E.auc_per_class(V.preds(spark, d), SCORES), "auc")


@query("auc_micro", "E06", "preds", "SELECT round(auc, 9) AS auc FROM area",
       LONG + ", pool AS (SELECT 0 AS one, s, pos FROM cells), " + RANKED.format(g="one", t="pool"))
def auc_micro(spark, d):
    return r9(E.auc_micro(V.preds(spark, d), SCORES), "auc")


@query("auc_hardened", "E06 F14", "preds", "SELECT round(avg(auc), 9) AS auc FROM area",
       "hard AS (" + " UNION ALL ".join(
           f"SELECT {i} AS cls, CAST(s_{i} = greatest(s_0, s_1, s_2) AS INTEGER) AS s, "
           f"CAST(y = {i} AS INTEGER) AS pos FROM preds" for i in range(3)) + "), "
       + RANKED.format(g="cls", t="hard"))
def auc_hardened(spark, d):
    return r9(E.auc_hardened(V.preds(spark, d), SCORES), "auc")


@query("auc_ovr", "E07", "preds", "SELECT round(avg(auc), 9) AS auc FROM area",
       LONG + ", " + RANKED.format(g="cls", t="cells"))
def auc_ovr(spark, d):
    return r9(E.auc_ovr(V.preds(spark, d), SCORES), "auc")


@query("auc_ovo", "E07 D06", "preds", "SELECT round(avg(auc), 9) AS auc FROM area",
       PAIRS + ", " + RANKED.format(g="a, b", t="pairs"))
def auc_ovo(spark, d):
    return r9(E.auc_ovo(V.preds(spark, d), SCORES), "auc")


MACRO = """own AS (SELECT cls, fpr AS x, min(tpr) AS f, max(tpr) AS l FROM roc GROUP BY 1, 2),
    grid AS (SELECT DISTINCT fpr AS x FROM roc),
    cell AS (SELECT c.cls, g.x, (SELECT l FROM own o WHERE o.cls = c.cls AND o.x = g.x) AS here,
      (SELECT max(x) FROM own o WHERE o.cls = c.cls AND o.x < g.x) AS x0,
      (SELECT min(x) FROM own o WHERE o.cls = c.cls AND o.x > g.x) AS x1
      FROM grid g, (SELECT unnest([0, 1, 2]) AS cls) c),
    mean AS (SELECT c.x, avg(coalesce(here, a.l + (b.f - a.l) * (c.x - x0) / (x1 - x0))) AS y FROM cell c
      LEFT JOIN own a ON a.cls = c.cls AND a.x = x0 LEFT JOIN own b ON b.cls = c.cls AND b.x = x1
      GROUP BY 1)"""


@query("macro_roc", "E08 J17", "preds",
       "SELECT round(x, 9) AS fpr, round(y, 9) AS tpr FROM mean",
       LONG + ", " + curve("cells", "cls") + ", " + MACRO)
def macro_roc(spark, d):
    points = E.roc(E.one_vs_rest(V.preds(spark, d), SCORES))
    return r9(E.macro_roc(points, 3), "fpr", "tpr")


@query("macro_roc_auc", "E08 E06", "preds",
       "SELECT round(sum((nx - x) * (ny + y) / 2), 9) AS auc FROM (SELECT x, y, lead(x) OVER (ORDER BY x) "
       "AS nx, lead(y) OVER (ORDER BY x) AS ny FROM mean)",
       LONG + ", " + curve("cells", "cls") + ", " + MACRO)
def macro_roc_auc(spark, d):
    points = E.roc(E.one_vs_rest(V.preds(spark, d), SCORES))
    return r9(E.curve_auc(E.macro_roc(points, 3)), "auc")


def _models(spark, d):
    """Two prediction sources: the scores and the scores shifted by one class."""
    preds = V.preds(spark, d)
    turned = preds.select("id", "y", F.col("s_1").alias("s_0"), F.col("s_2").alias("s_1"),
                          F.col("s_0").alias("s_2"))
    return preds.withColumn("model", F.lit("base")).unionByName(
        turned.withColumn("model", F.lit("turned")))


MODELS = """ms AS (SELECT 'base' AS model, y, s_0, s_1, s_2 FROM preds UNION ALL
      SELECT 'turned', y, s_1, s_2, s_0 FROM preds),
    mp AS (SELECT *, CASE greatest(s_0, s_1, s_2) WHEN s_0 THEN 0 WHEN s_1 THEN 1 ELSE 2 END AS pred FROM ms),
    f1 AS (SELECT model, avg(f) AS macro_f1 FROM (SELECT model, c, coalesce(2.0 * count(CASE WHEN y = c AND
      pred = c THEN 1 END) / nullif(count(CASE WHEN y = c THEN 1 END) + count(CASE WHEN pred = c THEN 1 END),
      0), 0)::DOUBLE AS f FROM mp, (SELECT unnest(range(3)) AS c) GROUP BY 1, 2) GROUP BY 1),
    acc AS (SELECT model, avg(CAST(y = pred AS INTEGER)) AS accuracy FROM mp GROUP BY 1),
    cells AS (""" + " UNION ALL ".join(
    f"SELECT 'r' AS kind, model, {i} AS a, -1 AS b, s_{i} AS s, CAST(y = {i} AS INTEGER) AS pos FROM ms "
    f"UNION ALL SELECT 'm', model, -1, -1, s_{i}, CAST(y = {i} AS INTEGER) FROM ms" for i in range(3)) \
    + " UNION ALL " + " UNION ALL ".join(
    f"SELECT 'o', model, {a}, {b}, s_{a}, CAST(y = {a} AS INTEGER) FROM ms WHERE y IN ({a}, {b})"
    for a in range(3) for b in range(3) if a != b) + "), " + RANKED.format(g="kind, model, a, b", t="cells")


@query("model_comparison", "E11 E09", "preds",
       "SELECT model, round(accuracy, 9) AS accuracy, round(macro_f1, 9) AS macro_f1, "
       "round(avg(CASE WHEN kind = 'o' THEN auc END), 9) AS auc_ovo, "
       "round(avg(CASE WHEN kind = 'r' THEN auc END), 9) AS auc_ovr, "
       "round(avg(CASE WHEN kind = 'm' THEN auc END), 9) AS auc_micro "
       "FROM area JOIN acc USING (model) JOIN f1 USING (model) GROUP BY 1, 2, 3", MODELS)
def model_comparison(spark, d):
    out = E.compare(_models(spark, d), SCORES)
    return r9(out, "accuracy", "macro_f1", "auc_ovo", "auc_ovr", "auc_micro")


REPORT = (PRED + ", " + LONG + ", " + curve("cells", "cls") + ", " + MACRO + ", " + RANKED.format(g="cls", t="cells")
          + ", pool AS (SELECT 0 AS one, s, pos FROM cells), "
          + RANKED.format(g="one", t="pool").replace("rk AS", "rk_m AS").replace("FROM rk ", "FROM rk_m ").replace("area AS", "area_m AS")
          + ", hard AS (" + " UNION ALL ".join(
              f"SELECT {i} AS cls, CAST(s_{i} = greatest(s_0, s_1, s_2) AS INTEGER) AS s, CAST(y = {i} AS INTEGER) AS pos FROM preds"
              for i in range(3)) + "), "
          + RANKED.format(g="cls", t="hard").replace("rk AS", "rk_h AS").replace("FROM rk ", "FROM rk_h ").replace("area AS", "area_h AS")
          + ", conf AS (SELECT t.c AS y, q.c AS pred, count(p.y) AS n FROM (SELECT unnest(range(3)) AS c) t CROSS JOIN "
            "(SELECT unnest(range(3)) AS c) q LEFT JOIN p ON p.y = t.c AND p.pred = q.c GROUP BY 1, 2)")


@query("evaluation_report", "E09", "preds", """
    SELECT 'confusion' AS "table", CAST(y AS INTEGER) AS a, CAST(pred AS INTEGER) AS b, NULL::DOUBLE AS x, n::DOUBLE AS value FROM conf
    UNION ALL SELECT 'confusion_norm', y, pred, NULL, round(n / nullif(sum(n) OVER (PARTITION BY y), 0)::DOUBLE, 9) FROM conf
    UNION ALL SELECT 'accuracy', NULL, NULL, NULL, round(avg(CAST(y = pred AS INTEGER)), 9) FROM p
    UNION ALL SELECT 'f1', c, NULL, NULL, round(f, 9) FROM (SELECT c, coalesce(2.0 * (SELECT count(*) FROM p WHERE y = c AND pred = c)
      / nullif((SELECT count(*) FROM p WHERE y = c) + (SELECT count(*) FROM p WHERE pred = c), 0), 0)::DOUBLE AS f
      FROM (SELECT unnest(range(3)) AS c))
    UNION ALL SELECT 'roc', cls, NULL, round(fpr, 9), round(tpr, 9) FROM roc
    UNION ALL SELECT 'roc_macro', NULL, NULL, round(x, 9), round(y, 9) FROM mean
    UNION ALL SELECT 'auc', cls, NULL, NULL, round(auc, 9) FROM area
    UNION ALL SELECT 'auc_micro', NULL, NULL, NULL, round(auc, 9) FROM area_m
    UNION ALL SELECT 'auc_macro', NULL, NULL, NULL, round(sum((nx - x) * (ny + y) / 2), 9) FROM
      (SELECT x, y, lead(x) OVER (ORDER BY x) AS nx, lead(y) OVER (ORDER BY x) AS ny FROM mean)
    UNION ALL SELECT 'auc_hardened', NULL, NULL, NULL, round(avg(auc), 9) FROM area_h""", REPORT)
def evaluation_report(spark, d):
    """All tables of the report as rows ``(table, a, b, x, value)``."""
    t = E.report(V.preds(spark, d), SCORES)
    none = lambda kind: F.lit(None).cast(kind)

    def rows(name, table, value, a=None, b=None, x=None):
        return table.select(F.lit(name).alias("table"), (a if a is not None else none("long")).cast("long").alias("a"),
                            (b if b is not None else none("long")).cast("long").alias("b"),
                            F.round(x, 9).alias("x") if x is not None else none("double").alias("x"),
                            F.round(value.cast("double"), 9).alias("value"))

    long = lambda table: table.select("y", F.posexplode(F.array(*[F.col(f"pred_{j}").cast("double") for j in range(3)])).alias("pred", "v"))
    parts = [rows(n, long(t[n]), F.col("v"), F.col("y"), F.col("pred")) for n in ("confusion", "confusion_norm")]
    parts.append(rows("accuracy", t["scores"], F.col("accuracy")))
    parts.append(rows("f1", t["scores"].select(F.posexplode(F.array("f1_0", "f1_1", "f1_2")).alias("c", "v")), F.col("v"), F.col("c")))
    parts.append(rows("roc", t["roc"], F.col("tpr"), F.col("cls"), x=F.col("fpr")))
    parts.append(rows("roc_macro", t["roc_macro"], F.col("tpr"), x=F.col("fpr")))
    parts.append(rows("auc", t["auc"], F.col("auc"), F.col("cls")))
    parts += [rows(n, t[n], F.col("auc")) for n in ("auc_micro", "auc_macro", "auc_hardened")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("metric_callback", "D06 E07", "preds", "SELECT 'auc_ovo' AS metric, round(avg(auc), 9) AS value FROM area",
       PAIRS + ", " + RANKED.format(g="a, b", t="pairs"))
def metric_callback(spark, d):
    """The metric that a search calls, on a probability vector."""
    scored = V.preds(spark, d).select(F.col("y").alias("label"), array_to_vector(F.array(*SCORES)).alias("probability"))
    value = M.AucOvoEvaluator(3).evaluate(scored)
    return spark.createDataFrame([("auc_ovo", round(value, 9))], "metric string, value double")


# the first 13 hexadecimal digits of a digest as a number in [0, 1), as the operator draws them
BOOT = ", ".join(repr(x) + "::DOUBLE" for x in accumulate(math.exp(-1) / math.factorial(k) for k in range(18)))


@query("bootstrap_metric", "E10", "preds", f"""
    SELECT 'accuracy' AS metric, round((SELECT avg(CAST(y = pred AS INTEGER)) FROM p), 9) AS score,
      round(stddev_samp(v), 9) AS standard_error, round(quantile_cont(v, 0.025), 9) AS low, round(quantile_cont(v, 0.975), 9) AS high
    FROM (SELECT resample, sum(CASE WHEN y = pred THEN w ELSE 0 END) / sum(w)::DOUBLE AS v FROM
      (SELECT *, len(list_filter([{BOOT}], lambda t: ('0x' || substr(md5(id || '|' || resample || '|42'), 1, 13))::BIGINT
        / {float(16 ** 13)!r}::DOUBLE >= t)) AS w FROM p, range(0, 10) r(resample)) GROUP BY resample)""", PRED)
def bootstrap_metric(spark, d):
    return r9(E.bootstrap(_preds(spark, d), 3), "score", "standard_error", "low", "high")
