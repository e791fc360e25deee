"""Exact classifier evaluation as aggregates and running sums.

Scores are first counted per distinct value, so a curve costs its distinct scores,
and running sums are spread over value ranges (``operators.ordered``).
``group_cols`` evaluates several models in one pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearsay.operators import ordered as O
from hearsay.functions.scalar import argmax, is_max
from hearsay.operators.ordered import hash_fraction
from hearsay.session import cut_lineage


# ---------------------------------------------------------------- labels

def with_prediction(df: DataFrame, score_cols: Sequence[str], out_col: str = "pred") -> DataFrame:
    return df.withColumn(out_col, argmax(F.array(*score_cols)))


def harden(df: DataFrame, score_cols: Sequence[str]) -> DataFrame:
    """Scores -> 1.0 where a score is the row maximum."""
    flags = is_max(F.array(*score_cols))
    return df.withColumns({c: flags[i].cast("double") for i, c in enumerate(score_cols)})


def confusion(df: DataFrame, n_classes: int, y: str = "y", pred: str = "pred",
              group_cols: Sequence[str] = ()) -> DataFrame:
    """Counts by true class (rows) and predicted class (columns), zeros included."""
    cells = [F.count_if((F.col(y) == i) & (F.col(pred) == j)).alias(f"{i}_{j}")
             for i in range(n_classes) for j in range(n_classes)]
    flat = df.groupBy(*group_cols).agg(*cells) if group_cols else df.agg(*cells)
    rows = F.array(*[F.struct(F.lit(i).alias("y"), *[F.col(f"{i}_{j}").alias(f"pred_{j}")
                                                    for j in range(n_classes)])
                     for i in range(n_classes)])
    return flat.select(*group_cols, F.inline(rows))


def confusion_norm(df: DataFrame, n_classes: int, y: str = "y", pred: str = "pred",
                   group_cols: Sequence[str] = ()) -> DataFrame:
    """Confusion matrix with rows summing to one."""
    table = confusion(df, n_classes, y, pred, group_cols)
    names = [f"pred_{j}" for j in range(n_classes)]
    total = F.expr(" + ".join(names))
    return table.select(*group_cols, "y", *[
        (F.col(n) / F.nullif(total, F.lit(0))).alias(n) for n in names])


def accuracy_f1(df: DataFrame, n_classes: int, y: str = "y", pred: str = "pred",
                group_cols: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """Accuracy, F1 per class (undefined is 0) and macro F1 from one aggregate."""
    w = F.lit(1) if weight is None else weight
    total = lambda cond: F.sum(F.when(cond, w).otherwise(F.lit(0)))
    f1 = []
    for i in range(n_classes):
        hit, true, said = (total((F.col(y) == i) & (F.col(pred) == i)), total(F.col(y) == i),
                           total(F.col(pred) == i))
        f1.append(F.coalesce(hit * 2.0 / F.nullif(true + said, F.lit(0)), F.lit(0.0)))
    mean = sum(f1[1:], f1[0]) / n_classes
    accuracy = total(F.col(y) == F.col(pred)) / F.sum(w)
    aggs = [accuracy.alias("accuracy"), *[f.alias(f"f1_{i}") for i, f in enumerate(f1)],
            mean.alias("macro_f1")]
    return df.groupBy(*group_cols).agg(*aggs) if group_cols else df.agg(*aggs)


# ---------------------------------------------------------------- curves

def one_vs_rest(df: DataFrame, score_cols: Sequence[str], y: str = "y",
                group_cols: Sequence[str] = ()) -> DataFrame:
    """Counts of positives and negatives per class and score."""
    cells = F.array(*[F.struct(F.lit(i).alias("cls"), F.col(c).cast("double").alias("s"),
                               (F.col(y) == i).alias("pos")) for i, c in enumerate(score_cols)])
    return _score_counts(df.select(*group_cols, F.inline(cells)), [*group_cols, "cls"])


def pooled(df: DataFrame, score_cols: Sequence[str], y: str = "y",
           group_cols: Sequence[str] = ()) -> DataFrame:
    """All cells of the indicator and score matrices as one binary problem."""
    cells = F.array(*[F.struct(F.col(c).cast("double").alias("s"), (F.col(y) == i).alias("pos"))
                      for i, c in enumerate(score_cols)])
    return _score_counts(df.select(*group_cols, F.inline(cells)), group_cols)


def one_vs_one(df: DataFrame, score_cols: Sequence[str], y: str = "y",
               group_cols: Sequence[str] = ()) -> DataFrame:
    """Counts per ordered class pair: rows of both classes by the first one's score.

    A row of class c is a positive of every (c, other) and a negative of every
    (other, c): 2(k - 1) cells per row, however many rows there are.
    """
    cells = []
    for a, c in enumerate(score_cols):
        for b in range(len(score_cols)):
            if a != b:
                cells.append(F.when(F.col(y).isin(a, b), F.struct(
                    F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(c).cast("double").alias("s"),
                    (F.col(y) == a).alias("pos"))))
    cells = F.filter(F.array(*cells), lambda x: x.isNotNull())
    return _score_counts(df.select(*group_cols, F.inline(cells)), [*group_cols, "a", "b"])


def binary(df: DataFrame, score: str = "s", y: str = "y",
           group_cols: Sequence[str] = ()) -> DataFrame:
    return _score_counts(df.select(*group_cols, F.col(score).cast("double").alias("s"),
                                   (F.col(y) == 1).alias("pos")), group_cols)


def _score_counts(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    return cells.groupBy(*keys, "s").agg(F.count_if("pos").alias("pos"),
                                         F.count_if(~F.col("pos")).alias("neg"))


def roc(counts: DataFrame, group_cols: Sequence[str] = ("cls",), thin: bool = True) -> DataFrame:
    """ROC points by falling score, starting at (0, 0).

    ``thin`` drops points on a straight line: inner points whose next step adds
    the same positives and negatives.
    """
    keys = list(group_cols)
    down = counts.withColumn("_order", -F.col("s"))
    summed = O.running_totals(down, "_order", {"tps": "pos", "fps": "neg"}, keys, keep_range=True)
    ahead = O.next_row(summed, "_order", {"next_pos": "pos", "next_neg": "neg"}, keys)
    inner = ((F.col("tps") > F.col("pos")) | (F.col("fps") > F.col("neg"))) \
        & F.col("next_pos").isNotNull()
    straight = (F.col("next_pos") == F.col("pos")) & (F.col("next_neg") == F.col("neg"))
    kept = ahead.where(~(inner & straight)) if thin else ahead
    ends = counts.groupBy(*keys).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    start = ends.select(*keys, F.lit(0).cast("long").alias("tps"), F.lit(0).cast("long").alias("fps"),
                        F.lit(float("inf")).alias("threshold"))
    points = kept.select(*keys, "tps", "fps", F.col("s").alias("threshold")).unionByName(start)
    both = points.join(ends, keys) if keys else points.select(
        "*", ends.select("P").scalar().alias("P"), ends.select("N").scalar().alias("N"))
    return both.select(*keys, "threshold", (F.col("fps") / F.nullif("N", F.lit(0))).alias("fpr"),
                       (F.col("tps") / F.nullif("P", F.lit(0))).alias("tpr"))


def auc(counts: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Area under the exact ROC curve, ties by half; null when one side is empty."""
    keys = list(group_cols)
    above = O.running_totals(counts, "s", {"negs_upto": "neg"}, keys)
    won = F.sum(F.col("pos") * (F.col("negs_upto") - F.col("neg") / 2.0))
    area = won / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))
    return (above.groupBy(*keys).agg(area.alias("auc")) if keys else above.agg(area.alias("auc")))


def auc_per_class(df, score_cols, y="y", group_cols=()) -> DataFrame:
    return auc(one_vs_rest(df, score_cols, y, group_cols), [*group_cols, "cls"])


def _mean_auc(table: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    mean = F.avg("auc").alias("auc")
    return table.groupBy(*group_cols).agg(mean) if group_cols else table.agg(mean)


def auc_ovr(df, score_cols, y="y", group_cols=()) -> DataFrame:
    """Mean of the per-class areas."""
    return _mean_auc(auc_per_class(df, score_cols, y, group_cols), group_cols)


def auc_micro(df, score_cols, y="y", group_cols=()) -> DataFrame:
    return auc(pooled(df, score_cols, y, group_cols), group_cols)


def auc_ovo_pairs(df, score_cols, y="y", group_cols=()) -> DataFrame:
    """Mean area of both directions per unordered class pair."""
    table = auc(one_vs_one(df, score_cols, y, group_cols), [*group_cols, "a", "b"])
    return (table.groupBy(*group_cols, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            .agg(F.avg("auc").alias("auc")))


def auc_ovo(df, score_cols, y="y", group_cols=()) -> DataFrame:
    """Mean over class pairs."""
    return _mean_auc(auc_ovo_pairs(df, score_cols, y, group_cols), group_cols)


def auc_hardened(df, score_cols, y="y", group_cols=()) -> DataFrame:
    """Mean per-class area of the hardened predictions."""
    return auc_ovr(harden(df, score_cols), score_cols, y, group_cols)


def macro_roc(points: DataFrame, n_classes: int, cls: str = "cls") -> DataFrame:
    """Mean curve on the union of all false-positive rates.

    A class is interpolated linearly between its own points; at a vertical step
    the last value counts.
    """
    own = points.groupBy(cls, "fpr").agg(F.min("tpr").alias("first"), F.max("tpr").alias("last"))
    known = own.select(cls, "fpr", F.struct(F.col("fpr").alias("x"), "first", "last").alias("point"))
    classes = F.array(*[F.lit(i) for i in range(n_classes)])
    grid = points.select("fpr").distinct().select(F.explode(classes).alias(cls), "fpr",
                                                  F.lit(None).cast(known.schema["point"].dataType)
                                                  .alias("point"))
    cells = known.unionByName(grid).groupBy(cls, "fpr").agg(F.max("point").alias("point"))
    filled = O.fill_between(cells, "fpr", "point", [cls])
    x, a, b = F.col("fpr"), F.col("prev"), F.col("next")
    between = a["last"] + (b["first"] - a["last"]) * (x - a["x"]) / F.nullif(b["x"] - a["x"], F.lit(0.0))
    value = F.when(F.col("point").isNotNull(), F.col("point")["last"]).otherwise(between)
    return filled.select("fpr", value.alias("v")).groupBy("fpr").agg(F.avg("v").alias("tpr"))


def curve_auc(curve: DataFrame) -> DataFrame:
    """Trapezoid area of a curve with distinct x."""
    steps = O.next_row(curve, "fpr", {"x1": "fpr", "y1": "tpr"})
    area = (F.col("x1") - F.col("fpr")) * (F.col("y1") + F.col("tpr")) / 2
    return steps.agg(F.sum(area).alias("auc"))


# ---------------------------------------------------------------- reports

def bootstrap(df: DataFrame, n_classes: int, n_resamples: int = 10, id_cols: Sequence[str] = ("id",),
              metric: str = "accuracy", confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """Score, standard error and percentile interval of a metric over resamples.

    A row's weight in a resample is a Poisson(1) number drawn from its hash, so
    the draw needs no shuffle and repeats exactly.
    """
    resample = F.explode(F.sequence(F.lit(0), F.lit(n_resamples - 1)))
    u = hash_fraction([*id_cols, "resample"], seed)
    # Poisson(1) distribution function at 0, 1, 2, ...; beyond the last one u cannot reach
    weight, p, total = F.lit(0), 2.718281828459045 ** -1, 0.0
    for k in range(18):
        total += p
        weight = weight + F.when(u >= F.lit(total), 1).otherwise(0)
        p /= k + 1
    drawn = df.withColumn("resample", resample).withColumn("w", weight)
    runs = accuracy_f1(drawn, n_classes, group_cols=["resample"], weight=F.col("w"))
    tail = (1 - confidence) / 2
    whole = accuracy_f1(df, n_classes).select(metric).scalar()
    return runs.agg(F.lit(metric).alias("metric"), F.first(whole).alias("score"),
                    F.stddev_samp(metric).alias("standard_error"),
                    F.percentile(metric, tail).alias("low"),
                    F.percentile(metric, 1 - tail).alias("high"))


def tagged_cells(df: DataFrame, score_cols: Sequence[str], y: str = "y",
                 group_cols: Sequence[str] = ()) -> DataFrame:
    """Everything that the metrics of a model need, counted in one pass: rows ``(kind, a, b, s,
    pos, neg)``, written once.

    ``c`` true class a and predicted class b, ``r`` class a against the rest by score, ``h``
    the same by hardened score, ``m`` all cells pooled, ``o`` class a against class b.
    """
    scores = F.array(*[F.col(c).cast("double") for c in score_cols])
    flags, label = is_max(scores), F.col(y)
    cell = lambda kind, a, b, s, pos: F.struct(F.lit(kind).alias("kind"), F.lit(a).cast("int").alias("a") if isinstance(a, int)
                                               else a.cast("int").alias("a"), (F.lit(b) if isinstance(b, int) else b).cast("int").alias("b"),
                                               s.alias("s"), pos.alias("pos"))
    n = len(score_cols)
    cells = [cell("c", label, argmax(scores), F.lit(0.0), F.lit(True))]
    for i in range(n):
        cells += [cell("r", i, -1, scores[i], label == i), cell("m", -1, -1, scores[i], label == i),
                  cell("h", i, -1, flags[i].cast("double"), label == i)]
        cells += [F.when(label.isin(i, j), cell("o", i, j, scores[i], label == i)) for j in range(n) if j != i]
    told = df.select(*group_cols, F.inline(F.filter(F.array(*cells), lambda x: x.isNotNull())))
    return cut_lineage(_score_counts(told, [*group_cols, "kind", "a", "b"]))


def areas(counts: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """``(kind, a, b, auc)`` of all kinds from one running pass; both directions of a class
    pair are averaged, the smaller class first."""
    keys = [*group_cols, "kind"]
    every = auc(counts.where("kind <> 'c'"), [*keys, "a", "b"])
    pair = F.col("kind") == "o"
    return (every.groupBy(*keys, F.when(pair, F.least("a", "b")).otherwise(F.col("a")).alias("a"),
                          F.when(pair, F.greatest("a", "b")).otherwise(F.col("b")).alias("b"))
            .agg(F.avg("auc").alias("auc")))


def _hits(counts: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return counts.where("kind = 'c'").select(*keep, F.col("a").alias("y"), F.col("b").alias("pred"), F.col("pos").alias("w"))


def compare(df: DataFrame, score_cols: Sequence[str], model: str = "model",
            y: str = "y") -> DataFrame:
    """One row per model: accuracy, macro F1, one-vs-one, one-vs-rest and micro areas."""
    counts = tagged_cells(df, score_cols, y, [model])
    basic = accuracy_f1(_hits(counts, [model]), len(score_cols), group_cols=[model], weight=F.col("w"))
    mean = lambda kind: F.avg(F.when(F.col("kind") == kind, F.col("auc")))
    wide = areas(counts, [model]).groupBy(model).agg(
        mean("o").alias("auc_ovo"), mean("r").alias("auc_ovr"), mean("m").alias("auc_micro"))
    return basic.select(model, "accuracy", "macro_f1").join(wide, model)


def report(df: DataFrame, score_cols: Sequence[str], y: str = "y") -> dict[str, DataFrame]:
    """The tables behind one evaluation page of a 2- or 3-class model, from one scan."""
    n = len(score_cols)
    counts = tagged_cells(df, score_cols, y)
    hits = _hits(counts)
    matrix = hits.groupBy("y").pivot("pred", list(range(n))).agg(F.sum("w"))
    names = [f"pred_{j}" for j in range(n)]
    full = (df.sparkSession.range(n).select(F.col("id").cast("int").alias("y")).join(matrix, "y", "left")
            .select("y", *[F.coalesce(str(j), F.lit(0)).alias(f"pred_{j}") for j in range(n)]))
    total = F.expr(" + ".join(names))
    points = cut_lineage(roc(counts.where("kind = 'r'").withColumnRenamed("a", "cls").drop("kind", "b")))
    macro = macro_roc(points, n)
    told = cut_lineage(areas(counts))
    mean = lambda kind: told.where(F.col("kind") == kind).agg(F.avg("auc").alias("auc"))
    return {
        "confusion": full,
        "confusion_norm": full.select("y", *[(F.col(c) / F.nullif(total, F.lit(0))).alias(c) for c in names]),
        "scores": accuracy_f1(hits, n, weight=F.col("w")),
        "roc": points,
        "roc_macro": macro,
        "auc": told.where("kind = 'r'").select(F.col("a").alias("cls"), "auc"),
        "auc_micro": mean("m"),
        "auc_macro": curve_auc(macro),
        "auc_hardened": mean("h"),
    }
