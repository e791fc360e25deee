"""Training, model selection and batch scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from itertools import product

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearsay.functions.scalar import argmax, label_from_name
from hearsay.operators import boosting as B
from hearsay.operators import evaluation as E
from hearsay.operators import features as FE
from hearsay.operators.bundle import BoostedTrees
from hearsay.operators.ordered import hash_fraction
from hearsay.session import cut_lineage

SCORING_BATCH = 128  # fixed value: rows per model call of the published scorer

# Grid of the published search (depth, rate, trees, column sample).
TREE_GRID = {
    "maxDepth": [3, 5, 6, 8, 10],
    "stepSize": [0.01, 0.05, 0.1],
    "maxIter": [100, 500, 1000],
    "featureSubsetStrategy": ["0.5", "0.7", "1.0"],  # share of the features per tree
}


# ---------------------------------------------------------------- features

def with_features(df: DataFrame, vocab: DataFrame, length: int = FE.PADDED_LENGTH,
                  id_cols: Sequence[str] = ("id",), token_col: str = "tokens") -> DataFrame:
    """Words -> ids -> padded ids -> vector; the same vocabulary at fit and score time."""
    coded = FE.encode(df, vocab, id_cols, token_col, "_ids", last=length)
    padded = FE.pad(F.col("_ids"), length).cast("array<double>")
    return coded.withColumn("features", array_to_vector(padded)).drop("_ids")


def fitted_words(train: DataFrame, token_col: str = "tokens") -> tuple[DataFrame, int, int]:
    """Vocabulary, padded length (95 % statistic) and number of word ids of training rows."""
    vocab = FE.stored_vocabulary(train, token_col)
    length = FE.max_length(train.select(F.size(token_col).cast("long").alias("n")), "n").first()[0]
    return vocab, int(length or 1), FE.FIRST_ID + vocab.count()


def fitted_features(df: DataFrame, is_train: Column, id_cols: Sequence[str] = ("id",),
                    token_col: str = "tokens") -> tuple[DataFrame, int]:
    """All rows as vectors, by vocabulary and padded length (95 % statistic) of the training
    rows alone, written once; and the number of word ids in use."""
    vocab, length, ids = fitted_words(df.where(is_train), token_col)
    return cut_lineage(with_features(df, vocab, length, id_cols, token_col).drop(token_col)), ids


def class_columns(df: DataFrame, n_classes: int, prefix: str = "label_",
                  probability: str = "probability") -> DataFrame:
    """Probability vector -> one column per class."""
    p = vector_to_array(probability)
    return df.select("*", *[p[i].alias(f"{prefix}{i}") for i in range(n_classes)])


# ---------------------------------------------------------------- training

def train_logreg(train: DataFrame, label: str = "label", max_iter: int = 100) -> PipelineModel:
    stage = LogisticRegression(labelCol=label, featuresCol="features", maxIter=max_iter,
                               family="multinomial")
    return Pipeline(stages=[stage]).fit(train)


def tree_estimator(n_classes: int, label: str = "label", seed: int = 42, **params) -> BoostedTrees:
    """Boosted trees with class probabilities for any number of classes."""
    return BoostedTrees(nClasses=n_classes, labelCol=label, seed=seed, **params)


def train_trees(train: DataFrame, n_classes: int, label: str = "label", seed: int = 42,
                **params) -> PipelineModel:
    return Pipeline(stages=[tree_estimator(n_classes, label, seed, **params)]).fit(train)


def train_one_vs_rest(train: DataFrame, label: str = "label", seed: int = 42, **params):
    """One boosted model per class."""
    base = GBTClassifier(labelCol=label, featuresCol="features", seed=seed, **params)
    return OneVsRest(classifier=base, labelCol=label, featuresCol="features").fit(train)


def with_folds(df: DataFrame, n_folds: int = 5, id_cols: Sequence[str] = ("id",),
               seed: int = 42, out_col: str = "fold") -> DataFrame:
    """Fold number by hash: the same row is always in the same fold."""
    return df.withColumn(out_col, F.floor(hash_fraction(id_cols, seed) * n_folds).cast("int"))


class AucOvoEvaluator(Evaluator):
    """One-vs-one area of the probability column as a Spark ML metric."""

    def __init__(self, n_classes: int, label: str = "label", probability: str = "probability"):
        super().__init__()
        self.n_classes, self.label, self.probability = n_classes, label, probability

    def _evaluate(self, dataset: DataFrame) -> float:
        scored = class_columns(dataset, self.n_classes, "_s_", self.probability)
        names = [f"_s_{i}" for i in range(self.n_classes)]
        value = E.auc_ovo(scored, names, self.label).first()[0]
        return float("nan") if value is None else float(value)

    def isLargerBetter(self) -> bool:
        return True


def _staged_scores(df: DataFrame, base: BoostedTrees, settings: Sequence[B.Setting], label: str,
                   n_folds: int, seed: int) -> DataFrame:
    """Rows ``(model, rounds, y, s_0, ...)``: every row scored by the models that left its fold
    out, after every round, to nine digits; one fit for all settings."""
    n = base.getOrDefault(base.nClasses)
    cuts = base.cuts(df)
    bins = B.binned(vector_to_array(base.getFeaturesCol()), cuts).alias("bins")
    rows = cut_lineage(with_folds(df, n_folds, seed=seed).select(bins, F.col(label).cast("int").alias("label"), "fold"))
    forest = B.fit(rows, n, settings, base.getOrDefault(base.maxBins))
    scored = B.staged(rows, forest, settings)
    return cut_lineage(scored.select("model", "rounds", "fold", F.col("label").alias("y"),
                                     *[F.round(F.col("p")[i], 9).alias(f"s_{i}") for i in range(n)]))


def boosting_curve(df: DataFrame, n_classes: int, rounds: int, label: str = "label",
                   n_folds: int = 5, seed: int = 42, **params) -> DataFrame:
    """Mean and deviation over folds of the one-vs-one area after every round.

    All folds are fitted in lock-step, once; the areas of all rounds come from the running
    sums of the trees' outputs.
    """
    base = tree_estimator(n_classes, label, seed, maxIter=rounds, **params)
    settings = [base.setting(fold, fold) for fold in range(n_folds)]
    scored = _staged_scores(df, base, settings, label, n_folds, seed)
    areas = E.auc_ovo(scored, [f"s_{i}" for i in range(n_classes)], group_cols=["fold", "rounds"])
    return areas.groupBy("rounds").agg(F.avg("auc").alias("auc_mean"), F.stddev_samp("auc").alias("auc_std"))


def combinations(grid: Mapping[str, Sequence]) -> list[dict]:
    """All settings of a grid but the numbers of rounds, which one fit answers together."""
    names = [n for n in grid if n != "maxIter"]
    return [dict(zip(names, values)) for values in product(*[grid[n] for n in names])]


def setting_name(values: Mapping) -> str:
    return ", ".join(f"{k}={v}" for k, v in sorted(values.items()))


def grid_settings(base: BoostedTrees, grid: Mapping[str, Sequence], n_folds: int) -> tuple[list[dict], list[B.Setting]]:
    """Combinations, and for each of them one model per fold that is left out."""
    found, settings = combinations(grid), []
    for i, values in enumerate(found):
        own = base.copy({base.getParam(k): v for k, v in values.items()})
        settings += [own.setting(i * n_folds + fold, fold) for fold in range(n_folds)]
    return found, settings


def search_trees(df: DataFrame, n_classes: int, grid: Mapping[str, Sequence] = TREE_GRID, label: str = "label",
                 n_folds: int = 5, seed: int = 42, **params) -> DataFrame:
    """One row per combination: its parameters, mean area over folds and rank.

    Combinations and folds grow in lock-step; numbers of rounds cost nothing extra, as the
    largest is fitted and the others are read from it.
    """
    stops = sorted(grid.get("maxIter", [100]))
    base = tree_estimator(n_classes, label, seed, maxIter=stops[-1], **params)
    found, settings = grid_settings(base, grid, n_folds)
    scored = (_staged_scores(df, base, settings, label, n_folds, seed).where(F.col("rounds").isin(stops))
              .withColumn("c", F.floor(F.col("model") / n_folds).cast("int")))
    areas = E.auc_ovo(scored, [f"s_{i}" for i in range(n_classes)], group_cols=["c", "rounds", "fold"])
    told = F.element_at(F.array(*[F.lit(setting_name(c)) for c in found]), F.col("c") + 1)
    best_first = Window.partitionBy(F.lit(0)).orderBy(F.desc("mean_metric"))  # one row per setting
    return (areas.groupBy("c", "rounds").agg(F.round(F.avg("auc"), 6).alias("mean_metric"))
            .select(told.alias("params"), F.col("rounds").alias("maxIter"), "mean_metric")
            .withColumn("rank", F.rank().over(best_first)))


def grid_search(train: DataFrame, n_classes: int, grid: Mapping[str, Sequence] = TREE_GRID,
                label: str = "label", n_folds: int = 5, parallelism: int = 4,
                seed: int = 42) -> CrossValidatorModel:
    """Cross-validated search scored by the one-vs-one area; folds by hash."""
    base = tree_estimator(n_classes, label, seed)
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(base.getParam(name), list(values))
    search = CrossValidator(estimator=base, estimatorParamMaps=builder.build(),
                            evaluator=AucOvoEvaluator(n_classes, label), numFolds=n_folds,
                            parallelism=parallelism, foldCol="fold", seed=seed)
    return search.fit(with_folds(train, n_folds, seed=seed))


def grid_results(spark: SparkSession, found: CrossValidatorModel) -> DataFrame:
    """One row per parameter combination with its mean metric and rank."""
    rows = []
    for params, mean in zip(found.getEstimatorParamMaps(), found.avgMetrics):
        named = ", ".join(f"{p.name}={v}" for p, v in sorted(params.items(), key=lambda x: x[0].name))
        rows.append((named, float(mean)))
    table = spark.createDataFrame(rows, "params string, mean_metric double")
    best_first = Window.partitionBy(F.lit(0)).orderBy(F.desc("mean_metric"))  # one row per setting
    return table.withColumn("rank", F.rank().over(best_first))


# ---------------------------------------------------------------- scoring

ModelFactory = Callable[[], Callable[[Sequence[str]], Sequence[Sequence[float]]]]


def score_batches(df: DataFrame, text_col: str, load_model: ModelFactory, n_classes: int,
                  batch_size: int = SCORING_BATCH, prefix: str = "label_") -> DataFrame:
    """Probabilities per class from a user's model function.

    The model is loaded once per task and called on batches of texts.  Only the
    text column crosses to Python; all other columns stay in the JVM.
    """

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load_model()
        for texts in batches:
            values = texts.tolist()
            out: list = []
            for i in range(0, len(values), batch_size):
                out.extend(np.asarray(model(values[i:i + batch_size]), dtype=float))
            yield pd.Series(out)

    scored = df.withColumn("_p", score(F.col(text_col)))
    return scored.select(*df.columns, *[F.col("_p")[i].alias(f"{prefix}{i}")
                                        for i in range(n_classes)])


def top_label(df: DataFrame, n_classes: int, prefix: str = "label_", pred: str = "pred_1",
              conf: str = "conf_1", names: Sequence[str] | None = None) -> DataFrame:
    """Best class, its number read from the class name, and its score."""
    names = names or [f"LABEL_{i}" for i in range(n_classes)]
    scores = F.array(*[f"{prefix}{i}" for i in range(n_classes)])
    name = F.get(F.array(*[F.lit(n) for n in names]), argmax(scores))
    return df.withColumn(pred, label_from_name(name)).withColumn(conf, F.array_max(scores))


def stage_one(df: DataFrame, vocab: DataFrame, model: PipelineModel,
              length: int = FE.PADDED_LENGTH, keep: bool = True) -> DataFrame:
    """Topic class and its confidence; ``keep`` leaves only on-topic rows."""
    scored = class_columns(model.transform(with_features(df, vocab, length)), 2, "_t_")
    scores = F.array("_t_0", "_t_1")
    out = scored.withColumn("class_I", argmax(scores)).withColumn("conf_I", F.array_max(scores))
    out = out.select(*df.columns, "class_I", "conf_I")
    return out.where("class_I = 1") if keep else out


def stage_two(df: DataFrame, n_classes: int = 3, prefix: str = "label_") -> DataFrame:
    """Stance and its confidence from the class scores; the first class wins a tie."""
    scores = F.array(*[f"{prefix}{i}" for i in range(n_classes)])
    return df.withColumn("class_II", argmax(scores)).withColumn("conf_II", F.array_max(scores))


def cascade(df: DataFrame, vocab: DataFrame, topic_model: PipelineModel, text_col: str,
            load_stance_model: ModelFactory, n_classes: int = 3,
            length: int = FE.PADDED_LENGTH) -> DataFrame:
    """Stage I on everything, stage II on what is on topic, as one plan."""
    on_topic = stage_one(df, vocab, topic_model, length)
    return stage_two(score_batches(on_topic, text_col, load_stance_model, n_classes), n_classes)
