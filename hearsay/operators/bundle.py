"""Fitted text classifiers as one Spark ML pipeline that can be written and read back.

``WordTokens`` splits texts, ``WordEncoder`` holds the vocabulary and the padded length,
``BoostedTreesModel`` holds the trees.  Parameters go into the metadata of a stage,
vocabulary and trees into Parquet tables beside it, so a bundle lives wherever Spark can
write and no other file is needed to score new texts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, PipelineModel, Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import (
    HasFeaturesCol, HasInputCol, HasLabelCol, HasOutputCol, HasPredictionCol, HasProbabilityCol, HasSeed)
from pyspark.ml.util import (
    DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader,
    MLWritable, MLWriter)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearsay.functions import text as X
from hearsay.operators import boosting as B
from hearsay.operators import features as FE


# ---------------------------------------------------------------- stages with tables

class _TableWriter(MLWriter):
    def __init__(self, stage: "_WithTables"):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.stage, path, self.sparkSession)
        for name, table in self.stage.tables().items():
            table.write.mode("overwrite").parquet(f"{path}/{name}")


class _TableReader(MLReader):
    def __init__(self, kind: type):
        super().__init__()
        self.kind = kind

    def load(self, path: str):
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        stage = self.kind()
        stage._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(stage, metadata)
        stage.take_tables(lambda name: self.sparkSession.read.parquet(f"{path}/{name}"))
        return stage


class _WithTables(MLWritable, MLReadable):
    """A stage whose state is one or more tables."""

    def write(self) -> MLWriter:
        return _TableWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _TableReader(cls)

    def tables(self) -> dict[str, DataFrame]:
        raise NotImplementedError

    def take_tables(self, read) -> None:
        raise NotImplementedError


# ---------------------------------------------------------------- text stages

class WordTokens(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """White-space tokens of a text column."""

    @keyword_only
    def __init__(self, *, inputCol: str = "text", outputCol: str = "tokens"):
        super().__init__()
        self._setDefault(inputCol="text", outputCol="tokens")
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.getOutputCol(), X.tokens(F.col(self.getInputCol())))


class WordEncoder(Model, HasInputCol, HasOutputCol, _WithTables):
    """Tokens -> padded word ids as a vector, by a vocabulary that it holds."""

    length = Param(Params._dummy(), "length", "padded length", TypeConverters.toInt)
    idCols = Param(Params._dummy(), "idCols", "columns that tell rows apart", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, vocabulary: DataFrame | None = None, length: int = FE.PADDED_LENGTH,
                 idCols: list[str] | None = None, inputCol: str = "tokens", outputCol: str = "features"):
        super().__init__()
        self._setDefault(inputCol="tokens", outputCol="features", length=FE.PADDED_LENGTH, idCols=["id"])
        given = {k: v for k, v in self._input_kwargs.items() if k != "vocabulary" and v is not None}
        self.vocabulary = vocabulary
        self._set(**given)

    def tables(self) -> dict[str, DataFrame]:
        return {"vocabulary": self.vocabulary}

    def take_tables(self, read) -> None:
        self.vocabulary = read("vocabulary")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        length = self.getOrDefault(self.length)
        coded = FE.encode(dataset, self.vocabulary, self.getOrDefault(self.idCols), self.getInputCol(), "_ids",
                          last=length)
        padded = FE.pad(F.col("_ids"), length).cast("array<double>")
        return coded.withColumn(self.getOutputCol(), array_to_vector(padded)).drop("_ids")


# ---------------------------------------------------------------- boosted trees

class _TreeParams(HasFeaturesCol, HasProbabilityCol, HasPredictionCol):
    nClasses = Param(Params._dummy(), "nClasses", "number of classes", TypeConverters.toInt)
    maxBins = Param(Params._dummy(), "maxBins", "bins of a feature", TypeConverters.toInt)
    #: 0 takes quantiles of every feature; else features are whole numbers below this one
    valuesBelow = Param(Params._dummy(), "valuesBelow", "bound of whole-number features", TypeConverters.toInt)


class BoostedTrees(Estimator, _TreeParams, HasLabelCol, HasSeed, DefaultParamsReadable, DefaultParamsWritable):
    """Boosted trees with class probabilities, for two or more classes.

    ``featureSubsetStrategy`` is the share of features that a tree may use, as a string.
    """

    maxIter = Param(Params._dummy(), "maxIter", "rounds", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "depth of a tree", TypeConverters.toInt)
    stepSize = Param(Params._dummy(), "stepSize", "learning rate", TypeConverters.toFloat)
    featureSubsetStrategy = Param(Params._dummy(), "featureSubsetStrategy", "share of features per tree",
                                  TypeConverters.toString)

    @keyword_only
    def __init__(self, *, nClasses: int = 2, featuresCol: str = "features", labelCol: str = "label",
                 probabilityCol: str = "probability", predictionCol: str = "prediction", maxIter: int = 100,
                 maxDepth: int = 6, stepSize: float = 0.3, featureSubsetStrategy: str = "1.0", maxBins: int = 32,
                 valuesBelow: int = 0, seed: int = 42):
        super().__init__()
        self._setDefault(nClasses=2, featuresCol="features", labelCol="label", probabilityCol="probability",
                         predictionCol="prediction", maxIter=100, maxDepth=6, stepSize=0.3,
                         featureSubsetStrategy="1.0", maxBins=32, valuesBelow=0, seed=42)
        self._set(**self._input_kwargs)

    def setting(self, model: int = 0, leave: int | None = None) -> B.Setting:
        get = self.getOrDefault
        return B.Setting(model, get(self.maxIter), get(self.maxDepth), get(self.stepSize),
                         float(get(self.featureSubsetStrategy)), leave=leave, seed=get(self.seed))

    def cuts(self, dataset: DataFrame) -> list:
        top, bins = self.getOrDefault(self.valuesBelow), self.getOrDefault(self.maxBins)
        if top:
            return B.even_cuts(top, bins)
        return B.quantile_cuts(dataset.select(vector_to_array(self.getFeaturesCol()).alias("_x")), "_x", bins)

    def model(self, forest: B.Forest, cuts: list, number: int = 0) -> "BoostedTreesModel":
        """The model ``number`` of a forest that may hold several."""
        own = B.Forest(forest.n_classes, {(0, r, k): t for (m, r, k), t in forest.trees.items() if m == number})
        return BoostedTreesModel(own, cuts, **{p.name: self.getOrDefault(p) for p in (
            self.featuresCol, self.probabilityCol, self.predictionCol, self.nClasses, self.maxBins, self.valuesBelow)})

    def _fit(self, dataset: DataFrame) -> "BoostedTreesModel":
        cuts = self.cuts(dataset)
        rows = dataset.select(B.binned(vector_to_array(self.getFeaturesCol()), cuts).alias("bins"),
                              F.col(self.getLabelCol()).cast("int").alias("label"))
        forest = B.fit(rows, self.getOrDefault(self.nClasses), [self.setting()], self.getOrDefault(self.maxBins))
        return self.model(forest, cuts)


class BoostedTreesModel(Model, _TreeParams, _WithTables):
    """Class probabilities and the most probable class (the first on a tie)."""

    def __init__(self, forest: B.Forest | None = None, cuts: list | None = None, **params):
        super().__init__()
        self._setDefault(featuresCol="features", probabilityCol="probability", predictionCol="prediction",
                         nClasses=2, maxBins=32, valuesBelow=0)
        self._set(**params)
        self.forest, self._cuts = forest, cuts

    def tables(self) -> dict[str, DataFrame]:
        from pyspark.sql import SparkSession

        spark = SparkSession.active()
        shared = not self._cuts or not isinstance(self._cuts[0], (list, tuple))
        lists = [self._cuts] if shared else self._cuts
        rows = [(-1 if shared else i, [float(c) for c in one]) for i, one in enumerate(lists)]
        return {"trees": self.forest.table(spark),
                "cuts": spark.createDataFrame(rows, "feature int, cuts array<double>")}

    def take_tables(self, read) -> None:
        self.forest = B.Forest.from_rows(read("trees").collect(), self.getOrDefault(self.nClasses))
        lists = read("cuts").orderBy("feature").collect()       # one row per feature
        self._cuts = list(lists[0]["cuts"]) if lists[0]["feature"] < 0 else [list(r["cuts"]) for r in lists]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        bins = B.binned(vector_to_array(self.getFeaturesCol()), self._cuts)
        scored = dataset.withColumn("_p", B.probabilities(bins, self.forest))
        best = F.array_position("_p", F.array_max("_p")) - 1
        return (scored.withColumn(self.getProbabilityCol(), array_to_vector("_p"))
                .withColumn(self.getPredictionCol(), best.cast("double")).drop("_p"))


def text_bundle(train: DataFrame, estimator: Estimator, id_cols: Sequence[str] = ("id",), text_col: str = "text",
                length: int | None = None) -> PipelineModel:
    """Tokens, vocabulary, padded length (the 95 % statistic of the training texts unless
    given) and a classifier, fitted on the training rows, as one pipeline."""
    tokens = WordTokens(inputCol=text_col)
    words = tokens.transform(train)
    if length is None:
        length = FE.max_length(words.select(F.size("tokens").cast("long").alias("n")), "n").first()[0] or 1
    vocabulary = FE.stored_vocabulary(words)
    encoder = WordEncoder(vocabulary=vocabulary, length=int(length), idCols=list(id_cols))
    if estimator.hasParam("valuesBelow"):
        estimator = estimator.copy({estimator.valuesBelow: FE.FIRST_ID + vocabulary.count()})
    return PipelineModel([tokens, encoder, estimator.fit(encoder.transform(words))])
