"""Conversion, model persistence, reports and cross-validated search."""

from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from hearsay.operators import features as FE
from hearsay.operators import models as M
from hearsay.sources import posts as P
from hearsay.sources import tabular as TB


def toy(spark):
    rows = spark.range(120).select("id", (F.col("id") % 2).cast("int").alias("label"))
    x = F.array((F.col("label") * 2 + F.col("id") % 3).cast("double"), (F.col("id") % 5).cast("double"))
    return rows.withColumn("features", array_to_vector(x)).cache()


def test_conversion_and_reports(spark, tmp_path):
    df = spark.range(10).select("id", F.concat(F.lit("t"), "id").alias("text"))
    TB.write_separated(df, f"{tmp_path}/csv", sep=",")
    P.convert_to_parquet(spark, f"{tmp_path}/csv", f"{tmp_path}/pq", "csv", df.schema, header=True)
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/pq").collect())) == sorted(map(tuple, df.collect()))
    TB.write_report(df.limit(3), f"{tmp_path}/report")
    assert spark.read.json(f"{tmp_path}/report").count() == 3
    words = spark.createDataFrame([(["b", "a"],)], "tokens array<string>")
    TB.save_table(FE.vocabulary(words), f"{tmp_path}/vocab")
    assert {r["word"]: r["word_id"] for r in spark.read.parquet(f"{tmp_path}/vocab").collect()} == {"a": 2, "b": 3}


def test_model_round_trip(spark, tmp_path):
    data = toy(spark)
    model = M.train_logreg(data, max_iter=10)
    model.write().overwrite().save(f"{tmp_path}/model")
    again = PipelineModel.load(f"{tmp_path}/model")
    scores = lambda m: [r["s_1"] for r in M.class_columns(m.transform(data), 2, "s_").orderBy("id").collect()]
    assert scores(model) == scores(again)


def test_grid_search(spark):
    found = M.grid_search(toy(spark), 2, {"maxDepth": [1, 2], "maxIter": [2]}, n_folds=2, parallelism=2)
    rows = M.grid_results(spark, found).orderBy("rank").collect()
    assert len(rows) == 2 and rows[0]["rank"] == 1
    assert rows[0]["mean_metric"] >= rows[1]["mean_metric"] > 0.5


def test_one_vs_rest_and_three_classes(spark):
    data = toy(spark).withColumn("label", (F.col("id") % 3).cast("double"))
    assert "prediction" in M.train_one_vs_rest(data, maxIter=2, maxDepth=2).transform(data).columns
    trees = M.train_trees(data, 3, maxIter=3, maxDepth=2)
    total = M.class_columns(trees.transform(data), 3, "s_").select(
        (F.col("s_0") + F.col("s_1") + F.col("s_2")).alias("t"))
    assert total.where(F.abs(F.col("t") - 1) > 1e-9).count() == 0


def test_separated_file_in_parts(spark, tmp_path):
    import random

    rng = random.Random(7)
    made = lambda: "".join(rng.choice(['a', 'b"', "\n", '"', "|", "\r", "é", " ", ",", "x" * 30]) for _ in range(rng.randrange(40)))
    rows = [(i, made(), None if i % 11 == 0 else made()) for i in range(400)] + [(400, "", "\n\n"), (401, '"', "\n" * 3000)]
    df = spark.createDataFrame(rows, "id int, a string, b string").coalesce(2)
    TB.write_separated(df, f"{tmp_path}/csv")
    plain = TB.read_separated(spark, f"{tmp_path}/csv", df.schema)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("700", "5000", before):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            got = TB.read_separated_in_parts(spark, f"{tmp_path}/csv", df.schema)
            key = lambda r: tuple(map(str, r))
            assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, plain.collect()), key=key)
            lines = spark.read.option("lineSep", "\n").text(f"{tmp_path}/csv")
            assert size == before or lines.rdd.getNumPartitions() > 4
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
            spark.conf.unset("spark.sql.files.openCostInBytes")
