"""Session building and lineage control for iterative operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "hearsay", master: str | None = None,
                  shuffle_partitions: int | None = None, **conf) -> SparkSession:
    """A session with the settings the operators assume.

    On a cluster leave ``master`` and ``shuffle_partitions`` unset: spark-submit
    names the former, and AQE coalesces from the configured initial number.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


_LOCAL_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir`` (or set on the context).

    A temporary folder is made only for ``local`` masters with nothing
    configured; on a cluster the setting is required, because executors come and go.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    app = context.applicationId
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="hearsay-")
    return _LOCAL_FOLDERS[app]


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"   # nothing reads the shuffle files again
_SPLITS = "spark.sql.files.maxPartitionBytes"


@contextmanager
def _set(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting that holds for what runs inside."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def cut_lineage(df: DataFrame, split_bytes: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Unlike a checkpointed plan, the table starts without inherited constraints
    (they multiply in self-joins) and with known file sizes, so Spark broadcasts
    what is small.  The shuffle files behind the table are removed once it is there.
    ``split_bytes`` bounds the splits of the files that ``df`` reads, for steps that sort
    or hash rows much longer in memory than in a file.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/hearsay-{uuid.uuid4().hex}"
    most = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    with _set(spark, _CLEAN, "true"), _set(spark, _SPLITS, str(min(most, split_bytes or most))):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Remove tables of ``cut_lineage`` that no later result reads."""
    for table in tables:
        spark = table.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            if folder.rsplit("/", 1)[-1].startswith("hearsay-"):
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a scan over all cores where it has too few splits to keep them busy.

    A table of many row groups comes back as it is; only one that a few tasks would read is
    dealt, so a shuffle of rows happens where the table is small.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df.repartition(cores) if 2 * splits <= cores else df


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
