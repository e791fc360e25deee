"""Scans and sinks of landed posts and comments.

Landed data is one Parquet table partitioned by community; a community and a
time range prune partitions and row groups, the field list prunes columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearsay.operators.joins import join_checked
from hearsay.operators.ordered import top_n_per_group

# Field lists of the two landed tables.
POST_FIELDS = ("author", "title", "selftext", "url", "id", "subreddit", "created_utc",
               "permalink", "score", "num_comments")
COMMENT_FIELDS = ("author", "body", "id", "created_utc", "permalink", "subreddit", "score",
                  "parent_id")
_LONGS = {"created_utc", "score", "num_comments"}


def _schema(fields: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(f, T.LongType() if f in _LONGS else T.StringType())
                         for f in fields])


POST_SCHEMA = _schema(POST_FIELDS)
COMMENT_SCHEMA = _schema(COMMENT_FIELDS)


def scan_posts(spark: SparkSession, path: str, name_glob: str | None = None) -> DataFrame:
    """All communities of a landed table; ``name_glob`` selects files by name."""
    reader = spark.read
    if name_glob:
        reader = reader.option("pathGlobFilter", name_glob)
    return reader.parquet(path)


def scan_communities(spark: SparkSession, path: str, prefix: str = "", suffix: str = "",
                     file_suffix: str = ".parquet", key: str = "subreddit") -> DataFrame:
    """Communities of a landed table chosen by the beginning and the end of their names.

    Only the folders that match are listed and read; files of the folder that do not end on
    ``file_suffix`` are left alone.
    """
    found = spark.read.option("pathGlobFilter", f"*{file_suffix}").parquet(path)
    return found.where(F.col(key).startswith(prefix) & F.col(key).endswith(suffix))


def slice_scan(df: DataFrame, community: str | None, start: int, end: int,
               fields: Sequence[str]) -> DataFrame:
    """Rows of one community (or all) in a range closed at both ends."""
    keep = F.col("created_utc").between(start, end)
    if community is not None:
        keep = keep & (F.col("subreddit") == community)
    return df.where(keep).select(*fields)


def latest_per_community(df: DataFrame, start: int, end: int, limit: int,
                         communities: DataFrame | None = None) -> DataFrame:
    """The newest ``limit`` posts of every community in a window (a scan option)."""
    df = df.where(F.col("created_utc").between(start, end))
    if communities is not None:
        df = join_checked(df, communities.select("subreddit").distinct(), "subreddit", "left_semi")
    ties = [F.col(c) for c in ("id", "url", "subreddit_subscribers", "score") if c in df.columns]
    return top_n_per_group(df, ["subreddit"], [F.col("created_utc").desc(), *ties], limit)


def lookup_urls(df: DataFrame, urls: DataFrame) -> DataFrame:
    """Posts whose URL is listed."""
    return df.join(urls.select("url").distinct(), "url", "left_semi")


def write_partitioned(df: DataFrame, path: str, key: str = "subreddit",
                      mode: str = "overwrite", files_per_key: int | None = None) -> None:
    """One partition folder per community.

    Adaptive execution splits the partitions of large communities over several
    writers; ``files_per_key`` fixes their number instead.
    """
    if files_per_key is None:
        df.hint("rebalance", key).write.mode(mode).partitionBy(key).parquet(path)
        return
    salt = F.pmod(F.xxhash64(*[c for c in df.columns if c != key]), F.lit(files_per_key))
    df.repartition(F.col(key), salt).write.mode(mode).partitionBy(key).parquet(path)


def convert_to_parquet(spark: SparkSession, source: str, target: str, fmt: str = "csv",
                       schema: T.StructType | None = None, **options) -> None:
    """Format conversion of a directory."""
    reader = spark.read.format(fmt).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    reader.load(source).write.mode("overwrite").parquet(target)
