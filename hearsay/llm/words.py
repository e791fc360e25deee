"""Words and numbered order, shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BREAKS = r"[\x20\x09-\x0D]+"
ROWS_PER_BUCKET = 50_000


def words(text: Column) -> Column:
    """Maximal runs without white space; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BREAKS), "")


def hash_order(*columns: Column) -> Column:
    """A pseudo-random order that any engine can repeat: md5 in hexadecimal digits."""
    return F.md5(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]))


def uniform(digest: Column) -> Column:
    """A number in (0, 1) from the first 13 hexadecimal digits of a digest."""
    head = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double")
    return (head + F.lit(0.5)) / F.lit(float(16 ** 13))


def bucket_digits(rows: int, groups: int = 1) -> int:
    """How many leading digits of a hash keep a bucket of one group at a task's size,
    even if one group holds all rows."""
    digits = 1
    while rows / 16 ** digits > ROWS_PER_BUCKET:
        digits += 1
    return digits


def bucket_offsets(totals: DataFrame, group: Sequence[str], bucket: str,
                   sums: dict[str, str]) -> DataFrame:
    """Sums over the earlier buckets of a group; ``totals`` has one row per (group, bucket)."""
    earlier = (Window.partitionBy(*group).orderBy(bucket)
               .rowsBetween(Window.unboundedPreceding, -1))
    return totals.select(*group, bucket, *[
        F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(o) for o, c in sums.items()])


def same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys of the same names, null meeting null; the left keys stay."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys]
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])
