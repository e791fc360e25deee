"""Joins with small tables whose size is checked, never assumed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000  # key tables of a few columns: some ten megabytes at most


def join_checked(left: DataFrame, small: DataFrame, on, how: str = "inner",
                 max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join a large table with a key table.

    The key table is counted (up to the bound) first.  Within the bound it is
    broadcast, so a hot key costs no shuffle; beyond it the join is left to
    Spark, which splits skewed partitions.
    """
    if small.limit(max_rows + 1).count() <= max_rows:
        small = F.broadcast(small)
    return left.join(small, on, how)


def null_safe(left: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "left",
              max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``join_checked`` on keys where null equals null."""
    renamed = small.select(*[F.col(k).alias(f"_k_{k}") for k in keys],
                           *[c for c in small.columns if c not in keys])
    cond = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        cond = same if cond is None else cond & same
    return join_checked(left, renamed, cond, how, max_rows).drop(*[f"_k_{k}" for k in keys])
