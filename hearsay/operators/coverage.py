"""Time slices and landing checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearsay.functions.scalar import DAY_SECONDS, WINDOW_SECONDS

# Number of slices of a complete community and the relative
# tolerance (about seven days of epoch time) of the start / end agreement.
FULL_SLICES = 24
AGREEMENT_TOLERANCE = 0.0004


def slice_bounds(start: int, end: int, n: int) -> Column:
    """Array of the n slices of a range; the last one reaches one day further."""
    step = (end - start) / n
    i = lambda x: x.cast("double")
    return F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda x: F.struct(
            F.floor(F.lit(float(start)) + i(x) * F.lit(step)).cast("long").alias("slice_start"),
            (F.floor(F.lit(float(start)) + (i(x) + 1) * F.lit(step) - 1).cast("long")
             + F.when(x == n - 1, F.lit(DAY_SECONDS)).otherwise(F.lit(0))).alias("slice_end")))


def time_slices(communities: DataFrame, start: int, end: int, n: int = FULL_SLICES) -> DataFrame:
    """Expected grid: every community with every slice."""
    return communities.select("subreddit", F.inline(slice_bounds(start, end, n)))


def slice_of(epoch: Column, start: int, end: int, n: int = FULL_SLICES) -> Column:
    """Slice start of a post; null outside the range."""
    step = (end - start) / n
    # cut positions are whole seconds, so the quotient can be one too low or high
    guess = F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((epoch - start) / F.lit(step))))
    begin = lambda k: F.floor(F.lit(float(start)) + k.cast("double") * F.lit(step)).cast("long")
    later = F.when((guess < n - 1) & (begin(guess + 1) <= epoch), guess + 1).otherwise(guess)
    inside = (epoch >= start) & (epoch <= end - 1 + DAY_SECONDS)
    return F.when(inside, F.when(begin(later) > epoch, begin(later - 1)).otherwise(begin(later)))


def landed_slices(posts: DataFrame, start: int, end: int, n: int = FULL_SLICES) -> DataFrame:
    """Rows per community and slice."""
    return (posts.withColumn("slice_start", slice_of(F.col("created_utc"), start, end, n))
            .where(F.col("slice_start").isNotNull())
            .groupBy("subreddit", "slice_start").agg(F.count(F.lit(1)).alias("n_rows")))


def missing_slices(grid: DataFrame, landed: DataFrame) -> DataFrame:
    """Expected slices without any landed row."""
    return grid.join(landed.where("n_rows > 0"), ["subreddit", "slice_start"], "left_anti")


def not_landed(wanted: DataFrame, landed: DataFrame, key: str = "subreddit") -> DataFrame:
    return wanted.join(landed.select(key).distinct(), key, "left_anti")


def already_landed(wanted: DataFrame, landed: DataFrame, key: str = "subreddit") -> DataFrame:
    return wanted.join(landed.select(key).distinct(), key, "left_semi")


def complete(landed: DataFrame, n: int = FULL_SLICES) -> DataFrame:
    """Communities with exactly n non-empty slices."""
    return (landed.where("n_rows > 0").groupBy("subreddit")
            .agg(F.count_distinct("slice_start").alias("n_slices")).where(F.col("n_slices") == n))


def contiguous(landed: DataFrame, step: float, tolerance: float = 1.0) -> DataFrame:
    """Whether every slice starts one step after the one before.

    Slice starts are cut to whole seconds, hence the tolerance.  The window runs
    over slices, a few dozen per community, never over posts.
    """
    w = Window.partitionBy("subreddit").orderBy("slice_start")
    gap = F.lead("slice_start").over(w) - F.col("slice_start")
    ok = F.coalesce(F.abs(gap - F.lit(step)) <= tolerance, F.lit(True))
    return (landed.select("subreddit", "slice_start", ok.alias("_ok"))
            .groupBy("subreddit").agg(F.bool_and("_ok").alias("contiguous"),
                                      F.count(F.lit(1)).alias("n_slices")))


def is_close(a: Column, b: Column, rel_tol: float = AGREEMENT_TOLERANCE) -> Column:
    return F.abs(a - b) <= F.lit(rel_tol) * F.greatest(F.abs(a), F.abs(b))


def agrees(posts: DataFrame, comments: DataFrame,
           rel_tol: float = AGREEMENT_TOLERANCE) -> DataFrame:
    """Start and end agreement of two landings per community."""
    span = lambda df, p: df.groupBy("subreddit").agg(
        F.min("created_utc").alias(f"{p}_start"), F.max("created_utc").alias(f"{p}_end"))
    both = span(posts, "post").join(span(comments, "comment"), "subreddit")
    return both.select(
        "subreddit",
        is_close(F.col("post_start"), F.col("comment_start"), rel_tol).alias("start_ok"),
        is_close(F.col("post_end"), F.col("comment_end"), rel_tol).alias("end_ok"))


def coverage_flags(communities: DataFrame, landed: DataFrame, flag: str) -> DataFrame:
    """Presence flag 0/1 of every listed community."""
    seen = landed.select("subreddit").distinct().withColumn(flag, F.lit(1))
    return communities.join(seen, "subreddit", "left").withColumn(
        flag, F.coalesce(flag, F.lit(0)))


def mergeable(posts: DataFrame, comments: DataFrame, start: int, end: int,
              n: int = FULL_SLICES, rel_tol: float = AGREEMENT_TOLERANCE) -> DataFrame:
    """Communities whose comment slices are contiguous and agree with the posts."""
    slices = landed_slices(comments, start, end, n)
    good = contiguous(slices, (end - start) / n).where("contiguous").select("subreddit")
    fits = agrees(posts, comments, rel_tol).where("start_ok AND end_ok").select("subreddit")
    return good.join(fits, "subreddit", "left_semi")


def next_window(posts: DataFrame) -> DataFrame:
    """Next scan window: from the last post on, 31 days long."""
    last = F.max("created_utc")
    return posts.agg(last.alias("start"), (last + WINDOW_SECONDS).alias("end"))
