"""Counts, shares, community statistics and daily series of scored posts.

Long ``groupBy`` tables are the source of truth; wide views pivot over explicit
values, so no extra distinct job runs.  Plain counts combine on the map side,
which is what keeps a dominating community or day cheap.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearsay.functions.scalar import DELETED_AUTHOR, date_of, share
from hearsay.operators.ordered import quantiles

# Names of the stance classes 0, 1, 2 and of the topic classes 0, 1.
STANCES = ("anti", "neutral", "pro")
TOPIC_CLASSES = ("Non-Covid", "Covid")

COUNT_NAMES = tuple(f"n_{s}" for s in STANCES)
SHARE_NAMES = tuple(f"p_{s}" for s in STANCES)


# ---------------------------------------------------------------- class counts

def class_counts(df: DataFrame, keys: Sequence[str], cls: str = "class_II",
                 measure: str = "score") -> DataFrame:
    """Long table keys x class -> n.  Rows with a missing key are not counted and
    a missing measure does not count."""
    for k in (*keys, cls):
        df = df.where(F.col(k).isNotNull())
    return df.groupBy(*keys, cls).agg(F.count(measure).alias("n"))


def class_db(df: DataFrame, keys: Sequence[str], cls: str = "class_II",
             values: Sequence[int] = (0, 1, 2), names: Sequence[str] = COUNT_NAMES,
             measure: str = "score", fill: int | None = 0) -> DataFrame:
    """Wide table keys -> one count per class.

    ``fill=None`` leaves cells without any row null; 0 fills them.
    """
    for k in (*keys, cls):
        df = df.where(F.col(k).isNotNull())
    cells = []
    for value, name in zip(values, names):
        n = F.count(F.when(F.col(cls) == value, F.col(measure)))
        seen = F.count_if(F.col(cls) == value)
        cell = n if fill is not None else F.when(seen > 0, n)
        if fill:
            cell = F.when(seen > 0, n).otherwise(F.lit(fill))
        cells.append(cell.alias(name))
    return df.groupBy(*keys).agg(*cells)


def wide_by(df: DataFrame, index: str, columns: Sequence[str], values: Sequence[str],
            measure: str = "n", fill: int | None = 0, sep: str = "|") -> DataFrame:
    """Pivot a long count table over a composite column label."""
    label = F.concat_ws(sep, *[F.col(c).cast("string") for c in columns])
    wide = df.withColumn("_label", label).groupBy(index).pivot("_label", list(values)).agg(
        F.sum(measure))
    return wide if fill is None else wide.fillna(fill, subset=list(values))


def merge_counts(parts: Sequence[DataFrame], keys: Sequence[str],
                 measures: Sequence[str]) -> DataFrame:
    """Full outer, zero-filled sum of partial count tables."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p, allowMissingColumns=True)
    return whole.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in measures])


def with_shares(df: DataFrame, parts: Sequence[str] = COUNT_NAMES, total: str = "total",
                names: Sequence[str] = SHARE_NAMES) -> DataFrame:
    whole = F.col(parts[0])
    for p in parts[1:]:
        whole = whole + F.col(p)
    df = df.withColumn(total, whole)
    return df.select("*", *[share(F.col(p), F.col(total)).alias(n) for p, n in zip(parts, names)])


def top_k(df: DataFrame, by: str | Column, k: int, tie: Sequence[str], skip: int = 0,
          floor: Column | None = None) -> DataFrame:
    """The k largest rows after skipping some; ties break by name."""
    if floor is not None:
        df = df.where(floor)
    order = (F.col(by) if isinstance(by, str) else by).desc()
    df = df.orderBy(order, *[F.col(t).asc() for t in tie])
    return df.offset(skip).limit(k) if skip else df.limit(k)


def group_vs_rest(shares: DataFrame, key: str = "author", value: str = DELETED_AUTHOR,
                  parts: Sequence[str] = SHARE_NAMES) -> DataFrame:
    """Shares of one group beside mean and sample deviation of all others."""
    is_one = F.col(key) == value
    out = []
    for p in parts:
        rest = F.when(~is_one, F.col(p))
        out += [F.max(F.when(is_one, F.col(p))).alias(f"{p}_one"),
                F.avg(rest).alias(f"{p}_mean"), F.stddev_samp(rest).alias(f"{p}_std")]
    return shares.agg(*out)


# ---------------------------------------------------------------- community statistics

def distinct_values(col: str, count_null: bool = False) -> Column:
    """Distinct count; optionally a missing value counts as one more value."""
    n = F.count_distinct(F.col(col))
    return n + F.max(F.col(col).isNull().cast("int")) if count_null else n


def community_stats(df: DataFrame, mode: str, key: str = "subreddit",
                    count_null_author: bool = False) -> DataFrame:
    """Post and author counts per community.

    ``c1`` splits by topic class, ``c2`` by stance among on-topic posts, ``none``
    uses no predictions.
    """
    authors = distinct_values("author", count_null_author).alias("authors")
    posts = F.count(F.lit(1)).alias("posts")
    if mode == "c1":
        split = [F.count_if(F.col("class_I") == i).alias(n) for i, n in enumerate(TOPIC_CLASSES)]
    elif mode == "c2":
        df = df.where(F.col("class_I") == 1)
        split = [F.count_if(F.col("class_II") == i).alias(f"posts_{n}")
                 for i, n in enumerate(STANCES)]
    elif mode == "none":
        split = []
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return df.groupBy(key).agg(posts, *split, authors)


def label_counts(df: DataFrame, col: str = "label") -> DataFrame:
    return (df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.col("n").desc(), F.col(col)))


def column_sums(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(*[F.sum(c).alias(c) for c in columns])


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "n_columns", F.lit(len(df.columns)).cast("long"))


def top_k_sum(df: DataFrame, by: str, k: int, tie: Sequence[str]) -> DataFrame:
    return top_k(df, by, k, tie).agg(F.sum(by).alias(f"sum_{by}"))


def sums_by_flag(df: DataFrame, flag: str, columns: Sequence[str]) -> DataFrame:
    return df.groupBy(flag).agg(*[F.sum(c).alias(c) for c in columns])


def summary(df: DataFrame, col: str) -> DataFrame:
    """Count, mean, std, min, exact quartiles, max of one column."""
    base = df.agg(F.count(col).alias("count"), F.avg(col).alias("mean"),
                  F.stddev_samp(col).alias("std"), F.min(col).alias("min"),
                  F.max(col).alias("max"))
    parts = quantiles(df, col, {"q25": 0.25, "q50": 0.5, "q75": 0.75}).first()
    return base.select("*", *[F.lit(parts[q]).cast("double").alias(q) for q in ("q25", "q50", "q75")])


def histogram(df: DataFrame, col: str, bins: int, low: float | None = None,
              high: float | None = None) -> DataFrame:
    """Equal-width histogram; the last bin is closed, empty bins are kept."""
    known = df.where(F.col(col).isNotNull())
    limits = known.agg(F.min(col).cast("double").alias("lo"), F.max(col).cast("double").alias("hi"))
    lo = F.lit(float(low)) if low is not None else limits.select("lo").scalar()
    hi = F.lit(float(high)) if high is not None else limits.select("hi").scalar()
    width = (hi - lo) / F.lit(float(bins))
    value = F.col(col).cast("double")
    number = F.when(value == hi, F.lit(bins - 1)).otherwise(
        F.floor((value - lo) / width).cast("int"))
    filled = (known.where((value >= lo) & (value <= hi))
              .groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("n")))
    spine = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (spine.join(filled, "bin", "left")
            .select("bin", (lo + F.col("bin") * width).alias("bin_start"),
                    F.coalesce("n", F.lit(0)).alias("n")))


# ---------------------------------------------------------------- daily series

def with_date(df: DataFrame, epoch: str = "created_utc", tz: str = "UTC") -> DataFrame:
    return df.withColumn("date", date_of(F.col(epoch), tz))


def daily_counts(df: DataFrame, keys: Sequence[str] = ("subreddit",),
                 epoch: str = "created_utc", tz: str = "UTC") -> DataFrame:
    return with_date(df, epoch, tz).groupBy("date", *keys).agg(F.count(F.lit(1)).alias("n"))


def daily_class_series(df: DataFrame, community: str | None = None, cls: str = "class_II",
                       measure: str = "num_comments", tz: str = "UTC") -> DataFrame:
    """Daily class counts with their total, of one community or of all."""
    if community is not None:
        df = df.where(F.col("subreddit") == community)
    return class_db(with_date(df, tz=tz), ["date"], cls, measure=measure).withColumn(
        "total", F.col("n_anti") + F.col("n_neutral") + F.col("n_pro"))


def date_spine(df: DataFrame, fill: Sequence[str], date: str = "date",
               start: str | None = None, end: str | None = None) -> DataFrame:
    """One row per calendar day; missing days hold zeros."""
    first = F.lit(start).cast("date") if start else F.min(date)
    last = F.lit(end).cast("date") if end else F.max(date)
    days = df.agg(F.explode(F.sequence(first, last)).alias(date))
    return days.join(df, date, "left").fillna(0, subset=list(fill))


def exclude_series(all_days: DataFrame, one: DataFrame, columns: Sequence[str],
                   date: str = "date") -> DataFrame:
    """All communities minus one, aligned by day."""
    other = one.select(date, *[F.col(c).alias(f"_o_{c}") for c in columns])
    return all_days.join(other, date, "left").select(
        date, *[(F.col(c) - F.coalesce(f"_o_{c}", F.lit(0))).alias(c) for c in columns])


def join_daily(counts: DataFrame, stats: DataFrame, date: str = "date") -> DataFrame:
    return counts.join(stats, date, "left")


def peaks(df: DataFrame, col: str) -> DataFrame:
    """All rows that hold the maximum."""
    return df.where(F.col(col) == df.agg(F.max(col)).scalar())


def between_days(df: DataFrame, after: str, before: str, date: str = "date") -> DataFrame:
    """Open interval of days."""
    return df.where((F.col(date) > F.lit(after).cast("date"))
                    & (F.col(date) < F.lit(before).cast("date")))


def event_window_mean(df: DataFrame, after: str, before: str,
                      columns: Mapping[str, str] | Sequence[str], date: str = "date") -> DataFrame:
    names = columns if isinstance(columns, Mapping) else {c: c for c in columns}
    return between_days(df, after, before, date).agg(
        *[F.avg(c).alias(n) for n, c in names.items()])
