"""Exact order-dependent results without sorting one group in one task.

``split_by_hash`` and friends need the order of a hash, which is uniform: the
cut positions are found on small bucket counts and only the rows of the few
buckets that hold a cut are ranked.

``running_totals`` and friends need the order of a value.  Input rows are first
collapsed to one row per distinct value; the values are spread over ranges whose
bounds come from approximate percentiles, and sums over earlier ranges are added
to sums inside the range.  The bounds only steer the spread, never the result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearsay.operators.joins import null_safe
from hearsay.session import cut_lineage, shuffle_width

HASH_DIGITS = 4  # 16**4 buckets of the hash order


def hash_key(columns: Sequence[str | Column], seed: int = 42) -> Column:
    """Deterministic pseudo-random order: md5 of the columns and the seed."""
    parts = [F.col(c) if isinstance(c, str) else c for c in columns]
    parts = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.md5(F.concat_ws("|", *parts, F.lit(str(seed))))


def _bucket(hash_col: Column) -> Column:
    return F.conv(F.substring(hash_col, 1, HASH_DIGITS), 16, 10).cast("int")


def hash_fraction(columns: Sequence[str | Column], seed: int = 42) -> Column:
    """The hash order as a number in [0, 1); 13 hex digits fit a double exactly."""
    head = F.conv(F.substring(hash_key(columns, seed), 1, 13), 16, 10)
    return head.cast("long") / F.lit(float(16 ** 13))


def split_by_hash(df: DataFrame, id_cols: Sequence[str], cuts: Column,
                  group_cols: Sequence[str] = (), seed: int = 42,
                  out_col: str = "segment") -> DataFrame:
    """Number the rows of each group in hash order and label their segment.

    ``cuts`` is an array expression over ``n`` (rows in the group) and the group
    columns: ``array(2, 5)`` puts two rows into segment 0, three into segment 1
    and the rest into segment 2.  Segment sizes are exact.  Rows with equal ids
    are interchangeable only if they are equal, so ids should identify rows.
    """
    group = list(group_cols)
    h = hash_key(id_cols, seed)
    keyed = df.withColumn("_h", h).withColumn("_b", _bucket(F.col("_h")))

    # the only pass over all rows before the result: a small table, written once
    counts = cut_lineage(keyed.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_c")))
    by_bucket = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    ordered = by_bucket.orderBy("_b")
    ends = (
        counts
        .withColumn("_upto", F.sum("_c").over(ordered))
        .withColumn("n", F.sum("_c").over(by_bucket))
        .withColumn("_cuts", cuts.cast("array<bigint>"))
    )
    # one row per group: for each cut the bucket that holds it and the rows before
    holds = (
        ends.select(*group, "_b", (F.col("_upto") - F.col("_c")).alias("_before"), "_upto",
                    F.posexplode("_cuts").alias("_i", "_cut"))
        .where((F.col("_cut") > F.col("_before")) & (F.col("_cut") <= F.col("_upto")))
        .groupBy(*group)
        .agg(F.collect_list(F.struct(F.col("_b").alias("b"), F.col("_before").alias("before"),
                                     F.col("_cut").alias("cut"))).alias("_holds"))
    )
    # cuts at or below zero are passed by every row, cuts beyond n by none
    passed = ends.groupBy(*group).agg(
        F.max(F.size(F.filter("_cuts", lambda c: c <= 0))).alias("_passed"))
    if group:
        table = null_safe(passed, holds, group)
        located = null_safe(keyed, table, group)
    else:
        table = passed.agg(F.max("_passed").alias("_passed"))
        located = (keyed.withColumn("_passed", table.select("_passed").scalar())
                   .withColumn("_holds", holds.select("_holds").scalar()))
    located = located.withColumn(
        "_holds", F.coalesce("_holds", F.expr(
            "cast(array() as array<struct<b:int,before:bigint,cut:bigint>>)")))
    at_cut = F.exists("_holds", lambda x: x["b"] == F.col("_b"))
    below = F.size(F.filter("_holds", lambda x: x["b"] < F.col("_b")))
    whole = (located.where(~at_cut)
             .withColumn(out_col, F.col("_passed") + below))
    rank = F.row_number().over(Window.partitionBy(*group, "_b").orderBy(
        "_h", *[F.col(c) for c in id_cols]))
    shared = (
        located.where(at_cut)
        .withColumn("_r", rank)
        .withColumn(out_col, F.col("_passed") + below + F.size(F.filter(
            "_holds", lambda x: (x["b"] == F.col("_b"))
            & (x["before"] + F.col("_r") > x["cut"]))))
        .drop("_r")
    )
    return whole.unionByName(shared).drop("_h", "_b", "_passed", "_holds")


def hash_sample(df: DataFrame, n: int, id_cols: Sequence[str], group_cols: Sequence[str] = (),
                seed: int = 42) -> DataFrame:
    """The first ``n`` rows (per group) of the hash order."""
    cut = F.array(F.lit(n))
    return (split_by_hash(df, id_cols, cut, group_cols, seed, "_seg")
            .where("_seg = 0").drop("_seg"))


def top_n_per_group(df: DataFrame, group_cols: Sequence[str], order: Sequence[Column],
                    n: int, salts: int = 64, out_col: str | None = None) -> DataFrame:
    """Exact top-n per group in two steps, so that a hot group is cut down in parallel."""
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(salts))
    first = Window.partitionBy(*group_cols, "_salt").orderBy(*order)
    final = Window.partitionBy(*group_cols).orderBy(*order)
    name = out_col or "_rank"
    best = (
        df.withColumn("_salt", salt)
        .withColumn("_rank0", F.row_number().over(first)).where(F.col("_rank0") <= n)
        .drop("_salt", "_rank0")
        .withColumn(name, F.row_number().over(final)).where(F.col(name) <= n)
    )
    return best if out_col else best.drop(name)


# ---------------------------------------------------------------- value order

def with_range(df: DataFrame, col: str, out_col: str = "_range",
               ranges: int | None = None) -> DataFrame:
    """Spread rows over value ranges of about equal row counts (one small action)."""
    count = ranges or shuffle_width(df.sparkSession)
    bounds: list[float] = []
    if count > 1:
        probs = [i / count for i in range(1, count)]
        found = df.agg(F.percentile_approx(F.col(col).cast("double"), probs, 10_000)).first()[0]
        bounds = sorted({float(b) for b in (found or []) if b is not None and math.isfinite(b)})
    splits = [-float("inf"), *bounds, float("inf")]
    if len(splits) < 3:
        return df.withColumn(out_col, F.lit(0))
    spread = Bucketizer(splits=splits, inputCol="_value", outputCol=out_col,
                        handleInvalid="keep")
    return (spread.transform(df.withColumn("_value", F.col(col).cast("double")))
            .withColumn(out_col, F.col(out_col).cast("int")).drop("_value"))


def running_totals(df: DataFrame, order_col: str, sums: Mapping[str, str],
                   group_cols: Sequence[str] = (), ranges: int | None = None,
                   keep_range: bool = False) -> DataFrame:
    """Inclusive running sums over ascending ``order_col``.

    ``df`` holds one row per (group, value), e.g. counts per score.  ``sums`` maps
    the output name to the summed column.  ``keep_range`` leaves the range number in
    place, and a frame that has one already is not spread again.
    """
    group = list(group_cols)
    spread = _spread(df, order_col, ranges)
    local = Window.partitionBy(*group, "_range").orderBy(order_col) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = (Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))) \
        .orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = spread.groupBy(*group, "_range").agg(
        *[F.sum(c).alias(f"_t_{o}") for o, c in sums.items()])
    offsets = totals.select(*group, "_range", *[
        F.coalesce(F.sum(f"_t_{o}").over(earlier), F.lit(0)).alias(f"_o_{o}") for o in sums])
    summed = spread
    for o, c in sums.items():
        summed = summed.withColumn(o, F.sum(c).over(local))
    joined = _join_on(summed, offsets, [*group, "_range"])
    for o in sums:
        joined = joined.withColumn(o, F.col(o) + F.col(f"_o_{o}")).drop(f"_o_{o}")
    return joined if keep_range else joined.drop("_range")


def _spread(df: DataFrame, order_col: str, ranges: int | None) -> DataFrame:
    """Rows with a range number.  The frame is read for the bounds, the sums per range
    and the rows, so it is written once first (one row per distinct value), unless it is
    read from such a table already."""
    if "_range" in df.columns:
        return df
    return with_range(df if df.inputFiles() and _is_written(df) else cut_lineage(df), order_col, ranges=ranges)


def _is_written(df: DataFrame) -> bool:
    """Whether the frame is a table of ``cut_lineage``, or rows and columns of one."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() in ("Project", "Filter"):
        plan = plan.child()
    return plan.nodeName() == "LogicalRelation" and "/hearsay-" in df.inputFiles()[0]


def _join_on(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.join(right, list(keys))


def next_row(df: DataFrame, order_col: str, columns: Mapping[str, str],
             group_cols: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """Values of the next row by ascending ``order_col`` (null at the end)."""
    group = list(group_cols)
    spread = _spread(df, order_col, ranges)
    local = Window.partitionBy(*group, "_range").orderBy(order_col)
    over_ranges = (Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))) \
        .orderBy("_range")
    picked = F.struct(*[F.col(c).alias(o) for o, c in columns.items()])
    firsts = (
        spread.groupBy(*group, "_range")
        .agg(F.min_by(picked, F.col(order_col)).alias("_first"))
        .select(*group, "_range", F.lead("_first").over(over_ranges).alias("_over"))
    )
    out = _join_on(spread.withColumn("_lead", F.lead(picked).over(local)), firsts,
                   [*group, "_range"])
    chosen = F.coalesce("_lead", "_over")
    kept = [c for c in df.columns if c != "_range"]
    return out.select(*kept, *[chosen[o].alias(o) for o in columns])


def fill_between(df: DataFrame, order_col: str, known: str, group_cols: Sequence[str] = (),
                 ranges: int | None = None) -> DataFrame:
    """For every row the nearest non-null ``known`` at or before and at or after it.

    Adds ``prev`` and ``next``; ``known`` is usually a struct of a curve point.
    """
    group = list(group_cols)
    spread = _spread(df, order_col, ranges)
    base = Window.partitionBy(*group, "_range").orderBy(order_col)
    back = base.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = base.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    per_range = spread.groupBy(*group, "_range").agg(
        F.max_by(known, F.when(F.col(known).isNotNull(), F.col(order_col))).alias("_last"),
        F.min_by(known, F.when(F.col(known).isNotNull(), F.col(order_col))).alias("_first"))
    whole = (Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))) \
        .orderBy("_range")
    edges = per_range.select(
        *group, "_range",
        F.last("_last", ignorenulls=True).over(
            whole.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.first("_first", ignorenulls=True).over(
            whole.rowsBetween(1, Window.unboundedFollowing)).alias("_after"))
    local = (spread
             .withColumn("_prev", F.last(known, ignorenulls=True).over(back))
             .withColumn("_next", F.first(known, ignorenulls=True).over(ahead)))
    return (_join_on(local, edges, [*group, "_range"])
            .withColumn("prev", F.coalesce("_prev", "_before"))
            .withColumn("next", F.coalesce("_next", "_after"))
            .drop("_prev", "_next", "_before", "_after", "_range"))


def value_counts(df: DataFrame, col: str, group_cols: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*group_cols, col).agg(F.count(F.lit(1)).alias("_count"))


BRACKET_ROWS = 500_000   # rows around a position that one task may put in order
SLACK = 0.02             # share of the rows on either side of a position that a bracket keeps


def values_at(df: DataFrame, col: str, positions: Callable[[int], Sequence[int]],
              bracket_rows: int = BRACKET_ROWS) -> tuple[int, dict[int, object]]:
    """``(n, {position: value})`` of the sorted non-null values; ``positions`` maps n to the
    zero-based positions that are asked for.

    No table is written and nothing is sorted but the rows near a position: quantile
    sketches, merged over tasks, bracket each position, exact counts tell where the bracket
    lies, and while a bracket holds too many rows it is bracketed again (one scan each).  A
    last scan counts the values inside.  The sketch steers the work; the counts decide.
    """
    values = df.where(F.col(col).isNotNull()).select(F.col(col).alias("v"))
    n = values.count()
    asked = sorted({p for p in positions(n) if 0 <= p < n}) if n else []
    # per position: bounds (None is open), rows below the lower bound, rows inside
    brackets = {p: (None, None, 0, n) for p in asked}
    x = F.col("v").cast("double")

    def above(low) -> Column:
        return F.lit(True) if low is None else ~(x < F.lit(low))

    def inside(low, high) -> Column:
        return above(low) if high is None else above(low) & ~(x > F.lit(high))

    wide = True
    while wide:
        wide = [p for p, (low, high, _, held) in brackets.items()
                if held > bracket_rows and (low is None or low != high)]
        if not wide:
            break
        sketches = values.agg(*[F.kll_sketch_agg_double(F.when(inside(*brackets[p][:2]), x)).alias(f"s{p}")
                                for p in wide])
        share = {p: (p - brackets[p][2]) / max(brackets[p][3] - 1, 1) for p in wide}
        bound = lambda p, q: F.kll_sketch_get_quantile_double(f"s{p}", F.lit(min(max(q, 0.0), 1.0)))
        found = sketches.select(*[c for p in wide for c in (
            bound(p, share[p] - SLACK).alias(f"l{p}"), bound(p, share[p] + SLACK).alias(f"h{p}"))]).first()
        tighter = {p: (found[f"l{p}"], found[f"h{p}"]) for p in wide}
        counts = values.agg(*[c for p, (low, high) in tighter.items() for c in (
            F.count_if(~above(low)).alias(f"b{p}"), F.count_if(inside(low, high)).alias(f"i{p}"))]).first()
        moved = False
        for p, (low, high) in tighter.items():
            below, held = counts[f"b{p}"], counts[f"i{p}"]
            if below <= p < below + held and held < brackets[p][3]:
                brackets[p] = (low, high, below, held)
                moved = True
        if not moved:      # a value that fills the bracket, or a sketch that missed: count what is there
            break
    if not asked:
        return n, {}
    cells = F.array(*[F.when(inside(low, high), F.lit(p).cast("long")) for p, (low, high, _, _) in brackets.items()])
    near = (values.select("v", F.explode(F.array_compact(cells)).alias("p")).groupBy("p", "v")
            .agg(F.count(F.lit(1)).alias("c")))
    before = F.element_at(F.create_map(*[F.lit(x).cast("long") for p, b in brackets.items() for x in (p, b[2])]), F.col("p"))
    upto = before + F.sum("c").over(Window.partitionBy("p").orderBy("v"))     # a bracket is bounded
    hit = near.withColumn("upto", upto).where((F.col("upto") > F.col("p")) & (F.col("upto") - F.col("c") <= F.col("p")))
    return n, {r["p"]: r["v"] for r in hit.select("p", "v").collect()}


def order_statistic(df: DataFrame, col: str, fraction: float,
                    out_col: str = "value") -> DataFrame:
    """``sorted(values)[int(n * fraction)]`` over the non-null values: one row."""
    _, found = values_at(df, col, lambda n: [math.floor(n * fraction)])
    kind = df.schema[col].dataType.simpleString()
    return df.sparkSession.createDataFrame([(next(iter(found.values()), None),)], f"{out_col} {kind}")


def quantiles(df: DataFrame, col: str, fractions: Mapping[str, float]) -> DataFrame:
    """Exact linearly interpolated quantiles, one output column per fraction."""
    places = lambda n: {name: (n - 1) * q for name, q in fractions.items()}
    n, found = values_at(df, col, lambda n: [p for h in places(n).values() for p in (math.floor(h), math.ceil(h))])
    row = []
    for h in places(n).values():
        low, high = (found.get(p) for p in (math.floor(h), math.ceil(h)))
        row.append(None if low is None else float(low) + (float(high) - float(low)) * (h - math.floor(h)))
    return df.sparkSession.createDataFrame([tuple(row)], ", ".join(f"{name} double" for name in fractions))


def mean_ranks(counts: DataFrame, col: str, count_col: str, out_col: str) -> DataFrame:
    """Average rank of each distinct value: ``(col, out_col)``."""
    per_value = counts.groupBy(col).agg(F.sum(count_col).alias("_count"))
    upto = running_totals(per_value, col, {"_upto": "_count"})
    return upto.select(
        col, (F.col("_upto") - (F.col("_count") - 1) / F.lit(2.0)).alias(out_col))
