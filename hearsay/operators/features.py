"""Vocabulary, encoding and padding of token sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearsay.operators.ordered import order_statistic
from hearsay.session import cut_lineage

# Ids of the padding and the unknown word, first id of a known
# word, padded length of the published scorer, order statistic of the length.
PAD_ID = 0
UNKNOWN_ID = 1
FIRST_ID = 2
PADDED_LENGTH = 78
LENGTH_FRACTION = 0.95


def vocabulary(df: DataFrame, token_col: str = "tokens") -> DataFrame:
    """Sorted distinct words ``(word, word_id)``, ids from 2.

    Words are dealt over ranges of equal size, numbered inside their range and shifted
    by the words of earlier ranges, so no prefix that many words share is hot.  The
    ranges are written once, as every pass has to see the same ones.
    """
    ranged = df.select(F.explode(token_col).alias("word")).distinct().repartitionByRange("word")
    words = cut_lineage(ranged.select("word", F.spark_partition_id().alias("_p")))
    sizes = words.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(
        Window.unboundedPreceding, -1)  # one row per range
    starts = sizes.select("_p", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_s"))
    local = F.row_number().over(Window.partitionBy("_p").orderBy("word"))
    return (words.withColumn("_r", local).join(starts, "_p")
            .select("word", (F.col("_s") + F.col("_r") + (FIRST_ID - 1)).cast("long").alias("word_id")))


def stored_vocabulary(df: DataFrame, token_col: str = "tokens") -> DataFrame:
    """``vocabulary``, written once so that its size is known and no reader repeats the count."""
    return cut_lineage(vocabulary(df, token_col))


def label_index(*frames: DataFrame, col: str = "label") -> DataFrame:
    """Sorted distinct labels of all given frames ``(label, label_id)``, ids from 0."""
    labels = frames[0].select(F.col(col).alias("label"))
    for f in frames[1:]:
        labels = labels.union(f.select(F.col(col).alias("label")))
    order = Window.partitionBy(F.lit(0)).orderBy("label")  # one row per class
    return labels.where("label IS NOT NULL").distinct().withColumn(
        "label_id", F.row_number().over(order) - 1)


def encode(df: DataFrame, vocab: DataFrame, id_cols: Sequence[str] = ("id",),
           token_col: str = "tokens", out_col: str = "ids", last: int | None = None) -> DataFrame:
    """Words -> ids in text order; unknown words become 1.

    With ``last`` only that many words at the end of a text are looked up.

    Spark broadcasts a vocabulary it knows to be small, so a text is put together
    before the only shuffle; a larger one is joined by word, where adaptive skew
    splitting handles frequent words.
    """
    keys = list(id_cols)
    looked_up = F.col(token_col)
    if last is not None:
        looked_up = F.slice(looked_up, F.greatest(F.size(looked_up) - last + 1, F.lit(1)), F.lit(last))
    words = df.select(*keys, F.posexplode_outer(looked_up).alias("_pos", "word"))
    known = words.join(vocab, "word", "left")
    cell = F.when(F.col("word").isNotNull(), F.struct(
        "_pos", F.coalesce("word_id", F.lit(UNKNOWN_ID)).cast("long").alias("i")))
    ordered = known.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(cell)), lambda x: x["i"]).alias(out_col))
    others = [c for c in df.columns if c not in keys and c != out_col]
    return df.select(*keys, *others).join(ordered, keys) if others else ordered


def pad(ids: Column, length: int = PADDED_LENGTH) -> Column:
    """Keep the last ``length`` ids and fill short sequences with zeros on the right."""
    n = F.size(ids)
    tail = F.slice(ids, F.greatest(n - length + 1, F.lit(1)), F.lit(length))
    fill = F.array_repeat(F.lit(PAD_ID).cast("long"), F.greatest(F.lit(length) - n, F.lit(0)))
    return F.concat(tail, fill)


def max_length(df: DataFrame, length_col: str, fraction: float = LENGTH_FRACTION) -> DataFrame:
    """``sorted(lengths)[int(n * fraction)]``."""
    return order_statistic(df, length_col, fraction, "max_length")


def unflatten(flat: DataFrame, k: int, pos: str = "pos", value: str = "value",
              prefix: str = "s") -> DataFrame:
    """Flat sequence ``(pos, value)`` -> rows of k values."""
    return (
        flat.groupBy(F.floor(F.col(pos) / k).cast("long").alias("row"))
        .agg(*[F.max(F.when(F.col(pos) % k == i, F.col(value))).alias(f"{prefix}_{i}")
               for i in range(k)])
    )
