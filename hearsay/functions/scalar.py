"""Scalar helpers: time, ids, labels, score arrays."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_SECONDS = 86_400

# Prefixes of ids and profiles, account of removed authors,
# length of one scan window (31 days).
POST_ID_PREFIX = "t3_"
PROFILE_PREFIX = "u_"
DELETED_AUTHOR = "[deleted]"
WINDOW_SECONDS = 2_678_400


# ---------------------------------------------------------------- time

def epoch_of(ts: Column) -> Column:
    """Epoch seconds of a zone-less timestamp, whatever the session zone."""
    days = F.unix_date(F.to_date(ts)).cast("long")
    return (days * DAY_SECONDS + F.hour(ts) * 3600 + F.minute(ts) * 60
            + F.second(ts)).cast("long")


def local_time(epoch: Column, tz: str = "UTC") -> Column:
    """Epoch seconds -> wall-clock ``timestamp_ntz`` in ``tz``."""
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    utc = start + F.make_dt_interval(secs=epoch.cast("decimal(18,6)"))
    if tz == "UTC":
        return utc
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), utc)


def date_of(epoch: Column, tz: str = "UTC") -> Column:
    """Calendar day of an epoch in ``tz``; UTC avoids any calendar arithmetic."""
    if tz == "UTC":
        return F.date_from_unix_date(F.floor(epoch / F.lit(DAY_SECONDS)).cast("int"))
    return F.to_date(local_time(epoch, tz))


def parse_date(text: Column, fmt: str | None = None) -> Column:
    return F.to_date(text, fmt) if fmt else F.to_date(text)


def epoch_of_date(day: Column) -> Column:
    return F.unix_date(F.to_date(day)).cast("long") * DAY_SECONDS


# ---------------------------------------------------------------- ids and names

def strip_id_prefix(post_id: Column) -> Column:
    return F.substr(post_id, F.lit(len(POST_ID_PREFIX) + 1))


def is_profile(name: Column) -> Column:
    return name.startswith(PROFILE_PREFIX)


def slice_file_name(path: Column) -> Column:
    """Community name in ``<name>-<epoch>.<ext>``."""
    return F.regexp_extract(path, r"([^/]*)-(\d{10})\.[^/]*$", 1)


def slice_file_start(path: Column) -> Column:
    """Slice start in ``<name>-<epoch>.<ext>``."""
    digits = F.regexp_extract(path, r"([^/]*)-(\d{10})\.[^/]*$", 2)
    return F.nullif(digits, F.lit("")).cast("long")


def unordered_pair(a: Column, b: Column) -> Column:
    """Key of an undirected edge; a struct, so names may hold any character."""
    return F.struct(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))


# ---------------------------------------------------------------- labels

def recode(value: Column, mapping: Mapping) -> Column:
    """Replace mapped values; the others stay as they are."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[value], value)


def lookup(value: Column, mapping: Mapping) -> Column:
    """Dictionary lookup; unmatched values become null."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.create_map(*pairs)[value]


def swap_01(label: Column) -> Column:
    return F.when(label == 0, F.lit(1)).when(label == 1, F.lit(0)).otherwise(label)


def label_from_name(name: Column) -> Column:
    """``LABEL_2`` -> 2."""
    return F.substring(name, -1, 1).cast("int")


# ---------------------------------------------------------------- score arrays

def argmax(scores: Column) -> Column:
    """Index of the largest score; the first one wins a tie."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def is_max(scores: Column) -> Column:
    """1 where a score equals the row maximum, so ties give several ones."""
    return F.transform(scores, lambda s: (s == F.array_max(scores)).cast("int"))


def one_hot(label: Column, n_classes: int) -> Column:
    return F.array(*[(label == i).cast("int") for i in range(n_classes)])


def row_sum(columns: Sequence[Column]) -> Column:
    total = columns[0]
    for c in columns[1:]:
        total = total + c
    return total


def share(part: Column, whole: Column) -> Column:
    """``part / whole`` with null instead of a division by zero."""
    return part / F.nullif(whole, F.lit(0))


def array_columns(array: Column, names: Sequence[str]) -> list[Column]:
    """Array column -> named columns."""
    return [array.getItem(i).alias(n) for i, n in enumerate(names)]
