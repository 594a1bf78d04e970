"""Exact distinct counts that add up: bitmaps of dense ids for each group and period.

A count of distinct orders of a year is not the sum of its months' counts. The bitmaps of the months are kept
instead, and those of any window are joined by OR: the lines are read once for all windows to come.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmart.functions.columns import named
from segmart.session import materialise

ID, BUCKET, BITMAP = "value_id", "bucket", "bitmap"
# monotonically_increasing_id counts rows below this bit and partitions above it.
ROW_BITS = 33


def value_ids(df: DataFrame, value: str, period: str) -> DataFrame:
    """(value, value_id) for every value that occurs but null, stored.

    Ids run without gaps inside each range of (first period, value). Values of one period lie side by side,
    so a period's bitmaps are few and full.
    """
    return materialise(_numbered(_first_periods(df, value, period), value, 0), "value_ids")


def extend_ids(ids: DataFrame, df: DataFrame, value: str, period: str) -> DataFrame:
    """``ids`` and, behind all of them, new ids for the values of ``df`` without one, stored; earlier ids stay."""
    known = ids.select(named(value))
    fresh = _first_periods(df, value, period).join(known, value, "left_anti")
    last = ids.agg(F.max(ID)).first()[0]
    used = 0 if last is None else (last >> ROW_BITS) + 1
    return materialise(ids.unionByName(_numbered(fresh, value, used)), "value_ids")


def _first_periods(df: DataFrame, value: str, period: str) -> DataFrame:
    seen = df.where(named(value).isNotNull())
    return seen.groupBy(named(value).alias(value)).agg(F.min(named(period)).alias("__first"))


def _numbered(firsts: DataFrame, value: str, used: int) -> DataFrame:
    # Numbers depend on the partitions, so the result is stored before anything refers to them.
    ranged = firsts.repartitionByRange("__first", named(value)).sortWithinPartitions("__first", named(value))
    return ranged.select(named(value), (F.monotonically_increasing_id() + F.lit(used << ROW_BITS)).alias(ID))


def distinct_states(df: DataFrame, ids: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(``by``, bucket, bitmap): which values occur in each group, 32,768 to a bitmap.

    A value repeated in a group is set again, nothing else. Bits are set before the shuffle, so a task sends at
    most one bitmap of 4 KB for each group and bucket, and a group with very many values is spread over its buckets.
    """
    used = df.select(*by, value).where(named(value).isNotNull()).distinct()
    return (
        used.join(ids, value)
        .groupBy(*by, F.bitmap_bucket_number(ID).alias(BUCKET))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(ID)).alias(BITMAP))
    )


def merge_states(states: DataFrame, by: Sequence[str]) -> DataFrame:
    """The states of the coarser groups ``by``, none for a single group."""
    return states.groupBy(*by, BUCKET).agg(F.bitmap_or_agg(BITMAP).alias(BITMAP))


def distinct_counts(states: DataFrame, by: Sequence[str], name: str = "value") -> DataFrame:
    """Distinct values of every group of ``by``; groups without any have no row."""
    merged = merge_states(states, by)
    return merged.groupBy(*by).agg(F.sum(F.bitmap_count(BITMAP)).alias(name))


def in_windows(states: DataFrame, period: str, windows: Sequence[tuple[str, str]]) -> DataFrame:
    """Every state once for each closed window of periods that it lies in, named "first-last" in ``window``."""
    inside = [
        F.when(named(period).between(first, last), F.lit(f"{first}-{last}")) for first, last in windows
    ]
    return states.withColumn("window", F.explode(F.array_compact(F.array(*inside))))
