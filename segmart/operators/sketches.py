"""Quantile sketches as columns: cutoffs per group, from states that merge."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmart.functions.columns import named

SKETCH = "sketch"


def sketch_size(rank_error: float) -> int:
    """The k of a KLL sketch whose ranks are off by at most ``rank_error`` with 99 % confidence."""
    if not 0 < rank_error < 1:
        raise ValueError("a rank error lies between 0 and 1")
    return max(8, min(65535, math.ceil((2.296 / rank_error) ** (1 / 0.9723))))


def quantile_states(df: DataFrame, by: Sequence[str], measure: str, rank_error: float = 0.003) -> DataFrame:
    """(``by``, sketch) of the known values of ``measure``; a group without any has no row.

    A sketch has a bounded size whatever its group holds, and sketches are built before the shuffle.
    """
    known = df.select(*by, named(measure).cast("double").alias(measure)).where(named(measure).isNotNull())
    sketch = F.kll_sketch_agg_double(named(measure), F.lit(sketch_size(rank_error)))
    return known.groupBy(*by).agg(sketch.alias(SKETCH))


def merge_states(states: DataFrame, by: Sequence[str]) -> DataFrame:
    """The sketches of the coarser groups ``by``."""
    return states.groupBy(*by).agg(F.kll_merge_agg_double(SKETCH).alias(SKETCH))


def cutoffs(states: DataFrame, by: Sequence[str], shares: Mapping[str, float]) -> DataFrame:
    """A column for each name in ``shares`` with that quantile of the group; nothing runs while the plan is built."""
    return states.select(
        *by, *[F.kll_sketch_get_quantile_double(SKETCH, F.lit(float(share))).alias(name) for name, share in shares.items()]
    )


def grouped_price_point(
    df: DataFrame, limits: DataFrame, by: Sequence[str], measure: str, low: str = "low", high: str = "high"
) -> DataFrame:
    """2 above the group's ``high``, 0 below its ``low``, else 1, also without a measure or limits.

    A null in ``by`` is a group like any other.
    """
    own = limits.select(*[named(c).alias(f"__{c}") for c in by], named(low).alias("__low"), named(high).alias("__high"))
    same = F.lit(True)
    for column in by:
        same = same & named(column).eqNullSafe(named(f"__{column}"))
    joined = df.join(own, same, "left")
    value = named(measure).cast("double")
    band = F.when(value > F.col("__high"), F.lit(2)).when(value < F.col("__low"), F.lit(0)).otherwise(F.lit(1))
    return joined.withColumn("price_point", band).drop(*[f"__{c}" for c in by], "__low", "__high")
