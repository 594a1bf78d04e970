"""Exact discrete quantiles without sorting everything in one task."""

from __future__ import annotations

import math
from collections.abc import Sequence
from decimal import localcontext

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmart.functions.columns import named
from segmart.session import materialise

MAX_DRIVER_VALUES = 100_000
CUTS = 64
MAX_DIGITS = 38
CUT_ERROR = 0.001


def exact_quantiles(
    df: DataFrame, column: str, probabilities: Sequence[float], max_values: int = MAX_DRIVER_VALUES
) -> list:
    """The smallest value at or above each share of the non-null rows.

    Equal values are counted first. If few enough remain, their counts decide. Otherwise an
    approximate quantile brackets each wanted rank, the rows below the bracket are counted, and
    the search goes on inside; only the counts of a narrow bracket reach the driver.
    """
    values = df.select(named(column).alias("v")).where("v IS NOT NULL")
    # Stored, as every step of every search reads them.
    counts = materialise(values.groupBy("v").agg(F.count(F.lit(1)).alias("n")), "value_counts")
    known = _few_counts(counts, max_values)
    if known is not None:
        total = sum(n for _, n in known)
        return [_at_rank(known, _rank(p, total)) if total else None for p in probabilities]
    total = counts.agg(F.sum("n")).first()[0]
    return [_search(counts, _rank(p, total), max_values) for p in probabilities]


def _rank(probability: float, total: int) -> int:
    return max(1, math.ceil(probability * total - 1e-9))


def _few_counts(counts: DataFrame, max_values: int) -> list | None:
    # Counted first: the smallest values of every partition would meet in the driver before a limit is applied.
    if counts.limit(max_values + 1).count() > max_values:
        return None
    return [(row["v"], row["n"]) for row in counts.orderBy("v").collect()]


def _at_rank(counts: list, rank: int):
    seen = 0
    for value, n in counts:
        seen += n
        if seen >= rank:
            return value
    return None


def _search(counts: DataFrame, rank: int, max_values: int):
    inside = counts
    steps = [i / CUTS for i in range(1, CUTS)]
    while True:
        known = _few_counts(inside, max_values)
        if known is not None:
            return _at_rank(known, rank)
        # Cut points over the distinct values; the row counts between them show where the rank lies.
        found = inside.select(F.col("v").cast("double").alias("v")).approxQuantile("v", steps, CUT_ERROR)
        cuts = sorted(set(found))
        position = F.col("v").cast("double")
        below = inside.agg(
            *[
                F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)).alias(f"{word}{i}")
                for i, cut in enumerate(cuts)
                for word, test in (("b", position < cut), ("u", position <= cut))
            ]
        ).first()
        lower, upper, skipped, upto = None, None, 0, 0
        for i, cut in enumerate(cuts):
            if below[f"b{i}"] < rank:
                lower, skipped, upto = cut, below[f"b{i}"], below[f"u{i}"]
            else:
                upper = cut
                break
        if lower is not None and upto >= rank:
            # Very many decimals or long integers with one double: what they exceed the least by tells them apart.
            same = inside.where(position == lower)
            known = _few_counts(same, max_values)
            if known is not None:
                return _at_rank(known, rank - skipped)
            least = same.agg(F.min("v")).first()[0]
            kind = same.schema["v"].dataType
            over = same.select((F.col("v") - F.lit(least).cast(kind)).cast(kind).alias("v"), "n")
            with localcontext(prec=MAX_DIGITS):
                return least + _search(over, rank - skipped, max_values)
        if lower is not None:
            inside, rank = inside.where(position > lower), rank - upto
        if upper is not None:
            inside = inside.where(position < upper)
