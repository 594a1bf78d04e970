"""Measures by segment, with the segments as columns.

Sales lines are summed or made distinct per customer first and only then joined with the segments:
the join sees a few rows per customer however many lines that customer has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmart.constants import NOT_AVAILABLE, SEGMENT_ORDER, UNKNOWN
from segmart.functions.columns import between_dates, named
from segmart.operators.encode import CUSTOMER
from segmart.operators.segment import SEGMENT
from segmart.operators.skew import lookup_join

SUM, DISTINCT = "sum", "distinct"


def spread(long: DataFrame, by: Sequence[str], order: Sequence[str], tag: str = SEGMENT, value: str = "value") -> DataFrame:
    """One column per listed segment in the given order; null where a segment has no row."""
    cells = [F.sum(F.when(named(tag) == F.lit(label), named(value))).alias(label) for label in order]
    return long.groupBy(*by).agg(*cells)


def _tagged(
    lines: DataFrame, segments: DataFrame, by: Sequence[str], measure: str, how: str, tag: str
) -> tuple[DataFrame, Column]:
    """Per-customer rows with their segment, and the aggregate that finishes the measure."""
    tags, keys = segments.select(CUSTOMER, tag), [CUSTOMER, *by]
    if how == SUM:
        per_customer = lines.groupBy(*keys).agg(F.sum(measure).alias("value"))
        return per_customer.join(tags, CUSTOMER), F.sum("value")
    if measure == CUSTOMER:
        per_customer = lines.select(*keys).distinct().withColumn("value", F.lit(1).cast("long"))
        return per_customer.join(tags.distinct(), CUSTOMER), F.sum("value")
    # Here a customer may still hold very many rows, one per counted value.
    values = lines.where(named(measure).isNotNull()).select(*keys, named(measure).alias("value")).distinct()
    return lookup_join(values, tags.distinct(), [CUSTOMER], "inner"), F.count_distinct("value")


def segment_measure(
    lines: DataFrame, segments: DataFrame, by: Sequence[str], measure: str, how: str = SUM, tag: str = SEGMENT
) -> DataFrame:
    """Long form: ``value`` per (``by``, segment)."""
    tagged, finish = _tagged(lines, segments, by, measure, how, tag)
    return tagged.groupBy(*by, tag).agg(finish.alias("value"))


def segment_pivot(
    lines: DataFrame,
    segments: DataFrame,
    by: Sequence[str],
    measure: str,
    how: str = SUM,
    order: Sequence[str] = SEGMENT_ORDER,
    tag: str = SEGMENT,
) -> DataFrame:
    """Sum or distinct count of ``measure`` by ``by`` (none: one total row) and segment.

    Sums go straight into the segment columns in one aggregate. Other distinct counts are finished
    per segment first.
    """
    tagged, finish = _tagged(lines, segments, by, measure, how, tag)
    if how == SUM or measure == CUSTOMER:
        return spread(tagged, by, order, tag)
    return spread(tagged.groupBy(*by, tag).agg(finish.alias("value")), by, order, tag)


def attribute_pivot(
    attributes: DataFrame,
    segments: DataFrame,
    by: str,
    order: Sequence[str] = SEGMENT_ORDER,
    tag: str = SEGMENT,
) -> DataFrame:
    """Customers by a per-customer attribute and segment; ``attributes`` has one row per customer."""
    joined = attributes.select(CUSTOMER, by).join(segments.select(CUSTOMER, tag).distinct(), CUSTOMER)
    return spread(joined.groupBy(by, tag).agg(F.count_distinct(CUSTOMER).alias("value")), [by], order, tag)


def category_pivot(
    lines: DataFrame,
    segments: DataFrame,
    by: str,
    measure: str,
    how: str = SUM,
    start: str | None = None,
    end: str | None = None,
    order: Sequence[str] = SEGMENT_ORDER,
    tag: str = SEGMENT,
    parity: bool = False,
) -> DataFrame:
    """Measure by category and segment, with null and "N/A" shown as "Unknown".

    By default categories are relabelled before they are grouped. ``parity`` groups on the raw
    values and relabels afterwards: groups that then look equal count once, and customers in
    several of them count several times, as the original reports have it.
    """
    windowed = lines.where(between_dates(F.col("order_date"), start, end))
    label = F.when(named(by).isNull() | (named(by) == NOT_AVAILABLE), F.lit(UNKNOWN)).otherwise(named(by))
    if parity:
        raw = segment_measure(windowed, segments, [by], measure, how, tag)
        return spread(raw.select(label.alias(by), tag, "value").distinct(), [by], order, tag)
    return segment_pivot(windowed.withColumn(by, label), segments, [by], measure, how, order, tag)
