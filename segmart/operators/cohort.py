"""New joiners and repeat purchase."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmart.constants import SEGMENT_ORDER
from segmart.operators.customer import visits
from segmart.operators.encode import CUSTOMER
from segmart.operators.pivot import spread
from segmart.operators.segment import SEGMENT
from segmart.operators.skew import lookup_join


def new_joiner(first_purchase: DataFrame, cutoff: str) -> DataFrame:
    """1 when the first purchase is on or after the cutoff, else 0 (also when unknown)."""
    joined = F.col("first_purchase_date") >= F.lit(cutoff).cast("date")
    return first_purchase.select(
        CUSTOMER, "first_purchase_date", F.when(joined, F.lit(1)).otherwise(F.lit(0)).alias("new_joiner_flag")
    )


def segment_visits(
    lines: DataFrame, segments: DataFrame, start: str | None, end: str | None, tag: str = SEGMENT
) -> DataFrame:
    """Visits per (customer, segment) in a date range."""
    return visits(lines, start, end).join(segments.select(CUSTOMER, tag).distinct(), CUSTOMER).select(CUSTOMER, tag, "visit")


def repeat_histogram(
    customer_visits: DataFrame, cohort: DataFrame | None = None, order: Sequence[str] = SEGMENT_ORDER, tag: str = SEGMENT
) -> DataFrame:
    """Customers by number of visits and segment, for all or for the customers in ``cohort``."""
    if cohort is not None:
        customer_visits = customer_visits.join(cohort.select(CUSTOMER), CUSTOMER, "left_semi")
    counted = customer_visits.groupBy("visit", tag).agg(F.count_distinct(CUSTOMER).alias("value"))
    return spread(counted, ["visit"], order, tag)


def repeat_customers(flags: DataFrame, customer_visits: DataFrame, min_visits: int = 2) -> DataFrame:
    """New joiners with at least ``min_visits`` visits, each once."""
    new = flags.where("new_joiner_flag = 1").select(CUSTOMER)
    return new.join(customer_visits.where(F.col("visit") >= min_visits), CUSTOMER, "left_semi").distinct()


def repeat_cohort(
    lines: DataFrame,
    flags: DataFrame,
    customer_visits: DataFrame,
    min_visits: int = 2,
    hot: Mapping[int, int] | None = None,
) -> DataFrame:
    """The sales lines of those customers. A semi join: several segments never repeat a line."""
    return lookup_join(lines, repeat_customers(flags, customer_visits, min_visits), [CUSTOMER], "left_semi", hot)
