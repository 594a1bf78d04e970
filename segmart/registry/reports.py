"""Registered segment, cohort, cross-class and list queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmart.constants import SEGMENT_ORDER
from segmart.functions.columns import named, year_month
from segmart.operators import cohort, cross, distinct_states, sketches
from segmart.operators.encode import CUSTOMER
from segmart.operators.lists import brand_descriptions, brand_list, control_totals, item_list
from segmart.operators.pivot import spread
from segmart.operators.segment import SEGMENT, attach_segments
from segmart.registry.mart import Mart
from segmart.sources import retail

CATEGORIES = {
    "maincat_subcat": "maincat_and_subcat",
    "subcat": "item_subcat_desc_cleaned",
    "brand": "prod_brand",
    "maincat": "maincat_desc_cleaned",
}
MEASURES = ["amount", "qty", "customers"]
MONTH_WINDOWS = [("200008", "200107"), ("199701", "199712"), ("199707", "199806"), ("199201", "200212")]
PRICE_SHARES = {"low": 0.3, "high": 0.8}
UNSEEN_LABELS = ["cluster 1", "cluster 2", "cluster 3", "cluster 4"]


def cells(df: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """Segment columns as doubles: counts with gaps have no common integer form."""
    labels = labels or SEGMENT_ORDER
    return df.select(
        *[named(c).cast("double").alias(c) if c in labels else named(c) for c in df.columns]
    )


def segmented_lines(mart: Mart) -> DataFrame:
    return attach_segments(mart.reports.lines, mart.reports.segments)


def brand_description(mart: Mart) -> DataFrame:
    return cells(brand_descriptions(mart.reports.category("prod_brand", "customers"), mart.warehouse.brands))


def cross_class_matrix(mart: Mart) -> DataFrame:
    """All segments, with a column for every class that any of them has."""
    return cross.as_matrices(mart.reports.cross_class(), "customers")


def segment_orders_merged(mart: Mart) -> DataFrame:
    """Orders by segment in the report window, from the states of its months."""
    first, last = (day[:7].replace("-", "") for day in retail.WINDOW)
    states = mart.order_states.where(F.col("yyyymm").between(first, last))
    return cells(spread(distinct_states.distinct_counts(states, [SEGMENT]), [], SEGMENT_ORDER))


def segment_orders_windows(mart: Mart) -> DataFrame:
    """Orders by segment in overlapping windows of months, all from one scan of the states."""
    states = distinct_states.in_windows(mart.order_states, "yyyymm", MONTH_WINDOWS)
    return distinct_states.distinct_counts(states, ["window", SEGMENT], "orders").withColumnRenamed("window", "months")


def monthly_amounts(mart: Mart) -> DataFrame:
    """Amounts per segment, customer and month."""
    reports = mart.reports
    amounts = reports.lines.groupBy(CUSTOMER, year_month(F.col("order_date")).alias("yyyymm")).agg(
        F.sum("net_amt_hkd").alias("amount")
    )
    return amounts.join(reports.segments.select(CUSTOMER, SEGMENT).distinct(), CUSTOMER)


def segment_cutoffs_check(mart: Mart) -> DataFrame:
    """Amounts by segment, and whether the ranks of its cutoffs, merged from monthly sketches, are off by at most 1 %."""
    amounts = monthly_amounts(mart)
    monthly = sketches.quantile_states(amounts, [SEGMENT, "yyyymm"], "amount")
    limits = sketches.cutoffs(sketches.merge_states(monthly, [SEGMENT]), [SEGMENT], PRICE_SHARES)
    value = F.col("amount").cast("double")
    ranks = [
        F.sum(test(value, F.col(name)).cast("long")).alias(f"{word}_{name}")
        for name in PRICE_SHARES
        for word, test in (("below", lambda v, c: v < c), ("upto", lambda v, c: v <= c))
    ]
    counted = amounts.join(limits, SEGMENT).groupBy(SEGMENT).agg(F.count("amount").alias("amounts"), *ranks)
    within = [
        (
            (F.col(f"below_{name}") <= (share + 0.01) * F.col("amounts") + 1)
            & (F.col(f"upto_{name}") >= (share - 0.01) * F.col("amounts") - 1)
        ).alias(f"{name}_within")
        for name, share in PRICE_SHARES.items()
    ]
    return counted.select(SEGMENT, "amounts", *within)


QUERIES: dict[str, Callable[[Mart], DataFrame]] = {
    "clean_profiling": lambda t: t.reports.lines.select(
        CUSTOMER, "sales_main_key", "item_code", "sold_qty", "net_amt_hkd", *CATEGORIES.values()
    ),
    "persona_labels": lambda t: t.reports.personas,
    "segment_override": lambda t: t.reports.segments,
    "segmented_lines": lambda t: segmented_lines(t).select(
        CUSTOMER, "persona", "customer_tag", "sales_main_key", "item_code", "order_date", "sold_qty", "net_amt_hkd"
    ),
    "segment_customers": lambda t: cells(t.reports.customers()),
    "segment_gender": lambda t: cells(t.reports.gender()),
    "segment_tenure": lambda t: cells(t.reports.tenure()),
    "segment_nationality": lambda t: cells(t.reports.nationality()),
    "segment_region": lambda t: cells(t.reports.region()),
    "segment_age": lambda t: cells(t.reports.age()),
    "segment_amount": lambda t: cells(t.reports.amount()),
    "segment_qty": lambda t: cells(t.reports.qty()),
    "segment_orders": lambda t: cells(t.reports.orders()),
    "segment_orders_merged": segment_orders_merged,
    "segment_orders_windows": segment_orders_windows,
    "segment_cutoffs_check": segment_cutoffs_check,
    "segment_orders_by_key": lambda t: cells(t.reports.orders("sales_main_key")),
    "segment_visits": lambda t: cells(t.reports.visits()),
    "store_customers": lambda t: cells(t.reports.store("customers")),
    "store_amount": lambda t: cells(t.reports.store("amount")),
    "month_customers": lambda t: cells(t.reports.month("customers")),
    "month_amount": lambda t: cells(t.reports.month("amount")),
    **{
        f"category_{measure}_{name}": lambda t, by=by, measure=measure: cells(t.reports.category(by, measure))
        for name, by in CATEGORIES.items()
        for measure in MEASURES
    },
    **{f"category_{measure}_tag": lambda t, measure=measure: cells(t.reports.tag(measure)) for measure in MEASURES},
    **{
        f"category_parity_{measure}_{name}": lambda t, by=by, measure=measure: cells(
            t.reports.category(by, measure, parity=True)
        )
        for name, by in CATEGORIES.items()
        for measure in MEASURES
    },
    **{
        f"category_parity_{measure}_tag": lambda t, measure=measure: cells(
            t.reports.tag(measure, fan_out=True, parity=True)
        )
        for measure in MEASURES
    },
    "brand_description": brand_description,
    "new_joiner_flag": lambda t: t.reports.new_joiners(),
    "segment_customer_visits": lambda t: t.reports.segment_visits(),
    "repeat_histogram": lambda t: cells(t.reports.repeat_histogram()),
    "new_vs_existing": lambda t: cells(t.reports.new_vs_existing()),
    "persona_visit_histogram": lambda t: cells(t.reports.persona_visits("Beautyholic")),
    "repeat_cohort_lines": lambda t: t.reports.repeat_lines().select(
        CUSTOMER, "persona", "customer_tag", "sales_main_key", "item_code", "sold_qty", "net_amt_hkd"
    ),
    "repeat_cohort_customers": lambda t: cells(t.reports.repeat_customers()),
    "repeat_cohort_amount": lambda t: cells(t.reports.repeat_amount()),
    "repeat_cohort_category": lambda t: cells(t.reports.repeat_category()),
    "repeat_cohort_category_unseen": lambda t: cells(t.reports.repeat_category(UNSEEN_LABELS), UNSEEN_LABELS),
    "returning_customers": lambda t: cohort.repeat_customers(t.reports.new_joiners(), t.reports.segment_visits()),
    "cross_class_customers": lambda t: t.reports.cross_class(),
    "cross_class_customers_subcat": lambda t: t.reports.cross_class("maincat_and_subcat"),
    "cross_class_pair_sum": lambda t: t.reports.cross_class_sum(),
    "cross_class_pair_amount": lambda t: t.reports.cross_class_sum("net_amt_hkd"),
    "cross_class_matrix": cross_class_matrix,
    "item_list": lambda t: item_list(t.transaction),
    "brand_list": lambda t: brand_list(t.transaction, t.warehouse.brands),
    "control_totals": lambda t: control_totals(t.transaction),
}
