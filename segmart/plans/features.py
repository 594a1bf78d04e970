"""Stage 3: per-customer feature tables from the datamart."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmart.operators.clean import clean_for_features
from segmart.operators.customer import (
    DEMOGRAPHIC_COLUMNS,
    demographics,
    price_cutoffs,
    price_point,
    tenure,
    transactional,
)
from segmart.operators import sparse
from segmart.operators.encode import CUSTOMER, distinct_values, one_hot
from segmart.operators.tags import attach_tags
from segmart.plans.datamart import Datamart
from segmart.session import materialise
from segmart.sources.tables import write_parquet

SUBCAT, MAINCAT, BRAND = "item_subcat_desc_cleaned", "maincat_desc_cleaned", "prod_brand"
CATEGORIES = {"subcat": SUBCAT, "maincat": MAINCAT, "brand": BRAND}
# Feature tables that clustering joins, in a fixed order; tags are optional per customer.
CLUSTERING_TABLES = [
    "subcat",
    "maincat",
    "brand",
    "share_of_wallet_subcat",
    "share_of_wallet_maincat",
    "share_of_wallet_brand",
    "tagging",
]


@dataclass(frozen=True)
class FeatureSettings:
    as_of: str
    visit_start: str | None = None
    visit_end: str | None = None
    fan_out: bool = False
    values: Mapping[str, Sequence[str]] = field(default_factory=dict)
    price_error: float = 0.01


def purchase_totals(clean: DataFrame) -> DataFrame:
    """Quantity and amount per (customer, categories, brand, item): the one pass over the lines
    that all count and share features are derived from."""
    return clean.groupBy(CUSTOMER, SUBCAT, MAINCAT, BRAND, "item_desc").agg(
        F.sum("sold_qty").alias("sold_qty"), F.sum("net_amt_hkd").alias("net_amt_hkd")
    )


def feature_values(totals: DataFrame, item_tags: DataFrame, fan_out: bool = False) -> DataFrame:
    """What every customer bought of every category value and tag, in long form."""
    per_item = totals.groupBy(CUSTOMER, "item_desc").agg(F.sum("sold_qty").alias("sold_qty"))
    return sparse.customer_values(totals, CATEGORIES, attach_tags(per_item, item_tags, fan_out=fan_out))


def category_values(values: DataFrame) -> dict[str, list[str]]:
    """The values that occur, by category, as names of columns; their catalogue is read once."""
    found: dict[str, list[str]] = {name: [] for name in (*CATEGORIES, sparse.TAG)}
    for row in values.where("value IS NOT NULL").select("category", "value").distinct().collect():
        found[row["category"]].append(row["value"])
    return {name: sorted(members) for name, members in found.items()}


def encoded_tables(values: DataFrame, names: Mapping[str, Sequence[str]]) -> dict[str, DataFrame]:
    """The count and share tables with a column for each name of a category."""
    present = {name: [v for v in members if v != ""] for name, members in names.items()}
    counts = {name: sparse.wide_counts(values, name, present[name]) for name in CATEGORIES}
    shares = {f"share_of_wallet_{name}": sparse.wide_shares(values, name, names[name]) for name in CATEGORIES}
    return counts | shares | {"tagging": sparse.wide_counts(values, sparse.TAG, present[sparse.TAG])}


def build_features(datamart: Datamart, settings: FeatureSettings) -> dict[str, DataFrame]:
    """Feature tables by name: ``customer_features`` in long form, from which stage 4 starts, and the wide ones.

    Wide tables have a column for every value that occurs, or for those in ``settings.values``.
    """
    clean = clean_for_features(datamart.transaction)
    totals = materialise(purchase_totals(clean), "purchase_totals")
    values = materialise(feature_values(totals, datamart.item_tags, settings.fan_out), "customer_values")
    names = category_values(values)
    given = {name: settings.values[column] for name, column in (*CATEGORIES.items(), (sparse.TAG, "tags")) if column in settings.values}
    # Stored, as the cutoffs are read from it before the bands are set.
    spending = materialise(transactional(clean, settings.visit_start, settings.visit_end), "spending")
    return encoded_tables(values, names | given) | {
        "customer_features": materialise(sparse.customer_features(values), "customer_features"),
        "demographic": demographic_features(clean, datamart.first_purchase, settings.as_of),
        "transactional": price_point(spending, price_cutoffs(spending, relative_error=settings.price_error)),
    }


def demographic_features(
    clean: DataFrame, first_purchase: DataFrame, as_of: str, categories: Mapping[str, Sequence[str]] | None = None
) -> DataFrame:
    """One-hot demographics; without given categories, those that occur."""
    summary = demographics(clean, tenure(first_purchase, as_of))
    if categories is None:
        # Stored, as every column's values are read from it before the flags are set.
        summary = materialise(summary, "demographics")
        categories = {c: distinct_values(summary, c) for c in DEMOGRAPHIC_COLUMNS}
    return one_hot(summary, categories)


def write_features(features: Mapping[str, DataFrame], folder: str) -> None:
    for name, df in features.items():
        write_parquet(df, f"{folder}/{name}.parquet")
