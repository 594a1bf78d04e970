"""Stage 1: raw warehouse tables -> transaction, demographic, first purchase and item tag tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmart.functions.columns import between_dates, named
from segmart.operators.cards import card_demographics, first_purchase
from segmart.operators.enrich import ValidRules, enrich, sku_table, store_table, subcat_table, valid_lines
from segmart.operators.lines import (
    MONEY,
    distinct_lines,
    drop_net_zero,
    lines_near,
    resolve_master,
    shops_in_scope,
    typed_lines,
)
from segmart.operators.tags import tag_items
from segmart.session import materialise
from segmart.sources.tables import write_parquet


@dataclass(frozen=True)
class Warehouse:
    """The source tables."""

    sales: DataFrame
    cards: DataFrame
    sku: DataFrame
    maincat: DataFrame
    subcat: DataFrame
    stores: DataFrame
    brands: DataFrame | None = None


@dataclass(frozen=True)
class DatamartSettings:
    house_brand: str
    start_date: str | None = None
    end_date: str | None = None
    rules: ValidRules = field(default_factory=ValidRules)
    money_type: str = MONEY


@dataclass(frozen=True)
class Datamart:
    transaction: DataFrame
    demographic: DataFrame
    first_purchase: DataFrame
    item_tags: DataFrame


@dataclass(frozen=True)
class Lookups:
    """Current item, sub category and store descriptions."""

    sku: DataFrame
    subcat: DataFrame
    store: DataFrame


def current_lookups(warehouse: Warehouse, settings: DatamartSettings) -> Lookups:
    """The lookups, small against the lines. Stored, they are measured and joined without rework."""
    return Lookups(
        sku=materialise(sku_table(warehouse.sku, warehouse.maincat), "sku"),
        subcat=materialise(subcat_table(warehouse.subcat), "subcat"),
        store=materialise(store_table(warehouse.stores, settings.house_brand), "store"),
    )


def transactions(warehouse: Warehouse, lookups: Lookups, settings: DatamartSettings) -> DataFrame:
    """The valid, enriched sales lines of the house brand in the date range.

    Order totals see every line of the orders concerned; the date, brand and validity filters
    follow. They concern plain columns, so Spark moves them below the joins and into the Parquet
    scan of the lines.
    """
    in_scope = (F.col("shop_brand") == settings.house_brand) & between_dates(
        F.col("order_date"), settings.start_date, settings.end_date
    )
    raw = typed_lines(warehouse.sales, settings.money_type)
    near = distinct_lines(lines_near(raw, materialise(shops_in_scope(raw, in_scope), "shops")))
    # Orders are judged by their lines with a master each; whole lines look theirs up once their order is known to stay.
    valid = valid_lines(near.where(in_scope), settings.rules)
    kept = drop_net_zero(valid, judged_by=resolve_master(near, warehouse.cards))
    return enrich(resolve_master(kept, warehouse.cards), lookups.sku, lookups.subcat, lookups.store)


def build_datamart(warehouse: Warehouse, settings: DatamartSettings) -> Datamart:
    """All stage-1 tables; the transactions are stored once and the item tags derive from them."""
    transaction = materialise(transactions(warehouse, current_lookups(warehouse, settings), settings), "transaction")
    return Datamart(
        transaction=transaction,
        demographic=card_demographics(warehouse.cards),
        first_purchase=first_purchase(warehouse.sales, warehouse.cards, settings.house_brand),
        item_tags=tag_items(transaction),
    )


def write_datamart(datamart: Datamart, folder: str, by_month: bool = False) -> None:
    """Parquet outputs, overwritten; ``by_month`` partitions the transactions for date pruning."""
    transaction, partitions = datamart.transaction, []
    if by_month:
        transaction = transaction.withColumn("order_month", F.date_trunc("month", named("order_date")).cast("date"))
        partitions = ["order_month"]
    write_parquet(transaction, f"{folder}/transaction.parquet", partition_by=partitions)
    write_parquet(datamart.demographic, f"{folder}/demographic.parquet")
    write_parquet(datamart.first_purchase, f"{folder}/first_purchase.parquet")
    write_parquet(datamart.item_tags, f"{folder}/item_attr_tagging.parquet")
