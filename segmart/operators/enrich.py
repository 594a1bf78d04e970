"""Product and store lookups, and the rules for a valid transaction."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmart.functions.columns import lenient_cast
from segmart.operators.skew import lookup_join
from segmart.operators.snapshot import latest_snapshot

SKU_ATTRIBUTES = [
    "item_desc",
    "item_cat",
    "item_sub_cat",
    "brand_code",
    "retail_price_hk",
    "retail_price_tw",
    "item_product_line_desc",
    "maincat_desc",
]


def sku_table(sku: DataFrame, maincat: DataFrame) -> DataFrame:
    """Latest version of every item with its main category."""
    versions = sku.select(
        "item_code",
        "item_desc",
        "item_desc_c",
        "item_cat",
        "maincat_key",
        "item_sub_cat",
        "item_product_line",
        "item_product_line_desc",
        "brand_code",
        "retail_price_hk",
        "retail_price_tw",
        lenient_cast(sku, "last_modified_date", "date").alias("last_modified_date"),
    ).distinct()
    latest = latest_snapshot(versions, ["item_code"], "last_modified_date")
    names = maincat.select("maincat_key", "maincat_code", "maincat_desc").distinct()
    return lookup_join(latest, names, ["maincat_key"])


def subcat_table(subcat: DataFrame) -> DataFrame:
    """Latest sub category names; the newest load wins per (brand, sub category), over all categories."""
    columns = ["item_brand_key", "item_cat", "item_sub_cat", "item_subcat_desc"]
    versions = subcat.select(*columns, "load_date").distinct()
    return latest_snapshot(versions, ["item_brand_key", "item_sub_cat"], "load_date").select(*columns).distinct()


def store_table(stores: DataFrame, house_brand: str) -> DataFrame:
    """Latest description of every store of the house brand."""
    versions = stores.where(F.col("shop_brand") == house_brand).select(
        "shop_code", "shop_desc", "city_district", lenient_cast(stores, "modified_date", "date").alias("modified_date")
    )
    latest = latest_snapshot(versions.distinct(), ["shop_code"], "modified_date")
    return latest.select("shop_code", "shop_desc", "city_district").distinct()


def enrich(
    lines: DataFrame,
    sku: DataFrame,
    subcat: DataFrame,
    store: DataFrame,
) -> DataFrame:
    """Add item, sub category and store descriptions to distinct lines.

    The lookups are reduced to the wanted columns and made distinct first: joined to distinct
    lines they cannot give two equal rows, so the result needs no distinct of its own.
    Lines move for the items only: shops are a small list beside the lines, as sub categories are,
    and a busy shop would bring very many of them to one task.
    """
    items = (
        sku.select("item_code", *SKU_ATTRIBUTES)
        .distinct()
        .withColumns({"prod_brand": F.col("brand_code")})
    )
    subcats = subcat.select(
        F.col("item_brand_key").alias("prod_brand"), "item_sub_cat", "item_cat", "item_subcat_desc"
    ).distinct()
    shops = store.select("shop_code", "shop_desc").distinct()
    with_item = lookup_join(lines, items, ["item_code", "prod_brand"], "left")
    with_subcat = lookup_join(with_item, subcats, ["prod_brand", "item_sub_cat", "item_cat"], "left")
    return lookup_join(with_subcat, F.broadcast(shops), ["shop_code"], "left")


@dataclass(frozen=True)
class ValidRules:
    """What makes a line count; None leaves a rule out."""

    house_brand: str | None = None
    regions: tuple[str, ...] | None = None
    excluded_items: tuple[str, ...] = ()
    excluded_dates: tuple[str, ...] = ()
    valid_flag: str | None = "1"
    drop_voided: bool = True

    def condition(self) -> Column:
        test = F.lit(True)
        if self.house_brand is not None:
            test = test & (F.col("shop_brand") == self.house_brand)
        if self.regions is not None:
            test = test & F.col("region_key").isin(*self.regions)
        for item in self.excluded_items:
            test = test & (F.col("item_code") != item)
        for day in self.excluded_dates:
            test = test & (F.col("order_date") != F.lit(day).cast("date"))
        if self.valid_flag is not None:
            # Text against text: under ANSI a number would fail on flags such as 'Y'.
            test = test & (F.col("valid_tx_flag").cast("string") == self.valid_flag)
        if self.drop_voided:
            test = test & F.col("void_flag").isNull()
        return test


def valid_lines(df: DataFrame, rules: ValidRules) -> DataFrame:
    return df.where(rules.condition())
