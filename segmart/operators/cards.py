"""Card demographics and first purchase."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmart.functions.columns import lenient_cast, trim_strings
from segmart.operators.lines import card_masters

CARD_ATTRIBUTES = [
    "vip_no",
    "vip_type",
    "vip_issue_date",
    "vip_sex",
    "vip_nation",
    "vip_agegrp",
    "region_key",
    "vip_staff_flag",
]


def card_demographics(cards: DataFrame) -> DataFrame:
    """Cards with a master customer: attributes and the smallest master."""
    return (
        cards.where(F.col("vip_main_no").isNotNull())
        .groupBy(*CARD_ATTRIBUTES)
        .agg(F.min("vip_main_no").alias("vip_main_no"))
    )


def first_purchase(sales: DataFrame, cards: DataFrame, brand: str) -> DataFrame:
    """First purchase date per customer at one shop brand, over the whole history.

    Dates are reduced to one per card before the card join, so no sales line is shuffled by
    customer and a much-used card costs one row.
    """
    trimmed = trim_strings(sales.select("sales_date", "shop_brand", "vip_no"))
    per_card = (
        trimmed.where(F.col("shop_brand") == brand)
        .select("vip_no", lenient_cast(trimmed, "sales_date", "date").alias("first_date"))
        .groupBy("vip_no")
        .agg(F.min("first_date").alias("first_date"))
    )
    return (
        per_card.join(card_masters(cards), "vip_no", "left")
        .groupBy(F.coalesce("vip_main_no", "vip_no").alias("vip_main_no"))
        .agg(F.min("first_date").alias("first_purchase_date"))
    )
