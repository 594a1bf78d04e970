"""Item and brand lists and control totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmart.operators.encode import CUSTOMER
from segmart.operators.skew import lookup_join


def item_list(lines: DataFrame) -> DataFrame:
    return lines.select("prod_brand", "item_desc", "maincat_desc", "item_subcat_desc").distinct()


def brand_list(lines: DataFrame, brands: DataFrame) -> DataFrame:
    """Distinct brands with description; a brand without one stays with null."""
    return brand_descriptions(lines.select("prod_brand").distinct(), brands).distinct()


def brand_descriptions(report: DataFrame, brands: DataFrame) -> DataFrame:
    """Add ``brand_desc`` to a table with a ``prod_brand`` column."""
    names = brands.select(F.col("brand_code").alias("prod_brand"), "brand_desc")
    return lookup_join(report, names, ["prod_brand"])


def control_totals(lines: DataFrame, measure: str = "net_amt_hkd") -> DataFrame:
    return lines.agg(F.count_distinct(CUSTOMER).alias("customers"), F.sum(measure).alias("amount"))
