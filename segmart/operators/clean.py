"""Category clean-up for features and for profiling (two different rule sets)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmart.constants import FEATURE_JUNK, FEATURE_RENAMES, PROFILE_RENAMES
from segmart.functions.columns import relabel


def clean_for_features(
    lines: DataFrame,
    renames: Mapping[str, Mapping[str, str]] = FEATURE_RENAMES,
    junk: Mapping[str, Sequence[str]] = FEATURE_JUNK,
) -> DataFrame:
    """Keep lines with a customer, a brand and real categories; add the cleaned category names."""
    customer = F.col("vip_main_no")
    kept = lines.where(
        customer.isNotNull()
        & (customer != "")
        & ~F.col("prod_brand").isin(*junk["brand"])
        & ~F.col("item_subcat_desc").isin(*junk["subcat"])
        & ~F.col("maincat_desc").isin(*junk["maincat"])
    )
    return kept.withColumns(
        {
            "item_subcat_desc_cleaned": relabel(F.col("item_subcat_desc"), renames["subcat"]),
            "maincat_desc_cleaned": relabel(F.col("maincat_desc"), renames["maincat"]),
        }
    )


def clean_for_profiling(
    lines: DataFrame,
    excluded_brands: Sequence[str],
    renames: Mapping[str, Mapping[str, str]] = PROFILE_RENAMES,
) -> DataFrame:
    """Relabel junk categories, add the combined label, drop excluded brands and lines without one."""
    maincat = relabel(F.col("maincat_desc"), renames["maincat"])
    subcat = relabel(F.col("item_subcat_desc"), renames["subcat"])
    return lines.where(~F.col("prod_brand").isin(*excluded_brands)).withColumns(
        {
            "maincat_desc_cleaned": maincat,
            "item_subcat_desc_cleaned": subcat,
            "maincat_and_subcat": F.concat(maincat, F.lit(" - "), subcat),
        }
    )
