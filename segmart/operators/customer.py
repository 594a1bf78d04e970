"""Per-customer summaries: tenure, demographics, visits, amounts, price point."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmart.constants import (
    AGE_LABELS,
    KNOWN_NATIONALITIES,
    OTHER_NATIONALITY,
    PRICE_POINT_ERROR,
    PRICE_POINT_HIGH,
    PRICE_POINT_LOW,
    TENURE_BANDS,
    TENURE_OPEN_BAND,
    UNKNOWN_SEX,
)
from segmart.functions.columns import between_dates, named, normalised_sex, relabel, tenure_years
from segmart.operators.encode import CUSTOMER
from segmart.operators.quantile import exact_quantiles

DEMOGRAPHIC_COLUMNS = ["customer_sex", "cust_nat_cat", "tenure", "age"]


def tenure_band(years: Column, unknown_label: str = TENURE_OPEN_BAND) -> Column:
    band = F.when(years.isNull(), F.lit(unknown_label))
    for bound, label in TENURE_BANDS:
        band = band.when(years <= bound, F.lit(label))
    return band.otherwise(F.lit(TENURE_OPEN_BAND))


def tenure(first_purchase: DataFrame, as_of: str) -> DataFrame:
    """Whole years since the first purchase, rounded half up, and the band."""
    years = tenure_years(F.col("first_purchase_date"), as_of)
    return first_purchase.select(
        CUSTOMER, "first_purchase_date", years.alias("tenure"), tenure_band(years).alias("tenure_band")
    ).distinct()


def nationality_group(column: Column) -> Column:
    return F.when(column.isin(*KNOWN_NATIONALITIES), column).otherwise(F.lit(OTHER_NATIONALITY))


def age_label(column: Column) -> Column:
    return relabel(column, AGE_LABELS, F.lit(None).cast("string"))


def demographics(lines: DataFrame, tenures: DataFrame) -> DataFrame:
    """Sex, nationality group and age label per (customer, tenure band).

    Lines are summarised per customer before the tenure join, which gives the same groups.
    """
    per_customer = lines.groupBy(CUSTOMER).agg(
        F.min(normalised_sex(F.col("customer_sex"), True, UNKNOWN_SEX)).alias("customer_sex"),
        F.min(nationality_group(F.col("cust_nat_cat"))).alias("cust_nat_cat"),
        F.max(age_label(F.col("customer_age_group"))).alias("age"),
    )
    return (
        per_customer.join(tenures.select(CUSTOMER, "tenure_band"), CUSTOMER, "left")
        .withColumn("tenure", F.coalesce("tenure_band", F.lit(TENURE_OPEN_BAND)))
        .groupBy(CUSTOMER, "tenure")
        .agg(
            F.min("customer_sex").alias("customer_sex"),
            F.min("cust_nat_cat").alias("cust_nat_cat"),
            F.max("age").alias("age"),
        )
        .select(CUSTOMER, *DEMOGRAPHIC_COLUMNS)
    )


def visits(
    lines: DataFrame,
    start: str | None = None,
    end: str | None = None,
    keys: Sequence[str] = ("order_date", "shop_code"),
) -> DataFrame:
    """Distinct visits per customer in a date range; a visit with an unknown key counts nothing."""
    known = F.lit(True)
    for key in keys:
        known = known & named(key).isNotNull()
    return (
        lines.where(between_dates(F.col("order_date"), start, end))
        .select(CUSTOMER, *keys)
        .distinct()
        .groupBy(CUSTOMER)
        .agg(F.count(F.when(known & F.col(CUSTOMER).isNotNull(), 1)).alias("visit"))
    )


def transactional(
    lines: DataFrame, start: str | None = None, end: str | None = None, order_key: str = "invoice_no"
) -> DataFrame:
    """Amount, quantity, orders, visits in the date range and average item value per customer."""
    totals = lines.groupBy(CUSTOMER).agg(
        F.sum("net_amt_hkd").alias("net_amt_hkd"),
        F.sum("sold_qty").alias("sold_qty"),
        F.count_distinct(order_key).alias("invoice_no"),
    )
    average = F.try_divide(F.col("net_amt_hkd").cast("double"), F.col("sold_qty").cast("double"))
    return totals.join(visits(lines, start, end), CUSTOMER, "left").withColumn("avg_item_value", average)


def price_cutoffs(
    df: DataFrame,
    measure: str = "net_amt_hkd",
    high: float = PRICE_POINT_HIGH,
    low: float = PRICE_POINT_LOW,
    relative_error: float = PRICE_POINT_ERROR,
) -> tuple:
    """Both cutoffs from one sketch pass, or exactly when ``relative_error`` is 0."""
    if relative_error == 0:
        upper, lower = exact_quantiles(df, measure, [high, low])
    else:
        upper, lower = df.select(named(measure).cast("double").alias("v")).approxQuantile(
            "v", [high, low], relative_error
        )
    return upper, lower


def price_point(df: DataFrame, cutoffs: tuple, measure: str = "net_amt_hkd") -> DataFrame:
    """2 above the high cutoff, 0 below the low one, 1 between, on a cutoff or unknown."""
    upper, lower = cutoffs
    band = (
        F.when(named(measure) > F.lit(upper), F.lit(2)).when(named(measure) < F.lit(lower), F.lit(0)).otherwise(F.lit(1))
    )
    return df.withColumn("price_point", band)
