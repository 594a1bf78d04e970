"""Per-customer encodings of categories: counts, shares of wallet, one-hot flags, value lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmart.functions.columns import named, quoted

CUSTOMER = "vip_main_no"
MAX_CATEGORIES = 10_000


def distinct_values(df: DataFrame, column: str, max_values: int = MAX_CATEGORIES) -> list:
    """Sorted non-null values of a category; refuses a column with too many to become columns."""
    rows = df.select(named(column).alias("v")).where("v IS NOT NULL").distinct().limit(max_values + 1).collect()
    if len(rows) > max_values:
        raise ValueError(f"{column} has more than {max_values} values; keep them in long form, as sparse.customer_values does")
    return sorted(row["v"] for row in rows)


def _pivot_sum(
    df: DataFrame, feature: str, values: Sequence, measure: str, key: str
) -> tuple[DataFrame, DataFrame]:
    """Sums as one column per value, 0 where a customer has none; and the narrow sums they come from.

    Rows are summed by (customer, value) first, which also splits a customer with very many of
    them. Those narrow rows, at most one per value, then move to their customer before they become
    columns: a plain pivot would shuffle one wide, mostly empty row for each of them.
    """
    sums = df.groupBy(key, named(feature).alias("__value")).agg(F.sum(measure).alias("__sum"))
    sums = sums.repartition(key)
    if not values:
        return sums.select(key).distinct(), sums
    return sums.groupBy(key).pivot("__value", list(values)).agg(F.sum("__sum")).na.fill(0), sums


def count_encoding(
    df: DataFrame,
    feature: str,
    values: Sequence[str] | None = None,
    prefix: str = "",
    postfix: str = "_qty",
    measure: str = "sold_qty",
    key: str = CUSTOMER,
) -> DataFrame:
    """Quantity per customer and value; customers with only blank values are not listed."""
    present = df.where(named(feature).isNotNull() & (named(feature) != ""))
    if values is None:
        values = distinct_values(present, feature)
    wide, _ = _pivot_sum(present, feature, values, measure, key)
    return wide.toDF(key, *[f"{prefix}{v}{postfix}" for v in values])


def share_of_wallet(
    df: DataFrame,
    by: str,
    postfix: str,
    values: Sequence[str] | None = None,
    measure: str = "net_amt_hkd",
    key: str = CUSTOMER,
) -> DataFrame:
    """Percent of a customer's amount per value; null when the amounts add up to zero.

    The total is over all rows, whatever their value and whether or not it is listed in ``values``.
    """
    if values is None:
        values = distinct_values(df, by)
    wide, sums = _pivot_sum(df, by, values, measure, key)
    totals = sums.groupBy(key).agg(F.sum("__sum").cast("double").alias("__total"))
    shares = [
        f"try_divide(cast({quoted(v)} as double), __total) * 100 AS {quoted(v + postfix)}" for v in values
    ]
    return wide.join(totals, key).selectExpr(key, *shares)


def one_hot(df: DataFrame, categories: Mapping[str, Sequence[str]]) -> DataFrame:
    """Replace each listed column by one boolean per value; a null value sets none."""
    kept = [named(c) for c in df.columns if c not in categories]
    flags = [
        F.coalesce(named(column) == F.lit(value), F.lit(False)).alias(f"{column}_{value}")
        for column, values in categories.items()
        for value in values
    ]
    return df.select(*kept, *flags)


def collect_values(df: DataFrame, feature: str, key: str = CUSTOMER) -> DataFrame:
    """The values a customer bought, sorted, each with the number of its lines.

    Equal values are counted before the shuffle, so an entry stands for any number of lines and an
    array holds at most every value of the category.
    """
    counted = df.where(named(feature).isNotNull()).groupBy(key, feature).agg(F.count(F.lit(1)).alias("__n"))
    entry = F.struct(named(feature).alias("value"), F.col("__n").alias("lines"))
    return counted.groupBy(key).agg(F.sort_array(F.collect_list(entry)).alias(feature))


def repeated_values(entries: Column) -> Column:
    """The plain list: every value as often as it has lines."""
    return F.flatten(F.transform(entries, lambda e: F.array_repeat(e["value"], e["lines"].cast("int"))))
