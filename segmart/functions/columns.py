"""Column helpers: quoting, trimming, relabelling, dates."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quoted(name: str) -> str:
    """A name for use in expression text; category values in names may hold dots and spaces."""
    return "`" + name.replace("`", "``") + "`"


def named(name: str) -> Column:
    """A column by its literal name."""
    return F.col(quoted(name))


def trim_strings(df: DataFrame) -> DataFrame:
    """Trim string columns in one projection; dates and numbers keep their type."""
    return df.select(
        *[
            F.trim(named(field.name)).alias(field.name)
            if isinstance(field.dataType, T.StringType)
            else named(field.name)
            for field in df.schema.fields
        ]
    )


def relabel(column: Column, mapping: Mapping, default: Column | None = None) -> Column:
    """Replace listed values; others keep theirs, or become ``default`` when it is given."""
    chain = None
    for value, label in mapping.items():
        test = column == F.lit(value)
        chain = F.when(test, F.lit(label)) if chain is None else chain.when(test, F.lit(label))
    fallback = column if default is None else default
    return fallback if chain is None else chain.otherwise(fallback)


def year_month(date: Column) -> Column:
    return F.date_format(date, "yyyyMM")


def between_dates(date: Column, start: str | None, end: str | None) -> Column:
    """Closed date range on a typed date column, so that Parquet statistics apply."""
    test = F.lit(True)
    if start is not None:
        test = test & (date >= F.lit(start).cast("date"))
    if end is not None:
        test = test & (date <= F.lit(end).cast("date"))
    return test


def lenient_cast(df: DataFrame, name: str, target: str) -> Column:
    """Cast that yields null for unreadable text, as with ANSI mode off; no-op on equal types."""
    current = df.schema[name].dataType.simpleString()
    column = named(name)
    if current == target:
        return column
    if target == "int":
        return column.try_cast("double").try_cast("int")
    return column.try_cast(target)


def normalised_sex(column: Column, blank_is_unknown: bool, unknown: str) -> Column:
    missing = column.isNull()
    if blank_is_unknown:
        missing = missing | (column == "")
    return F.when(missing, F.lit(unknown)).otherwise(column)


def tenure_years(first: Column, as_of: str) -> Column:
    days = F.date_diff(F.lit(as_of).cast("date"), first)
    return F.round(days / F.lit(365), 0)
