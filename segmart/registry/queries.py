"""All registered queries by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from segmart.functions.columns import quoted
from segmart.registry import datamart, features, reports
from segmart.registry.mart import Mart, mart

Query = Callable[[SparkSession, str], DataFrame]


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles and dates as text, the forms every engine prints alike."""

    def column(field: T.StructField) -> str:
        if isinstance(field.dataType, T.DecimalType):
            return f"cast({quoted(field.name)} as double) AS {quoted(field.name)}"
        if isinstance(field.dataType, T.DateType):
            return f"cast({quoted(field.name)} as string) AS {quoted(field.name)}"
        return quoted(field.name)

    return df.selectExpr(*[column(field) for field in df.schema.fields])


def _registered(build: Callable[[Mart], DataFrame]) -> Query:
    return lambda spark, folder: plain(build(mart(spark, folder)))


QUERIES: dict[str, Query] = {
    name: _registered(build)
    for group in (datamart.QUERIES, features.QUERIES, reports.QUERIES)
    for name, build in group.items()
}
