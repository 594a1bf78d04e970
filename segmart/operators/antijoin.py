"""NOT IN with SQL's three-valued logic, without a broadcast of the list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmart.functions.columns import named


def not_in(df: DataFrame, column: str, values: DataFrame, value_column: str | None = None) -> DataFrame:
    """Rows of ``df`` whose ``column`` is NOT IN the first (or named) column of ``values``, as in SQL.

    A null in the list makes every comparison unknown, so no row stays; an empty list keeps all rows, null
    ones too; otherwise null rows go, as they may be any value. Repeated rows stay repeated.

    The list may be of any size: it is made distinct and met in a hashed anti join, whose skewed partitions
    adaptive execution splits. What the whole list says is one row of two counts.
    """
    listed = values.select(named(value_column or values.columns[0]).alias("__listed"))
    facts = listed.agg(F.count(F.lit(1)).alias("__all"), F.count("__listed").alias("__known"))
    kept = df.join(listed.where("__listed IS NOT NULL").distinct(), named(column) == F.col("__listed"), "left_anti")
    # One row by construction.
    judged = kept.crossJoin(F.broadcast(facts))
    passes = (F.col("__all") == 0) | ((F.col("__all") == F.col("__known")) & named(column).isNotNull())
    return judged.where(passes).drop("__all", "__known")
