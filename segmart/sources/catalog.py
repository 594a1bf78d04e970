"""Catalog tables in monthly partitions and customer buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmart.functions.columns import named, quoted


def write_table(
    df: DataFrame,
    table: str,
    partition_by: Sequence[str] = (),
    bucket_by: Sequence[str] = (),
    buckets: int = 64,
    path: str | None = None,
    overwrite: bool = True,
) -> DataFrame:
    """Save ``df`` as a catalog table and return it.

    Tables in equally many buckets by the same columns join on them without a shuffle. Rows are dealt
    to their buckets first, so that there is one file for each partition and bucket, not one for each task too.
    """
    if bucket_by:
        df = df.repartition(buckets, *[named(c) for c in bucket_by])
    writer = df.write.format("parquet").mode("overwrite" if overwrite else "errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if bucket_by:
        writer = writer.bucketBy(buckets, *bucket_by).sortBy(*bucket_by)
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(table)
    return df.sparkSession.table(table)


def overwrite_partitions(df: DataFrame, table: str) -> DataFrame:
    """Replace the partitions of ``table`` that ``df`` has rows of; the others keep theirs.

    Columns are matched by name and cast to the table's types; a missing one is an error.
    """
    spark = df.sparkSession
    target = spark.table(table)
    rows = df.select(*[named(field.name).cast(field.dataType).alias(field.name) for field in target.schema.fields])
    bucketing = bucket_spec(spark, table)
    if bucketing:
        rows = rows.repartition(bucketing[0], *[named(c) for c in bucketing[1]])
    # Inserts take the mode from the session only; anything but dynamic would empty the other partitions.
    setting = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "dynamic")
    try:
        rows.write.insertInto(table, overwrite=True)
    finally:
        spark.conf.set(setting, before)
    spark.catalog.refreshTable(table)
    return spark.table(table)


def bucket_spec(spark: SparkSession, table: str) -> tuple[int, list[str]] | None:
    """Number of buckets and their columns, None for a table without."""
    facts = {row["col_name"]: row["data_type"] for row in spark.sql(f"DESCRIBE EXTENDED {table}").collect()}
    if "Num Buckets" not in facts:
        return None
    columns = facts["Bucket Columns"].strip("[]").split(",")
    return int(facts["Num Buckets"]), [c.strip().strip("`") for c in columns]


def by_month(df: DataFrame, date_column: str, month_column: str = "order_month") -> DataFrame:
    """With the month as yyyyMM in a column of its own, to partition by."""
    return df.withColumn(month_column, F.date_format(F.col(quoted(date_column)), "yyyyMM"))
