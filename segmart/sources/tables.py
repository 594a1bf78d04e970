"""Catalog and Parquet scans, Parquet and CSV sinks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_parquet(df: DataFrame, path: str, overwrite: bool = True, partition_by: Iterable[str] = ()) -> None:
    mode = "overwrite" if overwrite else "errorifexists"
    writer = df.write.mode(mode)
    partition_by = list(partition_by)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_feature_store(spark: SparkSession, folder: str, names: Iterable[str]) -> dict[str, DataFrame]:
    """Feature tables by name, in the given order (a directory listing has none)."""
    return {name: read_parquet(spark, f"{folder}/{name}.parquet") for name in names}
