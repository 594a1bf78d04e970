"""Bucketed and partitioned catalog tables, and NOT IN."""

import uuid

import pytest
from pyspark.sql import functions as F

from segmart.operators.antijoin import not_in
from segmart.sources import catalog


@pytest.fixture
def rows(spark):
    made = [(f"c{i % 7}", f"2020-0{1 + i % 3}-1{i % 5}", i) for i in range(60)]
    days = spark.createDataFrame(made, "customer string, day string, n int").withColumn("day", F.col("day").cast("date"))
    return catalog.by_month(days, "day")


def name():
    return f"t{uuid.uuid4().hex}"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_partitions_are_pruned_and_overwritten_alone(spark, rows, tmp_path):
    table = name()
    saved = catalog.write_table(rows, table, ["order_month"], ["customer"], 4, str(tmp_path / table))
    assert sorted(saved.collect()) == sorted(rows.select(saved.columns).collect())
    february = saved.where("order_month = '202002'")
    assert "PartitionFilters: [isnotnull(order_month" in plan(february)
    assert catalog.bucket_spec(spark, table) == (4, ["customer"])
    now = catalog.overwrite_partitions(rows.where("order_month = '202002' AND n > 30").select("order_month", "n", "day", "customer"), table)
    want = rows.where("order_month <> '202002' OR n > 30")
    assert sorted(now.collect()) == sorted(want.select(now.columns).collect())
    assert catalog.bucket_spec(spark, table) == (4, ["customer"])
    spark.sql(f"DROP TABLE {table}")


def test_equal_buckets_join_without_a_shuffle(spark, rows, tmp_path):
    names = [name(), name()]
    left, right = [
        catalog.write_table(df, table, bucket_by=["customer"], buckets=4, path=str(tmp_path / table))
        for df, table in ((rows, names[0]), (rows.groupBy("customer").count(), names[1]))
    ]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = left.join(right, "customer")
        assert "Exchange" not in plan(joined) and "SortMergeJoin" in plan(joined)
        assert joined.count() == 60
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for table in names:
        spark.sql(f"DROP TABLE {table}")


@pytest.mark.parametrize("listed", [[], [1, 3], [1, None], [None], [7], [1, 1, 3, 3]])
def test_not_in_is_that_of_sql(spark, listed):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (None, "c"), (3, None)], "k int, v string")
    values = spark.createDataFrame([(x,) for x in listed], "k int")
    df.createOrReplaceTempView("not_in_rows")
    values.createOrReplaceTempView("not_in_list")
    want = spark.sql("SELECT * FROM not_in_rows WHERE k NOT IN (SELECT k FROM not_in_list)")
    found = not_in(df, "k", values)
    assert found.columns == df.columns and sorted(found.collect(), key=str) == sorted(want.collect(), key=str)
