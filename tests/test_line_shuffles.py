"""Distinct lines and order totals: the same rows, without moving whole lines where none is repeated."""

import pytest
from pyspark.sql import functions as F

from segmart.operators import lines as op
from segmart.sources import retail


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


@pytest.fixture(scope="module")
def single(spark):
    return spark.range(200).select("id", F.when(F.col("id") % 3 != 0, F.col("id") % 7).alias("a"), F.lit(None).cast("string").alias("b"))


@pytest.mark.parametrize("max_repeated", [None, 0])
def test_distinct_lines_are_those_of_a_plain_distinct(spark, single, max_repeated):
    for lines in (single, single.unionByName(single.where("id < 60")), single.drop("id"), single.where("false")):
        assert rows(op.distinct_lines(lines, max_repeated)) == rows(lines.distinct())
    zeros = spark.createDataFrame([(0.0,), (-0.0,), (float("nan"),), (float("nan"),), (None,), (None,)], "x double")
    assert op.distinct_lines(zeros, max_repeated).count() == zeros.distinct().count() == 3


def test_lines_that_differ_are_not_shuffled(single):
    single = single.selectExpr("id * 2 AS id", "a", "b")
    assert exchanges(op.distinct_lines(single)) == 0 < exchanges(single.distinct())


def test_order_totals_read_no_other_columns(spark, tmp_path):
    facts = spark.range(50).select(
        F.concat(F.lit("o"), F.col("id") % 20).alias(op.ORDER_KEY), F.col("id").cast("string").alias("vip_no"), F.lit("P1").alias("item_code"),
        F.lit("2001-01-01").cast("date").alias("order_date"), ((F.col("id") % 3) - 1).cast("int").alias("sold_qty"),
        F.lit(1).cast("decimal(18,2)").alias("net_amt_hkd"), F.lit("long text").alias("unused"),
    )
    facts.write.parquet(f"{tmp_path}/lines")
    lines = spark.read.parquet(f"{tmp_path}/lines")
    kept = op.drop_net_zero(lines, rows_per_task=2)
    totals = {r[0] for r in facts.groupBy(op.ORDER_KEY).agg(F.sum("sold_qty").alias("t")).where("t != 0").collect()}
    assert rows(kept) == rows(facts.where(F.col(op.ORDER_KEY).isin(*totals)))
    narrow = kept.select(op.ORDER_KEY, *op.LINE_FACTS)._jdf.queryExecution().executedPlan().toString()
    assert "unused" not in narrow


def test_stored_sales_are_written_where_they_are_joined(spark, monkeypatch):
    tables = retail.load(spark, "/root/testdata/sf0.001")
    plans = []
    monkeypatch.setattr(retail, "materialise", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df)
    retail.warehouse(tables)
    assert len(plans) == 1 and "REPARTITION" not in plans[0] and "RoundRobin" not in plans[0]


def test_few_counts_send_the_driver_only_what_it_keeps(spark, monkeypatch):
    from pyspark.sql import DataFrame

    from segmart.operators import quantile

    sent, collect = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda df: sent.append(0) or collect(df))
    counts = spark.range(500).select((F.col("id") * 7 % 500).alias("v"), F.lit(2).alias("n"))
    assert quantile._few_counts(counts, 499) is None and not sent
    assert quantile._few_counts(counts, 500) == [(i, 2) for i in range(500)]
