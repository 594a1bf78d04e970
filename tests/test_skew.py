"""Joins with hot keys: same rows as plain joins, work spread over tasks."""

import pytest
from pyspark.sql import functions as F

from segmart.operators.lines import drop_net_zero, lines_near, shops_in_scope
from segmart.operators.skew import hot_keys, lookup_join, salted_join


@pytest.fixture(scope="module")
def facts(spark):
    """A third of the rows share one key, some have none."""
    key = F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.col("id") % 400)
    return spark.range(6000).select("id", key.cast("long").alias("k"))


@pytest.fixture(scope="module")
def lookup(spark):
    rows = spark.range(0, 300).select(F.col("id").cast("int").alias("k"), F.concat(F.lit("n"), "id").alias("name"))
    return rows.union(rows.where("k IN (7, 9)").withColumn("name", F.lit("twin")))


def rows(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=repr)


def test_hot_keys_finds_just_the_hot_key(facts):
    hot = hot_keys(facts, {"k": ["k"]}, rows_per_task=500)["k"]
    assert list(hot.values()) == [5]
    expected = facts.where("k = 7").select(F.xxhash64("k")).first()[0]
    assert list(hot) == [expected]


@pytest.mark.parametrize("how", ["left", "inner", "left_semi"])
def test_salted_join_equals_plain_join(facts, lookup, how):
    hot = hot_keys(facts, {"k": ["k"]}, rows_per_task=100)["k"]
    assert rows(salted_join(facts, lookup, ["k"], how, hot)) == rows(facts.join(lookup, ["k"], how))


@pytest.mark.parametrize("how", ["left", "inner", "left_semi"])
def test_lookup_join_without_broadcast(facts, lookup, how):
    found = lookup_join(facts, lookup, ["k"], how, hot_keys(facts, {"k": ["k"]}, rows_per_task=100)["k"])
    assert rows(found) == rows(facts.join(lookup, ["k"], how))


def test_hot_rows_spread_over_tasks(spark, facts, lookup):
    hot = hot_keys(facts, {"k": ["k"]}, rows_per_task=100)["k"]
    adaptive, threshold = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = salted_join(facts, lookup, ["k"], "inner", hot).where("k = 7")
        assert joined.select(F.spark_partition_id()).distinct().count() > 4
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_net_zero_with_a_hot_order(spark):
    lines = spark.range(3000).select(
        F.when(F.col("id") < 1000, F.lit("hot")).otherwise(F.concat(F.lit("o"), (F.col("id") / 2).cast("int"))).alias("sales_main_key"),
        F.when(F.col("id") % 2 == 0, F.lit(1)).when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.lit(2)).alias("sold_qty"),
        "id",
    )
    found = drop_net_zero(lines, rows_per_task=50)
    assert rows(found) == rows(drop_net_zero(lines))
    assert found.where("sales_main_key = 'hot'").count() == 1000


def test_lines_near_keeps_whole_orders(spark):
    lines = spark.createDataFrame(
        [("1-a", "HB"), ("1-a", "XX"), ("1-b", "XX"), ("2-a", "XX"), ("3-x-1", "HB"), ("3-x-2", "XX"), (None, "HB")],
        "sales_main_key string, shop_brand string",
    )
    in_scope = F.col("shop_brand") == "HB"
    kept = lines_near(lines, shops_in_scope(lines, in_scope))
    assert sorted(r[0] for r in kept.select("sales_main_key").collect()) == ["1-a", "1-a", "1-b", "3-x-1", "3-x-2"]


def test_every_hot_key_is_found(spark):
    facts = spark.range(30_000).select((F.col("id") % 1500).alias("k"), (F.col("id") % 7).alias("other"))
    found = hot_keys(facts, {"k": ["k"], "both": ["k", "other"], "other": ["other"]}, rows_per_task=15)
    assert set(found["k"].values()) == {2} and len(found["k"]) == 1500
    assert found["both"] == {} and len(found["other"]) == 7


def test_building_a_join_runs_nothing(spark, facts, lookup):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "a join")
    lookup_join(facts, lookup, ["k"])
    assert list(tracker.getJobIdsForGroup("building")) == []
    spark.sparkContext.setJobGroup("", "")
