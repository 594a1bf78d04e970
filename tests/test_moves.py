"""What moves, and in which pieces: as little as the same rows allow."""

import re

from pyspark.sql import functions as F

from segmart.operators import enrich, sparse
from segmart.operators import lines as op
from segmart.operators.encode import CUSTOMER
from segmart.registry import datamart
from segmart.registry.mart import Mart
from segmart.session import materialise
from segmart.sources import retail

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def exchanges(df):
    return [line for line in plan(df).splitlines() if re.search(r"\bExchange hashpartitioning", line)]


def features(spark):
    """50 customers, 40 of them complete, with eight features each."""
    return spark.range(400).select(
        F.concat(F.lit("c"), (F.col("id") % 50).cast("string")).alias(CUSTOMER), (F.col("id") % 50 < 40).alias("complete"),
        F.concat(F.lit("f"), F.floor(F.col("id") / 50).cast("string")).alias("feature"), F.col("id").cast("double").alias("value"),
    )


def test_wide_features_move_narrow_rows_once(spark, monkeypatch):
    monkeypatch.setattr(sparse, "ROWS_PER_TASK", 100)
    wide = sparse.wide_features(features(spark), ["f1", "f2", "f3"])
    assert len(exchanges(wide)) == 1
    assert wide.count() == 40 and set(wide.columns) == {CUSTOMER, "f1", "f2", "f3"}
    values = features(spark).select(
        CUSTOMER, F.lit("brand").alias("category"), F.col("feature").alias("value"), F.lit(1).alias("sold_qty"), F.lit(2).alias("net_amt_hkd"), F.lit(8).alias("total")
    )
    for wide in (sparse.wide_counts(values, "brand", ["f1"]), sparse.wide_shares(values, "brand", ["f1"])):
        assert len(exchanges(wide)) == 1 and wide.count() == 50


def test_long_rows_come_in_pieces_of_a_bounded_number(spark, monkeypatch):
    known, cores = features(spark), spark.sparkContext.defaultParallelism
    few = rows(sparse.wide_features(known, ["f1"]))
    monkeypatch.setattr(sparse, "ROWS_PER_TASK", 399)
    assert sparse.wide_features(known, ["f1"]).rdd.getNumPartitions() == cores
    monkeypatch.setattr(sparse, "ROWS_PER_TASK", 20)
    wide = sparse.wide_features(known, ["f1"])
    assert wide.rdd.getNumPartitions() == 20 and rows(wide) == few
    totals = known.select(CUSTOMER, F.lit("b").alias("brand"), F.lit(1).alias("sold_qty"), F.lit(2).alias("net_amt_hkd"))
    assert sparse.customer_values(totals, {"brand": "brand"}).rdd.getNumPartitions() == 20


def test_orders_may_be_judged_by_more_lines_than_stay(spark):
    facts = [("a", 1), ("a", -1), ("b", 2), ("c", None), ("d", 3), ("d", -2)]
    judged = spark.createDataFrame(facts, f"{op.ORDER_KEY} string, sold_qty int")
    some = judged.where("sold_qty > 0")
    assert rows(op.drop_net_zero(some, judged_by=judged)) == [("b", 2), ("d", 3)]
    assert rows(op.drop_net_zero(some)) == [("a", 1), ("b", 2), ("d", 3)]


def test_shops_do_not_move_lines(spark):
    mart = Mart(spark, FOLDER)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        house = retail.sales(mart.tables).where("shop_brand = 'HB'")
        assert not any("shop_brand" in line for line in exchanges(house))
        found = enrich.enrich(op.typed_lines(mart.warehouse.sales), mart.lookups.sku, mart.lookups.subcat, mart.lookups.store)
        assert "SortMergeJoin [shop_code" not in plan(found) and "BroadcastHashJoin [shop_code" in plan(found)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_enriched_lines_move_without_their_order_key(spark):
    found = datamart.enriched(Mart(spark, FOLDER))
    assert found.columns[found.columns.index(op.ORDER_KEY) + 1] == "vip_main_no"
    # The key is made above all joins, hence nowhere below an exchange.
    lines = plan(found).splitlines()
    made = next(i for i, line in enumerate(lines) if f"AS {op.ORDER_KEY}" in line)
    assert not any("Exchange" in line for line in lines[:made])
    assert found.where(F.col(op.ORDER_KEY) != F.concat("shop_code", F.lit("-"), "invoice_no")).count() == 0


def test_stored_lines_are_compressed_harder(spark):
    found = materialise(spark.range(10), "transaction")
    assert found.count() == 10 and all(".zstd." in name for name in found.inputFiles())
    assert not any(".zstd." in name for name in materialise(spark.range(10), "plain").inputFiles())
    assert all(".zstd." in name for name in retail.warehouse(retail.load(spark, FOLDER)).sales.inputFiles())


def test_marks_stand_for_what_their_columns_say(spark):
    """Nulls are neither padded nor returned nor unsure."""
    tables = retail.load(spark, FOLDER)
    line, part = tables["lineitem"], tables["part"]
    some = F.col("l_orderkey") % 4 == 0
    tables["lineitem"] = line.withColumns(
        {
            "l_linenumber": F.when(some, F.lit(None)).when(F.col("l_orderkey") % 4 == 1, -F.col("l_linenumber")).otherwise(F.col("l_linenumber")).cast("int"),
            "l_returnflag": F.when(~some, F.col("l_returnflag")),
        }
    )
    tables["part"] = part.withColumn("p_size", F.when(F.col("p_partkey") % 3 != 0, F.lit(20)).otherwise(F.lit(None)).cast("int"))
    expected = (
        tables["lineitem"]
        .join(tables["part"], F.col("l_partkey") == F.col("p_partkey"))
        .join(tables["orders"], F.col("l_orderkey") == F.col("o_orderkey"))
        .join(tables["customer"], F.col("o_custkey") == F.col("c_custkey"))
        .withColumn("sign", F.explode(F.when(F.col("l_returnflag") == "R", F.array(F.lit(1), F.lit(-1))).otherwise(F.array(F.lit(1)))))
    )
    card = F.concat(F.lit("V"), F.col("o_custkey"))
    expected = expected.select(
        F.concat(F.lit("I"), "l_orderkey"),
        F.concat(F.col("l_suppkey").cast("string"), F.when(F.col("l_linenumber") % 2 == 1, "  ").otherwise("")),
        F.when(F.col("c_acctbal").between(3000, 3200), F.lit(None)).when(F.col("c_acctbal").between(3200, 3400), "")
        .when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit(" "), card, F.lit(" "))).otherwise(card),
        F.col("l_quantity") * F.col("sign"),
        F.when(F.col("o_orderstatus") == "P", "0").when(F.col("p_size") == 20, "Y").otherwise("1"),
        F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "V"),
    )
    found = retail.sales(tables)
    assert rows(found.select("invoice_no", "shop_code", "vip_no", "sold_qty", "valid_tx_flag", "void_flag")) == rows(expected)
    assert " AS marks#" in plan(found)
