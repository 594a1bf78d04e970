"""Registered datamart queries."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmart.operators import antijoin, incremental
from segmart.operators.cards import card_demographics
from segmart.operators.enrich import enrich, sku_table, store_table, subcat_table
from segmart.operators.lines import (
    ORDER_KEY,
    WHOLE_MONEY,
    build_lines,
    distinct_lines,
    drop_net_zero,
    resolve_master,
    typed_columns,
    with_order_key,
)
from segmart.operators.snapshot import latest_snapshot
from segmart.registry.mart import Mart
from segmart.session import new_path
from segmart.sources import catalog, feature_store, retail
from segmart.sources.tables import read_parquet, read_table, write_csv, write_parquet

LINE = ["vip_no", "vip_main_no", "sales_main_key", "item_code", "order_date", "sold_qty", "net_amt_hkd"]


def resolved(mart: Mart) -> DataFrame:
    return resolve_master(build_lines(mart.warehouse.sales), mart.warehouse.cards)


def latest_orders(mart: Mart) -> DataFrame:
    orders = mart.tables["orders"].select("o_custkey", F.col("o_orderdate").cast("date").alias("o_orderdate"), "o_orderkey")
    return latest_snapshot(orders.distinct(), ["o_custkey"], "o_orderdate")


def enriched(mart: Mart) -> DataFrame:
    """Every line of the house brand with its descriptions.

    Other brands' lines differ from these, so they go before the distinct; the order key is made where lines have come to rest.
    """
    source, lookups = mart.warehouse, mart.lookups
    house = distinct_lines(typed_columns(source.sales).where(F.col("shop_brand") == retail.HOUSE_BRAND))
    found = with_order_key(enrich(resolve_master(house, source.cards), lookups.sku, lookups.subcat, lookups.store))
    names = [name for name in found.columns if name != ORDER_KEY]
    names.insert(names.index("vip_main_no"), ORDER_KEY)
    return found.select(*names)


def whole_unit_amounts(mart: Mart) -> DataFrame:
    lines = build_lines(mart.warehouse.sales, WHOLE_MONEY)
    return lines.groupBy("shop_code").agg(
        F.sum("net_amt_hkd").alias("net_amt_hkd"), F.sum("net_amt").alias("net_amt"), F.count(F.lit(1)).alias("lines")
    )


def parquet_round_trip(mart: Mart) -> DataFrame:
    """First purchases through the Parquet sink."""
    path = new_path(mart.spark, "first_purchase")
    write_parquet(mart.first_purchase, path, overwrite=False)
    return read_parquet(mart.spark, path)


def csv_round_trip(mart: Mart) -> DataFrame:
    """Latest orders through the CSV sink, which does not tell empty texts from nulls: they have neither."""
    path = new_path(mart.spark, "latest_orders_csv")
    orders = latest_orders(mart)
    write_csv(orders, path)
    return mart.spark.read.option("header", True).schema(orders.schema).csv(path)


def catalog_scan(mart: Mart) -> DataFrame:
    """First purchases as a named table of the session's catalog."""
    mart.first_purchase.createOrReplaceTempView("segmart_first_purchase")
    return read_table(mart.spark, "segmart_first_purchase")


def parquet_overwrite(mart: Mart) -> DataFrame:
    """First purchases written over a table of the same name."""
    path = new_path(mart.spark, "overwrite")
    for rows in (mart.first_purchase.limit(1), mart.first_purchase):
        write_parquet(rows, path, overwrite=True)
    return mart.spark.read.schema(mart.first_purchase.schema).parquet(path)


LINE_FACTS = ("vip_main_no", "order_date", "sold_qty", "net_amt_hkd")
CHANGED_MONTH = "199705"


def saved(mart: Mart, df: DataFrame, name: str, **options) -> str:
    """A new table of the session's catalog in the shared folder; its name."""
    path = new_path(mart.spark, name)
    table = f"segmart_{name}_{os.path.basename(path).rpartition('-')[2].removesuffix('.parquet')}"
    catalog.write_table(df, table, path=path, **options)
    return table


def catalog_partitions(mart: Mart) -> DataFrame:
    """Lines in monthly partitions, one of which is then replaced by its lines of more than one piece."""
    lines = catalog.by_month(mart.transaction.select(*LINE_FACTS), "order_date")
    table = saved(mart, lines, "lines", partition_by=["order_month"], bucket_by=["vip_main_no"], buckets=8)
    changed = lines.where((F.col("order_month") == CHANGED_MONTH) & (F.col("sold_qty") > 1))
    now = catalog.overwrite_partitions(changed, table)
    return now.groupBy(F.col("order_month").cast("string").alias("order_month")).agg(
        F.count(F.lit(1)).alias("lines"), F.sum("net_amt_hkd").alias("amount")
    )


def bucketed_join(mart: Mart) -> DataFrame:
    """Amounts by persona from two tables in equal buckets by customer, joined where they lie."""
    lines = saved(mart, mart.transaction.select(*LINE_FACTS), "facts", bucket_by=["vip_main_no"], buckets=8)
    personas = saved(mart, retail.personas(mart.tables), "personas", bucket_by=["vip_main_no"], buckets=8)
    joined = mart.spark.table(lines).join(mart.spark.table(personas), "vip_main_no")
    return joined.groupBy("persona").agg(F.count(F.lit(1)).alias("lines"), F.sum("net_amt_hkd").alias("amount"))


def not_in_cases(mart: Mart) -> DataFrame:
    """Lines by brand whose customer is not in a list without nulls, in one with a null, and in an empty one."""
    lines, found = mart.transaction.select("vip_main_no", "prod_brand"), []
    bought = lines.where("prod_brand = 'Brand#11'").select("vip_main_no")
    lists = {
        "known": bought.where("vip_main_no IS NOT NULL"),
        "with_null": bought.unionByName(bought.limit(1).select(F.lit(None).cast("string").alias("vip_main_no"))),
        "empty": bought.where("false"),
    }
    for name, listed in lists.items():
        kept = antijoin.not_in(lines, "vip_main_no", listed)
        found.append(kept.groupBy("prod_brand").agg(F.count(F.lit(1)).alias("lines")).withColumn("list", F.lit(name)))
    return found[0].unionByName(found[1]).unionByName(found[2])


def batches(df: DataFrame, key: str) -> list[DataFrame]:
    """The rows in four deliveries by a hash of a column, the last of which brings the third once more."""
    batch = F.pmod(F.xxhash64(key), F.lit(4))
    return [df.where(batch == 0), df.where(batch == 1), df.where(batch == 2), df.where(batch >= 2)]


def folded(mart: Mart, name: str, keys: list[str], merge: incremental.Merge, deliveries: list[DataFrame]) -> DataFrame:
    path = new_path(mart.spark, name)
    table = f"segmart_{name}_{os.path.basename(path).rpartition('-')[2].removesuffix('.parquet')}"
    state = incremental.State(table, tuple(keys), merge, parts=16)
    found = incremental.create(state, deliveries[0], path)
    for delta in deliveries[1:]:
        found = incremental.fold(state, delta)
    return found


def first_purchase_folded(mart: Mart) -> DataFrame:
    """First purchases from a state of cards: a base and three deltas, with late and repeated lines."""
    source = mart.warehouse
    deliveries = [incremental.first_dates(sales, retail.HOUSE_BRAND) for sales in batches(source.sales, "invoice_no")]
    dates = folded(mart, "card_dates", ["vip_no"], incremental.earliest_by_card, deliveries)
    return incremental.first_purchase_of(dates, source.cards)


def snapshot_folded(mart: Mart) -> DataFrame:
    """Latest orders from a base and three deltas, with late, tied and repeated rows."""
    orders = mart.tables["orders"].select("o_custkey", F.col("o_orderdate").cast("date").alias("o_orderdate"), "o_orderkey")
    merge = incremental.newest_rows(["o_custkey"], "o_orderdate")
    return folded(mart, "latest_orders", ["o_custkey"], merge, batches(orders, "o_orderkey"))


def feature_store_join(mart: Mart) -> DataFrame:
    """Two feature tables found by rule in a store, side by side; one of them has an outdated version as well."""
    store = new_path(mart.spark, "feature_store")
    spending = mart.spending.select("vip_main_no", "net_amt_hkd", "sold_qty", "invoice_no")
    firsts = mart.first_purchase.where("vip_main_no IS NOT NULL")
    for name, table in (
        ("customer_spending", spending.where("false")),
        ("scratch_spending", spending),
        ("customer_first_purchase", firsts),
        ("customer_spending", spending),
    ):
        feature_store.write_feature_table(table, store, name, "vip_main_no")
    return feature_store.read_features(mart.spark, feature_store.manifest(mart.spark, store, include=["customer_*"]))


QUERIES = {
    "first_purchase_folded": first_purchase_folded,
    "snapshot_folded": snapshot_folded,
    "feature_store_join": feature_store_join,
    "parquet_overwrite": parquet_overwrite,
    "catalog_partitions": catalog_partitions,
    "bucketed_join": bucketed_join,
    "not_in_cases": not_in_cases,
    "parquet_round_trip": parquet_round_trip,
    "csv_round_trip": csv_round_trip,
    "catalog_scan": catalog_scan,
    "master_id_fallback": lambda t: resolved(t).select(*LINE),
    "net_zero_orders": lambda t: drop_net_zero(resolved(t)).select(*LINE),
    "whole_unit_amounts": whole_unit_amounts,
    "latest_snapshot_ties": latest_orders,
    "sku_latest": lambda t: sku_table(t.warehouse.sku, t.warehouse.maincat),
    "subcat_latest": lambda t: subcat_table(t.warehouse.subcat),
    "store_latest": lambda t: store_table(t.warehouse.stores, retail.HOUSE_BRAND),
    "enrich_lines": enriched,
    "valid_lines": lambda t: t.transaction,
    "card_demographics": lambda t: card_demographics(t.warehouse.cards),
    "first_purchase": lambda t: t.first_purchase,
}
