"""The stages from raw tables to reports, through files as in production."""

from urllib.parse import urlparse

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from segmart.constants import SEGMENT_ORDER
from segmart.operators.encode import CUSTOMER
from segmart.operators.lists import item_list
from segmart.operators.model import wcss_curve
from segmart.plans.datamart import build_datamart, write_datamart
from segmart.plans.features import CLUSTERING_TABLES, build_features, write_features
from segmart.plans.personas import build_personas, write_personas
from segmart.plans.reports import SegmentReports
from segmart.session import shared_dir
from segmart.sources import retail
from segmart.sources.tables import read_feature_store, read_parquet, read_table, write_csv

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def datamart(spark):
    return build_datamart(retail.warehouse(retail.load(spark, FOLDER)), retail.DATAMART)


@pytest.fixture(scope="module")
def features(datamart):
    return build_features(datamart, retail.FEATURES)


@pytest.fixture(scope="module")
def personas(features):
    return build_personas(features, k=3)


def test_datamart_round_trip(spark, datamart, tmp_path):
    write_datamart(datamart, str(tmp_path), by_month=True)
    write_datamart(datamart, str(tmp_path), by_month=True)
    again = read_parquet(spark, f"{tmp_path}/transaction.parquet")
    assert again.count() == datamart.transaction.count() > 0
    assert again.inputFiles()[0].count("order_month=") == 1
    assert read_parquet(spark, f"{tmp_path}/item_attr_tagging.parquet").schema["tags"].dataType.simpleString() == "array<string>"


def test_transactions_are_distinct(datamart):
    assert datamart.transaction.distinct().count() == datamart.transaction.count()


def test_feature_store_round_trip(spark, features, tmp_path):
    write_features(features, str(tmp_path))
    store = read_feature_store(spark, str(tmp_path), CLUSTERING_TABLES)
    assert list(store) == CLUSTERING_TABLES
    assert store["tagging"].count() == features["tagging"].count() > 0


def test_shares_add_up_to_hundred(features):
    shares = features["share_of_wallet_brand"]
    total = sum((F.col(f"`{c}`") for c in shares.columns[1:]), F.lit(0.0))
    known = shares.where(F.col(f"`{shares.columns[1]}`").isNotNull())
    assert known.where(F.abs(total - 100) > 1e-6).count() == 0


def test_one_hot_sets_at_most_one_flag_per_attribute(features):
    demographic = features["demographic"]
    flags = [F.col(f"`{c}`").cast("int") for c in demographic.columns if c.startswith("tenure_")]
    assert demographic.where(sum(flags[1:], flags[0]) != 1).count() == 0


def test_personas_cover_the_customers_once(personas, features):
    assert personas.personas.count() == features["subcat"].count()
    assert personas.personas.groupBy(CUSTOMER).count().where("count > 1").count() == 0
    assert len(personas.selected) <= 25


def test_persona_files_are_not_overwritten(personas, tmp_path):
    write_personas(personas, str(tmp_path))
    with pytest.raises(AnalysisException):
        write_personas(personas, str(tmp_path))


def test_curve_over_the_persona_vectors(personas):
    curve = [r["wcss"] for r in wcss_curve(personas.vectors, [1, 3], restarts=1).collect()]
    assert curve[0] > curve[1]


@pytest.fixture(scope="module")
def reports(datamart, personas):
    return SegmentReports.prepare(
        datamart.transaction, personas.personas, datamart.first_purchase, datamart.item_tags, retail.REPORTS
    )


def test_segment_amounts_add_up(reports):
    row = reports.amount().first()
    by_segment = sum(row[s] or 0 for s in SEGMENT_ORDER)
    lines = reports.in_window().join(reports.segments.select(CUSTOMER), CUSTOMER)
    assert by_segment == lines.agg(F.sum("net_amt_hkd")).first()[0]


def test_cross_class_is_symmetric_and_margins_dominate(reports):
    cells = {(r["customer_tag"], r["class_x"], r["class_y"]): r["customers"] for r in reports.cross_class().collect()}
    for (tag, x, y), n in cells.items():
        assert cells[tag, y, x] == n <= cells[tag, x, "All"]


def test_csv_and_catalog(spark, datamart, tmp_path):
    items = item_list(datamart.transaction)
    write_csv(items, str(tmp_path / "items"))
    assert spark.read.option("header", True).csv(str(tmp_path / "items")).count() == items.count()
    items.createOrReplaceTempView("segmart_items")
    assert read_table(spark, "segmart_items").count() == items.count()
    spark.catalog.dropTempView("segmart_items")


def test_intermediate_tables_use_the_session_folder(spark, datamart):
    folder = urlparse(shared_dir(spark)).path
    assert urlparse(datamart.transaction.inputFiles()[0]).path.startswith(folder)
