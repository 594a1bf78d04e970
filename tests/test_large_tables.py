"""The paths for tables too large to broadcast and keys too hot for one task, end to end."""

import pytest
from compare import connect, difference

from segmart.operators import skew
from segmart.registry import datamart, features, reports
from segmart.registry.mart import Mart
from segmart.registry.oracle import SQL
from segmart.registry.queries import plain

FOLDER = "/root/testdata/sf0.001"
BUILDERS = datamart.QUERIES | features.QUERIES | reports.QUERIES


@pytest.fixture(scope="module")
def strict(spark):
    """Nothing may be broadcast for its size, and a few rows already make a key hot."""
    kept = skew.ROWS_PER_TASK, spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    skew.ROWS_PER_TASK = 5
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield Mart(spark, FOLDER)
    skew.ROWS_PER_TASK = kept[0]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept[1])


@pytest.mark.parametrize(
    "name",
    ["valid_lines", "enrich_lines", "net_zero_orders", "segmented_lines", "segment_orders", "repeat_cohort_lines", "category_customers_tag", "count_encode_tag"],
)
def test_same_rows(strict, name):
    assert difference(plain(BUILDERS[name](strict)), connect(FOLDER), SQL[name]) is None
