"""Every registered query against its SQL on the smallest sample."""

import pytest
from compare import connect, difference

import __spark_entry__ as entry_points

FOLDER = "/root/testdata/sf0.001"
# SQL has to write out the columns of wide results; not all of their values occur on the smallest sample.
WIDE_FOLDER = "/root/testdata/sf0.01"
WIDE = {"feature_matrix_join", "outlier_exclusion", "zero_share", "standardised_features", "correlation_matrix"}
WIDE |= {"count_encode_maincat", "share_of_wallet_maincat", "one_hot_demographics", "wcss_k1", "factor_selection_check"}
QUERIES, SQL = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


def test_sql_keys_are_registered():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, connection, name):
    if name in WIDE:
        assert difference(QUERIES[name](spark, WIDE_FOLDER), connect(WIDE_FOLDER), SQL[name]) is None
    else:
        assert difference(QUERIES[name](spark, FOLDER), connection, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
