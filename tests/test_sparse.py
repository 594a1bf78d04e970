"""Long features: discovered values, and the same numbers as the wide tables joined."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from segmart.operators import model, sparse
from segmart.operators.encode import CUSTOMER, count_encoding, share_of_wallet
from segmart.plans.features import CATEGORIES, category_values, encoded_tables, feature_values, purchase_totals

SCHEMA = f"{CUSTOMER} string, {CATEGORIES['subcat']} string, {CATEGORIES['maincat']} string, {CATEGORIES['brand']} string, item_desc string, sold_qty long, net_amt_hkd decimal(12,2)"  # noqa: E501
ROWS = [
    ("a", "s1", "m1", "b1", "lip cream", 2, 10), ("a", "s2", "m1", "b`2. x", "plain", 1, 30), ("a", "s1", "m1", "b1", "lip cream", -2, -10),
    ("b", "s1", "", "b1", "plain", 1, 5), ("b", "s1", "m2", "b1", "eye serum", 3, 5), ("c", "s1", None, "b1", "plain", 1, 7),
    ("d", "s2", "m2", "b1", None, 1, 5), ("d", "s2", "m2", "b1", "plain", 1, -5), ("e", "", "m1", "b1", "plain", 1, 1),
]
TAGS = [("lip cream", ["LIP", "CREAM"]), ("plain", []), ("eye serum", ["EYE"]), (None, [])]


@pytest.fixture(scope="module")
def item_tags(spark):
    return spark.createDataFrame(TAGS, "item_desc string, tags array<string>")


def lines(spark, rows):
    return spark.createDataFrame([(*row[:-1], None if row[-1] is None else Decimal(row[-1])) for row in rows], SCHEMA)


def built(spark, rows, item_tags):
    totals = purchase_totals(lines(spark, rows))
    values = feature_values(totals, item_tags).cache()
    return totals, values, sparse.customer_features(values)


def table(df):
    return {row[CUSTOMER]: {c: row[c] for c in df.columns if c != CUSTOMER} for row in df.collect()}


def test_same_as_the_wide_tables(spark, item_tags):
    totals, values, features = built(spark, ROWS, item_tags)
    names = category_values(values)
    assert names == {"subcat": ["", "s1", "s2"], "maincat": ["", "m1", "m2"], "brand": ["b1", "b`2. x"], "tag": ["CREAM", "EYE", "LIP"]}
    wide = encoded_tables(values, names)
    for name, column in CATEGORIES.items():
        assert table(wide[name]) == table(count_encoding(totals, column, prefix=f"{name}_"))
        assert table(wide[f"share_of_wallet_{name}"]) == table(share_of_wallet(totals, column, f"_SOW_by_{name}"))
    joined = model.feature_matrix(wide)
    found = sparse.wide_features(features, model.feature_names(joined))
    # c has a null category and e a blank one only; b has both kinds.
    assert table(found) == table(joined) and set(table(found)) == {"a", "b", "d"}
    assert {r[0]: r[1] for r in sparse.feature_zero_share(features).collect()} == {
        r[0]: r[1] for r in model.zero_share(joined).collect()
    }
    without = sparse.wide_features(features, ["brand_b1_qty"], excluded_ids=["a"])
    assert table(without) == {"b": {"brand_b1_qty": 4.0}, "d": {"brand_b1_qty": 2.0}}


def test_a_new_brand_is_a_new_feature(spark, item_tags):
    _, values, features = built(spark, [*ROWS, ("a", "s1", "m1", "never seen", "plain", 4, 60)], item_tags)
    assert category_values(values)["brand"] == ["b1", "b`2. x", "never seen"]
    row = sparse.wide_features(features, ["brand_never seen_qty", "never seen_SOW_by_brand"]).where(f"{CUSTOMER} = 'a'").first()
    assert row["brand_never seen_qty"] == 4.0 and abs(row["never seen_SOW_by_brand"] - 60 / 90 * 100) < 1e-9


def test_more_values_than_columns_could_hold(spark, item_tags):
    """20,000 brands: only the features that are filled often enough become columns."""
    rows = [(f"c{i % 50}", "s1", "m1", f"brand {i}", "plain", 1, 1) for i in range(20_000)]
    _, _, features = built(spark, rows, item_tags)
    dictionary = sparse.feature_dictionary(features)
    numbers = [(r["position"], r["category"], r["kind"], r["feature"]) for r in dictionary.collect()]
    assert len(numbers) == 40_004 and [n[0] for n in sorted(numbers)] == list(range(40_004))
    assert sorted(numbers) == [(i, *rest) for i, rest in enumerate(sorted(n[1:] for n in numbers))]
    vectors = sparse.sparse_vectors(features, dictionary)
    assert vectors.count() == 50
    assert vectors.where((F.size("positions") != 804) | (F.size("values") != 804)).isEmpty()
    kept = model.kept_names(sparse.feature_zero_share(features))
    assert kept == ["m1_SOW_by_maincat", "maincat_m1_qty", "s1_SOW_by_subcat", "subcat_s1_qty"]


def test_empty_and_no_columns(spark, item_tags):
    _, values, features = built(spark, ROWS, item_tags)
    none = features.where("false")
    assert sparse.feature_zero_share(none).count() == sparse.feature_dictionary(none).count() == 0
    assert table(sparse.wide_features(features, [])) == {"a": {}, "b": {}, "d": {}}
    assert sparse.wide_counts(values, "brand", []).columns == [CUSTOMER]


def test_one_shuffle_by_customer(spark, item_tags):
    totals = purchase_totals(lines(spark, ROWS)).checkpoint()
    plan = sparse.customer_features(sparse.customer_values(totals, CATEGORIES))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
