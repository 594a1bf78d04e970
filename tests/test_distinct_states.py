"""Distinct counts from bitmaps of months."""

import random

import pytest
from pyspark.sql import functions as F

from segmart.operators import distinct_states as ds

SCHEMA = "segment string, month string, orders string"


def lines(seed, months, n=4000, prefix="o"):
    pick = random.Random(seed)
    rows = []
    for _ in range(n):
        order = None if pick.random() < 0.05 else f"{prefix}{int(pick.random() ** 2 * 900)}"
        # One segment holds a third of all rows, and one order recurs in them.
        segment = "hot" if pick.random() < 0.33 else pick.choice(["a", "b", None])
        rows.append((segment, pick.choice(months), "o1" if segment == "hot" and pick.random() < 0.3 else order))
    return rows


def brute(rows, months):
    found = {}
    for segment, month, order in rows:
        if month in months and order is not None:
            found.setdefault(segment, set()).add(order)
    return {segment: len(orders) for segment, orders in found.items()}


def counted(states):
    return {row["segment"]: row["value"] for row in ds.distinct_counts(states, ["segment"]).collect()}


@pytest.fixture(scope="module")
def stored(spark):
    rows = lines(1, ["202001", "202002", "202003"])
    df = spark.createDataFrame(rows, SCHEMA)
    ids = ds.value_ids(df, "orders", "month")
    return rows, df, ids, ds.distinct_states(df, ids, ["segment", "month"], "orders").cache()


@pytest.mark.parametrize("months", [["202001"], ["202001", "202002"], ["202002", "202003"], ["202001", "202002", "202003"], ["209901"]])
def test_windows_equal_a_distinct_count(stored, months):
    rows, _, _, states = stored
    assert counted(states.where(F.col("month").isin(months))) == brute(rows, months)


def test_ids_are_one_to_one(stored):
    rows, _, ids, _ = stored
    found = [tuple(row) for row in ids.collect()]
    assert len({v for v, _ in found}) == len({i for _, i in found}) == len(found) == len({o for _, _, o in rows if o is not None})


def test_a_new_month_is_added_without_the_old_lines(spark, stored):
    rows, df, ids, states = stored
    more = lines(2, ["202004"]) + lines(3, ["202004"], 500, "new")
    news = spark.createDataFrame(more, SCHEMA)
    longer = ds.extend_ids(ids, news, "orders", "month")
    assert ids.exceptAll(longer).count() == 0
    assert longer.select("value_id").distinct().count() == longer.count()
    both = states.unionByName(ds.distinct_states(news, longer, ["segment", "month"], "orders"))
    months = ["202002", "202003", "202004"]
    assert counted(both.where(F.col("month").isin(months))) == brute(rows + more, months)
    assert counted(ds.merge_states(both, ["segment", "month"])) == brute(rows + more, {"202001", *months})


def test_overlapping_windows_in_one_pass(stored):
    rows, _, _, states = stored
    windows = [("202001", "202002"), ("202002", "202003"), ("202003", "202003"), ("202101", "202112")]
    found = ds.distinct_counts(ds.in_windows(states, "month", windows), ["window", "segment"])
    want = {
        (f"{first}-{last}", segment): n
        for first, last in windows
        for segment, n in brute(rows, [m for m in ("202001", "202002", "202003") if first <= m <= last]).items()
    }
    assert {(row["window"], row["segment"]): row["value"] for row in found.collect()} == want


def test_more_values_than_a_bitmap_holds(spark):
    df = spark.range(100_000).select(
        F.lit("s").alias("segment"), (F.col("id") % 3).cast("string").alias("month"), F.col("id").cast("string").alias("orders")
    )
    states = ds.distinct_states(df, ds.value_ids(df, "orders", "month"), ["segment"], "orders")
    assert counted(states) == {"s": 100_000}


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    ids = ds.value_ids(none, "orders", "month")
    assert ds.distinct_states(none, ids, ["segment"], "orders").count() == 0
    one = spark.createDataFrame([("a", "202001", "x"), ("a", "202001", "x"), ("a", None, None)], SCHEMA)
    longer = ds.extend_ids(ids, one, "orders", "month")
    assert counted(ds.distinct_states(one, longer, ["segment"], "orders")) == {"a": 1}
