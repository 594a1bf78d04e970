"""Quantile sketches per group."""

import random
from bisect import bisect_left, bisect_right

import pytest

from segmart.operators import sketches

SHARES = {"low": 0.3, "high": 0.8}


def amounts(n=30_000):
    pick = random.Random(5)
    rows = []
    for i in range(n):
        group = pick.choice(["even", "even", "skewed", "ties", None])
        value = {"skewed": pick.paretovariate(1.1), "ties": float(pick.randint(1, 4))}.get(group, pick.gauss(0, 10))
        rows.append((group, i % 7, None if pick.random() < 0.1 else value))
    return rows + [("lone", 1, 5.0), ("unknown", 1, None)]


def test_rank_error_of_merged_groups(spark):
    rows = amounts()
    df = spark.createDataFrame(rows, "g string, month int, v double")
    monthly = sketches.quantile_states(df, ["g", "month"], "v")
    limits = sketches.cutoffs(sketches.merge_states(monthly, ["g"]), ["g"], SHARES).collect()
    groups = {}
    for group, _, value in rows:
        if value is not None:
            groups.setdefault(group, []).append(value)
    assert {row["g"] for row in limits} == set(groups)
    for row in limits:
        values = sorted(groups[row["g"]])
        for name, share in SHARES.items():
            assert bisect_left(values, row[name]) <= (share + 0.01) * len(values) + 1
            assert bisect_right(values, row[name]) >= (share - 0.01) * len(values) - 1


def test_bands_per_group(spark):
    df = spark.createDataFrame(
        [("a", 1.0), ("a", 5.0), ("a", 9.0), ("a", None), (None, 0.0), (None, 3.0), ("b", 2.0)], "g string, v double"
    )
    limits = spark.createDataFrame([("a", 2.0, 8.0), (None, 1.0, 2.0)], "g string, low double, high double")
    found = sketches.grouped_price_point(df, limits, ["g"], "v")
    assert found.columns == ["g", "v", "price_point"]
    want = [("a", 1.0, 0), ("a", 5.0, 1), ("a", 9.0, 2), ("a", None, 1), (None, 0.0, 0), (None, 3.0, 2), ("b", 2.0, 1)]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)


def test_empty_and_unknown_groups(spark):
    none = spark.createDataFrame([("a", None)], "g string, v double")
    states = sketches.quantile_states(none, ["g"], "v")
    assert sketches.cutoffs(sketches.merge_states(states, ["g"]), ["g"], SHARES).count() == 0


def test_size_follows_the_error():
    assert sketches.sketch_size(0.0133) == pytest.approx(200, abs=2)
    assert sketches.sketch_size(0.001) > sketches.sketch_size(0.01)
    with pytest.raises(ValueError):
        sketches.sketch_size(0)
