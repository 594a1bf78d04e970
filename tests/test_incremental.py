"""States that deltas are folded into."""

import uuid

import pytest
from pyspark.sql import functions as F

from segmart.operators import incremental
from segmart.operators.cards import first_purchase

ROWS = "k string, ts int, v string"


@pytest.fixture
def make(spark, tmp_path):
    made = []

    def build(merge, keys, base, parts=4):
        state = incremental.State(f"s{uuid.uuid4().hex}", tuple(keys), merge, parts)
        incremental.create(state, base, str(tmp_path / state.table))
        made.append(state.table)
        return state

    yield build
    for table in made:
        spark.sql(f"DROP TABLE {table}")


def values(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_base_and_deltas_equal_the_full_run(spark, make):
    deliveries = [
        [("a", 3, "x"), ("b", 1, "y"), ("c", 5, None), (None, 9, "n"), ("d", None, "n")],
        [("a", 3, "tie"), ("b", 4, "new"), ("e", 1, "first")],
        [("a", 1, "late"), ("c", 5, None), ("b", 4, "new")],
        [("a", 3, "tie"), ("f", 2, ""), ("d", 0, "dated")],
    ]
    merge = incremental.newest_rows(["k"], "ts")
    frames = [spark.createDataFrame(rows, ROWS) for rows in deliveries]
    state = make(merge, ["k"], frames[0])
    for frame in frames[1:]:
        incremental.fold(state, frame)
    everything = spark.createDataFrame([row for rows in deliveries for row in rows], ROWS)
    want = values(merge(everything))
    assert values(incremental.read(spark, state)) == want
    for frame in reversed(frames):
        incremental.fold(state, frame)
    assert values(incremental.read(spark, state)) == want


def test_only_touched_partitions_are_written(spark, make):
    base = spark.createDataFrame([(f"k{i}", 1, "old") for i in range(100)], ROWS)
    state = make(incremental.newest_rows(["k"], "ts"), ["k"], base, parts=8)

    def files():
        rows = spark.table(state.table).select(incremental.PART, F.input_file_name().alias("file")).distinct().collect()
        return {row[incremental.PART]: row["file"] for row in rows}

    before = files()
    assert len(before) == 8
    incremental.fold(state, spark.createDataFrame([("k7", 2, "new")], ROWS))
    after = files()
    assert len([part for part in before if before[part] != after[part]]) == 1
    assert incremental.read(spark, state).where("v = 'new'").count() == 1
    assert incremental.read(spark, state).count() == 100


def test_empty_base_and_empty_delta(spark, make):
    none = spark.createDataFrame([], ROWS)
    state = make(incremental.newest_rows(["k"], "ts"), ["k"], none)
    assert incremental.fold(state, none).count() == 0
    one = spark.createDataFrame([("a", 1, "x")], ROWS)
    assert values(incremental.fold(state, one)) == [("a", 1, "x")]


def test_a_state_is_not_created_twice(spark, make, tmp_path):
    base = spark.createDataFrame([("a", 1, "x")], ROWS)
    state = make(incremental.newest_rows(["k"], "ts"), ["k"], base)
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        incremental.create(state, base, str(tmp_path / "other"))


def test_first_purchases_follow_late_lines_and_moved_cards(spark, make):
    sales = [
        ("2020-02-01", "HB", " c1 "),
        ("2020-03-01", "HB", "c2"),
        ("2020-01-01", "XX", "c1"),
        ("bad", "HB", "c3"),
        ("2020-05-01", "HB", None),
    ]
    late = [("2019-01-01", "HB", "c2"), ("2020-02-01", "HB", "c1"), ("2019-05-01", "HB", None), (None, None, None)]
    schema = "sales_date string, shop_brand string, vip_no string"
    frames = [spark.createDataFrame(rows, schema) for rows in (sales, late)]
    state = make(incremental.earliest_by_card, ["vip_no"], incremental.first_dates(frames[0], "HB"))
    dates = incremental.fold(state, incremental.first_dates(frames[1], "HB"))
    everything = frames[0].unionByName(frames[1])
    for masters in ([("c1", "m"), ("c2", "m")], [("c1", "m"), ("c2", "other"), ("c3", None)]):
        cards = spark.createDataFrame(masters, "vip_no string, vip_main_no string")
        want = first_purchase(everything, cards, "HB")
        assert values(incremental.first_purchase_of(dates, cards)) == values(want)
