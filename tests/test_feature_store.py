"""The feature store's manifest."""

import pytest
from pyspark.sql import functions as F

from segmart.sources import feature_store as fs


@pytest.fixture
def store(tmp_path):
    return str(tmp_path / "store")


def table(spark, column, rows):
    return spark.createDataFrame(rows, f"id string, {column} long")


def test_scan_takes_the_newest_versions_by_rule_and_name(spark, store):
    fs.write_feature_table(table(spark, "b", [("1", 1)]), store, "use_b", "id")
    fs.write_feature_table(table(spark, "a", [("1", 2), ("2", 3), (None, 4)]), store, "use_a", "id")
    fs.write_feature_table(table(spark, "c", [("1", 9)]), store, "scratch", "id")
    second = fs.write_feature_table(table(spark, "b", [("2", 7), ("3", 8)]), store, "use_b", "id")
    assert second.version == 2
    entries = fs.manifest(spark, store, include=["use_*"])
    assert fs.pinned(entries) == {"use_a": 1, "use_b": 2}
    joined = fs.read_features(spark, entries)
    assert joined.columns == ["id", "a", "b"]
    want = [("1", 2, None), ("2", 3, 7), ("3", None, 8), (None, 4, None)]
    assert sorted(map(tuple, joined.collect()), key=repr) == sorted(want, key=repr)
    assert fs.pinned(fs.manifest(spark, store, exclude=["use_b"])) == {"scratch": 1, "use_a": 1}


def test_pinned_versions_stay(spark, store):
    fs.write_feature_table(table(spark, "a", [("1", 1)]), store, "t", "id")
    pins = fs.pinned(fs.manifest(spark, store))
    fs.write_feature_table(spark.createDataFrame([("1", "text")], "id string, other string"), store, "t", "id")
    assert fs.read_features(spark, fs.pinned_entries(spark, store, pins)).columns == ["id", "a"]
    with pytest.raises(ValueError, match="not in the manifest"):
        fs.pinned_entries(spark, store, {"t": 3})


def test_changed_files_are_refused(spark, store):
    entry = fs.write_feature_table(table(spark, "a", [("1", 1)]), store, "t", "id")
    table(spark, "a", [("1", 1)]).withColumn("a", F.col("a").cast("string")).write.mode("overwrite").parquet(entry.path)
    with pytest.raises(ValueError, match="another schema.*'a'"):
        fs.read_entry(spark, entry)


def test_stray_folders_are_not_tables(spark, store):
    fs.write_feature_table(table(spark, "a", [("1", 1)]), store, "t", "id")
    table(spark, "z", [("1", 1)]).write.parquet(f"{store}/tables/stray/v1.parquet")
    assert fs.pinned(fs.manifest(spark, store)) == {"t": 1}


def test_missing_store_keys_and_clashing_columns(spark, store):
    assert fs.manifest(spark, store) == []
    with pytest.raises(ValueError, match="no feature table"):
        fs.read_features(spark, [])
    with pytest.raises(ValueError, match="no column"):
        fs.write_feature_table(table(spark, "a", []), store, "t", "customer")
    fs.write_feature_table(table(spark, "a", []), store, "t", "id")
    assert fs.read_features(spark, fs.manifest(spark, store)).count() == 0
    fs.write_feature_table(table(spark, "A", [("1", 1)]), store, "u", "id")
    with pytest.raises(ValueError, match="repeats columns"):
        fs.read_features(spark, fs.manifest(spark, store))
    fs.write_feature_table(spark.createDataFrame([("1", 1)], "key string, b long"), store, "u", "key")
    with pytest.raises(ValueError, match="different keys"):
        fs.read_features(spark, fs.manifest(spark, store))
