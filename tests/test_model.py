"""Statistics, factor analysis, clustering and quantiles."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from segmart.operators import model
from segmart.operators.customer import price_cutoffs
from segmart.operators.quantile import exact_quantiles


@pytest.fixture(scope="module")
def table(spark):
    rows = [(f"c{i}", float(i), 3.0, float(i % 2), None if i else 1.0) for i in range(10)]
    return spark.createDataFrame(rows, "vip_main_no string, ramp double, constant double, flip double, `spa.rse` double")


def test_zero_share_counts_null_as_zero(table):
    shares = {r["feature"]: r["zero_share"] for r in model.zero_share(table).collect()}
    assert shares == {"ramp": 0.1, "constant": 0.0, "flip": 0.5, "spa.rse": 0.9}


def test_zero_share_threshold_is_inclusive(spark):
    rows = [(str(i), 1 if i < 3 else 0) for i in range(20)]
    df = spark.createDataFrame(rows, "vip_main_no string, x int")
    assert model.keep_features(df, 0.85).columns == ["vip_main_no"]
    assert model.keep_features(df, 0.86).columns == ["vip_main_no", "x"]


def test_name_rule_is_case_sensitive(spark):
    df = spark.createDataFrame([("a", 1, 1, 1, 1)], "vip_main_no string, brand_x int, tag_SET int, subcat_Set int, reset int")
    assert model.keep_features(df).columns == ["vip_main_no", "reset"]


def test_standardise(table):
    scaled = model.standardise(table)
    row = scaled.agg(
        F.avg("ramp").alias("m"), F.stddev_pop("ramp").alias("s"), F.max(F.abs("constant")).alias("c")
    ).first()
    assert abs(row["m"]) < 1e-12 and abs(row["s"] - 1) < 1e-12 and row["c"] == 0
    top = scaled.where("vip_main_no = 'c9'").first()["ramp"]
    assert abs(top - 4.5 / 2.8722813232690143) < 1e-12


def test_correlation_of_constant_feature_is_zero(table):
    matrix = model.correlation(table.select("vip_main_no", "ramp", "constant", "flip"))
    assert matrix[1].tolist() == [0, 0, 0] and matrix[0, 0] == 1
    assert abs(matrix[0, 2] - np.corrcoef(range(10), [i % 2 for i in range(10)])[0, 1]) < 1e-12


def test_factor_analysis_recovers_the_structure():
    generator = np.random.default_rng(3)
    loadings = generator.normal(size=(12, 2))
    covariance = loadings @ loadings.T + np.diag(generator.uniform(0.3, 1.0, 12))
    scale = np.sqrt(np.diag(covariance))
    matrix = covariance / np.outer(scale, scale)
    found, unique = model.factor_analysis(matrix, 100_000, 2, tolerance=1e-6, max_iterations=5000)
    assert np.abs(found @ found.T + np.diag(unique) - matrix).max() < 1e-3


def test_factor_selection_takes_the_lowest_totals(spark):
    loadings = spark.createDataFrame(
        [("a", 0, 2.0), ("a", 1, -1.0), ("b", 0, 1.0), ("b", 1, 0.0), ("c", 0, -1.0), ("c", 1, 1.0)],
        "feature string, factor int, loading double",
    )
    assert [r["feature"] for r in model.select_features(loadings, 2).collect()] == ["b", "c"]
    assert [r["feature"] for r in model.select_features(loadings, 2, ascending=False).collect()] == ["a", "c"]


@pytest.fixture(scope="module")
def blobs(spark):
    generator = np.random.default_rng(5)
    rows = [(f"c{i}", float(i % 3 * 10 + generator.normal()), float(generator.normal())) for i in range(300)]
    return spark.createDataFrame(rows, "vip_main_no string, x double, y double")


def test_wcss_falls_and_k1_is_the_variance(blobs):
    vectors = model.assemble(blobs)
    curve = [r["wcss"] for r in model.wcss_curve(vectors, [1, 2, 3], restarts=2).collect()]
    assert curve[0] > curve[1] > curve[2]
    points = np.array([[r["x"], r["y"]] for r in blobs.collect()])
    assert math.isclose(curve[0], ((points - points.mean(axis=0)) ** 2).sum(), rel_tol=1e-9)


def test_personas_keep_their_ids_and_the_model_reloads(blobs, tmp_path):
    vectors = model.assemble(blobs)
    kmeans = model.fit_kmeans(vectors, 3, seed=4)
    personas = model.persona_table(kmeans, vectors)
    assert sorted(r["customers"] for r in model.cluster_sizes(personas).collect()) == [100, 100, 100]
    model.save_model(kmeans, str(tmp_path / "kmeans"))
    again = model.persona_table(model.load_model(str(tmp_path / "kmeans")), vectors)
    assert personas.exceptAll(again).count() == 0
    nearest = model.nearest_centre(blobs, [c.tolist() for c in kmeans.clusterCenters()])
    assert personas.exceptAll(nearest).count() == 0


@pytest.mark.parametrize("max_values", [100_000, 50])
def test_exact_quantiles(spark, max_values):
    df = spark.range(5000).select((F.pmod(F.xxhash64("id"), F.lit(900)) * F.lit(1.5)).alias("v")).union(
        spark.createDataFrame([(None,)] * 9 + [(300.0,)] * 2500, "v double")
    )
    data = sorted(r["v"] for r in df.where("v IS NOT NULL").collect())
    for p, found in zip((0.0, 0.3, 0.5, 0.8, 1.0), exact_quantiles(df, "v", [0.0, 0.3, 0.5, 0.8, 1.0], max_values)):
        assert found == data[max(1, math.ceil(p * len(data))) - 1]


def test_exact_quantiles_of_values_that_share_a_double(spark):
    base = "12345678901234567890123456789.00000"
    kind = "decimal(38,5)"
    df = spark.range(300).select((F.lit(base).cast(kind) + (F.col("id") * F.lit("0.00001").cast(kind))).cast(kind).alias("v"))
    df = df.union(spark.createDataFrame([("1",), ("-5",)], "v string").select(F.col("v").cast(kind)))
    data = sorted(r["v"] for r in df.collect())
    shares = [0.0, 0.004, 0.3, 0.5, 1.0]
    assert exact_quantiles(df, "v", shares, 40) == [data[max(1, math.ceil(p * len(data))) - 1] for p in shares]
    longs = spark.range(300).select((F.lit(2**62) + F.col("id")).alias("v"))
    assert exact_quantiles(longs, "v", [0.5, 1.0], 20) == [2**62 + 149, 2**62 + 299]


def test_approximate_cutoffs_are_within_the_error(spark):
    df = spark.range(20_000).select(F.col("id").cast("double").alias("net_amt_hkd"))
    upper, lower = price_cutoffs(df)
    assert abs(upper / 20_000 - 0.8) <= 0.011 and abs(lower / 20_000 - 0.3) <= 0.011
