"""Feature selection, factor analysis and k-means personas on Spark ML.

Only results bounded by the number of features reach the driver: one row of statistics, the
feature correlation matrix and the cluster centres.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmart.constants import (
    FEATURE_NAME_STOPWORDS,
    FINAL_K,
    N_FACTORS,
    N_SELECTED,
    WCSS_MAX_K,
    WCSS_RESTARTS,
    ZERO_SHARE_THRESHOLD,
)
from segmart.functions.columns import named, quoted
from segmart.operators import sweep
from segmart.operators.encode import CUSTOMER

VECTOR = "features"


def feature_matrix(
    tables: Mapping[str, DataFrame], optional: Sequence[str] = ("tagging",), excluded_ids: Sequence[str] = ()
) -> DataFrame:
    """All feature tables side by side per customer: inner joins, left joins for ``optional`` ones."""
    required = [df for name, df in tables.items() if name not in optional]
    matrix = required[0]
    for df in required[1:]:
        matrix = matrix.join(df, CUSTOMER, "inner")
    for name in optional:
        if name in tables:
            matrix = matrix.join(tables[name], CUSTOMER, "left")
    return drop_ids(matrix, excluded_ids).na.fill(0)


def drop_ids(df: DataFrame, excluded_ids: Sequence[str]) -> DataFrame:
    return df.where(~F.col(CUSTOMER).isin(*excluded_ids)) if excluded_ids else df


def feature_names(df: DataFrame, key: str = CUSTOMER) -> list[str]:
    return [c for c in df.columns if c != key]


def zero_share(df: DataFrame, key: str = CUSTOMER) -> DataFrame:
    """(feature, zero_share) of every feature in one pass; null counts as zero."""
    counted = Summarizer.metrics("count", "numNonZeros").summary(F.col(VECTOR)).alias("s")
    shares = assemble(df, key).select(counted).select(
        F.posexplode(vector_to_array("s.numNonZeros")).alias("position", "filled"), F.col("s.count").alias("n")
    )
    names = F.array(*[F.lit(c) for c in feature_names(df, key)])
    return shares.select(
        F.get(names, F.col("position")).alias("feature"), ((F.col("n") - F.col("filled")) / F.col("n")).alias("zero_share")
    )


def keep_features(
    df: DataFrame,
    threshold: float = ZERO_SHARE_THRESHOLD,
    stopwords: Sequence[str] = FEATURE_NAME_STOPWORDS,
    key: str = CUSTOMER,
) -> DataFrame:
    """Drop the features that are mostly zero or whose name contains a stopword (case matters)."""
    kept = set(kept_names(zero_share(df, key), threshold, stopwords))
    return df.selectExpr(key, *[quoted(c) for c in feature_names(df, key) if c in kept])


def kept_names(
    shares: DataFrame, threshold: float = ZERO_SHARE_THRESHOLD, stopwords: Sequence[str] = FEATURE_NAME_STOPWORDS
) -> list[str]:
    """Sorted names of the features below ``threshold`` zeros and without a stopword."""
    filled = shares.where(F.col("zero_share") < threshold).select("feature").collect()
    return sorted(row["feature"] for row in filled if not any(word in row["feature"] for word in stopwords))


def standardise(df: DataFrame, key: str = CUSTOMER) -> DataFrame:
    """(x - mean) / population deviation per feature; a constant feature becomes 0."""
    names = feature_names(df, key)
    summary = assemble(df, key).select(
        Summarizer.metrics("count", "mean", "variance").summary(F.col(VECTOR)).alias("s")
    ).first()["s"]
    to_population = (summary["count"] - 1) / summary["count"] if summary["count"] else 0.0
    means, deviations = summary["mean"].toArray(), np.sqrt(summary["variance"].toArray() * to_population)

    scaled = [
        f"(coalesce(cast({quoted(c)} as double), 0D) - {mean!r}D) / {deviation!r}D AS {quoted(c)}"
        if deviation
        else f"0D AS {quoted(c)}"
        for c, mean, deviation in zip(names, means.tolist(), deviations.tolist())
    ]
    return df.selectExpr(key, *scaled)


def assemble(df: DataFrame, key: str = CUSTOMER) -> DataFrame:
    """(key, features vector); null becomes 0."""
    names = feature_names(df, key)
    safe = df.selectExpr(key, *[f"coalesce(cast({quoted(c)} as double), 0D) AS f{i}" for i, c in enumerate(names)])
    assembler = VectorAssembler(inputCols=[f"f{i}" for i in range(len(names))], outputCol=VECTOR)
    return assembler.transform(safe).select(key, VECTOR)


def correlation(df: DataFrame, key: str = CUSTOMER) -> np.ndarray:
    """Pearson correlations of all features; 0 for a constant feature, also with itself."""
    matrix = Correlation.corr(assemble(df, key), VECTOR).first()[0].toArray()
    constant = np.isnan(matrix).sum(axis=0) >= max(len(matrix) - 1, 1)
    matrix = np.nan_to_num(matrix)
    matrix[constant, :] = 0.0
    matrix[:, constant] = 0.0
    return matrix


def correlation_table(spark: SparkSession, names: Sequence[str], matrix: np.ndarray) -> DataFrame:
    rows = [(a, b, float(matrix[i, j])) for i, a in enumerate(names) for j, b in enumerate(names)]
    return spark.createDataFrame(rows, "feature_a string, feature_b string, correlation double")


def factor_analysis(
    matrix: np.ndarray, rows: int, n_factors: int = N_FACTORS, tolerance: float = 1e-2, max_iterations: int = 1000
) -> tuple[np.ndarray, np.ndarray]:
    """Maximum-likelihood factor analysis of a feature correlation matrix: (loadings, unique variances).

    For given unique variances the likelihood is greatest when the loadings span the leading
    eigenvectors of the rescaled matrix; the variances are then what the loadings leave over.
    Both steps repeat until the log-likelihood of ``rows`` observations rises by less than
    ``tolerance``. The work depends on the number of features only.
    """
    size = len(matrix)
    count = min(n_factors, size)
    smallest = 1e-12
    observed = np.diag(matrix).copy()
    unique = np.ones(size)
    previous = -np.inf
    loadings = np.zeros((size, count))
    for _ in range(max_iterations):
        root = np.sqrt(unique) + smallest
        values, vectors = np.linalg.eigh(matrix / np.outer(root, root))
        leading = np.maximum(values[::-1][:count], smallest)
        remaining = values[: size - count].sum()
        loadings = root[:, None] * vectors[:, ::-1][:, :count] * np.sqrt(np.maximum(leading - 1.0, 0.0))
        deviance = size * np.log(2 * np.pi) + count + np.log(leading).sum() + remaining + np.log(unique).sum()
        likelihood = -0.5 * rows * deviance
        if likelihood - previous < tolerance:
            break
        previous = likelihood
        unique = np.maximum(observed - (loadings**2).sum(axis=1), smallest)
    return loadings, unique


def loading_table(spark: SparkSession, names: Sequence[str], loadings: np.ndarray) -> DataFrame:
    rows = [(a, j, float(loadings[i, j])) for i, a in enumerate(names) for j in range(loadings.shape[1])]
    return spark.createDataFrame(rows, "feature string, factor int, loading double")


def factor_loadings(standardised: DataFrame, n_factors: int = N_FACTORS, key: str = CUSTOMER) -> DataFrame:
    """(feature, factor, loading) of the standardised features."""
    loadings, _ = factor_analysis(correlation(standardised, key), standardised.count(), n_factors)
    return loading_table(standardised.sparkSession, feature_names(standardised, key), loadings)


def select_features(loadings: DataFrame, n: int = N_SELECTED, ascending: bool = True) -> DataFrame:
    """The n features with the smallest (or greatest) total absolute loading."""
    scored = loadings.groupBy("feature").agg(F.sum(F.abs("loading")).alias("score"))
    order = F.col("score").asc() if ascending else F.col("score").desc()
    return scored.orderBy(order, "feature").limit(n)


def first_points(points: DataFrame, rows: int) -> DataFrame:
    """The first ``rows`` points by a hash of themselves.

    Of many points only those with small hashes are sorted, about four times as many as wanted; otherwise every
    partition would send that many to the driver.
    """
    place = F.xxhash64(sweep.POINT)
    total, near = points.count(), points
    if total > 8 * rows:
        below = points.where(place < F.lit(-(1 << 63) + (1 << 64) * 4 * rows // total))
        near = below if below.limit(rows).count() == rows else points
    return near.orderBy(place, sweep.POINT).limit(rows)


def wcss_curve(
    vectors: DataFrame,
    ks: Sequence[int] = range(1, WCSS_MAX_K + 1),
    restarts: int = WCSS_RESTARTS,
    seed: int = 1,
    sample_rows: int = 20_000,
    max_scans: int = 300,
) -> DataFrame:
    """(k, wcss, moved): within-cluster sum of squares, the best of ``restarts`` fits per k.

    All fits advance together, one scan of the vectors for a step of every one of them. Starts are k-means++ and
    k-means on at most ``sample_rows`` vectors, the first by a hash of themselves; everything else uses all
    of them. ``moved`` is the longest last step of any centre, at most 1e-4 unless scans ran out. No vectors, no rows.
    """
    spark = vectors.sparkSession
    points = vectors.select(vector_to_array(VECTOR).alias(sweep.POINT)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        chosen = first_points(points, sample_rows).collect()
        if not chosen or not len(chosen[0][0]):
            return spark.createDataFrame([], "k int, wcss double, moved double")
        sample = np.array([row[0] for row in chosen])
        starts = sweep.refined_starts(spark, sample, sweep.sample_starts(sample, ks, restarts, seed), max_scans)
        found = sweep.lloyd_sweep(points, starts, max_scans)
    finally:
        points.unpersist()
    best: dict[int, float] = {}
    fits = [k for k in ks for _ in range(restarts if k > 1 else 1)]
    for k, cost in zip(fits, found.costs, strict=True):
        best[k] = min(cost, best.get(k, cost))
    return spark.createDataFrame([(k, cost, found.moved) for k, cost in best.items()], "k int, wcss double, moved double")


def fit_kmeans(vectors: DataFrame, k: int = FINAL_K, seed: int = 1, max_iterations: int = 300) -> KMeansModel:
    return KMeans(k=k, seed=seed, maxIter=max_iterations, tol=1e-4, featuresCol=VECTOR).fit(vectors)


def persona_table(model: KMeansModel, vectors: DataFrame, key: str = CUSTOMER) -> DataFrame:
    """(customer, persona): the id travels with its vector through the model."""
    return model.transform(vectors).select(key, F.col("prediction").alias("persona"))


def cluster_sizes(personas: DataFrame) -> DataFrame:
    return personas.groupBy("persona").agg(F.count(F.lit(1)).alias("customers")).orderBy("persona")


def save_model(model: KMeansModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> KMeansModel:
    return KMeansModel.load(path)


def nearest_centre(df: DataFrame, centres: Sequence[Sequence[float]], key: str = CUSTOMER) -> DataFrame:
    """(key, persona) by squared distance to given centres; the lower id wins a tie."""
    names = feature_names(df, key)
    options = []
    for label, centre in enumerate(centres):
        squares = [(named(c).cast("double") - F.lit(float(x))) ** 2 for c, x in zip(names, centre)]
        options.append(F.struct(sum(squares[1:], squares[0]).alias("distance"), F.lit(label).alias("persona")))
    return df.select(key, F.array_min(F.array(*options))["persona"].alias("persona"))
