"""Stage 4: feature tables -> k-means personas."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.clustering import KMeansModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmart.constants import FINAL_K, N_FACTORS, N_SELECTED
from segmart.functions.columns import named
from segmart.operators import model, sparse
from segmart.operators.encode import CUSTOMER
from segmart.plans.features import CLUSTERING_TABLES
from segmart.session import materialise
from segmart.sources.tables import write_parquet


@dataclass(frozen=True)
class PersonaResult:
    personas: DataFrame
    vectors: DataFrame
    loadings: DataFrame
    selected: list[str]
    kmeans: KMeansModel


def clustering_input(features: Mapping[str, DataFrame], excluded_ids: Sequence[str] = ()) -> DataFrame:
    """The standardised features that survive the zero-share and name rules, stored once.

    From ``customer_features`` only the features that survive become columns; at a threshold of 85 % zeros
    they are fewer than seven times the non-zero features of an average customer. Without that table the
    wide tables are joined.
    """
    if "customer_features" in features:
        long = features["customer_features"]
        if excluded_ids:
            long = long.where(~F.col(CUSTOMER).isin(*excluded_ids))
        names = model.kept_names(sparse.feature_zero_share(long))
        return model.standardise(materialise(sparse.wide_features(long, names), "feature_matrix"))
    tables = {name: features[name] for name in CLUSTERING_TABLES if name in features}
    matrix = materialise(model.feature_matrix(tables, excluded_ids=excluded_ids), "feature_matrix")
    return model.standardise(model.keep_features(matrix))


def build_personas(
    features: Mapping[str, DataFrame],
    excluded_ids: Sequence[str] = (),
    n_factors: int = N_FACTORS,
    n_selected: int = N_SELECTED,
    k: int = FINAL_K,
    seed: int = 1,
    ascending: bool = True,
) -> PersonaResult:
    standardised = clustering_input(features, excluded_ids)
    loadings = model.factor_loadings(standardised, n_factors)
    selected = [row["feature"] for row in model.select_features(loadings, n_selected, ascending).collect()]
    chosen = standardised.select(CUSTOMER, *[named(c) for c in selected])
    vectors = materialise(model.assemble(chosen), "persona_vectors")
    kmeans = model.fit_kmeans(vectors, k, seed)
    return PersonaResult(model.persona_table(kmeans, vectors), vectors, loadings, selected, kmeans)


def write_personas(result: PersonaResult, folder: str, name: str = "clustering_result_kmeans_iter1") -> None:
    """The persona table (an existing one is not overwritten) and the model."""
    write_parquet(result.personas, f"{folder}/{name}.parquet", overwrite=False)
    model.save_model(result.kmeans, f"{folder}/kmeans_model")
