"""Registered feature and model queries."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmart.functions.columns import named, quoted
from segmart.operators import model, sparse, sweep
from segmart.operators.clean import clean_for_features
from segmart.operators.customer import (
    demographics,
    price_cutoffs,
    price_point,
    tenure,
    transactional,
    visits,
)
from segmart.operators.encode import CUSTOMER, collect_values
from segmart.operators.tags import attach_tags, tag_items
from segmart.plans.features import BRAND, MAINCAT, SUBCAT, category_values, demographic_features, encoded_tables
from segmart.registry import mart as m
from segmart.sources import retail

CENTRES = [[5000.0, 5, 1, 0], [60000.0, 20, 1, 1], [150000.0, 60, 2, 1], [300000.0, 120, 4, 1], [600000.0, 250, 8, 2]]
OUTLIERS = ("V2", "V4", "V60")


def tagged_totals(mart: m.Mart, fan_out: bool = False) -> DataFrame:
    per_item = mart.totals.groupBy(CUSTOMER, "item_desc").agg(F.sum("sold_qty").alias("sold_qty"))
    return attach_tags(per_item, mart.item_tags, fan_out=fan_out)


def counts(mart: m.Mart, name: str) -> DataFrame:
    return encoded_tables(mart.values, category_values(mart.values))["tagging" if name == "tag" else name]


def shares(mart: m.Mart, name: str) -> DataFrame:
    return encoded_tables(mart.values, category_values(mart.values))[f"share_of_wallet_{name}"]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison; adding zero turns a negative zero into zero."""
    return df.selectExpr(
        *[
            f"round({quoted(name)}, {digits}) + 0D AS {quoted(name)}" if kind == "double" else quoted(name)
            for name, kind in df.dtypes
        ]
    )


def spending(mart: m.Mart) -> DataFrame:
    return mart.spending


def whole_counts(matrix: DataFrame) -> DataFrame:
    return matrix.selectExpr(
        *[f"cast({quoted(c)} AS bigint) AS {quoted(c)}" if c.endswith("_qty") else quoted(c) for c in matrix.columns]
    )


def full_matrix(mart: m.Mart) -> DataFrame:
    return mart.matrix


def sparse_rows(mart: m.Mart) -> DataFrame:
    """The sparse vectors as text: positions and values of each customer."""
    found = sparse.sparse_vectors(mart.features, mart.dictionary)
    return found.select(
        CUSTOMER,
        F.array_join(F.transform("positions", lambda p: p.cast("string")), ",").alias("positions"),
        F.round(F.aggregate("values", F.lit(0.0), lambda total, x: total + x), 3).alias("total"),
    )


def unpivoted(df: DataFrame) -> DataFrame:
    names = model.feature_names(df)
    doubles = df.select(CUSTOMER, *[named(c).cast("double").alias(c) for c in names])
    return doubles.unpivot(CUSTOMER, [named(c) for c in names], "feature", "value")


def maincat_counts(mart: m.Mart) -> DataFrame:
    return counts(mart, "maincat")


def item_tags(mart: m.Mart, **options) -> DataFrame:
    tags = tag_items(mart.transaction, **options)
    return tags.withColumn("tags", F.array_join("tags", "|"))


def spending_features(mart: m.Mart) -> DataFrame:
    return spending(mart).select(
        CUSTOMER, "net_amt_hkd", "sold_qty", "invoice_no", F.coalesce("visit", F.lit(0)).alias("visit")
    )


def correlation_long(mart: m.Mart) -> DataFrame:
    features = full_matrix(mart)
    matrix = model.correlation(features)
    return rounded(model.correlation_table(mart.spark, model.feature_names(features), matrix), 3)


def factor_selection(mart: m.Mart) -> DataFrame:
    return model.select_features(mart.result.loadings)


def price_point_check(mart: m.Mart) -> DataFrame:
    """Customers, and whether either approximate cutoff is off by at most 1 % of them, rounded up."""
    found = spending(mart)
    high, low = price_cutoffs(found)
    amount = F.col("net_amt_hkd").cast("double")
    counted = found.agg(
        F.count(F.lit(1)).alias("customers"),
        *[
            F.sum((amount < F.lit(float(cutoff))).cast("long")).alias(f"below_{name}")
            for name, cutoff in (("low", low), ("high", high))
        ],
        *[
            F.sum((amount <= F.lit(float(cutoff))).cast("long")).alias(f"upto_{name}")
            for name, cutoff in (("low", low), ("high", high))
        ],
    )
    # The rank of a cutoff is a range where customers tie with it.
    return counted.select(
        "customers",
        *[
            (
                (F.col(f"below_{name}") <= (share + 0.01) * F.col("customers") + 1)
                & (F.col(f"upto_{name}") >= (share - 0.01) * F.col("customers") - 1)
            ).alias(f"{name}_within")
            for name, share in (("low", 0.3), ("high", 0.8))
        ],
    )


def persona_check(mart: m.Mart) -> DataFrame:
    """Customers, how many of them are not with their nearest centre, and the sum of the cluster sizes."""
    centres = [[float(x) for x in centre] for centre in mart.result.kmeans.clusterCenters()]
    point = vector_to_array("features")
    distances = F.array(
        *[
            F.aggregate(
                F.zip_with(point, F.array(*map(F.lit, centre)), lambda x, c: (x - c) * (x - c)),
                F.lit(0.0),
                lambda total, x: total + x,
            )
            for centre in centres
        ]
    )
    placed = mart.result.personas.join(mart.result.vectors, CUSTOMER).select(
        "persona", distances.alias("distances")
    )
    # As near as makes no difference in doubles.
    wrong = F.get("distances", F.col("persona")) > F.array_min("distances") + 1e-9
    sizes = model.cluster_sizes(mart.result.personas).agg(F.sum("customers").alias("sizes"))
    return placed.agg(
        F.count(F.lit(1)).alias("customers"), F.sum(wrong.cast("long")).alias("misplaced")
    ).crossJoin(F.broadcast(sizes))


def wcss_check(mart: m.Mart) -> DataFrame:
    """Points of the curve, whether it starts at its top and falls, and whether all centres came to rest."""
    first = F.max(F.when(F.col("k") == 1, F.col("wcss")))
    return mart.curve.agg(
        F.count(F.lit(1)).alias("points"),
        (F.max("wcss") <= first).alias("one_is_most"),
        (F.min_by("wcss", "k") >= F.max_by("wcss", "k")).alias("falls"),
        (F.max("moved") <= 1e-4).alias("at_rest"),
    )


def wcss_of_centres(mart: m.Mart) -> DataFrame:
    """Sums of squares around the first one to five of the given centres, all from one scan."""
    columns = ("net_amt_hkd", "sold_qty", "invoice_no", "visit")
    points = spending_features(mart).select(F.array(*[F.col(c).cast("double") for c in columns]).alias(sweep.POINT))
    models = [np.array(CENTRES[:k], dtype=float) for k in range(1, len(CENTRES) + 1)]
    costs = sweep.model_costs(points, models)
    # In units that doubles hold exactly whatever the order of summing.
    return mart.spark.createDataFrame([(k, round(cost / 1e6, 2)) for k, cost in enumerate(costs, 1)], "k int, wcss_millions double")


def factor_selection_check(mart: m.Mart) -> DataFrame:
    """Features that take part, how many are selected, and whether no other one has a lower total loading."""
    scores = mart.result.loadings.groupBy("feature").agg(F.sum(F.abs("loading")).alias("score"))
    chosen = F.col("feature").isin(*mart.result.selected)
    return scores.agg(
        F.count(F.lit(1)).alias("features"),
        F.sum(chosen.cast("long")).alias("selected"),
        F.coalesce(
            F.max(F.when(chosen, F.col("score"))) <= F.min(F.when(~chosen, F.col("score"))), F.lit(True)
        ).alias("lowest"),
    )


QUERIES = {
    "clean_features": lambda t: clean_for_features(t.transaction).select(
        CUSTOMER, "sales_main_key", "item_code", "sold_qty", "net_amt_hkd", BRAND, MAINCAT, SUBCAT
    ),
    "item_tags": item_tags,
    "item_tags_distinct": lambda t: item_tags(t, distinct_tags=True),
    "item_tags_indexed": lambda t: item_tags(t, inline_keywords=0),
    "tag_fanout": lambda t: tagged_totals(t, True).groupBy(CUSTOMER, "tags").agg(F.sum("sold_qty").alias("qty")),
    "count_encode_subcat": lambda t: counts(t, "subcat"),
    "count_encode_maincat": lambda t: counts(t, "maincat"),
    "count_encode_brand": lambda t: counts(t, "brand"),
    "count_encode_tag": lambda t: counts(t, "tag"),
    "share_of_wallet_subcat": lambda t: rounded(shares(t, "subcat")),
    "share_of_wallet_maincat": lambda t: rounded(shares(t, "maincat")),
    "share_of_wallet_brand": lambda t: rounded(shares(t, "brand")),
    "collect_values": lambda t: collect_values(t.clean, SUBCAT).withColumn(
        SUBCAT, F.array_join(F.transform(SUBCAT, lambda e: F.concat_ws(":", e["value"], e["lines"])), "|")
    ),
    "tenure_bands": lambda t: tenure(t.first_purchase, retail.AS_OF),
    "demographics": lambda t: demographics(t.clean, tenure(t.first_purchase, retail.AS_OF)),
    "one_hot_demographics": lambda t: demographic_features(t.clean, t.first_purchase, retail.AS_OF),
    "visits": lambda t: visits(t.clean, *retail.WINDOW),
    "transactional": lambda t: rounded(
        spending(t).withColumn("visit", F.col("visit").cast("double"))
    ),
    "transactional_order_key": lambda t: rounded(
        transactional(t.clean, order_key="sales_main_key").withColumn("visit", F.col("visit").cast("double"))
    ),
    "price_point_exact": lambda t: price_point(
        spending(t), price_cutoffs(spending(t), relative_error=0)
    ).select(CUSTOMER, "net_amt_hkd", "price_point"),
    "price_point_approx": lambda t: price_point(spending(t), price_cutoffs(spending(t))).select(
        CUSTOMER, "net_amt_hkd", "price_point"
    ),
    "customer_features": lambda t: rounded(t.features),
    "feature_dictionary": lambda t: t.dictionary,
    "sparse_vectors": sparse_rows,
    "feature_matrix_join": lambda t: rounded(whole_counts(full_matrix(t))),
    "outlier_exclusion": lambda t: rounded(whole_counts(model.drop_ids(full_matrix(t), OUTLIERS))),
    "zero_share": lambda t: rounded(sparse.feature_zero_share(t.features)),
    "standardised_features": lambda t: rounded(unpivoted(model.standardise(full_matrix(t))), 3),
    "correlation_matrix": correlation_long,
    "wcss_k1": lambda t: rounded(
        model.wcss_curve(model.assemble(maincat_counts(t)), ks=[1]).select("k", "wcss"), 3
    ),
    "wcss_of_centres": wcss_of_centres,
    "nearest_centre": lambda t: model.nearest_centre(spending_features(t), CENTRES),
    "factor_loadings": lambda t: t.result.loadings,
    "factor_selection": factor_selection,
    "factor_selection_check": factor_selection_check,
    "price_point_check": price_point_check,
    "wcss_curve": lambda t: t.curve.select("k", "wcss"),
    "wcss_check": wcss_check,
    "kmeans_personas": lambda t: t.result.personas,
    "persona_check": persona_check,
    "cluster_sizes": lambda t: model.cluster_sizes(t.result.personas),
}
