"""Customer features in long form: one row for each customer and value, whatever values occur.

All counts and shares of wallet come from one pass and one shuffle by customer. Values are discovered, so
a new brand or category is a new feature without any list, and their number has no limit: only what is
wanted as columns becomes wide.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segmart.functions.columns import named, quoted
from segmart.operators.encode import CUSTOMER
from segmart.session import materialise

COUNT, SHARE = "count", "share"
TAG = "tag"
# Long rows of one task, some hundred bytes each while they are summed up.
ROWS_PER_TASK = 500_000


def _moved_to(rows: DataFrame, key: str, about: int) -> DataFrame:
    """``rows``, ``about`` so many, at their customers, in pieces of a bounded number of rows.

    Long rows take many times as much memory as they take in a shuffle, by which adaptive execution would
    measure and merge the pieces. So they are given by number, at least one for each core, unless one task can hold all.
    """
    if about <= ROWS_PER_TASK:
        return rows.repartition(key)
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(about / ROWS_PER_TASK)), key)


def customer_values(
    totals: DataFrame, categories: Mapping[str, str], tagged: DataFrame | None = None, key: str = CUSTOMER
) -> DataFrame:
    """(key, category, value, sold_qty, net_amt_hkd, total, complete): sums per customer and value.

    ``categories`` maps a category's name to its column of ``totals``; ``tagged`` has a row per line and tag
    in ``tags``. Null values keep their row, as the customer's ``total`` amount includes them. ``complete``
    customers have a value that is neither null nor blank in every category of ``categories``.

    Each row of ``totals`` becomes one narrow row per category. They move to their customer once, and sums,
    totals and completeness are all found there; ``totals`` are sums already, so a customer has at most one
    row for each combination of its items and categories.
    """
    entries = F.array(
        *[
            F.struct(F.lit(name).alias("category"), named(column).alias("value"), F.lit(1 << i).alias("bit"))
            for i, (name, column) in enumerate(categories.items())
        ]
    )
    rows = totals.select(key, "sold_qty", "net_amt_hkd", F.inline(entries))
    if tagged is not None:
        amount = F.lit(None).cast(totals.schema["net_amt_hkd"].dataType).alias("net_amt_hkd")
        rows = rows.unionByName(
            tagged.select(key, "sold_qty", amount, F.lit(TAG).alias("category"), F.col("tags").alias("value"), F.lit(0).alias("bit"))
        )
    # Totals are stored: their number is known without reading them.
    about = totals.count() * (len(categories) + (tagged is not None))
    sums = _moved_to(rows, key, about).groupBy(key, "category", "value", "bit").agg(
        F.sum("sold_qty").alias("sold_qty"), F.sum("net_amt_hkd").alias("net_amt_hkd")
    )
    own = Window.partitionBy(key)
    filled = F.bit_or(F.when(F.col("value") != "", F.col("bit")).otherwise(0))
    return sums.select(
        key, "category", "value", "sold_qty", "net_amt_hkd",
        # Every line has one entry in the first category.
        F.sum(F.when(F.col("bit") == 1, F.col("net_amt_hkd"))).over(own).alias("total"),
        (filled.over(own) == (1 << len(categories)) - 1).alias("complete"),
    )


def customer_features(values: DataFrame, postfix: str = "_qty", key: str = CUSTOMER) -> DataFrame:
    """(key, complete, category, kind, feature, value as double) of ``customer_values``.

    Counts are named ``<category>_<value>_qty`` and left out for blank values; shares are percent of the
    customer's total, null where that is zero, named ``<value>_SOW_by_<category>``. Tags have counts only.
    """
    value, category = F.col("value"), F.col("category")
    share = F.try_divide(F.col("net_amt_hkd").cast("double"), F.col("total").cast("double")) * 100
    both = F.array(
        F.struct(
            F.lit(COUNT).alias("kind"), F.concat(category, F.lit("_"), value, F.lit(postfix)).alias("feature"),
            F.col("sold_qty").cast("double").alias("number"), (value != "").alias("used"),
        ),
        F.struct(
            F.lit(SHARE).alias("kind"), F.concat(value, F.lit("_SOW_by_"), category).alias("feature"),
            share.alias("number"), (category != TAG).alias("used"),
        ),
    )
    rows = values.where(value.isNotNull()).select(key, "complete", "category", F.inline(both))
    return rows.where("used").select(key, "complete", "category", "kind", "feature", F.col("number").alias("value"))


def feature_dictionary(features: DataFrame) -> DataFrame:
    """(position, feature, category, kind) of all features, by category, kind and name.

    Sorted in ranges; positions count on from range to range, and only the ranges' sizes meet.
    """
    order = ["category", "kind", "feature"]
    ranged = features.select(*order).distinct().repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = materialise(ranged.withColumn("place", F.monotonically_increasing_id()), "feature-order")
    part = F.shiftright("place", 33).alias("part")
    sizes = ranged.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    return ranged.withColumn("part", part).join(sizes, "part").select(
        (F.col("before") + F.expr("place & 8589934591L")).alias("position"), "feature", "category", "kind"
    )


def sparse_vectors(features: DataFrame, dictionary: DataFrame, key: str = CUSTOMER) -> DataFrame:
    """(key, positions, values): every complete customer's non-zero features, ascending, by one aggregate."""
    placed = features.where("complete AND value != 0").join(dictionary, ["category", "kind", "feature"])
    entry = F.struct("position", "value")
    found = placed.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    return found.select(key, F.col("entries.position").alias("positions"), F.col("entries.value").alias("values"))


def feature_zero_share(features: DataFrame, key: str = CUSTOMER) -> DataFrame:
    """(feature, zero_share) over the complete customers; null counts as zero and absent features do too."""
    # The number of complete customers is one number, read back with every feature.
    customers = features.where("complete").select(key).distinct().count()
    filled = F.count(F.when(F.col("complete") & (F.col("value") != 0), 1))
    counted = features.groupBy("feature").agg(filled.alias("filled"))
    return counted.select("feature", ((F.lit(customers) - F.col("filled")) / F.lit(float(max(customers, 1)))).alias("zero_share"))


def wide_features(
    features: DataFrame, names: Sequence[str], excluded_ids: Sequence[str] = (), key: str = CUSTOMER
) -> DataFrame:
    """The named features of the complete customers as columns, 0 where they have none; counts stay whole.

    One pivot for all of them, whatever categories they are of. A customer without any of them has a row
    of zeros. Many narrow rows move to their customer before they become columns: a plain pivot would shuffle
    one wide, mostly empty row for nearly each of them.
    """
    rows = features.where("complete")
    if excluded_ids:
        rows = rows.where(~F.col(key).isin(*excluded_ids))
    if not names:
        return rows.select(key).distinct()
    # Names stand for themselves by place, as they may hold any character.
    places = {feature: i for i, feature in enumerate(names)}
    chosen = F.when(F.col("feature").isin(list(names)), F.col("feature"))
    narrow = rows.select(key, chosen.alias("feature"), F.when(chosen.isNotNull(), F.col("value")).alias("value"))
    about = features.count()
    # Few rows stay where they are: the order of their result is where k-means starts from.
    moved = _moved_to(narrow, key, about) if about > ROWS_PER_TASK else narrow
    wide = moved.groupBy(key).pivot("feature", list(places)).agg(F.first("value", ignorenulls=True))
    return wide.toDF(key, *names).na.fill(0.0)


def wide_counts(values: DataFrame, category: str, names: Sequence[str], postfix: str = "_qty", key: str = CUSTOMER) -> DataFrame:
    """Quantities of a category's values as columns; customers with only blank values are not listed."""
    rows = values.where((F.col("category") == category) & (F.col("value") != ""))
    if not names:
        return rows.select(key).distinct()
    wide = rows.repartition(key).groupBy(key).pivot("value", list(names)).agg(F.first("sold_qty")).na.fill(0)
    return wide.toDF(key, *[f"{category}_{v}{postfix}" for v in names])


def wide_shares(values: DataFrame, category: str, names: Sequence[str], key: str = CUSTOMER) -> DataFrame:
    """Shares of wallet of a category's values as columns; null for a customer whose amounts add up to zero."""
    rows = values.where(F.col("category") == category)
    if not names:
        return rows.select(key).distinct()
    wide = rows.repartition(key).groupBy(key, F.col("total").cast("double").alias("__total")).pivot("value", list(names)).agg(F.first("net_amt_hkd"))
    shares = [
        f"try_divide(coalesce(cast({quoted(v)} as double), 0D), __total) * 100 AS {quoted(f'{v}_SOW_by_{category}')}" for v in names
    ]
    return wide.selectExpr(key, *shares)
