"""Co-purchase matrices over product classes, with margins.

A customer's rows are first reduced to one per class, so pairs of sales lines never exist. The
margin is one more class, "All", that every customer holds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmart.constants import CROSS_CLASS_EXCLUDED
from segmart.functions.columns import named
from segmart.operators.encode import CUSTOMER, distinct_values
from segmart.operators.segment import SEGMENT

MARGIN = "All"


def _class_lines(lines: DataFrame, cls: str, excluded: Sequence[str]) -> DataFrame:
    # The exclusion is on the main category whatever the class; it drops unknown ones as well.
    return lines.where(~F.col("maincat_desc_cleaned").isin(*excluded) & named(cls).isNotNull())


def cross_class(
    lines: DataFrame,
    segments: DataFrame,
    cls: str = "maincat_desc_cleaned",
    excluded: Sequence[str] = CROSS_CLASS_EXCLUDED,
    tag: str = SEGMENT,
) -> DataFrame:
    """Customers per segment who bought both classes of a pair: (segment, class_x, class_y, customers).

    Customers with the same set of classes are counted together first; pairs are formed once per
    distinct set. A set holds at most every class.
    """
    held = _class_lines(lines, cls, excluded).select(CUSTOMER, named(cls).alias("class")).distinct()
    baskets = held.groupBy(CUSTOMER).agg(F.sort_array(F.collect_set("class")).alias("classes"))
    weighted = (
        baskets.join(segments.select(CUSTOMER, tag).distinct(), CUSTOMER)
        .groupBy(tag, "classes")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    with_margin = weighted.withColumn("classes", F.concat("classes", F.array(F.lit(MARGIN))))
    pairs = with_margin.select(tag, "n", "classes", F.explode("classes").alias("class_x")).select(
        tag, "n", "class_x", F.explode("classes").alias("class_y")
    )
    return pairs.groupBy(tag, "class_x", "class_y").agg(F.sum("n").alias("customers"))


def cross_class_sum(
    lines: DataFrame,
    segments: DataFrame,
    values: str = "sold_qty",
    cls: str = "maincat_desc_cleaned",
    excluded: Sequence[str] = CROSS_CLASS_EXCLUDED,
    tag: str = SEGMENT,
) -> DataFrame:
    """Sum of x + y, in whole numbers, over all pairs of a customer's lines: (segment, class_x, class_y, total).

    With n lines and sum s per customer and class, the pairs of classes a and b add up to
    n_b * s_a + n_a * s_b. The products are added up in the task that forms them.
    """
    per_class = (
        _class_lines(lines, cls, excluded)
        .groupBy(CUSTOMER, named(cls).alias("class"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(named(values).cast("long"), F.lit(0))).alias("s"))
    )
    entry = F.struct("class", "n", "s")
    profile = per_class.groupBy(CUSTOMER).agg(
        F.collect_list(entry).alias("entries"), F.sum("n").alias("n_all"), F.sum("s").alias("s_all")
    )
    margin = F.struct(F.lit(MARGIN).alias("class"), F.col("n_all").alias("n"), F.col("s_all").alias("s"))
    tagged = profile.join(segments.select(CUSTOMER, tag), CUSTOMER).select(
        tag, F.concat("entries", F.array(margin)).alias("entries")
    )
    pairs = tagged.select(tag, "entries", F.explode("entries").alias("x")).select(
        tag, "x", F.explode("entries").alias("y")
    )
    # Counts times sums of a very active customer do not fit a long.
    wide = {c: F.col(c).cast("decimal(19,0)") for c in ("x.n", "x.s", "y.n", "y.s")}
    product = wide["y.n"] * wide["x.s"] + wide["x.n"] * wide["y.s"]
    return pairs.groupBy(tag, F.col("x.class").alias("class_x"), F.col("y.class").alias("class_y")).agg(
        F.sum(product).cast("decimal(38,0)").alias("total")
    )


def as_matrix(long: DataFrame, segment: str, classes: Sequence[str], value: str, tag: str = SEGMENT) -> DataFrame:
    """One segment as a class x class table with 0 for missing pairs."""
    cells = [
        F.coalesce(F.sum(F.when(F.col("class_y") == F.lit(c), named(value))), F.lit(0)).alias(c)
        for c in [*classes, MARGIN]
    ]
    return long.where(named(tag) == segment).groupBy("class_x").agg(*cells)


def as_matrices(long: DataFrame, value: str, classes: Sequence[str] | None = None, tag: str = SEGMENT) -> DataFrame:
    """Every segment's class x class table, one below the other; columns for all classes that occur.

    Classes are a catalogue's, so their list is short; given ones save the query for it.
    """
    if classes is None:
        classes = [c for c in distinct_values(long, "class_y") if c != MARGIN]
    cells = [
        F.coalesce(F.sum(F.when(F.col("class_y") == F.lit(c), named(value))), F.lit(0)).alias(c)
        for c in [*classes, MARGIN]
    ]
    return long.groupBy(tag, "class_x").agg(*cells)
