"""Segments of customers: labels, the override rule and their join to sales lines."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmart.constants import OVERRIDE_FROM, OVERRIDE_TO, PERSONA_LABELS
from segmart.functions.columns import relabel
from segmart.operators.encode import CUSTOMER
from segmart.operators.skew import lookup_join

SEGMENT = "customer_tag"


def label_persona(persona: DataFrame, labels: Mapping[int, str] = PERSONA_LABELS) -> DataFrame:
    """Cluster ids replaced by their labels; an id without a label becomes null."""
    label = relabel(F.col("persona"), labels, F.lit(None).cast("string"))
    return persona.select(CUSTOMER, label.alias("persona"))


def override_segment(
    lines: DataFrame,
    personas: DataFrame,
    listed_brands: Sequence[str],
    moved_from: str = OVERRIDE_FROM,
    moved_to: str = OVERRIDE_TO,
) -> DataFrame:
    """Segment per customer: the persona, or ``moved_to`` for those of ``moved_from`` who bought
    exactly one of the listed brands.

    Decided per customer from one aggregate; the lines themselves are not joined.
    """
    one_brand = (
        lines.where(F.col("prod_brand").isin(*listed_brands))
        .groupBy(CUSTOMER)
        .agg(F.count_distinct("prod_brand").alias("__brands"))
        .where("__brands = 1")
    )
    moves = F.col("__brands").isNotNull() & (F.col("persona") == moved_from)
    return (
        personas.where(F.col(CUSTOMER).isNotNull())
        .distinct()
        .join(one_brand, CUSTOMER, "left")
        .select(CUSTOMER, "persona", F.when(moves, F.lit(moved_to)).otherwise(F.col("persona")).alias(SEGMENT))
    )


def attach_segments(lines: DataFrame, segments: DataFrame, hot: Mapping[int, int] | None = None) -> DataFrame:
    """Sales lines with persona and segment; customers without one vanish."""
    return lookup_join(lines, segments, [CUSTOMER], "inner", hot)
