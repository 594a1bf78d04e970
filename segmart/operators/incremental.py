"""Tables that deltas are folded into: only the partitions that a delta touches are read and written again.

A state keeps one summary for each key, spread over a fixed number of partitions by a hash of the key. What
a key keeps is decided by a merge that gives the same rows whatever the order and number of the deliveries, so
late rows count, a delta that comes twice changes nothing, and a fold that failed half way is simply repeated.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmart.functions.columns import lenient_cast, named, trim_strings
from segmart.operators.lines import card_masters
from segmart.operators.snapshot import latest_snapshot
from segmart.session import materialise
from segmart.sources import catalog

PART = "state_part"
Merge = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class State:
    """A catalog table of merged rows. ``merge`` maps rows of the table's columns to what their keys keep."""

    table: str
    keys: tuple[str, ...]
    merge: Merge
    parts: int = 256


def create(state: State, base: DataFrame, path: str | None = None) -> DataFrame:
    """Write the merged ``base`` as the state and return it; an existing table is an error."""
    rows = _in_parts(state, state.merge(base))
    catalog.write_table(rows, state.table, partition_by=[PART], path=path, overwrite=False)
    return read(base.sparkSession, state)


def fold(state: State, delta: DataFrame) -> DataFrame:
    """Merge ``delta`` into the state and return it.

    The delta is merged by itself first, so a much-used key is one summary before it meets the state. The driver
    sees the numbers of the touched partitions, at most ``parts``. The new partitions are stored before the old
    ones are replaced: a lost executor or driver leaves rows from which the same fold gives the same state.
    """
    spark = delta.sparkSession
    news = materialise(_with_part(state, state.merge(delta)), "delta")
    touched = [row[PART] for row in news.select(PART).distinct().collect()]
    if touched:
        held = spark.table(state.table).where(F.col(PART).isin(touched))
        merged = state.merge(held.drop(PART).unionByName(news.drop(PART)))
        stored = materialise(_with_part(state, merged), "folded")
        catalog.overwrite_partitions(stored.hint("rebalance", PART), state.table)
    return read(spark, state)


def read(spark: SparkSession, state: State) -> DataFrame:
    return spark.table(state.table).drop(PART)


def _with_part(state: State, df: DataFrame) -> DataFrame:
    part = F.pmod(F.xxhash64(*[named(key) for key in state.keys]), F.lit(state.parts)).cast("int")
    return df.withColumn(PART, part)


def _in_parts(state: State, df: DataFrame) -> DataFrame:
    """One write task for each partition, several for one that is much larger than the others."""
    return _with_part(state, df).hint("rebalance", PART)


def newest_rows(keys: Sequence[str], ts: str) -> Merge:
    """All different rows with their key's greatest ``ts``; rows without key or ``ts`` go."""
    return lambda df: latest_snapshot(df, keys, ts).distinct()


def first_dates(sales: DataFrame, brand: str) -> DataFrame:
    """(vip_no, first_date) of the lines of one shop brand: what a delta of lines adds to the cards' state.

    Lines without a card are one card of their own, a line without a date counts as no purchase but its card is known.
    """
    lines = trim_strings(sales.select("sales_date", "shop_brand", "vip_no")).where(F.col("shop_brand") == brand)
    return lines.select("vip_no", lenient_cast(lines, "sales_date", "date").alias("first_date"))


def earliest_by_card(df: DataFrame) -> DataFrame:
    return df.groupBy("vip_no").agg(F.min("first_date").alias("first_date"))


def first_purchase_of(dates: DataFrame, cards: DataFrame) -> DataFrame:
    """First purchase per customer from the cards' state.

    The state holds cards, not customers, so that a card which moves to another customer needs no rewrite.
    """
    return (
        dates.join(card_masters(cards), "vip_no", "left")
        .groupBy(F.coalesce("vip_main_no", "vip_no").alias("vip_main_no"))
        .agg(F.min("first_date").alias("first_purchase_date"))
    )
