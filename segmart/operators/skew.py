"""Joins of large tables whose keys may be very unevenly spread.

A key may hold a third of all rows. Plain joins leave it to adaptive execution to broadcast a small
side and to split hot partitions; the others spread known hot keys over several tasks.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmart.functions.columns import named

ROWS_PER_TASK = 4_000_000

FANOUT = "__fanout"
_HASH, _SALT = "__key_hash", "__salt"


def key_hash(keys: Sequence[str]) -> Column:
    return F.xxhash64(*[named(key) for key in keys])


def hot_keys(
    df: DataFrame, key_sets: Mapping[str, Sequence[str]], rows_per_task: int | None = None
) -> dict[str, dict[int, int]]:
    """For every key set: hash of each key above ``rows_per_task`` rows -> tasks to spread it over.

    One exact, column-pruned count for all key sets, combined before its shuffle. A key gets in only
    with more than ``rows_per_task`` rows, so there are at most (rows / rows_per_task) of them.
    """
    rows_per_task = rows_per_task or ROWS_PER_TASK
    hashed = F.array(
        *[F.struct(F.lit(name).alias("name"), key_hash(keys).alias("key")) for name, keys in key_sets.items()]
    )
    counted = df.select(F.explode(hashed).alias("of")).groupBy("of.name", "of.key").agg(F.count(F.lit(1)).alias("n"))
    found: dict[str, dict[int, int]] = {name: {} for name in key_sets}
    for row in counted.where(F.col("n") > rows_per_task).collect():
        found[row["name"]][row["key"]] = math.ceil(row["n"] / rows_per_task)
    return found


def salted_join(
    facts: DataFrame, lookup: DataFrame, on: Sequence[str], how: str, hot: Mapping[int, int]
) -> DataFrame:
    """Equi-join in which each hot key of ``facts`` is spread over several tasks.

    ``hot`` comes from ``hot_keys``. Without hot keys this is a plain join.
    """
    if not hot:
        return facts.join(lookup, list(on), how)
    types = {field.name: field.dataType for field in facts.schema.fields}
    lookup = lookup.withColumns({key: named(key).cast(types[key]) for key in on}).withColumn(_HASH, key_hash(on))
    fanout = facts.sparkSession.createDataFrame(list(hot.items()), f"{_HASH} long, {FANOUT} int")
    with_fanout = lookup.join(F.broadcast(fanout), _HASH, "left").drop(_HASH)
    return spread_join(facts.withColumn(_HASH, key_hash(on)), with_fanout, on, how, fanout, [_HASH]).drop(_HASH)


def spread_join(
    facts: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    how: str,
    fanout: DataFrame,
    fanout_on: Sequence[str],
    spread_by: Sequence[str] | None = None,
) -> DataFrame:
    """Equi-join spread by a ``FANOUT`` column: the number of tasks for a key, 1 or null for most.

    ``lookup`` carries it and ``fanout`` lists it for the hot keys of ``facts``. That list is
    broadcast, and bounded: a key gets in only with more than ``ROWS_PER_TASK`` rows, so it has at
    most (rows / ROWS_PER_TASK) of them. The salt is a hash of the whole row, or of the columns
    ``spread_by`` where they tell the rows of a key apart, hence the same when a lost task is run
    again; only the lookup rows of hot keys are repeated.
    """
    row_hash = F.xxhash64(*[named(c) for c in spread_by or facts.columns])
    salt = F.when(named(FANOUT).isNotNull(), F.pmod(row_hash, named(FANOUT)).cast("int")).otherwise(F.lit(0))
    spread = facts.join(F.broadcast(fanout), list(fanout_on), "left").withColumn(_SALT, salt).drop(FANOUT)
    salts = F.sequence(F.lit(0), F.coalesce(named(FANOUT), F.lit(1)) - 1)
    repeated = lookup.withColumn(_SALT, F.explode(salts)).drop(FANOUT)
    return spread.join(repeated, [*on, _SALT], how).drop(_SALT)


def lookup_join(
    facts: DataFrame, lookup: DataFrame, on: Sequence[str], how: str = "left", hot: Mapping[int, int] | None = None
) -> DataFrame:
    """Join ``facts`` with a lookup table; runs nothing by itself.

    Adaptive execution knows the size of the lookup when it is there: below the broadcast threshold it
    is broadcast, above it the partitions of hot keys are split. With hot keys that ``hot_keys`` found
    before, the join is salted for them instead.
    """
    return salted_join(facts, lookup, on, how, hot or {})
