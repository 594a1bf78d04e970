"""Latest version of each key in a history table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_snapshot(df: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """All rows carrying their key's greatest ``ts``: ties stay, rows without key or ``ts`` go.

    The maximum is combined before the shuffle, and the join hashes on key and ``ts`` together,
    so a key with a very long history is spread over its versions.
    """
    keys = list(keys)
    newest = df.groupBy(*keys).agg(F.max(ts).alias(ts))
    return df.join(newest, [*keys, ts], "left_semi")
