"""Order-free comparison of a query result with its SQL counterpart."""

from __future__ import annotations

import math

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]
TABLES += ["documents", "pages", "labels", "conversations", "embeddings"]


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return connection


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, float):
        return repr(round(value, 6) + 0.0)
    return repr(value)


def _rows(columns: list[str], rows: list) -> list:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def difference(df, connection: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when columns and values agree, else what does not."""
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    expected = _rows(names, result.fetchall())
    found = _rows(df.columns, [tuple(row) for row in df.collect()])
    if expected == found:
        return None
    missing = [row for row in expected if row not in set(found)][:3]
    extra = [row for row in found if row not in set(expected)][:3]
    return f"{len(found)} rows against {len(expected)}; only in SQL {missing}; only here {extra}"
