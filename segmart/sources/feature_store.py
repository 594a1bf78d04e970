"""A folder of feature tables with a manifest: name, key, schema and version of every table.

Scans take what the manifest lists, never what a directory happens to hold. A version is written once: its
rows first, then its line in the manifest, so that a write which failed is not seen. Both are errors if they
exist, hence of two writers of one version one fails.
"""

from __future__ import annotations

import fnmatch
import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from segmart.functions.columns import named

MANIFEST_COLUMNS = "name string, version int, feature_key string, schema string, path string"


@dataclass(frozen=True)
class Entry:
    name: str
    version: int
    key: str
    schema: T.StructType
    path: str


def write_feature_table(df: DataFrame, folder: str, name: str, key: str) -> Entry:
    """Store ``df`` as the next version of ``name``; its rows carry ``key``."""
    if key not in df.columns:
        raise ValueError(f"{name} has no column {key}")
    spark = df.sparkSession
    version = 1 + max((e.version for e in _entries(spark, folder) if e.name == name), default=0)
    # Parquet gives every column back as nullable.
    schema = T.StructType([T.StructField(field.name, field.dataType) for field in df.schema.fields])
    entry = Entry(name, version, key, schema, f"{folder}/tables/{name}/v{version}.parquet")
    df.write.mode("errorifexists").parquet(entry.path)
    line = [(name, version, key, schema.json(), entry.path)]
    spark.createDataFrame(line, MANIFEST_COLUMNS).coalesce(1).write.mode("errorifexists").json(
        f"{folder}/manifest/{name}/v{version}"
    )
    return entry


def manifest(
    spark: SparkSession, folder: str, include: Sequence[str] = ("*",), exclude: Sequence[str] = ()
) -> list[Entry]:
    """The newest version of every table whose name one of ``include`` matches and none of ``exclude``, by name.

    One small line a version, so its size follows the number of tables, not that of rows.
    """
    newest: dict[str, Entry] = {}
    for entry in _entries(spark, folder):
        chosen = any(fnmatch.fnmatchcase(entry.name, rule) for rule in include)
        if chosen and not any(fnmatch.fnmatchcase(entry.name, rule) for rule in exclude):
            if entry.name not in newest or newest[entry.name].version < entry.version:
                newest[entry.name] = entry
    return [newest[name] for name in sorted(newest)]


def pinned(entries: Sequence[Entry]) -> dict[str, int]:
    """Names and versions, to be kept with a model that was fitted on these tables."""
    return {entry.name: entry.version for entry in entries}


def pinned_entries(spark: SparkSession, folder: str, versions: Mapping[str, int]) -> list[Entry]:
    """Exactly the given versions, by name; a missing one is an error."""
    listed = {(entry.name, entry.version): entry for entry in _entries(spark, folder)}
    missing = sorted(pair for pair in versions.items() if pair not in listed)
    if missing:
        raise ValueError(f"not in the manifest: {missing}")
    return [listed[pair] for pair in sorted(versions.items())]


def read_entry(spark: SparkSession, entry: Entry) -> DataFrame:
    """The table of ``entry``; files with another schema than the manifest's are refused."""
    found = spark.read.parquet(entry.path)
    stored = {field.name: field.dataType for field in found.schema.fields}
    listed = {field.name: field.dataType for field in entry.schema.fields}
    if stored != listed:
        changed = sorted(name for name in stored.keys() | listed.keys() if stored.get(name) != listed.get(name))
        raise ValueError(f"{entry.name} v{entry.version} has another schema than its manifest: {changed}")
    return found.select(*[named(name) for name in listed])


def read_features(spark: SparkSession, entries: Sequence[Entry]) -> DataFrame:
    """All tables side by side by their common key, with every key that any of them has.

    A column that two tables have would be ambiguous and is an error, as are different keys.
    """
    if not entries:
        raise ValueError("no feature table is listed")
    keys = {entry.key for entry in entries}
    if len(keys) > 1:
        raise ValueError(f"feature tables have different keys: {sorted(keys)}")
    key = keys.pop()
    seen: set[str] = set()
    for entry in entries:
        names = {field.name.lower() for field in entry.schema.fields} - {key.lower()}
        if names & seen:
            raise ValueError(f"{entry.name} repeats columns {sorted(names & seen)}")
        seen |= names
    tables = [read_entry(spark, entry) for entry in entries]
    joined = tables[0]
    for table in tables[1:]:
        joined = joined.join(table, key, "full_outer")
    return joined


def _entries(spark: SparkSession, folder: str) -> list[Entry]:
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest")
    if not root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(root):
        return []
    lines = spark.read.schema(MANIFEST_COLUMNS).option("recursiveFileLookup", True).json(f"{folder}/manifest")
    return [
        Entry(row["name"], row["version"], row["feature_key"], T.StructType.fromJson(json.loads(row["schema"])), row["path"])
        for row in lines.orderBy("name", "version").collect()
    ]
