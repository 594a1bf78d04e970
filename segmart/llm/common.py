"""What the operators share: the word definition, tables by name and safe column names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segmart.functions.columns import named
from segmart.session import materialise

__all__ = ["SPACES", "LOWER", "columns_as", "crc32_sql", "free_name", "materialise", "named", "table", "text_or_empty"]

# Words are maximal runs of other characters; bytes.split() cuts at the same six.
SPACES = " \t\n\x0b\x0c\r"
# ASCII letters only; used on UTF-8 bytes.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_or_empty(name: str) -> Column:
    return F.coalesce(named(name).cast("string"), F.lit(""))


def columns_as(df: DataFrame, **names: str) -> DataFrame:
    """Only the named columns, under the operator's own names, whatever else the table carries."""
    return df.select(*[named(old).alias(new) for new, old in names.items()])


def free_name(df: DataFrame, wish: str) -> str:
    """``wish``, or a longer form of it that no column of ``df`` has."""
    taken = {name.lower() for name in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def crc32_sql(number: str) -> str:
    """Unsigned CRC-32 of a number in decimal, bit by bit, as SQL."""
    octet = "list_reduce([xor(crc, code)] || list_transform(range(8), lambda i: 0), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)))"
    codes = f"list_transform(string_split(cast({number} AS varchar), ''), lambda x: cast(ascii(x) AS bigint))"
    return f"xor(list_reduce([4294967295::bigint] || {codes}, lambda crc, code: {octet}), 4294967295)"
