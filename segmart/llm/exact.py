"""Exact duplicates: 128-bit content hash, then the bytes themselves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmart.llm.common import columns_as, free_name, materialise, named

# The normal form drops these characters; everything else counts.
_SPACE = r"[\x20\x09-\x0D]+"


def normal_form(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), _SPACE, "")


def exact_groups(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    content_hash: Callable[[Column], Column] = F.md5,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, n_chars.

    Texts are equal when their normal forms are. Of equal texts the row with the most code points in
    its original text stays, then the one with the smallest id. A null text counts as empty, and all
    empty texts are one group. A row without id gives way to rows with one; rows that tie in
    everything, such as a repeated row, are all marked as kept. An empty table gives no rows.

    Rows are grouped by ``content_hash`` on narrow columns, partial counts first, so a group of any
    size is a few rows by the time it is shuffled. Only texts whose hash occurs twice are then grouped
    by their bytes, which tells colliding texts apart; no group is ever gathered in one place, and the
    joins back to the rows are plain equi-joins that adaptive execution splits for hot keys.
    """
    source = columns_as(docs, doc_id=id_column, text=text_column)
    rows = source.select(
        "doc_id",
        normal_form(F.col("text")).alias("norm"),
        F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"),
    ).withColumn("content", content_hash(F.col("norm")))

    # The smallest of these is the row that stays.
    rank = F.struct((-F.col("n_chars")).alias("shortness"), F.col("doc_id").isNull().alias("nameless"), "doc_id")

    def counted(df: DataFrame, *keys: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("group_size"), F.min(rank).alias("best"))

    # Stored, and then shuffled as it is: adaptive execution splits hot keys only of joins whose both sides
    # come straight from a shuffle, not from an aggregate.
    shared = materialise(counted(rows, "content").withColumnRenamed("content", "group_content"), "exact-groups")
    alone = F.col("group_size") == 1
    sha = F.sha2("norm", 256).alias("text_sha256")

    single = (
        rows.select("doc_id", "n_chars", "content", sha)
        .join(shared.where(alone), F.col("content") == F.col("group_content"))
        .select("doc_id", "n_chars", "text_sha256", "group_size", "best")
    )
    suspects = rows.join(shared.where(~alone), F.col("content") == F.col("group_content"), "left_semi")
    # By the bytes alone: copies are combined before the shuffle, wherever the join has put them.
    same_bytes = materialise(counted(suspects, "norm"), "exact-bytes")
    several = suspects.join(same_bytes, "norm").select("doc_id", "n_chars", sha, "group_size", "best")

    best = F.col("best")
    return single.unionByName(several).select(
        "doc_id",
        best["doc_id"].alias("keep_id"),
        "group_size",
        (F.col("doc_id").eqNullSafe(best["doc_id"]) & (-F.col("n_chars") == best["shortness"])).alias("kept"),
        "text_sha256",
        "n_chars",
    )


def drop_exact_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; one row of each group of equal texts.

    Of rows that tie in everything, such as a repeated row, any one stays.
    """
    dropped = exact_groups(docs, id_column, text_column).where(~F.col("kept"))
    dropped_row = free_name(docs, "dropped_row")
    dropped = dropped.select(F.struct("doc_id", "text_sha256", "n_chars").alias(dropped_row))
    row = free_name(docs, "row")
    original = F.coalesce(named(text_column), F.lit(""))
    marked = docs.withColumn(
        row,
        F.struct(
            named(id_column).alias("doc_id"),
            F.sha2(normal_form(original), 256).alias("text_sha256"),
            F.char_length(original).cast("long").alias("n_chars"),
        ),
    )
    # Before the join, so that repetitions are combined before they are shuffled.
    marked = marked.dropDuplicates([row])
    # Structs compare field by field, null ids included.
    return marked.join(dropped, named(row) == named(dropped_row), "left_anti").drop(row)


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm
  FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, sha256(norm) AS text_sha256, n_chars
FROM d WINDOW w AS (PARTITION BY norm ORDER BY n_chars DESC, doc_id)
"""
