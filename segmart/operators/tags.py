"""Keyword tags of item descriptions and their join to sales."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmart.constants import TAG_KEYWORDS
from segmart.operators.skew import lookup_join
from segmart.operators.tag_index import rule_table, tags_by_index

ITEM_COLUMNS = ["item_desc", "maincat_desc", "item_subcat_desc"]


def tag_array(
    description: Column,
    rules: Mapping[str, Sequence[str]] = TAG_KEYWORDS,
    distinct_tags: bool = False,
    lower_keywords: bool = False,
) -> Column:
    """Upper-cased tags whose keyword is part of the lower-cased description.

    A tag appears once per matching keyword unless ``distinct_tags``; a keyword with capitals
    never matches unless ``lower_keywords``. No description gives an empty array.
    """
    text = F.lower(description)
    hits = [
        F.when(text.contains(keyword.lower() if lower_keywords else keyword), F.lit(tag.upper()))
        for tag, keywords in rules.items()
        for keyword in keywords
    ]
    tags = F.array_compact(F.array(*hits))
    return F.array_distinct(tags) if distinct_tags else tags


# Rules up to this number are inline expressions; more of them go through an index. Tags are the same.
INLINE_KEYWORDS = 200


def tag_items(
    lines: DataFrame,
    rules: Mapping[str, Sequence[str]] | DataFrame = TAG_KEYWORDS,
    distinct_tags: bool = False,
    inline_keywords: int = INLINE_KEYWORDS,
) -> DataFrame:
    """Tags of the distinct items of ``lines``.

    ``rules`` maps tags to keywords, or is a table of (place, keyword, tag) of any size.
    """
    items = lines.select(*ITEM_COLUMNS).distinct()
    if not isinstance(rules, DataFrame):
        if sum(map(len, rules.values())) <= inline_keywords:
            return items.withColumn("tags", tag_array(F.col("item_desc"), rules, distinct_tags))
        rules = rule_table(lines.sparkSession, rules)
    tags = tags_by_index(items, rules, distinct_tags).withColumnRenamed("item_desc", "of_desc")
    return items.join(tags, F.col("item_desc").eqNullSafe(F.col("of_desc"))).drop("of_desc")


def attach_tags(
    lines: DataFrame,
    item_tags: DataFrame,
    fan_out: bool = False,
    keep_untagged: bool = False,
    hot: Mapping[int, int] | None = None,
) -> DataFrame:
    """One row per line and tag, in column ``tags``.

    ``fan_out`` repeats a line for every category its description is listed in; otherwise the tags
    are taken once per description. ``keep_untagged`` keeps lines without a tag, with null.
    Pass lines already summed up per description where that is possible: the rows multiply here.
    """
    lookup = item_tags.select("item_desc", "tags")
    if not fan_out:
        lookup = lookup.distinct()
    joined = lookup_join(lines, lookup, ["item_desc"], "left", hot)
    explode = F.explode_outer if keep_untagged else F.explode
    return joined.withColumn("tags", explode("tags"))
