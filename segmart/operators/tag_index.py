"""Keyword tags by an index of letter groups, for rule sets of any size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segmart.session import materialise

GRAM = 3


def rule_table(
    spark: SparkSession, rules: Mapping[str, Sequence[str]], lower_keywords: bool = False
) -> DataFrame:
    """(place, keyword, tag) of rules given as tag -> keywords, in their order; tags in capitals."""
    flat = [(tag.upper(), keyword) for tag, keywords in rules.items() for keyword in keywords]
    rows = [(i, keyword.lower() if lower_keywords else keyword, tag) for i, (tag, keyword) in enumerate(flat)]
    return spark.createDataFrame(rows, "place long, keyword string, tag string")


def _grams(text: Column, size: Column) -> Column:
    """Distinct groups of ``size`` consecutive characters; one empty group for size 0."""
    last = F.char_length(text) - size + 1
    every = F.transform(
        F.when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<int>")),
        lambda i: F.substring(text, i, size),
    )
    return F.array_distinct(F.when(size == 0, F.array(F.lit(""))).otherwise(every))


def tags_by_index(descriptions: DataFrame, rules: DataFrame, distinct_tags: bool = False) -> DataFrame:
    """(item_desc, tags) for every distinct ``item_desc``: tags whose keyword is part of it in lower case.

    ``rules`` has place, keyword and tag; tags come in the order of places, once for each matching keyword
    unless ``distinct_tags``. Null keywords match nothing and empty ones everything; no description gives no tags.

    Every keyword is looked up by its rarest group of three letters (all of it, if it is shorter), found
    from counts over the descriptions. Descriptions meet the keywords of their groups in an equi-join, and
    only those pairs are tested. A group that many descriptions share is chosen only by keywords that
    have no rarer one; adaptive execution splits its partition.
    """
    texts = materialise(descriptions.select("item_desc").distinct(), "tag-texts")
    rules = materialise(rules.where("keyword IS NOT NULL").select("place", "keyword", "tag"), "tag-rules")
    size = F.least(F.char_length("keyword"), F.lit(GRAM))
    groups = rules.select("place", "keyword", "tag", F.explode(_grams(F.col("keyword"), size)).alias("gram"))
    # At most four sizes occur: one row of the rules' own lengths.
    sizes = [row[0] for row in rules.select(size.alias("size")).distinct().collect()]
    lowered = F.lower("item_desc")
    parts = F.flatten(F.array(*[_grams(lowered, F.lit(s)) for s in sorted(sizes)])) if sizes else F.array().cast("array<string>")
    shown = texts.where("item_desc IS NOT NULL").select("item_desc", F.explode(parts).alias("gram"))
    counts = materialise(shown.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "tag-grams")
    # A keyword with a group that no description has is in none of them.
    rated = groups.join(counts.withColumnRenamed("gram", "of_gram"), F.col("gram") == F.col("of_gram"), "left")
    rated = rated.groupBy("place", "keyword", "tag").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("best"))
    rarest = materialise(rated.where("best.n > 0").select("place", "keyword", "tag", F.col("best.gram").alias("gram")), "tag-rarest")
    used = shown.join(rarest, "gram").where(F.contains(lowered, F.col("keyword")))
    found = used.groupBy("item_desc").agg(F.array_sort(F.collect_list(F.struct("place", "tag"))).alias("hits"))
    tags = F.coalesce(F.col("hits.tag"), F.array().cast("array<string>"))
    return texts.join(found.withColumnRenamed("item_desc", "of_desc"), F.col("item_desc") == F.col("of_desc"), "left").select(
        "item_desc", (F.array_distinct(tags) if distinct_tags else tags).alias("tags")
    )
