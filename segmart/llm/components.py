"""Connected components of a distributed edge table by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmart.llm.common import materialise


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node around it."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least")), "component-least")
    return (
        both.where(F.col("b") > F.col("a"))
        .join(least, "a")
        .select(F.col("b").alias("a"), F.col("least").alias("b"))
        .where(F.col("a") != F.col("b"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Link the smaller neighbours of a node, and itself, to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = materialise(down.groupBy("a").agg(F.min("b").alias("least")), "component-least")
    return (
        down.join(least, "a")
        .select(F.col("b").alias("a"), F.col("least").alias("b"))
        .unionByName(least.select("a", F.col("least").alias("b")))
        .where(F.col("a") != F.col("b"))
        .distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of ``edges`` (columns a, b of one orderable type, any direction).

    ``root`` is the smallest node of the component. Rounds end when the table of edges, stars by then,
    stays the same; their number grows with the logarithm of the nodes. Each round is written to the
    shared folder and read back, so a lost executor costs one round at most. A node with very many
    edges is aggregated before the shuffle; the minima are stored, so that the adaptive join can spread
    its rows. Self-links
    and null ends are ignored; no edges give no rows.
    """
    edges = materialise(
        edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL AND a != b").distinct(), "component-edges"
    )
    state = None
    while True:
        larger = materialise(_large_star(edges), "component-large")
        edges = materialise(_small_star(larger), "component-edges")
        # Exact in any order of the rows: their number and two combined hashes.
        found = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())
        if found == state:
            break
        state = found
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
