"""Connected components of an edge table, by alternating star contractions.

Every step is a grouped minimum (combined before the shuffle) and one join on the node,
so no component is ever gathered. Steps are written to the shared folder: lineage stays
short, and a join between two written tables lets Spark split the rows of a hot node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node is tied once, to one that is not tied itself."""
    tied = edges.groupBy("a").agg(F.count("*").alias("ties"))
    ends = edges.select(F.col("b").alias("end")).distinct()
    return tied.join(ends, tied.a == ends.end, "left").where("ties > 1 or end is not null").isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    """Tie every larger neighbour of a node to the least node around it."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = settle(both.groupBy("a").agg(F.min("b").alias("m"))
                   .select("a", F.least("a", "m").alias("m")))
    return (both.join(least, "a").where("b > a and b != m")
            .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Tie a node and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = settle(down.groupBy("a").agg(F.min("b").alias("m")))
    return (down.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(least.select("a", F.col("m").alias("b"))).distinct())


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable, for each node that has an edge.

    ``edges`` has two columns of integers; loops and NULL ends are ignored, repeats and
    both directions of an edge count once. No edges: no rows.
    """
    left, right = edges.columns
    now = settle(edges.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b"))
                 .where("a > b").distinct())
    while not _are_stars(now):
        now = settle(_small_star(settle(_large_star(now))))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
