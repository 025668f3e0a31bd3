"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyglass.llm.common import keep_table


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b), a < b, root being the smallest node of its component.

    Each round: every node's larger neighbours move to its smallest neighbour (large
    star), then its smaller neighbours do (small star). Both steps keep components;
    the rounds, logarithmic in practice, end when the links are stars, that is when no
    node has two smaller neighbours and no centre has a smaller one. Minima are folded
    before the shuffle and a node with many links is split by the adaptive join; each
    round is a table in the shared folder.
    """
    edges = keep_table(links.select("a", "b").where("a < b").distinct(), "edges")       # a < b: a is the smaller end
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = (both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct())
        large = keep_table(large, "large-star")
        small_least = large.groupBy("b").agg(F.min("a").alias("m"), F.count("*").alias("n"))
        joined = large.join(small_least, "b")
        small = joined.select(F.col("m").alias("x"), F.col("a").alias("y")).unionAll(joined.select(F.col("m").alias("x"), F.col("b").alias("y")))
        edges = keep_table(small.where("x < y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "small-star")
        if _stars(edges):
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionAll(
                edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether each larger end occurs once and is never a smaller end."""
    ends = edges.select(F.col("b").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(
        edges.select(F.col("a").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up = 1 AND down = 1)").isEmpty()
