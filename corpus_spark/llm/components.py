"""Connected components by alternating large and small stars, each round a few joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_spark.llm.scratch import written


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of the links (a, b); the root is the smallest node of its component.

    Each round hangs nodes under smaller neighbours: first the larger neighbours of each node (large
    star), then the smaller ones and the node itself (small star). The rounds end when a round
    changes nothing; their number grows with the logarithm of the longest path. Links to oneself,
    repeated links and links in both directions are allowed. A node with many links is a group of a
    minimum, combined before the shuffle, and a join side that Spark can split; it is never one
    collected group. Every round is written to the shared folder. Nodes without links are not named.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges = written(edges, "stars")
    before = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before = now
        edges = written(_small_star(_large_star(edges)), "stars")


def _large_star(edges: DataFrame) -> DataFrame:
    """The larger neighbours of each node move to the smallest of its neighbours and itself."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """The smaller neighbours of each node, and the node, move to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return moved.filter("u <> v").unionByName(own).distinct()
