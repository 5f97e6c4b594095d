"""Connected components of links, by large and small stars over tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigtrace.operators.staging import stage


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is the smallest node it can reach.

    Nulls link nothing.  Each round moves every edge towards the smallest known
    neighbour, so the rounds grow with the logarithm of the longest chain.
    """
    edges = stage(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    while True:
        small = stage(_star(_star(edges, large=True), large=False))
        # a forest of stars: no node is a centre and a leaf at once, and each leaf has one centre
        if small.isEmpty() or _settled(small):
            break
        edges = small
    leaves = small.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaves.union(leaves.select("root", "root").distinct())


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links of each node to larger (or else smaller) neighbours, moved to its smallest neighbour."""
    if large:
        pairs = edges.select("u", "v").union(edges.select("v", "u")).toDF("u", "v")
    else:
        pairs = edges
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"))
    joined = pairs.join(least, F.col("u") == F.col("x"))
    if large:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("x", "m"))
    return moved.where("u > v").distinct()


def _settled(edges: DataFrame) -> bool:
    twice = edges.groupBy("u").count().where("count > 1")
    both = edges.select("u").join(edges.select(F.col("v").alias("u")), "u", "left_semi")
    return twice.isEmpty() and both.isEmpty()
