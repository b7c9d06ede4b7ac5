"""Connected components of a distributed edge list by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchspark.llm.common import staged


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("_m")).select(F.col("a").alias("_n"), F.least("a", "_m").alias("_m"))
    return both.where(F.col("b") > F.col("a")).join(least, F.col("a") == F.col("_n")).select(
        F.col("b").alias("a"), F.col("_m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, is linked to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("_m")).withColumnRenamed("a", "_n")
    met = edges.join(least, F.col("a") == F.col("_n")).where(F.col("b") > F.col("_m"))
    return met.select(F.col("b").alias("a"), F.col("_m").alias("b")).unionByName(
        least.select(F.col("_n").alias("a"), F.col("_m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (a, b); root is the smallest node reachable.

    Repeated edges, loops and either direction are fine, edges with a null end are not
    used; no edges give no rows. Only the number of changes comes to the driver; the
    rounds, some log of the longest path, are cut from each other by staged tables, and no
    task sees all the neighbours of a node.
    """
    edges = edges.where(F.col("a") != F.col("b"))
    now = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == tuple(mark):
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        state = tuple(mark)
        now = staged(_small_star(_large_star(now)), "edges")
