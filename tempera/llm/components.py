"""Connected components of a large graph, by alternating star contractions.

Every round points each node's larger neighbours, then its smaller ones, at the least node it knows.
Only minima are aggregated (with a map-side combine) and joined back. Where a hub's edges are a large partition of
that join, Spark's adaptive execution splits it, as an inner join allows; each round is written to the shared folder, which keeps the lineage
short, and rounds grow with the logarithm of the longest path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempera.llm.common import drop_written, written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` (its least node) for every node of ``edges`` (a, b; any order, repeats,
    loops and nulls are ignored)."""
    current = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current = written(current, "edges")
    seen = None
    while True:
        digest = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(digest) == seen or digest[0] == 0:
            break
        seen = tuple(digest)
        after = written(_small_star(_large_star(current)), "edges")
        drop_written(current)
        current = after
    roots = current.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
