"""Distributed connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremora.operators.lineage import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges(a, b); component is the smallest node that can be reached.

    Loops and rows with a null end are left out; repeated edges count once; no edges give no rows. Minima are
    aggregated before the shuffle, and the joins on a hub's id are plain sort-merge joins, which adaptive execution
    splits. Only counts come to the driver; each round is cut off in the shared checkpoint folder.
    """
    a, b = F.greatest("a", "b"), F.least("a", "b")
    proper = edges.where(F.col("a") != F.col("b"))
    stars = cut(proper.select(a.alias("a"), b.alias("b")).distinct())
    while not _settled(stars):
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where(F.col("a") != F.col("b")).distinct()
        first = large.groupBy("a").agg(F.min("b").alias("m"))
        inner = large.join(first, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        stars = cut(inner.unionByName(first.select("a", F.col("m").alias("b"))).distinct())
    leaves = stars.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return leaves.unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _settled(stars: DataFrame) -> bool:
    """Whether every node hangs on one root, which hangs on none."""
    twice = stars.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a")
    hanging = stars.select(F.col("b").alias("a")).distinct().join(stars.select("a"), "a", "left_semi")
    return twice.unionByName(hanging).isEmpty()
