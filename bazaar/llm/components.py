"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaar.llm.scratch import stage


def _towards_minimum(edges: DataFrame) -> DataFrame:
    """One round of large-star and small-star: every node is linked to the
    smallest node around it instead of to its neighbours. Minima are
    pre-aggregated on the map side, so a node with very many links is no hot
    key in the aggregation."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(
        F.col("u").alias("_u"), F.least("u", "m").alias("m"))
    large = both.where("v > u").join(least, F.col("u") == F.col("_u")).select(
        F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    # large: u > v everywhere, or the pair of a node with itself is gone.
    low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), "m")
    joined = large.join(low, F.col("u") == F.col("_u"))
    small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
        joined.select("u", F.col("m").alias("v")))
    return small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node that has an edge to another one;
    component is the smallest node it reaches. Rounds go through staged
    tables until the edges no longer change."""
    now = stage(edges.where(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    print_of = None
    while True:
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if tuple(seen) == print_of or not seen["n"]:
            break
        print_of = tuple(seen)
        now = stage(_towards_minimum(now), "edges")
    # Now every node has one edge, to the minimum of its component.
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
