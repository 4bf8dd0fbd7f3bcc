"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.llm.common import stage, unstage


def large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the node's least neighbour (or itself)."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    linked = both.join(least, "u").where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return stage(linked.distinct(), "large-star")


def small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return stage(linked.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")


def all_stars(edges: DataFrame) -> bool:
    """Whether every node has one edge, to a node that has none of its own."""
    twice = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("u")
    return twice.unionByName(edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").select("u")).isEmpty()


def connected_components(edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(node, component): for each node with an edge to another, the least node that it is connected with.

    edges: (u, v) of longs; known: an earlier result, which the edges add to. Each step sends an edge to one other
    place, and the steps repeat until every component is a star around its least node. The edges of a hub meet for one
    aggregate (combined before the shuffle) and one join, whose large partitions Spark splits; no row holds them all.
    """
    edges = edges.select("u", "v").where("u != v")
    if known is not None:
        edges = edges.unionByName(known.select(F.col("node").alias("u"), F.col("component").alias("v")))
    edges, own = stage(edges.distinct(), "component-edges"), None
    while own is None or not all_stars(edges):
        wide = large_star(edges)
        own = small_star(wide)
        unstage(edges, wide)
        edges = own
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
