"""Weakly connected components by alternating star contractions (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to the least of it and its neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the least of these; every edge has u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, left: str = "src", right: str = "dst") -> DataFrame:
    """(node, component) of every node that an edge joins to another; component is its least node.

    Logarithmically many rounds in practice; both steps aggregate before they
    shuffle and join on a node, so a hub's rows are dealt anew by adaptive
    execution. Only two sums of the edges reach the driver.
    """
    edges = edges.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, before = cut(edges), None
    while True:
        state = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if state == before or state[0] == 0:
            break
        before = state
        edges = cut(_small_star(_large_star(edges)))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def weak_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, component) of all ``nodes`` (id); a node without links to others is its own component."""
    found = connected_components(edges)
    return nodes.join(found, nodes["id"] == found["node"], "left").select("id", F.coalesce("component", "id").alias("component"))
