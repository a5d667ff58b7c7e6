"""Directed graphs as edge tables: multigraph and simple views, vertices, degrees, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ExtractConfig
from ..functions.links import with_links
from .order import numbered


def multigraph(pages: DataFrame, config: ExtractConfig = ExtractConfig()) -> DataFrame:
    """(src, dst) of each page's links; a page that is listed twice gives its edges twice, one without links none."""
    return with_links(pages.where("coalesce(url, '') <> ''"), config).select(F.col("url").alias("src"), F.explode("links").alias("dst"))


def simple(edges: DataFrame) -> DataFrame:
    """Distinct edges; loops stay."""
    return edges.select("src", "dst").distinct()


def vertices(edges: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """(id): sources, targets and declared vertices (id)."""
    ids = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    return (ids if declared is None else ids.union(declared.select("id"))).distinct()


def out_degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_degree"))


def in_degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree"))


def degrees(edges: DataFrame) -> DataFrame:
    """(id, out_degree, in_degree) of every vertex of distinct edges, in one aggregation.

    Each edge counts once for its source and once for its target, so partial sums
    leave the map side and the edges are shuffled once, by vertex.
    """
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    ends = F.explode(F.array(F.struct(F.col("src").alias("id"), one.alias("o"), none.alias("i")), F.struct(F.col("dst").alias("id"), none.alias("o"), one.alias("i"))))
    return edges.select(ends.alias("e")).groupBy(F.col("e.id").alias("id")).agg(F.sum("e.o").alias("out_degree"), F.sum("e.i").alias("in_degree"))


def adjacency(edges: DataFrame) -> DataFrame:
    """(source, targets), targets in order of name; repeated edges repeat."""
    return edges.groupBy(F.col("src").alias("source")).agg(F.array_sort(F.collect_list("dst")).alias("targets"))


def from_adjacency(lists: DataFrame) -> DataFrame:
    return lists.select(F.col("source").alias("src"), F.explode("targets").alias("dst"))


def multigraph_stats(edges: DataFrame) -> DataFrame:
    """One row: sources, edges with repeats, edges per source."""
    counted = edges.groupBy("src").agg(F.count("*").alias("n")).agg(F.count("*").alias("sources"), F.coalesce(F.sum("n"), F.lit(0)).alias("edges"))
    return counted.select("sources", "edges", F.when(F.col("sources") > 0, F.col("edges") / F.col("sources")).otherwise(0.0).alias("avg_out_degree"))


def graph_stats(edges: DataFrame) -> DataFrame:
    """One row about the simple graph: nodes, edges, highest degrees, dangling nodes."""
    rows = degrees(simple(edges))
    none = F.lit(0).cast("long")
    return rows.agg(
        F.count("*").alias("nodes"),
        F.coalesce(F.sum("out_degree"), none).alias("edges"),
        F.coalesce(F.max("in_degree"), none).alias("max_in_degree"),
        F.coalesce(F.max("out_degree"), none).alias("max_out_degree"),
        F.count_if(F.col("out_degree") == 0).alias("dangling"),
    )


def vertex_ids(nodes: DataFrame) -> DataFrame:
    """(id, vid): dense numbers from 0 in order of id."""
    return numbered(nodes.select("id"), "vid", F.col("id"))
