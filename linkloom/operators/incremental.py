"""Graph growth: deltas between versions, dirty sets, warm and localised rank updates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import RankConfig
from . import graph as G
from .pagerank import Graph, Ranks, converge, fixed


@dataclass
class Delta:
    """What a version adds: source nodes, target nodes (id), edges (src, dst), earlier sources with new edges (id), and counts (one row)."""

    new_sources: DataFrame
    new_targets: DataFrame
    new_edges: DataFrame
    affected: DataFrame
    summary: DataFrame


def _except(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right, left.columns, "left_anti")


def _one(frame: DataFrame, name: str) -> DataFrame:
    return frame.agg(F.count("*").alias(name))


def _row(*counts: DataFrame) -> DataFrame:
    """One-row tables side by side."""
    out = counts[0]
    for more in counts[1:]:
        out = out.crossJoin(F.broadcast(more))
    return out


def delta(previous: DataFrame, new: DataFrame) -> Delta:
    """From two edge tables. added_* in the summary are differences of counts."""
    old, now = G.simple(previous), G.simple(new)
    old_nodes, now_nodes = G.vertices(old), G.vertices(now)
    old_sources = old.select(F.col("src").alias("id")).distinct()
    new_sources = _except(now.select(F.col("src").alias("id")).distinct(), old_sources)
    new_targets = _except(_except(now_nodes, old_nodes), new_sources)
    new_edges = _except(now, old)
    affected = new_edges.select(F.col("src").alias("id")).distinct().join(old_sources, "id", "left_semi")
    counts = _row(_one(old_nodes, "prev_node_count"), _one(now_nodes, "new_node_count"), _one(old, "prev_edge_count"), _one(now, "new_edge_count"))
    summary = counts.select("prev_node_count", "new_node_count", (F.col("new_node_count") - F.col("prev_node_count")).alias("added_nodes"), "prev_edge_count", "new_edge_count", (F.col("new_edge_count") - F.col("prev_edge_count")).alias("added_edges"))
    return Delta(new_sources, new_targets, new_edges, affected, summary)


def delta_of_graphs(previous: DataFrame, new: DataFrame, previous_nodes: DataFrame | None = None, new_nodes: DataFrame | None = None) -> Delta:
    """The variant for generated graphs: new nodes with out-links, new nodes with in-links (a node may be in both), and set differences as counts."""
    old, now = G.simple(previous), G.simple(new)
    old_nodes, now_nodes = previous_nodes or G.vertices(old), new_nodes or G.vertices(now)
    added = _except(now_nodes, old_nodes)
    new_sources = added.join(now.select(F.col("src").alias("id")).distinct(), "id", "left_semi")
    new_targets = added.join(now.select(F.col("dst").alias("id")).distinct(), "id", "left_semi")
    new_edges = _except(now, old)
    affected = new_edges.select(F.col("src").alias("id")).distinct().join(old_nodes, "id", "left_semi")
    summary = _row(_one(old_nodes, "prev_nodes"), _one(added, "new_nodes"), _one(old, "prev_edges"), _one(new_edges, "new_edges"))
    return Delta(new_sources, new_targets, new_edges, affected, summary)


def warm_start(nodes: DataFrame, previous: DataFrame) -> DataFrame:
    """(id, rank): earlier ranks (id, rank), 1/N for new vertices, divided by their total if positive."""
    n = _one(nodes, "n")
    before = previous.select(F.col("id").alias("old"), F.col("rank").alias("old_rank"))
    rows = nodes.select("id").join(before, F.col("id") == F.col("old"), "left").crossJoin(F.broadcast(n))
    rows = rows.select("id", F.coalesce("old_rank", 1 / F.col("n")).alias("rank"))
    total = rows.agg(F.sum("rank").alias("total"))
    return rows.crossJoin(F.broadcast(total)).select("id", F.when(F.col("total") > 0, F.col("rank") / F.col("total")).otherwise(F.col("rank")).alias("rank"))


def dirty_seed(change: Delta, nodes: DataFrame) -> DataFrame:
    """(id): new and affected vertices and both ends of new edges, as far as they are vertices."""
    ends = change.new_edges.select(F.explode(F.array("src", "dst")).alias("id"))
    seed = change.new_sources.union(change.new_targets).union(change.affected).union(ends).distinct()
    return seed.join(nodes.select("id"), "id", "left_semi")


def dirty_set(change: Delta, graph: Graph, hops: int) -> DataFrame:
    """The seed and ``hops`` levels of successors."""
    dirty = dirty_seed(change, graph.vertices)
    for _ in range(max(hops, 0)):
        reached = graph.edges.join(dirty, F.col("src") == F.col("id"), "left_semi").select(F.col("dst").alias("id"))
        dirty = dirty.union(reached).distinct()
    return dirty


def normalised(ranks: DataFrame) -> DataFrame:
    total = ranks.agg(F.sum("rank").alias("total"))
    return ranks.crossJoin(F.broadcast(total)).select("id", F.when(F.col("total") > 0, F.col("rank") / F.col("total")).otherwise(F.col("rank")).alias("rank"))


def warm(graph: Graph, previous: DataFrame, config: RankConfig = RankConfig()) -> Ranks:
    return converge(graph, config, warm_start(graph.vertices, previous))


def localised(graph: Graph, previous: DataFrame, dirty: DataFrame, config: RankConfig = RankConfig()) -> Ranks:
    """Only dirty vertices move, with the base term and dangling mass of the whole graph; ranks are normalised at the end."""
    got = converge(graph, config, warm_start(graph.vertices, previous), dirty)
    return Ranks(normalised(got.ranks), got.iterations, got.deltas, got.blocks)


def warm_fixed(graph: Graph, previous: DataFrame, iterations: int, damping: float = 0.85) -> DataFrame:
    return fixed(graph, iterations, damping, warm_start(graph.vertices, previous))


def localised_fixed(graph: Graph, previous: DataFrame, dirty: DataFrame, iterations: int, damping: float = 0.85) -> DataFrame:
    return normalised(fixed(graph, iterations, damping, warm_start(graph.vertices, previous), dirty))
