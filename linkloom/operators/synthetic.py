"""Clustered scale-free graphs, generated without state.

Preferential attachment by copying: a vertex's edge picks an earlier vertex of
its community (or, for a share of the edges, of the whole graph) and a slot of
it: the vertex itself, or one of its own edges, whose target is found the same
way. All choices are hashes of (seed, vertex, edge, attempt), so any edge can be
computed anywhere, in any order, and a larger graph contains the smaller one
(after Sanders and Schulz, 2016).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import GeneratorConfig
from ..functions.scalars import MULTIPLIER, synthetic_url

#: Attempts of an edge to find a new target that is not the vertex itself.
ATTEMPTS = 6


def _dice(seed: int, *parts) -> np.ndarray:
    x = np.uint64(seed)
    with np.errstate(over="ignore"):
        for part in parts:
            x = (np.asarray(part).astype(np.uint64) + x) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            x = x ^ (x >> np.uint64(29))
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def _dangling(node: np.ndarray, c: GeneratorConfig) -> np.ndarray:
    return (node >= c.communities) & (_dice(c.seed, node, 1) < c.dangling_share)


def _targets(node: np.ndarray, edge: np.ndarray, attempt: int, c: GeneratorConfig) -> np.ndarray:
    """The target of each (node, edge); -1 where there is no earlier vertex to pick."""
    at, slot, tries = node.copy(), edge.copy(), np.full(len(node), attempt)
    out = np.full(len(node), -1)
    open_ = np.arange(len(node))
    own = _dice(c.seed, node, edge, tries, 2) >= c.cross_share  # these stay in the community all the way
    while len(open_):
        v, e, a = at[open_], slot[open_], tries[open_]
        wide = _dice(c.seed, v, e, a, 2) < c.cross_share
        pick = _dice(c.seed, v, e, a, 3)
        earlier = v // c.communities  # earlier vertices of the same community: v - j * communities
        local = v - c.communities * (1 + np.floor(pick * np.maximum(earlier, 1)).astype(np.int64))
        chosen = np.where(wide | (earlier == 0), np.floor(pick * v).astype(np.int64), local)
        none = v == 0
        which = np.floor(_dice(c.seed, v, e, a, 4) * (c.edges_per_node + 1)).astype(np.int64)
        leaves = own[open_] & ((chosen < c.communities) | (_dice(c.seed, chosen, which - 1, np.zeros_like(chosen), 2) < c.cross_share))
        ends = none | (which == 0) | _dangling(chosen, c) | (chosen == 0) | leaves
        out[open_[ends]] = np.where(none, -1, chosen)[ends]
        on = ~ends
        at[open_[on]], slot[open_[on]], tries[open_[on]] = chosen[on], which[on] - 1, 0
        open_ = open_[on]
    return out


def generate(spark: SparkSession, nodes: int, config: GeneratorConfig = GeneratorConfig()) -> DataFrame:
    """(src, dst) of vertices 0 .. nodes - 1, distinct, without loops; a larger number of nodes adds to the edges."""

    def run(batches):
        for batch in batches:
            ids = batch["id"].to_numpy()
            ids = ids[~_dangling(ids, config)]
            node, edge = np.repeat(ids, config.edges_per_node), np.tile(np.arange(config.edges_per_node), len(ids))
            found = np.full(len(node), -1)
            for attempt in range(ATTEMPTS):
                frame = pd.DataFrame({"node": node, "found": found})
                open_ = np.flatnonzero((found < 0) | (found == node) | frame.duplicated().to_numpy())
                if not len(open_):
                    break
                found[open_] = _targets(node[open_], edge[open_], attempt, config)
            out = pd.DataFrame({"src": node, "dst": found})
            yield out[(out["dst"] >= 0) & (out["dst"] != out["src"])].drop_duplicates()

    return spark.range(nodes).mapInPandas(run, "src long, dst long")


def as_urls(edges: DataFrame) -> DataFrame:
    return edges.select(synthetic_url(F.col("src")).alias("src"), synthetic_url(F.col("dst")).alias("dst"))


def meta(edges: DataFrame, nodes: int, config: GeneratorConfig = GeneratorConfig()) -> DataFrame:
    """One row: the settings and the counts."""
    settings = [F.lit(getattr(config, name)).alias(name) for name in ("communities", "edges_per_node", "cross_share", "dangling_share", "seed")]
    return edges.agg(F.lit(nodes).cast("long").alias("nodes"), F.count("*").alias("edges"), F.lit(MULTIPLIER).alias("multiplier"), *settings)


def series(spark: SparkSession, sizes: tuple[int, ...], config: GeneratorConfig = GeneratorConfig()) -> list[DataFrame]:
    """Snapshots of a growing graph."""
    return [generate(spark, n, config) for n in sizes]
