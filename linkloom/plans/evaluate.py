"""Evaluation runs: scaling (A), partition strategies (B), full against warm and localised updates (C).

Results are plain rows; ``figures`` gives the tidy table behind each chart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import RankConfig
from ..functions import scalars as S
from ..lineage import cut
from ..operators import graph as G
from ..operators import incremental, metrics, partitioning
from ..operators import pagerank as P
from .runs import RunStats, measured

UPDATES = ("sequential", "full", "warm", "localised")


def _nodes(graph: P.Graph) -> int:
    return graph.vertices.count()


def update(graph: P.Graph, kind: str, config: RankConfig = RankConfig(), previous: DataFrame | None = None, change: incremental.Delta | None = None, hops: int = 1, name: str | None = None) -> tuple[P.Ranks, RunStats]:
    """One measured run. warm needs earlier ranks, localised these and a delta."""
    if kind not in UPDATES:
        raise ValueError(f"unknown update {kind!r}; there are {', '.join(UPDATES)}")
    if kind in ("warm", "localised") and previous is None:
        raise ValueError(f"{kind} needs earlier ranks")
    if kind == "localised" and change is None:
        raise ValueError("localised needs a delta")
    dirty = incremental.dirty_set(change, graph, hops) if kind == "localised" else None
    run = {
        "sequential": lambda: P.converge(graph, config),
        "full": lambda: P.converge(graph, config),
        "warm": lambda: incremental.warm(graph, previous, config),
        "localised": lambda: incremental.localised(graph, previous, dirty, config),
    }[kind]
    ranks, stats = measured(graph.edges.sparkSession, name or kind, {"update": kind, "damping": config.damping, "threshold": config.threshold, "nodes": _nodes(graph)}, run)
    if dirty is not None:
        count = dirty.count()
        for row in stats.iterations:
            row.dirty_node_count = count
    return ranks, stats


def group_a(graph: P.Graph, config: RankConfig = RankConfig(), workers: tuple[int, ...] = (1, 2, 4)) -> list[dict]:
    """Wall time, speedup and efficiency by the number of partitions that work is dealt over."""
    graph = graph.kept()
    spark = graph.edges.sparkSession
    before = spark.conf.get("spark.sql.shuffle.partitions")
    rows = []
    try:
        for n in (None, *workers):
            spark.conf.set("spark.sql.shuffle.partitions", str(n or 1))
            _, stats = update(graph, "sequential" if n is None else "full", config, name="sequential" if n is None else f"parallel_w{n}")
            rows.append({"run": stats.run_name, "workers": n or 1, "wall_s": stats.total_wall_time_s, "iterations": len(stats.iterations), "final_delta": stats.iterations[-1].delta if stats.iterations else None})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    base = rows[0]["wall_s"]
    for row in rows:
        row["speedup"] = base / row["wall_s"] if row["wall_s"] else float("inf")
        row["efficiency"] = row["speedup"] / max(row["workers"], 1)
    return rows


def group_b(graph: P.Graph, k: int = 4, strategies: tuple[str, ...] = tuple(partitioning.STRATEGIES), config: RankConfig = RankConfig()) -> list[dict]:
    """Size and work balance of each strategy, and a measured run over edges that lie by the part of their target."""
    nodes = G.degrees(graph.edges).select("id", (F.col("in_degree") + 1).alias("work"))
    nodes = cut(nodes.join(G.vertex_ids(nodes), "id"))
    weights, rows = graph.weighted(), []
    for name in strategies:
        assigned = cut(partitioning.assign(nodes, name, k))
        placed = weights.join(assigned.select(F.col("id").alias("dst"), "part"), "dst").repartition(k, "part").select("src", "dst", "w")
        dealt = P.Graph(placed.select("src", "dst"), graph.vertices, placed)
        _, stats = update(dealt, "full", config, name=f"parallel_full_{name}_w{k}")
        told = stats.summary()
        run = {"wall_s": told["total_wall_time_s"], "iterations": told["num_iterations"], "comm_kb": told["total_comm_bytes"] / 1024, "task_imbalance": told["avg_load_imbalance"]}
        rows.append({"strategy": name, "k": k} | partitioning.diagnostics(assigned, k).first().asDict() | run)
    return rows


def group_c(versions: list[DataFrame], config: RankConfig = RankConfig(), hops: int = 1) -> list[dict]:
    """For each step between versions (edge tables): full, warm and localised, with the accuracy of the latter two. Earlier ranks are the full ones of the version before."""
    previous, rows = P.converge(P.Graph.of(versions[0]), config).ranks, []
    for number, (old, new) in enumerate(zip(versions, versions[1:], strict=False), 1):
        graph, change = P.Graph.of(new).kept(), incremental.delta(old, new)
        full, stats = update(graph, "full", config)
        row = {"version": number, "nodes": _nodes(graph), "full_s": stats.total_wall_time_s, "full_iterations": full.iterations}
        for kind in ("warm", "localised"):
            ranks, stats = update(graph, kind, config, previous, change, hops)
            row |= {f"{kind}_s": stats.total_wall_time_s, f"{kind}_iterations": ranks.iterations, f"{kind}_max_diff": metrics.accuracy(full.ranks, ranks.ranks).first()["max_abs_diff"]}
            if kind == "localised":
                row["dirty"] = stats.iterations[0].dirty_node_count if stats.iterations else 0
        rows.append(row)
        previous = full.ranks
    return rows


def amdahl_projection(spark: SparkSession, sequential_s: float, parallel_s: float, workers: int) -> DataFrame:
    """(workers, speedup) that the parallel share implied by one measurement would give."""
    share = S.parallel_fraction(F.lit(float(sequential_s)), F.lit(float(parallel_s)), F.lit(workers))
    rows = spark.range(1).select(F.explode(F.array(*map(F.lit, (1, 2, 4, 8, 16, 32)))).alias("workers"), share.alias("share"))
    return rows.select("workers", S.amdahl(F.col("share"), F.col("workers")).alias("speedup"))


def figures(a: list[dict], b: list[dict], c: list[dict]) -> dict[str, list[tuple]]:
    """(series, x, y) rows of the charts of the three groups."""
    out = {
        "a_wall": [("wall_s", r["workers"], r["wall_s"]) for r in a],
        "a_speedup": [("speedup", r["workers"], r["speedup"]) for r in a],
        "a_efficiency": [("efficiency", r["workers"], r["efficiency"]) for r in a],
    }
    for measure in ("size_imbalance", "work_imbalance", "wall_s", "comm_kb"):
        out[f"b_{measure}"] = [(measure, r["strategy"], r[measure]) for r in b]
    for name, columns in (("wall", ("full_s", "warm_s", "localised_s")), ("iterations", ("full_iterations", "warm_iterations", "localised_iterations")), ("accuracy", ("warm_max_diff", "localised_max_diff")), ("dirty", ("dirty",)), ("nodes", ("nodes",))):
        out[f"c_{name}"] = [(column, r["version"], r[column]) for r in c for column in columns]
    return out
