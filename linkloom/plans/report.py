"""Small tables as text."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

from ..operators import graph as G
from ..operators import metrics
from ..operators.components import weak_components
from ..operators.pagerank import Ranks, top


def table(rows: list[dict]) -> str:
    """Columns aligned; numbers with six significant digits."""
    if not rows:
        return "(no rows)"
    told = [{k: f"{v:.6g}" if isinstance(v, float) else str(v) for k, v in row.items()} for row in rows]
    widths = {k: max(len(k), *(len(row.get(k, "")) for row in told)) for k in told[0]}
    line = lambda row: "  ".join(row.get(k, "").ljust(w) for k, w in widths.items()).rstrip()
    return "\n".join([line({k: k for k in widths}), *map(line, told)])


def convergence(deltas: list[float], width: int = 40) -> str:
    """A bar for each change, on a logarithmic scale from the largest to the smallest."""
    logs = [math.log10(max(d, 1e-300)) for d in deltas]
    if not logs:
        return "(no iterations)"
    low, high = min(logs), max(logs)
    span = (high - low) or 1.0
    return "\n".join(f"{t:4d}  {d:.3e}  {'#' * (1 + round((width - 1) * (v - low) / span))}" for t, (d, v) in enumerate(zip(deltas, logs, strict=True), 1))


def graph_summary(edges: DataFrame) -> str:
    simple = G.simple(edges)
    row = G.multigraph_stats(edges).first().asDict() | {f"simple_{k}": v for k, v in G.graph_stats(edges).first().asDict().items()}
    row["weak_components"] = weak_components(simple, G.vertices(simple)).select("component").distinct().count()
    return table([{"figure": k, "value": v} for k, v in row.items()])


def ranks_summary(result: Ranks, n: int = 10) -> str:
    spread = metrics.gini(result.ranks).first()
    head = [{"figure": "iterations", "value": result.iterations}, {"figure": "rank sum", "value": spread["total"]}, {"figure": "gini", "value": spread["gini"]}]
    best = [{"place": i, "id": r["id"], "rank": r["rank"]} for i, r in enumerate(top(result.ranks, n).collect(), 1)]
    return "\n\n".join([table(head), table(best), convergence(result.deltas)])
