"""PageRank as a linear recurrence in one plan.

An iteration is r' = (1-d)/N + d S/N + d A r, S the rank of dangling vertices.
Only S couples a vertex to all others, and it enters every vertex alike. So with
T = d A (on active vertices, 0 on others), the sequences

    p_0 = r_0, p_{t+1} = T p_t + (r_0 where inactive)      u_0 = 1 where active, u_{t+1} = T u_t

need no scalar, and r_t = p_t + sum over j < t of b_j u_{t-1-j}, where the b_j =
(1-d)/N + d S_j/N follow from the sums of p and u over dangling vertices. So no
job runs between iterations: up to ``CHAIN`` of them are one plan with one
exchange each (the partial sums, by target), in which the edges' exchange is
reused, and all scalars come from one aggregation at the end. Longer runs cut the
lineage between chains.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import RankConfig
from ..lineage import cut
from . import graph as G

#: Most vertices whose ranks the broadcast variant sends to every executor.
BROADCAST_VERTICES = 1_000_000
#: Iterations of one plan.
CHAIN = 5


@dataclass
class Ranks:
    """ranks (id, rank); iterations done; the change of each; (iterations, when it ended) of each block of them."""

    ranks: DataFrame
    iterations: int
    deltas: list[float]
    blocks: list[tuple[int, float]] = field(default_factory=list)


@dataclass
class Graph:
    """Distinct edges (src, dst), vertices (id, out_degree); weights (src, dst, w) if they are computed already."""

    edges: DataFrame
    vertices: DataFrame
    weights: DataFrame | None = None

    @classmethod
    def of(cls, edges: DataFrame, declared: DataFrame | None = None) -> Graph:
        edges = G.simple(edges)
        nodes = G.degrees(edges).select("id", "out_degree")
        if declared is not None:
            nodes = nodes.unionByName(declared.select("id", F.lit(0).cast("long").alias("out_degree"))).groupBy("id").agg(F.max("out_degree").alias("out_degree"))
        return cls(edges, nodes)

    def kept(self) -> Graph:
        """Weighted edges and vertices computed once; for iterations in several blocks."""
        weights = cut(self.weighted())
        return Graph(weights.select("src", "dst"), cut(self.vertices), weights)

    def weighted(self) -> DataFrame:
        """(src, dst, w), w = 1 / out-degree of src."""
        if self.weights is not None:
            return self.weights
        return self.edges.join(G.out_degrees(self.edges), F.col("src") == F.col("id")).select("src", "dst", (1 / F.col("out_degree")).alias("w"))


def _chain(edges: DataFrame, state: DataFrame, done: int, steps: int, names: list[str], damping: float, idle: DataFrame | None, execution: str) -> DataFrame:
    """``state`` with the sequences' values after each of ``steps`` more steps.

    Vertices without in-links have none in a step's sums; idle (id, p) holds what
    vertices that are not updated send, which only the first step finds in the state.
    """
    values, rows = state.select(F.col("id").alias("from"), *[F.col(f"{x}{done}").alias(x) for x in names]), []
    new = [f"{x}{done + i}" for i in range(1, steps + 1) for x in names]
    for i in range(1, steps + 1):
        values = {"broadcast": F.broadcast, "shuffle": lambda v: v.hint("merge")}.get(execution, lambda v: v)(values)
        sent = edges.join(values, F.col("src") == F.col("from")).select(F.col("dst").alias("to"), *[(damping * F.col("w") * F.col(x)).alias(x) for x in names])
        if idle is not None and i > 1:
            sent = sent.unionByName(idle.select(F.col("id").alias("to"), "p", F.lit(0.0).alias("u")))
        sums = sent.groupBy("to").agg(*[F.sum(x).alias(x) for x in names])
        own = {f"{x}{done + i}": F.col(x) for x in names}
        rows.append(sums.select("to", *[own.get(c, F.lit(0.0)).alias(c) for c in new]))
        values = sums.withColumnRenamed("to", "from")
    together = rows[0]
    for more in rows[1:]:
        together = together.unionByName(more)
    together = together.groupBy("to").agg(*[F.sum(c).alias(c) for c in new])
    joined = state.join(together, F.col("id") == F.col("to"), "left")
    kept = {c: F.when(F.col("active"), F.coalesce(c, F.lit(0.0))).otherwise(F.col("p0") if c[0] == "p" else F.lit(0.0)) for c in new}
    return joined.select(*state.columns, *[v.alias(c) for c, v in kept.items()])


def _history(graph: Graph, start: DataFrame | None, steps: int, damping: float, active: DataFrame | None, execution: str) -> DataFrame:
    """(id, out_degree, active, p0.., u0..) after ``steps`` steps; without ``start`` only u, for the uniform vector."""
    edges, state, idle = graph.weighted(), graph.vertices, None
    if active is not None:
        edges = edges.join(active.select(F.col("id").alias("dst")), "dst", "left_semi")
        state = state.join(active.select("id", F.lit(True).alias("active")), "id", "left").withColumn("active", F.coalesce("active", F.lit(False)))
    else:
        state = state.withColumn("active", F.lit(True))
    state = state.withColumn("u0", F.when(F.col("active"), 1.0).otherwise(0.0))
    names = ["u"]
    if start is not None:
        names = ["p", "u"]
        state = state.join(start.select(F.col("id").alias("of"), F.col("rank").alias("p0")), F.col("id") == F.col("of")).drop("of")
    if steps > 1:  # both are read again and again
        edges = edges if active is None and graph.weights is not None else cut(edges)
        state = cut(state)
    if active is not None and steps > 1:
        still = state.where("not active").select(F.col("id").alias("from"), "p0")
        sent = edges.join(still, F.col("src") == F.col("from"))
        idle = cut(sent.groupBy(F.col("dst").alias("id")).agg((damping * F.sum(F.col("w") * F.col("p0"))).alias("p")))
    for done in range(0, steps, CHAIN):
        if done:
            state = cut(state)
        state = _chain(edges, state, done, min(CHAIN, steps - done), names, damping, idle, execution)
    return state


def _scalars(history: DataFrame, steps: int, damping: float, uniform: bool) -> DataFrame:
    """One row: n, and b0.. of the iterations."""
    dangling = F.col("out_degree") == 0
    names = ["u"] if uniform else ["p", "u"]
    sums = [F.coalesce(F.sum(F.when(dangling, F.col(f"{x}{t}"))), F.lit(0.0)).alias(f"{x}{t}_dangling") for x in names for t in range(steps)]
    row = history.agg(F.count("*").alias("n"), *sums)
    for t in range(steps):
        own = F.col(f"u{t}_dangling") / F.col("n") if uniform else F.col(f"p{t}_dangling")
        mass = sum((F.col(f"b{j}") * F.col(f"u{t - 1 - j}_dangling") for j in range(t)), own)
        row = row.withColumn(f"b{t}", (1 - damping) / F.col("n") + damping * mass / F.col("n"))
    return row.select("n", *[f"b{t}" for t in range(steps)])


def _rank(t: int, uniform: bool) -> Column:
    own = F.col(f"u{t}") / F.col("n") if uniform else F.col(f"p{t}")
    return sum((F.col(f"b{j}") * F.col(f"u{t - 1 - j}") for j in range(t)), own)


def iterate(graph: Graph, steps: int, damping: float = 0.85, start: DataFrame | None = None, active: DataFrame | None = None, execution: str = "auto", keep: bool = False) -> DataFrame:
    """(id, r0, ..., r<steps>): all iterates of a block, lazily; from 1/N each without ``start`` (id, rank).

    active (id): the vertices that are updated, all without it; the others stay.
    execution: "broadcast" and "shuffle" say how ranks meet edges, "auto" leaves
    it to sizes. keep: compute the sequences once, for several looks at them.
    """
    if execution == "broadcast" and graph.vertices.count() > BROADCAST_VERTICES:
        execution = "shuffle"
    uniform = start is None and active is None
    if start is None and not uniform:
        n = graph.vertices.agg(F.count("*").alias("n"))
        start = graph.vertices.crossJoin(F.broadcast(n)).select("id", (1 / F.col("n")).alias("rank"))
    history = _history(graph, start, steps, damping, active, execution)
    history = cut(history) if keep else history
    row = F.broadcast(_scalars(history, steps, damping, uniform))  # one row
    return history.crossJoin(row).select("id", *[_rank(t, uniform).alias(f"r{t}") for t in range(steps + 1)])


def changes(iterates: DataFrame, steps: int, norm: str = "l1") -> DataFrame:
    """One row: d1, d2, ..., the change that each iteration made."""
    over = {"l1": F.sum, "linf": F.max}[norm]
    return iterates.agg(*[F.coalesce(over(F.abs(F.col(f"r{t}") - F.col(f"r{t - 1}"))), F.lit(0.0)).alias(f"d{t}") for t in range(1, steps + 1)])


def fixed(graph: Graph, iterations: int, damping: float = 0.85, start: DataFrame | None = None, active: DataFrame | None = None, execution: str = "auto") -> DataFrame:
    """(id, rank) after so many iterations, as one lazy plan; 0 give the start."""
    return iterate(graph, iterations, damping, start, active, execution).select("id", F.col(f"r{iterations}").alias("rank"))


def converge(graph: Graph, config: RankConfig = RankConfig(), start: DataFrame | None = None, active: DataFrame | None = None, execution: str = "auto") -> Ranks:
    """Iterates until the change is under the threshold, looking after each block of iterations."""
    graph, deltas, blocks, done, ranks = graph.kept(), [], [], 0, start
    if active is not None:
        active = cut(active.select("id").distinct())
    while done < config.max_iterations:
        steps = min(config.block, config.max_iterations - done)
        block = iterate(graph, steps, config.damping, ranks, active, execution, keep=True)
        got = list(changes(block, steps, config.norm).first())
        small = [t for t, d in enumerate(got, 1) if config.threshold is not None and d < config.threshold]
        last = small[0] if small else steps
        deltas += got[:last]
        done += last
        ranks = cut(block.select("id", F.col(f"r{last}").alias("rank")))
        blocks.append((last, time.time()))
        if small:
            break
    return Ranks(fixed(graph, 0) if ranks is None else ranks, done, deltas, blocks)


def top(ranks: DataFrame, n: int, digits: int = 10) -> DataFrame:
    """The n highest ranks, rounded, ties by id."""
    return ranks.select("id", F.round("rank", digits).alias("rank")).orderBy(F.desc("rank"), "id").limit(n)
