"""Vertex partitioning: range, hash and edge-balanced assignments, and how even they are.

Assignments are columns of (id, vid, part, work); work is in-degree + 1.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .order import numbered


#: Most runs of the greedy plan that go to every executor.
BROADCAST_RUNS = 20_000


def _check(k: int) -> None:
    if k <= 0:
        raise ValueError("the number of partitions must be positive")


def by_range(nodes: DataFrame, k: int) -> DataFrame:
    """Chunks of max(1, n // k) consecutive vertices; the last takes the rest."""
    _check(k)
    n = nodes.agg(F.count("*").alias("n"))
    size = F.greatest(F.lit(1), F.floor(F.col("n") / k))
    return nodes.crossJoin(F.broadcast(n)).withColumn("part", F.least(F.floor(F.col("vid") / size), F.lit(k - 1)).cast("int")).drop("n")


def by_hash(nodes: DataFrame, k: int) -> DataFrame:
    _check(k)
    return nodes.withColumn("part", F.pmod("vid", F.lit(k)).cast("int"))


def _greedy(classes: list[tuple[int, int]], k: int) -> list[tuple[int, int, int, list[int]]]:
    """For each (work, count), largest work first: runs (work, first place, place after the last, parts that repeat over these).

    The rule is that the next vertex goes to the part of least load, ties to the
    lowest part. A part of load L takes its j-th vertex of a class when its load is
    L + j * work, so in units of work it takes one at each level from L div work on,
    in order of (L mod work, part) within a level. Between two levels at which
    further parts begin, the same parts repeat: a class has at most k runs, however
    many vertices it has.
    """
    loads, out, place = [0] * k, [], 0
    for work, left in classes:
        begins = [load // work for load in loads]
        within = sorted(range(k), key=lambda p: (loads[p] % work, p))
        levels = sorted(set(begins))
        for level, upper in zip(levels, [*levels[1:], None], strict=True):
            cycle = [p for p in within if begins[p] <= level]
            n = left if upper is None else min(left, (upper - level) * len(cycle))
            if not n:
                break
            rounds, rest = divmod(n, len(cycle))
            for at, p in enumerate(cycle):
                loads[p] += work * (rounds + (at < rest))
            out.append((work, place, place + n, cycle))
            place, left = place + n, left - n
    return out


def edge_balanced(nodes: DataFrame, k: int) -> DataFrame:
    """Longest work first, each vertex to the part of least load so far; ties of work by vid.

    Only the histogram of works reaches the driver (of E edges, at most about the
    root of 2 E different works); vertices find their part by their place in order of work.
    """
    _check(k)
    placed = numbered(nodes, "place", F.col("work").desc(), F.col("vid"))
    classes = [(r["work"], r["n"]) for r in nodes.groupBy("work").agg(F.count("*").alias("n")).orderBy(F.desc("work")).collect()]
    runs = _greedy(classes, k)
    plan = nodes.sparkSession.createDataFrame(runs, "of long, first long, after long, cycle array<int>")
    plan = F.broadcast(plan) if len(runs) <= BROADCAST_RUNS else plan
    here = (F.col("work") == F.col("of")) & F.col("place").between(F.col("first"), F.col("after") - 1)
    turn = F.pmod(F.col("place") - F.col("first"), F.size("cycle")).cast("int")
    return placed.join(plan, here).withColumn("part", F.get("cycle", turn)).select(*nodes.columns, "part")


STRATEGIES: dict[str, Callable[[DataFrame, int], DataFrame]] = {"range": by_range, "hash": by_hash, "edge_balanced": edge_balanced}


def assign(nodes: DataFrame, strategy: str, k: int) -> DataFrame:
    """``nodes`` (id, vid, work) with part, by the name of a strategy."""
    name = strategy.strip().lower()
    if name not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; there are {', '.join(STRATEGIES)}")
    if name == "edge_balanced" and "work" not in nodes.columns:
        raise ValueError("edge_balanced needs the column work")
    return STRATEGIES[name](nodes, k)


def diagnostics(assigned: DataFrame, k: int) -> DataFrame:
    """One row: least, most, mean and imbalance of the parts' sizes and works; empty parts count."""
    parts = assigned.sparkSession.range(k).select(F.col("id").cast("int").alias("part"))
    sums = assigned.groupBy("part").agg(F.count("*").alias("size"), F.sum("work").alias("work"))
    rows = parts.join(sums, "part", "left").na.fill(0, ["size", "work"])
    of = lambda c: [F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"), F.avg(c).alias(f"avg_{c}"), F.when(F.max(c) > 0, (F.max(c) - F.min(c)) / F.max(c)).otherwise(0.0).alias(f"{c}_imbalance")]
    return rows.agg(*of("size"), *of("work"))
