"""Scalar formulas of scaling studies and of synthetic graphs, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: Knuth's multiplier of the community hash.
MULTIPLIER = 2654435761
SYNTHETIC_PREFIX = "syn://node/"


def speedup(sequential: Column, parallel: Column) -> Column:
    """Sequential over parallel time; infinite if the latter is 0."""
    return F.when(parallel == 0, F.lit(float("inf"))).otherwise(sequential / F.when(parallel != 0, parallel))


def efficiency(speed: Column, workers: Column) -> Column:
    return speed / F.greatest(workers, F.lit(1))


def amdahl(parallel_share: Column, workers: Column) -> Column:
    """The speedup that n workers give if this share of the work is parallel."""
    return 1 / ((1 - parallel_share) + parallel_share / workers)


def parallel_fraction(sequential: Column, parallel: Column, workers: Column) -> Column:
    """The parallel share that a measured speedup implies, kept in [0, 1]; 0 for one worker."""
    measured = F.when(parallel <= 0, F.lit(1.0)).otherwise(sequential / F.when(parallel > 0, parallel))
    share = (1 / measured - 1) / (1 / F.when(workers > 1, workers) - 1)
    return F.when(workers <= 1, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))


def load_imbalance(most: Column, least: Column) -> Column:
    return F.when(most > 0, (most - least) / F.when(most > 0, most)).otherwise(0.0)


def community(node: Column, communities: int) -> Column:
    return F.pmod(node * F.lit(MULTIPLIER), F.lit(communities))


def synthetic_url(node: Column) -> Column:
    return F.concat(F.lit(SYNTHETIC_PREFIX), node.cast("string"))


def synthetic_id(url: Column) -> Column:
    return F.substring_index(url, "/", -1).cast("long")


def display_name(url: Column, prefix: str, width: int = 45) -> Column:
    return F.left(F.replace(url, F.lit(prefix), F.lit("")), F.lit(width))
