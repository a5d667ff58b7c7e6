"""How ranks compare, how they are spread, and how evenly work ran."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import load_imbalance
from .order import numbered


def _differences(reference: DataFrame, test: DataFrame) -> DataFrame:
    other = test.select(F.col("id").alias("other"), F.col("rank").alias("other_rank"))
    return reference.join(other, F.col("id") == F.col("other"), "left").select("id", F.abs(F.col("rank") - F.col("other_rank")).alias("diff"))


def accuracy(reference: DataFrame, test: DataFrame) -> DataFrame:
    """One row: max_abs_diff, l1, l2, missing. Nothing in common is infinitely far; an empty reference is 0 apart."""
    row = _differences(reference, test).agg(F.count("*").alias("n"), F.count("diff").alias("common"), F.max("diff").alias("m"), F.sum("diff").alias("a"), F.sqrt(F.sum(F.col("diff") * F.col("diff"))).alias("e"))

    def told(c: str) -> Column:
        return F.when(F.col("n") == 0, 0.0).when(F.col("common") == 0, float("inf")).otherwise(F.col(c))

    return row.select(told("m").alias("max_abs_diff"), told("a").alias("l1"), told("e").alias("l2"), (F.col("n") - F.col("common")).alias("missing"))


def validate(reference: DataFrame, test: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """One row: valid (no vertex missing, all differences within tolerance), the greatest difference and where it is (ties by id)."""
    row = _differences(reference, test).agg(F.max("diff").alias("max_abs_diff"), F.count_if(F.col("diff").isNull()).alias("missing"), F.min(F.struct((-F.col("diff")).alias("d"), "id")).alias("worst"), F.min(F.when(F.col("diff").isNotNull(), F.struct((-F.col("diff")).alias("d"), F.col("id")))).alias("at"))
    within = (F.col("missing") == 0) & (F.coalesce("max_abs_diff", F.lit(0.0)) <= tolerance)
    return row.select(within.alias("valid"), "max_abs_diff", "missing", F.col("at.id").alias("worst_id"))


def gini(ranks: DataFrame) -> DataFrame:
    """One row: the Gini coefficient (0: equal), n and total, of ``ranks`` (id, rank)."""
    # equal ranks may take their places in any order; the id spreads them over partitions
    placed = numbered(ranks.select("id", "rank"), "place", F.col("rank"), F.col("id"))
    row = placed.agg(F.count("*").alias("n"), F.sum("rank").alias("total"), F.sum(F.col("rank") * (F.col("place") + 1)).alias("weighted"))
    coefficient = F.when((F.col("n") > 0) & (F.col("total") > 0), 2 * F.col("weighted") / (F.col("n") * F.col("total")) - (F.col("n") + 1) / F.col("n")).otherwise(0.0)
    return row.select(coefficient.alias("gini"), "n", F.coalesce("total", F.lit(0.0)).alias("total"))


def task_stats(tasks: DataFrame, by: list[str], seconds: str = "seconds") -> DataFrame:
    """Per group: least, most, mean and sample deviation of task times (0 for one task), and their imbalance."""
    rows = tasks.groupBy(*by).agg(F.min(seconds).alias("task_min_s"), F.max(seconds).alias("task_max_s"), F.avg(seconds).alias("task_avg_s"), F.coalesce(F.stddev_samp(seconds), F.lit(0.0)).alias("task_std_s"))
    return rows.withColumn("load_imbalance", load_imbalance(F.col("task_max_s"), F.col("task_min_s")))


def run_totals(iterations: DataFrame) -> DataFrame:
    """One row of a run's totals from its iteration rows."""
    none = F.lit(0.0)
    return iterations.agg(
        F.count("*").alias("num_iterations"),
        F.coalesce(F.sum("comm_bytes"), F.lit(0)).alias("comm_bytes"),
        F.coalesce(F.sum("barrier_wait_s"), none).alias("barrier_wait_s"),
        F.coalesce(F.sum("compute_time_s"), none).alias("compute_time_s"),
        F.coalesce(F.avg("wall_time_s"), none).alias("avg_iteration_s"),
        F.coalesce(F.avg("load_imbalance"), none).alias("avg_load_imbalance"),
        F.coalesce(F.max("driver_rss_mb"), none).alias("max_driver_rss_mb"),
    )


def all_task_metrics(tasks: DataFrame, nodes: int, iterations: int, seconds: str = "seconds") -> DataFrame:
    """One row over all tasks of a run, with the analytic communication volume, 8 bytes a vertex and iteration."""
    row = tasks.agg(F.min(seconds).alias("task_min_s"), F.max(seconds).alias("task_max_s"), F.avg(seconds).alias("task_avg_s"))
    return row.withColumn("load_imbalance", load_imbalance(F.col("task_max_s"), F.col("task_min_s"))).withColumn("comm_bytes", F.lit(nodes * 8 * iterations))
