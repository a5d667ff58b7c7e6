"""Writers; Spark's commit protocol makes each atomic."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators.incremental import Delta
from ..operators.pagerank import top


def adjacency_json(edges: DataFrame, path: str) -> None:
    """One JSON object a source and line: {"source": ..., "targets": [...]}; repeats stay."""
    G.adjacency(edges).write.mode("overwrite").json(path)


def edges_csv(edges: DataFrame, path: str) -> None:
    edges.select(F.col("src").alias("source"), F.col("dst").alias("target")).write.mode("overwrite").option("header", True).csv(path)


def snapshot(edges: DataFrame, path: str, number: int) -> None:
    """Distinct edges as one version of a table partitioned by version; only that version is replaced."""
    G.simple(edges).withColumn("version", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(path)


def delta(change: Delta, path: str) -> None:
    for name in ("new_sources", "new_targets", "new_edges", "affected", "summary"):
        getattr(change, name).write.mode("overwrite").parquet(f"{path}/{name}")


def cache(entries: DataFrame, path: str) -> None:
    """Entries (url, links) as JSON lines, beside those that are there."""
    entries.select("url", "links").write.mode("append").json(path)


def top_scores(ranks: DataFrame, n: int = 1000) -> DataFrame:
    """(place, id, rank, rank_sum, node_count) of the n highest."""
    totals = ranks.agg(F.sum("rank").alias("rank_sum"), F.count("*").alias("node_count"))
    return top(ranks, n, 15).crossJoin(F.broadcast(totals))


def scores(ranks: DataFrame, path: str) -> None:
    ranks.select("id", "rank").write.mode("overwrite").parquet(f"{path}/scores")
    top_scores(ranks).coalesce(1).write.mode("overwrite").json(f"{path}/top")


def run_stats(stats, path: str) -> None:
    """metrics.json, metrics_summary.csv and iteration_log.csv of a run, on the driver's side."""
    import pandas as pd

    folder = Path(path)
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "metrics.json").write_text(json.dumps(stats.as_dict(), indent=2))
    pd.json_normalize(stats.summary()).to_csv(folder / "metrics_summary.csv", index=False)
    pd.DataFrame(stats.rows()).to_csv(folder / "iteration_log.csv", index=False)


def group_results(group: str, rows: list[dict], path: str) -> None:
    """An evaluation group's rows as <path>/group<X>/summary.json and .csv, and its line in <path>/index.json, on the driver's side."""
    import pandas as pd

    root = Path(path)
    folder = root / f"group{group}"
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "summary.json").write_text(json.dumps(rows, indent=2))
    pd.json_normalize(rows).to_csv(folder / "summary.csv", index=False)
    index = root / "index.json"
    known = json.loads(index.read_text()) if index.exists() else {}
    index.write_text(json.dumps(known | {group: {"rows": len(rows), "folder": folder.name}}, indent=2, sort_keys=True))
