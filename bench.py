"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from linkloom.config import RankConfig
from linkloom.operators import graph as G
from linkloom.operators import incremental
from linkloom.operators import pagerank as P
from linkloom.operators.components import weak_components
from linkloom.plans.catalog import QUERIES
from linkloom.plans.graphs import trade, web


def ranked(spark, sf_dir, execution="auto"):
    """Ranks of the trade graph until the change is under 1e-6, its edges given."""
    return P.converge(P.Graph.of(trade(spark, sf_dir)), RankConfig(), execution=execution).ranks


def warm(spark, sf_dir):
    old, new = P.Graph.of(trade(spark, sf_dir, 2)), P.Graph.of(trade(spark, sf_dir, 3))
    return incremental.warm(new, P.converge(old).ranks).ranks


def components(spark, sf_dir):
    edges = web(spark, sf_dir)
    return weak_components(edges, G.vertices(edges))


HEADLINE = {
    "links_normalised": QUERIES["links_normalised"],
    "edges_distinct": QUERIES["edges_distinct"],
    "graph_stats_trade": QUERIES["graph_stats_trade"],
    "pagerank_trade_10": QUERIES["pagerank_trade_10"],
    "pagerank_converged": ranked,
    "pagerank_warm": warm,
    "delta_new_edges": QUERIES["delta_new_edges"],
    "part_edge_balanced": QUERIES["part_edge_balanced"],
    "wcc": components,
}


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["edges_distinct"](spark, sf_dir).agg(F.count("*")).collect()  # start-up and first compilation
    took = {}
    for name, query in HEADLINE.items():
        began = time.perf_counter()
        query(spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total of headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": int(cpus)}))
    sys.stdout.flush()
    spark.stop()


if __name__ == "__main__":
    main()
