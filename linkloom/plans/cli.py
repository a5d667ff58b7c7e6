"""python -m linkloom.plans.cli: extract, rank, grow, update, evaluate and generate from the command line."""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence

from pyspark.sql import SparkSession

from ..config import ExtractConfig, GeneratorConfig, GrowthConfig, RankConfig
from ..operators import graph as G
from ..operators import growth, incremental, synthetic
from ..operators import pagerank as P
from ..sources import readers, writers
from . import evaluate, report


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="linkloom", description=__doc__)
    commands = out.add_subparsers(dest="command", required=True)

    def command(name: str, text: str) -> argparse.ArgumentParser:
        return commands.add_parser(name, help=text, description=text)

    c = command("extract", "Links of a table of pages (page_id, url, html), as version 0 of a graph.")
    c.add_argument("pages")
    c.add_argument("output")
    c.add_argument("--max-links", type=int)
    c.add_argument("--domain")
    c.add_argument("--parser", choices=("regex", "html"), default="regex")

    c = command("rank", "PageRank of a stored graph.")
    c.add_argument("graph")
    c.add_argument("--version", type=int, default=0)
    c.add_argument("--damping", type=float, default=0.85)
    c.add_argument("--max-iter", type=int, default=100)
    c.add_argument("--threshold", type=float, default=1e-6)
    c.add_argument("--no-convergence", action="store_true", help="always run all iterations")
    c.add_argument("--strategy", choices=("auto", "broadcast", "shuffle"), default="auto")
    c.add_argument("--norm", choices=("l1", "linf"), default="l1")
    c.add_argument("--update", choices=evaluate.UPDATES, default="full")
    c.add_argument("--prev-scores")
    c.add_argument("--hops", type=int, default=1)
    c.add_argument("--output-dir")

    c = command("grow", "Versions of a graph from growing shares of a table of pages.")
    c.add_argument("pages")
    c.add_argument("output")
    group = c.add_mutually_exclusive_group(required=True)
    group.add_argument("--all", action="store_true")
    group.add_argument("--version", type=int)
    c.add_argument("--cache-dir", help="extracted links, read before and added to after each step")
    c.add_argument("--delta-dir", help="where the delta of each step is stored")

    c = command("evaluate", "Groups A (scaling), B (partitions), C (updates).")
    c.add_argument("graph")
    c.add_argument("--group", choices=("A", "B", "C", "all"), default="all")
    c.add_argument("--quick", action="store_true")
    c.add_argument("--partitions", type=int, default=4, help="parts of group B")
    c.add_argument("--output-dir", help="where each group's rows and an index of the groups are stored")

    c = command("generate", "A synthetic clustered graph.")
    c.add_argument("nodes", type=int)
    c.add_argument("output")
    c.add_argument("--seed", type=int, default=42)
    return out


def _grow(spark: SparkSession, args) -> str:
    shares = GrowthConfig().shares
    numbers = range(len(shares)) if args.all else [args.version]
    if any(not 0 <= n < len(shares) for n in numbers):
        raise SystemExit(f"there are versions 0 to {len(shares) - 1}")
    pages, told = readers.pages(spark, args.pages), []
    for n in numbers:
        if n == 0:
            writers.snapshot(G.multigraph(growth.version(pages, 0)), args.output, 0)
            continue
        cache = spark.createDataFrame([], "key string, url string, links array<string>")
        if args.cache_dir and readers.exists(spark, args.cache_dir):
            cache = readers.link_cache(spark, args.cache_dir)
        step = growth.grow(readers.version(spark, args.output, n - 1), growth.version(pages, n), cache)
        told.append({"version": n} | step.stats.first().asDict() | step.delta.summary.first().asDict())
        writers.snapshot(step.edges, args.output, n)
        if args.delta_dir:
            writers.delta(step.delta, f"{args.delta_dir}/v{n - 1}_v{n}")
        if args.cache_dir:
            writers.cache(step.cached, args.cache_dir)
    return report.table(told)


def _rank(spark: SparkSession, args) -> str:
    if args.update in ("warm", "localised") and not args.prev_scores:
        raise SystemExit(f"--update {args.update} needs --prev-scores")
    if args.update == "localised" and args.version < 1:
        raise SystemExit("--update localised needs a version that another precedes")
    edges = readers.version(spark, args.graph, args.version)
    config = RankConfig(args.damping, args.max_iter, None if args.no_convergence else args.threshold, args.norm)
    previous = readers.scores(spark, args.prev_scores) if args.prev_scores else None
    change = None
    if args.update == "localised":
        change = incremental.delta(readers.version(spark, args.graph, args.version - 1), edges)
    if args.update in ("sequential", "full"):
        result = P.converge(P.Graph.of(edges), config, execution=args.strategy)
    else:
        result, _ = evaluate.update(P.Graph.of(edges), args.update, config, previous, change, args.hops)
    if args.output_dir:
        writers.scores(result.ranks, args.output_dir)
    return report.ranks_summary(result)


def _evaluate(spark: SparkSession, args) -> str:
    edges = spark.read.parquet(args.graph)
    numbers = sorted(r["version"] for r in edges.select("version").distinct().collect())
    versions = [readers.version(spark, args.graph, n) for n in numbers]
    graph = P.Graph.of(versions[0]).kept()
    groups = {
        "A": lambda: evaluate.group_a(graph, workers=(1, 4) if args.quick else (1, 2, 4)),
        "B": lambda: evaluate.group_b(graph, args.partitions, ("range", "edge_balanced") if args.quick else ("range", "hash", "edge_balanced")),
        "C": lambda: evaluate.group_c(versions[:2] if args.quick else versions),
    }
    told = []
    for name in groups if args.group == "all" else args.group:
        rows = groups[name]()
        told.append(report.table(rows))
        if args.output_dir:
            writers.group_results(name, rows, args.output_dir)
    return "\n\n".join(told)


def main(argv: Sequence[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("linkloom").getOrCreate()
    if args.command == "extract":
        edges = G.multigraph(readers.pages(spark, args.pages), ExtractConfig(args.max_links, args.domain, parser=args.parser))
        writers.snapshot(edges, args.output, 0)
        print(report.graph_summary(readers.version(spark, args.output, 0)))
    elif args.command == "rank":
        print(_rank(spark, args))
    elif args.command == "grow":
        print(_grow(spark, args))
    elif args.command == "evaluate":
        print(_evaluate(spark, args))
    else:
        config = GeneratorConfig(seed=args.seed)
        writers.snapshot(synthetic.as_urls(synthetic.generate(spark, args.nodes, config)), args.output, 0)
        print(json.dumps(synthetic.meta(readers.version(spark, args.output, 0), args.nodes, config).first().asDict()))


if __name__ == "__main__":
    main()
