"""The command line, evaluation groups and reports on small data."""

import json

import pytest

from linkloom.config import RankConfig
from linkloom.operators import pagerank as P
from linkloom.plans import cli, evaluate, report

PAGES = "/root/testdata/sf0.001/pages.parquet"


@pytest.fixture(scope="module")
def versions(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("graph"))
    cli.main(["grow", PAGES, path, "--all"])
    return path


def test_rank_full_then_warm(spark, versions, tmp_path, capsys):
    cli.main(["rank", versions, "--output-dir", f"{tmp_path}/v0"])
    told = capsys.readouterr().out
    assert "rank sum" in told and "#" in told
    cli.main(["rank", versions, "--version", "1", "--update", "localised", "--prev-scores", f"{tmp_path}/v0/scores", "--max-iter", "3"])
    assert "rank sum" in capsys.readouterr().out


def test_guards(spark, versions):
    for bad in (["rank", versions, "--update", "warm"], ["grow", PAGES, versions, "--version", "9"], ["rank", versions, "--update", "localised", "--prev-scores", "x"]):
        with pytest.raises(SystemExit):
            cli.main(bad)
    graph = P.Graph.of(spark.createDataFrame([("a", "b")], "src string, dst string"))
    for kind in ("warm", "localised", "sideways"):
        with pytest.raises(ValueError):
            evaluate.update(graph, kind)


def test_groups(spark, versions):
    edges = [spark.read.parquet(versions).where(f"version = {n}").select("src", "dst") for n in (0, 1)]
    config = RankConfig(max_iterations=6)
    a = evaluate.group_a(P.Graph.of(edges[0]), config, workers=(2,))
    b = evaluate.group_b(P.Graph.of(edges[0]))
    c = evaluate.group_c(edges, config)
    assert [r["run"] for r in a] == ["sequential", "parallel_w2"] and a[0]["speedup"] == 1
    assert {r["strategy"] for r in b} == {"range", "hash", "edge_balanced"} and min(b, key=lambda r: r["work_imbalance"])["strategy"] == "edge_balanced"
    assert all(r["wall_s"] > 0 and r["iterations"] and r["comm_kb"] > 0 for r in b)
    assert c[0]["dirty"] > 0 and c[0]["warm_max_diff"] < 1e-3
    assert len(evaluate.figures(a, b, c)) == 12
    assert [r["speedup"] for r in evaluate.amdahl_projection(spark, 8.0, 8.0, 4).collect()] == [1.0] * 6


def test_grow_with_a_cache_and_stored_groups(spark, tmp_path, capsys):
    table, cache = f"{tmp_path}/graph", f"{tmp_path}/cache"
    cli.main(["grow", PAGES, table, "--version", "0"])
    told = []
    for _ in range(2):
        capsys.readouterr()
        cli.main(["grow", PAGES, table, "--version", "1", "--cache-dir", cache, "--delta-dir", f"{tmp_path}/deltas"])
        head, row = (line.split() for line in capsys.readouterr().out.strip().splitlines()[:2])
        told.append(dict(zip(head, row, strict=True)))
    misses, hits = int(told[0]["cache_misses"]), int(told[1]["cache_hits"])
    assert misses > 0 and hits == misses and told[1]["cache_misses"] == "0" and told[0]["links"] == told[1]["links"]
    assert spark.read.parquet(f"{tmp_path}/deltas/v0_v1/new_edges").count() > 0
    cli.main(["evaluate", table, "--group", "B", "--quick", "--partitions", "2", "--output-dir", f"{tmp_path}/out"])
    assert len(json.loads((tmp_path / "out/groupB/summary.json").read_text())) == 2
    assert json.loads((tmp_path / "out/index.json").read_text()) == {"B": {"folder": "groupB", "rows": 2}}


def test_runs_are_measured(spark):
    graph = P.Graph.of(spark.range(200).selectExpr("id as src", "(id * 7) % 200 as dst").union(spark.range(200).selectExpr("id as src", "(id * id) % 200 as dst")))
    ranks, stats = evaluate.update(graph, "full", RankConfig(max_iterations=7, threshold=None))
    assert [n for n, _ in ranks.blocks] == [5, 2] and len(stats.iterations) == 7
    told = stats.as_dict()
    assert told["total_compute_time_s"] > 0 and told["total_comm_bytes"] > 0 and told["max_driver_rss_mb"] > 0
    assert sum(r["wall_time_s"] for r in told["iterations"]) <= told["total_wall_time_s"]
    assert all(r["task_max_s"] >= r["task_avg_s"] >= r["task_min_s"] for r in told["iterations"])


def test_text():
    assert report.table([]) == "(no rows)" and report.table([{"a": 1, "b": 0.5}]).splitlines()[1].split() == ["1", "0.5"]
    assert report.convergence([1.0, 0.1]).count("\n") == 1
