"""Operators on a hand graph: a repeated edge, a loop, dangling vertices, three weak components."""

import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkloom.config import ExtractConfig, RankConfig
from linkloom.functions.links import raw_links, with_links
from linkloom.operators import components, graph, growth, incremental, metrics, partitioning, synthetic
from linkloom.operators import pagerank as P
from linkloom.plans.catalog import WRITTEN

EDGES = [("a", "b"), ("a", "b"), ("a", "c"), ("b", "c"), ("c", "a"), ("d", "c"), ("d", "f"), ("e", "e"), ("x", "y")]
# From an independent power iteration in plain Python, d = 0.85.
AFTER_10 = {"a": 0.2548916658, "b": 0.1366178235, "c": 0.2648595337, "d": 0.0288007834, "e": 0.1916484042, "f": 0.0410605965, "x": 0.0288007834, "y": 0.0533204095}
CONVERGED = {"a": 0.2543470077, "b": 0.1368537334, "c": 0.2654012188, "d": 0.0287562914, "e": 0.1917086016, "f": 0.0409777157, "x": 0.0287562914, "y": 0.0531991400}


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, "src string, dst string")


@pytest.fixture(scope="module")
def hand(edges):
    return P.Graph.of(edges).kept()


def as_dict(ranks):
    return {r["id"]: r["rank"] for r in ranks.collect()}


def test_degrees_and_stats(edges):
    got = {r["id"]: (r["out_degree"], r["in_degree"]) for r in graph.degrees(graph.simple(edges)).collect()}
    assert got == {"a": (2, 1), "b": (1, 1), "c": (1, 3), "d": (2, 0), "e": (1, 1), "f": (0, 1), "x": (1, 0), "y": (0, 1)}
    row = graph.graph_stats(edges).first()
    assert (row["nodes"], row["edges"], row["max_in_degree"], row["max_out_degree"], row["dangling"]) == (8, 8, 3, 2, 2)
    row = graph.multigraph_stats(edges).first()
    assert (row["sources"], row["edges"]) == (6, 9)


def test_vertex_ids_are_dense_and_ordered(edges):
    got = graph.vertex_ids(graph.vertices(edges)).orderBy("vid").collect()
    assert [(r["vid"], r["id"]) for r in got] == list(enumerate("abcdefxy"))


def test_weak_components(edges):
    got = {r["id"]: r["component"] for r in components.weak_components(edges, graph.vertices(edges)).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "a", "f": "a", "e": "e", "x": "x", "y": "x"}


def test_long_chain_is_one_component(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)], "src long, dst long")
    assert {r["component"] for r in components.connected_components(chain).collect()} == {0}


@pytest.mark.parametrize("execution", ["auto", "broadcast", "shuffle"])
def test_fixed_iterations(hand, execution):
    got = as_dict(P.fixed(hand, 10, execution=execution))
    assert got == pytest.approx(AFTER_10, abs=1e-9) and sum(got.values()) == pytest.approx(1)


def test_convergence_does_not_depend_on_the_block(hand):
    for block in (4, 7):
        got = P.converge(hand, RankConfig(block=block))
        assert got.iterations == 25 and len(got.deltas) == 25
        assert as_dict(got.ranks) == pytest.approx(CONVERGED, abs=1e-9)
    assert got.deltas[0] == pytest.approx(0.425)
    assert P.converge(hand, RankConfig(norm="linf", max_iterations=1)).deltas == [pytest.approx(0.1328125)]


def test_no_iteration_gives_the_start_and_no_edges_no_rows(spark, hand):
    assert set(as_dict(P.converge(hand, RankConfig(max_iterations=0)).ranks).values()) == {0.125}
    empty = spark.createDataFrame([], "src string, dst string")
    assert P.fixed(P.Graph.of(empty), 3).count() == 0


def test_warm_start_from_the_full_result_needs_one_step(hand):
    full = P.converge(hand, RankConfig(threshold=1e-12)).ranks
    again = incremental.warm(hand, full, RankConfig(threshold=1e-6))
    assert again.iterations == 1
    assert as_dict(again.ranks) == pytest.approx(as_dict(full), abs=1e-9)


def test_localised_with_all_vertices_is_warm(spark, hand):
    start = spark.createDataFrame([("a", 0.5), ("b", 0.5), ("gone", 3.0)], "id string, rank double")
    warm = as_dict(incremental.warm_fixed(hand, start, 3))
    local = as_dict(incremental.localised_fixed(hand, start, hand.vertices.select("id"), 3))
    assert local == pytest.approx({k: v / sum(warm.values()) for k, v in warm.items()}, abs=1e-12)


def test_localised_keeps_the_others(spark, hand):
    start = spark.createDataFrame([(v, 0.125) for v in "abcdefxy"], "id string, rank double")
    dirty = spark.createDataFrame([("c",), ("a",)], "id string")
    got, r = as_dict(incremental.localised_fixed(hand, start, dirty, 7)), dict.fromkeys("abcdefxy", 0.125)
    for _ in range(7):
        base = 0.15 / 8 + 0.85 * (r["f"] + r["y"]) / 8
        r |= {"c": base + 0.85 * (r["a"] / 2 + r["b"] + r["d"] / 2), "a": base + 0.85 * r["c"]}
    assert got == pytest.approx({k: v / sum(r.values()) for k, v in r.items()}, abs=1e-12)


def test_deltas(spark, edges):
    more = edges.union(spark.createDataFrame([("a", "f"), ("n", "a"), ("n", "m")], "src string, dst string"))
    change = incremental.delta(edges, more)
    ids = lambda frame: {r["id"] for r in frame.collect()}
    assert ids(change.new_sources) == {"n"} and ids(change.new_targets) == {"m"} and ids(change.affected) == {"a"}
    assert {tuple(r) for r in change.new_edges.collect()} == {("a", "f"), ("n", "a"), ("n", "m")}
    assert tuple(change.summary.first()) == (8, 10, 2, 8, 11, 3)
    grown = P.Graph.of(more)
    assert ids(incremental.dirty_set(change, grown, 0)) == {"n", "m", "a", "f"} == ids(incremental.dirty_seed(change, grown.vertices))
    assert ids(incremental.dirty_set(change, grown, 1)) == {"n", "m", "a", "f", "b", "c"}
    nothing = incremental.delta(edges, edges)
    assert nothing.new_edges.count() == 0 and tuple(nothing.summary.first())[2] == 0


def test_accuracy_and_validation(spark, hand):
    full = P.fixed(hand, 10)
    assert tuple(metrics.accuracy(full, full).first()) == (0, 0, 0, 0)
    other = spark.createDataFrame([("nowhere", 1.0)], "id string, rank double")
    row = metrics.accuracy(full, other).first()
    assert row["max_abs_diff"] == float("inf") and row["missing"] == 8
    assert metrics.accuracy(full.limit(0), other).first()["l1"] == 0
    assert metrics.validate(full, full).first()["valid"] and not metrics.validate(full, other).first()["valid"]
    assert metrics.gini(P.converge(hand).ranks).first()["gini"] == pytest.approx(0.41504, abs=1e-5)


@pytest.mark.parametrize("k", [1, 2, 3, 7])
def test_edge_balanced_is_greedy(spark, k):
    rng = np.random.default_rng(k)
    works = [int(w) for w in rng.zipf(1.7, 300).clip(1, 500)]
    nodes = spark.createDataFrame([(str(i), i, w) for i, w in enumerate(works)], "id string, vid long, work long")
    heap, want = [(0, p) for p in range(k)], {}
    for i in sorted(range(300), key=lambda i: (-works[i], i)):
        load, part = heapq.heappop(heap)
        want[i] = part
        heapq.heappush(heap, (load + works[i], part))
    assert {r["vid"]: r["part"] for r in partitioning.assign(nodes, " Edge_Balanced ", k).collect()} == want


def test_edge_balanced_plan_stays_short():
    plan = partitioning._greedy([(300_000, 1), (1, 200_000)], 8)
    assert len(plan) <= 16 and all(len(cycle) <= 8 for *_, cycle in plan)
    assert [end for _, _, end, _ in plan][-1] == 200_001
    assert partitioning._greedy([], 4) == []


def test_gini_of_ties_and_nothing(spark):
    rows = spark.createDataFrame([(i, 1.0) for i in range(50)], "id long, rank double")
    assert metrics.gini(rows).first()["gini"] == pytest.approx(0)
    row = metrics.gini(rows.limit(0)).first()
    assert (row["gini"], row["n"], row["total"]) == (0, 0, 0)
    skew = rows.withColumn("rank", F.when(F.col("id") == 0, 1.0).otherwise(0.0))
    assert metrics.gini(skew).first()["gini"] == pytest.approx(0.98)


def test_both_parsers_read_anchors_alike(spark):
    rows = spark.createDataFrame([(f"http://h/{i}", html) for i, html in WRITTEN], "url string, html string")
    told = [{r["url"]: r["links"] for r in with_links(rows, ExtractConfig(parser=p)).collect()} for p in ("regex", "html")]
    assert told[0] == told[1] and sum(map(len, told[0].values())) == 10
    many = "<a " + "x='y' " * 20_000 + "href=/end>" + "<a " * 5000
    assert [r["x"] for r in spark.createDataFrame([(many,)], "html string").select(raw_links(F.col("html")).alias("x")).collect()] == [["/end"]]


def test_partitions(spark):
    nodes = spark.createDataFrame([(str(i), i, 1) for i in range(7)], "id string, vid long, work long")
    assert [r["part"] for r in partitioning.by_range(nodes, 3).orderBy("vid").collect()] == [0, 0, 1, 1, 2, 2, 2]
    assert [r["part"] for r in partitioning.by_range(nodes, 9).orderBy("vid").collect()] == list(range(7))
    row = partitioning.diagnostics(partitioning.by_hash(nodes, 9), 9).first()
    assert (row["min_size"], row["max_size"], row["work_imbalance"]) == (0, 1, 1)
    for bad in (lambda: partitioning.assign(nodes, "spiral", 2), lambda: partitioning.by_hash(nodes, 0), lambda: partitioning.assign(nodes.drop("work"), "edge_balanced", 2)):
        with pytest.raises(ValueError):
            bad()


def test_links(spark):
    html = '<a class="x" href=" /b?q#f ">1</a><a href="#top"></a><A href="">2</A><a href="mailto:x@y"></a><a href="../c">3</a><a href="/b">4</a><a href="http://other.org/d;p">5</a>'
    pages = spark.createDataFrame([("http://h.com/x/y", html), ("http://h.com/n", None), ("http://h.com/e", "")], "url string, html string")
    links = lambda **c: [r["links"] for r in with_links(pages, ExtractConfig(**c)).collect()]
    want = ["http://h.com/b", "http://h.com/c", "http://other.org/d;p"]
    assert links() == [want, [], []] == links(parser="html")
    assert links(max_links=2)[0] == want[:2] and links(domain="h.com")[0] == want[:2] and links(domain="h.co", exact_host=True)[0] == []


def test_growth_step_skips_what_is_known(spark):
    pages = spark.createDataFrame([(i, f"http://h.com/{i}", f'<a href="/{i + 1}">') for i in range(6)], "page_id long, url string, html string")
    first = graph.multigraph(growth.page_slice(pages, 0, 0.5))
    cache = spark.createDataFrame([("http://h.com/4", ["http://h.com/cached"])], "url string, links array<string>").selectExpr("substring(sha1(url), 1, 16) AS key", "url", "links")
    step = growth.grow(first, pages, cache)
    assert step.stats.first().asDict() == {"fetched": 3, "failed": 0, "links": 3, "cache_hits": 1, "cache_misses": 2, "skipped": 3}
    assert ("http://h.com/4", "http://h.com/cached") in {tuple(r) for r in step.edges.collect()}
    assert step.edges.count() == 6 and step.cached.count() == 2 and step.delta.affected.count() == 0


def test_growth_step_takes_each_pages_own_links(spark):
    pages = spark.createDataFrame([(i, "http://h.com/same", f'<a href="/{i}">') for i in range(4)], "page_id long, url string, html string")
    cache = spark.createDataFrame([(i, "http://h.com/same", [f"http://h.com/{i}"]) for i in (0, 1, 3)], "page_id long, url string, links array<string>").selectExpr("substring(sha1(url), 1, 16) AS key", "url", "links", "page_id")
    step = growth.grow(graph.multigraph(pages.limit(0)), pages, cache)
    assert sorted(r["dst"] for r in step.edges.collect()) == [f"http://h.com/{i}" for i in range(4)] == sorted(r["dst"] for r in step.delta.new_edges.collect())
    assert [(r["page_id"], r["links"]) for r in step.cached.collect()] == [(2, ["http://h.com/2"])]


def test_generator(spark):
    small, large = (g.toPandas() for g in synthetic.series(spark, (1500, 3000)))
    pairs = lambda f: set(map(tuple, f.to_numpy()))
    assert pairs(small) <= pairs(large) and len(pairs(large)) == len(large)
    assert (large["src"] != large["dst"]).all() and large.groupby("src").size().max() == 4
    assert (large["dst"] < large["src"]).all()
    degree = large.groupby("dst").size().sort_values()
    assert degree.iloc[-30:].sum() > 0.1 * len(large)  # few vertices hold much
    assert 0.03 < 1 - large["src"].nunique() / 3000 < 0.08
    assert 0.8 < (large["src"] % 64 == large["dst"] % 64)[large["src"] > 640].mean() < 0.95
