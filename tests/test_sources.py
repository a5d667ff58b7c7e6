"""Readers, writers, streaming growth, and the entry without optional parts."""

import json
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from linkloom.operators import incremental
from linkloom.operators import pagerank as P
from linkloom.plans import runs
from linkloom.sources import readers, writers
from linkloom.streaming.growth import grow_stream


def test_index_lines(spark, tmp_path):
    good = {"url": "http://a/", "filename": "w", "offset": "3", "length": "4", "status": "200", "mime": "text/html"}
    lines = ["", json.dumps(good), "{broken", json.dumps(good | {"status": "404"}), json.dumps({k: v for k, v in good.items() if k != "length"}), json.dumps(good | {"offset": "x"})]
    (tmp_path / "index.jsonl").write_text("\n".join(lines))
    rows = readers.cdx(spark, str(tmp_path / "index.jsonl")).collect()
    assert [(r["url"], r["offset"], r["length"]) for r in rows] == [("http://a/", 3, 4)]


def test_archive_records(spark, tmp_path):
    record = b"WARC/1.0\r\nWARC-Type: response\r\n\r\nHTTP/1.1 200 OK\r\n\r\n<p>\xe9</p>\r\n\r\n"
    (tmp_path / "w").write_bytes(b"junk" + record)
    rows = spark.createDataFrame([("u", "w", 4, len(record)), ("v", "missing", 0, 1)], "url string, filename string, offset long, length long")
    got = {r["url"]: r["html"] for r in readers.warc_pages(rows, str(tmp_path), attempts=1).collect()}
    assert got == {"u": "<p>é</p>", "v": None}
    assert readers.warc_html(b"") is None and readers.warc_html(None) is None


def test_retries():
    waits, calls = [], []

    def fail():
        calls.append(1)
        raise OSError

    assert readers.with_retries(fail, 3, waits.append) is None and waits == [1, 2] and len(calls) == 3


def test_mock_crawl_is_reproducible(spark):
    links = lambda: [r["links"] for r in readers.mock_links(readers.mock_cdx(spark, 20)).orderBy("url").collect()]
    assert links() == links() and all(5 <= len(x) == len(set(x)) <= 15 for x in links())


def test_graph_files(spark, tmp_path):
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c")], "src string, dst string")
    writers.edges_csv(edges, f"{tmp_path}/csv")
    assert readers.snapshot(spark, f"{tmp_path}/csv", "csv").count() == 3
    (tmp_path / "adj.json").write_text(json.dumps({"a": ["b", "b"], "b": ["c"], "z": []}))
    assert sorted(map(tuple, readers.snapshot(spark, f"{tmp_path}/adj.json", "json").collect())) == [("a", "b"), ("a", "b"), ("b", "c")]
    writers.adjacency_json(edges, f"{tmp_path}/adj")
    assert spark.read.json(f"{tmp_path}/adj").count() == 2
    for number, rows in ((0, edges), (1, edges.limit(1)), (0, edges)):
        writers.snapshot(rows, f"{tmp_path}/table", number)
    assert readers.version(spark, f"{tmp_path}/table", 0).count() == 2 and readers.version(spark, f"{tmp_path}/table", 1).count() == 1
    with pytest.raises(ValueError):
        readers.snapshot(spark, "x", "pickle")
    writers.delta(incremental.delta(edges.limit(1), edges), f"{tmp_path}/delta")
    assert spark.read.parquet(f"{tmp_path}/delta/new_edges").count() == 1


def test_scores_and_cache(spark, tmp_path):
    ranks = P.fixed(P.Graph.of(spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")), 2)
    writers.scores(ranks, f"{tmp_path}/s")
    assert readers.scores(spark, f"{tmp_path}/s/scores").count() == 3
    (tmp_path / "s.json").write_text('{"a": 0.5, "b": 0.25}')
    assert {r["id"]: r["rank"] for r in readers.scores(spark, f"{tmp_path}/s.json").collect()} == {"a": 0.5, "b": 0.25}
    (tmp_path / "c1.json").write_text(json.dumps({"url": "http://a/", "links": ["http://b/"]}))
    (tmp_path / "c2.json").write_text("{corrupt")
    assert [r["url"] for r in readers.link_cache(spark, f"{tmp_path}/c*.json").collect()] == ["http://a/"]
    for entry in (("http://x/", ["http://y/"]), ("http://z/", []), ("http://w/", ["http://x/", "http://x/"])):
        writers.cache(spark.createDataFrame([entry], "url string, links array<string>"), f"{tmp_path}/cache")
    writers.cache(spark.createDataFrame([("http://p/", []), ("http://q/", [])], "url string, links array<string>").coalesce(1), f"{tmp_path}/cache")
    (tmp_path / "cache" / "own.json").write_text(json.dumps({"url": "http://m/", "links": ["http://n/"]}, indent=1))
    assert sorted(r["url"] for r in readers.link_cache(spark, f"{tmp_path}/cache").collect()) == [f"http://{x}/" for x in "mpqwxz"]
    edges = [("a", "b"), ("a", "b"), ("a", "c"), ("d", "a")]
    writers.adjacency_json(spark.createDataFrame(edges, "src string, dst string"), f"{tmp_path}/adjacency")
    assert sorted(map(tuple, readers.adjacency_json(spark, f"{tmp_path}/adjacency").collect())) == edges
    made = []
    table = f"{tmp_path}/made"
    for _ in range(2):
        readers.read_or_create(spark, table, lambda: made.append(1) or spark.range(3))
    assert made == [1]
    with pytest.raises(FileNotFoundError):
        readers.read_or_create(spark, f"{tmp_path}/none", lambda: None)


def test_run_stats(tmp_path):
    stats = runs.RunStats("r", {"k": 1}, [runs.Iteration(1, 1.0, 0.5, 8, task_times_s=[1.0, 3.0]), runs.Iteration(2, 3.0, 0.1, 8)], {}, 4.0)
    writers.run_stats(stats, str(tmp_path))
    told = json.loads((tmp_path / "metrics.json").read_text())
    assert told["num_iterations"] == 2 and told["total_comm_bytes"] == 16 and told["final_delta"] == 0.1
    assert told["iterations"][0]["load_imbalance"] == pytest.approx(2 / 3) and told["iterations"][1]["task_std_s"] == 0
    assert len((tmp_path / "iteration_log.csv").read_text().splitlines()) == 3


def test_stream_grows_a_table(spark, tmp_path):
    pages = spark.createDataFrame([(f"http://h/{i}", f'<a href="/{i + 1}">') for i in range(3)], "url string, html string")
    pages.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("url string, html string").parquet(f"{tmp_path}/in")
    for _ in range(2):
        grow_stream(stream, f"{tmp_path}/edges", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/edges").count() == 3
    pages.union(spark.createDataFrame([("http://h/9", '<a href="/1">')], pages.schema)).write.mode("append").parquet(f"{tmp_path}/in")
    grow_stream(stream, f"{tmp_path}/edges", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/edges").where(F.col("src") == "http://h/9").count() == 1
    assert spark.read.parquet(f"{tmp_path}/edges").count() == 4


def test_entry_without_the_optional_parts(tmp_path):
    root = Path(__file__).resolve().parent.parent
    code = "import sys\nsys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e\nassert 'pagerank_web_10' in e.queries() and not any(k.startswith('op1_') for k in e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True).returncode == 0
