"""Every query of the catalog that has SQL returns DuckDB's rows."""

import duckdb
import pytest

from linkloom.operators.pagerank import Graph
from linkloom.plans import catalog
from linkloom.plans.catalog import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for table in ("pages", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    return con


def rows(frame):
    columns = sorted(frame.columns)
    return columns, frame[columns].sort_values(columns).reset_index(drop=True).astype(str).to_numpy().tolist()


def test_converged_web_is_not_capped(spark, monkeypatch):
    pairs = [(i, i + 1) for i in range(40)] + [(40, 0), (0, 20)]
    graph = Graph.of(spark.createDataFrame(pairs, "src long, dst long"))
    monkeypatch.setattr(catalog, "_web_graph", lambda spark, sf_dir: graph)
    got = catalog.pagerank_converged_web(spark, DATA).select("iterations").distinct().collect()
    assert len(got) == 1 and 12 < got[0][0] < 100


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name in ORACLES:
        assert rows(got) == rows(db.execute(ORACLES[name]).df())
    else:
        assert len(got)
