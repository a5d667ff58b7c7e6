"""Every query of the library by name, with DuckDB SQL for its rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ExtractConfig, RankConfig
from ..functions import scalars as S
from ..functions import urls as U
from ..functions.links import raw_links, with_links
from ..lineage import cut
from ..operators import graph as G
from ..operators import growth, incremental, metrics, partitioning, synthetic
from ..operators import pagerank as P
from ..operators.components import weak_components
from ..sources import readers, writers
from . import oracles as O
from .graphs import SHARES, pages, trade, web, web_multigraph

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DIGITS = 10
#: Iterations in the SQL of converged ranks; the queries themselves run to the default of 100.
UNROLLED = 24


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _rounded(ranks: DataFrame, digits: int = DIGITS) -> DataFrame:
    return ranks.select("id", F.round("rank", digits).alias("rank"))


def _sql_ranks(graph: str, steps: int, damping: float = 0.85) -> str:
    return f"WITH {graph}, {O.ranks(steps, damping)} SELECT id, round(rank, {DIGITS}) AS rank FROM r{steps}"


def _web_graph(spark, sf_dir) -> P.Graph:
    return P.Graph.of(web(spark, sf_dir))


def _trade_graph(spark, sf_dir) -> P.Graph:
    return P.Graph.of(trade(spark, sf_dir))


# Links


@query(f"WITH {O.LINKS} SELECT src AS url, CAST(pos AS INTEGER) AS pos, href FROM links")
def links_extracted(spark, sf_dir):
    return pages(spark, sf_dir).select("url", F.posexplode(raw_links(F.col("html"))).alias("at", "href")).select("url", (F.col("at") + 1).alias("pos"), "href")


#: Forms of anchors: quotes, spaces, entities, comments and scripts, tags in attributes, other tags and names.
WRITTEN = (
    (1, "<a href='/one'>1</a><A HREF=/two>2</A><a href = \"/three\">3</a>"),
    (2, '<a title="x > y" href="/four">4</a><a\nclass=b\nhref="/five?a=1&amp;b=2">5</a>'),
    (3, '<!-- <a href="/hidden"> --><a href="/six">6</a><script>"<a href=/no>"</script><!-- <a href="/open">'),
    (4, "<abbr href='/no'><a data-href='/no' href='/seven'><a hrefx='/no'><link href='/no'><a name=x>"),
    (5, "<a href=\"it's\"><a href='say &quot;hi&quot; &lt;&amp;lt;'><a href='' ><a id='k' href=/eight/>"),
)


def _sql_written() -> str:
    rows = ", ".join(f"({i}, '{html.replace(chr(39), chr(39) * 2)}')" for i, html in WRITTEN)
    return r"""SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) AS INTEGER) AS pos,
            replace(replace(replace(replace(CASE WHEN v[1] IN ('"', '''') THEN v[2:len(v) - 1] ELSE v END, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS href
        FROM (SELECT page_id, unnest(found) AS v, unnest(range(len(found))) AS i FROM (
            SELECT page_id, regexp_extract_all(regexp_replace(html, '(?is)<!--.*?(-->|\z)|<script\b.*?</script>', '', 'g'),
                '(?i)<a(?:\s(?:[^>"'']|"[^"]*"|''[^'']*'')*?)?\shref\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>][^\s>]*)', 1) AS found
            FROM (VALUES """ + rows + ") t(page_id, html)))"


@query(_sql_written())
def links_written_by_hand(spark, sf_dir):
    """The forms in which people write anchors, beyond what the tables' pages hold."""
    rows = spark.createDataFrame(WRITTEN, "page_id int, html string")
    return rows.select("page_id", F.posexplode(raw_links(F.col("html"))).alias("at", "href")).select("page_id", (F.col("at") + 1).alias("pos"), "href")


def _placed(rows: DataFrame) -> DataFrame:
    return rows.select("url", F.posexplode("links").alias("at", "target")).select("url", (F.col("at") + 1).alias("place"), "target")


@query(f"WITH {O.LINKS} SELECT src AS url, CAST(place AS INTEGER) AS place, dst AS target FROM targets")
def links_normalised(spark, sf_dir):
    return _placed(with_links(pages(spark, sf_dir)))


@query(f"WITH {O.LINKS} SELECT src AS url, CAST(place AS INTEGER) AS place, dst AS target FROM targets")
def links_html_parser(spark, sf_dir):
    return _placed(with_links(pages(spark, sf_dir), ExtractConfig(parser="html")))


@query(f"WITH {O.LINKS} SELECT src AS url, CAST(place AS INTEGER) AS place, dst AS target FROM targets WHERE place <= 3")
def links_capped(spark, sf_dir):
    return _placed(with_links(pages(spark, sf_dir), ExtractConfig(max_links=3)))


@query(f"""WITH {O.LINKS} SELECT src AS url, CAST(row_number() OVER (PARTITION BY page_id ORDER BY place) AS INTEGER) AS place, dst AS target
    FROM targets WHERE contains(regexp_extract(dst, '^[a-zA-Z]+://([^/?#]*)', 1), 'example.org')""")
def links_domain_filtered(spark, sf_dir):
    return _placed(with_links(pages(spark, sf_dir), ExtractConfig(domain="example.org")))


@query("SELECT url, regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1) AS netloc, regexp_replace(url, '[?#].*$', '') AS normalised, substr(sha1(url), 1, 16) AS cache_key FROM pages")
def url_functions(spark, sf_dir):
    url = F.col("url")
    return pages(spark, sf_dir).select("url", U.netloc(url).alias("netloc"), U.without_query(url).alias("normalised"), U.cache_key(url).alias("cache_key"))


@query("""SELECT * FROM (VALUES ('http://h.x/a/b/c', 'd', 'http://h.x/a/b/d'), ('http://h.x/a/b/c', '../d', 'http://h.x/a/d'), ('http://h.x/a/b/c', '/d/./e', 'http://h.x/d/e'),
    ('http://h.x/a/b/c', '//o.x/d', 'http://o.x/d'), ('http://h.x/a/b/c', '?q=1', 'http://h.x/a/b/c'), ('http://h.x/a/b/c', '../../../d', 'http://h.x/d'),
    ('http://h.x', 'd', 'http://h.x/d'), ('http://h.x/a', 'https://o.x/d?q#f', 'https://o.x/d'), ('http://h.x/a/b/', '..', 'http://h.x/a/')) t(base, href, resolved)""")
def url_resolution(spark, sf_dir):
    rows = [("http://h.x/a/b/c", h) for h in ("d", "../d", "/d/./e", "//o.x/d", "?q=1", "../../../d")] + [("http://h.x", "d"), ("http://h.x/a", "https://o.x/d?q#f"), ("http://h.x/a/b/", "..")]
    return spark.createDataFrame(rows, "base string, href string").select("base", "href", U.resolve(F.col("base"), F.col("href")).alias("resolved"))


# Graphs


@query(f"WITH {O.LINKS} SELECT src, dst FROM targets")
def edges_multigraph(spark, sf_dir):
    return web_multigraph(spark, sf_dir)


@query(f"WITH {O.WEB} SELECT src, dst FROM edges")
def edges_distinct(spark, sf_dir):
    return web(spark, sf_dir)


@query(f"WITH {O.trade()} SELECT src, dst FROM edges")
def edges_trade(spark, sf_dir):
    return trade(spark, sf_dir)


@query(f"WITH {O.WEB}, {O.nodes()} SELECT id FROM v")
def vertices(spark, sf_dir):
    return G.vertices(web(spark, sf_dir))


@query(f"WITH {O.WEB}, {O.nodes()} SELECT id, row_number() OVER (ORDER BY id) - 1 AS vid FROM v")
def vertex_ids(spark, sf_dir):
    return G.vertex_ids(G.vertices(web(spark, sf_dir)))


@query(f"WITH {O.trade()} SELECT src AS id, count(*) AS out_degree FROM edges GROUP BY src")
def out_degree(spark, sf_dir):
    return G.out_degrees(trade(spark, sf_dir))


@query(f"WITH {O.trade()} SELECT dst AS id, count(*) AS in_degree FROM edges GROUP BY dst")
def in_degree(spark, sf_dir):
    return G.in_degrees(trade(spark, sf_dir))


@query(f"""WITH {O.WEB}, {O.nodes()} SELECT id, coalesce(o.c, 0) AS out_degree, coalesce(i.c, 0) AS in_degree FROM v
    LEFT JOIN (SELECT src, count(*) AS c FROM edges GROUP BY src) o ON o.src = id LEFT JOIN (SELECT dst, count(*) AS c FROM edges GROUP BY dst) i ON i.dst = id""")
def degrees(spark, sf_dir):
    return G.degrees(web(spark, sf_dir))


@query(f"WITH {O.WEB}, {O.nodes()} SELECT id FROM v WHERE id NOT IN (SELECT src FROM edges)")
def dangling_nodes(spark, sf_dir):
    return G.degrees(web(spark, sf_dir)).where("out_degree = 0").select("id")


@query(f"WITH {O.LINKS} SELECT src AS source, array_to_string(list(dst ORDER BY dst), ' ') AS targets FROM targets GROUP BY src")
def adjacency(spark, sf_dir):
    return G.adjacency(web_multigraph(spark, sf_dir)).select("source", F.array_join("targets", " ").alias("targets"))


@query(f"WITH {O.LINKS} SELECT src, dst FROM targets")
def adjacency_round_trip(spark, sf_dir):
    return G.from_adjacency(G.adjacency(web_multigraph(spark, sf_dir)))


_STATS = """SELECT (SELECT count(*) FROM v) AS nodes, (SELECT count(*) FROM edges) AS edges,
    (SELECT max(c) FROM (SELECT count(*) AS c FROM edges GROUP BY dst)) AS max_in_degree, (SELECT max(c) FROM (SELECT count(*) AS c FROM edges GROUP BY src)) AS max_out_degree,
    (SELECT count(*) FROM v WHERE id NOT IN (SELECT src FROM edges)) AS dangling"""


@query(f"WITH {O.WEB}, {O.nodes()} {_STATS}")
def graph_stats(spark, sf_dir):
    return G.graph_stats(web(spark, sf_dir))


@query(f"WITH {O.trade()}, {O.nodes()} {_STATS}")
def graph_stats_trade(spark, sf_dir):
    return G.graph_stats(trade(spark, sf_dir))


@query(f"WITH {O.LINKS} SELECT count(DISTINCT src) AS sources, count(*) AS edges, count(*) / count(DISTINCT src) AS avg_out_degree FROM targets")
def web_graph_summary(spark, sf_dir):
    return G.multigraph_stats(web_multigraph(spark, sf_dir))


_REACH = f"""WITH RECURSIVE {O.WEB}, {O.nodes()}, both_ways AS MATERIALIZED (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
    reach(id, other) AS (SELECT id, id FROM v UNION SELECT r.id, b.b FROM reach r JOIN both_ways b ON b.a = r.other),
    labels AS (SELECT id, min(other) AS component FROM reach GROUP BY id)"""


@query(f"{_REACH} SELECT id, component FROM labels")
def wcc_labels(spark, sf_dir):
    edges = web(spark, sf_dir)
    return weak_components(edges, G.vertices(edges))


@query(f"{_REACH} SELECT count(*) AS components, max(c) AS largest FROM (SELECT count(*) AS c FROM labels GROUP BY component)")
def wcc_count(spark, sf_dir):
    return wcc_labels(spark, sf_dir).groupBy("component").agg(F.count("*").alias("c")).agg(F.count("*").alias("components"), F.max("c").alias("largest"))


@query(f"WITH {O.LINKS}, first AS (SELECT DISTINCT src FROM targets ORDER BY src LIMIT 3) SELECT src AS source, array_to_string(list(dst ORDER BY dst)[1:3], ' ') AS targets FROM targets WHERE src IN (SELECT src FROM first) GROUP BY src")
def sample_pages(spark, sf_dir):
    first = G.adjacency(web_multigraph(spark, sf_dir)).orderBy("source").limit(3)
    return first.select("source", F.array_join(F.slice("targets", 1, 3), " ").alias("targets"))


# PageRank


@query(_sql_ranks(O.WEB, 10))
def pagerank_web_10(spark, sf_dir):
    return _rounded(P.fixed(_web_graph(spark, sf_dir), 10))


@query(_sql_ranks(O.trade(), 10))
def pagerank_trade_10(spark, sf_dir):
    return _rounded(P.fixed(_trade_graph(spark, sf_dir), 10))


@query(_sql_ranks(O.trade(), 5, 0.5))
def pagerank_d050(spark, sf_dir):
    return _rounded(P.fixed(_trade_graph(spark, sf_dir), 5, 0.5))


@query(_sql_ranks(O.WEB, 5, 0.99))
def pagerank_d099(spark, sf_dir):
    return _rounded(P.fixed(_web_graph(spark, sf_dir), 5, 0.99))


@query(_sql_ranks(O.trade(), 5))
def pagerank_broadcast(spark, sf_dir):
    return _rounded(P.fixed(_trade_graph(spark, sf_dir), 5, execution="broadcast"))


@query(_sql_ranks(O.trade(), 5))
def pagerank_shuffle(spark, sf_dir):
    return _rounded(P.fixed(_trade_graph(spark, sf_dir), 5, execution="shuffle"))


def _sql_converged(graph: str, most: int, norm: str) -> str:
    """The iterate after the first small change, of at most ``most``."""
    picked = " UNION ALL ".join(f"SELECT {t} AS iterations, id, rank FROM r{t}" for t in range(1, most + 1))
    return f"""WITH {graph}, {O.ranks(most)}, d AS ({O.changes(most, norm)}), stop AS (SELECT coalesce(min(iteration) FILTER (WHERE delta < 1e-6), {most}) AS t FROM d)
        SELECT id, round(rank, {DIGITS}) AS rank, iterations FROM ({picked}) WHERE iterations = (SELECT t FROM stop)"""


def _converged(graph: P.Graph, norm: str) -> DataFrame:
    got = P.converge(graph, RankConfig(norm=norm))
    return _rounded(got.ranks).withColumn("iterations", F.lit(got.iterations))


@query(_sql_converged(O.WEB, UNROLLED, "sum"))
def pagerank_converged_web(spark, sf_dir):
    return _converged(_web_graph(spark, sf_dir), "l1")


@query(_sql_converged(O.trade(), UNROLLED, "max"))
def pagerank_converged_trade_linf(spark, sf_dir):
    return _converged(_trade_graph(spark, sf_dir), "linf")


def _changes(spark, sf_dir, norm):
    row = P.changes(P.iterate(_trade_graph(spark, sf_dir), 6), 6, norm)
    return row.select(F.posexplode(F.array(*[f"d{t}" for t in range(1, 7)])).alias("at", "d")).select((F.col("at") + 1).alias("iteration"), F.round("d", 12).alias("delta"))


@query(f"WITH {O.trade()}, {O.ranks(6)} {O.changes(6, 'sum')}")
def pagerank_deltas_l1(spark, sf_dir):
    return _changes(spark, sf_dir, "l1")


@query(f"WITH {O.trade()}, {O.ranks(6)} {O.changes(6, 'max')}")
def pagerank_deltas_linf(spark, sf_dir):
    return _changes(spark, sf_dir, "linf")


@query(f"WITH {O.WEB}, {O.ranks(5)} SELECT round(sum(rank), {DIGITS}) AS dangling_mass FROM r5 WHERE id NOT IN (SELECT src FROM od)")
def dangling_mass(spark, sf_dir):
    graph = _web_graph(spark, sf_dir)
    dangling = graph.vertices.where("out_degree = 0").select("id")
    return P.fixed(graph, 5).join(dangling, "id", "left_semi").agg(F.round(F.sum("rank"), DIGITS).alias("dangling_mass"))


@query(f"WITH {O.WEB}, {O.ranks(5)} SELECT round(sum(rank), 9) AS rank_sum, count(*) AS n FROM r5")
def rank_sum(spark, sf_dir):
    return P.fixed(_web_graph(spark, sf_dir), 5).agg(F.round(F.sum("rank"), 9).alias("rank_sum"), F.count("*").alias("n"))


def _sql_top(n: int) -> str:
    return f"WITH {O.WEB}, {O.ranks(10)} SELECT id, round(rank, {DIGITS}) AS rank FROM r10 ORDER BY 2 DESC, 1 LIMIT {n}"


@query(_sql_top(10))
def top10(spark, sf_dir):
    return P.top(P.fixed(_web_graph(spark, sf_dir), 10), 10)


@query(_sql_top(1000))
def top1000(spark, sf_dir):
    return P.top(P.fixed(_web_graph(spark, sf_dir), 10), 1000)


@query(f"WITH {O.WEB}, {O.ranks(5)}, t AS (SELECT round(sum(rank), 9) AS rank_sum, count(*) AS node_count FROM r5) SELECT id, round(rank, 9) AS rank, rank_sum, node_count FROM (SELECT id, round(rank, 15) AS rank FROM r5 ORDER BY round(rank, 15) DESC, id LIMIT 20), t")
def top_scores_payload(spark, sf_dir):
    rows = writers.top_scores(P.fixed(_web_graph(spark, sf_dir), 5), 20)
    return rows.select("id", F.round("rank", 9).alias("rank"), F.round("rank_sum", 9).alias("rank_sum"), "node_count")


@query(f"WITH {O.trade()}, {O.ranks(5)} SELECT id, rank FROM (SELECT id, round(rank, {DIGITS}) AS rank FROM r5) ORDER BY rank DESC, id LIMIT 1")
def argmax(spark, sf_dir):
    ranks = _rounded(P.fixed(_trade_graph(spark, sf_dir), 5))
    return ranks.agg(F.min(F.struct((-F.col("rank")).alias("low"), "id")).alias("m")).select("m.id", (-F.col("m.low")).alias("rank"))


@query(f"""WITH {O.trade()}, {O.ranks(5)} SELECT round(2 * sum(i * rank) / (count(*) * sum(rank)) - (count(*) + 1) / count(*), 9) AS gini, count(*) AS n, round(sum(rank), 9) AS total
    FROM (SELECT rank, row_number() OVER (ORDER BY rank) AS i FROM r5)""")
def gini(spark, sf_dir):
    return metrics.gini(P.fixed(_trade_graph(spark, sf_dir), 5)).select(F.round("gini", 9).alias("gini"), "n", F.round("total", 9).alias("total"))


# Growth


def _trade_delta(spark, sf_dir) -> incremental.Delta:
    return incremental.delta(trade(spark, sf_dir, 0), trade(spark, sf_dir, 1))


@query(f"WITH {O.DELTA} SELECT id FROM new_sources")
def delta_new_sources(spark, sf_dir):
    return _trade_delta(spark, sf_dir).new_sources


@query(f"WITH {O.DELTA} SELECT id FROM new_targets")
def delta_new_targets(spark, sf_dir):
    return _trade_delta(spark, sf_dir).new_targets


@query(f"WITH {O.DELTA} SELECT src, dst FROM new_edges")
def delta_new_edges(spark, sf_dir):
    return _trade_delta(spark, sf_dir).new_edges


@query(f"WITH {O.DELTA} SELECT id FROM affected")
def delta_affected(spark, sf_dir):
    return _trade_delta(spark, sf_dir).affected


@query(f"""WITH {O.DELTA}, c AS (SELECT (SELECT count(*) FROM old_v) AS a, (SELECT count(*) FROM new_v) AS b, (SELECT count(*) FROM old) AS c, (SELECT count(*) FROM new) AS d)
    SELECT a AS prev_node_count, b AS new_node_count, b - a AS added_nodes, c AS prev_edge_count, d AS new_edge_count, d - c AS added_edges FROM c""")
def delta_summary(spark, sf_dir):
    return _trade_delta(spark, sf_dir).summary


_ADDED = "added AS (SELECT id FROM new_v EXCEPT SELECT id FROM old_v)"


def _trade_delta2(spark, sf_dir) -> incremental.Delta:
    return incremental.delta_of_graphs(trade(spark, sf_dir, 0), trade(spark, sf_dir, 1))


@query(f"WITH {O.DELTA}, {_ADDED} SELECT id FROM added WHERE id IN (SELECT src FROM new)")
def delta2_new_sources(spark, sf_dir):
    return _trade_delta2(spark, sf_dir).new_sources


@query(f"WITH {O.DELTA}, {_ADDED} SELECT id FROM added WHERE id IN (SELECT dst FROM new)")
def delta2_new_targets(spark, sf_dir):
    return _trade_delta2(spark, sf_dir).new_targets


@query(f"WITH {O.DELTA} SELECT DISTINCT src AS id FROM new_edges WHERE src IN (SELECT id FROM old_v)")
def delta2_affected(spark, sf_dir):
    return _trade_delta2(spark, sf_dir).affected


@query(f"WITH {O.DELTA}, {_ADDED} SELECT (SELECT count(*) FROM old_v) AS prev_nodes, (SELECT count(*) FROM added) AS new_nodes, (SELECT count(*) FROM old) AS prev_edges, (SELECT count(*) FROM new_edges) AS new_edges")
def delta2_summary(spark, sf_dir):
    return _trade_delta2(spark, sf_dir).summary


@query(f"WITH {O.DELTA} SELECT id FROM seed")
def dirty_seed(spark, sf_dir):
    return incremental.dirty_seed(_trade_delta(spark, sf_dir), G.vertices(trade(spark, sf_dir, 1)))


def _dirty(spark, sf_dir, hops):
    return incremental.dirty_set(_trade_delta(spark, sf_dir), P.Graph.of(trade(spark, sf_dir, 1)), hops)


@query(f"WITH {O.DELTA} SELECT id FROM hop1")
def dirty_hop1(spark, sf_dir):
    return _dirty(spark, sf_dir, 1)


@query(f"WITH {O.DELTA} SELECT id FROM hop2")
def dirty_hop2(spark, sf_dir):
    return _dirty(spark, sf_dir, 2)


def _grown(spark, sf_dir):
    """The web's v1, ranks of v0, and what is dirty within one hop."""
    old, new = cut(web(spark, sf_dir, 0)), cut(web(spark, sf_dir, 1))
    graph = P.Graph.of(new).kept()
    previous = cut(P.fixed(P.Graph.of(old), 5))
    return graph, previous, cut(incremental.dirty_set(incremental.delta(old, new), graph, 1))


@query(f"WITH {O.WEB_GROWTH} SELECT id, round(rank, {DIGITS}) AS rank FROM init")
def warm_init(spark, sf_dir):
    graph, previous, _ = _grown(spark, sf_dir)
    return _rounded(incremental.warm_start(graph.vertices, previous))


_WARM = O.ranks(3, edges="new", tag="w", start="init")
_LOCAL = O.ranks(3, edges="new", tag="l", start="init", active="hop1") + ", local AS MATERIALIZED (SELECT id, rank / (SELECT sum(rank) FROM rl3) AS rank FROM rl3)"
_FULL = O.ranks(5, edges="new", tag="f")


@query(f"WITH {O.WEB_GROWTH}, {_WARM} SELECT id, round(rank, {DIGITS}) AS rank FROM rw3")
def warm_pagerank_3(spark, sf_dir):
    graph, previous, _ = _grown(spark, sf_dir)
    return _rounded(incremental.warm_fixed(graph, previous, 3))


@query(f"WITH {O.WEB_GROWTH}, {_LOCAL} SELECT id, round(rank, {DIGITS}) AS rank FROM local")
def localised_pagerank_3(spark, sf_dir):
    graph, previous, dirty = _grown(spark, sf_dir)
    return _rounded(incremental.localised_fixed(graph, previous, dirty, 3))


def _rounded_accuracy(row: DataFrame) -> DataFrame:
    return row.select(*[F.round(c, 12).alias(c) for c in ("max_abs_diff", "l1", "l2")], "missing")


@query(f"WITH {O.WEB_GROWTH}, {_FULL}, {_WARM} {O.accuracy('rw3')}")
def accuracy_warm(spark, sf_dir):
    graph, previous, _ = _grown(spark, sf_dir)
    return _rounded_accuracy(metrics.accuracy(P.fixed(graph, 5), incremental.warm_fixed(graph, previous, 3)))


@query(f"WITH {O.WEB_GROWTH}, {_FULL}, {_LOCAL} {O.accuracy('local')}")
def accuracy_localised(spark, sf_dir):
    graph, previous, dirty = _grown(spark, sf_dir)
    return _rounded_accuracy(metrics.accuracy(P.fixed(graph, 5), incremental.localised_fixed(graph, previous, dirty, 3)))


@query(f"""WITH {O.WEB_GROWTH}, {_FULL} SELECT count(b.id) = count(*) AND max(abs(a.rank - b.rank)) <= 1e-4 AS valid, round(max(abs(a.rank - b.rank)), 9) AS max_abs_diff, count(*) - count(b.id) AS missing
    FROM rf5 a LEFT JOIN rp5 b ON a.id = b.id""")
def validate(spark, sf_dir):
    graph, previous, _ = _grown(spark, sf_dir)
    return metrics.validate(P.fixed(graph, 5), previous).select("valid", F.round("max_abs_diff", 9).alias("max_abs_diff"), "missing")


# Partitions


def _works(spark, sf_dir):
    edges = web(spark, sf_dir)
    nodes = G.degrees(edges).select("id", (F.col("in_degree") + 1).alias("work"))
    return nodes.join(G.vertex_ids(nodes), "id").select("id", "vid", "work")


def _partition_query(strategy: str) -> None:
    def assigned(spark, sf_dir):
        return partitioning.assign(_works(spark, sf_dir), strategy, 4)

    def diagnosed(spark, sf_dir):
        row = partitioning.diagnostics(assigned(spark, sf_dir), 4)
        return row.select(*[F.round(c, DIGITS).alias(c) if c.endswith("imbalance") else c for c in row.columns])

    assigned.__name__, diagnosed.__name__ = f"part_{strategy}", f"part_{strategy}_diag"
    query(O.partition(strategy))(assigned)
    query(O.partition(strategy, diagnose=True))(diagnosed)


for _strategy in partitioning.STRATEGIES:
    _partition_query(_strategy)


# Crawl


@query("""SELECT page_id, url FROM pages, (SELECT min(page_id) AS low, max(page_id) - min(page_id) + 1 AS span FROM pages)
    WHERE page_id >= low + CAST(floor(span * 0.6) AS BIGINT) AND page_id < low + CAST(floor(span * 0.75) AS BIGINT)""")
def page_slice(spark, sf_dir):
    return growth.page_slice(pages(spark, sf_dir), SHARES[0], SHARES[1]).select("page_id", "url")


@query("SELECT page_id, CAST((page_id - (SELECT min(page_id) FROM pages)) // 25 AS BIGINT) AS batch FROM pages")
def batch_ids(spark, sf_dir):
    return growth.batches(pages(spark, sf_dir), 25)


def _cache(spark, sf_dir):
    """Extractions of every page whose id is a multiple of 3, as an earlier crawl left them."""
    rows = with_links(pages(spark, sf_dir).where("page_id % 3 = 0"))
    return rows.select(U.cache_key(F.col("url")).alias("key"), "url", "links", "page_id")


_STEP = f"""{O.LINKS}, {O.web_version(SHARES[0], "old")}, fates AS MATERIALIZED (
    SELECT page_id, url, CASE WHEN coalesce(url, '') = '' THEN 'failed' WHEN url IN (SELECT src FROM old) THEN 'skipped' WHEN page_id % 3 = 0 THEN 'hit' WHEN html IS NULL THEN 'failed' ELSE 'miss' END AS status
    FROM pages WHERE page_id < (SELECT min(page_id) + CAST(floor((max(page_id) - min(page_id) + 1) * {SHARES[2]}) AS BIGINT) FROM pages)),
    added AS MATERIALIZED (SELECT f.url AS src, t.dst FROM fates f JOIN targets t ON t.page_id = f.page_id WHERE f.status IN ('hit', 'miss'))"""


def _step(spark, sf_dir) -> growth.Step:
    return growth.grow(web(spark, sf_dir, 0), growth.version(pages(spark, sf_dir), 2), _cache(spark, sf_dir))


@query(f"WITH {_STEP} SELECT url, status FROM fates")
def cache_join(spark, sf_dir):
    known = web(spark, sf_dir, 0).select(F.col("src").alias("id"))
    return growth.extract_cached(growth.version(pages(spark, sf_dir), 2), known, _cache(spark, sf_dir)).select("url", "status")


@query(f"""WITH {_STEP} SELECT count(*) FILTER (WHERE status IN ('hit', 'miss')) AS fetched, count(*) FILTER (WHERE status = 'failed') AS failed, (SELECT count(*) FROM added) AS links,
    count(*) FILTER (WHERE status = 'hit') AS cache_hits, count(*) FILTER (WHERE status = 'miss') AS cache_misses, count(*) FILTER (WHERE status = 'skipped') AS skipped FROM fates""")
def crawl_stats(spark, sf_dir):
    return _step(spark, sf_dir).stats


@query(f"WITH {_STEP} SELECT src, dst FROM old UNION ALL SELECT src, dst FROM added")
def growth_step(spark, sf_dir):
    return _step(spark, sf_dir).edges


@query(f"WITH {_STEP} SELECT DISTINCT src, dst FROM added EXCEPT SELECT src, dst FROM old")
def growth_step_delta(spark, sf_dir):
    return _step(spark, sf_dir).delta.new_edges


@query("""SELECT url, 'f' || page_id AS filename, page_id * 10 AS "offset", page_id + 1 AS length FROM pages WHERE page_id % 5 <> 0 AND page_id % 7 <> 0 AND page_id % 4 <> 0""")
def cdx_filtered(spark, sf_dir):
    """Index lines staged from pages: some are cut short, lack a field, or are of another status."""
    record = F.to_json(F.struct("url", F.concat(F.lit("f"), "page_id").alias("filename"), F.when(F.col("page_id") % 7 != 0, (F.col("page_id") * 10).cast("string")).alias("offset"), (F.col("page_id") + 1).cast("string").alias("length"), F.when(F.col("page_id") % 4 == 0, "404").otherwise("200").alias("status"), F.lit("text/html").alias("mime")))
    lines = pages(spark, sf_dir).select(F.when(F.col("page_id") % 5 == 0, F.substring(record, 1, 9)).otherwise(record).alias("value"))
    rows = readers.cdx_rows(lines).where("status = '200' and mime = 'text/html'")
    return rows.select("url", "filename", "offset", "length")


@query()
def mock_crawl(spark, sf_dir):
    return readers.mock_links(readers.mock_cdx(spark, 200)).select("url", F.explode("links").alias("target"))


# Formulas


@query("SELECT n, round(1 / ((1 - p) + p / n), 10) AS speedup, p FROM (SELECT unnest([1, 2, 4, 8, 16, 32]) AS n), (SELECT unnest([CAST(0.5 AS DOUBLE), 0.9, 0.95]) AS p)")
def amdahl_table(spark, sf_dir):
    rows = spark.range(1).select(F.explode(F.array(*map(F.lit, (1, 2, 4, 8, 16, 32)))).alias("n")).select("n", F.explode(F.array(*map(F.lit, (0.5, 0.9, 0.95)))).alias("p"))
    return rows.select("n", F.round(S.amdahl(F.col("p"), F.col("n")), 10).alias("speedup"), "p")


_RUNS = [(0.162, 0.494, 1), (0.162, 0.496, 2), (0.162, 0.533, 4), (8.0, 2.5, 4), (8.0, 0.0, 8), (3.0, 1.0, 2)]


@query("""SELECT t_seq, t_par, w, CASE WHEN t_par = 0 THEN CAST('inf' AS DOUBLE) ELSE round(t_seq / t_par, 10) END AS speedup,
    CASE WHEN w <= 1 THEN 0.0 WHEN t_par <= 0 THEN 0.0 ELSE round(greatest(0.0, least(1.0, (t_par / t_seq - 1) / (1.0 / w - 1))), 10) END AS parallel_fraction
    FROM (VALUES (CAST(0.162 AS DOUBLE), CAST(0.494 AS DOUBLE), 1), (0.162, 0.496, 2), (0.162, 0.533, 4), (8.0, 2.5, 4), (8.0, 0.0, 8), (3.0, 1.0, 2)) t(t_seq, t_par, w)""")
def parallel_fraction(spark, sf_dir):
    rows = spark.createDataFrame(_RUNS, "t_seq double, t_par double, w int")
    t_seq, t_par, w = (F.col(c) for c in ("t_seq", "t_par", "w"))
    return rows.select("t_seq", "t_par", "w", F.round(S.speedup(t_seq, t_par), 10).alias("speedup"), F.round(S.parallel_fraction(t_seq, t_par, w), 10).alias("parallel_fraction"))


def _task_rows(spark, sf_dir):
    """Task times of made-up iterations, from the order items' quantities."""
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((F.col("l_linenumber") % 4).alias("iteration"), F.col("l_quantity").alias("seconds"))


@query("""SELECT iteration, min(s) AS task_min_s, max(s) AS task_max_s, round(avg(s), 9) AS task_avg_s, round(coalesce(stddev_samp(s), 0), 9) AS task_std_s, round((max(s) - min(s)) / max(s), 9) AS load_imbalance
    FROM (SELECT l_linenumber % 4 AS iteration, l_quantity AS s FROM lineitem) GROUP BY iteration""")
def task_stats(spark, sf_dir):
    row = metrics.task_stats(_task_rows(spark, sf_dir), ["iteration"])
    return row.select("iteration", "task_min_s", "task_max_s", *[F.round(c, 9).alias(c) for c in ("task_avg_s", "task_std_s", "load_imbalance")])


@query("""SELECT count(*) AS num_iterations, CAST(sum(c) AS BIGINT) AS comm_bytes, round(sum(b), 6) AS barrier_wait_s, round(sum(w), 6) AS compute_time_s, round(avg(w), 6) AS avg_iteration_s, round(avg(i), 6) AS avg_load_imbalance, max(m) AS max_driver_rss_mb
    FROM (SELECT CAST(l_orderkey AS BIGINT) AS c, l_tax AS b, l_discount AS w, l_tax AS i, l_quantity AS m FROM lineitem)""")
def run_totals(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    rows = items.select(F.col("l_orderkey").alias("comm_bytes"), F.col("l_tax").alias("barrier_wait_s"), F.col("l_discount").alias("compute_time_s"), F.col("l_discount").alias("wall_time_s"), F.col("l_tax").alias("load_imbalance"), F.col("l_quantity").alias("driver_rss_mb"))
    row = metrics.run_totals(rows)
    return row.select("num_iterations", "comm_bytes", *[F.round(c, 6).alias(c) for c in ("barrier_wait_s", "compute_time_s", "avg_iteration_s", "avg_load_imbalance")], "max_driver_rss_mb")


@query("""SELECT min(s) AS task_min_s, max(s) AS task_max_s, round(avg(s), 9) AS task_avg_s, round((max(s) - min(s)) / max(s), 9) AS load_imbalance, CAST(37074 * 8 * 4 AS INTEGER) AS comm_bytes FROM (SELECT l_quantity AS s FROM lineitem)""")
def all_task_metrics(spark, sf_dir):
    row = metrics.all_task_metrics(_task_rows(spark, sf_dir), 37_074, 4)
    return row.select("task_min_s", "task_max_s", F.round("task_avg_s", 9).alias("task_avg_s"), F.round("load_imbalance", 9).alias("load_imbalance"), "comm_bytes")


@query("SELECT id, (id * 2654435761) % 64 AS community FROM range(1000) t(id)")
def community_hash(spark, sf_dir):
    return spark.range(1000).select("id", S.community(F.col("id"), 64).alias("community"))


@query("SELECT 'syn://node/' || id AS url, id AS back FROM range(1000) t(id)")
def syn_codec(spark, sf_dir):
    return spark.range(1000).select(S.synthetic_url(F.col("id")).alias("url")).select("url", S.synthetic_id(F.col("url")).alias("back"))


@query("SELECT url, left(replace(url, 'https://', ''), 45) AS name FROM pages")
def display_name(spark, sf_dir):
    return pages(spark, sf_dir).select("url", S.display_name(F.col("url"), "https://").alias("name"))


@query()
def synthetic_edges(spark, sf_dir):
    return synthetic.as_urls(synthetic.generate(spark, 2000))


@query()
def synthetic_meta(spark, sf_dir):
    return synthetic.meta(synthetic.generate(spark, 2000), 2000)


@query()
def synthetic_growth(spark, sf_dir):
    small, large = synthetic.series(spark, (1500, 2000))
    ids = lambda n: spark.range(n)
    return incremental.delta_of_graphs(small, large, ids(1500), ids(2000)).summary
