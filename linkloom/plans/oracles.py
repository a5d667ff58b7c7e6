"""DuckDB SQL of the queries in ``catalog``: independent statements of what each returns."""

from __future__ import annotations

LINKS = """links AS MATERIALIZED (
    SELECT page_id, url AS src, unnest(hrefs) AS href, unnest(range(1, len(hrefs) + 1)) AS pos
    FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hrefs FROM pages)),
targets AS MATERIALIZED (
    SELECT page_id, src, dst, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS place FROM (
        SELECT page_id, src, regexp_extract(src, '^(https?://[^/?#]+)', 1) || regexp_replace(href, '[?#].*$', '') AS dst, min(pos) AS pos
        FROM links WHERE trim(href) <> '' AND NOT starts_with(href, '#') GROUP BY ALL))"""
WEB = LINKS + ", edges AS MATERIALIZED (SELECT DISTINCT src, dst FROM targets)"
SHARES = (0.6, 0.75, 0.875, 1.0)


def trade(share: float = 1.0, name: str = "edges") -> str:
    first = f"l_orderkey < (SELECT min(o_orderkey) + CAST(floor((max(o_orderkey) - min(o_orderkey) + 1) * {share}) AS BIGINT) FROM orders)"
    return f"""{name} AS MATERIALIZED (
        SELECT 'c' || o_custkey AS src, 'p' || l_partkey AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE {first}
        UNION SELECT 'p' || l_partkey, 's' || l_suppkey FROM lineitem WHERE {first})"""


def web_version(share: float, name: str = "edges") -> str:
    return f"{name} AS MATERIALIZED (SELECT DISTINCT src, dst FROM targets WHERE page_id < (SELECT min(page_id) + CAST(floor((max(page_id) - min(page_id) + 1) * {share}) AS BIGINT) FROM pages))"


def nodes(edges: str = "edges", name: str = "v") -> str:
    return f"{name} AS MATERIALIZED (SELECT src AS id FROM {edges} UNION SELECT dst FROM {edges})"


def ranks(steps: int, damping: float = 0.85, edges: str = "edges", tag: str = "", start: str | None = None, active: str | None = None) -> str:
    """CTEs r0 .. r<steps> (id, rank), with a tag in all names; start: a CTE (id, rank); active: a CTE (id)."""
    v, od, n = f"v{tag}", f"od{tag}", f"n{tag}"
    out = [
        nodes(edges, v),
        f"{od} AS MATERIALIZED (SELECT src, count(*) AS c FROM {edges} GROUP BY src)",
        f"{n} AS MATERIALIZED (SELECT CAST(count(*) AS DOUBLE) AS n FROM {v})",
        f"r{tag}0 AS MATERIALIZED (" + (f"SELECT id, rank FROM {start}" if start else f"SELECT id, 1.0 / n AS rank FROM {v}, {n}") + ")",
    ]
    for t in range(steps):
        new = f"(1 - {damping}) / {n}.n + {damping} * s.s / {n}.n + {damping} * coalesce(c.c, 0)"
        if active:
            new = f"CASE WHEN o.id IN (SELECT id FROM {active}) THEN {new} ELSE o.rank END"
        out.append(f"""r{tag}{t + 1} AS MATERIALIZED (
            SELECT o.id, {new} AS rank
            FROM r{tag}{t} o LEFT JOIN (
                SELECT e.dst, sum(r.rank / d.c) AS c FROM {edges} e JOIN r{tag}{t} r ON r.id = e.src JOIN {od} d ON d.src = e.src GROUP BY e.dst) c ON c.dst = o.id,
            {n}, (SELECT coalesce(sum(rank), 0) AS s FROM r{tag}{t} WHERE id NOT IN (SELECT src FROM {od})) s)""")
    return ", ".join(out)


def changes(steps: int, norm: str, tag: str = "") -> str:
    return " UNION ALL ".join(f"SELECT {t} AS iteration, round({norm}(abs(a.rank - b.rank)), 12) AS delta FROM r{tag}{t} a JOIN r{tag}{t - 1} b ON a.id = b.id" for t in range(1, steps + 1))


DELTA = f"""{trade(SHARES[0], "old")}, {trade(SHARES[1], "new")}, {nodes("old", "old_v")}, {nodes("new", "new_v")},
new_sources AS MATERIALIZED (SELECT DISTINCT src AS id FROM new EXCEPT SELECT src FROM old),
new_targets AS MATERIALIZED (SELECT id FROM new_v EXCEPT SELECT id FROM old_v EXCEPT SELECT id FROM new_sources),
new_edges AS MATERIALIZED (SELECT src, dst FROM new EXCEPT SELECT src, dst FROM old),
affected AS MATERIALIZED (SELECT DISTINCT src AS id FROM new_edges WHERE src IN (SELECT src FROM old)),
seed AS MATERIALIZED (SELECT id FROM (SELECT id FROM new_sources UNION SELECT id FROM new_targets UNION SELECT id FROM affected UNION SELECT src FROM new_edges UNION SELECT dst FROM new_edges) WHERE id IN (SELECT id FROM new_v)),
hop1 AS MATERIALIZED (SELECT id FROM seed UNION SELECT dst FROM new WHERE src IN (SELECT id FROM seed)),
hop2 AS MATERIALIZED (SELECT id FROM hop1 UNION SELECT dst FROM new WHERE src IN (SELECT id FROM hop1))"""

#: The web graph grows by pages: ranks of v0 start those of v1.
WEB_GROWTH = f"""{LINKS}, {web_version(SHARES[0], "old")}, {web_version(SHARES[1], "new")}, {ranks(5, edges="old", tag="p")},
{nodes("old", "old_v")}, {nodes("new", "new_v")},
new_edges AS MATERIALIZED (SELECT src, dst FROM new EXCEPT SELECT src, dst FROM old),
seed AS MATERIALIZED (SELECT src AS id FROM new_edges UNION SELECT dst FROM new_edges),
hop1 AS MATERIALIZED (SELECT id FROM seed UNION SELECT dst FROM new WHERE src IN (SELECT id FROM seed)),
mixed AS MATERIALIZED (SELECT v.id, coalesce(p.rank, 1.0 / (SELECT count(*) FROM new_v)) AS rank FROM new_v v LEFT JOIN rp5 p ON p.id = v.id),
init AS MATERIALIZED (SELECT id, rank / (SELECT sum(rank) FROM mixed) AS rank FROM mixed)"""


def accuracy(test: str) -> str:
    return f"""SELECT round(max(abs(a.rank - b.rank)), 12) AS max_abs_diff, round(sum(abs(a.rank - b.rank)), 12) AS l1,
        round(sqrt(sum((a.rank - b.rank) * (a.rank - b.rank))), 12) AS l2, count(*) - count(b.id) AS missing
        FROM rf5 a LEFT JOIN {test} b ON a.id = b.id"""


VERTICES = WEB + ", " + nodes() + """,
works AS MATERIALIZED (SELECT v.id, row_number() OVER (ORDER BY v.id) - 1 AS vid, 1 + coalesce(c, 0) AS work
    FROM v LEFT JOIN (SELECT dst, count(*) AS c FROM edges GROUP BY dst) d ON d.dst = v.id)"""
PARTS = {
    "range": "parts AS (SELECT *, CAST(least(vid // greatest(1, (SELECT count(*) FROM works) // {k}), {k} - 1) AS INTEGER) AS part FROM works)",
    "hash": "parts AS (SELECT *, CAST(vid % {k} AS INTEGER) AS part FROM works)",
    "edge_balanced": """queue AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY work DESC, vid) AS i FROM works),
        walk(i, loads, part) AS (
            SELECT CAST(0 AS BIGINT), list_transform(range({k}), lambda x: CAST(0 AS BIGINT)), CAST(-1 AS BIGINT)
            UNION ALL
            SELECT q.i, list_transform(w.loads, lambda l, j: l + CASE WHEN j = list_position(w.loads, list_min(w.loads)) THEN q.work ELSE 0 END),
                CAST(list_position(w.loads, list_min(w.loads)) - 1 AS BIGINT)
            FROM walk w JOIN queue q ON q.i = w.i + 1),
        parts AS (SELECT q.id, q.vid, q.work, CAST(w.part AS INTEGER) AS part FROM walk w JOIN queue q ON q.i = w.i)""",
}


def partition(strategy: str, k: int = 4, diagnose: bool = False) -> str:
    recursive = "RECURSIVE " if strategy == "edge_balanced" else ""
    body = f"WITH {recursive}{VERTICES}, {PARTS[strategy].format(k=k)} "
    if not diagnose:
        return body + "SELECT id, vid, CAST(work AS BIGINT) AS work, part FROM parts"
    figures = ", ".join(f"CAST(min({c}) AS BIGINT) AS min_{c}, CAST(max({c}) AS BIGINT) AS max_{c}, avg({c}) AS avg_{c}, round((max({c}) - min({c})) / max({c}), 10) AS {c}_imbalance" for c in ("size", "work"))
    return body + f"SELECT {figures} FROM (SELECT p.k, count(parts.id) AS size, coalesce(sum(work), 0) AS work FROM (SELECT unnest(range({k})) AS k) p LEFT JOIN parts ON parts.part = p.k GROUP BY p.k)"
