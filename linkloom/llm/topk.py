"""Exact top-k search by inner products.

Vectors are dealt into blocks of about ``BLOCK`` rows by a hash; each pair of a
query block and a candidate block is one task's tile. In a tile, matrix products
of a slice of queries with all candidates give integer scores, of which partial
selection keeps k a query. Lists are merged in a tree of ``FAN`` lists a step.
Nothing is broadcast or capped; a group holds one tile's two blocks, or the
lists of one query from FAN tiles.

Defined cases: a component x becomes floor(scale * x); vectors that are null,
empty, or hold null or non-finite components take no part, nor do rows without
an id; vectors of different lengths do not meet; a query meets every row but
those of its own id; rows that repeat an id are candidates each, and as queries
count once if their vectors are equal, else each (then an id has several lists);
scores beyond a long are clamped to it; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, prepare

BLOCK, SLICE, FAN = 16_384, 256, 16
_LONG = (1 << 63) - 1


def _integers(vectors: pd.Series, scale: float) -> np.ndarray:
    x = np.floor(np.array(vectors.tolist(), np.float64) * scale)
    return x if np.abs(x).max(initial=0) < 2**53 else np.array([[int(v) for v in row] for row in x], object)


def _best(queries: pd.DataFrame, rows: pd.DataFrame, k: int, scale: float):
    """Each query's k best rows, (query, vec_id, score), ties to the smaller id."""
    q, c = _integers(queries["vector"], scale), _integers(rows["vector"], scale)
    bound = q.shape[1] * float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0))
    if bound >= 2**53:  # beyond exact doubles
        kind = np.int64 if bound < 2**62 else object
        q, c = q.astype(kind), c.astype(kind)
    order = np.argsort(rows["vec_id"].to_numpy(), kind="stable")
    ids, c = rows["vec_id"].to_numpy()[order], c[order].T
    for at in range(0, len(q), SLICE):
        scores = q[at : at + SLICE] @ c
        for own, row in zip(queries.iloc[at : at + SLICE].itertuples(), scores, strict=True):
            left, right = np.searchsorted(ids, own.vec_id), np.searchsorted(ids, own.vec_id, "right")
            # the query's own id can take right - left places
            want = min(k + right - left, len(row))
            if want == 0:
                continue
            if row.dtype == object:
                chosen = np.arange(len(row))
            else:
                least = np.partition(row, len(row) - want)[len(row) - want]
                chosen = np.flatnonzero(row >= least)
            chosen = chosen[(chosen < left) | (chosen >= right)]
            chosen = chosen[np.lexsort((ids[chosen], -row[chosen]))] if row.dtype != object else np.array(sorted(chosen, key=lambda j: (-row[j], ids[j])), int)
            for j in chosen[:k]:
                yield own, int(ids[j]), min(max(int(row[j]), -_LONG), _LONG)


def _search(vectors: DataFrame, is_query: Column, k: int, scale: float) -> DataFrame:
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    finite = ~F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & (F.size("vector") > 0) & finite).withColumn("length", F.size("vector"))
    queries = rows.where(is_query).distinct()
    sizes = {(kind, r["length"]): r["count"] for kind, frame in (("q", queries), ("c", rows)) for r in frame.groupBy("length").count().collect()}
    lengths = {n for _, n in sizes}
    blocks = {kind: F.create_map(*[F.lit(x) for n in lengths for x in (n, max(1, -(-sizes.get((kind, n), 0) // BLOCK)))]) if lengths else None for kind in "qc"}
    if not lengths:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(0).cast("long").alias("query_no"), F.lit(0).alias("block"), F.array(F.struct(F.lit(0).cast("long").alias("neg"), F.col("vec_id").alias("vec_id"))).alias("best"))
    own, other = {"q": "q_block", "c": "c_block"}, {"q": "c_block", "c": "q_block"}
    dealt = []
    for kind, frame in (("q", queries), ("c", rows)):
        n, m = blocks[kind][F.col("length")], blocks["c" if kind == "q" else "q"][F.col("length")]
        frame = frame.withColumn("kind", F.lit(kind)).withColumn(own[kind], F.pmod(F.xxhash64("vec_id", "vector"), n).cast("int"))
        dealt.append(frame.withColumn(other[kind], F.explode(F.sequence(F.lit(0), m - 1))))

    def tile(part: pd.DataFrame) -> pd.DataFrame:
        asks, has = part[part["kind"] == "q"], part[part["kind"] == "c"]
        out: dict[tuple, list] = {}
        if len(asks) and len(has):
            for number, (own_row, vec_id, score) in enumerate(_best(asks, has, k, scale)):
                out.setdefault((own_row.vec_id, own_row.query_no, own_row.c_block), []).append((score, vec_id))
        return pd.DataFrame([(q, no, b, [{"neg": -s, "vec_id": v} for s, v in best]) for (q, no, b), best in out.items()], columns=["query_id", "query_no", "block", "best"])

    both = dealt[0].unionByName(dealt[1]).withColumn("query_no", F.xxhash64("vector"))
    return both.groupBy("length", "q_block", "c_block").applyInPandas(tile, "query_id long, query_no long, block int, best array<struct<neg:long,vec_id:long>>")


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: float = 1024.0) -> DataFrame:
    """(query_id, rank from 1, vec_id, score) for the rows of ``vectors`` (vec_id, embedding) that ``is_query`` (of vec_id) selects."""
    prepare(vectors.sparkSession)
    lists = cut(_search(vectors, is_query, k, scale))
    top = lists.agg(F.max("block")).first()[0]
    ordered = F.array_sort(F.flatten(F.collect_list("best")))  # by the negated score, then the id
    while True:
        lists = lists.withColumn("block", F.floor(F.col("block") / FAN).cast("int")).groupBy("query_id", "query_no", "block").agg(F.slice(ordered, 1, k).alias("best"))
        top = (top or 0) // FAN
        if top == 0:
            break
    ranked = lists.select("query_id", F.posexplode("best").alias("place", "hit"))
    return ranked.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.neg")).alias("score"))
