"""MinHash near-duplicates with b-bit signatures.

A document's set holds the hashes of its distinct word shingles. 128 MinHash
minima give 25 band keys of 5 minima each for candidates; of each minimum the 2
low bits are retained, packed into four longs. The similarity of a candidate
pair is estimated from the matching 2-bit fields, counted by bits and corrected
for chance matches (a quarter); pairs far under the bound go. So do pairs whose
parity sketches (of each of 1024 bits, whether an odd number of elements falls on
it) differ in more bits than the sets of linked documents could differ in
elements: each differing element flips one bit, so no link is lost. All others
are confirmed on their full sets. Equal sets are one node throughout, so exact
copies cost one row each; see ``linking`` for large groups of near copies.

Bands of 5 miss a pair of similarity 0.85 with probability (1 - 0.85**5)**25 =
4e-7, one of 0.8 with 5e-5. The estimate's standard error at 0.85 is 0.037 and
the cut lies 5 of these below the bound.

Defined cases: null text counts as empty; an empty set links with nothing; fewer
words than the shingle size make one shingle of all; rows that repeat a doc_id
are one document if their sets are equal; a null doc_id takes part under the
label null, which stands for a group only if it has no other; an empty table
gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textops as T
from .common import cut, prepare
from .linking import link_groups

MINIMA, BAND, BITS = 128, 5, 2
BANDS = MINIMA // BAND
SIGNATURE = ["s0", "s1", "s2", "s3"]
PARITY_BITS = 1024
PARITY = [f"p{k}" for k in range(PARITY_BITS // 64)]
SKETCH = [*SIGNATURE, *PARITY, "n_shingles"]
_random = np.random.Generator(np.random.PCG64(20240917))
_XOR = _random.integers(0, 1 << 32, MINIMA, dtype=np.uint32)
_ODD = _random.integers(0, 1 << 31, MINIMA, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
#: Elements whose 128 images are held at a time.
CHUNK = 512


def _minima(elements: np.ndarray) -> np.ndarray:
    """The least image of the set under each of the permutations of 32-bit values."""
    x = (elements >> T.U64(32)).astype(np.uint32)
    best = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), CHUNK):
        image = x[at : at + CHUNK, None] ^ _XOR
        image *= _ODD
        np.minimum(best, image.min(axis=0), out=best)
    return best


def _sets(batch: pa.RecordBatch, size: int) -> list[np.ndarray]:
    data, offsets = T.text_bytes(batch.column(1), lower=True)
    starts, ends, first = T.word_spans(data, offsets)
    runs, at = T.shingle_hashes(T.word_hashes(data, starts, ends), first, size)
    return [np.unique(runs[at[i] : at[i + 1]]) for i in range(len(first) - 1)]


def _identity(elements: np.ndarray) -> tuple[int, int]:
    """128 bits that equal sets share."""
    with np.errstate(over="ignore"):
        return int(np.sum(T.mix(elements ^ T.U64(0xA5A5A5A5A5A5A5A5))).view(np.int64)), int(np.sum(T.mix(elements * T.U64(0x9FB21C651E98DF25) + T.U64(7))).view(np.int64))


def _sketches(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        for batch in batches:
            sets = _sets(batch, size)
            n = len(sets)
            minima = np.array([_minima(s) for s in sets], np.uint32).reshape(n, MINIMA)
            mixed = T.mix(minima.astype(np.uint64) ^ (np.arange(MINIMA, dtype=np.uint64) << T.U64(32)))
            low = (mixed & T.U64((1 << BITS) - 1)).reshape(n, len(SIGNATURE), -1)
            packed = np.bitwise_or.reduce(low << (np.arange(low.shape[2], dtype=np.uint64) * T.U64(BITS)), axis=2).view(np.int64)
            odd = np.array([np.bincount((s & T.U64(PARITY_BITS - 1)).astype(np.int64), minlength=PARITY_BITS) & 1 for s in sets], np.uint8).reshape(n, PARITY_BITS)
            parity = np.packbits(odd, axis=1, bitorder="little").view("<i8")
            bands = minima[:, : BANDS * BAND].astype(np.uint64).reshape(n, BANDS, BAND)
            keys = np.zeros((n, BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
            for k in range(BAND):
                keys = T.mix(keys ^ bands[:, :, k] + T.U64(0x632BE59BD9B4E019))
            ids = np.array([_identity(s) for s in sets], np.int64).reshape(n, 2)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * BANDS, pa.int32()), pa.array(keys.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *batch.columns[2:], pa.array([len(s) for s in sets], pa.int64()), pa.array(ids[:, 0]), pa.array(ids[:, 1]), *[pa.array(np.ascontiguousarray(x[:, k])) for x in (packed, parity) for k in range(x.shape[1])], lists],
                ["doc_id", *batch.schema.names[2:], "n_shingles", "id1", "id2", *SIGNATURE, *PARITY, "bands"],
            )

    return run


def _full_sets(size: int):
    def run(batches):
        for batch in batches:
            sets = _sets(batch, size)
            ids = np.array([_identity(s) for s in sets], np.int64).reshape(len(sets), 2)
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids[:, 0]), pa.array(ids[:, 1]), pa.ListArray.from_arrays(pa.array(ends), flat)], ["id1", "id2", "elements"])

    return run


def _mismatches(left: str, right: str) -> Column:
    """How many of the 128 two-bit fields differ."""
    total = F.lit(0)
    for s in SIGNATURE:
        x = F.col(left + s).bitwiseXOR(F.col(right + s))
        total = total + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    return total


def estimate(left: str, right: str) -> Column:
    """Similarity by the signatures with these prefixes, corrected for chance matches."""
    chance = 1 / (1 << BITS)
    return ((1 - _mismatches(left, right) / F.lit(float(MINIMA))) - chance) / (1 - chance)


def text_hash(text: str) -> Column:
    return F.xxhash64(F.col(text).cast("string"))


def _grouped(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, hash of text, n_shingles, id1, id2, sketches) of each row, and (id1, id2, doc_id, component) of each set."""
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_hash("text").alias("hash"))
    columns = "doc_id long, hash long, n_shingles long, id1 long, id2 long, " + ", ".join(f"{s} long" for s in (*SIGNATURE, *PARITY))
    rows = cut(docs.mapInArrow(_sketches(size), columns + ", bands array<long>"))
    firsts = rows.where("n_shingles > 0").groupBy("id1", "id2").agg(F.min("doc_id").alias("doc_id"), *[F.min(s).alias(s) for s in SKETCH])
    nodes = cut(firsts.withColumn("node", F.monotonically_increasing_id()))
    banded = rows.where("n_shingles > 0").select("id1", "id2", "doc_id", "bands").dropDuplicates(["id1", "id2"])
    buckets = banded.join(nodes.select("id1", "id2", "node"), ["id1", "id2"]).select("node", F.explode("bands").alias("bucket"))

    bound = percent / 100
    error = (((0.25 + 0.75 * bound) * 0.75 * (1 - bound)) / MINIMA) ** 0.5 / 0.75

    def confirm(used: DataFrame):
        own = nodes.join(used, "node").select("node", "id1", "id2", "doc_id")
        needed = docs.join(own.select("doc_id").where("doc_id is not null").distinct(), "doc_id", "left_semi").unionByName(docs.where("doc_id is null"))
        full = needed.mapInArrow(_full_sets(size), "id1 long, id2 long, elements array<long>").dropDuplicates(["id1", "id2"])
        full = cut(full.join(own, ["id1", "id2"]).select("node", "elements"))

        def test(pairs: DataFrame) -> DataFrame:
            a = full.select(F.col("node").alias("a"), F.col("elements").alias("ea"))
            b = full.select(F.col("node").alias("b"), F.col("elements").alias("eb"))
            shared = F.size(F.array_intersect("ea", "eb")).cast("long")
            joined = pairs.join(b, "b").join(a, "a").select("a", "b", shared.alias("shared"), (F.size("ea").cast("long") + F.size("eb")).alias("both"))
            return joined.where(F.col("shared") * 100 >= (F.col("both") - F.col("shared")) * percent).select("a", "b")

        return test

    def near(a: str, b: str) -> Column:
        apart = sum((F.bit_count(F.col(a + p).bitwiseXOR(F.col(b + p))) for p in PARITY), F.lit(0))
        both = F.col(f"{a}n_shingles") + F.col(f"{b}n_shingles")
        # of both = union + intersection, at most this share lies outside the intersection
        return (estimate(a, b) >= F.lit(bound - 5 * error)) & (apart * (100 + percent) <= both * (100 - percent))

    linked = link_groups(nodes, buckets, SKETCH, near, confirm)
    labelled = nodes.select("node", "id1", "id2", "doc_id").join(linked, "node", "left")
    grouped = cut(labelled.select("id1", "id2", "doc_id", F.coalesce("component", "node").alias("component")))
    return rows, grouped


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs`` (doc_id, text).

    size: words of a shingle. percent: documents link if 100 * intersection >=
    percent * union. component_id: the least doc_id that links reach, itself
    included; kept: whether it is the document's own.
    """
    rows, grouped = _grouped(docs, size, percent)
    least = grouped.groupBy("component").agg(F.min("doc_id").alias("least"))
    of_set = grouped.join(least, "component").select("id1", "id2", "least")
    held = rows.where("n_shingles > 0").select("doc_id", "n_shingles", "id1", "id2").join(of_set, ["id1", "id2"]).select("doc_id", "n_shingles", F.col("least").alias("component_id"))
    empty = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return held.unionByName(empty).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with exactly one row of each group that links make, whatever ids rows share or lack.

    It is the row of the least (doc_id, hash of text), a null id last; of rows that
    are equal in both, the least by a hash of all columns. Rows without words all stay.
    """
    rows, grouped = _grouped(docs, size, percent)
    held = rows.where("n_shingles > 0").join(grouped.select("id1", "id2", "component"), ["id1", "id2"])
    counted = held.groupBy("component", "doc_id", "hash").agg(F.count("*").alias("times"))
    first = counted.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "hash", "times")).alias("first")).select("first.doc_id", "first.hash", "first.times")
    empty = rows.where("n_shingles = 0").select("doc_id", "hash", F.lit(1).cast("long").alias("times")).distinct()
    kept = cut(first.unionByName(empty).select(F.col("doc_id").alias("__kept_id"), F.col("hash").alias("__kept_hash"), F.col("times").alias("__times")))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__kept_id")) & (text_hash("text") == F.col("__kept_hash"))
    out = docs.join(kept.where("__times = 1"), same, "left_semi")
    repeated = kept.where("__times > 1")
    if repeated.limit(1).count():
        equal = Window.partitionBy("__kept_id", "__kept_hash").orderBy(F.xxhash64(*docs.columns))
        some = docs.join(repeated, same).withColumn("__number", F.row_number().over(equal)).where("__number = 1")
        out = out.unionByName(some.select(docs.columns))
    return out
