"""Mixing sources to target weights by pivotal dependent rounding.

Sources by code point (null last) weigh 1, 2, 3, 1, ... and share the words of
all documents; a target above three times its source's words stops there, and
the excess is shared again by weight, until no target is above its cap.

Every document of a source starts with the same copies, target / source's words:
a whole part and a fraction. Fractions are rounded by pairs: one document's words
are moved to the other until a fraction becomes 0 or 1, in either direction, at
random with the odds that keep every document's expectation; the words taken stay
exactly on target. A chunk of about ``CHUNK`` documents is folded largest first
and leaves one fractional document; these meet in chunks of chunks, and so on: a
reduction tree whose widest task holds about CHUNK documents of one source. The
last fraction of a source is rounded to the nearer side, so a source's words miss
their target by at most half a document. Random numbers are hashes of ids.

All on DataFrame functions. Defined cases: null text has size 0; documents of
size 0 are taken 0 words; rows that repeat doc_id, source and size are one unit
with the same copies each; a null doc_id is an id; an empty table gives no rows.
Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.order import numbered
from .common import WORD, cut, prepare, small_side

CHUNK, MOST, SEED = 64, 3, 20240917
_TINY = 1e-12


def with_targets(sources: DataFrame, most: int = MOST) -> DataFrame:
    """``sources`` (source, source_size), one row each, with weight, target and copies.

    No task sees all sources: places by name come from range partitions, and the
    words per weight rise from one aggregation to the next as sources stop at their
    caps, until none is above. Sums are whole numbers, so reruns agree.
    """
    placed = numbered(sources, "place", F.col("source").asc_nulls_last())
    rows = cut(placed.select("source", "source_size", (F.col("place") % 3 + 1).alias("weight"), (F.col("source_size") * most).alias("cap")))
    total = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level = 0.0
    while True:
        stopped = F.col("cap") <= F.col("weight") * level
        sums = rows.agg(F.sum(F.when(stopped, F.col("cap"))).alias("capped"), F.sum(F.when(~stopped, F.col("weight"))).alias("weights")).first()
        higher = (total - (sums["capped"] or 0)) / sums["weights"] if sums["weights"] else level
        if higher <= level:
            break
        level = higher
    rows = rows.withColumn("target", F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(level)))
    copies = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    return rows.select("source", "source_size", "weight", "target", copies.alias("copies"))


def _unit(key: Column, doc_id: Column, size: Column, rows: Column, words: Column, p: Column) -> Column:
    return F.struct(words.cast("double").alias("words"), key.alias("key"), doc_id.alias("doc_id"), size.alias("size"), rows.alias("rows"), p.alias("p"))


def _done(unit: Column, up: Column) -> Column:
    return F.struct(unit["doc_id"].alias("doc_id"), unit["size"].alias("size"), unit["rows"].alias("rows"), up.alias("up"))


def _at(unit: Column, p: Column) -> Column:
    return _unit(unit["key"], unit["doc_id"], unit["size"], unit["rows"], unit["words"], p)


def _step(state: Column, new: Column, level: int) -> Column:
    """Moves words between the fractional unit of ``state`` and ``new`` until one is whole."""
    old, done = state["old"], state["done"]
    rise = F.least((1 - old["p"]) * old["words"], new["p"] * new["words"])
    fall = F.least(old["p"] * old["words"], (1 - new["p"]) * new["words"])
    dice = F.pmod(F.xxhash64(old["key"], new["key"], F.lit(level), F.lit(SEED)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    up = dice * (rise + fall) < fall
    old_is_whole = F.when(up, (1 - old["p"]) * old["words"] <= new["p"] * new["words"]).otherwise(old["p"] * old["words"] <= (1 - new["p"]) * new["words"])
    moved = F.when(up, rise).otherwise(-fall)
    rest = F.when(old_is_whole, _at(new, new["p"] - moved / new["words"])).otherwise(_at(old, old["p"] + moved / old["words"]))
    # the old unit is whole at 1 if it rose, the new one at 1 if the old one fell
    whole = F.when(old_is_whole, _done(old, up)).otherwise(_done(new, ~up))
    first = F.struct(new.alias("old"), done.alias("done"))
    return F.when(old.isNull(), first).otherwise(F.struct(rest.alias("old"), F.concat(done, F.array(whole)).alias("done")))


def _fold(units: DataFrame, level: int) -> DataFrame:
    """(source, chunk, old, done): each chunk's fractional unit, and those that became whole."""
    unit = "struct<words:double,key:bigint,doc_id:bigint,size:bigint,rows:bigint,p:double>"
    start = F.expr(f"named_struct('old', cast(null as {unit}), 'done', cast(array() as array<struct<doc_id:bigint,size:bigint,rows:bigint,up:boolean>>))")
    folded = F.aggregate(F.sort_array(F.collect_list("unit"), asc=False), start, lambda state, new: _step(state, new, level))
    return units.groupBy("source", "chunk").agg(folded.alias("state")).select("source", "chunk", "state.old", "state.done")


def mix(docs: DataFrame, most: int = MOST) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for each row of ``docs`` (doc_id, text, source).

    size: words of the text; copies: how often the mix takes the document; taken: copies * size.
    """
    prepare(docs.sparkSession)
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"))
    units = cut(sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows")))
    per_source = units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count_if(F.col("size") > 0).alias("units"))
    counts = cut(with_targets(per_source.select("source", "source_size"), most).join(per_source.select(F.col("source").alias("own"), "units"), F.col("source").eqNullSafe(F.col("own"))).drop("own"))
    table = counts.withColumnRenamed("source", "own")
    rows = units.join(small_side(table), F.col("source").eqNullSafe(F.col("own"))).drop("own")
    rows = rows.withColumn("p", F.col("copies") - F.floor("copies"))
    fractional = (F.col("size") > 0) & F.col("p").between(_TINY, 1 - _TINY)

    chunks = F.greatest(F.ceil(F.col("units") / CHUNK), F.lit(1).cast("long"))
    key = F.xxhash64("doc_id", "size", F.lit(SEED))
    start = rows.where(fractional).select("source", F.pmod(key, chunks).cast("long").alias("chunk"), _unit(key, F.col("doc_id"), F.col("size"), F.col("rows"), F.col("size") * F.col("rows"), F.col("p")).alias("unit"))
    width = counts.agg(F.max(chunks)).first()[0] or 1
    whole, level = [], 0
    while True:
        folded = cut(_fold(start, level))
        whole.append(folded.select("source", F.explode("done").alias("done")))
        if width <= 1:
            break
        width, level = -(-width // CHUNK), level + 1
        start = folded.select("source", F.floor(F.col("chunk") / CHUNK).alias("chunk"), F.col("old").alias("unit"))
    whole.append(folded.select("source", _done(F.col("old"), F.col("old.p") >= 0.5).alias("done")))
    rounded = whole[0]
    for more in whole[1:]:
        rounded = rounded.unionByName(more)
    rounded = rounded.select("source", "done.*").join(small_side(table), F.col("source").eqNullSafe(F.col("own")))
    rounded = rounded.withColumn("copies", (F.floor("copies") + F.col("up").cast("long")).cast("long"))
    settled = rows.where(~fractional).withColumn("copies", F.when(F.col("size") > 0, F.round("copies")).otherwise(0).cast("long"))
    columns = ["doc_id", "source", "size", "source_size", "target", "copies", "rows"]
    both = rounded.select(columns).unionByName(settled.select(columns))
    each = both.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), "rows")))
    return each.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
