"""Groups of similar rows from candidate buckets, without all pairs of a bucket.

Any pair that shares a bucket and is ``near`` by its sketches ends in one group
or has been confirmed not to be a link: nothing is capped. What keeps large
buckets cheap is that only pairs of different groups need a look:

1. every member against its bucket's least node, then groups are formed;
2. in buckets that still hold several groups, every member against the bucket's
   least node by hash, if of another group; groups are formed again;
3. in buckets that still hold several groups, all pairs of different groups,
   in tiles of about ``TILE`` by ``TILE`` members, by their sketches in the join
   itself, so that only pairs that are near leave it. There ``within`` may add columns and
   tell more, up to the exact test, so that no pairs of unlike rows are written; then buckets of up to
   ``FEW`` members skip the first two steps, which would test most of their pairs twice, and
   those of one tile are joined with themselves, so that their members are shuffled once.

What is kept between the steps goes when the last reader is done.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bitmap, cut, dropped, freed, stored, with_maybe
from .components import connected_components

TILE = 1024
FEW = 4


def _with(frame: DataFrame, nodes: DataFrame, key: str, sketch: list[str]) -> DataFrame:
    return frame.join(nodes.select(F.col("node").alias(key), *[F.col(c).alias(f"{key}_{c}") for c in sketch]), key)


def _near_pairs(pairs: DataFrame, nodes: DataFrame, sketch: list[str], near: Callable[[str, str], Column]) -> DataFrame:
    pairs = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return cut(_with(_with(pairs, nodes, "a", sketch), nodes, "b", sketch).where(near("a_", "b_")).select("a", "b"))


def _label(members: DataFrame, groups: DataFrame) -> DataFrame:
    return members.join(groups.withColumnRenamed("component", "group"), "node", "left").withColumn("group", F.coalesce("group", "node"))


def _unresolved(members: DataFrame, groups: DataFrame) -> DataFrame:
    """(bucket, node, group, n, other, other_group) of the buckets that hold several groups."""
    labelled = _label(members.select("bucket", "node"), groups)
    pick = F.min(F.struct(F.xxhash64("node", "bucket").alias("h"), F.col("node").alias("other"), F.col("group").alias("other_group"))).alias("pick")
    several = labelled.groupBy("bucket").agg(F.count("*").alias("n"), F.min("group").alias("low"), F.max("group").alias("high"), pick).where("low <> high")
    return stored(labelled.join(several.select("bucket", "n", "pick.other", "pick.other_group"), "bucket"))


def link_groups(
    nodes: DataFrame,
    buckets: DataFrame,
    sketch: list[str],
    near: Callable[[str, str], Column],
    confirm: Callable[[DataFrame], Callable[[DataFrame], DataFrame]],
    within: tuple[list[str], Callable[[DataFrame], DataFrame], Callable[[str, str], Column], Callable[[str, str], Column]] | None = None,
) -> DataFrame:
    """(node, component) of all nodes that have a link.

    nodes: (node long, the columns ``sketch``), kept by ``cut`` or ``stored``. buckets:
    (bucket long, node long), whose rows may repeat. near(left, right): whether sketches are near, given the
    prefixes of both sides' columns. confirm(nodes that share a bucket) prepares
    and returns the exact test from (a, b) pairs to those that are links. within: names of
    columns, what adds them to the open members (bucket, node, node_<sketch>, ...) and keeps these by ``stored``, which may drop those that
    link with no other, whether a pair of one ``bucket``, of columns with these prefixes, may be a link to tell there,
    and whether it then is one without a further test.
    """
    extra, attach, held, sure = within or ([], lambda frame: frame, lambda left, right: F.lit(True), lambda left, right: F.lit(False))
    few = FEW if within else 0
    heads = cut(buckets.groupBy("bucket").agg(F.min("node").alias("head"), F.max("node").alias("last"), (F.count("*") > few).alias("many")).where("head < last").select("bucket", "head", "many"))
    likely = with_maybe(buckets, F.col("bucket"), bitmap(heads, F.col("bucket")), "maybe").where("maybe").select("bucket", "node")
    members = stored(likely.join(heads, "bucket").distinct())
    used = cut(members.select("node").distinct())
    nodes = stored(nodes.join(used, "node"))
    test = confirm(used)

    found = test(_near_pairs(members.where("many").select(F.col("head").alias("a"), F.col("node").alias("b")), nodes, sketch, near))
    links = cut(found)
    groups = connected_components(links)
    freed(nodes.sparkSession)

    open_ = _unresolved(members, groups)
    dropped(members)
    second = open_.where(F.expr("`group` <> other_group") & (F.col("n") > few)).select(F.col("other").alias("a"), F.col("node").alias("b"))
    links = links.union(cut(test(_near_pairs(second, nodes, sketch, near))))
    groups = connected_components(links)

    freed(nodes.sparkSession)

    seen, open_ = open_, _unresolved(open_, groups)
    dropped(seen)
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    tiled = _with(open_.select("bucket", "node", "group", tiles.alias("tiles")), nodes, "node", sketch)
    attached = attach(tiled)
    if within:
        dropped(open_, nodes)
    tiled = attached.withColumn("tile", F.pmod(F.xxhash64("node"), "tiles").cast("int"))
    sketch = [*sketch, *extra]
    packed = [F.col(f"node_{c}") for c in sketch]
    side = lambda frame, x, *more: frame.select("bucket", *more, F.col("node").alias(x), F.col("group").alias(f"{x}_group"), *[c.alias(f"{x}_{n}") for c, n in zip(packed, sketch, strict=True)])
    ordered = F.col("a") < F.col("b")

    def met(left: DataFrame, right: DataFrame, keys: list[str], once: Column) -> DataFrame:
        right = right.withColumnsRenamed({k: f"b_{k}" for k in keys})
        # in this order: the dear test comes last
        wanted = F.when((F.col("a_group") != F.col("b_group")) & once, F.when(near("a_", "b_"), held("a_", "b_")).otherwise(False)).otherwise(False)
        return left.join(right, [*[F.col(k) == F.col(f"b_{k}") for k in keys], wanted]).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), sure("a_", "b_").alias("sure"))

    # dealt out before the sides' names differ, so that both read one exchange
    one, several = (tiled.where("tiles = 1").repartition("bucket"), tiled.where("tiles > 1")) if within else (None, tiled)
    left = side(several, "a", F.col("tile").alias("i"), F.explode(F.sequence("tile", F.col("tiles") - 1)).alias("j"))
    right = side(several, "b", F.explode(F.sequence(F.lit(0), "tile")).alias("i"), F.col("tile").alias("j"))
    third = met(left, right, ["bucket", "i", "j"], (F.col("i") < F.col("j")) | ordered)
    if one is not None:
        third = third.unionByName(met(side(one, "a"), side(one, "b"), ["bucket"], ordered))
    third = cut(third.distinct())
    dropped(*([attached] if within else [open_, nodes]))
    freed(nodes.sparkSession)
    tested = test(third.where("not sure").select("a", "b"))
    return connected_components(links.union(third.where("sure").select("a", "b")).union(tested))
