"""The graphs that queries run on: the links of pages, and who ordered what from whom."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ExtractConfig, GrowthConfig
from ..operators import graph as G
from ..operators.growth import page_slice, version
from ..sources import readers

SHARES = GrowthConfig().shares


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.pages(spark, f"{sf_dir}/pages.parquet")


def web_multigraph(spark: SparkSession, sf_dir: str, config: ExtractConfig = ExtractConfig()) -> DataFrame:
    return G.multigraph(pages(spark, sf_dir), config)


def web(spark: SparkSession, sf_dir: str, number: int | None = None) -> DataFrame:
    """Distinct links, of all pages or of a version's."""
    rows = pages(spark, sf_dir)
    return G.simple(G.multigraph(rows if number is None else version(rows, number)))


def trade(spark: SparkSession, sf_dir: str, number: int = len(SHARES) - 1) -> DataFrame:
    """Customers to parts to suppliers, from the orders of a version's share of the order keys."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    orders = read("orders").select("o_orderkey", "o_custkey")
    items = read("lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    if SHARES[number] < 1:
        low, high = orders.agg(F.min("o_orderkey"), F.max("o_orderkey")).first()
        first_after = low + int((high - low + 1) * SHARES[number]) if low is not None else 0
        orders, items = orders.where(F.col("o_orderkey") < first_after), items.where(F.col("l_orderkey") < first_after)
    part = F.concat(F.lit("p"), "l_partkey")
    buys = orders.join(items, F.col("o_orderkey") == F.col("l_orderkey")).select(F.concat(F.lit("c"), "o_custkey").alias("src"), part.alias("dst"))
    made = items.select(part.alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"))
    return buys.union(made).distinct()


__all__ = ["SHARES", "page_slice", "pages", "trade", "web", "web_multigraph"]
