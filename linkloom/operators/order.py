"""Places in a total order, found without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut


def numbered(rows: DataFrame, name: str, *order: Column) -> DataFrame:
    """``rows`` with their numbers from 0 in this order, as the column ``name``.

    Range partitions are sorted apart and counted; only the counts of the
    partitions meet to give each its first number. Rows that ``order`` holds equal
    fall into one partition, so it should end with a key.
    """
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    marked = cut(sorted_.withColumn("__m", F.monotonically_increasing_id()))
    marked = marked.withColumn("__chunk", F.shiftright("__m", 33).cast("int"))
    before = Window.orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    firsts = marked.groupBy("__chunk").agg(F.count("*").alias("n")).select("__chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__first"))
    placed = marked.join(F.broadcast(firsts), "__chunk")  # a row a partition
    number = F.col("__first") + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn(name, number).select(*rows.columns, name)
