"""Pages that arrive as a stream grow a stored graph, batch by batch.

An extension: ``foreachBatch`` around the batch step, so a batch that is run
again after a failure finds its pages among the known sources and adds nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..config import ExtractConfig
from ..operators.growth import extract_cached


def grow_stream(pages: DataFrame, table: str, checkpoint: str, config: ExtractConfig = ExtractConfig()) -> DataStreamWriter:
    """Appends the edges of new pages to the Parquet table at ``table``; start() the result."""
    spark = pages.sparkSession
    spark.createDataFrame([], "src string, dst string, version long").write.mode("append").partitionBy("version").parquet(table)

    def step(batch: DataFrame, number: int) -> None:
        known = spark.read.schema("src string, dst string, version long").parquet(table).where(F.col("version") != number).select(F.col("src").alias("id"))
        cache = spark.createDataFrame([], "key string, url string, links array<string>")
        fates = extract_cached(batch.dropDuplicates(["url"]), known, cache, config)
        added = fates.select(F.col("url").alias("src"), F.explode("links").alias("dst"), F.lit(number).alias("version"))
        added.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(table)

    return pages.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
