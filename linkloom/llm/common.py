"""What the operators share: cutting lineage, batch sizes, a checked broadcast."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import checkpoint_folder

#: Words of the contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of one Arrow batch: with texts of 100 KB a batch stays near 10 MB.
BATCH_ROWS = 96


def prepare(spark: SparkSession) -> SparkSession:
    """Small Arrow batches, since texts may be very long, and the shared checkpoint folder."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    checkpoint_folder(spark)
    return spark


def cut(frame: DataFrame) -> DataFrame:
    """The frame's rows, computed once and kept in the shared checkpoint folder.

    Later reads do not depend on the executors that computed them.
    """
    prepare(frame.sparkSession)
    return frame.checkpoint(eager=True)


def stored(frame: DataFrame) -> DataFrame:
    """The rows as a compressed table in the shared folder, of which later reads take only the columns they need.

    ``dropped`` takes it away again.
    """
    spark = frame.sparkSession
    path = f"{checkpoint_folder(spark)}/table-{uuid.uuid4().hex}"
    frame.write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes what ``stored`` has written; nothing lazy may read it from here on."""
    for table in tables:
        spark = table.sparkSession
        for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def freed(spark: SparkSession) -> None:
    """Has the driver collect its garbage, between steps of a long query.

    Its heap else grows with what the plans of earlier steps left, and checkpoints that
    nothing refers to any more stay on the shared disk until then.
    """
    spark._jvm.System.gc()


#: Most rows of a table that goes to every executor.
BROADCAST_ROWS = 20_000


def small_side(frame: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``frame`` with a broadcast hint if it is counted to have few rows, else as it is.

    ``frame`` must be cheap to count: a table that ``cut`` has kept. Without the
    hint the join is shuffled and adaptive execution splits its hot keys.
    """
    return F.broadcast(frame) if frame.limit(rows + 1).count() <= rows else frame


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def fold(doc_id: str | Column, of: int) -> Column:
    """crc32 of the id's decimal text, modulo ``of``; a null id is in fold 0."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % of, F.lit(0))


#: Bits of a broadcast bitmap, 1 MB whatever the data.
BITMAP_BITS = 1 << 23


def bitmap(frame: DataFrame, key: Column) -> DataFrame:
    """Which hashes of ``key`` occur, in at most 256 rows of 4 KB."""
    place = F.pmod(F.xxhash64(key), F.lit(BITMAP_BITS)).alias("place")
    return frame.select(place).groupBy(F.bitmap_bucket_number("place").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("__bits"))


def with_maybe(frame: DataFrame, key: Column, held: DataFrame, name: str) -> DataFrame:
    """``frame`` with a boolean column: false where ``key`` certainly isn't among the keys of the bitmap ``held``.

    It spares rows an exchange; an exact join must follow.
    """
    placed = frame.withColumn("__place", F.pmod(F.xxhash64(key), F.lit(BITMAP_BITS)))
    joined = placed.join(F.broadcast(held), F.bitmap_bucket_number("__place") == F.col("__bucket"), "left")
    at = F.bitmap_bit_position("__place")
    byte = F.conv(F.hex(F.substring("__bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.expr("shiftright(__byte, cast(bitmap_bit_position(__place) % 8 as int)) & 1 = 1")
    return joined.withColumn("__byte", byte).withColumn(name, F.coalesce(hit, F.lit(False))).drop("__place", "__bucket", "__bits", "__byte")
