"""Readers with fixed schemas; malformed rows are dropped or null, never guessed."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.urls import cache_key

CDX = T.StructType([T.StructField(n, T.StringType()) for n in ("url", "filename", "offset", "length", "status", "mime")])
CACHE = "key string, url string, links array<string>"
SCORES = "id string, rank double"


def pages(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, html)."""
    return spark.read.parquet(path).select("page_id", "url", "html")


def cdx_rows(lines: DataFrame, column: str = "value") -> DataFrame:
    """Index records of JSON lines: blank and malformed lines and those without a required field go; offset and length are numbers."""
    parsed = lines.where(F.trim(column) != "").select(F.from_json(column, CDX, {"mode": "PERMISSIVE"}).alias("r")).select("r.*")
    parsed = parsed.withColumns({c: F.expr(f"try_cast({c} as bigint)") for c in ("offset", "length")})
    return parsed.where("url is not null and filename is not null and offset is not null and length is not null")


def cdx(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """The HTML pages that were fetched well, of an index in JSON lines."""
    rows = cdx_rows(spark.read.text(path)).where("status = '200' and mime = 'text/html'")
    return rows if limit is None else rows.limit(limit)


def mock_cdx(spark: SparkSession, n: int, prefix: str = "https://example.org/wiki/Page_") -> DataFrame:
    return spark.range(n).select(F.concat(F.lit(prefix), "id").alias("url"), F.lit("FAKE").alias("filename"), F.lit(0).cast("long").alias("offset"), F.lit(0).cast("long").alias("length"), F.lit("200").alias("status"), F.lit("text/html").alias("mime"))


def mock_links(records: DataFrame, max_links: int = 15, targets: int = 100, seed: int = 42, prefix: str = "https://example.org/wiki/Page_") -> DataFrame:
    """(url, links): between 5 and min(15, max_links) seeded pseudo-random distinct targets a record."""
    most = min(15, max_links)
    how_many = F.least(F.lit(5), F.lit(most)) + F.pmod(F.xxhash64("url", F.lit(seed)), F.lit(max(most - 5, 0) + 1)).cast("int")
    order = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(targets - 1)), lambda i: F.struct(F.xxhash64("url", i, F.lit(seed)).alias("h"), F.concat(F.lit(prefix), i.cast("string")).alias("to"))))
    return records.select("url", F.transform(F.slice(order, F.lit(1), how_many), lambda x: x["to"]).alias("links"))


def with_retries(action: Callable, attempts: int = 3, wait: Callable[[float], None] = time.sleep):
    """The action's result; after a failure it waits 1, 2, 4, ... seconds; null once all attempts failed."""
    for attempt in range(attempts):
        try:
            return action()
        except OSError:
            if attempt + 1 < attempts:
                wait(2**attempt)
    return None


def warc_html(raw: bytes | None) -> str | None:
    """The body of the first response record, as UTF-8 or else Latin-1; null if there is none."""
    import gzip

    try:
        data = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
        for record in data.split(b"WARC/1.")[1:]:
            head, _, rest = record.partition(b"\r\n\r\n")
            if b"warc-type: response" in head.lower():
                body = rest.partition(b"\r\n\r\n")[2].removesuffix(b"\r\n\r\n")
                try:
                    return body.decode("utf-8")
                except UnicodeDecodeError:
                    return body.decode("latin-1")
    except Exception:
        return None
    return None


def warc_pages(records: DataFrame, root: str, attempts: int = 3) -> DataFrame:
    """(url, html) of index records: bytes [offset, offset + length) of files below ``root``, which all executors must see."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            html = []
            for name, offset, length in zip(batch["filename"], batch["offset"], batch["length"], strict=True):

                def fetch(name=name, offset=offset, length=length):
                    with open(f"{root}/{name}", "rb") as f:
                        f.seek(int(offset))
                        return f.read(int(length))

                html.append(warc_html(with_retries(fetch, attempts, lambda s: time.sleep(s * (0.5 + random.random())))))
            yield pd.DataFrame({"url": batch["url"], "html": html})

    return records.select("url", "filename", "offset", "length").mapInPandas(run, "url string, html string")


def _lines_and_wholes(spark: SparkSession, path: str, line: str, held: str, whole: str) -> tuple[DataFrame, DataFrame]:
    """(r) of the lines that are objects with the field ``held``, and of all of each file that has no such line."""
    parsed = spark.read.text(path).select(F.input_file_name().alias("file"), F.from_json("value", line).alias("r")).where(f"r.{held} is not null")
    texts = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    rest = texts.join(parsed.select("file").distinct(), "file", "left_anti")
    return parsed.select("r"), rest.select(F.from_json("value", whole).alias("r"))


def link_cache(spark: SparkSession, path: str) -> DataFrame:
    """(key, url, links) of cached extractions, one JSON object a line, or a file over several lines; corrupt entries are misses."""
    schema = "url string, links array<string>"
    lines, wholes = _lines_and_wholes(spark, path, schema, "url", schema)
    rows = lines.unionByName(wholes).select("r.url", "r.links").where("url is not null and links is not null")
    return rows.select(cache_key(F.col("url")).alias("key"), "url", "links")


def adjacency_json(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst) of lines {"source": ..., "targets": [...]}, or of files with one object from sources to lists of targets; repeats stay."""
    lines, wholes = _lines_and_wholes(spark, path, "source string, targets array<string>", "source", "map<string,array<string>>")
    mapped = wholes.select(F.explode("r").alias("src", "targets"))
    return lines.select(F.col("r.source").alias("src"), "r.targets").unionByName(mapped).select("src", F.explode("targets").alias("dst"))


def edges_csv(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("source string, target string").option("header", True).csv(path)
    return rows.select(F.col("source").alias("src"), F.col("target").alias("dst"))


def snapshot(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """Edges (src, dst) of a stored snapshot; vertices without links are not in it."""
    if form == "parquet":
        return spark.read.parquet(path).select("src", "dst")
    if form == "json":
        return adjacency_json(spark, path)
    if form == "csv":
        return edges_csv(spark, path)
    raise ValueError(f"unknown snapshot form {form!r}")


def version(spark: SparkSession, path: str, number: int) -> DataFrame:
    """Edges of one version of a table partitioned by version."""
    return spark.read.parquet(path).where(F.col("version") == number).select("src", "dst")


def scores(spark: SparkSession, path: str) -> DataFrame:
    """(id, rank) from Parquet, or from one JSON object of numbers; other objects are refused."""
    if not path.endswith(".json"):
        return spark.read.parquet(path).select("id", "rank")
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,double>", {"mode": "FAILFAST"}).alias("m"))
    return rows.select(F.explode("m").alias("id", "rank"))


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def read_or_create(spark: SparkSession, path: str, make: Callable[[], DataFrame | None]) -> DataFrame:
    """The table at the path; if there is none, what ``make`` gives is written there first."""
    if not exists(spark, path):
        made = make()
        if made is None:
            raise FileNotFoundError(path)
        made.write.parquet(path)
    return spark.read.parquet(path)
