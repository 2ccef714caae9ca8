"""Files in and out: document scan, chapter store, reports, text logs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webtables.functions.text import split_title_author
from webtables.operators.documents import index_chapters


def read_documents(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    """Text and markup files below a folder: path, length, format, title, author, content, reason.

    No file is too large unless ``max_bytes`` is given; then larger ones come without content, and ``reason`` says
    so. That test is applied to the listing, so such files are never read. A file scan passes over empty files.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    file_name = F.regexp_extract("path", "([^/]*)$", 1)
    ext = F.lower(F.regexp_extract(file_name, "\\.([^.]*)$", 1))
    kept = files.withColumn("format", F.when(ext == "", "txt").otherwise(ext)).filter(F.col("format").isin("txt", "html", "htm", "xhtml"))
    named = split_title_author(file_name)
    listed = ["path", "length", "format", named["title"].alias("title"), named["author"].alias("author")]
    none = F.lit(None).cast("string")
    if max_bytes is None:
        return kept.select(*listed, "content", none.alias("reason"))
    small = kept.filter(F.col("length") <= max_bytes).select(*listed, "content", none.alias("reason"))
    large = kept.filter(F.col("length") > max_bytes).select(*listed, F.lit(None).cast("binary").alias("content"), F.lit("too large").alias("reason"))
    return small.unionByName(large)


def write_chapters(chapters: DataFrame, path: str, doc: str = "doc_id", buckets: int = 64) -> None:
    """Chapters with their byte ranges as parquet, partitioned by document bucket.

    A range shuffle on (bucket, document, chapter) gives even tasks and few files per bucket whatever the
    document sizes. A chapter is found by its bucket folder and the row-group statistics of the document.
    """
    indexed = chapters if "byte_offset" in chapters.columns else index_chapters(chapters, doc)
    placed = indexed.filter("byte_length > 0").withColumn("bucket", F.pmod(F.xxhash64(doc), F.lit(buckets)))
    ordered = placed.repartitionByRange("bucket", doc, "idx").sortWithinPartitions("bucket", doc, "idx")
    ordered.write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_chapter(spark: SparkSession, path: str, doc_id: int, idx: int, doc: str = "doc_id", buckets: int = 64) -> DataFrame:
    """One chapter: prunes to one bucket folder, then to the row groups of the document."""
    bucket = F.pmod(F.xxhash64(F.lit(doc_id).cast("long")), F.lit(buckets))
    stored = spark.read.parquet(path)
    return stored.filter((F.col("bucket") == bucket) & (F.col(doc) == doc_id) & (F.col("idx") == idx))


def write_report(lines: DataFrame, path: str) -> None:
    """Tab-separated report lines."""
    lines.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def host_listing(sites: DataFrame, host: str = "host", name: str = "name", url: str = "source_url") -> DataFrame:
    """A listing of sites under their host: one line per site, ordered by host; ``sites`` is the host's total."""
    totals = sites.groupBy(host).agg(F.count(F.lit(1)).alias("sites"))
    return sites.select(host, name, url).join(totals, host).orderBy(F.col("sites").desc(), host, name, url)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def parse_log(lines: DataFrame, patterns: Mapping[str, str], value: str = "value") -> DataFrame:
    """Typed fields out of free-text lines: one row per (line, pattern) that matches.

    Each pattern has at most one group; ``number`` is the group as a number when it is one.
    """
    found = F.array(
        *[
            F.struct(
                F.lit(name).alias("field"),
                F.when(F.col(value).rlike(p), F.regexp_extract(value, p, 1 if "(" in p.replace("\\(", "").replace("(?", "") else 0)).alias("text"),
            )
            for name, p in patterns.items()
        ]
    )
    hits = lines.select(F.inline(F.filter(found, lambda x: x["text"].isNotNull())))
    return hits.withColumn("number", F.col("text").try_cast("double"))


def log_summary(fields: DataFrame) -> DataFrame:
    """Matches, positive numbers, sum and maximum per field."""
    return fields.groupBy("field").agg(
        F.count(F.lit(1)).alias("matches"), F.count_if(F.col("number") > 0).alias("positive"),
        F.sum("number").alias("total"), F.max("number").alias("largest"),
    )
