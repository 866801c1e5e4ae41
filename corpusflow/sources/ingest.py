"""Ingest: content hashes, duplicates, HTML sections, incremental stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def inspect_files(spark: SparkSession, path: str, magic: bytes = b"%PDF", pattern: str = "*.pdf", most: int = 50 << 20) -> DataFrame:
    """(path, sha256, doc_id, length, error) of every file below a folder; the first check that fails is the error. Spark lists no empty files."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    error = F.when(F.col("length") > most, "file too large").when(F.substring("content", 1, len(magic)) != F.lit(bytearray(magic)), "wrong file type")
    sha = F.sha2("content", 256)
    return f.select("path", sha.alias("sha256"), F.substring(sha, 1, 16).alias("doc_id"), "length", error.alias("error"))


def first_by_content(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(sha256, content_id, first, copies): one row for each content, the least key kept."""
    return docs.select(F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("sha256"), key).groupBy("sha256").agg(F.min(key).alias("first"), F.count("*").alias("copies")).withColumn("content_id", F.substring("sha256", 1, 16))


def new_content(batch: DataFrame, store: DataFrame) -> DataFrame:
    """Rows of a batch (sha256, …), one for each content, that the store does not have."""
    return batch.dropDuplicates(["sha256"]).join(store.select("sha256").distinct(), "sha256", "left_anti")


def stale(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_id,) of documents extracted after their newest chunk, or without one."""
    newest = chunks.groupBy("doc_id").agg(F.max("ingested_at").alias("at"))
    return docs.join(newest, "doc_id", "left").where("at IS NULL OR at < extracted_at").select("doc_id")


def sections(pages: DataFrame) -> DataFrame:
    """(page_id, title, n_headings, n_paragraphs, n_links) of web pages."""
    h = F.coalesce("html", F.lit(""))
    return pages.select("page_id", F.regexp_extract(h, r"(?is)<title>(.*?)</title>", 1).alias("title"), *(F.regexp_count(h, F.lit(p)).cast("long").alias(n) for n, p in (("n_headings", "(?i)<h[1-6][ >]"), ("n_paragraphs", "(?i)<p[ >]"), ("n_links", "(?i)<a[ >]"))))


def strip_tags(html):
    """Text of a page without scripts, styles and tags, white space collapsed."""
    t = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)[^>]*>.*?</(?:script|style)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"<[^>]+>", " "), r"\s+", " "))


def strip_html(html: str = "html"):
    return strip_tags(F.col(html))


def status_now(log: DataFrame) -> DataFrame:
    """(doc_id, status): the newest of an append-only log (doc_id, status, at)."""
    return log.groupBy("doc_id").agg(F.max_by("status", "at").alias("status"))


def replace_partition(df: DataFrame, path: str, by: str) -> None:
    """Writes a table so that only the partitions present in ``df`` are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def drop_collection(df: DataFrame, collection: str) -> DataFrame:
    return df.where(F.col("collection_id") != collection)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(name,) of a text list; ``#`` begins a comment."""
    return spark.read.text(path).where("trim(value) <> '' AND NOT ltrim(value) LIKE '#%'").select(F.trim("value").alias("name"))
