"""Parquet tables, and the corpus view that stands files on the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: absolute_path, text, size_bytes, modified_at_ms and content_md5."""
    d = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("/corpus/"), "source", F.lit("/"), "lang", F.lit("/doc-"), F.col("doc_id").cast("string"), F.lit(".md"))
    return d.select("doc_id", path.alias("absolute_path"), "text", "lang", "source", F.octet_length("text").cast("long").alias("size_bytes"), (F.col("doc_id") * 1000).alias("modified_at_ms"), F.md5("text").alias("content_md5"))


def files(spark: SparkSession, root: str, most_bytes: int = 20 << 20) -> DataFrame:
    """Text files of a tree: read whole, size limit pushed to the scan, no NUL bytes, strict UTF-8."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(F.col("length") <= most_bytes)
    ok = F.is_valid_utf8(F.col("content").cast("string")) & (F.instr(F.col("content").cast("string"), "\x00") == 0)
    return f.dropDuplicates(["path"]).where(ok).select("path", F.col("content").cast("string").alias("text"), "length", "modificationTime")
