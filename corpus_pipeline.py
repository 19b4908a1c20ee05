"""The training-data pipeline: each stage reads what the one before it kept, as a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratiform.llm import decontam, lines, packing, simhash, toxicity
from stratiform.llm.common import Store, session


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, session(spark).read.parquet(f"{sf_dir}/labels.parquet"), Store(spark))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.clean_documents(docs, Store(session(spark)))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, Store(session(spark)))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, session(spark).read.parquet(f"{sf_dir}/benchmark.parquet"), Store(spark))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, in sequences of 2048 tokens; see ``packing.pack``."""
    return packing.pack(docs, Store(session(spark)), packing.tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("simhash_dedup", dedup_documents),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: Learned scores and XXH64 fingerprints can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; stages between the first and last are written and read again.

    What a stage makes of nulls, empty and very long texts, repeated rows, empty tables and clashing column
    names stands with its operator; all but the last keep every column of their documents as it is called.
    """
    store = Store(session(spark))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store.put(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
