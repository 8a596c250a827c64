"""The corpus pipeline: stages over documents, each written as Parquet and reread as the next one's docs.

Every stage takes all rows its predecessor kept, whatever further columns they have, and gives no error on an empty table,
on null, empty or very long texts, or on rows that repeat; what it does with them is told below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from briarlake.llm import decontam, near_dup, packing, pii, quality
from briarlake.llm._store import deleted, fresh_path, written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects. Rows are judged by their text alone, null as empty; ties at the
    cut stay; rows that repeat fall or stay together."""
    return quality.accepted(docs, quality.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group: five-word shingles, similarity 0.8 or more. The smallest doc_id stays,
    one of rows that repeat; rows without a word or a doc_id all stay; rows that share a doc_id only are judged apart."""
    return near_dup.keep_one(docs, words=5, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark window. Null and empty texts hold none; a null doc_id is judged like any."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data, and terms that disclose it, in the texts. All rows stay; null texts stay null."""
    return pii.sanitised(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens. A null or empty text is the closing id alone; each row is packed on its own."""
    return packing.pack(docs)


STAGES = [
    ("quality", good_quality),
    ("near_dup", one_of_each),
    ("decontamination", without_benchmark),
    ("pii", without_personal_data),
    ("packing", packed),
]

#: Model training, near-duplicate groups and tokenizer ids cannot be stated in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        docs = written(stage(spark, docs, sf_dir), name, path)
        if before:
            deleted(spark, before)
        before = path
    return docs
