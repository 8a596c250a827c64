"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session; a temporary folder only where it is unset and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _LOCAL:
        _LOCAL.append("file://" + tempfile.mkdtemp(prefix="briarlake-"))
    return _LOCAL[0]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark, path = df.sparkSession, path or fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def deleted(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Tables and broadcasts that are needed until a result is written; both are given back when the block ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self._paths, self._shared = spark, [], []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for shared in self._shared:
            shared.destroy()
        for path in self._paths:
            deleted(self.spark, path)

    def written(self, df: DataFrame, name: str) -> DataFrame:
        self._paths.append(fresh_path(self.spark, name))
        return written(df, name, self._paths[-1])

    def broadcast(self, value):
        self._shared.append(self.spark.sparkContext.broadcast(value))
        return self._shared[-1]


def unused(df: DataFrame, name: str) -> str:
    """The name, with as many underscores before it as no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def ids_and_text(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, under fixed types, whatever else the table holds."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
