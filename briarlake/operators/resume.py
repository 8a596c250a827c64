"""Resumable work: keys done or failed are kept in a table, and a run works on what is left."""

from __future__ import annotations

import traceback
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "key string, status string, payload string, error string, traceback string, attempt long"


def load(spark: SparkSession, path: str) -> DataFrame:
    """The latest attempt of every key; an absent table is empty."""
    try:
        rows = spark.read.schema(SCHEMA).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], SCHEMA)
    last = rows.groupBy("key").agg(F.max_by(F.struct("status", "payload", "error", "traceback", "attempt"), F.struct("attempt", F.col("status") == "done")).alias("r"))
    return last.select("key", "r.*")


def pending(items: DataFrame, state: DataFrame, retry_failed: bool = False) -> DataFrame:
    """Items whose key is not done and, unless retried, has not failed."""
    skip = state.where("status = 'done'") if retry_failed else state
    return items.join(skip.select("key"), "key", "left_anti")


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def recover(spark: SparkSession, path: str) -> str | None:
    """Puts a table that cannot be read aside, under the name returned, so that work starts anew; a sound or absent one stays."""
    try:
        load(spark, path).agg(F.count("payload")).collect()
        return None
    except Exception:
        p, fs = _path(spark, path)
        k = 0
        while fs.exists(spark._jvm.org.apache.hadoop.fs.Path(aside := f"{path.rstrip('/')}.corrupt{k or ''}")):
            k += 1
        if not fs.rename(p, spark._jvm.org.apache.hadoop.fs.Path(aside)):
            raise
        return aside


def resumable_map(items: DataFrame, work: Callable[[str], str], path: str, retry_failed: bool = False, all_done: bool = False, save_every: int = 1000) -> DataFrame:
    """items: key, payload. Works on pending payloads, appends the outcomes to the table at path, and gives the done rows of
    the items (of all keys with all_done).

    Outcomes are committed in parts of about save_every items, told apart by a hash of the key: what a crash leaves is kept,
    and a task that runs again commits once. A table that cannot be read is put aside first.
    """
    spark = items.sparkSession
    recover(spark, path)
    state = load(spark, path)
    attempt = (state.agg(F.max("attempt")).first()[0] or 0) + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, payload in zip(batch["key"], batch["payload"], strict=True):
                try:
                    rows.append((key, "done", work(payload), None, None, attempt))
                except Exception as e:
                    rows.append((key, "failed", None, f"{type(e).__name__}: {e}", traceback.format_exc()[-800:], attempt))
            yield pd.DataFrame(rows, columns=["key", "status", "payload", "error", "traceback", "attempt"])

    left = pending(items, state.where(F.col("attempt") < attempt), retry_failed).select("key", "payload")
    parts = -(-left.count() // save_every)
    for part in range(parts):
        left.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == part).mapInPandas(run, SCHEMA).write.mode("append").parquet(path)
    done = load(spark, path).where("status = 'done'")
    return (done if all_done else done.join(items.select("key"), "key", "left_semi")).select("key", "payload")


def stage_items(events: DataFrame, payload) -> DataFrame:
    """key, payload of a stage's work over events (asset, event_date, …): the key that all stages share."""
    return events.select(F.concat_ws("_", "asset", F.col("event_date").cast("string")).alias("key"), payload.alias("payload"))


def status(state: DataFrame) -> DataFrame:
    return state.groupBy("status").agg(F.count("*").alias("n"))


def failures(state: DataFrame, most: int = 20) -> DataFrame:
    return state.where("status = 'failed'").select("key", "error").orderBy("key").limit(most)


def reset(spark: SparkSession, path: str, confirm: bool = False) -> bool:
    """Deletes the table, if confirmed."""
    if not confirm:
        return False
    p, fs = _path(spark, path)
    return fs.delete(p, True)
