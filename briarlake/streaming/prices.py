"""Streams: price series from event files with watermarks, and new files through resumable work."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from briarlake.operators.resume import resumable_map


def daily_closes(events: DataFrame, late: str = "2 days") -> DataFrame:
    """events (ts, asset, value), a stream or a table: mean value per asset and day, once the watermark passed it."""
    df = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if df.isStreaming:
        df = df.withWatermark("ts", late)
    day = F.window("ts", "1 day")
    return df.groupBy(day.alias("w"), "asset").agg(F.avg("value").alias("close")).select("asset", F.to_date("w.start").alias("date"), "close")


def work_on_new_files(spark: SparkSession, source: str, schema: str, path: str, checkpoint: str, work: Callable[[str], str]):
    """Every batch of new files (key, payload) goes through resumable_map once; ends when all files are read."""

    def each(batch: DataFrame, _: int) -> None:
        resumable_map(batch, work, path)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
