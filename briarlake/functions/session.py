"""Settings that results depend on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def sound_unions(spark: SparkSession) -> None:
    """Keeps Spark from taking a union of inputs partitioned alike as partitioned: where adaptive execution then coalesces the
    inputs' partitions differently, Spark 4.1 groups or joins rows of one key in two tasks, and the result is wrong."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def settled(df: DataFrame) -> DataFrame:
    """df checkpointed to the session's spark.checkpoint.dir, so that what is used several times is computed once and what a
    model told is told once; without such a folder df as it is."""
    if not df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return df
    return df.checkpoint()
