"""Readers and writers of the datasets: questions as JSON lines, topics as JSON arrays, events as CSV, review sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUESTIONS = "id string, topic_id long, asset string, event_date string, target_event string, option_A string, option_B string, option_C string, option_D string, golden_answer string"
TOPICS = "topic_id long, topic string, docs array<struct<title:string,url:string,source:string,date:string,content:string>>"
EVENTS = "asset string, date date, pct_move double, direction string, score double"


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QUESTIONS).json(path)


def read_topics(spark: SparkSession, path: str) -> DataFrame:
    """A whole-file array of topics with nested documents."""
    return spark.read.schema(TOPICS).option("multiLine", True).json(path)


def read_splits(spark: SparkSession, paths: dict[str, str], reader=read_questions) -> DataFrame:
    """All splits under one schema, with split and split_ord."""
    out = None
    for i, (name, path) in enumerate(paths.items()):
        df = reader(spark, path).withColumn("split", F.lit(name)).withColumn("split_ord", F.lit(i))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def write_questions(df: DataFrame, path: str) -> None:
    """JSON lines, a folder per split if there are splits."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy("split") if "split" in df.columns else writer).json(path)


def write_events(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema=EVENTS, header=True)


def write_sheets(assignments: DataFrame, path: str) -> None:
    assignments.write.mode("overwrite").partitionBy("annotator").json(path)


def read_sheets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def write_dump(df: DataFrame, path: str) -> None:
    """A stage's rows (topics, extracted, scored) as a table, and as JSON beside it for other programs."""
    df.write.mode("overwrite").parquet(f"{path}/table")
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(f"{path}/json")


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/table")


def backup(spark: SparkSession, path: str) -> str:
    """Copies a file or table to the next free name path.backupN, and gives that name."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(conf)
    k = 1
    while fs.exists(at(f"{path}.backup{k}")):
        k += 1
    if not jvm.org.apache.hadoop.fs.FileUtil.copy(fs, at(path), fs, at(f"{path}.backup{k}"), False, conf):
        raise OSError(f"{path} could not be copied")
    return f"{path}.backup{k}"


def has_answers(df: DataFrame, column: str = "golden_answer") -> bool:
    """Whether a split has answers: a test split lacks the column."""
    return column in df.columns


def report_lines(report: DataFrame) -> DataFrame:
    """metric, value rows as aligned text lines."""
    return report.select(F.format_string("%-28s %s", "metric", F.col("value").cast("string")).alias("line"))
