"""Profiles of a question dataset and its documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from briarlake.functions import fixed, text
from briarlake.operators.assemble import LETTERS


def split_sizes(questions: DataFrame) -> DataFrame:
    return questions.groupBy("split").agg(F.count("*").alias("n_questions"), F.count_distinct("topic_id").alias("n_topics"))


def first_by_key(df: DataFrame, key: str, order: str) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")


def multi_answer_share(questions: DataFrame) -> DataFrame:
    return questions.groupBy("split").agg((F.avg(F.coalesce(F.contains("golden_answer", F.lit(",")), F.lit(False)).cast("int")) * 100).alias("multi_pct"))


def answer_count(golden: str = "golden_answer") -> Column:
    """Letters of a raw answer; a missing one counts as one."""
    return F.size(F.split(F.coalesce(F.col(golden), F.lit("nan")), ","))


def cardinality(questions: DataFrame) -> DataFrame:
    n = questions.groupBy(answer_count().alias("n_answers")).agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("t")))).select("n_answers", "n", (F.col("n") / F.col("t")).alias("share"))


def none_options(options: DataFrame, marker: str = fixed.NONE_MARKER) -> DataFrame:
    """By letter: share of none options, and of those that are golden."""
    none = F.coalesce(F.contains("text", F.lit(marker)), F.lit(False))
    return options.groupBy("letter").agg((F.avg(none.cast("int")) * 100).alias("none_pct"), (F.avg((none & F.col("is_golden")).cast("int")) * 100).alias("golden_pct"))


def repeated_options(options: DataFrame) -> DataFrame:
    """Questions with options of one text, by how their labels go together: both_golden, both_distractor or MISMATCH."""
    first = Window.partitionBy("id", text.strip("text"))
    df = options.withColumn("first_letter", F.min("letter").over(first)).withColumn("first_golden", F.min_by("is_golden", "letter").over(first))
    dup = df.where("letter <> first_letter")
    kind = F.when(F.col("is_golden") & F.col("first_golden"), "both_golden").when(F.col("is_golden") != F.col("first_golden"), "MISMATCH").otherwise("both_distractor")
    return dup.select("id", kind.alias("kind")).distinct().groupBy("kind").agg(F.count("*").alias("n"))


def cooccurrence(options: DataFrame) -> DataFrame:
    """How often two letters are golden together; the diagonal is how often one is. At most four rows join per question."""
    g = options.where("is_golden").select("id", "letter")
    return g.join(g.withColumnRenamed("letter", "other"), "id").groupBy("letter").pivot("other", LETTERS).agg(F.count(F.lit(1))).na.fill(0)


def overlap_stats(options: DataFrame) -> DataFrame:
    j = options.withColumn("j", text.jaccard(text.tokens("text"), text.tokens("target_event")))
    return j.groupBy("is_golden").agg(F.avg("j").alias("mean"), F.median("j").alias("median"), F.stddev_samp("j").alias("std"))


def describe(df: DataFrame, column: str) -> DataFrame:
    q = lambda p: F.percentile(column, p)
    return df.agg(F.count(column).alias("count"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).alias("min"),
                  q(0.25).alias("q1"), q(0.5).alias("q2"), q(0.75).alias("q3"), F.max(column).alias("max"))


def value_counts(df: DataFrame, column: str, missing: str = "UNKNOWN") -> DataFrame:
    return df.groupBy(F.coalesce(column, F.lit(missing)).alias(column)).agg(F.count("*").alias("n"))


def top_share(counts: DataFrame, key: str, k: int = 5) -> DataFrame:
    """Share of the k largest counts: a top-k, and a total."""
    top = counts.orderBy(F.desc("n"), key).limit(k).agg(F.sum("n").alias("top"))
    return top.crossJoin(counts.agg(F.sum("n").alias("total"))).select((F.col("top") * 100 / F.col("total")).alias("top_pct"))


def shared_topics(questions: DataFrame) -> DataFrame:
    """Pairs of splits with the number of topics that both hold."""
    t = questions.select("split", "topic_id").distinct()
    pairs = t.withColumnRenamed("split", "a").join(t.withColumnRenamed("split", "b"), "topic_id").where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n_shared"))


def docs_per_question(questions: DataFrame, topics: DataFrame) -> DataFrame:
    """By split: documents of its topics (topic_id, n_docs) over its questions."""
    n = questions.groupBy("split").agg(F.count("*").alias("n"))
    d = questions.select("split", "topic_id").distinct().join(topics, "topic_id").groupBy("split").agg(F.sum("n_docs").alias("docs"))
    return n.join(d, "split", "left").select("split", F.try_divide(F.coalesce("docs", F.lit(0)), "n").alias("docs_per_question"))


def distinct_in_order(df: DataFrame, column: str, order: str) -> DataFrame:
    return df.groupBy(column).agg(F.min(order).alias("first_at"))
