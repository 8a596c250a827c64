"""Human review, splits by event, and the dataset's profile."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from briarlake.functions import fixed, text
from briarlake.operators.score import krippendorff_alpha


def assign_reviews(queue: DataFrame, key: str = "item", overlap: float = 0.15, annotators: int = 3, seed: str = "42") -> DataFrame:
    """annotator, item, is_overlap: max(1, floor(n * overlap)) items for everybody, the rest dealt round in hash order.

    Places are counted within the 256 ranges of the hash's first byte, and the counts of the ranges before are added.
    """
    df = queue.select(key).withColumn("h", F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))).withColumn("b", F.substring("h", 1, 2))
    counts = df.groupBy("b").agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("b", before.alias("start"))
    n = counts.agg(F.greatest(F.lit(1), F.floor(F.coalesce(F.sum("c"), F.lit(0)) * overlap)).alias("n_overlap"))
    place = F.row_number().over(Window.partitionBy("b").orderBy("h", key)) - 1
    df = df.withColumn("place", place).join(F.broadcast(starts), "b").withColumn("rn", F.col("place") + F.col("start"))
    df = df.crossJoin(F.broadcast(n)).withColumn("is_overlap", F.col("rn") < F.col("n_overlap"))
    everybody = F.sequence(F.lit(0), F.lit(annotators - 1))
    who = F.when(F.col("is_overlap"), everybody).otherwise(F.array(F.pmod(F.col("rn") - F.col("n_overlap"), F.lit(annotators)).cast("int")))
    return df.select(F.explode(who).alias("annotator"), F.col(key), "is_overlap")


def collect_reviews(sheets: DataFrame) -> DataFrame:
    """annotator, item_key, your_score: of several copies of a row the last that is filled in (by sheet order) counts."""
    return sheets.where("your_score is not null").groupBy("annotator", "item_key").agg(F.max_by("your_score", "sheet").alias("your_score"))


def review_agreement(reviews: DataFrame, least: float = 0.45) -> DataFrame:
    a = krippendorff_alpha(reviews, "item_key", "your_score")
    return a.select("alpha", (~F.isnan("alpha") & (F.col("alpha") >= least)).alias("acceptable"))


def item_key() -> object:
    return F.concat(F.col("topic_id").cast("string"), F.lit("::"), F.substring("text", 1, 40))


def split_events(questions: DataFrame, train: float = 0.7, dev: float = 0.15, seed: str = "42", strata: tuple[str, ...] = ()) -> DataFrame:
    """questions with split: all of an event (asset, event_date) go to one split; each asset's events are dealt in hash order."""
    events = questions.select("asset", "event_date", *strata).dropDuplicates(["asset", "event_date"])
    w = Window.partitionBy("asset", *strata)
    order = F.md5(F.concat(F.lit(seed), "asset", F.col("event_date").cast("string")))
    events = events.withColumn("rn", F.row_number().over(w.orderBy(order, "event_date"))).withColumn("n", F.count("*").over(w))
    n_train, n_dev = F.floor(F.col("n") * train), F.floor(F.col("n") * dev)
    split = F.when(F.col("rn") <= n_train, "train").when(F.col("rn") <= n_train + n_dev, "dev").otherwise("test")
    return questions.join(events.select("asset", "event_date", split.alias("split")), ["asset", "event_date"])


def _metrics(a: DataFrame, names: list[str] | None = None) -> DataFrame:
    names = names or a.columns
    return a.select(F.explode(F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.col(f"`{n}`").cast("double") for n in names]))).alias("metric", "value"))


def profile(questions: DataFrame, docs: DataFrame | None = None, published: bool = False) -> DataFrame:
    """metric, value of a question set; with docs (topic_id, source, role, content) those of its documents too.

    by_asset:x counts the questions of an asset. published adds the source dataset's figures as published:x.
    """
    size = F.size(text.letters("golden_answer"))
    out = _metrics(questions.agg(
        F.count("*").alias("questions"), F.count_distinct("asset", "event_date").alias("events"),
        (F.count("*") / F.greatest(F.lit(1), F.count_distinct("asset", "event_date"))).alias("per_event"), F.avg(size).alias("mean_gold"),
        *[(F.avg((size == k).cast("int")) * 100).alias(f"size_{k}_pct") for k in (1, 2, 3)], (F.avg((size > 1).cast("int")) * 100).alias("multi_answer_pct"),
        F.avg(text.word_count("target_event")).alias("target_words"),
    ))
    assets = questions.groupBy("asset").agg(F.count("*").cast("double").alias("value"))
    out = out.unionByName(assets.select(F.concat(F.lit("by_asset:"), F.coalesce(F.col("asset").cast("string"), F.lit(""))).alias("metric"), "value"))
    if docs is not None:
        out = out.unionByName(document_profile(docs))
    if published:
        out = out.unionByName(out.sparkSession.createDataFrame([(f"published:{k}", float(v)) for k, v in fixed.PUBLISHED.items()], "metric string, value double"))
    return out


def document_profile(docs: DataFrame, top: int = 5) -> DataFrame:
    """metric, value of documents: per topic, words, tokens (1.3 a word), sources, the largest sources' share, distractors."""
    topics = docs.groupBy("topic_id").agg(F.count("*").alias("n"), F.sum(text.word_count(F.coalesce("content", F.lit("")))).alias("words"))
    sources = docs.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count("*").alias("n"), F.count_if(F.col("role") == "distractor").alias("off"))
    most = sources.orderBy(F.desc("n"), "source").limit(top).agg(F.sum("n").alias("most"))
    a = topics.agg(F.avg("n").alias("docs_per_topic"), F.avg("words").alias("words_per_topic"), (F.avg("words") * 1.3).alias("tokens_per_topic"))
    b = sources.agg(F.count_if(F.col("source") != "").alias("unique_sources"), F.sum("n").alias("all"), F.sum("off").alias("off")).crossJoin(F.broadcast(most))
    share = lambda c: F.col(c) * 100 / F.greatest(F.lit(1), F.coalesce("all", F.lit(0)))
    return _metrics(a).unionByName(_metrics(b.select("unique_sources", share("most").alias("top5_source_share_pct"), share("off").alias("distractor_pct"))))


def against_published(report: DataFrame) -> DataFrame:
    """metric, published, found: the source dataset's figures beside those of a report (metric, value)."""
    told = report.sparkSession.createDataFrame([(k, float(v)) for k, v in fixed.PUBLISHED.items()], "metric string, published double")
    return F.broadcast(told).join(report.withColumnRenamed("value", "found"), "metric", "left")
