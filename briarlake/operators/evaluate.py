"""Evaluation: predictions from model answers, set metrics, and where models fail."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from briarlake.functions import parsers, text
from briarlake.operators.retrieve import context
from briarlake.sources.providers import call_model, offline_model

ASK = 'Context:\n%s\n\nEvent: %s\nA. %s\nB. %s\nC. %s\nD. %s\nWhich options caused it? Reply as {"answer": [letters]}.'


def metrics(pred: str = "pred", gold: str = "gold") -> list[Column]:
    """exact_match, precision, recall, f1, sizes, and letters missed and added, of two letter sets."""
    p, g = F.array_distinct(pred), F.array_distinct(gold)
    tp, np_, ng = F.size(F.array_intersect(p, g)), F.size(p), F.size(g)
    pr, re_ = text.ratio(tp, np_), text.ratio(tp, ng)
    return [
        (F.array_sort(p) == F.array_sort(g)).cast("int").alias("exact_match"), pr.alias("precision"), re_.alias("recall"), text.ratio(2 * pr * re_, pr + re_).alias("f1"),
        np_.alias("n_pred"), ng.alias("n_gold"), (ng - tp).alias("under_selected"), (np_ - tp).alias("over_selected"),
    ]


def fallback_id() -> Column:
    return F.coalesce("id", F.concat_ws("_", "asset", F.col("event_date").cast("string")))


def evaluate(questions: DataFrame, docs: DataFrame, model: Callable[[str], str] = offline_model, name: str = "offline", most: int = 20_000) -> DataFrame:
    """Results per question. Questions without documents are asked with an empty context; failed calls select nothing."""
    asked = questions.join(context(docs, most=most).withColumnRenamed("topic", "topic_id"), "topic_id", "left")
    prompt = F.format_string(ASK, F.coalesce("context", F.lit("")), "target_event", "option_A", "option_B", "option_C", "option_D")
    raw = call_model(asked.withColumn("prompt", prompt), model=model)
    out = raw.withColumn("pred", parsers.answer_of(F.coalesce("raw", F.lit("")))).withColumn("gold", text.letters("golden_answer"))
    failed = F.when(F.col("error").isNotNull(), "call").when(F.size("pred") == 0, "parse").alias("failure")
    return out.select(F.lit(name).alias("model"), fallback_id().alias("id"), "asset", "pred", "gold", *metrics(), failed, "raw")


def summary(results: DataFrame, by: tuple[str, ...] = ("model",)) -> DataFrame:
    """Means and totals of results; no results give no row."""
    mean = lambda c, d: F.bround(F.avg(c), d).alias(c)
    return results.groupBy(*by).agg(
        F.count("*").alias("n"), mean("exact_match", 4), mean("f1", 4), mean("precision", 4), mean("recall", 4), F.sum("under_selected").alias("under_selected"),
        F.sum("over_selected").alias("over_selected"), mean("n_pred", 2), mean("n_gold", 2),
    )


def failures_by(results: DataFrame) -> DataFrame:
    """Means by answer size (with the mean number of letters predicted) and by asset, in one pass of grouping sets."""
    g = results.groupingSets([["n_gold"], ["asset"]], "n_gold", "asset")
    predicted = F.when(F.grouping("n_gold") == 0, F.bround(F.avg("n_pred"), 2)).alias("mean_predicted")
    return g.agg(F.count("*").alias("n"), F.bround(F.avg("exact_match"), 3).alias("exact_match"), F.bround(F.avg("f1"), 3).alias("f1"), predicted)


def fooled_and_missed(results: DataFrame, questions: DataFrame) -> DataFrame:
    """Option types of letters chosen wrongly (fooled) and left out (missed), with counts; letters without a type are unknown.

    Of questions with one id that of the largest topic_id counts.
    """
    types = questions.where("option_types is not null").select(fallback_id().alias("id"), "option_types", "topic_id").groupBy("id").agg(F.max_by("option_types", "topic_id").alias("t"))
    both = F.array(
        F.struct(F.lit("fooled").alias("kind"), F.array_except("pred", "gold").alias("l")), F.struct(F.lit("missed").alias("kind"), F.array_except("gold", "pred").alias("l"))
    )
    rows = results.join(types, "id").select("t", F.explode(both).alias("x")).select("t", "x.kind", F.explode("x.l").alias("letter"))
    return rows.groupBy("kind", F.coalesce(F.try_element_at("t", F.col("letter")), F.lit("unknown")).alias("type")).agg(F.count("*").alias("n"))


def comparison_lines(summaries: DataFrame) -> DataFrame:
    """Summaries by model as the lines of an aligned table, the heading first: place, line."""
    head = "%-12s %5s %8s %8s %8s %8s %12s" % ("model", "n", "exact", "F1", "prec", "recall", "pred/gold")
    row = F.format_string("%-12s %5d %8.3f %8.3f %8.3f %8.3f %5.2f/%-6.2f", "model", "n", "exact_match", "f1", "precision", "recall", "n_pred", "n_gold")
    top = summaries.sparkSession.createDataFrame([("", head), (" ", "-" * len(head))], "place string, line string")
    return top.unionByName(summaries.select(F.concat(F.lit("  "), "model").alias("place"), row.alias("line"))).orderBy("place")


def under_over(results: DataFrame) -> DataFrame:
    a = results.agg(F.sum("under_selected").alias("under"), F.sum("over_selected").alias("over"))
    return a.select("under", "over", F.bround(F.try_divide("under", "over"), 1).alias("ratio"))
