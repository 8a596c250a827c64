"""Scoring by several raters: asking models, consensus, agreement, review queue and report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from briarlake.functions import fixed, parsers
from briarlake.functions.session import settled, sound_unions
from briarlake.operators.retrieve import evidence
from briarlake.sources.providers import Model, call_models


ASK_ONE = """How strongly did the candidate cause the event? Judge by the reports alone.

Event: %s
Candidate: %s
Reports:
%s

3 is a main driver, 2 a contributing cause, 1 background or a minor influence, 0 no cause: this goes for what came after the
event and for what is merely about the same subject. Reply with JSON alone: {"reasoning": "one sentence", "score": 0}"""
ASK_ALL = """How strongly did each candidate cause the event? Judge by the reports alone.

Event: %s
Reports:
%s
Candidates:
%s

3 is a main driver, 2 a contributing cause, 1 background or a minor influence, 0 no cause: this goes for what came after the
event and for what is merely about the same subject. Reply with a JSON list alone, an object for each candidate in order:
[{"n": 1, "score": 3, "why": "brief"}]"""
_SCORED = "consensus int, spread int, mean double, needs_review boolean, review_reason string, auto_zero string"


def consensus(ratings: DataFrame, keys: list[str]) -> DataFrame:
    """Per candidate: consensus, spread, mean, needs_review and review_reason of its non-null scores.

    ratings: keys, model, score (null for a failure), and failure if what went wrong is known. One score is taken as it is
    and reviewed; of more, the median rounded half to even, reviewed at a spread of 2 or more or at a median of 1.5.
    """
    failure = F.concat_ws(": ", "model", "failure") if "failure" in ratings.columns else F.col("model")
    a = ratings.groupBy(*keys).agg(
        F.count("score").alias("n_scores"), F.min("score").alias("_lo"), F.max("score").alias("_hi"), F.median("score").alias("_mid"), F.avg("score").alias("_mean"),
        F.array_sort(F.collect_list(F.when(F.col("score").isNull(), failure))).alias("failures"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("score").isNotNull(), F.struct("model", "score"))))).alias("model_scores"),
    )
    spread = (F.col("_hi") - F.col("_lo")).cast("int")
    reason = (
        F.when(F.col("n_scores") == 0, fixed.REVIEW_UNSCORED).when(F.col("n_scores") == 1, fixed.REVIEW_SINGLE)
        .when(spread >= 2, F.format_string(fixed.REVIEW_SPREAD, spread)).when(F.col("_mid") == 1.5, fixed.REVIEW_BOUNDARY)
    )
    return a.select(
        *keys, "n_scores", "model_scores", "failures", F.bround(F.col("_mid")).cast("int").alias("consensus"), spread.alias("spread"),
        F.bround("_mean", 2).alias("mean"), reason.isNotNull().alias("needs_review"), reason.alias("review_reason"),
    )


def _after():
    return F.coalesce(F.col("position") == "after", F.lit(False))


def first_candidates(candidates: DataFrame, most: int = 40) -> DataFrame:
    """The first candidates of every topic (topic_id, ord): only these are scored, whether by rule or by models."""
    rank = F.row_number().over(Window.partitionBy("topic_id").orderBy("ord"))
    return candidates.withColumn("_r", rank).where(F.col("_r") <= most).drop("_r")


def auto_zero(candidates: DataFrame, most: int = 40) -> DataFrame:
    """Of a topic's first candidates those that come after the event: score 0, no model is asked."""
    return first_candidates(candidates, most).where(_after()).select(
        "*", F.lit(0).alias("consensus"), F.lit(0).alias("spread"), F.lit(False).alias("needs_review"), F.lit(fixed.AUTO_ZERO).alias("auto_zero")
    )


def to_score(candidates: DataFrame, most: int = 40) -> DataFrame:
    """Of a topic's first candidates those that models are asked for; an unknown position is no reason to leave one out."""
    return first_candidates(candidates, most).where(~_after())


def _scored(candidates: DataFrame, judged: DataFrame, most: int) -> DataFrame:
    """Candidates with their scores; judged: what models gave, by topic_id and ord. Those scored by rule come along."""
    sound_unions(candidates.sparkSession)
    kinds = dict(f.split() for f in _SCORED.split(", "))
    zero = auto_zero(candidates, most)
    parts = []
    for part in (to_score(candidates, most).join(judged, ["topic_id", "ord"]), zero):
        missing = [F.lit(None).cast(k).alias(c) for c, k in kinds.items() if c not in part.columns]
        parts.append(part.select("*", *missing).select(*candidates.columns, *[F.col(c).cast(k).alias(c) for c, k in kinds.items()]))
    return parts[0].unionByName(parts[1])


def _valid(score: str = "score"):
    return F.when(F.col(score).between(0, 3), F.col(score))


def rate(candidates: DataFrame, topics: DataFrame, docs: DataFrame, models: dict[str, Model], most: int = 40, asking: dict | None = None) -> DataFrame:
    """Every model rates every candidate by itself: topic_id, ord, model, score, failure, written by the caller.

    candidates: topic_id, ord, text, position; topics: topic_id, target_event; docs: topic_id, ord, content, role.
    A reply without a score from 0 to 3 is unparseable. asking: intervals, workers, retries and backoff of the calls.
    """
    asked = to_score(candidates, most).select("topic_id", "ord", "text").join(topics.select("topic_id", "target_event"), "topic_id")
    asked = asked.join(evidence(docs), "topic_id", "left").withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
    prompt = F.format_string(ASK_ONE, "target_event", "text", F.coalesce("context", F.lit("")))
    told = call_models(asked.select("topic_id", "ord", "model", prompt.alias("prompt")), models, **(asking or {})).withColumn("score", parsers.score_of("raw"))
    failure = F.coalesce(F.col("failure"), F.when(_valid().isNull(), "unparseable"))
    return told.select("topic_id", "ord", "model", _valid().alias("score"), failure.alias("failure"))


def score_topics(candidates: DataFrame, topics: DataFrame, docs: DataFrame, models: dict[str, Model], most: int = 40, store=None, asking: dict | None = None) -> DataFrame:
    """Candidates rated one by one by several models, and those after the event at 0. store(df) writes what models told (by default, a checkpoint where the session has a folder for it)."""
    store = store or settled
    return _scored(candidates, consensus(store(rate(candidates, topics, docs, models, most, asking)), ["topic_id", "ord"]), most)


def rate_batched(candidates: DataFrame, topics: DataFrame, docs: DataFrame, models: dict[str, Model], most: int = 40, asking: dict | None = None) -> DataFrame:
    """Every model rates all candidates of a topic at once: a row per topic, model and number that it told, and one without
    a number where it failed: topic_id, model, n, score, failure.

    Numbers are places, from 1, among the topic's candidates that are to be scored.
    """
    listed = numbered(candidates, most).groupBy("topic_id").agg(F.array_sort(F.collect_list(F.struct("n", "text"))).alias("c"))
    lines = F.array_join(F.transform("c", lambda c: F.concat(c["n"].cast("string"), F.lit(". "), c["text"])), "\n")
    asked = listed.join(topics.select("topic_id", "target_event"), "topic_id").join(evidence(docs), "topic_id", "left")
    prompt = F.format_string(ASK_ALL, "target_event", F.coalesce("context", F.lit("")), lines)
    asked = asked.select("topic_id", prompt.alias("prompt"), F.explode(F.array(*[F.lit(m) for m in models])).alias("model"))
    told = call_models(asked, models, **(asking or {})).withColumn("rows", parsers.batch_scores_of("raw"))
    failure = F.coalesce(F.col("failure"), F.when(F.size("rows") == 0, "unparseable"))
    rows = told.select("topic_id", "model", failure.alias("failure"), F.explode_outer("rows").alias("r")).select("topic_id", "model", "r.n", "r.score", "failure")
    # a number told twice counts as told last
    return rows.groupBy("topic_id", "model", "n").agg(F.max("score").alias("score"), F.max("failure").alias("failure"))


def numbered(candidates: DataFrame, most: int = 40) -> DataFrame:
    """Candidates to score with their number in the topic's list."""
    return to_score(candidates, most).withColumn("n", F.row_number().over(Window.partitionBy("topic_id").orderBy("ord")))


def failed_topics(told: DataFrame) -> DataFrame:
    """topic_id, error of the topics that every model failed to score; told: what rate_batched gives."""
    per = told.groupBy("topic_id").agg(F.count("score").alias("n"), F.array_join(F.array_sort(F.collect_set(F.concat_ws(": ", "model", "failure"))), ", ").alias("why"))
    return per.where("n = 0").select("topic_id", F.concat(F.lit("every model failed to score this topic: "), "why").alias("error"))


def score_batched(candidates: DataFrame, topics: DataFrame, docs: DataFrame, models: dict[str, Model], most: int = 40, store=None, asking: dict | None = None) -> DataFrame:
    """Candidates scored by one call per topic and model, and those after the event at 0.

    Candidates that a reply leaves out stay unscored. Of a topic that every model failed only those after the event come
    back, as failed_topics tells. With one model nothing is reviewed but what has no score: there is nothing to compare.
    """
    store = store or settled
    told = store(rate_batched(candidates, topics, docs, models, most, asking))
    alive = told.where("score is not null").select("topic_id", "model").distinct()
    places = numbered(candidates, most).select("topic_id", "ord", "n").join(alive, "topic_id")
    ratings = places.join(told.where("n is not null").select("topic_id", "model", "n", "score"), ["topic_id", "model", "n"], "left")
    judged = consensus(ratings.select("topic_id", "ord", "model", "score"), ["topic_id", "ord"])
    if len(models) == 1:
        unscored = F.col("consensus").isNull()
        judged = judged.withColumn("needs_review", unscored).withColumn("review_reason", F.when(unscored, fixed.REVIEW_MISSING))
    return _scored(candidates, judged, most)


def rescore(scored: DataFrame, topics: DataFrame, docs: DataFrame, models: dict[str, Model], most: int = 40, store=None, asking: dict | None = None) -> DataFrame:
    """scored with the topics that hold an unscored candidate asked again, all their old scores put away; topics whose calls
    fail again stay as they were."""
    own = [f.split()[0] for f in _SCORED.split(", ")]
    asked = scored.join(unscored_topics(scored), "topic_id", "left_semi")
    again = score_batched(asked.drop(*own), topics, docs, models, most, store, asking)
    mended = again.where("auto_zero is null").select("topic_id").distinct()
    return scored.join(mended, "topic_id", "left_anti").unionByName(again.join(mended, "topic_id", "left_semi").select(*scored.columns))


def krippendorff_alpha(ratings: DataFrame, item: str = "item", value: str = "value", level: str = "interval") -> DataFrame:
    """One row: alpha. Units are items of two ratings or more; levels: interval (also asked for as ordinal) and nominal.

    Pairs are never formed: the sum of squared differences of m values is m * sum of squares - square of sum.
    """
    if level not in ("interval", "ordinal", "nominal"):
        raise ValueError(f"unknown level {level!r}")
    r = ratings.where(F.col(value).isNotNull()).select(F.col(item).alias("i"), F.col(value).cast("double").alias("v"))
    if level == "nominal":
        c = r.groupBy("i", "v").agg(F.count("*").cast("double").alias("n"))
        units = c.groupBy("i").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.col("n")).alias("q")).where("m > 1")
        observed = units.agg(F.sum((F.col("m") * F.col("m") - F.col("q")) / (F.col("m") - 1)).alias("o"), F.sum("m").alias("n"))
        total = c.join(units.select("i"), "i", "left_semi").groupBy("v").agg(F.sum("n").alias("n")).agg(F.sum(F.col("n") * F.col("n")).alias("q"))
        parts = observed.crossJoin(total).select("o", "n", (F.col("n") * F.col("n") - F.col("q")).alias("e"))
    else:
        units = r.groupBy("i").agg(F.count("*").cast("double").alias("m"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q")).where("m > 1")
        parts = units.agg(
            F.sum(2 * (F.col("m") * F.col("q") - F.col("s") * F.col("s")) / (F.col("m") - 1)).alias("o"),
            F.sum("m").alias("n"),
            (2 * (F.sum("m") * F.sum("q") - F.sum("s") * F.sum("s"))).alias("e"),
        )
    alpha = 1 - (F.col("o") / F.col("n")) / (F.col("e") / (F.col("n") * (F.col("n") - 1)))
    return parts.select(F.when(F.col("n").isNull(), float("nan")).when(F.col("e") == 0, 1.0).otherwise(alpha).alias("alpha"))


def review_queue(scored: DataFrame) -> DataFrame:
    """Candidates to review, the widest spread first: a range-partitioned sort, no global rank."""
    return scored.where("needs_review").orderBy(F.desc(F.coalesce("spread", F.lit(0))), "topic_id", "ord")


def rescored(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the consensus of new where that has one; only topics that hold an unscored candidate are asked again."""
    return old.join(new.select(*keys, F.col("consensus").alias("_new")), keys, "left").withColumn("consensus", F.coalesce("_new", "consensus")).drop("_new")


def unscored_topics(scored: DataFrame) -> DataFrame:
    return scored.groupBy("topic_id").agg(F.bool_or(F.col("consensus").isNull()).alias("open")).where("open").select("topic_id")


def score_report(topics: DataFrame, scored: DataFrame) -> DataFrame:
    """metric, value: counts by consensus, and topics by what they can give. topics: topic_id, all of them."""
    per_topic = topics.select("topic_id").join(scored, "topic_id", "left").groupBy("topic_id").agg(
        F.count("ord").alias("n"), F.count_if(F.col("consensus") >= 2).alias("correct"), F.count_if(F.col("ord").isNotNull() & F.col("consensus").isNull()).alias("unscored"),
        F.count_if("needs_review").alias("review"), *[F.count_if(F.col("consensus") == s).alias(f"score_{s}") for s in range(4)],
    )
    totals = per_topic.agg(
        *[F.sum(c).alias(c) for c in ("n", "unscored", "review", "score_0", "score_1", "score_2", "score_3")],
        F.count_if(F.expr("correct = 0")).alias("topics_without_correct"), F.count_if(F.expr("n < 4")).alias("topics_under_four"), F.count_if(F.expr("correct >= 1 and n >= 2")).alias("usable_topics"),
    )
    names = totals.columns
    return totals.select(F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in names]), F.array(*[F.col(c).cast("long") for c in names]))).alias("metric", "value"))
