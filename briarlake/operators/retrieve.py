"""Search hits around an event: windows, filters, first hit by URL, and topics."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from briarlake.functions import fixed, text
from briarlake.sources.html import body_text


def in_search_window(published: Column, event: Column, before: int = 4, after: int = 1) -> Column:
    """From `before` days ahead of the event to midnight of the day `after` days later."""
    start = F.date_sub(event, before).cast("timestamp_ntz")
    return published.between(start, F.date_add(event, after).cast("timestamp_ntz"))


def in_client_window(reported: Column, event: Column, today: Column, before: int = 4, after: int = 1, strict: bool = True) -> Column:
    """A day of slack around the search window; a missing date is out only if strict and the event is over 30 days old."""
    inside = reported.between(F.date_sub(event, before + 1), F.date_add(event, after + 1))
    missing = ~(F.lit(strict) & (F.datediff(today, event) > 30))
    return F.when(reported.isNull(), missing).otherwise(inside)


def hits_in_window(events: DataFrame, hits: DataFrame, before: int = 4, after: int = 1) -> DataFrame:
    """events (event_id, date) with the hits (ts, …) of their windows.

    A range join by day buckets: an event lists the few days of its window, hits join on their day, so it stays an equi
    join that hashes and spills; the exact bounds filter afterwards.
    """
    days = events.withColumn("_day", F.explode(F.sequence(F.date_sub("date", before), F.date_add("date", after))))
    joined = days.join(hits.withColumn("_day", F.to_date("ts")), "_day")
    return joined.where(in_search_window(F.col("ts"), F.col("date"), before, after)).drop("_day")


def matches_query(x: str, query_terms: str) -> Column:
    """Whether all the terms stand in the text's tokens."""
    found = text.tokens(x)
    return F.forall(query_terms, lambda t: F.array_contains(found, t))


def filter_hits(hits: DataFrame, keep_all_if_none: bool = False) -> DataFrame:
    """Hits (search_id, title, source, language, …) that are English, no price tables, and from wanted outlets.

    Outlets join as a dimension on dot-suffixes. With keep_all_if_none, a search without any wanted outlet keeps its hits.
    """
    df = hits.where(text.is_english("language") & ~text.is_price_title("title")).withColumn("is_quality", text.is_quality_outlet("source"))
    if not keep_all_if_none:
        return df.where("is_quality")
    any_ = F.max("is_quality").over(Window.partitionBy("search_id"))
    return df.withColumn("_any", any_).where("is_quality or not _any").drop("_any")


def trace(hits: DataFrame) -> DataFrame:
    """Hits with what becomes of them: PRIC, keep or drop."""
    return hits.withColumn("mark", F.when(text.is_price_title("title"), "PRIC").when(text.is_quality_outlet("source"), "keep").otherwise("drop"))


def first_by_url(hits: DataFrame) -> DataFrame:
    """One hit per topic and URL, the first by query and rank; empty URLs are out."""
    w = Window.partitionBy("topic", "url").orderBy("query_ord", "rank")
    return hits.where("url <> ''").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def take_relevant(hits: DataFrame, n: int = 15) -> DataFrame:
    """The first n hits of a topic; queries are asked only while earlier ones have given fewer than n."""
    order = Window.partitionBy("topic").orderBy("query_ord", "rank")
    return first_by_url(hits).withColumn("n", F.row_number().over(order)).where(F.col("n") <= n)


def take_distractors(hits: DataFrame, relevant: DataFrame, n: int = 5, queries: int = 3) -> DataFrame:
    """Off-story hits: none whose URL an on-story query found, max(1, n // queries) a query."""
    off = hits.join(relevant.select("topic", "url").distinct(), ["topic", "url"], "left_anti")
    w = Window.partitionBy("topic", "query_ord").orderBy("rank")
    return first_by_url(off).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= max(1, n // queries)).drop("_n")


def with_content(docs: DataFrame, min_words: int = 120) -> DataFrame:
    """docs (title, snippet, html): the page's text if it has enough words, else title and snippet, else left out."""
    body = body_text("html")
    df = docs.withColumn("_body", body)
    long_ = F.when(text.word_count("_body") >= min_words, F.col("_body"))
    short = F.when(F.coalesce(F.col("snippet"), F.lit("")) != "", F.concat(F.coalesce("title", F.lit("")), F.lit(". "), F.col("snippet")))
    df = df.withColumn("content", F.coalesce(long_, short)).withColumn("content_is_snippet", long_.isNull() & short.isNotNull())
    return df.where(F.length("content") > 0).drop("_body")


def topic_counters(docs: DataFrame, min_docs: int = 5) -> DataFrame:
    """Per topic: documents by role, snippets, words, tokens (1.3 a word), and thin topics."""
    words = F.sum(text.word_count("content"))
    return docs.groupBy("topic").agg(
        F.count_if(F.expr("role = 'relevant'")).alias("n_relevant"), F.count_if(F.expr("role = 'distractor'")).alias("n_distractor"),
        F.count_if("content_is_snippet").alias("n_snippet_only"), words.alias("words"), F.floor(words * 1.3).alias("tokens"),
        (F.count("*") < min_docs).alias("thin"),
    )


def build_topics(relevant: DataFrame, off_story: DataFrame, n_relevant: int = 15, n_distractor: int = 5) -> DataFrame:
    """Documents of every topic with their role and place: relevant ones first."""
    rel = take_relevant(relevant, n_relevant).drop("n")
    both = rel.withColumn("role", F.lit("relevant")).unionByName(
        take_distractors(off_story, relevant, n_distractor).withColumn("role", F.lit("distractor")), allowMissingColumns=True
    )
    order = Window.partitionBy("topic").orderBy(F.desc("role"), "query_ord", "rank")
    return both.withColumn("ord", F.row_number().over(order))


def dimension(spark, table: dict, name: str) -> DataFrame:
    """A small fixed table by asset: queries with their order."""
    rows = [(asset, i, q) for asset, queries in table.items() for i, q in enumerate(queries)]
    return spark.createDataFrame(rows, f"asset string, query_ord int, {name} string")


def queries_of(events: DataFrame, off_story: bool = False, long: bool = False) -> DataFrame:
    """Each event's search queries; assets without any give none. The dimension has a fixed dozen of rows."""
    table = fixed.OFF_STORY_QUERIES if off_story else fixed.LONG_QUERIES if long else fixed.STORY_QUERIES
    return events.join(F.broadcast(dimension(events.sparkSession, table, "query")), "asset")


def merge_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def within_budget(blocks: DataFrame, budget: int = 250_000, clip: int = 9000) -> DataFrame:
    """Documents (topic, ord, content) that fit a topic's prompt, in order, until their running length passes the budget."""
    w = Window.partitionBy("topic").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    df = blocks.withColumn("block", F.substring("content", 1, clip))
    return df.withColumn("running", F.sum(F.length("block")).over(w)).where(F.col("running") <= budget)


def context(docs: DataFrame, clip: int = 1500, most: int = 8000) -> DataFrame:
    """One text per topic: its clipped documents in order, joined by blank lines and clipped. With source and doc_date, each
    document has these at its head; empty documents are left out.

    Only documents that can stand within the clip, or whose blank line can, are gathered: each takes a character and a blank
    line at least.
    """
    body = F.substring("content", 1, clip)
    if {"source", "doc_date"} <= set(docs.columns):
        body = F.concat(F.lit("["), F.coalesce("source", F.lit("")), F.lit(" "), F.coalesce("doc_date", F.lit("")), F.lit("]\n"), body)
    own = docs.where("content <> ''").select("topic", "ord", body.alias("c"))
    order = Window.partitionBy("topic").orderBy("ord")
    own = own.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most // 3 + 2)
    own = own.withColumn("before", F.sum(F.length("c") + 2).over(order.rowsBetween(Window.unboundedPreceding, -1))).where(F.coalesce("before", F.lit(0)) < most + 2)
    parts = own.groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("k", "c"))).alias("p"))
    return parts.select("topic", F.substring(F.array_join(F.transform("p", lambda x: x["c"]), "\n\n"), 1, most).alias("context"))


def evidence(docs: DataFrame) -> DataFrame:
    """topic_id, context of what a scorer sees: the topic's documents (topic_id, ord, content, role), distractors left out."""
    on_story = docs.where(F.coalesce(F.col("role"), F.lit("")) != "distractor") if "role" in docs.columns else docs
    return context(on_story.withColumnRenamed("topic_id", "topic")).withColumnRenamed("topic", "topic_id")


def average_size(topics: DataFrame, column: str = "docs") -> DataFrame:
    """One row: mean length of a list column; null lists count as empty."""
    return topics.agg(F.avg(F.size(F.coalesce(column, F.array()))).alias("mean_size"))


def fullest_topic(counters: DataFrame, by: str = "n_relevant") -> DataFrame:
    """The topic with the most, the first on ties."""
    return counters.orderBy(F.desc(by), "topic").limit(1)


def topic_documents(events: DataFrame, search: Callable[..., DataFrame], fetch: Callable[[DataFrame], DataFrame], n_relevant: int = 15, n_distractor: int = 5, long: bool = False) -> DataFrame:
    """The documents of events (topic, asset, date), found and fetched: role, ord and content of each.

    search(searches, most) gives hits (search_id, rank, url, title, source, snippet, …) of searches (search_id, query, date);
    fetch(hits) gives these with html, null where a page cannot be had. Hits without text fall back on their snippet.
    """

    def hits(off_story: bool, most: int) -> DataFrame:
        queries = queries_of(events, off_story=off_story, long=long and not off_story)
        searches = queries.withColumn("search_id", F.concat_ws("|", F.col("topic").cast("string"), F.col("query_ord").cast("string")))
        found = search(searches.select("search_id", "query", "date"), most)
        return found.drop("query", "date", *[c for c in ("topic", "query_ord") if c in found.columns]).join(searches.select("search_id", "topic", "query_ord"), "search_id")

    per_query = max(1, n_distractor // max(len(q) for q in fixed.OFF_STORY_QUERIES.values()))
    built = build_topics(hits(False, 40), hits(True, per_query * 4), n_relevant, n_distractor)
    return with_content(fetch(built))


def topics_of(documents: DataFrame, events: DataFrame, min_docs: int = 5) -> DataFrame:
    """A row per event with its counters; events without documents have none and are thin."""
    counters = topic_counters(documents, min_docs)
    return events.join(counters, "topic", "left").na.fill(0, [c for c in counters.columns if c.startswith("n_")]).na.fill({"words": 0, "tokens": 0, "thin": True})
