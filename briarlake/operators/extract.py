"""Candidate causes: model calls over documents, rule filters, merging of mentions, and a timeline."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from briarlake.functions import fixed, parsers, text
from briarlake.functions.session import settled, sound_unions
from briarlake.operators.retrieve import within_budget
from briarlake.sources.providers import call_model, offline_model

ASK_DOCUMENT = "Event: %s\nList, as a JSON array of short sentences, the facts of this article that happened before it.\nSource: %s\nDate: %s\n\n%s"
ASK_TOPIC = 'Event: %s\nList, as a JSON array of {"event", "doc"}, the facts of these articles that happened before it.\n\n%s'
ASK_AGAIN = 'Event: %s\nAlready found:\n%s\nList further facts as a JSON array of {"event", "doc"}.\n\n%s'


def long_enough(docs: DataFrame, least: int = 200) -> DataFrame:
    return docs.where(F.length(text.strip("content")) >= least)


def from_documents(docs: DataFrame, model: Callable[[str], str] = offline_model, clip: int = 6000) -> DataFrame:
    """One call a document (topic, ord, target, source, doc_date, content, …); a row per event with the document's origin."""
    prompt = F.format_string(ASK_DOCUMENT, "target", F.coalesce("source", F.lit("unknown")), F.coalesce("doc_date", F.lit("unknown")), F.substring("content", 1, clip))
    called = call_model(long_enough(docs).withColumn("prompt", prompt), model=model)
    return called.withColumn("events", parsers.events_of("raw")).select("*", F.posexplode("events").alias("event_ord", "e")).select("*", F.col("e.event").alias("text")).drop("prompt", "raw", "events", "e")


def from_topics(docs: DataFrame, model: Callable[[str], str] = offline_model, found: DataFrame | None = None, clip: int = 9000, budget: int = 250_000) -> DataFrame:
    """One call a topic over the documents that fit; with found (topic, text), the second pass that names what is known.

    An event whose document number matches none belongs to the topic's first document.
    """
    packed = within_budget(long_enough(docs), budget, clip).withColumn("doc", F.row_number().over(Window.partitionBy("topic").orderBy("ord")))
    block = F.format_string("[%d] %s (%s)\n%s", "doc", F.coalesce("source", F.lit("unknown")), F.coalesce("doc_date", F.lit("unknown")), "block")
    topics = packed.groupBy("topic", "target").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("articles"))
    if found is None:
        prompt = F.format_string(ASK_TOPIC, "target", "articles")
    else:
        known = found.groupBy("topic").agg(F.array_join(F.array_sort(F.collect_list("text")), "\n- ").alias("known"))
        topics, prompt = topics.join(known, "topic", "left"), F.format_string(ASK_AGAIN, "target", F.coalesce("known", F.lit("")), "articles")
    called = call_model(topics.withColumn("prompt", prompt), model=model).withColumn("events", parsers.events_of("raw"))
    events = called.select("topic", F.posexplode("events").alias("event_ord", "e")).select("topic", "event_ord", F.col("e.event").alias("text"), F.col("e.doc").alias("doc"))
    origin = packed.select("topic", "doc", F.struct("doc", "source", "doc_date").alias("origin"))
    first = packed.where("doc = 1").select("topic", F.struct("doc", "source", "doc_date").alias("first"))
    joined = events.join(origin, ["topic", "doc"], "left").join(first, "topic")
    return joined.select("topic", "event_ord", "text", F.coalesce("origin", "first").alias("o")).select("topic", "event_ord", "text", "o.source", "o.doc_date")


def need_second_pass(topics: DataFrame, candidates: DataFrame, least: int = 6) -> DataFrame:
    """Topics with fewer candidates than that, those with none included."""
    n = candidates.groupBy("topic").agg(F.count("*").alias("n_found"))
    return topics.join(n, "topic", "left").where(F.coalesce("n_found", F.lit(0)) < least).drop("n_found")


def keeps(x: str = "text", fewest: int = 4, most: int = 60) -> Column:
    """Whether a sentence may be a cause: a fit length, no opinion, and no description of the asset's own price."""
    length = text.word_count(x).between(fewest, most)
    priced = text.contains_any(x, fixed.PRICE_PHRASES) & (text.contains_any(x, fixed.ASSET_WORDS) | text.contains_any(x, fixed.HARD_PRICE_PHRASES))
    return length & ~text.contains_any(x, fixed.OPINION_MARKERS) & ~priced


def merge_mentions(events: DataFrame, threshold: float = 0.45, seed_mentions: bool = False) -> DataFrame:
    """Events (topic, ord, text, source) merged greedily in order: each joins the first cluster whose text tells of the same
    event; the longer text then stands for the cluster, so what later events meet may change.

    The order matters, so a topic's events meet in one task, where they stream by: only its clusters are held, and an event
    is compared with those that share a token or a name with it. Tokens, names and verb families are computed in the JVM
    beforehand. With seed_mentions, n_mentions and sources of an earlier pass are carried on.
    """
    earlier = F.col("sources") if seed_mentions else F.array(F.col("source"))
    made = events.select(
        "topic", "ord", "text", earlier.alias("s"), (F.col("n_mentions") if seed_mentions else F.lit(1)).cast("int").alias("m"),
        text.content_tokens("text").alias("t"), text.entities("text").alias("e"), text.actions("text").alias("a"),
    )
    names = ["topic", "ord", "text", "n_mentions", "sources"]

    def rows(topic, clusters: list[Cluster]) -> list[tuple]:
        return [(topic, c.ord, c.text, c.mentions, sorted(c.sources)) for c in clusters]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        topic, fold, out = None, Fold(threshold), []
        for batch in batches:
            for r in batch.itertuples():
                if r.topic != topic:
                    out += rows(topic, fold.clusters)
                    topic, fold = r.topic, Fold(threshold)
                fold.add(Cluster(r.ord, r.text, set(r.t), set(r.e), set(r.a), r.m, {x for x in r.s if x}))
            if out:
                yield pd.DataFrame(out, columns=names)
                out = []
        yield pd.DataFrame(out + rows(topic, fold.clusters), columns=names)

    kinds = dict(events.dtypes)
    schema = f"topic {kinds['topic']}, ord {kinds['ord']}, text string, n_mentions int, sources array<string>"
    return made.repartition("topic").sortWithinPartitions("topic", "ord").mapInPandas(run, schema)


@dataclass
class Cluster:
    ord: object
    text: str
    tokens: set
    names: set
    actions: set
    mentions: int
    sources: set


class Fold:
    """The clusters of a topic, found by the tokens and names of the texts that stand, or have stood, for them."""

    def __init__(self, threshold: float):
        self.threshold, self.clusters, self.by_word = threshold, [], {}

    def same(self, a: Cluster, b: Cluster) -> bool:
        if not a.tokens or not b.tokens:
            return False
        return len(a.tokens & b.tokens) >= self.threshold * len(a.tokens | b.tokens) or bool(a.names & b.names and a.actions & b.actions)

    def add(self, new: Cluster) -> None:
        met = sorted({k for w in new.tokens | new.names for k in self.by_word.get(w, ())})
        at = next((k for k in met if self.same(new, self.clusters[k])), None)
        if at is None:
            at = len(self.clusters)
            self.clusters.append(new)
        else:
            old = self.clusters[at]
            old.mentions += new.mentions
            old.sources |= new.sources
            if len(new.text) <= len(old.text):
                return
            old.text, old.tokens, old.names, old.actions = new.text, new.tokens, new.names, new.actions
        for w in new.tokens | new.names:
            self.by_word.setdefault(w, set()).add(at)


def timeline(candidates: DataFrame, event_date: str = "event_date", doc_date: str = "doc_date") -> DataFrame:
    """parsed_date and position of each candidate: before (the same day counts), after or unknown; dated first, in order."""
    df = candidates.withColumn("parsed_date", text.parse_event_date(doc_date))
    position = F.when(F.col("parsed_date").isNull(), "unknown").when(F.col("parsed_date") <= F.col(event_date), "before").otherwise("after")
    return df.withColumn("position", position).orderBy("topic", F.asc_nulls_last("parsed_date"), "ord")


def candidates(docs: DataFrame, model: Callable[[str], str] = offline_model, least: int = 0, store: Callable[[DataFrame], DataFrame] = settled) -> DataFrame:
    """From documents (topic, target, event_date, ord, content, source, doc_date) to merged candidates on a timeline.

    One call a topic; topics with fewer than `least` candidates are asked once more, with what was found, and both passes
    merge. A candidate keeps its first mention's date. store(df) writes what a model told: a call that runs again may tell
    something else.
    """
    sound_unions(docs.sparkSession)
    told = store(from_topics(docs, model)).where(keeps("text")).withColumnRenamed("event_ord", "ord")
    found = merge_mentions(told)
    dates = told.select("topic", "ord", "doc_date")
    if least:
        found = store(found)
        few = need_second_pass(docs.select("topic").distinct(), found, least)
        more = store(from_topics(docs.join(few, "topic", "left_semi"), model, found=found.select("topic", "text")))
        more = more.where(keeps("text")).withColumn("ord", F.col("event_ord") + 1_000_000).drop("event_ord")
        dates = dates.unionByName(more.select("topic", "ord", "doc_date"))
        more = more.select("topic", "ord", "text", F.lit(1).alias("n_mentions"), F.array_compact(F.array("source")).alias("sources"))
        found = merge_mentions(found.unionByName(more), seed_mentions=True)
    events = docs.select("topic", "event_date").distinct()
    return timeline(found.join(dates, ["topic", "ord"]).join(events, "topic"))


#: Rules of a tagger that needs no model: label and pattern of a whole word, the first that fits wins.
TAGS = [
    ("DATE", r"(?:19|20)[0-9]{2}|January|February|March|April|June|July|August|September|October|November|December"),
    ("MONEY", r"[$€£][0-9][0-9.,]*"),
    ("PERCENT", r"[0-9][0-9.,]*%"),
    ("ORG", r"[A-Z]{2,6}"),
    ("NAME", r"[A-Z][a-z]{2,}"),
    ("CARDINAL", r"[0-9][0-9.,]*"),
]
#: What may be tagged: words, and numbers with their signs.
TAGGED = r"[$€£]?[0-9]+(?:[.,][0-9]+)*%?|[\p{L}\p{N}_]+"


def tags(x) -> Column:
    """The entities of a text by rules, as an array of (text, label): a JVM stand-in for a trained tagger."""
    label = lambda t: F.coalesce(*[F.when(t.rlike(f"^(?:{p})$"), F.lit(name)) for name, p in TAGS])
    found = F.transform(F.regexp_extract_all(x, F.lit(TAGGED), F.lit(0)), lambda t: F.struct(t.alias("text"), label(t).alias("label")))
    return F.filter(found, lambda t: t["label"].isNotNull())


def label_counts(df: DataFrame, column: str, tagger: Callable[[Iterator[pd.Series]], Iterator[pd.Series]] | None = None) -> DataFrame:
    """label, n, pct of the entities in the distinct texts of a column; tagger: a trained one, as an Arrow UDF's function."""
    tag = F.pandas_udf(tagger, "array<struct<text:string,label:string>>")(column) if tagger else tags(column)
    n = df.select(column).distinct().select(F.explode(tag).alias("e")).groupBy("e.label").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    return n.crossJoin(F.broadcast(total)).select("label", "n", (F.col("n") * 100 / F.col("total")).alias("pct"))
