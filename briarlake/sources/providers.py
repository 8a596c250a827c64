"""Providers that can be swapped: prices, news and models. Each has an offline form, so that everything runs without a network."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from briarlake.functions import fixed, text


class PriceSource(Protocol):
    def fetch(self, spark: SparkSession, assets: list[str], start: str, end: str) -> DataFrame: ...


@dataclass
class TablePrices:
    """Prices from a Parquet table or CSV of asset, date, close."""

    path: str
    format: str = "parquet"

    def fetch(self, spark: SparkSession, assets: list[str], start: str, end: str) -> DataFrame:
        df = spark.read.format(self.format).options(header=True).load(self.path)
        df = df.select("asset", F.col("date").cast("date").alias("date"), F.col("close").cast("double").alias("close"))
        df = df.where(F.col("asset").isin(*assets) & F.col("date").between(start, end)).dropna(subset=["close"])
        if df.isEmpty():
            raise ValueError(f"no prices of {assets} from {start} to {end}")
        return df


@dataclass
class CorpusNews:
    """News from a table of title, url, source, language, content and ts: a query's terms must all be in the text."""

    corpus: DataFrame

    def search(self, searches: DataFrame, before: int = 4, after: int = 1, most: int = 40) -> DataFrame:
        """searches: search_id, query, date. Hits with rank, at most `most` a search.

        Terms and document ids alone are joined, each search on its rarest term; the days of its window bound what it meets.
        The documents themselves join the few hits at the end. Documents are told apart by url and ts.
        """
        from pyspark.sql import Window

        from briarlake.operators.retrieve import in_search_window

        day = lambda c: F.to_date(c)
        docs = self.corpus.select("url", "ts", text.tokens("content").alias("_words"))
        terms = searches.withColumn("_terms", text.tokens("query"))
        wanted = terms.select(F.explode("_terms").alias("_term")).distinct()
        words = docs.select("url", "ts", day("ts").alias("_day"), F.explode("_words").alias("_term")).join(wanted, "_term", "left_semi")
        counts = words.groupBy("_term").agg(F.count("*").alias("_n"))
        rarest = terms.select("search_id", "_terms", "date", F.explode("_terms").alias("_term")).join(counts, "_term", "left")
        rarest = rarest.groupBy("search_id", "_terms", "date").agg(F.min_by("_term", F.struct(F.coalesce("_n", F.lit(0)), "_term")).alias("_term"))
        days = rarest.withColumn("_day", F.explode(F.sequence(F.date_sub("date", before), F.date_add("date", after))))
        met = words.join(days, ["_term", "_day"]).where(in_search_window(F.col("ts"), F.col("date"), before, after))
        met = met.select("search_id", "_terms", "url", "ts").join(docs.distinct(), ["url", "ts"]).where(F.size(F.array_except("_terms", "_words")) == 0)
        rank = F.row_number().over(Window.partitionBy("search_id").orderBy(F.desc("ts"), "url"))
        met = met.withColumn("rank", rank).where(F.col("rank") <= most).select("search_id", "rank", "url", "ts")
        return met.join(self.corpus, ["url", "ts"]).join(searches, "search_id")


@dataclass
class Registry:
    """Search and model providers by name, and which of them have a key."""

    providers: dict[str, str] = field(default_factory=dict)
    keys: dict[str, str] = field(default_factory=dict)

    def available(self) -> list[str]:
        return [m for m, p in self.providers.items() if p == "offline" or self.keys.get(p)]

    def pick(self, preferred: list[str]) -> str:
        """The first preferred model that can be used."""
        for m in preferred:
            if m in self.available():
                return m
        raise ValueError(f"none of {preferred} is available")


class QuotaError(RuntimeError):
    """A daily allowance is used up: retrying is no use."""


@dataclass
class Caller:
    """Calls a model with a least interval between calls, and retries with growing waits; quota errors fail at once."""

    model: Callable[[str], str]
    interval: float = 0.0
    retries: int = 3
    backoff: float = 2.0
    limited_wait: float = 20.0
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    last: float = float("-inf")

    def __call__(self, prompt: str) -> str:
        error: Exception | None = None
        for attempt in range(self.retries):
            wait = self.last + self.interval - self.clock()
            if wait > 0:
                self.sleep(wait)
            self.last = self.clock()
            try:
                return self.model(prompt)
            except QuotaError:
                raise
            except Exception as e:
                error = e
                limited = "429" in str(e)
                if attempt + 1 < self.retries:
                    self.sleep(max(self.limited_wait * (attempt + 1), self.backoff * 2**attempt) if limited else self.backoff * 2**attempt)
        raise RuntimeError(f"{self.retries} attempts failed: {error}") from error


def offline_model(prompt: str) -> str:
    """A deterministic stand-in: its answer depends on the prompt's hash alone."""
    h = hashlib.md5(prompt.encode()).digest()
    return json.dumps({"score": h[0] % 4, "answer": [c for i, c in enumerate("ABCD") if h[1] >> i & 1] or ["A"], "reasoning": "offline"})


Model = Callable[[str], str]

#: Seconds between two calls of a provider.
INTERVALS = {"google": 4.0, "groq": 8.0, "cerebras": 3.0, "azure": 1.0, "openai": 1.0, "anthropic": 1.0}


def call_models(df: DataFrame, models: dict[str, Model], intervals: dict[str, float] | None = None, workers: int | None = None, retries: int = 3, backoff: float = 2.0) -> DataFrame:
    """df (model, prompt, …) with raw and failure: each row's prompt goes to the model that it names.

    A model whose error says that it is unavailable is not asked again by that task: it would fail every time. Each model
    keeps its own interval between calls. A failure names the error's type: that of the last attempt. Write the result before
    it is used twice.
    """
    schema = StructType([*df.schema.fields, StructField("raw", StringType()), StructField("failure", StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        callers = {m: Caller(f, (intervals or {}).get(m, 0.0), retries, backoff) for m, f in models.items()}
        dead: set[str] = set()
        for batch in batches:
            raw, failure = [], []
            for m, p in zip(batch["model"], batch["prompt"], strict=True):
                out, why = None, "unavailable" if m in dead or m not in callers else None
                if why is None:
                    try:
                        out = callers[m](p or "")
                    except Exception as e:
                        why = type(e.__cause__ or e).__name__
                        if any(x in str(e) for x in fixed.DEAD_MODEL):
                            dead.add(m)
                raw.append(out)
                failure.append(why)
            yield batch.assign(raw=raw, failure=failure)

    return (df.repartition(workers) if workers else df).mapInPandas(run, schema)


@dataclass
class HttpNews:
    """News by an HTTP search. get(url, params) gives the decoded reply, a dict; it is injected, so nothing here opens a socket.

    A failed search is tried again with doubled waits, then gives nothing. Hits are filtered as in retrieve.filter_hits.
    """

    get: Callable[[str, dict], dict]
    url: str
    params: Callable[[str, str, int], dict]
    hits: Callable[[dict], list[dict]]
    keep_all_if_none: bool = False
    interval: float = 12.0
    retries: int = 4
    sleep: Callable[[float], None] = time.sleep

    def search(self, searches: DataFrame, most: int = 40) -> DataFrame:
        from briarlake.operators.retrieve import filter_hits

        get, url, params, hits, sleep, interval, retries = self.get, self.url, self.params, self.hits, self.sleep, self.interval, self.retries

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            caller = Caller(lambda x: json.dumps(get(url, json.loads(x))), interval, retries, interval, interval, sleep=sleep)
            for batch in batches:
                rows = []
                for s in batch.itertuples():
                    try:
                        found = hits(json.loads(caller(json.dumps(params(s.query, str(s.date), most)))))[:most]
                    except Exception:
                        found = []
                    rows += [(s.search_id, i, *(h.get(k) for k in ("url", "title", "source", "language", "snippet", "reported_date"))) for i, h in enumerate(found)]
                yield pd.DataFrame(rows, columns=["search_id", "rank", "url", "title", "source", "language", "snippet", "reported_date"])

        schema = "search_id string, rank int, url string, title string, source string, language string, snippet string, reported_date string"
        asked = searches.select(F.col("search_id").cast("string").alias("search_id"), "query", F.col("date").cast("string").alias("date"))
        found = asked.mapInPandas(run, schema)
        host = text.host("url")
        return filter_hits(found.withColumn("source", F.coalesce("source", F.when(host != "", host))), self.keep_all_if_none)


def dispatch(sources: list[tuple[str, object]], keys: dict[str, str]):
    """The first search source whose key is set; the last needs none."""
    for name, source in sources[:-1]:
        if keys.get(name):
            return source
    return sources[-1][1]


def fetched(hits: DataFrame, get: Callable[[str], tuple[int, str]], delay: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """hits (url, …) with html; get(url) gives status and body. Any error, and any status but 200, gives null."""
    schema = StructType([*hits.schema.fields, StructField("html", StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pages = []
            for u in batch["url"]:
                try:
                    status, body = get(u)
                except Exception:
                    status, body = 0, None
                pages.append(body if status == 200 else None)
                sleep(delay)
            yield batch.assign(html=pages)

    return hits.mapInPandas(run, schema)


@dataclass
class DownloadedPrices:
    """Prices by a download: get(ticker, start, end) gives (date, close) pairs; tickers by asset."""

    get: Callable[[str, str, str], list[tuple[str, float | None]]]
    tickers: dict[str, str]

    def fetch(self, spark: SparkSession, assets: list[str], start: str, end: str) -> DataFrame:
        rows = [(a, str(d), float(c)) for a in assets for d, c in self.get(self.tickers[a], start, end) if c is not None]
        if not rows:
            raise ValueError(f"no prices of {assets} from {start} to {end}")
        df = spark.createDataFrame(rows, "asset string, date string, close double")
        return df.withColumn("date", F.to_date("date")).where(~F.isnan("close"))


def probe(models: dict[str, Model], prompt: str = 'Reply with {"score": 1}') -> dict[str, str]:
    """What each model says to a short prompt: ok, empty, or the error."""
    out = {}
    for name, model in models.items():
        try:
            out[name] = "ok" if (model(prompt) or "").strip() else "empty"
        except Exception as e:
            out[name] = f"{type(e).__name__}: {e}"[:200]
    return out


def call_model(df: DataFrame, prompt: str = "prompt", model: Callable[[str], str] = offline_model, interval: float = 0.0, workers: int | None = None) -> DataFrame:
    """df with raw and error columns. Write the result before it is used twice: a call that runs again may answer otherwise.

    workers bounds how many partitions call at once, which with the interval bounds the rate.
    """
    schema = StructType([*df.schema.fields, StructField("raw", StringType()), StructField("error", StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = Caller(model, interval)
        for batch in batches:
            raw, error = [], []
            for p in batch[prompt]:
                try:
                    raw.append(call(p or ""))
                    error.append(None)
                except Exception as e:
                    raw.append(None)
                    error.append(str(e)[-800:])
            yield batch.assign(raw=raw, error=error)

    spread = df.repartition(workers) if workers else df
    return spread.mapInPandas(run, schema)
