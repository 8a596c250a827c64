"""Table functions for SQL: the options of a question, and the events of a model's reply."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from briarlake.functions.parsers import parse_events


class ExplodeOptions:
    """letter, text, is_golden of a question's four options and its comma-joined answer."""

    def eval(self, a: str, b: str, c: str, d: str, golden: str) -> Iterator[tuple]:
        letters = {x.strip() for x in (golden or "").split(",")}
        for letter, text in zip("ABCD", (a, b, c, d), strict=True):
            yield letter, text, letter in letters


class ParseEvents:
    """event, doc of a reply that lists events."""

    def eval(self, raw: str) -> Iterator[tuple]:
        for x in parse_events(raw):
            yield x["event"], x["doc"]


def register(spark: SparkSession) -> None:
    """Makes explode_options and parse_events known to spark.sql."""
    spark.udtf.register("explode_options", udtf(ExplodeOptions, returnType="letter string, text string, is_golden boolean"))
    spark.udtf.register("parse_events", udtf(ParseEvents, returnType="event string, doc int"))
