"""Text functions and parsers against Python models and hand-made cases."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from briarlake.functions import fixed, parsers, text

TEXTS = ["", "One  two\n three", "Élan über_all 3x", "  padded　text ", "The the THE", None, "a b"]


def test_tokens_and_counts_match_python(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    rows = df.select("i", text.tokens("t").alias("k"), text.word_count("t").alias("n"), text.strip("t").alias("s")).collect()
    for r in rows:
        t = TEXTS[r.i]
        if t is not None:
            assert set(r.k) == set(re.findall(r"\w+", t.lower())) and r.n == len(t.split()) and r.s == t.strip()


def test_fixed_values_have_their_sizes():
    assert len(fixed.PRICE_TITLE_PATTERNS) == 15 and len(fixed.QUALITY_DOMAINS) == len(set(fixed.QUALITY_DOMAINS)) == 75
    assert len(fixed.OPINION_MARKERS) == 10 and len(fixed.PRICE_PHRASES) == 75 and len(fixed.ASSET_WORDS) == 10 and len(fixed.HARD_PRICE_PHRASES) == 6
    assert len(set(fixed.STOPWORDS)) == 43 and len(set(fixed.SHORT_STOPWORDS)) == 31 and len(set(fixed.GENERIC_NAMES)) == 42 and len(fixed.ACTION_STEMS) == 10


@pytest.mark.parametrize(("domain", "good"), [("www.bbc.co.uk", True), ("news.bbc.co.uk", True), ("notbbc.co.uk", False), ("", False), (None, False), ("REUTERS.com", True)])
def test_outlets(spark, domain, good):
    df = spark.createDataFrame([(domain,)], "d string")
    assert df.select(text.is_quality_outlet("d")).first()[0] is good


def test_titles_and_languages(spark):
    df = spark.createDataFrame([("Gold rate today", "eng"), ("Fed raises rates", "German"), (None, None), ("24 Karat gold", "English")], "t string, l string")
    assert [tuple(r) for r in df.select(text.is_price_title("t"), text.is_english("l")).collect()] == [(True, True), (False, False), (False, True), (True, True)]


def test_names_actions_and_same_event(spark):
    df = spark.createDataFrame([("Binance halts withdrawals on Monday", "On Tuesday Binance paused all trading"), ("", "Binance halts"), ("Binance grows", "Binance halts withdrawals")], "a string, b string")
    f = lambda c: [text.content_tokens(c), text.entities(c), text.actions(c)]
    (ta, ea, aa), (tb, eb, ab) = f("a"), f("b")
    assert [r[0] for r in df.select(text.same_event(ta, tb, ea, eb, aa, ab)).collect()] == [True, False, False]
    assert df.select(text.entities("a")).first()[0] == ["binance"]


def test_hosts(spark):
    df = spark.createDataFrame([("https://www.Example.com:81/x?y",), ("no url",), (None,)], "u string")
    assert [r[0] for r in df.select(text.host("u")).collect()] == ["example.com:81", "", None]


@pytest.mark.parametrize(("raw", "letters"), [
    ('{"answer":["A","C"]}', ["A", "C"]), ('```json\n{"answer": "b"}\n```', ["B"]), ("the answer is A and C", ["A", "C"]), ("- B. yes", ["B"]), ("", []), (None, []),
    ('so {"answer": ["D"]} it is', ["D"]), ('"answer": [A, B', ["A", "B"]), ("nothing", []), ('["C"]', ["C"]),
])
def test_answers(raw, letters):
    assert parsers.parse_answer(raw) == letters


@pytest.mark.parametrize(("raw", "score"), [('{"score": 2}', 2), ('x {"score": "3"} y', 3), ("score: 1", 1), ("bad", None), (None, None), ('{"other": 1} score=2', 2)])
def test_scores(raw, score):
    assert parsers.parse_score(raw) == score


def test_lists_and_batches():
    assert parsers.parse_events('["a ", "", {"event": "b", "doc": "3"}, {"event": "c", "doc": 3}]') == [{"event": "a", "doc": None}, {"event": "b", "doc": None}, {"event": "c", "doc": 3}]
    assert parsers.parse_events("none") == parsers.parse_events(None) == []
    assert [(x["n"], x["score"]) for x in parsers.parse_batch_scores('[{"n": 1, "score": 9}, {"score": 1}, {"n": 2, "score": -1}]')] == [(1, 3), (2, 0)]


def test_udfs_run_in_workers(spark):
    df = spark.createDataFrame([('{"answer":["A"]}',), (None,)], "t string")
    assert [r[0] for r in df.select(parsers.answer_of("t")).collect()] == [["A"], []]
    assert df.select(F.size(parsers.events_of("t"))).count() == 2


def test_table_functions(spark):
    from briarlake.functions import tables

    tables.register(spark)
    rows = spark.sql("SELECT * FROM explode_options('w', 'x', 'y', NULL, 'B,D')").collect()
    assert [tuple(r) for r in rows] == [("A", "w", False), ("B", "x", True), ("C", "y", False), ("D", None, True)]
    rows = spark.sql("""SELECT t.event, t.doc FROM VALUES ('[{"event": "e", "doc": 2}, "f"]'), ('none') v(raw), LATERAL parse_events(raw) t""").collect()
    assert sorted(map(tuple, rows), key=str) == [("e", 2), ("f", None)]
