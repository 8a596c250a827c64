"""Operators against Python models, hand-made cases and, for all queries, DuckDB."""

from __future__ import annotations

import glob
import hashlib
import itertools
import math
import os
import random
import statistics
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as entry
from briarlake.operators import assemble, evaluate, extract, finalise, gate, resume, retrieve, score, series
from briarlake.plans import registry
from briarlake.sources import files, html, providers

SF = "/root/testdata/sf0.001"


def prices(spark, closes, asset="a"):
    days = pd.date_range("2020-01-01", periods=len(closes)).date
    return spark.createDataFrame([(asset, d, c) for d, c in zip(days, closes, strict=True)], "asset string, date date, close double")


def test_first_statistics_stand_where_windows_fill(spark):
    rng = random.Random(1)
    p = prices(spark, [100 * math.exp(rng.gauss(0, 0.01)) for _ in range(60)])
    z = series.standardised(p).orderBy("date").toPandas()
    assert z["z"].first_valid_index() == 31
    assert series.bipower(p).orderBy("date").toPandas()["sigma"].first_valid_index() == 16
    r = z["ret"]
    assert abs(z["sigma"][40] - r.shift(1).rolling(90, min_periods=30).std()[40]) < 1e-12


def test_jumps_and_flat_series(spark):
    rng = random.Random(3)
    closes = [100.0]
    for i in range(300):
        closes.append(closes[-1] * math.exp(rng.gauss(0, 0.005) + (0.2 if i == 200 else 0)))
    p = prices(spark, closes).unionByName(prices(spark, [5.0] * 50, "flat")).unionByName(prices(spark, [1.0, -2.0, 3.0], "odd"))
    got = series.big_moves(p, "lee_mykland").collect()
    assert len(got) == 1 and got[0].direction == "up"
    t = {r.asset: r for r in series.jump_test(p).select("asset", "n_obs", "threshold").distinct().collect()}
    assert t["flat"].threshold is None and t["odd"].n_obs == 0
    flat = prices(spark, [5.0] * 40 + [6.0])
    assert series.big_moves(flat).first().score == float("inf")
    with pytest.raises(ValueError):
        series.big_moves(p, "other")


def test_consensus_cases(spark):
    cases = {1: [], 2: [2], 3: [2, 2, 3], 4: [0, 1], 5: [1, 2], 6: [2, 3], 7: [0, 2, 2]}
    rows = [(i, f"m{k}", s) for i, c in cases.items() for k, s in enumerate(c)] + [(1, "m0", None)]
    got = {r.item: (r.consensus, r.needs_review) for r in score.consensus(spark.createDataFrame(rows, "item int, model string, score int"), ["item"]).collect()}
    assert got == {1: (None, True), 2: (2, True), 3: (2, False), 4: (0, False), 5: (2, True), 6: (2, False), 7: (2, True)}


def _alpha(units, distance):
    units = [u for u in units if len(u) > 1]
    values = [x for u in units for x in u]
    n = len(values)
    do = sum(distance(a, b) / (len(u) - 1) for u in units for a, b in itertools.permutations(u, 2)) / n
    de = sum(distance(a, b) for a, b in itertools.permutations(values, 2)) / (n * (n - 1))
    return 1.0 if de == 0 else 1 - do / de


@pytest.mark.parametrize(("level", "distance"), [("interval", lambda a, b: (a - b) ** 2), ("nominal", lambda a, b: float(a != b))])
def test_alpha_by_all_pairs(spark, level, distance):
    rng = random.Random(2)
    units = [[rng.randrange(4) for _ in range(rng.randrange(0, 5))] for _ in range(30)]
    df = spark.createDataFrame([(i, x) for i, u in enumerate(units) for x in u], "item int, value int")
    assert abs(score.krippendorff_alpha(df, level=level).first()[0] - _alpha(units, distance)) < 1e-9
    same = spark.createDataFrame([(1, 2), (1, 2), (2, 2), (2, 2)], "item int, value int")
    assert score.krippendorff_alpha(same, level=level).first()[0] == 1.0
    assert math.isnan(score.krippendorff_alpha(same.limit(1), level=level).first()[0])
    with pytest.raises(ValueError):
        score.krippendorff_alpha(same, level="ratio")


def test_sentence_filter(spark):
    cases = [("one two three", False), ("one two three four", True), (" ".join(["w"] * 60), True), (" ".join(["w"] * 61), False), ("the gold price surged a lot", False),
             ("The dollar surged after data", True), ("heavy trading volume was seen", False), ("analysts said it was fine", False)]
    df = spark.createDataFrame(cases, "text string, keep boolean")
    assert df.select("keep", extract.keeps().alias("k")).where("keep <> k").count() == 0


def test_greedy_merge_follows_its_model(spark):
    words = [f"word{i}" for i in range(12)]
    rng = random.Random(5)
    rows = [(t, i, " ".join(rng.sample(words, rng.randrange(2, 6))), rng.choice(["s1", "s2", None])) for t in range(6) for i in range(15)]
    got = {}
    for r in extract.merge_mentions(spark.createDataFrame(rows, "topic int, ord int, text string, source string")).collect():
        got.setdefault(r.topic, []).append((r.ord, r.text, r.n_mentions, r.sources))
    for t in range(6):
        clusters = []
        for _, i, x, s in [r for r in rows if r[0] == t]:
            for c in clusters:
                a, b = set(x.split()), set(c[1].split())
                if len(a & b) / len(a | b) >= 0.45:
                    c[2] += 1
                    c[3].add(s)
                    c[1] = x if len(x) > len(c[1]) else c[1]
                    break
            else:
                clusters.append([i, x, 1, {s}])
        assert sorted(got[t]) == [(a, b, c, sorted(x for x in d if x)) for a, b, c, d in clusters]


def test_balanced_pick_follows_its_model(spark):
    rng = random.Random(7)
    correct, pool = [], []
    for q in range(40):
        correct += [(q, i, " ".join(["c"] * rng.randrange(4, 9))) for i in range(rng.randrange(1, 4))]
        pool += [(q, i, " ".join(["d"] * rng.randrange(3, 14)) + f" {i}", rng.choice(["x", "y", "z"])) for i in range(rng.randrange(0, 8))]
    c, p = spark.createDataFrame(correct, "topic_id int, ord int, text string"), spark.createDataFrame(pool, "topic_id int, ord int, text string, type string")
    got = {}
    for r in assemble.balanced_pick(c, p).collect():
        got.setdefault(r.topic_id, []).append((r.p, r.ord))
    for q in range(40):
        own = [len(t.split()) for i, _, t in correct if i == q]
        mean, need = sum(own) / len(own), 4 - len(own)
        ranked = sorted([(abs(len(t.split()) - mean), o, t, k) for i, o, t, k in pool if i == q])
        picked, seen = [], set()
        for r in ranked:
            if len(picked) < need and r[3] not in seen:
                picked.append(r)
                seen.add(r[3])
        picked += [r for r in ranked if r not in picked][: need - len(picked)]
        ok = len(picked) == need and abs(statistics.mean(len(r[2].split()) for r in picked) - mean) <= 4
        assert [o for _, o in sorted(got.get(q, []))] == ([r[1] for r in picked] if ok else [])


def test_questions_are_well_formed(spark):
    q = registry.queries()["build_questions"](spark, SF).collect()
    assert q and all(r.n_options >= 4 and r.golden_answer for r in q)


def test_rebalance_evens_letters(spark):
    df = spark.createDataFrame([(f"q{i}", "A") for i in range(100)], "id string, golden_answer string")
    shifts = [r["shift"] for r in assemble.rebalanced_shifts(df).collect()]
    assert len(shifts) == 100 and all(abs(shifts.count(s) - 25) <= 1 for s in range(4))


def test_rebalance_follows_the_emptiest_letters(spark):
    rng = random.Random(4)
    for size in (7, 60, 900):
        rows = [(f"q{i}", ",".join(sorted(rng.sample("ABCD", rng.choice([1, 1, 1, 2, 2, 3]))) if rng.random() < 0.7 else ["A"])) for i in range(size)]
        shifts = {r.id: r["shift"] for r in assemble.rebalanced_shifts(spark.createDataFrame(rows, "id string, golden_answer string")).collect()}
        assert set(shifts) == {i for i, _ in rows} and set(shifts.values()) <= {0, 1, 2, 3}

        def spread(deal):
            used = [0] * 4
            for i, g in sorted(rows, key=lambda r: -len(r[1])):
                gold = ["ABCD".index(x) for x in g.split(",")]
                s = deal(i, gold, used)
                for x in gold:
                    used[(x + s) % 4] += 1
            return max(used) - min(used)

        greedy = spread(lambda i, gold, used: min(range(4), key=lambda s: sum(used[(x + s) % 4] for x in gold)))
        assert spread(lambda i, gold, used: shifts[i]) <= greedy + 3


def _flat(spark):
    o = [("one", 3, "correct", True), ("two", 0, "unrelated", False), ("three", 0, "unrelated", False), ("four", 1, "background", False)]
    df = spark.createDataFrame([("gold", 1, o)], "asset string, topic_id int, options array<struct<text:string,consensus:int,type:string,correct:boolean>>")
    return assemble.lettered(df.withColumn("event_date", F.to_date(F.lit("2023-01-02"))).withColumn("target_event", F.lit("t")))


@pytest.mark.parametrize(("shift", "answer"), [(0, "A"), (1, "B"), (3, "D"), (5, "B")])
def test_rotation_moves_everything(spark, shift, answer):
    r = assemble.rotate(_flat(spark).withColumn("shift", F.lit(shift))).first()
    assert r.golden_answer == answer and r[f"option_{answer}"] == "one" and r.causal_strength[answer] == 3 and r.option_types[answer] == "correct"
    assert assemble.inconsistent(assemble.rotate(_flat(spark).withColumn("shift", F.lit(shift)))).count() == 0
    assert assemble.shuffled_positions(_flat(spark)).first().golden_answer in "ABCD"


def test_events_stay_in_one_split(spark):
    rows = [(f"q{i}", f"a{i % 3}", f"2023-01-{1 + i % 17:02d}") for i in range(120)] + [("solo", "z", "2023-05-05")]
    out = finalise.split_events(spark.createDataFrame(rows, "id string, asset string, event_date string")).collect()
    by_event = {}
    for r in out:
        by_event.setdefault((r.asset, r.event_date), set()).add(r.split)
    assert len(out) == 121 and all(len(s) == 1 for s in by_event.values()) and by_event["z", "2023-05-05"] == {"test"}


def test_assignment_loads(spark):
    out = finalise.assign_reviews(spark.createDataFrame([(i,) for i in range(20)], "item int")).collect()
    loads = sorted(sum(r.annotator == a for r in out) for a in range(3))
    assert loads == [8, 9, 9] and len({r.item for r in out if r.is_overlap}) == 3
    sheets = spark.createDataFrame([("x", "k", 1, 1), ("x", "k", None, 2), ("y", "k", 1, 1)], "annotator string, item_key string, your_score int, sheet int")
    got = finalise.collect_reviews(sheets)
    assert {(r.annotator, r.your_score) for r in got.collect()} == {("x", 1), ("y", 1)} and finalise.review_agreement(got).first().alpha == 1.0


def test_metrics(spark):
    df = spark.createDataFrame([(["A"], ["A", "B"]), ([], ["A"]), (["B", "A"], ["A", "B"])], "pred array<string>, gold array<string>")
    r = df.select(*evaluate.metrics()).collect()
    assert (r[0].precision, r[0].recall, round(r[0].f1, 4), r[0].under_selected, r[0].over_selected) == (1.0, 0.5, 0.6667, 1, 0)
    assert (r[1].precision, r[1].f1, r[1].exact_match) == (0.0, 0.0, 0) and r[2].exact_match == 1


def test_gate_fails_what_leaks(spark):
    long_, short = "a long and careful correct answer text with many words inside", "short wrong one"
    rows = [(f"q{i}", "t", *(long_ + f" {i}" if k == i % 4 else f"{short} {i} {k}" for k in range(4)), "ABCD"[i % 4]) for i in range(240)]
    q = spark.createDataFrame(rows, "id string, target_event string, option_A string, option_B string, option_C string, option_D string, golden_answer string")
    o = gate.option_rows(q)
    v = gate.verdict(gate.length_balance(o), gate.structure(o), gate.leakage(o)).first()
    assert v.failures == "leakage,length" and not v.passed
    assert gate.leakage(o.limit(10)).first().error


@pytest.mark.parametrize("features", [1, 2, 5, 12, 40, 2000])
def test_leakage_counts_the_terms_that_plain_counting_finds(spark, features):
    texts = [" ".join("abcdefghij"[(i * j * j + j) % (2 + i % 9)] * 2 for j in range(i % 13)) for i in range(60)]
    counts = Counter(g for t in texts for w in [t.split()] for g in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))])
    want = sorted(counts, key=lambda g: (-counts[g], " " in g, g))[:features]
    said = spark.createDataFrame([(t.split(),) for t in texts], "words array<string>")
    assert gate.top_terms(said, features) == want and (features < 40 or any(" " in g for g in want))


@pytest.mark.parametrize("n", [1, 2, 6, 11, 16, 101, 1003])
def test_leakage_holds_out_a_fifth_by_percent_rank(spark, n):
    df = spark.createDataFrame([(float(i % 3 == 0), hashlib.md5(str(i % 90).encode()).hexdigest()) for i in range(n)], "label double, h string")
    ranges = df.groupBy("label", F.substring("h", 1, 3).alias("range")).agg(F.count("*").alias("n")).collect()
    bounds = gate.held_out(df, ranges)
    place = F.percent_rank().over(Window.partitionBy("label").orderBy("h"))
    assert all((r.h <= bounds[r.label]) == (r.place < 0.2) for r in df.withColumn("place", place).collect())


def test_leakage_moves_keys_and_takes_null_and_empty_texts(spark):
    rows = [(f"q{i}", x, None if i % 7 == 0 else "" if i % 7 == 1 else f"{'right' if x == 'A' else 'wrong'} answer {i % 5}", x == "A") for i in range(80) for x in "ABCD"]
    o = spark.createDataFrame(rows, "id string, letter string, text string, is_golden boolean")
    texts = o.select(F.concat("id", "letter").alias("key"), "text")
    plain, keyed = gate.leakage(o).first(), gate.leakage(o.withColumn("text", F.concat("id", "letter")), texts=texts).first()
    assert plain == keyed and plain.error is None and plain.n_options == 320 and plain.gap_pp >= 0
    assert gate.leakage(o.withColumn("text", F.lit("? !"))).first().error == "no words"


def test_none_options_count_where_they_are_shown(spark):
    none = "None of the other options are correct causes."
    rows = [(f"q{i}", "t", "a b", "c d", "e f", none if i % 5 == 0 else "g h", "D" if i % 5 == 0 else "ABC"[i % 3]) for i in range(50)]
    q = spark.createDataFrame(rows, "id string, target_event string, option_A string, option_B string, option_C string, option_D string, golden_answer string")
    o = gate.option_rows(q)
    m = {r.metric: r.value for r in gate.structure(o).collect()}
    assert (m["none_present_pct"], m["none_correct_pct"]) == (20.0, 100.0)
    assert gate.verdict(gate.length_balance(o), gate.structure(o)).first().failures == "none option"
    plain = gate.option_rows(q.where("golden_answer <> 'D'"))
    assert {r.metric: r.value for r in gate.structure(plain).collect()}["none_correct_pct"] is None
    assert "none" not in gate.verdict(gate.length_balance(plain), gate.structure(plain)).first().failures


def test_topics_draw_what_they_lack(spark):
    """One of three distractors is missing: one comes from another topic, near in time, and none that names another year."""
    t = lambda k, n: " ".join(f"{k}{i}" for i in range(n))
    rows = [(1, "gold", "2023-05-01", 0, t("c", 5), 3, "before"), (1, "gold", "2023-05-01", 1, t("l", 5), 0, "before"), (1, "gold", "2023-05-01", 2, t("m", 6), 1, "before"),
            (2, "gold", "2023-06-01", 0, t("n", 5), 3, "before"), (2, "gold", "2023-06-01", 1, "in 2019 " + t("x", 3), 0, "before"), (3, "gold", "2021-01-01", 0, t("f", 5), 0, "before"),
            (4, "oil", "2023-05-01", 0, t("o", 5), 0, "before"), (5, "gold", "2023-05-20", 0, t("L", 5).replace("L", "l"), 0, "before")]
    c = spark.createDataFrame(rows, "topic_id int, asset string, d string, ord int, text string, consensus int, position string").withColumn("event_date", F.to_date("d"))
    topics = c.select("topic_id", F.lit("a move").alias("target_event")).distinct()
    built = {r.topic_id: r for r in assemble.build_questions(c, topics, none_prob=0.0).collect()}
    texts = [built[1][f"option_{x}"] for x in "ABCD"]
    assert sorted(texts) == sorted([t("c", 5), t("l", 5), t("m", 6), t("n", 5)])
    assert sorted(built[1].option_types.values()) == ["background", "correct", "semantic_crosstopic", "unrelated"]
    # with the near one gone, the whole pool is met
    far = {r.topic_id: r for r in assemble.build_questions(c.where("topic_id <> 2"), topics, none_prob=0.0).collect()}
    assert t("f", 5) in [far[1][f"option_{x}"] for x in "ABCD"]


def test_first_candidates_are_scored_or_zeroed(spark):
    c = spark.createDataFrame([(1, i, f"t{i}", p) for i, p in enumerate(["before", "after", None, "unknown", "after"])], "topic_id int, ord int, text string, position string")
    assert [r.ord for r in score.auto_zero(c, 3).collect()] == [1] and sorted(r.ord for r in score.to_score(c, 3).collect()) == [0, 2]
    both = score.auto_zero(c).select("ord").unionByName(score.to_score(c).select("ord"))
    assert sorted(r.ord for r in both.collect()) == [0, 1, 2, 3, 4]


def test_scoring_by_several_models(spark):
    c = spark.createDataFrame([(1, 0, "x", "before"), (1, 1, "y", "after"), (1, 2, "z", "before"), (2, 0, "w", "before")], "topic_id int, ord int, text string, position string")
    topics = spark.createDataFrame([(1, "e1"), (2, "e2")], "topic_id int, target_event string")
    docs = spark.createDataFrame([(1, 0, "report", "relevant", "s", "d"), (1, 1, "noise", "distractor", "s", "d")], "topic_id int, ord int, content string, role string, source string, doc_date string")

    def first(prompt):
        assert "noise" not in prompt and ("e2" in prompt or "[s d]\nreport" in prompt)
        return '{"score": 2}' if "Candidate: x" in prompt else "7" if "Candidate: z" in prompt else '{"score": 9}'

    def second(prompt):
        raise ValueError("model_not_found")

    out = {(r.topic_id, r.ord): r for r in score.score_topics(c, topics, docs, {"a": first, "b": second}, asking={"retries": 1}).collect()}
    assert (out[1, 0].consensus, out[1, 0].review_reason) == (2, "only one model scored this, no cross-check")
    assert (out[1, 1].consensus, out[1, 1].auto_zero) == (0, "dated after the target event") and out[1, 2].review_reason == out[2, 0].review_reason == "no model scored this"
    told = score.rate(c, topics, docs, {"b": second}, asking={"retries": 1, "workers": 1})
    assert {r.failure for r in told.collect()} == {"ValueError", "unavailable"}

    def lists(prompt):
        if "e2" in prompt:
            raise OSError("down")
        assert "1. x\n2. z" in prompt
        return 'so: [{"n": 1, "score": 3, "why": "w"}, {"n": 2'

    once = {"retries": 1}
    got = {(r.topic_id, r.ord): r for r in score.score_batched(c, topics, docs, {"m": lists}, asking=once).collect()}
    assert set(got) == {(1, 0), (1, 1), (1, 2)} and got[1, 0].consensus == 3 and not got[1, 0].needs_review and got[1, 2].review_reason == "no score returned"
    failed = score.failed_topics(score.rate_batched(c, topics, docs, {"m": lists}, asking=once)).collect()
    assert [(r.topic_id, r.error) for r in failed] == [(2, "every model failed to score this topic: m: OSError")]
    scored = score.score_topics(c, topics, docs, {"a": first, "b": second}, asking=once)
    again = {(r.topic_id, r.ord): r.consensus for r in score.rescore(scored, topics, docs, {"m": lists}, asking=once).collect()}
    assert again == {(1, 0): 3, (1, 1): 0, (1, 2): None, (2, 0): None}


def test_search_fetch_and_topics(spark):
    pages = {"http://a.reuters.com/1": (200, "<p>" + "word " * 130 + "</p>"), "http://www.bbc.co.uk/2": (200, "<p>short</p>"), "http://www.ft.com/3": (404, "x"), "http://cnn.com/4": (200, "<p>" + "off " * 130 + "</p>")}

    def get(url, params):
        if params["q"] == "NFT market":
            raise OSError("down")
        if params["q"] in ("bitcoin price", "bitcoin selloff investors"):
            return {"hits": [{"url": u, "title": "Markets", "snippet": "a line"} for u in list(pages)[:3]] + [{"url": "http://blog.example/9", "title": "no"}, {"url": "http://cnn.com/x", "title": "gold rate today"}]}
        return {"hits": [{"url": "http://cnn.com/4", "title": "Off"}, {"url": "http://a.reuters.com/1", "title": "On"}]} if params["q"].startswith("block") else {}

    news = providers.HttpNews(get, "http://search", lambda q, day, most: {"q": q, "day": day, "n": most}, lambda r: r.get("hits", []), interval=0.0, sleep=lambda s: None)
    events = spark.createDataFrame([(1, "crypto", "2023-03-01"), (2, "gold", "2023-03-01")], "topic int, asset string, d string").withColumn("date", F.to_date("d"))

    def page(url):
        return pages[url]

    docs = retrieve.topic_documents(events, news.search, lambda hits: providers.fetched(hits, page, delay=0.0))
    got = [(r.topic, r.url, r.role, r.content_is_snippet) for r in docs.orderBy("topic", "ord").collect()]
    assert got == [(1, "http://a.reuters.com/1", "relevant", False), (1, "http://www.bbc.co.uk/2", "relevant", True), (1, "http://www.ft.com/3", "relevant", True), (1, "http://cnn.com/4", "distractor", False)]
    topics = {r.topic: r for r in retrieve.topics_of(docs, events, min_docs=4).collect()}
    assert (topics[1].n_relevant, topics[1].n_distractor, topics[1].n_snippet_only, topics[1].thin) == (3, 1, 2, False) and topics[2].thin and topics[2].n_relevant == 0
    assert providers.dispatch([("live", 1), ("offline", 2)], {}) == 2 and providers.dispatch([("live", 1), ("offline", 2)], {"live": "k"}) == 1
    got = providers.DownloadedPrices(lambda ticker, a, b: [(a, 1.0), (b, None)], {"gold": "G"}).fetch(spark, ["gold"], "2023-01-01", "2023-01-02")
    assert [(str(r.date), r.close) for r in got.collect()] == [("2023-01-01", 1.0)]
    assert providers.probe({"a": lambda p: "hi", "b": lambda p: "", "c": lambda p: 1 / 0}) == {"a": "ok", "b": "empty", "c": "ZeroDivisionError: division by zero"}


def test_thin_topics_are_asked_again(spark):
    body = "Central bank raises rates again today after long talks. " * 8
    docs = spark.createDataFrame([(1, 0, body, "s1", "2023-01-01"), (1, 1, body, "s2", "20230103")], "topic int, ord int, content string, source string, doc_date string")
    docs = docs.withColumn("target", F.lit("gold moved")).withColumn("event_date", F.to_date(F.lit("2023-01-02")))

    def model(prompt):
        if "Already found" in prompt:
            assert "Strike halts output at the port" in prompt
            return '[{"event": "Strike halts all output at the port", "doc": 2}, {"event": "Refinery closes after fire near coast", "doc": 2}]'
        return '[{"event": "Strike halts output at the port", "doc": 1}, {"event": "gold surged to a new record high", "doc": 1}]'

    one = extract.candidates(docs, model).collect()
    assert [(r.text, r.position) for r in one] == [("Strike halts output at the port", "before")]
    two = {r.text: r for r in extract.candidates(docs, model, least=6).collect()}
    r = two["Strike halts all output at the port"]
    assert len(two) == 2 and (r.n_mentions, r.sources, r.position) == (2, ["s1", "s2"], "before") and two["Refinery closes after fire near coast"].position == "after"


def test_context_takes_what_fits(spark):
    rng = random.Random(6)
    rows = [(t, i, "x" * rng.choice([0, 1, 5, 300, 2000])) for t in range(4) for i in range(60)]
    for clip, most in ((1500, 8000), (10, 50), (1, 7)):
        got = {r.topic: r.context for r in retrieve.context(spark.createDataFrame(rows, "topic int, ord int, content string"), clip, most).collect()}
        assert got == {t: "\n\n".join(c[:clip] for k, _, c in rows if k == t and c)[:most] for t in range(4)}


def test_profiles_and_reports(spark):
    q = _flat(spark).withColumn("asset", F.lit("gold"))
    docs = spark.createDataFrame([(1, "a", "relevant", "x y"), (1, "b", "distractor", None), (2, "a", None, "z")], "topic_id int, source string, role string, content string")
    m = {r.metric: r.value for r in finalise.profile(q, docs, published=True).collect()}
    assert m["by_asset:gold"] == 1 and m["docs_per_topic"] == 1.5 and m["unique_sources"] == 2 and m["published:mean_gold"] == 1.574 and m["multi_answer_pct"] == 0
    lines = [r.line for r in evaluate.comparison_lines(evaluate.summary(registry._results(spark, SF))).orderBy("place").collect()]
    assert lines[0].split() == ["model", "n", "exact", "F1", "prec", "recall", "pred/gold"] and lines[2].startswith("m1 ") and len(lines) == 4
    assert files.has_answers(q) and not files.has_answers(q.drop("golden_answer"))


def test_dumps_and_backups(spark, tmp_path):
    q = _flat(spark)
    files.write_dump(q, f"{tmp_path}/d")
    assert files.read_dump(spark, f"{tmp_path}/d").count() == 1 and '"golden_answer":"A"' in spark.read.text(f"{tmp_path}/d/json").first().value
    assert files.backup(spark, f"{tmp_path}/d").endswith("d.backup1") and files.backup(spark, f"{tmp_path}/d").endswith("d.backup2")
    assert files.read_dump(spark, f"{tmp_path}/d.backup2").count() == 1


def test_resume_commits_in_parts_and_recovers(spark, tmp_path):
    path = f"file://{tmp_path}/state"
    items = spark.createDataFrame([(str(i), f"p{i}") for i in range(40)], "key string, payload string")
    log = tmp_path / "log"

    def work(p):
        with open(log, "a") as f:
            f.write(p + "\n")
        return p

    assert resume.resumable_map(items, work, path, save_every=10).count() == 40
    assert len(log.read_text().split()) == 40 and resume.resumable_map(items, work, path, save_every=10).count() == 40 and len(log.read_text().split()) == 40
    for f in (tmp_path / "state").glob("*.parquet"):
        f.write_bytes(b"broken")
    assert resume.resumable_map(items.limit(3), work, path).count() == 3 and (tmp_path / "state.corrupt").exists()
    ev = spark.createDataFrame([("gold", "2023-01-01", "x")], "asset string, event_date string, p string")
    assert tuple(resume.stage_items(ev, F.col("p")).first()) == ("gold_2023-01-01", "x")


def test_resume(spark, tmp_path):
    path, calls = f"file://{tmp_path}/state", []

    def work(p):
        if p == "bad":
            raise ValueError("no")
        return p.upper()

    items = spark.createDataFrame([("1", "a"), ("2", "bad"), ("3", "c")], "key string, payload string")
    assert {tuple(r) for r in resume.resumable_map(items, work, path).collect()} == {("1", "A"), ("3", "C")}
    state = resume.load(spark, path)
    assert resume.pending(items, state).count() == 0 and resume.pending(items, state, retry_failed=True).count() == 1
    assert resume.failures(state).first().error == "ValueError: no" and calls == []
    fixed = resume.resumable_map(items, lambda p: "ok", path, retry_failed=True)
    assert fixed.count() == 3 and {r.status: r.n for r in resume.status(resume.load(spark, path)).collect()} == {"done": 3}
    assert not resume.reset(spark, path) and resume.reset(spark, path, confirm=True) and resume.load(spark, path).isEmpty()


def test_calls_wait_and_retry():
    now, slept = [0.0], []
    sleep = lambda s: (slept.append(s), now.__setitem__(0, now[0] + s))
    answers = iter([RuntimeError("429"), RuntimeError("x"), "fine"])

    def model(prompt):
        a = next(answers)
        if isinstance(a, Exception):
            raise a
        return a

    c = providers.Caller(model, interval=1.0, clock=lambda: now[0], sleep=sleep)
    assert c("p") == "fine" and slept[0] == 20.0 and slept[1] == 4.0

    def quota(prompt):
        raise providers.QuotaError("daily")

    with pytest.raises(providers.QuotaError):
        providers.Caller(quota)("p")


def test_sources_round_trip(spark, tmp_path):
    q = _flat(spark).drop("options", "causal_strength", "option_types", "length_gap")
    files.write_questions(q.withColumn("split", F.lit("train")), f"{tmp_path}/q")
    assert files.read_questions(spark, f"{tmp_path}/q/split=train").first().golden_answer == "A"
    both = files.read_splits(spark, {"train": f"{tmp_path}/q/split=train", "test": f"{tmp_path}/q/split=train"})
    assert {r.split for r in both.collect()} == {"train", "test"}
    (tmp_path / "t.json").write_text('[{"topic_id": 1, "topic": "x", "docs": [{"source": "s"}, {"source": null}]}]')
    assert len(files.read_topics(spark, f"{tmp_path}/t.json").first().docs) == 2
    p = prices(spark, [1.0, None, 3.0])
    p.write.parquet(f"{tmp_path}/p")
    assert providers.TablePrices(f"{tmp_path}/p").fetch(spark, ["a"], "2020-01-01", "2021-01-01").count() == 2
    with pytest.raises(ValueError):
        providers.TablePrices(f"{tmp_path}/p").fetch(spark, ["b"], "2020-01-01", "2021-01-01")
    assert html.main_text("<nav>x</nav><p>a  b</p><script>z</script><p>c") == "a b\nc"


def test_news_search(spark):
    corpus = spark.createDataFrame(
        [("Fed raises rates", "u1", "the fed raises rates today", "2023-03-12 10:00:00"), ("x", "u2", "the fed sleeps", "2023-03-12 10:00:00"), ("y", "u3", "fed raises rates", "2023-03-20 00:00:00")],
        "title string, url string, content string, t string",
    ).withColumn("ts", F.col("t").cast("timestamp_ntz"))
    s = spark.createDataFrame([(1, "Fed rates", "2023-03-13")], "search_id int, query string, d string").withColumn("date", F.to_date("d"))
    assert [r.url for r in providers.CorpusNews(corpus).search(s).collect()] == ["u1"]
    assert retrieve.queries_of(spark.createDataFrame([("gold",), ("none",)], "asset string")).count() == 6


def test_stream_takes_each_file_once(spark, tmp_path):
    from briarlake.streaming.prices import work_on_new_files

    src, state, ck = f"{tmp_path}/in", f"file://{tmp_path}/state", f"{tmp_path}/ck"
    spark.createDataFrame([("1", "a"), ("2", "b")], "key string, payload string").write.parquet(src)
    for _ in range(2):
        work_on_new_files(spark, src, "key string, payload string", state, ck, str.upper).awaitTermination()
    assert resume.load(spark, state).count() == 2


def _plain(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].map(lambda x: "" if x is None or (not isinstance(x, (list, tuple)) and pd.isna(x)) else f"{x:.7g}" if isinstance(x, float) else str(x)[:10] if hasattr(x, "year") else str(x))
        try:
            df[c] = df[c].map(lambda x: x if x == "" else f"{float(x):.7g}")
        except ValueError:
            pass
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_queries_match_the_oracle(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got, want = _plain(registry.queries()[name](spark, SF).toPandas()), _plain(con.execute(registry.oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns) and got.values.tolist() == want.values.tolist()


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
