"""The pipeline as a whole against plain versions of its stages, on a small corpus with planted cases."""

from __future__ import annotations

import random
import re
import zlib

import corpus_pipeline
import numpy as np

from briarlake.llm import packing


def corpus(tmp_path, spark):
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("bcdfghklmn") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(3000)]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n)) + "."
    good = {i: prose(rng.randint(30, 300)) for i in range(240)}
    item = prose(20)
    good[5] = good[5] + " " + item
    good[6] = good[6] + " write to ann.lee@mail.example or +1 (555) 010-9999 at 10.0.0.7"
    good[7], good[8] = good[6], good[9] + " extra"
    good[10] = prose(120)
    near = good[10].split()
    near[len(near) // 2] = "changed"
    good[11] = " ".join(near)
    bad = {1000 + i: " ".join(w.upper() + "!!" for w in prose(40).split()) for i in range(80)}
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in {**good, **bad}.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(i < 1000), 0) for i in list(range(20, 180)) + list(range(1000, 1060))]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return good, bad, item


def shingles(t):
    w = t.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def expected(good, item):
    """Texts that stay, in plain steps: near copies of a smaller id go, then the benchmark passage, then personal data."""
    sets, root = {i: shingles(t) for i, t in good.items()}, {i: i for i in good}
    for x in sorted(good):
        for y in sorted(good):
            if x < y and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                a, b = root[x], root[y]
                root = {i: min(a, b) if r in (a, b) else r for i, r in root.items()}
    window = item.rstrip(".").split()
    held = lambda t: any(" ".join(window[k : k + 10]) in re.sub(r"[^a-z0-9 ]", "", t.lower()) for k in range(len(window) - 9))
    out = {i: t for i, t in good.items() if root[i] == i and not held(t)}
    for p, mark in ((r"[\w.]+@[\w.]+\w", "[EMAIL]"), (r"\+1 \(555\) 010-9999", "[PHONE]"), (r"10\.0\.0\.7", "[IP]")):
        out = {i: re.sub(p, mark, t) for i, t in out.items()}
    return out


def test_pipeline_against_plain_stages(spark, tmp_path):
    from tokenizers import Tokenizer

    good, _, item = corpus(tmp_path, spark)
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want, tok = expected(good, item), Tokenizer.from_file(packing.default_tokenizer())
    got: dict[int, list] = {}
    for p in pieces:
        got.setdefault(p.doc_id, []).append(p)
    assert set(got) == set(want)
    assert 5 not in got and 7 not in got and 11 not in got and 6 in got
    for i, t in want.items():
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 0], "<u4")
        ps = sorted(got[i], key=lambda p: p.start)
        assert sum(p.length for p in ps) == len(ids) and all(p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in ps)


def test_stages_keep_the_columns_and_take_effect(spark, tmp_path):
    corpus(tmp_path, spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, n = docs.columns, docs.count()
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
        docs.write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        assert docs.count() < n if k < 3 else docs.count() == n
        n = docs.count()
