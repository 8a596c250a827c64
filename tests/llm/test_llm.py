"""The operators of the llm subpackage against brute force, exact round trips and odd inputs."""

from __future__ import annotations

import base64
import gzip
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from briarlake.llm import decontam, html_extract, media_gif, near_dup, packing, pii, quality, suffix_dedup, toxicity, warc
from briarlake.llm._store import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977}" for i in range(20_000))
ODD = [
    (1, None), (2, ""), (3, "   "), (4, "one"), (5, "one two"), (6, "The QUICK brown fox jumps over the lazy dog again and again today"),
    (7, "the quick brown fox jumps over the lazy dog again and again today"), (7, "the quick brown fox jumps over the lazy dog again and again today"),
    (8, LONG), (9, LONG + " end"), (None, "a null id stands here"), (10, "ü ß　é 😀 a  b\n\nc"),
]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    # extra columns whose names the operators use themselves
    return docs(spark, ODD).selectExpr("*", "1 as keys", "2 as h", "'x' as found", "3 as held_out", "4 as row")


@pytest.fixture(scope="module")
def nothing(spark):
    return docs(spark, [])


LABELS = "doc_id long, quality int, toxic int"


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), LABELS)


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


# --- every operator: odd rows, and none


def test_odd_rows_keep_their_place(spark, odd):
    b = bench(spark, [(1, "quick brown fox jumps over the lazy dog again and again"), (2, None), (None, "one"), (3, "")])
    n = len(ODD)
    assert near_dup.groups(odd, 3, 85).count() == n
    assert suffix_dedup.digest(odd).count() == n
    assert pii.spans(odd).count() == n
    assert media_gif.stored(odd).count() == n
    assert decontam.scan(odd, b).count() == n
    assert toxicity.score(odd, toxicity.train(odd, labels(spark))).count() == n
    assert quality.score(odd, quality.train(odd, labels(spark, [(4, 1, 0), (None, 0, 1), (5, None, None)]))).count() == n
    assert {r.doc_id for r in packing.pack(odd).collect()} == {i for i, _ in ODD}
    assert pii.sanitised(odd).columns == odd.columns
    assert decontam.clean(odd, b).columns == odd.columns
    assert near_dup.keep_one(odd).columns == odd.columns


def test_empty_tables(spark, nothing):
    b = bench(spark, [])
    assert near_dup.groups(nothing, 3, 85).count() == 0
    assert suffix_dedup.digest(nothing).count() == 0
    assert pii.spans(nothing).count() == 0 and pii.sanitised(nothing).count() == 0
    assert media_gif.stored(nothing).count() == 0
    assert decontam.scan(nothing, b).count() == 0
    assert packing.pack(nothing).count() == 0
    assert toxicity.score(nothing, toxicity.train(nothing, labels(spark))).count() == 0
    assert quality.score(nothing, quality.train(nothing, labels(spark))).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_extract.extracted(pages).count() == 0


# --- 1 WARC


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/ b\r\nx", "<p>é</p>"), (2, None, None), (3, "http://c", "<p>é</p>"), (4, "http://d", ""), (None, "http://e", "<p>é</p>"), (5, "u", "WARC/1.1\r\n\r\n")]
    path = f"file://{tmp_path}/w"
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    out = {r.page_id: r for r in warc.read(spark, path).collect()}
    assert len(out) == len(rows) and warc.quarantine(spark, path).count() == 0
    assert (out[3].record_type, out[3].refers_to, out[3].payload_bytes) == ("revisit", 1, 9)
    assert (out[4].record_type, out[4].refers_to) == ("revisit", 2) and out[None].refers_to == 1
    assert out[1].payload_digest == base64.b32encode(hashlib.sha1("<p>é</p>".encode()).digest()).decode()


def _warc_record(i: int, payload: bytes) -> bytes:
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = b"HTTP/1.1 200 OK\r\n\r\n" + payload
    head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nWARC-Payload-Digest: sha1:{digest}\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


@pytest.mark.parametrize("zipped", [False, True])
def test_warc_salvage(zipped):
    parts = [_warc_record(i, bytes([65 + i]) * 500) for i in range(6)]
    pack = gzip.compress if zipped else bytes
    parts = [pack(p) for p in parts]
    good = b"".join(parts)
    assert [r.header["warc-record-id"][10:-1] for r in warc.read_archive(good)] == list("012345")
    at = sum(map(len, parts[:2]))
    hurt = bytearray(good)
    hurt[at + len(parts[2]) // 2] ^= 0xFF
    cut = bytes(hurt)[: len(hurt) - 7] + b""
    found = list(warc.read_archive(cut))
    got = [r.header["warc-record-id"][10:-1] for r in found if isinstance(r, warc.Record)]
    gaps = [g for g in found if isinstance(g, warc.Gap)]
    assert [x for x in got if x != "5"] == ["0", "1", "3", "4"]
    assert (gaps[0].first, gaps[0].end) == (at, at + len(parts[2])) and gaps[0].reason
    assert gaps[-1].end == len(cut)


def _told(data):
    return [x.header["warc-record-id"][10:-1] if isinstance(x, warc.Record) else "gap" for x in warc.read_archive(bytes(data))]


@pytest.mark.parametrize("level", [0, 6])
def test_warc_salvage_within_a_member(level):
    rng = random.Random(level)
    parts = [_warc_record(i, bytes(rng.choices(b"abcdefgh <>", k=40_000))) for i in range(6)]
    one = gzip.compress(b"".join(parts), level)
    # a wrong checksum alone costs no record
    assert _told(one[:-6] + bytes([one[-6] ^ 1]) + one[-5:]) == [*"012345", "gap"]
    hurt = bytearray(one)
    hurt[len(one) // 2 + 40] ^= 0xFF
    found = _told(hurt)
    got = [x for x in found if x != "gap"]
    assert "gap" in found and (got[:2] == ["0", "1"] and len(got) == len(set(got)) if level else got == ["0", "1", "2", "4", "5"])
    # behind a broken member, plain records and members are found again
    assert _told(bytes(hurt) + parts[0].replace(b"page:0", b"page:8") + gzip.compress(parts[1].replace(b"page:1", b"page:9")))[-2:] == ["8", "9"]


def test_warc_records_across_members_and_long_headers():
    long = _warc_record(7, b"x").replace(b"WARC-Type", b"WARC-Note: " + b"n" * (3 << 20) + b"\r\nWARC-Type")
    parts = [_warc_record(i, bytes([65 + i]) * 50_000) for i in range(4)] + [long]
    whole = b"".join(parts)
    cuts = [0, 3, 70_000, 140_000, len(whole) - (1 << 20), len(whole)]
    assert _told(b"".join(gzip.compress(whole[a:b]) for a, b in zip(cuts, cuts[1:], strict=False))) == list("01237")
    assert _told(whole) == list("01237")
    # a record cut at the end of its member does not take the next one with it
    assert _told(gzip.compress(parts[0]) + gzip.compress(parts[1][:-9]) + gzip.compress(parts[2])) == ["0", "gap", "2"]


def test_warc_salvage_of_own_archives(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "SEGMENT_BYTES", 3000)
    rng = random.Random(3)
    rows = [(i, f"http://h/{i}", " ".join(str(rng.random()) for _ in range(rng.randrange(1, 200)))) for i in range(120)] + [(500, "u" * (2 << 20), "long url")]
    path = f"{tmp_path}/own"
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), f"file://{path}")
    (file,) = [f for f in (tmp_path / "own").iterdir() if f.name.startswith("part-")]
    data = file.read_bytes()
    assert gzip.decompress(data).count(b"WARC-Record-ID") == len(rows)
    want = [str(i) for i, _, _ in rows]
    assert _told(data) == want
    for share in (0.1, 0.25, 0.5, 0.9):
        hurt = bytearray(data)
        hurt[int(len(data) * share)] ^= 0xFF
        found = _told(hurt)
        lost = set(want) - set(found)
        assert len(lost) <= 1 and found.count("gap") == len(lost) and [x for x in found if x != "gap"] == [x for x in want if x not in lost]
    out = {r.page_id: bytes(r.payload) for r in warc.read(spark, f"file://{path}", payloads=True).collect()}
    assert out == {i: t.encode() for i, _, t in rows}


def test_warc_of_odd_tables(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write(none, f"file://{tmp_path}/none")
    assert warc.read(spark, f"file://{tmp_path}/none").count() == 0
    rows = [(1, "u", "x"), (1, "u", "x"), (2, "u", "x"), (3, "u", "y")]
    again = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as digest", "2 as p", "3 as first")
    warc.write(again, f"file://{tmp_path}/again")
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in warc.read(spark, f"file://{tmp_path}/again").collect()) == [
        (1, "response", None), (1, "response", None), (2, "revisit", 1), (3, "response", None)]


def test_segment_of_a_large_member():
    record = bytes(17 << 20)
    data = warc._segment([warc.member(record)]) + b"\0"
    assert gzip.decompress(data) == record and [type(x).__name__ for x in warc.read_archive(data)] == ["Gap"]


def test_warc_finds_records_behind_garbage():
    data = b"noise WARC/1.0\r\nbroken" + _warc_record(1, b"x") + b"zz" + _warc_record(2, b"y")
    kinds = [type(x).__name__ for x in warc.read_archive(data)]
    assert kinds == ["Gap", "Record", "Gap", "Record"]
    assert list(warc.read_archive(b"")) == []


# --- 2 toxicity


def _distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_is_the_edit_distance():
    rng = random.Random(5)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    entries = {w: i for i, w in enumerate(dict.fromkeys(words))}
    root = toxicity.trie(entries)
    for _ in range(400):
        token = "".join(rng.choice("abc") for _ in range(rng.randint(0, 8)))
        for errors in (1, 2):
            near = [(d, i) for w, i in entries.items() if (d := _distance(token, w)) <= errors]
            assert toxicity.intersect(toxicity.Automaton(token, errors), root) == (min(near) if near else None)


def test_all_entries_take_errors():
    lexicon = toxicity.Lexicon(["scum", "worthless", "disgusting", "moron*", "idio*", "ox"], {"slum"})
    near = {"scvm": 0, "scm": 0, "worhles": 1, "wrthlesz": 1, "disgustn": 2, "mor0ns": 3, "mornic": 3, "idjots": 4, "morn": 3, "xmoron": 3}
    assert {t: lexicon.match(t)[0] for t in near} == near and all(lexicon.match(t)[1] for t in near)
    assert [lexicon.match(t)[0] for t in ("slum", "scvvm", "wrthlz", "marble", "oz", "nitwits")] == [-1] * 6
    # the filter of parts leaves out nothing that the automaton takes
    rng = random.Random(8)
    for _ in range(3000):
        w = list(rng.choice(lexicon.entries).removesuffix("*"))
        for _ in range(rng.randint(1, 2)):
            k = rng.randrange(len(w) + 1)
            w[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "m"])
        t = "".join(w) + rng.choice(["", "s", "ing"])
        exact = min(((d, i) for i, x in enumerate(lexicon.entries) if (d := _entry_distance(t, x)) <= lexicon.allowed[i]), default=(0, -1))
        if t not in lexicon.benign and lexicon.match(t)[1]:
            assert lexicon.match(t) == exact[::-1]
        elif t not in lexicon.benign and lexicon.match(t)[0] < 0:
            assert exact[1] < 0, t


def _entry_distance(token, entry):
    return min(_distance(token[:k], entry[:-1]) for k in range(len(token) + 1)) if entry.endswith("*") else _distance(token, entry)


def test_toxic_terms_misspelled_and_quoted():
    rng = random.Random(2)
    filler = [f"{a}{b}{c}" for a in ("lorem", "dolor", "amet") for b in "aeiou" for c in "xyz"]
    clean = [" ".join(rng.choices(filler, k=60)) for _ in range(200)]
    bad = []
    for t in [" ".join(rng.choices(filler, k=60)) for _ in range(60)]:
        w = t.split()
        for k in (3, 20, 40):
            w[k] = rng.choice(["scoundrel", "nitwit", "blockhead"])
        bad.append(" ".join(w))
    m = toxicity.fit(clean[:150] + bad[:45], [0] * 150 + [1] * 45, 0.2)
    score = lambda texts: m.scores(m.features(m.hits(pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])), len(texts)))
    assert (score(clean[150:]) < 0.5).all() and (score(bad[45:]) >= 0.5).all()
    wrong = [t.replace("scoundrel", "scoundrl").replace("nitwit", "nitw1t").replace("blockhead", "blokhead") for t in bad[45:]]
    told = m.hits(pa.RecordBatch.from_arrays([pa.array(wrong)], ["text"]))
    assert len(told[0]) == 3 * len(wrong) and (told[2] > 0).all()
    assert (score(wrong) > score(clean[150:165])).all()
    quoted = 'They wrote “what a scoundrel” in the report'
    assert m.hits(pa.RecordBatch.from_arrays([pa.array([quoted])], ["text"]))[3].tolist() == [True]
    assert score([quoted])[0] < score(["what a scoundrel you nitwit blockhead"])[0]


def test_context_of_a_toxic_term_counts():
    rng = random.Random(3)
    filler = [f"{a}{b}{c}" for a in ("lorem", "dolor", "amet") for b in "aeiou" for c in "xyz"]
    abuse, report = ["you", "are", "such", "go"], ["paper", "denied", "using", "word"]
    text = lambda: rng.choices(filler, k=50)
    clean = [" ".join([*text(), *report]) for _ in range(100)]
    bad = [" ".join([*text(), *abuse, rng.choice(["scoundrel", "nitwit"]), *abuse]) for _ in range(60)]
    m = toxicity.fit(clean + bad, [0] * 100 + [1] * 60, 0.2)
    base = " ".join(text())
    pair = [f"{base} {' '.join(w)} scoundrel {' '.join(w)}" for w in (abuse, report)]
    f = m.features(m.hits(pa.RecordBatch.from_arrays([pa.array(pair)], ["text"])), 2)
    assert f[0, 5] > 0 > f[1, 5] and m.scores(f)[0] > m.scores(f)[1] + 0.01


def test_quotations_of_any_length():
    m = toxicity.Model(toxicity.Lexicon(["scoundrel"], set()), np.ones(1), np.zeros(toxicity._BUCKETS), np.zeros(toxicity._N))
    quoted = lambda t: m.hits(pa.RecordBatch.from_arrays([pa.array([t])], ["text"]))[3].tolist()
    far = "word " * 200
    for a, b in ('""', "“”", "„“", "»«", "‹›"):
        assert quoted(f"é {a}{far}scoundrel {far}end{b} scoundrel") == [True, False]
        assert quoted(f"{a}one{b} scoundrel {a}two{b}") == [False]
        assert quoted(f"scoundrel {a}one{b} and ({a}the scoundrel{b})") == [False, True]
    assert quoted("« un scoundrel » scoundrel « a »") == [True, False]
    assert quoted('a 5" scoundrel') == [False] and quoted('"scoundrel') == [False] and quoted('5" and "a scoundrel" or "b"') == [True]


def test_scores_against_plain_hits():
    """The scores of the query against tokens, distances, windows and features in plain Python."""
    rng = random.Random(12)
    filler = [f"{a}{b}{c}" for a in ("lorem", "dolor", "amet") for b in "aeiou" for c in "xyz"]
    bad = ["scoundrel", "nitwit", "blockhead", "scowndrel", "nitwits", "ScoundreL", '"nitwit"', "“blokhead”"]
    texts = [" ".join(rng.choices(filler, k=rng.randrange(0, 80))) for _ in range(150)]
    toxic = [" ".join(rng.sample([*rng.choices(filler, k=40), *rng.choices(bad, k=4)], 44)) for _ in range(60)]
    m = toxicity.fit(texts + toxic, [0] * 150 + [1] * 60, 0.2)
    lexicon = m.lexicon
    tokens = lambda t: [(x.start(), x[0].lower()) for x in re.finditer(r"[^\W_]+", t)]

    def match(t):
        if t in lexicon.words:
            return lexicon.words[t], 0
        for k in lexicon.sizes:
            if t[:k] in lexicon.stems:
                return lexicon.stems[t[:k]], 0
        if t in lexicon.benign:
            return None
        near = [(d, i) for i, x in enumerate(lexicon.entries) if (d := _entry_distance(t, x)) <= lexicon.allowed[i]]
        return min(near)[::-1] if near else None

    def plain(t):
        words, hits = tokens(t), []
        marks, opens = toxicity.quotation_marks(t)
        for k, (at, w) in enumerate(words):
            if found := match(w):
                before = [o for p, o in zip(marks, opens, strict=True) if p < at]
                after = [o for p, o in zip(marks, opens, strict=True) if p > at]
                around = [x for _, x in words[max(0, k - toxicity.CONTEXT) : k] + words[k + 1 : k + 1 + toxicity.CONTEXT]]
                near = [m.near[toxicity._buckets([x.encode()])[0]] for x in around]
                hits.append((*found, bool(before and before[-1] and after and not after[0]), sum(near) / len(near) if near else 0.0))
        count = lambda f: sum(map(f, hits))
        plain_hits = [m.strength[e] for e, d, q, _ in hits if not q and not d]
        x = [1, max([0, *plain_hits]) / 4, np.log1p(len(plain_hits)), np.log1p(count(lambda h: not h[2] and h[1] > 0)), np.log1p(count(lambda h: h[2])),
             sum(h[3] for h in hits) / max(1, len(hits)), min(count(lambda h: not h[2]) * 100 / max(1, len(words)), 4)]
        return 1 / (1 + np.exp(-np.clip(np.array(x) @ m.weight, -35, 35)))

    every = texts[:20] + toxic + ["", "ÉTÉ Scoundrél é", "x" * 300]
    got = m.scores(m.features(m.hits(pa.RecordBatch.from_arrays([pa.array(every)], ["text"])), len(every)))
    assert np.allclose(got, [plain(t) for t in every], atol=1e-9) and got[20:80].mean() > 0.5


# --- 3 near duplicates


def _shingles(t, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return set() if not w else {tuple(w)} if len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def _components(rows, k, percent):
    sets, root = {i: _shingles(t, k) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("k", "percent", "large"), [(3, 85, 2000), (5, 80, 3)])
def test_near_duplicates_against_brute_force(spark, monkeypatch, k, percent, large):
    monkeypatch.setattr(near_dup, "LARGE", large)
    rng = random.Random(k)
    rows, passage = [], " ".join(f"p{i}" for i in range(40))
    for g in range(30):
        base = [f"g{g}w{rng.randrange(400)}" for _ in range(rng.choice([4, 60, 150, 400]))]
        if g % 3 == 0:
            base += passage.split()
        for c in range(rng.choice([1, 2, 5, 9])):
            words = list(base)
            for _ in range(rng.randrange(0, max(1, len(words) // 25) + 1)):
                words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
            rows.append((len(rows) * 3 + c, " ".join(words)))
    rows = list({i: (i, t) for i, t in rows}.values()) + [(90001, ""), (90002, None), (90003, "Solo word"), (90004, "solo WORD")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.groups(docs(spark, rows), k, percent).collect()}
    assert got == _components(rows, k, percent)
    if k == 5:
        kept = {r.doc_id for r in near_dup.keep_one(docs(spark, rows)).collect()}
        assert kept == {root for _, root in got.values()}


def test_near_duplicates_that_share_one_large_key_only(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "LARGE", 3)
    rng = random.Random(5)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(500)], k=60 + i)) for i in range(12)]
    texts += [texts[9] + " end", "new " + texts[4]]
    # all documents share the first key and no other
    table = docs(spark, enumerate(texts)).selectExpr("doc_id node", "doc_id", "text")
    rows = near_dup.features(table, 3).withColumnRenamed("node", "id")
    rows = rows.selectExpr("id", "transform(keys, (k, i) -> if(i = 0, 7L, xxhash64(id, i))) keys", "n_shingles", *near_dup._LANES)
    with Scratch(spark) as work:
        found = {(r.node, r.root) for r in near_dup._links(rows, table, 3, 85, work).collect()}
    assert found == {(12, 9), (13, 4)}


def test_signatures_within_the_distance_share_a_key():
    rng = np.random.default_rng(4)
    top = np.uint64((1 << near_dup.BITS) - 1)
    for r in rng.integers(0, 1 << near_dup.BITS, (200, near_dup._K), dtype=np.uint64):
        c = r.copy()
        c[rng.choice(near_dup._K, near_dup.CHUNKS * (near_dup.ERRORS + 1) - 1, replace=False)] ^= top
        assert set(near_dup._band_keys(r[None])[0].tolist()) & set(near_dup._band_keys(c[None])[0].tolist())


def test_sketches_never_tell_more_than_the_difference():
    rng = np.random.default_rng(5)
    for n in (5, 60, 900, 5000):
        both, own, other = (rng.integers(0, 1 << 63, k, dtype=np.uint64) for k in (n, rng.integers(0, n), rng.integers(0, n)))
        x, y = (near_dup._sketches(s, np.array([0, len(s)]))[0] for s in (np.concatenate([both, own]), np.concatenate([both, other])))
        assert sum((int(p) ^ int(q)).bit_count() if p ^ q >= 0 else (int(p ^ q) & (1 << 64) - 1).bit_count() for p, q in zip(x, y, strict=True)) <= len(own) + len(other)


def test_rows_that_share_a_doc_id_are_judged_apart(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(3, a), (7, a), (7, b), (9, c), (9, c), (None, a), (None, a), (10, ""), (11, None)]
    kept = sorted((str(r.doc_id), (r.text or "")[:2]) for r in near_dup.keep_one(docs(spark, rows).selectExpr("*", "1 as node", "2 as root")).collect())
    assert kept == sorted([("3", "a0"), ("7", "b0"), ("9", "c0"), ("None", "a0"), ("None", "a0"), ("10", ""), ("11", "")])
    told = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in near_dup.groups(docs(spark, rows)).collect())
    assert told == sorted([(3, 3, True), (7, 3, False), (7, 7, True), (9, 9, True), (9, 9, True), (0, 0, True), (0, 0, True), (10, 10, True), (11, 11, True)])


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 70), (100, 71)], "a long, b long")
    with Scratch(spark) as work:
        got = {r.node: r.root for r in near_dup.components(edges, work).collect()}
    assert {got.get(i, i) for i in range(1, 61)} == {1} and {got.get(i, i) for i in (70, 71, 100)} == {70}


# --- 4 repeated strings


def _covered(texts, length):
    from collections import Counter

    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        marks = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                marks[i : i + length] = b"\1" * length
        out.append((b, bytes(marks)))
    return out


@pytest.mark.parametrize(("length", "hot", "rows"), [(400, 50_000, 20_000), (60, 50_000, 40), (60, 3, 20_000)])
def test_repeated_strings_against_brute_force(spark, monkeypatch, length, hot, rows):
    monkeypatch.setattr(suffix_dedup, "MERGE_ROWS", rows)
    rng = random.Random(length + hot)
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 9)))
    passages = [" ".join(word() for _ in range(n)) for n in (10, 40, 90, 120)]
    texts = []
    for i in range(60):
        parts = [" ".join(word() for _ in range(rng.randrange(1, 60)))]
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(passages)
            lo = rng.randrange(0, 30)
            parts += [p[lo : len(p) - rng.randrange(0, 30)], " ".join(word() for _ in range(rng.randrange(1, 30)))]
        texts.append(" ".join(parts))
    texts += [texts[0], texts[1][:-1], "ab" * 700, "x" * 900, "x" * 399, "x" * 401, "", None, texts[5] + texts[5]]
    got = {r.doc_id: r for r in suffix_dedup.removed(docs(spark, list(enumerate(texts))), length, hot).collect()}
    for i, (b, marks) in enumerate(_covered(texts, length)):
        runs = [(m.start(), m.end()) for m in re.finditer(b"\1+", marks)]
        assert [(r.start, r.end) for r in got[i].runs] == runs, i
        assert bytes(got[i].kept) == bytes(x for x, m in zip(b, marks, strict=True) if not m)


# --- 5 packing


def _tokens():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_tokenizer())


def test_packing_is_whole_and_tight(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["alpha", "Beta,", "γάμμα", "x\n\n y", "1234", "don't", "😀", "a  b", " ", "end."]) for _ in range(rng.choice([0, 1, 9, 300, 2500]))) for _ in range(120)]
    texts += ["", None, " ", "\n", "<|endoftext|> x", "a<|endoftext|>b", "a <|endoftext|><|endoftext|> <|endoftext|", "text|>", "x<|end", "oftext|>", " lead", "trail ", "　 a  b", "\x1c a"]
    pieces = packing.pack(docs(spark, list(enumerate(texts))).repartition(3)).collect()
    tok, by_doc, by_seq = _tokens(), {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
    for i, t in enumerate(texts):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for p in sorted(by_doc[i], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    padding = total = 0
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024
        total += at
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding <= 0.01 * total


def test_cut_gives_all_tokens():
    for n in [*range(1, 3000), 10_000]:
        pieces = packing.cut(n)
        assert sum(pieces) == n and all(p == 1024 or p & (p - 1) == 0 or p < packing.SMALLEST for p in pieces)


# --- 6 personal data


def _plain_spans(t):
    luhn = lambda d: sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(d[::-1])) % 10 == 0
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m[0])) <= 15]
    return [(k, m.start(), m.end()) for k, m in out]


def test_base_spans_against_plain_patterns():
    rng = random.Random(4)
    for n in range(20_000):
        alphabet = "a@.-+ 1240é%(_A@@.." if n % 3 else "0123456789 -+."
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(t) == _plain_spans(t), t
    assert pii.base_spans("a" * 200_000 + " " + "1" * 200_000 + "." * 1000) == []


def test_disclosing_terms(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("bcdfg") + rng.choice("aeiou") for _ in range(4))
    rows = [(i, " ".join(word() for _ in range(30)) + " the office") for i in range(150)]
    rows += [(200 + i, f"{word()} {word()} Wintermute the {word()} writes ann@corp.example {word()} {word()}") for i in range(6)]
    rows += [(300 + i, "copy of Sidonia and her bob@corp.example address") for i in range(6)]
    out = {r.doc_id: r for r in pii.spans(docs(spark, rows)).collect()}
    term = lambda i: [s.split(":")[0] for s in out[i].spans.split(",") if s]
    assert all("removed" in term(200 + i) or "generalised" in term(200 + i) for i in range(6))
    assert all(term(300 + i) == ["email"] for i in range(6))
    assert all(out[i].spans == "" for i in range(150))
    clean = {r.doc_id: r.text for r in pii.sanitised(docs(spark, rows)).collect()}
    assert "Wintermute" not in clean[200] and "[EMAIL]" in clean[200] and clean[0] == rows[0][1] and len(clean) == len(rows)


def test_disclosing_terms_of_copies_and_scripts(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("bcdfg") + rng.choice("aeiou") for _ in range(4))
    rows = [(i, " ".join(word() for _ in range(20))) for i in range(600)]
    for k, name in enumerate(["Wintermute", "Ωμέγας", "Ольга", "Łucja", "Kim"]):
        texts = [f"{word()} {word()} “{name}” {word()} writes u{k}@corp.example {word()} {word()}" for _ in range(4)]
        rows += [(1000 * (k + 1) + i, texts[i % 4]) for i in range(48 if not k else 4)]
    rows += [(9000, f"{word()} saw Ольга {word()} again")]
    table = docs(spark, rows)
    out = {r.doc_id: r for r in pii.spans(table).collect()}
    for k in range(5):
        for i in range(48 if not k else 4):
            text, more = dict(rows)[1000 * (k + 1) + i], [s.split(":") for s in out[1000 * (k + 1) + i].spans.split(",")]
            assert ["Wintermute", "Ωμέγας", "Ольга", "Łucja", "Kim"][k] in [text[int(a) : int(b)] for kind, a, b in more if kind in ("removed", "generalised")]
    assert out[9000].spans
    clean = {r.doc_id: r.text for r in pii.sanitised(table).collect()}
    assert len(clean) == len(rows) and "Ольга" not in clean[9000] and clean[5] == dict(rows)[5]


def test_spans_against_plain_counts(spark):
    """All columns of the query against a plain version of the disclosure rule."""
    import math

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("bcdfg") + rng.choice("aeiouÉ") for _ in range(3))
    names = [word() + "mark" for _ in range(6)]
    rows = [(i, " ".join(word() for _ in range(25))) for i in range(120)]
    for k, name in enumerate(names):
        for i in range(3 + k):
            rows.append((1000 + 50 * k + i, f"{word()} 7_{name.title()}9 {word()} user{k}@corp.example, {word()} 10.0.0.{k} {word()} the end {name if i % 2 else ''}"))
    rows += [(5000, f"{names[0]} again; {names[2].upper()}"), (5001, f"see {names[1]}@corp.example {names[1]}"), (5001, f"see {names[1]}@corp.example {names[1]}"), (5002, None), (5003, "")]
    texts = [t or "" for _, t in rows]
    term = re.compile(r"[^\W\d_]+")
    held, near, n = {}, {}, len(texts)
    for i, t in enumerate(texts):
        for e, window, terms in pii.contexts(t, _plain_spans(t)):
            held.setdefault(e, set()).add(i)
            for x in terms:
                near.setdefault((e, x), []).append((i, window))
    level = {}
    for (e, x), seen in near.items():
        if len({w for _, w in seen}) >= pii.SUPPORT and len(held[e]) < n:
            nt, w, ne = sum(x in {m.lower() for m in term.findall(t)} for t in texts), len({i for i, _ in seen}), len(held[e])
            d = math.log(n * w / (ne * nt)) / math.log(n / ne)
            if d >= pii.GENERALISE:
                level[x] = max(level.get(x, 0), d)
    assert len(level) >= 5
    want = []
    for (i, _), t in zip(rows, texts, strict=True):
        base = _plain_spans(t)
        more = [("removed" if level[m[0].lower()] >= pii.REMOVE else "generalised", m.start(), m.end()) for m in term.finditer(t)
                if m[0].lower() in level and not any(a < m.end() and m.start() < b for _, a, b in base)]
        told = [",".join(f"{k}:{a}:{b}" for k, a, b in x) for x in (base, base + sorted(more))]
        want.append((i, *(sum(k == b[0] for b in base) for k in pii.KINDS), hashlib.sha256(told[0].encode()).hexdigest(), told[1], len(base) + len(more)))
    assert sorted(tuple(r) for r in pii.spans(docs(spark, rows)).collect()) == sorted(want)
    # columns that the operator itself uses, and repeated rows
    table = docs(spark, rows).selectExpr("*", "1 as terms", "2 as key", "3 as more", "4 as told", "5 as _key")
    clean = pii.sanitised(table)
    out = clean.collect()
    assert clean.columns == table.columns and len(out) == len(rows) and all((r.terms, r.key, r.more, r.told, r._key) == (1, 2, 3, 4, 5) for r in out)
    left = " ".join(r.text or "" for r in out).lower()
    assert not any(x in term.findall(left) for x in level) and "@" not in left


# --- 7 main text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p><p>no</p>";</script></head><body><header class="top"><h1>Site name</h1></header>
<nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav><div class="cookie-banner"><p>We use cookies, and more cookies, on this site.</p></div>{main}
<div class="sidebar"><p>Other, unrelated, text with, many, commas, in, it, to, tempt, the, scorer, more, than, once, and, again.</p></div>
<section id="comments"><p>Nice, very nice, article, I, liked, it, a, lot, thanks, for, all, of, it.</p></section><form><p>Subscribe, now</p></form><footer>&copy; 2024</footer>"""
BODY = "<h1>Title</h1><p>First, some text &amp; more.<p>Second,\n  with <b>bold</b> and <a href=x>a link</a>.</p><div class='ad'>Buy!</div><blockquote>Quoted words</blockquote><p>Short.</p>"
TEXT = "Title\n\nFirst, some text & more.\n\nSecond, with bold and a link.\n\nQuoted words\n\nShort."


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main><div class='content'>{}</div></main>", "<div id='content'>{}</div>", "<div><div class='post-body'>{}</div></div>"])
def test_main_text(wrap):
    page = PAGE.format(main=wrap.format(BODY))
    assert html_extract.extract(page) == TEXT
    assert html_extract.extract(page + "</body></html>") == TEXT


GOLD = [
    # link paragraphs and lists of linked references belong to the article
    ("<article><p>One, two, three.</p><p>See <a href=x>the full report of the committee on water</a>.</p><ul><li><a href=1>A study of rivers, 2020</a><li><a href=2>B</a><li><a href=3>C</a></ul></article>",
     ["One, two, three.", "See the full report of the committee on water.", "A study of rivers, 2020", "B", "C"]),
    # comments stay out whatever else their class says, and whatever they hold
    ("<article><p>Text, here, stays.</p><div class='comments no-avatar'><p>I, for one, like, it, a, lot, more.</p></div></article>", ["Text, here, stays."]),
    ("<main><article><p>Text, here.</p></article><section class='article-comments'><article class='comment'><h1>Me</h1><p>I, for one, like, it.</p></article></section></main>", ["Text, here."]),
    # the head of a class tells, not each of its words
    ("<article><p>A, b.</p><div class='discussion-of-results'><p>We found, and show, much.</p></div><div id='related-work'><p>Others did.</p></div></article>",
     ["A, b.", "We found, and show, much.", "Others did."]),
    ("<div class='page with-sidebar'><div class='sidebar-left'><p>Other, things, here.</p></div><div class='content'><p>Main, text.</p></div></div>", ["Main, text."]),
    ("<div class='sidebar'><h1>T</h1><p>All, the, text.</p></div>", ["T", "All, the, text."]),
    ("<div class='cookie-notice'><p>We, use, cookies.</p></div>", []),
    # short siblings and sections stay
    ("<div class='wrap'><div class='body'><p>Long, long, text, with, many, commas, and words.</p></div><div>The end.</div></div>", ["Long, long, text, with, many, commas, and words.", "The end."]),
    ("<article><header><h1>T</h1></header><section><p>" + "Many, words, " * 60 + "end.</p></section><section><h2>S</h2><p>Short.</p></section>bare <b>text</b><table><tr><td>1<td>2</table></article>",
     ["T", "Many, words, " * 60 + "end.", "S", "Short.", "bare text", "1", "2"]),
    ("<div><h1>T</h1><div class='story'><section><p>" + "One, two, " * 50 + "x.</p></section><section><p>Two.</p></section></div></div>", ["T", "One, two, " * 50 + "x.", "Two."]),
    # menus without a name, beside the text
    ("<div class='content'><ul><li><a href=1>Home</a><li><a href=2>News</a><li><a href=3>Shop</a></ul><p>Text, of, the page.</p></div>", ["Text, of, the page."]),
    ("<form action=x><main><p>All, in a form.</p><input><button>Go</button></main></form>", ["All, in a form."]),
    ("<body><h1>T</h1><p>a, b</p><div>&copy; 2024</div><div><a href=x>Imprint and more of it</a></div></body>", ["T", "a, b"]),
]


@pytest.mark.parametrize(("page", "blocks"), GOLD)
def test_gold_pages(page, blocks):
    assert html_extract.extract(page) == "\n\n".join(blocks)
    assert html_extract.extract("<html><head><title>x</title></head><body><nav><a href=y>z</a></nav>" + page + "<footer>f, f</footer>") == "\n\n".join(blocks)


def test_extraction_as_a_query(spark):
    long = "<article>" + "<p>word, and &lt;more&gt; words</p>" * 60_000 + "</article>"
    rows = [(1, "u", PAGE.format(main=BODY)), (1, "u", PAGE.format(main=BODY)), (2, None, None), (3, "", ""), (None, "n", "<p>é</p>"), (4, "l", long)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as n_chars", "3 as body")
    got = sorted(((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in html_extract.extracted(table).collect()), key=lambda r: r[:2])
    want = [(0, "n", "é", 1), (1, "u", TEXT, len(TEXT)), (1, "u", TEXT, len(TEXT)), (2, "", "", 0), (3, "", "", 0)]
    assert got[:5] == want and got[5][2] == "\n\n".join(["word, and <more> words"] * 60_000)


def test_generated_pages_against_their_plan():
    """Pages whose blocks are known, with furniture among and around them."""
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9)))
    prose = lambda n: " ".join(word() + ("," if rng.random() < 0.1 else "") for _ in range(n)) + "."
    for _ in range(150):
        kept, inner = [], []
        for tag in ["h1"] + rng.choices(["p", "p", "p", "h2", "blockquote", "pre", "li", "div"], k=rng.randint(1, 12)):
            t = prose(rng.randint(1, 60))
            kept.append(t)
            inner.append(f"<ul><li>{t}</ul>" if tag == "li" else f"<{tag}>{t}" + ("" if tag == "p" and rng.random() < 0.5 else f"</{tag}>"))
            if rng.random() < 0.3:
                name = rng.choice(["ad", "share-box", "article-comments", "newsletter signup", "relatedPosts widget", "cookie_notice"])
                inner.append(f"<div class='{name}'><p>{prose(rng.randint(1, 80))}</div>")
        tag = rng.choice(["article", "main", "div class=content", "div id=main-text"])
        around = [f"<div class='{c}'><p>{prose(rng.randint(5, 80))}</p></div>" for c in rng.sample(["sidebar", "top-banner", "footer-links", "cookie-bar", "comments"], 2)]
        page = f"<body><header><p>{prose(5)}</header>{around[0]}<{tag}>{''.join(inner)}</{tag.split()[0]}>{around[1]}<footer>{prose(9)}</footer>"
        assert html_extract.extract(page) == "\n\n".join(kept), page


def test_main_text_of_odd_pages():
    assert html_extract.extract(None) == html_extract.extract("") == html_extract.extract("<nav><a href=x>Home</a></nav>") == ""
    assert html_extract.extract("plain words") == "plain words"
    wrapped = "<div class='layout with-sidebar'><article><p>Text, here</p><div class='article-comments'><p>Nice, one</p></div></article></div>"
    assert html_extract.extract(wrapped) == "Text, here"
    assert html_extract.extract("<p>a<p>b <unclosed") == "a\n\nb"
    assert html_extract.extract("<div>" * 20_000 + "<p>deep text here</p>") == "deep text here"
    assert html_extract.extract('<p title="a > b">x</p><!-- <p>no</p> --><p>y</p>') == "x\n\ny"


# --- 8 GIF


def _lzw(pixels, low, deferred=False):
    clear, end = 1 << low, (1 << low) + 1
    bits: list[int] = []
    size = low + 1

    def put(c):
        bits.extend(c >> i & 1 for i in range(size))

    put(clear)
    table, w = {(i,): i for i in range(clear)}, ()
    following = end + 1
    for x in pixels:
        if (*w, x) in table:
            w = (*w, x)
            continue
        put(table[w])
        if following < 4096:
            table[(*w, x)] = following
            if following == 1 << size and size < 12:
                size += 1
            following += 1
        elif not deferred:
            put(clear)
            table, following, size = {(i,): i for i in range(clear)}, end + 1, low + 1
        w = (x,)
    if w:
        put(table[w])
    put(end)
    return np.packbits(np.array(bits, np.uint8), bitorder="little").tobytes()


@pytest.mark.parametrize("deferred", [False, True])
def test_lzw_streams_of_a_plain_encoder(deferred):
    rng = np.random.default_rng(1)
    for low, n in ((2, 50), (4, 3000), (8, 300), (8, 40_000), (2, 60_000), (8, 1)):
        pixels = np.minimum((1 << low) - 1, rng.geometric(0.2, n) - 1)
        assert np.array_equal(media_gif._pixels(_lzw(pixels.tolist(), low, deferred), low, n), pixels)
    assert not media_gif._pixels(_lzw([0] * 5000, 8), 8, 5000).any()
    assert len(media_gif._pixels(b"\xff\x00", 8, 10)) == 10


def test_own_lzw_streams_are_those_of_a_plain_encoder():
    rng = np.random.default_rng(2)
    for n in (1, 2, 254, 255, 256, 257, 300, 600, 5000, 40_000):
        for high in (2, 30, 256):
            pixels = rng.integers(0, high, n, dtype=np.uint8)
            data = media_gif._stream(pixels.tobytes())
            plain = _lzw(pixels.tolist(), 8)
            # the width of the end code alone is told differently at the edge of a table
            assert data[:-3] == plain[: len(data) - 3] and abs(len(data) - len(plain)) <= 1
            assert np.array_equal(media_gif._pixels(data, 8, n), pixels)


def test_gif_round_trip_and_frames(monkeypatch):
    rng = np.random.default_rng(3)
    frame = media_gif.WIDTH * media_gif.FRAME_ROWS
    for n in (64, 128, 64 * 254, 64 * 300, frame, frame + 64, 20 * frame + 640):
        for high in (256, 3):
            payload = rng.integers(0, high, n, dtype=np.uint8).tobytes()
            media = media_gif.encode(payload)
            frames = list(media_gif.decode(media))
            assert b"".join(map(media_gif._bytes_of, frames)) == payload
            assert sum(media_gif.histogram(f).sum() for f in frames) == n and all(f.delay == media_gif.DELAY for f in frames)
            assert [f.disposal for f in frames] == [2 if k % media_gif.KEY == media_gif.KEY - 1 else 1 for k in range(len(frames))]
            # the bytes come from the screen: indices alone are not the payload once pixels are transparent
            if high == 3 and len(frames) > 1:
                assert b"".join(f.index.tobytes() for f in frames) != payload
    expand, calls = media_gif._expand, []
    monkeypatch.setattr(media_gif, "_expand", lambda *a: calls.append(1) or expand(*a))
    list(media_gif.decode(media_gif.encode(b"a" * 64)))
    assert calls


def test_gif_query_columns_against_plain_code(spark):
    rng = random.Random(11)
    texts = ["", None, "é", "x" * 64, "y" * 65, "".join(rng.choice("abc é\n") for _ in range(70_000)), "\0", "x" * 64]
    got = {r.doc_id: r for r in media_gif.stored(docs(spark, list(enumerate(texts)))).collect()}
    gifs = {r.id: bytes(r.gif) for r in media_gif.as_gif(docs(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        payload = data + bytes(-len(data) % 64 if data else 64)
        r, bins = got[i], [0] * 64
        for x in payload:
            red, green, blue = (x >> 5) * 36, (x >> 2 & 7) * 36, (x & 3) * 85
            bins[(red >> 6) * 16 + (green >> 6) * 4 + (blue >> 6)] += 1
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(gifs[i]), hashlib.sha256(gifs[i]).hexdigest())
        assert r.histogram == bins and r.n_frames == -(-len(payload) // 8192) and r.feature == f"{r.n_frames}x64:" + ",".join(map(str, bins))
    assert got[3][1:] == got[7][1:]
    rows = media_gif.timed_frames(spark.createDataFrame([(1, gifs[5]), (2, None), (3, b"no"), (1, gifs[3])], "id long, gif binary")).collect()
    assert len(rows) == got[5].n_frames + 1 and [r.begin_cs for r in rows][:3] == [0, 10, 20] and [sum(x) for x in zip(*(r.histogram for r in rows[:-1]), strict=True)] == got[5].histogram


def test_gif_disposal_transparency_and_interlacing():
    import struct

    def frame(pixels, w, h, left=0, top=0, disposal=0, transparent=None, interlaced=0):
        flags = disposal << 2 | (transparent is not None)
        return (
            b"\x21\xf9\x04" + struct.pack("<BHB", flags, 7, transparent or 0) + b"\0\x2c" + struct.pack("<HHHHB", left, top, w, h, interlaced << 6)
            + b"\x02" + media_gif._sub_blocks(_lzw(pixels, 2))
        )

    palette = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    head = b"GIF89a" + struct.pack("<HHBBB", 2, 4, 0x81, 0, 0) + palette
    data = head + frame([1] * 8, 2, 4, disposal=1) + frame([2, 3], 2, 1, top=1, disposal=2, transparent=3) + frame([3], 1, 1, disposal=3) + frame([0, 0, 1, 1, 2, 2, 3, 3], 2, 4, interlaced=1) + b"\x3b"
    f = list(media_gif.decode(data))
    assert [x.delay for x in f] == [7] * 4
    assert f[1].canvas[1, 0].tolist() == [0, 255, 0, 255] and f[1].canvas[1, 1].tolist() == [255, 0, 0, 255]
    assert f[2].canvas[1, 0].tolist() == [0, 0, 0, 0] and f[2].canvas[0, 0].tolist() == [0, 0, 255, 255]
    assert f[3].index[:, 0].tolist() == [0, 2, 1, 3]
    assert not list(media_gif.decode(b"no gif")) and len(list(media_gif.decode(data[:60]))) <= 4


# --- 9 quality


def test_quality_separates_kinds():
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(300)]
    good = [" ".join(rng.choices(words, k=rng.randint(5, 200))) + "." for _ in range(200)]
    shout = [t.upper().replace(" ", "!! ") for t in good[:40]]
    again = [" ".join(w for w in t.split()[:10] for _ in range(9)) for t in good[40:80]]
    texts, y = good[:150] + shout[:30] + again[:30], [1] * 150 + [0] * 60
    m = quality.fit(texts, y, 0.8)
    score = lambda ts: m.scores(*quality.grams(pa.RecordBatch.from_arrays([pa.array(ts)], ["text"])), len(ts))
    assert (score(good[150:]) >= 0.7).mean() > 0.95 and (score(shout[30:] + again[30:]) < 0.7).mean() > 0.95
    assert 0 <= score([""])[0] <= 1


def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(80, 5)), None
    y = np.sign(x @ np.array([1, -2, 0, 0.5, 0]) + 0.3 * rng.normal(size=80))
    w = quality.dual_coordinate_descent([(np.arange(5), r) for r in x], y, 5, np.full(80, 0.5), rounds=3000, tolerance=1e-9)
    loss = lambda w: 0.5 * w @ w + 0.5 * np.maximum(0, 1 - y * (x @ w)).sum()
    assert all(loss(w) <= loss(w + 0.02 * rng.normal(size=5)) + 1e-9 for _ in range(300))


def test_quality_scores_against_plain_grams():
    """Indicators and scores of the query in plain Python."""
    rng = random.Random(10)
    words = ["".join(rng.choice("abcdefg") for _ in range(4)) for _ in range(80)]
    good = [" ".join(rng.choices(words, k=rng.randint(1, 90))) + "." for _ in range(120)]
    bad = [t.upper().replace(" ", " !! ") if i % 2 else " ".join(w for w in t.split() for _ in range(4)) for i, t in enumerate(good[:60])]
    m = quality.fit(good + bad, [1] * 120 + [0] * 60, 0.6)
    every = good[:15] + bad[:15] + ["", "  ", "a", "ab", "É1 é2! {x} x x", "Ärger ÄÖ #1 #1"]

    def kind(w, same):
        b = w.encode()
        upper = [(64 < c < 91) or (c >= 0x80 and i and b[i - 1] == 0xC3 and c < 0x9F) for i, c in enumerate(b)]
        lower = [(96 < c < 123) or (c >= 0x80 and i and b[i - 1] == 0xC3 and c >= 0x9F) for i, c in enumerate(b)]
        led = 64 < b[0] < 91 or b[0] == 0xC3
        u, n = sum(upper), sum(lower)
        case = 0 if u + n == 0 else 3 if n == 0 and u == 1 else 1 if n == 0 else 2 if u == 0 else 3 if led and u == 1 else 4
        return (((case * 2 + any(c in b"#$%&*|<>=+@^~_/\\[]{}" for c in b)) * 2 + any(c in b"!?" for c in b)) * 2 + any(47 < c < 58 for c in b)) * 2 + same

    def plain(t):
        b, out = t.encode(), set()
        for i in range(len(b) - 2):
            out.add(((b[i] * 0x9E3779B1 + b[i + 1] * 0x85EBCA6B + b[i + 2] * 0xC2B2AE35) & 0xFFFFFFFF) >> (32 - quality.GRAM_BITS))
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fold = lambda x: re.sub("[A-Z]", lambda k: k[0].lower(), x)
        s = [kind(x, i > 0 and fold(x) == fold(w[i - 1])) for i, x in enumerate(w)]
        grams = s + [quality.SHAPES + a * quality.SHAPES + b for a, b in zip(s, s[1:], strict=False)]
        for g in set(grams):
            out |= {quality._GRAMS + g * len(quality.LEVELS) + k for k, level in enumerate(quality.LEVELS) if grams.count(g) / len(w) > level}
        return sorted(out)

    row, gram = quality.grams(pa.RecordBatch.from_arrays([pa.array(every)], ["text"]))
    assert [gram[row == i].tolist() for i in range(len(every))] == [plain(t) for t in every]
    got = m.scores(row, gram, len(every))
    for t, s in zip(every, got, strict=True):
        g = plain(t)
        margin = sum(m.weight[g]) / np.sqrt(max(sum(m.ratio2[g]), 1e-12)) + m.bias
        assert abs(s - 1 / (1 + np.exp(-np.clip(m.slope * margin + m.offset, -35, 35)))) < 1e-5
    keys = np.array([5, 5, 1, quality._GRAMS + 2, 3])
    assert quality._distinct(keys, 2).tolist() == sorted(set(keys.tolist())) == quality._distinct(np.tile(keys, 3000), 2).tolist()


# --- 10 decontamination


def _decontaminated(texts, items, n=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = [(i, tuple(w[k : k + min(n, len(w))])) for i, t in items for w in [words(t)] if w for k in range(len(w) - min(n, len(w)) + 1)]
    out = []
    for t in texts:
        w, hit, found = words(t), set(), set()
        for i, win in windows:
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    found.add(str(i))
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("block", [4 << 20, 60])
def test_decontamination_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    rng = random.Random(1)
    word = lambda: rng.choice(["the", "of", "and", "Été", "x1", "zeta", "mu", "pi"])
    items = [(i, " ".join(word() for _ in range(k))) for i, k in enumerate([3, 9, 10, 11, 25, 40, 2])] + [(100, None), (101, ".,;"), (2, "of the")]
    texts = [" ".join(word() for _ in range(rng.randrange(0, 80))) for _ in range(60)]
    texts += [f"a b, {items[5][1]}! c", items[4][1].upper(), items[2][1], items[3][1] + items[3][1], None, "", "of"]
    got = {r.doc_id: tuple(r)[1:] for r in decontam.scan(docs(spark, list(enumerate(texts))), bench(spark, items)).collect()}
    assert [got[i] for i in range(len(texts))] == _decontaminated(texts, items)
    table = docs(spark, list(enumerate(texts))).selectExpr("*", "1 as key", "2 as spans", "3 as items")
    clean = decontam.clean(table, bench(spark, items))
    assert {r.doc_id for r in clean.collect()} == {i for i in got if not got[i][-1]} and clean.columns == table.columns


def test_longest_matches(spark):
    item = " ".join(f"w{i}" for i in range(30))
    rows = [(1, "x y " + " ".join(f"w{i}" for i in range(5, 25)) + " z"), (2, "nothing here")]
    (m,) = decontam.longest_matches(docs(spark, rows), bench(spark, [(7, item)])).collect()
    assert (m.doc_id, m.item_id, m.doc_word, m.item_word, m.n_words) == (1, "7", 2, 5, 20)
    # two items, one of them twice in a document, and a match that is broken by a word
    rows = [(1, f"{item} x {item}"), (2, item.replace("w15", "w15 x"))]
    found = sorted(tuple(r) for r in decontam.longest_matches(docs(spark, rows), bench(spark, [(7, item), (8, item + " more")])).collect())
    assert found == sorted((1, i, at, 0, 30) for i in "78" for at in (0, 31)) + [(2, "7", 0, 0, 16), (2, "7", 17, 16, 14), (2, "8", 0, 0, 16), (2, "8", 17, 16, 14)]
