"""Personal data: fixed patterns, and terms that disclose it by corpus co-occurrence.

Base spans are e-mail and IP addresses, card and phone numbers. Each distinct value is a protected entity. The words that
stand within `WINDOW` words of it are candidate terms. For an entity e and a term t, over N documents,

    disclosure(t, e) = PMI(t; e) / IC(e) = log(N w(t,e) / (n(e) n(t))) / log(N / n(e)),

with w the documents that hold t in a window of e, n(e) those that hold e and n(t) those that hold t, copies included
everywhere. A term with `SUPPORT` distinct windows (copies of a window count once) and a disclosure of `GENERALISE` or more
is a span of its own in every document that holds it: generalised there, or removed from `REMOVE` on. One tokenizer, of
Unicode letters in lower case, serves windows, counts and spans.

n(t) is counted over all documents, but only for terms in the buckets that candidates fall in: a bit map of fixed size is
all that is broadcast. Words are told apart once in a slice, by Arrow, and looked up once each.

Null and empty texts have no spans. A null doc_id is as good as any. Rows that repeat count as documents of their own and
are each treated alike: rows with candidate terms are known by a 64-bit hash of doc_id and text.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from briarlake.llm._arrow import LETTERS, Words, frugal, slices, text_bytes
from briarlake.llm._store import Scratch, ids_and_text, unused, written

KINDS = ("email", "ip", "card", "phone")
WINDOW, SUPPORT, GENERALISE, REMOVE = 6, 3, 0.8, 0.95
#: Buckets of the bit map of candidate terms.
BUCKETS = 1 << 20
#: Distinct words that a task remembers, and distinct terms that it counts before it hands them on.
HELD = 200_000
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W\d_]+")
_MORE = "array<struct<term:string,start:int,end:int>>"
_MORE_TYPE = pa.list_(pa.struct([("term", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: each starts at the first of the local letters before its @, but not inside the match before."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and _LOCAL.match(text, start - 1):
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            end = m.end()
            out.append((start, end))
            at = text.find("@", end)
        else:
            end = at + 1 if not m and start == at else end
            at = text.find("@", at + 1)
    return out


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str, digits: int | None = None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind, then start. digits: how many the text has, if that is known."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    most = len(text) if digits is None else digits
    if most >= 4:
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) < 4 and int(p) < 256 for p in m[0].split(".")):
                out.append(("ip", m.start(), m.end()))
    if most >= 16:
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16:
                number = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(number) <= 19 and _luhn(number):
                    out.append(("card", m.start(), m.end()))
    if most >= 8 and "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [t or "" for t in batch.column("text").to_pylist()]


def _base(batch: pa.RecordBatch) -> list[list[tuple[str, int, int]]]:
    """The base spans of each text of a slice. Texts without an @ and with fewer than four digits are not looked at."""
    raw, offsets = text_bytes(batch.column("text"))
    count = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])
    digits = count((raw >= 48) & (raw < 58))
    out: list[list] = [[] for _ in range(batch.num_rows)]
    for i in np.flatnonzero((digits >= 4) | (count(raw == 64) > 0)).tolist():
        out[i] = base_spans(batch.column("text")[i].as_py(), int(digits[i]))
    return out


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def entity(kind: str, value: str) -> int:
    """A protected entity's number: its kind and value, written alike."""
    return _hash(f"{kind}:{value.lower() if kind == 'email' else re.sub(r'[^0-9.]', '', value)}")


def contexts(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[int, int, set[str]]]:
    """(entity, hash of its window, terms) of each base span."""
    words = [(m.start(), m.end(), m[0].lower()) for m in _TERM.finditer(text)]
    inside = np.zeros(len(words), bool)
    starts, ends = np.array([w[0] for w in words], np.int64), np.array([w[1] for w in words], np.int64)
    for _, a, b in spans:
        inside[np.searchsorted(ends, a, "right") : np.searchsorted(starts, b, "left")] = True
    out = []
    for kind, a, b in spans:
        lo, hi = int(np.searchsorted(ends, a, "right")), int(np.searchsorted(starts, b, "left"))
        near = [*range(max(0, lo - WINDOW), lo), *range(hi, min(len(words), hi + WINDOW))]
        near = [words[i][2] for i in near if not inside[i]]
        out.append((entity(kind, text[a:b]), _hash(" ".join(near)), set(near)))
    return out


def bucket(term: str) -> int:
    return zlib.crc32(term.encode("utf-8", "replace")) % BUCKETS


def _marked(terms: DataFrame) -> bytes:
    """A byte per bucket: 1 where a row of (bucket) falls."""
    marks = np.zeros(BUCKETS, np.uint8)
    marks[[r[0] for r in terms.select("bucket").distinct().toLocalIterator()]] = 1
    return marks.tobytes()


class _Holders:
    """Which texts hold which terms whose bucket is marked; words are looked up once each."""

    def __init__(self, marks: bytes):
        self.marks = marks
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, list[int]] = {}
        self.ids: dict[str, int] = {}
        self.terms: list[str] = []

    def _of(self, word: bytes) -> list[int]:
        out = []
        for found in _TERM.findall(word.decode("utf-8", "replace")):
            term = found.lower()
            if self.marks[bucket(term)]:
                if term not in self.ids:
                    self.ids[term] = len(self.terms)
                    self.terms.append(term)
                out.append(self.ids[term])
        return out

    def __call__(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """(row, number of a term in self.terms) of every marked term in every text, each once."""
        if len(self.known) > HELD:
            self._forget()
        raw, offsets = text_bytes(batch.column("text"))
        words = Words(raw, offsets, LETTERS, hashed=False)
        if not len(words.starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        edges = np.concatenate([[0], np.cumsum(words.lengths)]).astype(np.int64)
        column = pa.Array.from_buffers(pa.large_binary(), len(words.starts), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(raw[LETTERS[raw]]))])
        coded = column.dictionary_encode()
        known, held = self.known, []
        for word in coded.dictionary.to_pylist():
            if word not in known:
                known[word] = self._of(word)
            held.append(known[word])
        count = np.array([len(x) for x in held], np.int64)
        flat = np.array([i for x in held for i in x], np.int64)
        which = coded.indices.to_numpy().astype(np.int64)
        at = np.flatnonzero(count[which])
        code, row = which[at], np.searchsorted(words.bounds, at, "right") - 1
        size = count[code]
        place = np.repeat((np.cumsum(count) - count)[code] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        pairs = np.unique(np.repeat(row, size) << 32 | flat[place])
        return pairs >> 32, pairs & 0xFFFFFFFF


def _observed(docs: DataFrame) -> DataFrame:
    """(entity, term, bucket, window, own): a row per window, own is 1 once a document; and one without term per entity and document."""
    names, kinds = ["entity", "term", "bucket", "window", "own"], [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32()]

    def run(batches):
        for batch in slices(batches, "text"):
            out: list[tuple] = []
            for i, found in enumerate(_base(batch)):
                seen: set = set()
                for e, window, terms in contexts(batch.column("text")[i].as_py(), found) if found else ():
                    for t in [None, *sorted(terms)]:
                        out.append((e, t, None if t is None else bucket(t), window, int((e, t) not in seen)))
                        seen.add((e, t))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return docs.select("text").mapInArrow(frugal(run), "entity long, term string, bucket long, window long, own int")


def _document_counts(docs: DataFrame, marks) -> DataFrame:
    """(term, n): documents that hold each term whose bucket is marked; marks: a broadcast."""

    def run(batches):
        holders = _Holders(marks.value)
        for batch in slices(batches, "text"):
            _, ids = holders(batch)
            n = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([holders.terms[i] for i in at.tolist()], pa.string()), pa.array(n[at], pa.int64())], ["term", "n"])

    return docs.select("text").mapInArrow(frugal(run), "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def disclosing(docs: DataFrame, work: Scratch) -> DataFrame:
    """(term, bucket, disclosure) of the terms that reveal an entity, written; docs: rows with a text."""
    seen = work.written(_observed(docs), "pii-seen")
    holders = seen.where("term is null").groupBy("entity").agg(F.sum("own").alias("ne"))
    pairs = seen.where("term is not null").groupBy("entity", "term", "window").agg(F.sum("own").alias("w"), F.min("bucket").alias("bucket"))
    pairs = pairs.groupBy("entity", "term").agg(F.count("*").alias("windows"), F.sum("w").alias("w"), F.min("bucket").alias("bucket")).where(F.col("windows") >= SUPPORT)
    pairs = work.written(pairs.join(holders, "entity"), "pii-pairs")
    marks = _marked(pairs)
    if not any(marks):
        return pairs.select("term", "bucket", F.lit(0.0).alias("disclosure")).limit(0)
    total = docs.count()
    n = F.lit(float(max(total, 2)))
    # an entity that every document holds has no information to disclose
    ic = F.log(n / F.col("ne"))
    pmi = F.log(n * F.col("w") / (F.col("ne") * F.col("n")))
    found = pairs.join(_document_counts(docs, work.broadcast(marks)), "term").where(F.col("ne") < total)
    found = found.groupBy("term").agg(F.min("bucket").alias("bucket"), F.max(pmi / ic).alias("disclosure"))
    return work.written(found.where(F.col("disclosure") >= GENERALISE), "pii-terms")


def _candidates(batch: pa.RecordBatch, base: list[list], holders: _Holders) -> pa.Array:
    """Per text, the marked terms that touch no base span; null where there are none."""
    rows, ids = holders(batch)
    out: list[list | None] = [None] * batch.num_rows
    for i in np.unique(rows).tolist():
        held = {holders.terms[k] for k in ids[rows == i].tolist()}
        taken, k, end, more = sorted((a, b) for _, a, b in base[i]), 0, 0, []
        for m in _TERM.finditer(batch.column("text")[i].as_py()):
            term = m[0].lower()
            if term in held:
                while k < len(taken) and taken[k][0] < m.end():
                    end = max(end, taken[k][1])
                    k += 1
                if end <= m.start():
                    more.append({"term": term, "start": m.start(), "end": m.end()})
        out[i] = more or None
    return pa.array(out, _MORE_TYPE)


def _judged(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(key, told): the candidates of rows (key, more) that are disclosing terms, as sorted (kind, start, end)."""
    kind = F.when(F.col("disclosure") >= REMOVE, "removed").otherwise("generalised").alias("kind")
    hits = rows.select("key", F.explode("more").alias("m")).select("key", "m.*").distinct().join(found, "term")
    return hits.groupBy("key").agg(F.array_sort(F.collect_list(F.struct(kind, "start", "end"))).alias("told"))


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with base spans as [KIND], generalised terms as [TERM] and removed ones left out; overlaps become one."""
    out, end = [], 0
    for a, b, kind in sorted((a, b, k) for k, a, b in spans):
        if a >= end:
            out += [text[end:a], {"generalised": "[TERM]", "removed": ""}.get(kind, f"[{kind.upper()}]")]
        end = max(end, b)
    return "".join([*out, text[end:]])


def spans(docs: DataFrame) -> DataFrame:
    """Per row of docs: counts and digest of base spans, all spans (base ones, then terms by kind and start), and their number."""
    names = [f"n_{k}" for k in KINDS]
    own = ids_and_text(docs)
    schema = "doc_id long, key long, " + ", ".join(f"{n} long" for n in names) + f", base_sha256 string, base string, more {_MORE}"

    def told(marks):
        def run(batches: Iterator[pa.RecordBatch]):
            holders = _Holders(marks.value) if marks else None
            for batch in slices(batches, "text"):
                base = _base(batch)
                joined = [_joined(r) for r in base]
                more = _candidates(batch, base, holders) if holders else pa.nulls(batch.num_rows, _MORE_TYPE)
                counts = [pa.array([sum(k == s[0] for s in r) for r in base], pa.int64()) for k in KINDS]
                digests = [hashlib.sha256(x.encode()).hexdigest() for x in joined]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("key"), *counts, pa.array(digests, pa.string()), pa.array(joined, pa.string()), more],
                    ["doc_id", "key", *names, "base_sha256", "base", "more"],
                )

        return own.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key")).mapInArrow(frugal(run), schema)

    n_base = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    with Scratch(docs.sparkSession) as work:
        found = disclosing(own, work)
        marks = _marked(found)
        if not any(marks):
            return told(None).select("doc_id", *names, "base_sha256", F.col("base").alias("spans"), n_base.alias("n_spans"))
        rows = work.written(told(work.broadcast(marks)), "pii-rows")
        judged = _judged(rows.where("more is not null"), found.select("term", "disclosure"))
        rows = rows.where("more is null").drop("more").withColumn("told", F.expr("cast(null as array<struct<kind:string,start:int,end:int>>)")).unionByName(
            rows.where("more is not null").drop("more").join(judged, "key", "left")
        )
        extra = F.array_join(F.transform("told", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
        both = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), extra)
        return written(rows.select("doc_id", *names, "base_sha256", both.alias("spans"), (n_base + F.coalesce(F.size("told"), F.lit(0))).alias("n_spans")), "pii-spans")


def sanitised(docs: DataFrame) -> DataFrame:
    """docs with their texts redacted; all columns and rows stay."""
    columns = docs.columns
    at = columns.index("text")

    def replaced(batch: pa.RecordBatch, texts: list) -> list:
        return [*batch.columns[:at], pa.array(texts, batch.column(at).type), *batch.columns[at + 1 :]]

    def base_only(batches):
        for batch in slices(batches, "text"):
            base, texts = _base(batch), batch.column("text").to_pylist()
            texts = [redact(t, b) if b else t for t, b in zip(texts, base, strict=True)]
            yield pa.RecordBatch.from_arrays(replaced(batch, texts), columns)

    with Scratch(docs.sparkSession) as work:
        found = disclosing(docs, work)
        marks = _marked(found)
        if not any(marks):
            return docs.mapInArrow(frugal(base_only), docs.schema)
        key, more, told = (unused(docs, n) for n in ("key", "more", "told"))
        shared = work.broadcast(marks)

        def run(batches):
            """Redacts texts without candidates at once; the others are left as they are."""
            holders = _Holders(shared.value)
            for batch in slices(batches, "text"):
                base, texts = _base(batch), batch.column("text").to_pylist()
                held = _candidates(batch, base, holders)
                texts = [redact(t, b) if b and none else t for t, b, none in zip(texts, base, held.is_null().to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*replaced(batch, texts), held], [*columns, key, more])

        schema = docs.withColumn(key, F.lit(0).cast("long")).withColumn(more, F.lit(None).cast(_MORE)).schema
        rows = docs.withColumn(key, F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))
        rows = work.written(rows.mapInArrow(frugal(run), schema), "pii-rows")
        hits = rows.where(F.col(more).isNotNull())
        judged = _judged(hits.select(F.col(key).alias("key"), F.col(more).alias("more")), found.select("term", "disclosure"))
        judged = judged.select(F.col("key").alias(key), F.col("told").alias(told))

        def extend(batches):
            for batch in slices(batches, "text"):
                terms = batch.column(told).to_pylist()
                spans = [b + [(x["kind"], x["start"], x["end"]) for x in t or ()] for b, t in zip(_base(batch), terms, strict=True)]
                texts = [redact(t, s) for t, s in zip(_texts(batch), spans, strict=True)]
                yield pa.RecordBatch.from_arrays(replaced(batch, texts)[: len(columns)], columns)

        plain = [F.col(f"`{c}`") for c in columns]
        mended = hits.drop(more).join(judged, key, "left").select(*plain, told).mapInArrow(frugal(extend), docs.schema)
        return written(rows.where(F.col(more).isNull()).select(*plain).unionByName(mended), "pii")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
