"""Benchmark decontamination with suffix arrays over the training shards.

Every slice of a partition is a shard. Its suffix array is sparse: only suffixes are kept that begin with the first words
of some benchmark window (no other suffix can match one), sorted by their first `window` words. Every benchmark suffix is
then binary-searched in it; the equal range gives its verbatim matches with their places. Matches that follow one another
in document and item alike are one longest match: the words inside longest matches are hit, and their items are found.
Shards are independent, so nothing is shuffled and a lost executor costs its own shards only.

The benchmark travels in blocks of a fixed number of bytes (`BLOCK_BYTES`), one at a time: each block is broadcast, searched
in one pass over all shards, and given back. What the passes of several blocks find is joined by document. Words are
compared by 64-bit hashes. Null and empty texts have no words and are never hit; null item ids are left out of the digest
but their windows count as hits; repeated items count once per distinct id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from briarlake.llm._arrow import ALNUM, Words, frugal, mix, slices, text_bytes
from briarlake.llm._store import Scratch, ids_and_text, unused, written

WINDOW = 10
#: Bytes of benchmark text in one broadcast block.
BLOCK_BYTES = 4 << 20
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_BITS = 22

SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
MATCHES = "doc_id long, item_id string, doc_word long, item_word long, n_words long"


def _head(h: np.ndarray, q: int) -> np.ndarray:
    """A hash of the q words that start at each place (places too near the end get what the roll brings)."""
    x = h * _A
    if q > 1:
        x = x + np.roll(h, -1) * _B
    if q > 2:
        x = x + np.roll(h, -2) * _C
    return mix(x)


def _bytes(keys: np.ndarray) -> np.ndarray:
    """Rows of word hashes as byte strings that sort as the rows do."""
    width = keys.shape[1] * 8
    return np.ascontiguousarray(keys.astype(">u8")).view(f"S{width}").ravel()


class Block:
    """The windows of some benchmark items: distinct word sequences, sorted, with the (item, place) pairs of each."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        self.window = window
        self.ids = [i for i, _ in items]
        raw, offsets = text_bytes(pa.array([t for _, t in items], pa.string()))
        words = Words(raw, offsets, ALNUM)
        rows, owner, place, length = [], [], [], []
        for i in range(len(items)):
            h = words.hash[words.bounds[i] : words.bounds[i + 1]]
            if not len(h):
                continue
            size = min(window, len(h))
            view = np.lib.stride_tricks.sliding_window_view(h, size)
            full = np.zeros((len(view), window), np.uint64)
            full[:, :size] = view
            rows.append(full)
            owner.append(np.full(len(view), i))
            place.append(np.arange(len(view)))
            length.append(np.full(len(view), size))
        self.empty = not rows
        if self.empty:
            return
        keys, self.owner, self.place, size = np.concatenate(rows), np.concatenate(owner), np.concatenate(place), np.concatenate(length)
        self.by_size = {}
        for s in np.unique(size):
            at = np.flatnonzero(size == s)
            packed, of = np.unique(_bytes(keys[at][:, :s]), return_inverse=True)
            order = np.argsort(of, kind="stable")
            self.by_size[int(s)] = (packed, at[order], np.searchsorted(of[order], np.arange(len(packed) + 1)))
        self.q = min(3, min(self.by_size))
        self.seen = np.zeros(1 << _BITS, bool)
        heads = [_head(keys[i : i + 1, :].ravel(), self.q)[0] for i in range(len(keys))]
        self.seen[np.array(heads, np.uint64) >> np.uint64(64 - _BITS)] = True

    def search(self, h: np.ndarray, left: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
        """h: word hashes of a shard; left: words from each place to its text's end. Yields shard places, owners, item places, window size."""
        if self.empty or not len(h):
            return
        at = np.flatnonzero(self.seen[_head(h, self.q) >> np.uint64(64 - _BITS)])
        at = at[left[at] >= self.q]
        for size, (packed, windows, bounds) in self.by_size.items():
            own = at[left[at] >= size]
            if not len(own):
                continue
            suffixes = _bytes(h[own[:, None] + np.arange(size)])
            order = np.argsort(suffixes, kind="stable")
            array, own = suffixes[order], own[order]
            lo, hi = np.searchsorted(array, packed, "left"), np.searchsorted(array, packed, "right")
            for k in np.flatnonzero(hi > lo):
                w = windows[bounds[k] : bounds[k + 1]]
                yield own[lo[k] : hi[k]], self.owner[w], self.place[w], size

    def longest(self, h: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The longest matches in a shard: shard place, owner, item place and words of each."""
        found = [(np.repeat(p, len(o)), np.tile(o, len(p)), np.tile(j, len(p)), np.full(len(p) * len(o), size)) for p, o, j, size in self.search(h, left)]
        if not found:
            return (np.zeros(0, np.int64),) * 4
        p, o, j, size = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((p, p - j, o))
        p, o, j, size = p[order], o[order], j[order], size[order]
        new = np.ones(len(p), bool)
        new[1:] = (o[1:] != o[:-1]) | (j[1:] != j[:-1] + 1) | (p[1:] != p[:-1] + 1)
        lead = np.flatnonzero(new)
        return p[lead], o[lead], j[lead], size[lead] + np.diff(np.append(lead, len(p))) - 1


def _block_rows(benchmark: DataFrame, size: int) -> Iterator[list[tuple[str | None, str | None]]]:
    """The benchmark's items in blocks; the driver holds one block at a time. There is always one."""
    now, held, any_ = [], 0, False
    rows = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("t"))
    for r in rows.toLocalIterator():
        now.append((r.i, r.t))
        held += len(r.t or "")
        if held >= size:
            yield now
            now, held, any_ = [], 0, True
    if now or not any_:
        yield now


def _shard(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw, offsets = text_bytes(batch.column("text"))
    words = Words(raw, offsets, ALNUM)
    counts = np.diff(words.bounds)
    left = np.repeat(words.bounds[1:], counts) - np.arange(len(words.hash))
    return words.hash, words.bounds, left


def _pairs(block: Block, bounds: np.ndarray, p: np.ndarray, o: np.ndarray, n: int) -> list[list[str]]:
    """The items found in each text, distinct, in order."""
    found: list[set] = [set() for _ in range(n)]
    rows = np.searchsorted(bounds, p, "right") - 1
    for pair in np.unique(rows << 32 | o).tolist():
        if block.ids[pair & 0xFFFFFFFF] is not None:
            found[pair >> 32].add(block.ids[pair & 0xFFFFFFFF])
    return [sorted(x) for x in found]


def _told(doc_ids: pa.Array, words: np.ndarray, hits: np.ndarray, names: list[list[str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            doc_ids,
            pa.array(words, pa.int64()),
            pa.array(hits, pa.int64()),
            pa.array([len(x) for x in names], pa.int64()),
            pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names], pa.string()),
            pa.array(hits > 0, pa.bool_()),
        ],
        ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    )


def _scan_block(own: DataFrame, shared) -> DataFrame:
    """The whole result where the benchmark is one block."""

    def run(batches):
        block = Block(shared.value)
        for batch in slices(batches, "text"):
            h, bounds, left = _shard(batch)
            p, o, _, size = block.longest(h, left)
            hit = np.zeros(len(h) + 1, np.int64)
            np.add.at(hit, p, 1)
            np.add.at(hit, p + size, -1)
            covered = np.concatenate([[0], np.cumsum(np.cumsum(hit[:-1]) > 0)])
            yield _told(batch.column("doc_id"), np.diff(bounds), covered[bounds[1:]] - covered[bounds[:-1]], _pairs(block, bounds, p, o, batch.num_rows))

    return own.mapInArrow(frugal(run), SCHEMA)


def _found_in_block(own: DataFrame, shared) -> DataFrame:
    """(key, items, spans) of rows (key, text) that hold a window of the block; spans: (first word, word behind)."""
    span = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))

    def run(batches):
        block = Block(shared.value)
        for batch in slices(batches, "text"):
            h, bounds, left = _shard(batch)
            p, o, _, size = block.longest(h, left)
            spans: list[list] = [[] for _ in range(batch.num_rows)]
            row = np.searchsorted(bounds, p, "right") - 1
            for r, s, e in zip(row.tolist(), (p - bounds[row]).tolist(), (p - bounds[row] + size).tolist(), strict=True):
                spans[r].append({"s": s, "e": e})
            items = _pairs(block, bounds, p, o, batch.num_rows)
            held = [i for i, x in enumerate(spans) if x]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(pa.array(held, pa.int64())), pa.array([items[i] for i in held], pa.list_(pa.string())), pa.array([spans[i] for i in held], span)],
                ["key", "items", "spans"],
            )

    return own.select("key", "text").mapInArrow(frugal(run), "key long, items array<string>, spans array<struct<s:long,e:long>>")


def _joined(own: DataFrame, found: DataFrame) -> DataFrame:
    """The result from what several blocks gave."""

    def count(batches):
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(np.diff(_shard(batch)[1]), pa.int64())], ["doc_id", "key", "n_words"])

    def tell(batches):
        for batch in batches:
            hits = []
            for spans in batch.column("spans").to_pylist():
                end = total = 0
                for s, e in sorted((x["s"], x["e"]) for x in spans or ()):
                    total += max(0, e - max(s, end))
                    end = max(end, e)
                hits.append(total)
            yield _told(batch.column("doc_id"), batch.column("n_words").to_numpy(), np.array(hits, np.int64), [sorted(x or ()) for x in batch.column("items").to_pylist()])

    each = found.distinct().groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"))
    words = own.mapInArrow(frugal(count), "doc_id long, key long, n_words long")
    return words.join(each, "key", "left").select("doc_id", "n_words", "items", "spans").mapInArrow(frugal(tell), SCHEMA)


def _each_block(own: DataFrame, benchmark: DataFrame, search, name: str) -> DataFrame:
    """What search(own, block) gives, block by block; each pass is written and its broadcast given back."""
    out = []
    for rows in _block_rows(benchmark, BLOCK_BYTES):
        with Scratch(own.sparkSession) as work:
            out.append(written(search(own, work.broadcast(rows)), name))
    return reduce(DataFrame.unionByName, out)


def _one_block(benchmark: DataFrame) -> list | None:
    """The benchmark's rows if they fit one block."""
    blocks = _block_rows(benchmark, BLOCK_BYTES)
    first = next(blocks)
    return first if next(blocks, None) is None else None


def _key():
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def scan(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: words, words inside benchmark windows, the items found; see the module's text for odd cases."""
    own, one = ids_and_text(docs), _one_block(benchmark)
    if one is not None:
        return _scan_block(own, docs.sparkSession.sparkContext.broadcast(one))
    own = own.withColumn("key", _key())
    return _joined(own, _each_block(own, benchmark, _found_in_block, "decontam-found"))


def longest_matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The longest verbatim matches with their places, in words, in document and item; written."""

    def search(own: DataFrame, shared) -> DataFrame:
        def run(batches):
            block = Block(shared.value)
            for batch in slices(batches, "text"):
                h, bounds, left = _shard(batch)
                p, o, j, size = block.longest(h, left)
                row = np.searchsorted(bounds, p, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(row)), pa.array([block.ids[i] for i in o.tolist()], pa.string()), *(pa.array(x, pa.int64()) for x in (p - bounds[row], j, size))],
                    ["doc_id", "item_id", "doc_word", "item_word", "n_words"],
                )

        return own.mapInArrow(frugal(run), MATCHES)

    return _each_block(ids_and_text(docs), benchmark, search, "decontam-matches")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents that hold a benchmark window; columns and rows stay, those with a null doc_id are judged too."""
    one, schema = _one_block(benchmark), docs.schema
    if one is None:
        name = unused(docs, "key")
        keyed = docs.withColumn(name, _key())
        bad = _each_block(keyed.select(F.col(name).alias("key"), F.col("text").cast("string").alias("text")), benchmark, _found_in_block, "decontam-found")
        return keyed.join(bad.select(F.col("key").alias(name)).distinct(), name, "left_anti").drop(name)
    shared = docs.sparkSession.sparkContext.broadcast(one)

    def run(batches):
        block = Block(shared.value)
        for batch in slices(batches, "text"):
            h, bounds, left = _shard(batch)
            bad = np.zeros(batch.num_rows, bool)
            bad[np.searchsorted(bounds, block.longest(h, left)[0], "right") - 1] = True
            yield batch.filter(pa.array(~bad))

    return docs.mapInArrow(frugal(run), schema)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
