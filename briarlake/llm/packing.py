"""Harmonic packing of token sequences.

Each document's ids (with the closing id 0) are cut into full sequences of `capacity` tokens and a rest. The rest is cut
into pieces of capacity/2, capacity/4 … down to `SMALLEST`, the largest first, and one last piece below `SMALLEST`. Pieces
fall into reciprocal-capacity classes: class k takes lengths in (capacity/(k+1), capacity/k], and k pieces fill a bin of
class k. The cut pieces fill their bins exactly. Only bins of the last, short pieces are padded, by less than one such
piece. Every worker fills the bins of each class by itself, in the order of its rows, holding only the open bins.

What is left open when a worker ends goes out without padding: short pieces are cut at powers of two and join those
classes, and a bin with c < k pieces of one power of two is split into sequences that hold a power of two of pieces, whose
length is then a power of two, which needs no padding.

sequence_id is (partition << 40) + the bin's number there: a rerun of a lost partition gives the same ids. A null or empty
text is the id 0 alone. Rows that repeat are packed each on its own.
"""

from __future__ import annotations

import itertools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from briarlake.llm._arrow import NOT_BLANK, frugal, slices, text_bytes
from briarlake.llm._store import ids_and_text

CAPACITY = 1024
#: Rests are cut at powers of two down to this length.
SMALLEST = 64
#: Distinct chunks of text whose ids a task keeps.
CACHE = 120_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of whole texts by a byte-level BPE tokenizer file, with a bounded cache of chunks.

    The pre-tokenizer never joins a non-blank character with a single space behind it, so a text falls apart before each
    space that stands between two non-blank characters; each chunk's ids do not depend on its neighbours. Spaces beside
    what may be blank outside ASCII are never cut at, which only makes a chunk longer. The file's special tokens are found
    before all else, so each occurrence in a text is a chunk of its own, of one id. Chunks are told apart in one Arrow
    dictionary encoding per slice; only chunks that the cache lacks meet the tokenizer, which is a compiled BPE over the
    file's own vocabulary (its ids are in merge order).
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.special = {t["content"].encode(): t["id"] for t in file["added_tokens"]}
        self.marks = re.compile(b"|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        vocab = file["model"]["vocab"]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
        ranks = {bytes(byte_of[c] for c in word): i for word, i in vocab.items() if all(c in byte_of for c in word)}
        ranks = {w: i for w, i in ranks.items() if w not in self.special}
        self.encode = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.reset()

    def reset(self) -> None:
        """Forgets all chunks."""
        self.known: dict[bytes, int] = {}
        self.base = np.zeros(0, np.uint32)
        self.starts = self.lengths = np.zeros(0, np.int64)

    def cuts(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where chunks begin: each text's start, the safe spaces, and both ends of special tokens."""
        n = len(raw)
        pad = np.full(n + 6, 10, np.uint8)
        pad[3 : n + 3] = raw
        at = np.flatnonzero(raw == 32)
        before, after = pad[at + 2], pad[at + 4]
        wide = lambda x: (x >= 0xE1) & (x <= 0xE3)
        blank = lambda lead, x: (lead == 0xC2) & ((x == 0x85) | (x == 0xA0))
        dark = lambda x: NOT_BLANK[x] & ((x < 28) | (x > 31))
        safe = dark(before) & dark(after) & ~wide(after) & ~wide(pad[at]) & ~blank(pad[at + 1], before) & ~blank(after, pad[at + 5])
        begin = np.concatenate([at[safe], offsets[:-1]])
        if self.marks and (found := self._marks(raw, offsets)):
            # a token may hold a space that is no place to cut
            first, end = np.array(found).T
            last = np.searchsorted(first, begin, "left") - 1
            begin = np.concatenate([begin[(last < 0) | (begin >= end[last])], first, end])
        return np.unique(begin[begin < n])

    def _marks(self, raw: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
        """(start, end) of the special tokens, none of which crosses texts."""
        out, data = [], raw.tobytes()
        at = 0
        while m := self.marks.search(data, at):
            edge = int(offsets[np.searchsorted(offsets, m.start(), "right")])
            at = m.end() if m.end() <= edge else m.start() + 1
            if m.end() <= edge:
                out.append(m.span())
        return out

    def __call__(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, each with its closing 0, and the offsets of the texts' ids."""
        if len(self.known) > CACHE:
            self.reset()
        begin = self.cuts(raw, offsets)
        if not len(begin):
            return np.zeros(len(offsets) - 1, np.uint32), np.arange(len(offsets))
        edges = np.append(begin, len(raw)).astype(np.int64)
        chunks = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(raw))])
        coded = chunks.dictionary_encode()
        words, known = coded.dictionary.to_pylist(), self.known
        missing = [w for w in words if w not in known]
        if missing:
            found, base = [[self.special[w]] if w in self.special else self.encode(w.decode()) for w in missing], len(known)
            known.update(zip(missing, range(base, base + len(missing)), strict=True))
            new, end = np.fromiter(map(len, found), np.int64, len(found)), len(self.base)
            self.base = np.concatenate([self.base, np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(new.sum()))])
            self.starts = np.concatenate([self.starts, end + np.cumsum(new) - new])
            self.lengths = np.concatenate([self.lengths, new])
        which = np.fromiter(map(known.__getitem__, words), np.int64, len(words))[coded.indices.to_numpy()]
        size = self.lengths[which]
        behind = np.cumsum(size)
        total = int(behind[-1])
        ids = self.base[np.repeat(self.starts[which] - (behind - size), size) + np.arange(total)]
        # ids before each text: those of the chunks before its first one
        ends = np.concatenate([[0], behind])[np.searchsorted(begin, offsets)]
        ends[-1] = total
        out = np.zeros(total + len(offsets) - 1, np.uint32)
        out[np.arange(total) + np.repeat(np.arange(len(offsets) - 1), np.diff(ends))] = ids
        return out, ends + np.arange(len(offsets))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def cut(n: int, capacity: int = CAPACITY, smallest: int = SMALLEST) -> list[int]:
    """Piece lengths of a document of n ids, in order."""
    out, rest = [capacity] * (n // capacity), n % capacity
    size = capacity // 2
    while rest >= smallest and size >= smallest:
        if rest >= size:
            out.append(size)
            rest -= size
        size //= 2
    return [*out, rest] if rest else out


class Bins:
    """The open bins of one worker. A piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, first_id: int, capacity: int = CAPACITY):
        self.next, self.capacity, self.open = first_id, capacity, {}

    def _emit(self, pieces: list) -> Iterator[tuple]:
        offset = 0
        for doc_id, start, ids, total in pieces:
            yield doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.next, offset
            offset += len(ids)
        self.next += 1

    def add(self, piece: tuple) -> Iterator[tuple]:
        """A piece joins the open bin of its class; a full bin is emitted."""
        k = self.capacity // len(piece[2])
        bin_ = self.open.setdefault(k, [])
        bin_.append(piece)
        if len(bin_) == k:
            self.open[k] = []
            yield from self._emit(bin_)

    def close(self) -> Iterator[tuple]:
        """Cuts open pieces at powers of two, then splits open bins so that no sequence needs padding."""
        for k in list(self.open):
            for piece in self.open[k] if self.capacity % k or any(self.capacity // k != len(p[2]) for p in self.open[k]) else ():
                doc_id, start, ids, total = piece
                at = 0
                while at < len(ids):
                    size = 1 << ((len(ids) - at).bit_length() - 1)
                    yield from self._into(("cut", size), (doc_id, start + at, ids[at : at + size], total), self.capacity // size)
                    at += size
                self.open[k] = [p for p in self.open[k] if p is not piece]
        for key in sorted(self.open, key=str):
            pieces = self.open[key]
            while pieces:
                take = 1 << (len(pieces).bit_length() - 1)
                yield from self._emit(pieces[:take])
                pieces = pieces[take:]
        self.open = {}

    def _into(self, key, piece: tuple, k: int) -> Iterator[tuple]:
        bin_ = self.open.setdefault(key, [])
        bin_.append(piece)
        if len(bin_) == k:
            self.open[key] = []
            yield from self._emit(bin_)


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece; `capacity` is a power of two. No shuffle: every partition packs its own rows."""
    if capacity & (capacity - 1) or capacity < SMALLEST:
        raise ValueError("capacity must be a power of two")
    path = tokenizer or default_tokenizer()

    def table(rows: list) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        )

    def run(batches):
        encode, bins, rows = encoder(path), Bins(TaskContext.get().partitionId() << 40, capacity), []
        for batch in slices(batches, "text", 2 << 20):
            flat, ends = encode(*text_bytes(batch.column("text")))
            for doc_id, lo, hi in zip(batch.column("doc_id").to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                ids, start = flat[lo:hi], 0
                for size in cut(len(ids), capacity):
                    rows += bins.add((doc_id, start, ids[start : start + size], len(ids)))
                    start += size
            if len(rows) >= 20_000:
                yield table(rows)
                rows = []
        rows += bins.close()
        encode.reset()
        yield table(rows)

    return ids_and_text(docs).mapInArrow(frugal(run), SCHEMA)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
