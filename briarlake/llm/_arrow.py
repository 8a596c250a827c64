"""Whole-batch text work on Arrow buffers: the Python side of the operators works on byte arrays, never word by word."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one vectorised step handles; a longer text is handled alone.
SLICE_BYTES = 1 << 20
#: Rows of a slice, so that what is kept by row stays small however short the texts are.
SLICE_ROWS = 2048

_RNG = np.random.default_rng(20240229)
_POS_BITS = 12
_POS = _RNG.integers(0, 1 << 63, 1 << _POS_BITS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LAP = np.uint64(0x9E3779B97F4A7C15)

#: A-Z become a-z, every other byte stays.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words `[^\x20\x09-\x0D]+`.
NOT_BLANK = np.ones(256, dtype=bool)
NOT_BLANK[[9, 10, 11, 12, 13, 32]] = False

#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing (upper case counts too, as it is lowered).
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True

#: Bytes that letters are of: ASCII ones, and all of other scripts.
LETTERS = np.zeros(256, dtype=bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and its n+1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """The work of a partition, behind which the worker, which lives on for other tasks, gives its free memory back."""

    @functools.wraps(run)
    def work(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return work


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each slice holds at most `rows` rows and at most `limit` bytes of `column`, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        done, lo = 0, 0
        total = np.cumsum(sizes)
        while lo < batch.num_rows:
            hi = min(lo + rows, max(lo + 1, int(np.searchsorted(total, done + limit, "right"))))
            yield batch.slice(lo, hi - lo)
            done, lo = int(total[hi - 1]), hi


class Words:
    """The words of a slice: start and length of each in the byte buffer, a 64-bit hash, and each text's first word."""

    __slots__ = ("hash", "lengths", "starts", "bounds")

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, table: np.ndarray, hashed: bool = True):
        inside = table[raw]
        n = len(raw)
        if not inside.any():
            self.starts = self.lengths = np.zeros(0, np.int64)
            self.hash = np.zeros(0, np.uint64)
            self.bounds = np.zeros(len(offsets), np.int64)
            return
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        edges = offsets[:-1][offsets[:-1] < n]
        first[edges] = inside[edges]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        edges = offsets[1:][offsets[1:] > 0] - 1
        last[edges] = inside[edges]
        self.starts = np.flatnonzero(first)
        self.lengths = np.flatnonzero(last) + 1 - self.starts
        self.bounds = np.searchsorted(self.starts, offsets)
        self.hash = word_hashes(raw[inside], self.lengths) if hashed else np.zeros(0, np.uint64)


def word_hashes(letters: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hashes of the lower-cased words whose bytes stand one after another in `letters`."""
    begin = np.cumsum(lengths) - lengths
    place = np.arange(len(letters), dtype=np.int64) - np.repeat(begin, lengths)
    weight = _POS[place & ((1 << _POS_BITS) - 1)]
    if len(lengths) and int(lengths.max()) > 1 << _POS_BITS:
        weight = weight + (place >> _POS_BITS).astype(np.uint64) * _LAP * np.uint64(2)
    terms = (LOWER[letters].astype(np.uint64) + np.uint64(1)) * weight
    return mix(np.add.reduceat(terms, begin) + lengths.astype(np.uint64) * _LAP)
