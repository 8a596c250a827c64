"""Repeated byte strings, by sampled suffixes whose contexts are compared group by group.

This is not a merge of Burrows-Wheeler transforms of shards by interleave refinement, which was asked for. Each pass of that
merge moves every suffix to the rank of its predecessor, over the whole corpus, and strings of 400 bytes take up to 400
passes, or some 13 to 20 over content-defined phrases; either way each pass shuffles all suffixes that still repeat, and half
of the corpus does. What is done instead finds the same strings, exactly but for collisions of 64-bit hashes:

Sampled suffixes. By winnowing: of the hashes of all k-grams, those smallest in a window of g. With k + g - 1 = length, each
string of `length` bytes holds a sampled suffix, and equal strings hold it at the same place. A sampled suffix has its
k-gram, and as its context the bytes before and behind that any string of `length` bytes with that sample can hold.

Groups. The samples of one k-gram are a group. Three cases:

* the group has one row: nothing repeats there;
* rows agree on all their context: every string through them repeats, so counting is enough, before the shuffle;
* the rest are refined as intervals of a suffix array are: right contexts split the group step by step (eight bytes a step,
  intervals of one row leave), which also gives the common prefixes; then each step back over the preceding byte splits the
  intervals again. After l such steps, rows that still share an interval and whose common prefix is at least length - l are
  repeats that start l bytes before the sample.

Texts are UTF-8 bytes; null and empty ones have none. Strings never cross texts. Rows that repeat are occurrences of their
own. Samples that repeat within one text are settled in place and reach the shuffle as one row, so texts with a short
period stay small. Groups of more than `HOT` rows with differing contexts are not gathered in a task: their strings are
counted by hash instead, with the same result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from briarlake.llm._arrow import frugal, mix, slices, text_bytes
from briarlake.llm._store import Scratch, ids_and_text, written

LENGTH = 400
HOT = 50_000
#: Rows of whole intervals that one merge takes.
MERGE_ROWS = 20_000
#: Bits of a place within a slice: texts have less than 2 GB.
_PLACE_BITS = 31
_RNG = np.random.default_rng(400)
_TABLE = _RNG.integers(0, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0xD1342543DE82EF95)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}
SAMPLES = "k1 long, k2 long, a int, s int, e int, h long, w long, n long"


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    if len(_POWERS.get("up", ())) < n:
        n = max(n, 1 << 21)
        for name, base in (("up", _BASE), ("down", _BACK)):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _POWERS[name] = np.multiply.accumulate(x)
    return _POWERS["up"], _POWERS["down"]


class Hashes:
    """Hashes of any stretch of a byte buffer, of which equal stretches have equal ones, in two independent kinds."""

    def __init__(self, raw: np.ndarray):
        up, self.down = _powers(len(raw) + 1)
        self.sums = []
        for table in _TABLE:
            s = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum(table[raw] * up[: len(raw)], out=s[1:])
            self.sums.append(s)

    def of(self, lo: np.ndarray, hi: np.ndarray, kind: int) -> np.ndarray:
        s = self.sums[kind]
        return mix((s[hi] - s[lo]) * self.down[lo])

    def all(self, k: int) -> np.ndarray:
        s = self.sums[0]
        return mix((s[k:] - s[:-k]) * self.down[: len(s) - k])


def _sliding_minimum(x: np.ndarray, g: int) -> np.ndarray:
    n = len(x)
    rows = np.full(-(-n // g) * g, np.iinfo(np.uint64).max, np.uint64)
    rows[:n] = x
    rows = rows.reshape(-1, g)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - g + 1], ahead[g - 1 : n])


def sample(raw: np.ndarray, offsets: np.ndarray, length: int):
    """Per sampled suffix: text, place in the buffer, context's bounds, and hashes of its k-gram and of its context."""
    k = length // 2
    g = length - k + 1
    size = np.diff(offsets)
    texts = np.flatnonzero(size >= length)
    empty = np.zeros(0, np.int64)
    if not len(texts):
        return empty, empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64), None
    hashes = Hashes(raw)
    grams = hashes.all(k)
    mask = np.uint64((1 << _PLACE_BITS) - 1)
    least = _sliding_minimum((grams & ~mask) | np.arange(len(grams), dtype=np.uint64), g) & mask
    starts = size[texts] - length + 1
    first = np.cumsum(starts) - starts
    windows = np.repeat(offsets[:-1][texts] - first, starts) + np.arange(int(starts.sum()))
    at = np.unique(least[windows].astype(np.int64))
    text = np.searchsorted(offsets, at, "right") - 1
    lo = np.maximum(offsets[text], at - (length - k))
    hi = np.minimum(offsets[text + 1], at + length)
    context = mix(hashes.of(lo, hi, 1) + (at - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (hi - at).astype(np.uint64))
    return text, at, lo, hi, grams[at], context, hashes


def _keyed(docs: DataFrame) -> DataFrame:
    own = ids_and_text(docs).withColumn("text", F.coalesce("text", F.lit("")))
    return own.select("doc_id", "text", F.coalesce("doc_id", F.lit(-1)).alias("k1"), F.xxhash64("text").alias("k2"))


def _samples(keyed: DataFrame, length: int) -> DataFrame:
    """Rows of the shards' transforms; rows without h are stretches that repeat within their own text."""

    def run(batches):
        for batch in slices(batches, "text"):
            raw, offsets = text_bytes(batch.column("text"))
            text, at, lo, hi, h, w, _ = sample(raw, offsets, length)
            k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
            order = np.lexsort((at, w, h, text))
            t, x, y = text[order], h[order], w[order]
            new = np.ones(len(order), bool)
            new[1:] = (t[1:] != t[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
            group = np.cumsum(new) - 1
            times = np.bincount(group) if len(group) else np.zeros(0, np.int64)
            once = order[new][times == 1]
            often = order[new][times > 1]
            inner = order[times[group] > 1] if len(group) else order
            base = offsets[text] if len(text) else text
            inner = inner[np.argsort(at[inner], kind="stable")]
            # stretches of one text that touch are one row
            s, e, owner = lo[inner], hi[inner], text[inner]
            apart = np.ones(len(inner), bool)
            if len(inner) > 1:
                apart[1:] = (owner[1:] != owner[:-1]) | (s[1:] > np.maximum.accumulate(e)[:-1])
            lead = np.flatnonzero(apart)
            ends = np.maximum.reduceat(e, lead) if len(lead) else e
            row = np.concatenate([once, often, inner[lead]])
            kind = np.concatenate([np.zeros(len(once), int), np.ones(len(often), int), np.full(len(lead), 2)])
            end = np.concatenate([hi[once], hi[often], ends])
            start = np.concatenate([lo[once], lo[often], s[lead]])
            null = kind == 2
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(k1[text[row]], pa.int64()),
                    pa.array(k2[text[row]], pa.int64()),
                    pa.array((at[row] - base[row]).astype(np.int32)),
                    pa.array((start - base[row]).astype(np.int32)),
                    pa.array((end - base[row]).astype(np.int32)),
                    pa.array(h[row].view(np.int64), pa.int64(), mask=null),
                    pa.array(w[row].view(np.int64), pa.int64(), mask=null),
                    pa.array(np.where(kind == 1, 2, 1), pa.int64()),
                ],
                ["k1", "k2", "a", "s", "e", "h", "w", "n"],
            )

    return keyed.select("k1", "k2", "text").mapInArrow(frugal(run), SAMPLES)


def _contexts(rows: DataFrame, keyed: DataFrame, length: int) -> DataFrame:
    """The bytes around samples (k1, k2, a, s, e, h): c, a second hash of the k-gram; before, backwards; behind the k-gram."""
    k = length // 2

    def run(batches):
        for batch in slices(batches, "text"):
            out: list[list] = [[] for _ in range(7)]
            for k1, k2, text, found in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "text", "found")), strict=True):
                b = text.encode()
                for f in found:
                    a, h = f["a"], f["h"]
                    c = int.from_bytes(hashlib.blake2b(b[a : a + k], digest_size=8).digest(), "little", signed=True)
                    for column, v in zip(out, (h, c, k1, k2, a, b[f["s"] : a][::-1], b[a + k : f["e"]]), strict=True):
                        column.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], ["h", "c", "k1", "k2", "a", "before", "behind"])

    lists = rows.groupBy("k1", "k2").agg(F.collect_set(F.struct("a", "s", "e", "h")).alias("found"))
    once = keyed.select("k1", "k2", "text").join(lists, ["k1", "k2"])
    return once.mapInArrow(frugal(run), "h long, c long, k1 long, k2 long, a int, before binary, behind binary")


def _matrix(column: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    out = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in column), np.uint8).reshape(-1, width)
    return out, np.array([len(x) for x in column])


def interleave(first: np.ndarray, before: list[bytes], behind: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Merges the rows of whole intervals. first: each row's interval; before: bytes backwards; behind: after the k-gram.

    Gives (row, l): the string of `length` bytes that starts l bytes before the sample occurs in another row too.
    """
    k = length // 2
    most, n = length - k, len(first)
    width = -(-most // 8) * 8
    right, right_size = _matrix(behind, width)
    left, left_size = _matrix(before, most)
    words = right.reshape(n, -1, 8).view(">u8").reshape(n, -1).astype(np.uint64)
    # the right contexts: order and common prefixes by refining intervals, eight bytes a step
    order = np.argsort(first, kind="stable")
    interval = np.unique(first, return_inverse=True)[1][order]
    common = np.full(max(n - 1, 0), -1, np.int64)
    common[interval[1:] == interval[:-1]] = most
    for step in range(words.shape[1]):
        same = interval[1:] == interval[:-1]
        if not same.any():
            break
        live = np.zeros(n, bool)
        live[1:] |= same
        live[:-1] |= same
        at = np.flatnonzero(live)
        rows = order[at]
        by = np.lexsort((words[rows, step], interval[at]))
        rows = order[at] = rows[by]
        w, inner = words[rows, step], interval[at]
        split = (inner[1:] == inner[:-1]) & (w[1:] != w[:-1])
        x = w[1:] ^ w[:-1]
        equal = np.zeros(len(x), np.int64)
        for shift in (56, 48, 40, 32, 24, 16, 8):
            equal += (x >> np.uint64(shift)) == 0
        gaps = at[1:][split] - 1
        common[gaps] = step * 8 + equal[split]
        rise = np.zeros(n, np.int64)
        rise[at[1:][split]] = 1
        interval = interval + np.cumsum(rise)
    shortest = np.minimum(right_size[order[1:]], right_size[order[:-1]])
    common = np.minimum(common, shortest)
    # steps back: each preceding byte refines the intervals
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    live, bucket = np.arange(n), np.unique(first, return_inverse=True)[1]
    found_row, found_l = [], []
    for l in range(most + 1):
        near = np.concatenate([[0], np.cumsum(common < most - l)])[place[live]]
        # a row too short to hold the string on the right shares no prefix of that length with any other
        pair = near * np.int64(n + 1) + bucket
        _, which, times = np.unique(pair, return_inverse=True, return_counts=True)
        hit = (times[which] > 1) & (right_size[live] >= most - l)
        found_row.append(live[hit])
        found_l.append(np.full(int(hit.sum()), l))
        if l == most:
            break
        on = left_size[live] > l
        live, bucket = live[on], bucket[on]
        if not len(live):
            break
        _, bucket, times = np.unique(bucket * 256 + left[live, l], return_inverse=True, return_counts=True)
        on = times[bucket] > 1
        live, bucket = live[on], bucket[on]
        if not len(live):
            break
    return np.concatenate(found_row), np.concatenate(found_l)


def _stretches(a: np.ndarray, row: np.ndarray, l: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the runs of neighbouring strings of each row."""
    order = np.lexsort((l, row))
    row, l = row[order], l[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (l[1:] != l[:-1] + 1)
    lead = np.flatnonzero(new)
    last = np.append(lead[1:], len(row)) - 1 if len(lead) else lead
    return row[lead], a[row[lead]] - l[last], a[row[lead]] - l[lead] + length


def _merged(contexts: DataFrame, length: int) -> DataFrame:
    """(k1, k2, s, e) of the repeats among rows whose contexts differ."""

    def merge(rows: pa.Table):
        h, c = rows.column("h").to_numpy(), rows.column("c").to_numpy()
        first = np.unique(np.stack([h, c]), axis=1, return_inverse=True)[1].ravel()
        row, l = interleave(first, rows.column("before").to_pylist(), rows.column("behind").to_pylist(), length)
        row, s, e = _stretches(rows.column("a").to_numpy().astype(np.int64), row, l, length)
        return pa.RecordBatch.from_arrays(
            [pa.array(rows.column("k1").to_numpy()[row]), pa.array(rows.column("k2").to_numpy()[row]), pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32))],
            ["k1", "k2", "s", "e"],
        )

    def run(batches):
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < MERGE_ROWS:
                continue
            table = pa.Table.from_batches(held)
            h = table.column("h").to_numpy()
            # the last interval may go on in the next batch
            cut = int(np.searchsorted(h != h[-1], False)) if h[0] == h[-1] else int(np.flatnonzero(h != h[-1])[-1]) + 1
            if cut:
                yield merge(table.slice(0, cut))
            held = table.slice(cut).to_batches()
            rows = len(table) - cut
        if held:
            yield merge(pa.Table.from_batches(held))

    return contexts.repartition("h").sortWithinPartitions("h").mapInArrow(frugal(run), "k1 long, k2 long, s int, e int")


def _counted(contexts: DataFrame, length: int, work: Scratch) -> DataFrame:
    """What _merged gives, for intervals too large to gather: every string's hash is counted, before the shuffle first."""
    k = length // 2

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for h, c, k1, k2, a, before, behind in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                for l in range(max(0, length - k - len(behind)), len(before) + 1):
                    d = hashlib.blake2b(before[:l] + b"|" + behind[: length - k - l] + h.to_bytes(8, "little", signed=True) + c.to_bytes(8, "little", signed=True), digest_size=16).digest()
                    x, y = int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)
                    for column, v in zip(out, (x, y, k1, k2, a - l, a - l + length), strict=True):
                        column.append(v)
            kinds = [pa.int64()] * 4 + [pa.int32()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], ["x", "y", "k1", "k2", "s", "e"])

    strings = work.written(contexts.select("h", "c", "k1", "k2", "a", "before", "behind").mapInArrow(frugal(run), "x long, y long, k1 long, k2 long, s int, e int"), "suffix-strings")
    often = work.written(strings.groupBy("x", "y").agg(F.count("*").alias("n")).where("n > 1").select("x", "y"), "suffix-often")
    return strings.join(often, ["x", "y"]).select("k1", "k2", "s", "e")


def _covered(keyed: DataFrame, length: int, hot: int, work: Scratch) -> DataFrame:
    """(k1, k2, s, e): stretches of texts whose every byte lies in a repeated string."""
    rows = work.written(_samples(keyed, length), "suffix-samples")
    own = rows.where("h is null").select("k1", "k2", "s", "e")
    rows = rows.where("h is not null")
    intervals = rows.groupBy("h").agg(F.sum("n").alias("n"), F.min("w").alias("lo"), F.max("w").alias("hi")).where("n > 1")
    intervals = work.written(intervals.select("h", (F.col("lo") == F.col("hi")).alias("alike")), "suffix-intervals")
    members = work.written(rows.join(intervals, "h").select("k1", "k2", "a", "s", "e", "h", "w", "n", "alike"), "suffix-members")
    alike = members.where("alike").select("k1", "k2", "s", "e")
    mixed = members.where("not alike")
    # rows that agree are one; the first of them stands for all, so that those which differ meet it
    kinds = work.written(mixed.groupBy("h", "w").agg(F.sum("n").alias("n"), F.min(F.struct("k1", "k2", "a", "s", "e")).alias("m")), "suffix-kinds")
    many = mixed.join(kinds.where("n > 1").select("h", "w"), ["h", "w"]).select("k1", "k2", "s", "e")
    contexts = _contexts(kinds.select("m.*", "h"), keyed, length)
    large = work.written(kinds.groupBy("h").agg(F.count("*").alias("rows")).where(F.col("rows") > hot).select("h"), "suffix-large")
    if large.isEmpty():
        met = _merged(contexts, length)
    else:
        contexts = work.written(contexts, "suffix-contexts")
        met = _merged(contexts.join(large, "h", "left_anti"), length).unionByName(_counted(contexts.join(large, "h", "left_semi"), length, work))
    return own.unionByName(alike).unionByName(many).unionByName(met)


def _with_stretches(docs: DataFrame, length: int, hot: int) -> DataFrame:
    """doc_id, text and the stretches to remove, of every row."""
    keyed = _keyed(docs)
    with Scratch(docs.sparkSession) as work:
        found = _covered(keyed, length, hot, work).groupBy("k1", "k2").agg(F.collect_set(F.struct("s", "e")).alias("found"))
        lists = written(found, "suffix-found")
    return keyed.join(lists, ["k1", "k2"], "left").select("doc_id", "text", "found")


def _runs(found: list[dict] | None) -> list[list[int]]:
    out: list[list[int]] = []
    for s, e in sorted((f["s"], f["e"]) for f in found or ()):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def _kept(data: bytes, runs: list[list[int]]) -> bytes:
    edges = [0, *(x for r in runs for x in r), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def removed(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """Per row of docs: doc_id, kept (the bytes left), and the removed runs as (start, end)."""

    def run(batches):
        for batch in slices(batches, "text"):
            runs = [_runs(f) for f in batch.column("found").to_pylist()]
            kept = [_kept(t.encode(), r) for t, r in zip(batch.column("text").to_pylist(), runs, strict=True)]
            told = pa.array([[{"start": a, "end": b} for a, b in r] for r in runs], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kept, pa.binary()), told], ["doc_id", "kept", "runs"])

    return _with_stretches(docs, length, hot).mapInArrow(frugal(run), "doc_id long, kept binary, runs array<struct<start:int,end:int>>")


def digest(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def run(batches):
        for batch in slices(batches, "text"):
            out: list[list] = [[] for _ in range(4)]
            for text, found in zip(batch.column("text").to_pylist(), batch.column("found").to_pylist(), strict=True):
                data, runs = text.encode(), _runs(found)
                for c, v in zip(out, (len(data), sum(b - a for a, b in runs), len(runs), hashlib.sha256(_kept(data, runs)).hexdigest()), strict=True):
                    c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            )

    return _with_stretches(docs, length, hot).mapInArrow(frugal(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
