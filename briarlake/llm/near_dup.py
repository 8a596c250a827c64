"""Near-duplicates by MinHash signatures and a multi-index Hamming join, confirmed on full shingle sets.

A document's signature has `CHUNKS` x `PER_CHUNK` minima of `BITS` bits. Two signatures that differ in fewer than
CHUNKS * (ERRORS + 1) components agree, by pigeonhole, on some chunk but for at most ERRORS components. All such errors are
enumerated: a chunk gives one key per set of PER_CHUNK - ERRORS components that stay. Documents that share a key are
candidates, so every pair under that distance is found. With 8 x 5 components and one error, a pair of similarity 0.85
shares no key with probability 5e-7, one of 0.8 with 2e-5.

Candidates are weighed in the join by odd sketches of their full sets (the parity of hashed shingles in `SKETCH` bits). The
distance of two sketches never exceeds the size of the sets' difference, so a pair further apart than the similarity allows
is none; no other pair is left out. The others are confirmed on the full sets.

Work follows the documents, not the pairs:

1. Equal sets fall together by their digest, counted before the shuffle; one row stands for each set.
2. Each row is held against the smallest of every key it shares (a star), which links copies in linear work.
3. Only keys whose rows are then still in several components are compared further, between components only. The rows of a
   key of more than `LARGE` (a passage that many share) are parted by bands of set size, which similar sets cannot be apart
   by more than one, and dealt in blocks of about `LARGE` that are joined two by two. So every pair that shares any key is
   weighed, at any size; rows of the key's largest component are not held against each other.
4. Links are joined to components by alternating large and small stars.

No pair of copies within a component is listed. A row is known by its doc_id, so the hub of a key is its first document, of
which the others are most often copies; rows that share a doc_id but not a text are told apart by a 64-bit hash of both.
"""

from __future__ import annotations

import hashlib
import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from briarlake.llm._arrow import NOT_BLANK, Words, frugal, mix, slices, text_bytes
from briarlake.llm._store import Scratch, ids_and_text, unused, written

CHUNKS, PER_CHUNK, ERRORS, BITS = 8, 5, 1, 16
#: Bits of the odd sketch of a full set.
SKETCH = 1024
#: Rows of one key that are compared in one task; also a block's size.
LARGE = 2000
#: Bits of the map of rows whose texts a confirmation needs.
MAP_BITS = 1 << 23
_KEEP = list(combinations(range(PER_CHUNK), PER_CHUNK - ERRORS))
KEYS = CHUNKS * len(_KEEP)
_K = CHUNKS * PER_CHUNK
_RNG = np.random.default_rng(85)
_MUL = _RNG.integers(0, 1 << 63, _K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, _K, dtype=np.uint64)
_SALT = mix(np.arange(1, KEYS + 1, dtype=np.uint64))
_WORD = mix(np.arange(101, 201, dtype=np.uint64)) | np.uint64(1)

_LANES = [f"o{i}" for i in range(SKETCH // 64)]
FEATURES = "node long, doc_id long, n_shingles long, digest binary, keys array<long>, " + ", ".join(f"{x} long" for x in _LANES)


def shingle_sets(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of every text in a slice, one after another, and their n+1 bounds.

    A text of fewer than k words has its whole sequence as one shingle; one without words has none.
    """
    raw, offsets = text_bytes(batch.column("text"))
    words = Words(raw, offsets, NOT_BLANK)
    h, counts = words.hash, np.diff(words.bounds)
    n = len(h)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    mixed = np.zeros(n, np.uint64)
    for j in range(k):
        mixed[: n - j] += h[j:] * _WORD[j]
    doc = np.repeat(np.arange(len(counts)), counts)
    left = np.repeat(words.bounds[1:], counts) - np.arange(n)
    short = np.flatnonzero((counts > 0) & (counts < k))
    use = left >= k
    for d in short.tolist():
        lo, hi = words.bounds[d], words.bounds[d + 1]
        mixed[lo] = (h[lo:hi] * _WORD[: hi - lo]).sum() + np.uint64(hi - lo)
        use[lo] = True
    s, doc = mix(mixed[use]), doc[use]
    order = np.lexsort((s, doc))
    s, doc = s[order], doc[order]
    first = np.ones(len(s), bool)
    first[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    s, doc = s[first], doc[first]
    return s, np.searchsorted(doc, np.arange(len(counts) + 1))


def signatures(s: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The signature of each non-empty set; begin: where sets begin in s."""
    out = np.empty((len(begin), _K), np.uint64)
    for j in range(_K):
        x = s * _MUL[j] + _ADD[j]
        x ^= x >> np.uint64(32)
        out[:, j] = mix(np.minimum.reduceat(x, begin)) & np.uint64((1 << BITS) - 1)
    return out


def _band_keys(signature: np.ndarray) -> np.ndarray:
    """The keys of each signature: every chunk with every set of components that stay."""
    out = np.empty((len(signature), KEYS), np.uint64)
    for i in range(CHUNKS):
        for j, keep in enumerate(_KEEP):
            packed = np.zeros(len(signature), np.uint64)
            for c in keep:
                packed = (packed << np.uint64(BITS)) | signature[:, i * PER_CHUNK + c]
            at = i * len(_KEEP) + j
            out[:, at] = mix(packed ^ _SALT[at])
    return out


def _sketches(s: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The odd sketch of every set, as 64-bit words."""
    n = len(bounds) - 1
    row = np.repeat(np.arange(n), np.diff(bounds))
    bit = (mix(s ^ _SALT[0]) % np.uint64(SKETCH)).astype(np.int64)
    odd = (np.bincount(row * SKETCH + bit, minlength=n * SKETCH) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(n, SKETCH), axis=1, bitorder="little").view(np.int64)


def features(docs: DataFrame, words: int) -> DataFrame:
    """Set size, digest, keys and sketch of rows (node, doc_id, text)."""

    def run(batches):
        for batch in slices(batches, "text"):
            s, bounds = shingle_sets(batch, words)
            size = np.diff(bounds)
            full = np.flatnonzero(size)
            signature = signatures(s, bounds[:-1][full]) if len(full) else np.zeros((0, _K), np.uint64)
            digests = [hashlib.blake2b(s[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(np.where(size > 0, KEYS, 0))]), pa.int32()), pa.array(_band_keys(signature).ravel().view(np.int64), pa.int64())
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(digests, pa.binary()), lists, *(pa.array(x) for x in _sketches(s, bounds).T.copy())],
                ["node", "doc_id", "n_shingles", "digest", "keys", *_LANES],
            )

    return docs.mapInArrow(frugal(run), FEATURES)


def _chosen_texts(docs: DataFrame, ids: DataFrame, work: Scratch) -> DataFrame:
    """(id, text) of the rows (node, doc_id, text) whose doc_id or node is among ids, and a few others, without a shuffle of texts.

    A bit map of `MAP_BITS` bits, whatever the number of ids, is built by a distributed aggregate and broadcast; the joins
    that follow drop what it lets through by chance.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(MAP_BITS))
    page = 32768
    marks = ids.select(place("id").alias("p")).groupBy((F.col("p") / page).cast("int").alias("k")).agg(F.bitmap_construct_agg(F.col("p") % page).alias("bits"))
    bits = bytearray(MAP_BITS // 8)
    for r in marks.toLocalIterator():
        bits[r.k * page // 8 : (r.k + 1) * page // 8] = bytes(r.bits)
    shared = work.broadcast(bytes(bits))

    def run(batches):
        wanted = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            for name, at in (("doc_id", "p"), ("node", "q")):
                p = batch.column(at).to_numpy()
                held = pa.array((wanted[p >> 3] >> (p & 7) & 1).astype(bool))
                yield pa.RecordBatch.from_arrays([batch.column(name).filter(held), batch.column("text").filter(held)], ["id", "text"])

    known = docs.where("doc_id is not null").select("node", "doc_id", "text", place("doc_id").alias("p"), place("node").alias("q"))
    return work.written(known.mapInArrow(frugal(run), "id long, text string"), "near-dup-texts")


def confirmed(pairs: DataFrame, docs: DataFrame, words: int, percent: int, work: Scratch) -> DataFrame:
    """The pairs (a, b) whose full sets meet the similarity: 100 * |A and B| >= percent * |A or B|."""

    def compare(batches):
        for batch in slices(batches, "x"):
            sets = [shingle_sets(pa.RecordBatch.from_arrays([batch.column(c)], ["text"]), words) for c in ("x", "y")]
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = (s[bounds[i] : bounds[i + 1]] for s, bounds in sets)
                if not len(x) or 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    continue
                at = np.searchsorted(x, y)
                at[at == len(x)] = 0
                both = int((x[at] == y).sum())
                keep[i] = both and 100 * both >= percent * (len(x) + len(y) - both)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    own = _chosen_texts(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), work)
    both = pairs.join(own.select(F.col("id").alias("a"), F.col("text").alias("x")), "a").join(own.select(F.col("id").alias("b"), F.col("text").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(frugal(compare), "a long, b long").distinct()


def components(edges: DataFrame, work: Scratch) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b): the smallest node reachable.

    Large and small stars alternate; each round is written, so no plan grows. A node's neighbours are only ever aggregated
    to their minimum, never listed.
    """
    now, before = work.written(edges.where("a <> b").selectExpr("greatest(a, b) u", "least(a, b) v").distinct(), "stars"), None
    while True:
        both = now.select("u", "v").unionByName(now.selectExpr("v u", "u v"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) m")
        large = both.where("v > u").join(low, "u").selectExpr("v u", "m v")
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").selectExpr("case when v = m then u else v end u", "m v").where("u <> v").distinct()
        now = work.written(small, "stars")
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark == before:
            break
        before = mark
    return now.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")


def _near(x: str, y: str, percent: int) -> str:
    """Whether two rows may be of this similarity: by their set sizes, and by the distance of their sketches."""
    sizes = f"100 * least({x}.n_shingles, {y}.n_shingles) >= {percent} * greatest({x}.n_shingles, {y}.n_shingles)"
    apart = " + ".join(f"bit_count({x}.{lane} ^ {y}.{lane})" for lane in _LANES)
    return f"{sizes} and {100 + percent} * ({apart}) <= {100 - percent} * ({x}.n_shingles + {y}.n_shingles)"


def _between(held: DataFrame, percent: int) -> DataFrame:
    """Near pairs (a, b) of rows (key, id, root, lanes) that share a key and are in different components."""
    x, y = held.alias("x"), held.alias("y")
    return x.join(y, F.expr(f"x.key = y.key and x.id < y.id and x.root <> y.root and {_near('x', 'y', percent)}")).selectExpr("x.id a", "y.id b")


def _between_blocks(held: DataFrame, percent: int, work: Scratch) -> DataFrame:
    """The pairs of `_between`, for keys of any number of documents.

    A pair meets in the higher of its two size bands. There the documents of the largest component (the main one) and the
    others are dealt in blocks, and each two blocks, but for two main ones, meet in a cell of their own.
    """
    width = max(math.log(100 / percent), 1e-6) * (1 + 1e-9)
    banded = held.withColumn("band", F.floor(F.log("n_shingles") / width)).withColumn("meet", F.explode(F.expr("array(band, band + 1)")))
    sizes = banded.groupBy("key", "meet", "root").agg(F.count("*").alias("c")).groupBy("key", "meet")
    sizes = sizes.agg(F.max_by("root", "c").alias("main"), F.max("c").alias("m"), F.sum("c").alias("n"), F.count("*").alias("roots")).where("roots > 1")
    blocks = work.written(sizes.select("key", "meet", "main", F.expr(f"ceil(m / {LARGE})").alias("mains"), F.expr(f"ceil((n - m) / {LARGE})").alias("rests")), "near-dup-sizes")
    own = "if(root = main, -1 - pmod(xxhash64(id), mains), pmod(xxhash64(id), rests))"
    dealt = banded.join(blocks, ["key", "meet"]).withColumn("own", F.expr(own))
    dealt = dealt.withColumn("other", F.explode(F.expr("if(own < 0, sequence(0L, rests - 1), sequence(-mains, rests - 1))")))
    dealt = work.written(dealt.selectExpr("key", "meet", "band", "own", "least(own, other) low", "greatest(own, other) high", "id", "root", "n_shingles", *_LANES), "near-dup-blocks")
    x, y = dealt.where("own = low").alias("x"), dealt.where("own = high").alias("y")
    cell = "x.key = y.key and x.meet = y.meet and x.low = y.low and x.high = y.high"
    near = f"x.root <> y.root and (x.low < x.high or x.id < y.id) and greatest(x.band, y.band) = x.meet and {_near('x', 'y', percent)}"
    return x.join(y, F.expr(f"{cell} and {near}")).selectExpr("least(x.id, y.id) a", "greatest(x.id, y.id) b")


def _links(rows: DataFrame, docs: DataFrame, words: int, percent: int, work: Scratch) -> DataFrame:
    """(node, root) over the rows that stand for their sets; rows: (id, keys, n_shingles, lanes); docs: (node, doc_id, text).

    What is aggregated by key is written before it is joined, so that Spark may split the join of a hot key.
    """
    lanes = rows.select("id", "n_shingles", *_LANES)
    keyed = rows.select("id", F.explode("keys").alias("key"))
    hubs = work.written(keyed.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("n")).where("n > 1"), "near-dup-keys")
    shared = work.written(keyed.join(hubs, "key").select("key", "id", "hub", "n"), "near-dup-shared")
    stars = shared.where("id <> hub").selectExpr("hub a", "id b").distinct()
    stars = stars.join(lanes.alias("x"), F.expr("a = x.id")).join(lanes.alias("y"), F.expr("b = y.id")).where(_near("x", "y", percent)).select("a", "b")
    first = work.written(stars, "near-dup-stars")
    links = work.written(confirmed(first, docs, words, percent, work), "near-dup-links")
    # a first merge by one step: linked rows take the smallest hub that they are linked to
    roots = work.written(links.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("root")), "near-dup-hubs")
    held = shared.join(roots, "id", "left").select("key", "id", "n", F.coalesce("root", "id").alias("root"))
    held = work.written(held, "near-dup-held")
    several = work.written(held.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key"), "near-dup-several")
    held = work.written(held.join(several, "key").join(lanes, "id"), "near-dup-open")
    small = held.where(F.col("n") <= LARGE).select("key", "id", "root", "n_shingles", *_LANES)
    large = held.where(F.col("n") > LARGE).select("key", "id", "root", "n_shingles", *_LANES)
    second = _between(small, percent).unionByName(_between_blocks(large, percent, work)).distinct().join(first, ["a", "b"], "left_anti")
    second = work.written(second, "near-dup-rest")
    if not second.isEmpty():
        links = links.unionByName(work.written(confirmed(second, docs, words, percent, work), "near-dup-links"))
    return components(links, work)


def _grouped(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Per row of (node, doc_id, text): node, doc_id, n_shingles, root (of its group), low (the group's smallest doc_id), written.

    root and low are null for rows without shingles or doc_id.
    """
    with Scratch(docs.sparkSession) as work:
        seen = work.written(features(docs, words), "near-dup-features")
        linked = seen.where("n_shingles > 0 and doc_id is not null")
        leaders = linked.groupBy("digest").agg(F.min(F.struct("doc_id", "node")).alias("first")).select("digest", "first.*")
        shared = linked.groupBy("doc_id").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("doc_id", F.lit(True).alias("shared"))
        leaders = leaders.join(shared, "doc_id", "left").withColumn("id", F.when(F.col("shared"), F.col("node")).otherwise(F.col("doc_id")))
        leaders = work.written(leaders.drop("shared"), "near-dup-leaders")
        rows = linked.join(leaders.select("digest", "node", "id"), ["digest", "node"]).dropDuplicates(["digest", "node"])
        rows = work.written(rows.select("id", "keys", "n_shingles", *_LANES), "near-dup-rows")
        roots = work.written(_links(rows, docs, words, percent, work), "near-dup-roots")
        named = leaders.join(roots.withColumnRenamed("node", "id"), "id", "left")
        named = work.written(named.select("digest", "doc_id", F.coalesce("root", "id").alias("root")), "near-dup-named")
        lows = named.groupBy("root").agg(F.min("doc_id").alias("low"))
        named = work.written(named.join(lows, "root").select("digest", "root", "low"), "near-dup-groups")
        out = seen.select("node", "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest"))
        return written(out.join(named, "digest", "left").drop("digest"), "near-dup")


def _nodes(docs: DataFrame) -> DataFrame:
    return ids_and_text(docs).select(F.xxhash64("doc_id", "text").alias("node"), "doc_id", "text")


def groups(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (the smallest doc_id reachable), kept.

    Null, empty and blank texts have no shingles and are linked with nothing. Rows with equal sets are linked. Rows that
    share a doc_id are each judged by their own text. A null doc_id takes part in no link and is kept.
    """
    low = F.coalesce("low", "doc_id")
    return _grouped(_nodes(docs), words, percent).select(
        "doc_id", "n_shingles", low.alias("component_id"), (F.col("doc_id").isNull() | (F.col("doc_id") == low)).alias("kept")
    )


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group (the smallest doc_id's), under all columns; rows without shingles or doc_id all stay."""
    name = unused(docs, "node")
    own = docs.withColumn(name, F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    seen = _grouped(_nodes(docs), words, percent).where("root is not null")
    with Scratch(docs.sparkSession) as work:
        kept = seen.groupBy("root").agg(F.min(F.struct("doc_id", "node")).alias("first")).select("root", F.col("first.node").alias("first"))
        kept = work.written(kept, "near-dup-kept")
        rows = seen.groupBy("node", "root").agg(F.count("*").alias("n"))
        told = rows.join(kept, "root").select(F.col("node").alias(name), (F.col("node") == F.col("first")).alias("is_first"), "n")
        told = written(told.where("not is_first or n > 1"), "near-dup-told")
    gone = told.where("not is_first").select(name)
    again = told.where("is_first").select(name)
    out = own.join(gone, name, "left_anti")
    if again.isEmpty():
        return out.drop(name)
    # the few rows that stand in docs several times: one of them stays
    return out.join(again, name, "left_anti").unionByName(own.join(again, name, "left_semi").dropDuplicates([name])).drop(name)


def op3_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles, similarity 0.85, whole texts."""
    return groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=3, percent=85)
