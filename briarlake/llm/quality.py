"""Quality classifier: a linear support-vector machine on naive-Bayes-scaled n-gram indicators.

N-grams are of two kinds: byte trigrams (hashed), and uni- and bigrams of word shapes (case, marks, digits, and whether a
word repeats the one before it). A shape n-gram has one indicator per level of its share in the text, so that a text which
is all of a kind differs from one that holds a little of it. Indicators are scaled by the log of the ratio of their
smoothed class probabilities, rows to unit length, and a hinge-loss model is fitted by dual coordinate descent. A logistic
curve on margins of texts left out of the fit turns margins into probabilities, with the class share of all labels.

Fitting uses at most `PER_CLASS` labelled texts of either class; scoring uses every whole text. Null and empty texts have
no n-grams: their margin is the bias. Without labels of both classes every score is that of the share alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from briarlake.llm._arrow import NOT_BLANK, Words, frugal, slices, text_bytes
from briarlake.llm._labels import fold, labelled
from briarlake.llm._store import ids_and_text

PER_CLASS = 2000
CUT = 0.7
GRAM_BITS = 15
LEVELS = (0.0, 0.02, 0.1, 0.4)
SHAPES = 80
_GRAMS = 1 << GRAM_BITS
_SHAPE_GRAMS = SHAPES + SHAPES * SHAPES
SIZE = _GRAMS + _SHAPE_GRAMS * len(LEVELS)
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"

_KIND = np.zeros((5, 256), np.int64)  # upper, lower, digit, symbol, exclamation
_KIND[0, 65:91] = _KIND[1, 97:123] = _KIND[2, 48:58] = 1
for _c in b"#$%&*|<>=+@^~_/\\[]{}":
    _KIND[3, _c] = 1
_KIND[4, [33, 63]] = 1


def _shapes(raw: np.ndarray, words: Words) -> np.ndarray:
    """The shape, below SHAPES, of every word."""
    edges = np.append(words.starts, len(raw))
    upper, lower, digit, symbol, shout = (np.add.reduceat(k[raw], edges[:-1]) for k in _KIND)
    before = np.concatenate([[0], raw[:-1]])
    accent = ((before == 0xC3) & (raw >= 0x80)).astype(np.int64)
    upper = upper + np.add.reduceat(accent * (raw < 0x9F), edges[:-1])
    lower = lower + np.add.reduceat(accent * (raw >= 0x9F), edges[:-1])
    head = raw[words.starts]
    led = ((head >= 65) & (head <= 90)) | (head == 0xC3)
    case = np.select([upper + lower == 0, lower == 0, upper == 0, led & (upper == 1)], [0, 1, 2, 3], 4)
    case[(case == 1) & (upper == 1)] = 3
    same = np.zeros(len(words.hash), bool)
    same[1:] = words.hash[1:] == words.hash[:-1]
    first = words.bounds[:-1]
    same[first[first < len(same)]] = False
    return (((case * 2 + (symbol > 0)) * 2 + (shout > 0)) * 2 + (digit > 0)) * 2 + same


def _distinct(keys: np.ndarray, n: int) -> np.ndarray:
    """The distinct keys (row, hash), sorted: by marks where these take no more room than the keys, else by sorting."""
    if n * _GRAMS > 8 * len(keys):
        return np.unique(keys)
    flags = np.zeros(n * _GRAMS, bool)
    flags[keys] = True
    return np.flatnonzero(flags)


def grams(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(row, indicator) of every indicator that holds, ordered by row and indicator, each once."""
    raw, offsets = text_bytes(batch.column("text"))
    n = batch.num_rows
    found = []
    if len(raw) >= 3:
        wide = raw.astype(np.uint32)
        hashed = ((wide[:-2] * np.uint32(0x9E3779B1) + wide[1:-1] * np.uint32(0x85EBCA6B) + wide[2:] * np.uint32(0xC2B2AE35)) >> np.uint32(32 - GRAM_BITS)).astype(np.int64)
        row = np.repeat(np.arange(n), np.diff(offsets))[:-2]
        whole = np.arange(len(hashed)) + 3 <= offsets[1:][row]
        at = _distinct((row << GRAM_BITS | hashed)[whole], n)
        found.append((at >> GRAM_BITS) * SIZE + (at & (_GRAMS - 1)))
    words = Words(raw, offsets, NOT_BLANK)
    if len(words.starts):
        shape, counts = _shapes(raw, words), np.diff(words.bounds)
        row = np.repeat(np.arange(n), counts)
        pair = np.flatnonzero(row[1:] == row[:-1])
        keys = np.concatenate([row * _SHAPE_GRAMS + shape, row[pair] * _SHAPE_GRAMS + SHAPES + shape[pair] * SHAPES + shape[pair + 1]])
        keys, times = np.unique(keys, return_counts=True)
        row, gram = keys // _SHAPE_GRAMS, keys % _SHAPE_GRAMS
        share = times / counts[row]
        for k, level in enumerate(LEVELS):
            at = share > level
            found.append(row[at] * SIZE + _GRAMS + gram[at] * len(LEVELS) + k)
    keys = np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return keys // SIZE, keys % SIZE


def dual_coordinate_descent(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, c: np.ndarray, rounds: int = 30, tolerance: float = 1e-3) -> np.ndarray:
    """Weights of the L2-regularised hinge-loss model (no bias term of its own); rows: (columns, values); y: +1 or -1; c: cost of each row."""
    w, alpha, rng = np.zeros(size), np.zeros(len(rows)), np.random.default_rng(7)
    norm = np.array([v @ v for _, v in rows])
    for _ in range(rounds):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            if norm[i] == 0:
                continue
            at, v = rows[i]
            slope = y[i] * (w[at] @ v) - 1
            bounded = min(slope, 0) if alpha[i] == 0 else max(slope, 0) if alpha[i] >= c[i] else slope
            worst = max(worst, abs(bounded))
            if bounded:
                new = min(max(alpha[i] - slope / norm[i], 0.0), c[i])
                w[at] += (new - alpha[i]) * y[i] * v
                alpha[i] = new
        if worst < tolerance:
            break
    return w


def _curve(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve, by Newton steps towards smoothed targets."""
    pos, neg = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -35, 35)))
        g = np.array([((p - t) * margin).sum() + 1e-3 * (a - 1), (p - t).sum()])
        s = p * (1 - p)
        h = np.array([[(s * margin * margin).sum() + 1e-2, (s * margin).sum()], [(s * margin).sum(), s.sum() + 1e-2]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
        if np.abs(step).max() < 1e-7:
            break
    return max(float(a), 1e-3), float(b)


class Model:
    """weights (already times the ratios), ratios (for the row length), bias, curve."""

    def __init__(self, ratio: np.ndarray, weight: np.ndarray, bias: float, slope: float, offset: float):
        self.ratio2, self.weight = (ratio**2).astype(np.float32), (ratio * weight).astype(np.float32)
        self.bias, self.slope, self.offset = bias, slope, offset

    def margins(self, row: np.ndarray, gram: np.ndarray, n: int) -> np.ndarray:
        total, length = np.bincount(row, self.weight[gram], n), np.bincount(row, self.ratio2[gram], n)
        return total / np.sqrt(np.maximum(length, 1e-12)) + self.bias

    def scores(self, row: np.ndarray, gram: np.ndarray, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(row, gram, n) + self.offset, -35, 35)))


def fit(texts: list[str], labels: list[int], share: float) -> Model:
    y = np.where(np.array(labels) > 0, 1.0, -1.0)
    share = min(max(share, 1e-4), 1 - 1e-4)
    prior = float(np.log(share / (1 - share)))
    if len(set(labels)) < 2:
        return Model(np.zeros(SIZE), np.zeros(SIZE), 0.0, 1.0, prior)
    rows: list[np.ndarray] = []
    table = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    for part in slices([table], "text"):
        row, gram = grams(part)
        rows += np.split(gram, np.searchsorted(row, np.arange(1, part.num_rows)))

    def learn(use: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        p, q = np.ones(SIZE), np.ones(SIZE)
        for i in use:
            (p if y[i] > 0 else q)[rows[i]] += 1
        ratio = np.log(p / p.sum() / (q / q.sum()))
        scaled = []
        for i in use:
            v = ratio[rows[i]]
            scaled.append((np.append(rows[i], SIZE), np.append(v / max(np.sqrt(v @ v), 1e-6), 1.0)))
        cost = np.where(y[use] > 0, len(use) / (2 * max(1, (y[use] > 0).sum())), len(use) / (2 * max(1, (y[use] < 0).sum())))
        w = dual_coordinate_descent(scaled, y[use], SIZE + 1, cost)
        return ratio, w[:-1], float(w[-1])

    order = np.random.default_rng(11).permutation(len(y))
    margin = np.zeros(len(y))
    for k in range(3):
        test = order[k::3]
        ratio, w, bias = learn(np.setdiff1d(order, test))
        m = Model(ratio, w, bias, 1.0, 0.0)
        for i in test:
            margin[i] = m.margins(np.zeros(len(rows[i]), np.int64), rows[i], 1)[0]
    slope, offset = _curve(margin, y)
    ratio, w, bias = learn(np.arange(len(y)))
    # the sample's classes are taken evenly; the share of all labels moves the curve back
    sample = (y > 0).mean()
    return Model(ratio, w, bias, slope, offset + prior - float(np.log(sample / (1 - sample))))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Fits on labelled rows whose crc32(doc_id) mod 4 is not 2."""
    sample, share = labelled(docs, labels, "quality", fold(4) != 2, per_class)
    return fit([t for t, _ in sample], [y for _, y in sample], share)


def score(docs: DataFrame, model: Model) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in slices(batches, "text"):
            s = shared.value.scores(*grams(batch), batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= CUT).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"]
            )

    own = ids_and_text(docs)
    return own.select("doc_id", "text", (fold(4) == 2).alias("held_out")).mapInArrow(frugal(run), SCHEMA)


def accepted(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """docs without those that score below cut; one pass, all columns stay."""
    shared, schema = docs.sparkSession.sparkContext.broadcast(model), docs.schema

    def run(batches):
        for batch in slices(batches, "text"):
            yield batch.filter(pa.array(shared.value.scores(*grams(batch), batch.num_rows) >= cut))

    return docs.mapInArrow(frugal(run), schema)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
