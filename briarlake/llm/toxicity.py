"""Toxicity: Levenshtein automata run over a lexicon trie, with context windows around each hit.

The lexicon (words and word stems) is learned from labelled texts. Each distinct token of a slice is matched once: stems
and words exactly, then both with spelling errors, by walking the trie together with the token's Levenshtein automaton
and leaving every branch whose states are all dead; a stem takes any token that has it, but for errors, at its start. An
entry's length sets its errors. A token that clean labelled texts use is no misspelling.
Each hit is weighed in its window: what stands between an opening and a closing quotation mark, however far apart, counts
apart, and the words around it add the log ratio with which they stand near hits of toxic texts and in clean ones. A small logistic model joins the text's hits to a score.

At most `PER_CLASS` labelled texts of either class are learned from; every whole text is scored. Null and empty texts have
no hits: their score is the model's for none. Without labels of both classes every score is the share of label 1.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from briarlake.llm._arrow import ALNUM, LOWER, Words, frugal, mix, slices, text_bytes, word_hashes
from briarlake.llm._labels import fold, labelled
from briarlake.llm._store import ids_and_text

PER_CLASS = 2500
#: A lexicon entry stands in so many toxic sample texts at least.
SUPPORT = 3
#: A text uses a stem that makes up this share of its tokens; clean texts that use an entry are at most this share of toxic ones.
RATE, PURITY = 0.01, 0.04
#: Stems have so many letters, entries that may have an error so many at least: one of two letters has no part left.
STEM, FUZZY = (4, 7), 3
#: Words this long may have two errors.
TWO_ERRORS = 9
#: Tokens on each side of a hit that are its context.
CONTEXT = 4
#: Distinct tokens that a worker remembers.
CACHE = 200_000
_BUCKETS = 4096
#: Tokens added to both sides of a context ratio, and tokens of clean background added to the windows of clean hits.
SHRINK, BACKGROUND = 2.0, 200.0
_N = 7
SCHEMA = "doc_id long, held_out boolean, score double, predicted int, n_hits int, n_quoted int, n_misspelled int"
#: Straight, raised, low and pointed quotation marks, single pointed ones included.
_QUOTES = re.compile('["\u201c\u201d\u201e\u00ab\u00bb\u2039\u203a]')


class Automaton:
    """The Levenshtein automaton of a word: bit i of states[e] is set where i letters are read at e errors."""

    def __init__(self, word: str, errors: int):
        self.n, self.errors = len(word), errors
        self.masks: dict[str, int] = {}
        for i, c in enumerate(word):
            self.masks[c] = self.masks.get(c, 0) | 1 << i
        self.all = (1 << (self.n + 1)) - 1

    def start(self) -> tuple[int, ...]:
        return tuple((1 << (e + 1)) - 1 & self.all for e in range(self.errors + 1))

    def step(self, states: tuple[int, ...], c: str) -> tuple[int, ...]:
        mask, out = self.masks.get(c, 0), []
        for e, s in enumerate(states):
            now = (s & mask) << 1
            if e:
                low = states[e - 1]
                now |= low | low << 1 | out[e - 1] << 1
            out.append(now & self.all)
        return tuple(out)

    def errors_at_end(self, states: tuple[int, ...]) -> int | None:
        return next((e for e, s in enumerate(states) if s >> self.n & 1), None)


def trie(words: dict[str, int]) -> dict:
    """The trie of words and, with a * at their end, stems."""
    root: dict = {}
    for w, i in words.items():
        node = root
        for c in w.removesuffix("*"):
            node = node.setdefault(c, {})
        node["*" if w.endswith("*") else ""] = i
    return root


def intersect(automaton: Automaton, root: dict, allowed: list[int] | None = None) -> tuple[int, int] | None:
    """(errors, entry) of the trie entry that the automaton takes with fewest errors, the first entry on ties.

    allowed: the most errors of each entry, where that is less than the automaton's.
    """
    best, todo = None, [(root, automaton.start())]
    while todo:
        node, states = todo.pop()
        for c, child in node.items():
            if c in ("", "*"):
                # a stem is read as soon as some first letters of the token are
                e = automaton.errors_at_end(states) if c == "" else next((e for e, s in enumerate(states) if s), None)
                if e is not None and (allowed is None or e <= allowed[child]) and (best is None or (e, child) < best):
                    best = (e, child)
                continue
            after = automaton.step(states, c)
            if any(after):
                todo.append((child, after))
    return best


class Lexicon:
    """Entries by text; those that end in * are stems."""

    def __init__(self, entries: list[str], benign: set[str]):
        self.entries = entries
        self.words = {w: i for i, w in enumerate(entries) if not w.endswith("*")}
        self.stems = {w[:-1]: i for i, w in enumerate(entries) if w.endswith("*")}
        self.sizes = sorted({len(s) for s in self.stems})
        self.allowed = [self._errors(len(w.removesuffix("*"))) for w in entries]
        fuzzy = {w: i for w, i in self.words.items() if self.allowed[i]}
        stems = {s: i for s, i in self.stems.items() if self.allowed[i]}
        self.root, self.benign = trie({**fuzzy, **{s + "*": i for s, i in stems.items()}}), benign
        # tokens of these lengths, or of the last one and more, may be near; with so few or more letters, by two errors
        self.lengths = {n + d for w in fuzzy for n in [len(w)] for d in range(-self._errors(n), self._errors(n) + 1)}
        self.longer = min((len(s) - self._errors(len(s)) for s in stems), default=1 << 30)
        self.two = min((len(w) - 2 for w in [*fuzzy, *stems] if self._errors(len(w)) == 2), default=1 << 30)
        # of an entry with e errors, one of e + 1 parts is intact
        one = [w for w in [*fuzzy, *stems] if self._errors(len(w)) == 1]
        self.heads = {w[: len(w) // 2] for w in one}
        self.tails = {w[len(w) // 2 :] for w in fuzzy if self._errors(len(w)) == 1}
        parts = {w[k * len(w) // 3 : (k + 1) * len(w) // 3] for w in [*fuzzy, *stems] if self._errors(len(w)) == 2 for k in range(3)}
        parts |= {s[len(s) // 2 :] for s in stems if self._errors(len(s)) == 1}
        self.part = re.compile("|".join(map(re.escape, sorted(parts)))) if parts else None
        self.head_sizes, self.tail_sizes = sorted({len(x) for x in self.heads}), sorted({len(x) for x in self.tails})

    @staticmethod
    def _errors(n: int) -> int:
        return 2 if n >= TWO_ERRORS else int(n >= FUZZY)

    def _near(self, token: str) -> bool:
        return (
            any(token[:k] in self.heads for k in self.head_sizes)
            or any(token[-k:] in self.tails for k in self.tail_sizes)
            or (self.part is not None and self.part.search(token) is not None)
        )

    def match(self, token: str) -> tuple[int, int]:
        """(entry, errors) of a lower-case token; entry is -1 if it has none."""
        if token in self.words:
            return self.words[token], 0
        for k in self.sizes:
            if token[:k] in self.stems:
                return self.stems[token[:k]], 0
        n = len(token)
        if (n in self.lengths or n >= self.longer) and token not in self.benign and self._near(token):
            found = intersect(Automaton(token, 2 if n >= self.two else 1), self.root, self.allowed)
            if found:
                return found[1], found[0]
        return -1, 0


def _without_marks(raw: np.ndarray) -> np.ndarray:
    """The bytes with wide quotation marks, dashes and blanks (U+2000 to U+206F, guillemets, U+00A0) as spaces."""
    out = raw.copy()
    wide = np.flatnonzero((raw[:-2] == 0xE2) & ((raw[1:-1] == 0x80) | (raw[1:-1] == 0x81))) if len(raw) > 2 else np.zeros(0, np.int64)
    two = np.flatnonzero((raw[:-1] == 0xC2) & np.isin(raw[1:], (0xA0, 0xAB, 0xBB))) if len(raw) > 1 else np.zeros(0, np.int64)
    for at in (wide, wide + 1, wide + 2, two, two + 1):
        out[at] = 32
    return out


def _tokens(batch: pa.RecordBatch):
    """Raw bytes, offsets, words, and the distinct tokens with each word's number among them."""
    raw, offsets = text_bytes(batch.column("text"))
    plain = _without_marks(raw)
    words = Words(plain, offsets, ALNUM, hashed=False)
    if not len(words.starts):
        return raw, offsets, words, [], np.zeros(0, np.int64)
    letters = LOWER[plain]
    wide = np.zeros(len(raw), bool)
    wide[1:] = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
    letters[wide] += 32
    letters = np.ascontiguousarray(letters[ALNUM[plain]])
    edges = np.concatenate([[0], np.cumsum(words.lengths)]).astype(np.int64)
    column = pa.Array.from_buffers(pa.large_binary(), len(words.starts), [None, pa.py_buffer(edges), pa.py_buffer(letters)])
    coded = column.dictionary_encode()
    return raw, offsets, words, coded.dictionary.to_pylist(), coded.indices.to_numpy()


def quotation_marks(text: str) -> tuple[list[int], list[bool]]:
    """Places of the quotation marks of a text, and which of them open.

    A mark behind a blank, bracket or the beginning opens if no blank follows; one behind anything else closes if a blank,
    punctuation or the end follows. Other marks open if the last one closes, and the reverse.
    """
    places, opens = [], []
    for m in _QUOTES.finditer(text):
        before, after = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
        led, ended = not before or before.isspace() or before in "([{", not after or not (after.isalnum() or after in "([{")
        places.append(m.start())
        opens.append(led if led != ended else not (opens and opens[-1]))
    return places, opens


def _buckets(tokens: list[bytes]) -> np.ndarray:
    sizes = np.array([len(t) for t in tokens], np.int64)
    return (word_hashes(np.frombuffer(b"".join(tokens), np.uint8), sizes) % np.uint64(_BUCKETS)).astype(np.int64) if len(sizes) else np.zeros(0, np.int64)


def _context_weights(toxic: np.ndarray, clean: np.ndarray, background: np.ndarray) -> np.ndarray:
    """Log ratios of context tokens near hits of toxic texts and of clean ones, at any sample size.

    Clean texts hardly have hits, so their windows are shrunk to all tokens of clean texts. A bucket with little evidence
    weighs about 0; one that clean texts use and toxic windows lack weighs less.
    """
    share = (clean + BACKGROUND * background / max(1.0, background.sum())) / (clean.sum() + BACKGROUND)
    return np.clip(np.log((toxic + SHRINK) / (toxic.sum() * share + SHRINK)), -1, 1)


def _byte_places(data: bytes, places: list[int]) -> list[int]:
    """Places in code points as places in UTF-8 bytes."""
    first = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
    return first[places].tolist() if places else []


class Model:
    def __init__(self, lexicon: Lexicon, strength: np.ndarray, near: np.ndarray, weight: np.ndarray):
        self.lexicon, self.strength, self.near, self.weight = lexicon, strength, near, weight
        self.known: dict[bytes, tuple[int, int]] = {}

    def __getstate__(self):
        return {**self.__dict__, "known": {}}

    def hits(self, batch: pa.RecordBatch):
        """Per hit: row, entry, errors, quoted, context buckets; per row: tokens."""
        raw, offsets, words, distinct, which = _tokens(batch)
        if len(self.known) > CACHE:
            self.known = {}
        known, match = self.known, self.lexicon.match
        for t in distinct:
            if t not in known:
                known[t] = match(t.decode("utf-8", "replace"))
        kinds = np.array([known[t] for t in distinct], np.int64).reshape(-1, 2)
        at = np.flatnonzero(kinds[which, 0] >= 0) if len(distinct) else np.zeros(0, np.int64)
        row = np.searchsorted(words.bounds, at, "right") - 1
        quoted = np.zeros(len(at), bool)
        buckets = []
        of = -1
        for i, (k, r) in enumerate(zip(at.tolist(), row.tolist(), strict=True)):
            if r != of:
                of, data = r, raw[offsets[r] : offsets[r + 1]].tobytes()
                places, opens = quotation_marks(data.decode())
                if not data.isascii():
                    places = _byte_places(data, places)
            last = bisect_left(places, int(words.starts[k] - offsets[r])) - 1
            quoted[i] = last >= 0 and opens[last] and last + 1 < len(opens) and not opens[last + 1]
            around = [*range(max(int(words.bounds[r]), k - CONTEXT), k), *range(k + 1, min(int(words.bounds[r + 1]), k + CONTEXT + 1))]
            buckets.append(_buckets([distinct[which[j]] for j in around]))
        return row, kinds[which[at], 0] if len(at) else at, kinds[which[at], 1] if len(at) else at, quoted, buckets, np.diff(words.bounds)

    def features(self, found, n: int) -> np.ndarray:
        """Per row: 1, strongest plain hit, plain hits, misspelled hits, quoted hits, mean context, hits in 100 tokens."""
        row, entry, errors, quoted, buckets, tokens = found
        out = np.zeros((n, _N))
        out[:, 0] = 1
        if len(row):
            context = np.array([self.near[b.astype(np.int64)].mean() if len(b) else 0.0 for b in buckets])
            plain = ~quoted & (errors == 0)
            np.maximum.at(out[:, 1], row[plain], np.clip(self.strength[entry[plain]], 0, None) / 4)
            out[:, 2] = np.log1p(np.bincount(row[plain], minlength=n))
            out[:, 3] = np.log1p(np.bincount(row[~quoted & (errors > 0)], minlength=n))
            out[:, 4] = np.log1p(np.bincount(row[quoted], minlength=n))
            out[:, 5] = np.bincount(row, context, n) / np.maximum(np.bincount(row, minlength=n), 1)
            out[:, 6] = np.minimum(np.bincount(row[~quoted], minlength=n) * 100 / np.maximum(tokens, 1), 4)
        return out

    def scores(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.weight, -35, 35)))


def _stems(token: str) -> list[str]:
    """The stems of a token: some first letters, with more to follow."""
    return [token[:k] + "*" for k in range(STEM[0], min(STEM[1], len(token) - 1) + 1)]


def _minima(distinct: list[bytes], which: np.ndarray, bounds: np.ndarray) -> list[tuple]:
    """Six minima of hashed pairs of neighbouring tokens, of each text; fewer than two tokens give themselves."""
    sizes = np.array([len(t) for t in distinct], np.int64)
    h = word_hashes(np.frombuffer(b"".join(distinct), np.uint8), sizes)[which] if len(distinct) else np.zeros(0, np.uint64)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        pairs = h[a : b - 1] * np.uint64(0x9E3779B97F4A7C15) + h[a + 1 : b] if b - a > 1 else h[a:b]
        out.append(tuple(int((mix(pairs) * np.uint64(2 * k + 0x9E3779B97F4A7C15)).min()) for k in range(6)) if len(pairs) else ())
    return out


def _first_of_copies(minima: list[tuple]) -> list[bool]:
    """False for texts that are nearly an earlier one: two minima that stand together agree."""
    seen, out = set(), []
    for low in minima:
        pairs = {(k, low[k], low[k + 1]) for k in (0, 2, 4)} if low else set()
        out.append(not pairs & seen)
        seen |= pairs
    return out


def _learn_entries(texts: list[Counter], minima: list[tuple], y: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Words and stems that toxic texts use often and clean ones hardly do, with their log ratios.

    A text uses a word that it holds, and a stem that makes up `RATE` of its tokens at least: one chance word with that stem
    in a long clean text is no use. Of copies one counts. Of nested candidates with about the same texts the longest stands
    for all; else the shortest. Rare candidates count only in toxic texts that no common one explains.
    """

    def used(counts: Counter) -> set[str]:
        stems: Counter = Counter()
        for t, n in counts.items():
            for stem in _stems(t):
                stems[stem] += n
        least = RATE * counts.total()
        return {*counts, *(w for w, n in stems.items() if n >= least)}

    own = [i for i, fresh in enumerate(_first_of_copies(minima)) if fresh]
    sets, y = [used(texts[i]) for i in own], y[own]
    toxic, clean = Counter(), Counter()
    for s, label in zip(sets, y.tolist(), strict=True):
        (toxic if label else clean).update(s)
    n1, n0 = max(1, int(y.sum())), max(1, int((1 - y).sum()))
    good = {w for w in toxic if toxic[w] >= SUPPORT and clean[w] / n0 <= PURITY * toxic[w] / n1}
    strong = {w for w in good if toxic[w] >= max(SUPPORT, 0.02 * n1)}
    again = Counter(w for s, label in zip(sets, y.tolist(), strict=True) if label and not s & strong for w in s)
    good = strong | {w for w in good if again[w] >= max(SUPPORT, 0.01 * n1)}
    above = lambda w: _stems(w) if not w.endswith("*") else [x for x in _stems(w[:-1])]
    longer: Counter = Counter()
    for w in good:
        for stem in above(w):
            longer[stem] = max(longer[stem], toxic[w])
    good = {w for w in good if longer[w] < 0.9 * toxic[w]}
    entries = sorted((w for w in good if not any(x in good for x in above(w))), key=lambda w: (-toxic[w], w))
    strength = [np.log((toxic[w] + 0.5) / (n1 + 1)) - np.log((clean[w] + 0.5) / (n0 + 1)) for w in entries]
    return entries, np.array(strength)


def _logistic(x: np.ndarray, y: np.ndarray, cost: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Newton's method for the weights, held near `prior` by an L2 term."""
    w, hold = prior.copy(), np.array([1e-3] + [1.0] * (x.shape[1] - 1))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        g = x.T @ (cost * (p - y)) + hold * (w - prior)
        h = (x * (cost * p * (1 - p))[:, None]).T @ x + np.diag(hold + 1e-6)
        step = np.linalg.solve(h, g)
        w = w - np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-7:
            break
    return w


def fit(texts: list[str], labels: list[int], share: float) -> Model:
    y = np.array(labels, np.float64)
    share = min(max(share, 1e-4), 1 - 1e-4)
    base = float(np.log(share / (1 - share)))
    nothing = Model(Lexicon([], set()), np.zeros(0), np.zeros(_BUCKETS), np.array([base] + [0.0] * (_N - 1)))
    if len(set(labels)) < 2:
        return nothing
    table = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    parts = list(slices([table], "text"))
    counted: list[Counter] = []
    minima: list[tuple] = []
    for part in parts:
        _, _, words, distinct, which = _tokens(part)
        names = [t.decode("utf-8", "replace") for t in distinct]
        minima += _minima(distinct, which, words.bounds)
        counted += [Counter(names[j] for j in which[a:b].tolist()) for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True)]
    entries, strength = _learn_entries(counted, minima, y)
    benign = {t for c, label in zip(counted, y.tolist(), strict=True) if not label for t in c}
    lexicon = Lexicon(entries, set())
    # only such clean tokens as come near an entry need to be remembered
    lexicon.benign = {t for t in benign if lexicon.match(t)[0] >= 0 and t not in lexicon.words}
    model = Model(lexicon, strength, np.zeros(_BUCKETS), nothing.weight)
    found, begin = [], 0
    counts, clean = np.zeros((2, _BUCKETS)), np.zeros(_BUCKETS)
    for part in parts:
        f = model.hits(part)
        found.append((f, part.num_rows))
        for r, b in zip(f[0].tolist(), f[4], strict=True):
            np.add.at(counts[int(y[begin + r])], b.astype(np.int64), 1)
        begin += part.num_rows
    for c, label in zip(counted, y.tolist(), strict=True):
        if not label:
            np.add.at(clean, _buckets([t.encode() for t in c]), list(c.values()))
    model.near = _context_weights(counts[1], counts[0], clean)
    x = np.concatenate([model.features(f, n) for f, n in found])
    sample = y.mean()
    cost = np.where(y > 0, share / sample, (1 - share) / (1 - sample))
    model.weight = _logistic(x, y, cost, np.array([base, 1.0, 0.5, 0.5, 0.0, 0.5, 2.0]))
    return model


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Fits on labelled rows whose crc32(doc_id) mod 5 is not 0."""
    sample, share = labelled(docs, labels, "toxic", fold(5) != 0, per_class)
    return fit([t for t, _ in sample], [y for _, y in sample], share)


def score(docs: DataFrame, model: Model) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in slices(batches, "text"):
            n = batch.num_rows
            f = m.hits(batch)
            s = m.scores(m.features(f, n))
            counts = [np.bincount(f[0][k], minlength=n).astype(np.int32) for k in (np.ones(len(f[0]), bool), f[3], f[2] > 0)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), *map(pa.array, counts)],
                ["doc_id", "held_out", "score", "predicted", "n_hits", "n_quoted", "n_misspelled"],
            )

    own = ids_and_text(docs)
    return own.select("doc_id", "text", (fold(5) == 0).alias("held_out")).mapInArrow(frugal(run), SCHEMA)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
