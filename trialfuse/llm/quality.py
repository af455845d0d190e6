"""Weak-label quality classifier: labellers, expectation-maximisation, hashed linear scorer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_NAMES, RID, SPACES, chunks_of_docs, joined, map_arrow, mix, settle, utf8, with_row_ids, word_names

#: Rows that the scorer is fitted on (about; twice as many at most), the largest features of each, and the hashed features.
SAMPLE_ROWS = 6000
SAMPLE_FEATURES = 2048
FEATURE_BITS = 18
FAMILIES = 3
CHUNK = 1 << 20
LABELLERS = ("capitals", "symbols", "ragged_ends", "word_length", "variety", "line_repeats", "bars", "digits", "stutter")

_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1
_LETTER = _UPPER.copy()
_LETTER[97:123] = 1
_LETTER[0xC0:] = 1  # one for each letter of two bytes
_DIGIT = np.zeros(256, np.int64)
_DIGIT[48:58] = 1
_BAR = np.zeros(256, np.int64)
_BAR[ord("|")] = 1
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[[ord(c) for c in "!#$%&*+<=>@[]^_`{|}~\\/"]] = 1
#: First bytes of letters of three and more bytes, whose scripts part words without spaces or in other ways.
_WIDE = np.zeros(256, np.int64)
_WIDE[[0xE0, 0xE1, *range(0xE3, 0xF0)]] = 1
_PLAIN_END = np.ones(256, bool)
_PLAIN_END[[ord(c) for c in "!#$%&*+<=>@[]^_`{|}~\\/"]] = False
#: Shapes: what kind of character stands where.
_SHAPES = BYTE_NAMES.copy()
_SHAPES[65:91] = BYTE_NAMES[65]
_SHAPES[97:123] = BYTE_NAMES[97]
_SHAPES[48:58] = BYTE_NAMES[48]
_SHAPES[128:] = BYTE_NAMES[200]


def _sums(table: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(table[data])]
    return total[offsets[1:]] - total[offsets[:-1]]


def _distinct(doc: np.ndarray, names: np.ndarray, n: int) -> np.ndarray:
    """Distinct names of each document."""
    _, at = np.unique(mix(names, doc.astype(np.uint64)), return_index=True)
    return np.bincount(doc[at], minlength=n)[:n]


class Chunk:
    """Words of some documents, parted where documents meet."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(offsets) - 1
        sizes = np.diff(offsets)
        spaced = np.full(int(sizes.sum()) + n, 0x20, np.uint8)
        self.first = offsets[:-1] - offsets[0] + np.arange(n)
        spaced[np.arange(int(sizes.sum())) + np.repeat(np.arange(n), sizes)] = data[offsets[0] : offsets[-1]]
        self.data, self.sizes, self.n = spaced, sizes, n
        self.edges = np.r_[self.first, len(spaced)]
        self.names, self.start, self.end = word_names(spaced)
        self.doc = np.searchsorted(self.first, self.start, side="right") - 1
        self.words = np.bincount(self.doc, minlength=n)[:n] if n else np.zeros(0, np.int64)

    def again(self) -> np.ndarray:
        """Whether a word is the one before it."""
        return np.r_[False, (self.names[1:] == self.names[:-1]) & (self.doc[1:] == self.doc[:-1])][: len(self.doc)]

    def votes(self) -> np.ndarray:
        """(documents, labellers): 1 for good text, -1 for junk, 0 for no opinion."""
        n, words = self.n, np.maximum(self.words, 1)
        upper, letters, digits, bars, symbols = (_sums(t, self.data, self.edges) for t in (_UPPER, _LETTER, _DIGIT, _BAR, _SYMBOL))
        size = np.maximum(self.sizes, 1)
        ends = np.bincount(self.doc, ~_PLAIN_END[self.data[self.end - 1]], n)[:n] / words
        length = letters / words
        variety = _distinct(self.doc, self.names, n) / np.sqrt(words)
        line = self.data.copy()
        line[SPACES[line]] = ord("_")
        line[(self.data == 10)] = 0x20
        if n:
            line[self.edges[1:] - 1] = 0x20
        names, start, _ = word_names(line)
        own = np.searchsorted(self.first, start, side="right") - 1
        lines = np.bincount(own, minlength=n)[:n]
        distinct = _distinct(own, names, n) / np.maximum(lines, 1)
        share = upper / np.maximum(letters, 1)

        no = np.zeros(n, bool)  # the labeller knows junk only

        def vote(value, good, bad, know=True):
            return np.where(bad, -1, np.where(good, 1, 0)) * know

        spaced = _sums(_WIDE, self.data, self.edges) * 10 < size  # words are what spaces part
        some = self.words >= 5
        stutter = np.bincount(self.doc[self.again()], minlength=n)[:n] / words
        return np.stack(
            [
                vote(share, no, share > 0.5, letters >= 10),
                vote(symbols, no, symbols / size > 0.06, size >= 20),
                vote(ends, no, ends > 0.3, some),
                vote(length, (length >= 3) & (length <= 9), (length < 2) | (length > 14), some & spaced),
                vote(variety, variety > 5, variety < 3, (self.words >= 60) & spaced),
                vote(distinct, distinct > 0.9, distinct < 0.6, lines >= 4),
                vote(bars, no, bars / words > 0.2, some),
                vote(digits, no, digits / size > 0.4, size >= 20),
                vote(stutter, no, stutter > 0.3, some),
            ],
            axis=1,
        ).astype(np.int8)

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """(document, feature): a word's shape, the shape with its first bytes, and whether the word is repeated at once."""
        shape, _, _ = word_names(self.data, _SHAPES)
        head = self.data[self.start].astype(np.uint64) | self.data[np.minimum(self.start + 1, len(self.data) - 1)].astype(np.uint64) << np.uint64(8)
        both = (shape ^ (head * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xC2B2AE3D27D4EB4F)
        bits = np.uint64(64 - FEATURE_BITS)
        same = np.where(self.again(), BYTE_NAMES[1], BYTE_NAMES[2])
        return np.concatenate([self.doc] * FAMILIES), np.concatenate([shape >> bits, both >> bits, same >> bits]).astype(np.int64)


def label_votes(docs: DataFrame) -> DataFrame:
    """(_rid, doc_id, pattern): votes as text of + - 0."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = utf8(b.column(2))
            out = []
            for i, j in chunks_of_docs(offsets, CHUNK):
                v = Chunk(data, offsets[i : j + 1]).votes()
                out += [bytes(x).decode() for x in np.array([48, 43, 45], np.uint8)[v]]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], names=[RID, "doc_id", "pattern"])

    return map_arrow(docs.select(RID, "doc_id", "text"), fn, f"{RID} long, doc_id long, pattern string")


def fit_labellers(patterns: dict[str, int], rounds: int = 200) -> tuple[np.ndarray, float, dict[str, float]]:
    """Expectation-maximisation over vote patterns and their counts.

    (rates, prior, posterior of good): rates[class, labeller, vote] for the
    classes junk and good and the votes junk, none, good. Labellers overlap
    and are taken as independent given the class; they start as mostly right.
    """
    if not patterns:
        return np.zeros((2, 0, 3)), 0.5, {}
    names = sorted(patterns)
    v = np.array([[{"-": 0, "0": 1, "+": 2}[c] for c in p] for p in names])
    n = np.array([patterns[p] for p in names], float)
    m = v.shape[1]
    one = np.eye(3)[v]
    rates = np.empty((2, m, 3))
    rates[0], rates[1] = (0.4, 0.4, 0.2), (0.02, 0.38, 0.6)
    prior = 0.8
    post = np.full(len(names), prior)
    for _ in range(rounds):
        log = [np.log(p) + np.einsum("pmv,mv->p", one, np.log(r)) for p, r in ((1 - prior, rates[0]), (prior, rates[1]))]
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
        prior = float(np.clip((n @ post + 1) / (n.sum() + 2), 0.01, 0.99))
        for c, w in ((0, n * (1 - post)), (1, n * post)):
            rates[c] = (np.einsum("p,pmv->mv", w, one) + np.array([0.5, 0.5, 0.5])) / (w.sum() + 1.5)
    return rates, prior, dict(zip(names, post.tolist(), strict=True))


def fit_scorer(doc: np.ndarray, feature: np.ndarray, weight: np.ndarray, label: np.ndarray, rounds: int = 150) -> tuple[np.ndarray, float]:
    """Logistic regression on feature shares; label: posterior of good. Balanced classes."""
    size = 1 << FEATURE_BITS
    used, col = np.unique(feature, return_inverse=True)
    w, b = np.zeros(len(used)), 0.0
    total = label.sum(), (1 - label).sum()
    importance = label / max(total[0], 1e-9) + (1 - label) / max(total[1], 1e-9)
    m1, m2 = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for t in range(1, rounds + 1):
        z = np.bincount(doc, weight * w[col], len(label)) + b
        e = importance * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - label)
        g = np.r_[np.bincount(col, weight * e[doc], len(used)) + 1e-5 * w, e.sum()]
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        step = 0.5 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    out = np.zeros(size, np.float32)
    out[used] = w
    return out, float(b)


def _shares(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    doc, f = chunk.features()
    key, n = np.unique(doc.astype(np.int64) << FEATURE_BITS | f, return_counts=True)
    doc = key >> FEATURE_BITS
    return doc, key & ((1 << FEATURE_BITS) - 1), n / np.maximum(FAMILIES * chunk.words[doc], 1)


def classify(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, threshold: float = 0.5) -> DataFrame:
    """_rid, doc_id, pattern, posterior, score, keep.

    Heuristic labellers vote on every whole text. Their accuracies are estimated by
    expectation-maximisation over the counts of vote patterns of all
    documents (3**labellers patterns at most, whatever their number). A hashed linear
    scorer is then trained on the posteriors of at most about `sample_rows` documents,
    those of the smallest hashed ids, and scores all; keep: score >= threshold.

    Null or wordless text: no features, score 0, not kept. Very long texts are
    read whole, by one task each. A score of exactly the threshold is kept. Rows that share an id, or have none, and
    repeated rows: each by itself. Other columns are ignored; an empty table gives an empty result.
    """
    return classify_rows(with_row_ids(docs), sample_rows, threshold)


def classify_rows(own: DataFrame, sample_rows: int = SAMPLE_ROWS, threshold: float = 0.5) -> DataFrame:
    """The same of rows from with_row_ids()."""
    votes = settle(label_votes(own), "votes")
    patterns = {r.pattern: r.n for r in votes.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect()}
    _, _, posterior = fit_labellers(patterns)
    total = sum(patterns.values())
    spark = own.sparkSession
    table = spark.createDataFrame([(p, float(x)) for p, x in posterior.items()], "pattern string, posterior double")
    part = min(1.0, sample_rows / max(total, 1))
    chosen = (F.xxhash64(RID).bitwiseAND(F.lit((1 << 30) - 1)) < int(part * (1 << 30))) if part < 1 else F.lit(True)
    ids = votes.filter(chosen).join(F.broadcast(table), "pattern").select(RID, "posterior").orderBy(F.xxhash64(RID), RID).limit(sample_rows * 2)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = utf8(b.column(0))
            label = b.column(1).to_numpy(zero_copy_only=False)
            for i, j in chunks_of_docs(offsets, CHUNK):
                doc, f, w = _shares(Chunk(data, offsets[i : j + 1]))
                largest = np.lexsort((f, -w, doc))
                rank = np.arange(len(doc)) - np.searchsorted(doc, doc)
                doc, f, w = (x[largest][rank < SAMPLE_FEATURES] for x in (doc, f, w))
                cut = np.searchsorted(doc, np.arange(j - i + 1))
                f, w = f.astype("<i4"), w.astype("<f4")
                yield pa.RecordBatch.from_arrays([pa.array(label[i:j]), pa.array([f[s:e].tobytes() for s, e in zip(cut, cut[1:], strict=False)], pa.binary()), pa.array([w[s:e].tobytes() for s, e in zip(cut, cut[1:], strict=False)], pa.binary())], names=["label", "f", "w"])

    sample = map_arrow(own.filter(chosen).join(F.broadcast(ids), RID).select("text", "posterior"), rows, "label double, f binary, w binary").toPandas()
    label = sample.label.to_numpy()
    f, w = [np.frombuffer(x, "<i4") for x in sample.f], [np.frombuffer(x, "<f4") for x in sample.w]
    doc = np.repeat(np.arange(len(label)), [len(x) for x in f])
    shared = spark.sparkContext.broadcast(fit_scorer(doc, joined(f, np.int32), joined(w, np.float32).astype(float), label))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, b0 = shared.value
        for b in batches:
            data, offsets = utf8(b.column(1))
            out = np.zeros(b.num_rows)
            for i, j in chunks_of_docs(offsets, CHUNK):
                c = Chunk(data, offsets[i : j + 1])
                doc, f = c.features()
                z = np.bincount(doc, weights[f], c.n)[: c.n] / np.maximum(FAMILIES * c.words, 1) + b0
                out[i:j] = np.where(c.words > 0, 1 / (1 + np.exp(-np.clip(z, -50, 50))), 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out)], names=[RID, "score"])

    labelled = votes.join(F.broadcast(table), "pattern")
    scored = labelled.join(map_arrow(own.select(RID, "text"), score, f"{RID} long, score double"), RID)
    return scored.select(RID, "doc_id", "pattern", "posterior", "score", (F.col("score") >= threshold).alias("keep"))
