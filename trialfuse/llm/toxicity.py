"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, settle, with_row_ids

#: Labelled rows that are learned from at most: those of the smallest hashed ids.
SAMPLE_ROWS = 40_000
#: Lengths of stems; shorter words are terms as a whole.
STEMS = range(4, 10)
#: A term stands in so many toxic documents and between so many different pairs of words there, whatever the size of the
#: table, and its rate in toxic documents is this share of both classes' rates together.
LEAST_DOCS, PRECISION = 5, 0.95
THRESHOLD = 0.3
#: Spans of these are never counted, besides the exceptions that are learned: none, unless the caller names some.
EXCEPTIONS: tuple[str, ...] = ()

_LOOKALIKES = {
    "a": "аɑα@4àáâãå", "b": "Ьвβ8", "c": "сϲ¢", "d": "ԁɗ", "e": "еёεɛ3€", "g": "ɡ9", "h": "һհ", "i": "іιıɩ1!|ì", "j": "јʝ",
    "k": "кκ", "l": "ӏⅼ", "m": "мⅿ", "n": "ոη", "o": "оοօ0ο", "p": "рρ", "q": "ԛ", "r": "гⲅ", "s": "ѕʂ5$", "t": "тτ7+",
    "u": "υսù", "v": "ѵν", "w": "ԝω", "x": "хχ×", "y": "уүγ", "z": "ᴢ2",
}


class _Fold(dict):
    """Homoglyphs and digit substitutions become letters; what is no letter or digit, a space."""

    def __missing__(self, code: int) -> int:
        ch = chr(code)
        wide = chr(code - 0xFEE0).lower() if 0xFF01 <= code <= 0xFF5E else ch
        out = ord(wide) if wide.isalnum() else 32
        self[code] = out
        return out


FOLD = _Fold({ord(x): ord(to) for to, xs in _LOOKALIKES.items() for x in xs})
#: At the ends of a word these are punctuation, inside it letters.
_EDGE = "!|+$@*#%&"


def fold(text: str | None) -> str:
    """Lower case, folded, words parted by one or more spaces, with spaces at both ends."""
    words = (text or "").lower().split()
    return " " + " ".join([w if w.isascii() and w.isalpha() else w.strip(_EDGE).translate(FOLD) for w in words]) + " "


def _terms(folded: str) -> set[str]:
    return {t for w in set(folded.split()) for t in _terms_of(w)}


def _terms_of(word: str) -> list[str]:
    return [word[:k] for k in STEMS if len(word) >= k] if len(word) >= STEMS.start else [f"{word} "]


def _sample(labels: DataFrame, rows: int) -> DataFrame:
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    own = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null")
    own = own.filter(~held).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def learn_lexicon(train: DataFrame) -> dict[str, float]:
    """Stems at word starts, and whole short words, with log-odds weights. train: (text, toxic).

    Copies of a toxic document make all its words look toxic, so occurrences count once for each pair of words beside them.
    If no term stands between five such pairs (all toxic documents are one text), documents alone count.
    """

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[Counter] = [Counter(), Counter()]

        def out():
            terms = list(seen[0] | seen[1])
            for i in range(0, len(terms), 100_000):
                part = terms[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *(pa.array([c[t] for t in part], pa.int64()) for c in seen)], names=["term", "neg", "pos"])
            for c in seen:
                c.clear()

        for b in batches:
            for x, y in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                seen[1 if y else 0].update(_terms(fold(x.as_py())))
                seen[1 if y else 0][""] += 1
            if len(seen[0]) + len(seen[1]) > 1_000_000:
                yield from out()
        yield from out()

    counts = map_arrow(train.select("text", "toxic"), fn, "term string, neg long, pos long").groupBy("term").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    counts = settle(counts, "terms")
    n, p = (counts.filter("term = ''").select(F.coalesce("neg", F.lit(0)), F.coalesce("pos", F.lit(0))).first() or (0, 0))
    if not n or not p:
        return {}
    rate = (F.col("pos") / p) / (F.col("pos") / p + F.col("neg") / n)
    found = counts.filter((F.col("term") != "") & (F.col("pos") >= LEAST_DOCS) & (rate >= PRECISION)).collect()
    places = _neighbourhoods(train, frozenset(r.term for r in found))
    found = [r for r in found if places.get(r.term, 0) >= LEAST_DOCS] or found
    weight = {r.term: math.log((r.pos + 0.5) / (p + 1)) - math.log((r.neg + 0.5) / (n + 1)) for r in found}
    # a stem covers the longer ones; it is made longer where that costs hardly any document
    seen = {r.term: r.pos for r in found}
    short = [t for t in weight if not any(t[:k] in weight for k in STEMS if k < len(t))]
    whole = {t: max((x for x in weight if x.startswith(t) and seen[x] >= 0.95 * seen[t]), key=lambda x: (len(x), seen[x], x)) for t in short}
    return {x: weight[x] for x in whole.values()}


def _neighbourhoods(train: DataFrame, terms: frozenset[str]) -> dict[str, int]:
    """Different pairs of neighbours of each term in toxic documents."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            met = set()
            for x in b.column(0):
                words = ["", *fold(x.as_py()).split(), ""]
                for i in range(1, len(words) - 1):
                    own = [t for t in _terms_of(words[i]) if t in terms]
                    if own:
                        beside = xxhash.xxh64_intdigest(f"{words[i - 1]} {words[i + 1]}") - (1 << 63)
                        met.update((t, beside) for t in own)
            yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in met], pa.string()), pa.array([m[1] for m in met], pa.int64())], names=["term", "beside"])

    found = map_arrow(train.filter("toxic > 0").select("text"), fn, "term string, beside long").distinct().groupBy("term").count()
    return {r[0]: r[1] for r in found.collect()}


class Matcher:
    def __init__(self, lexicon: dict[str, float], exceptions: tuple[str, ...]):
        import ahocorasick

        self.auto = ahocorasick.Automaton()
        for term, w in lexicon.items():
            self.auto.add_word(f" {term}", (len(term), w))
        for phrase in {" ".join(fold(x).split()) for x in exceptions}:
            self.auto.add_word(f" {phrase} ", (len(phrase) + 1, None))
        self.any = len(self.auto) > 0
        if self.any:
            self.auto.make_automaton()

    def hits(self, folded: str) -> list[tuple[int, float]]:
        """(place of the word, weight), outside exception phrases."""
        if not self.any:
            return []
        found = [(end - n + 1, end, w) for end, (n, w) in self.auto.iter(folded)]
        spared = [(s, e) for s, e, w in found if w is None]
        return [(s, w) for s, e, w in found if w is not None and not any(a <= s <= b for a, b in spared)]

    def value(self, text: str | None) -> tuple[float, int, int]:
        """(weight of hits over the log of the length, hits, words)."""
        folded = " ".join(fold(text).split())
        hits = self.hits(f" {folded} ")
        n = folded.count(" ") + 1 if folded else 0
        return sum(w for _, w in hits) / math.log2(16 + n), len(hits), n


def learn_exceptions(train: DataFrame, lexicon: dict[str, float]) -> tuple[str, ...]:
    """Two-word phrases around lexicon words that occur in clean documents, not in toxic ones."""
    if not lexicon:
        return ()
    made: list[Matcher] = []

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(Matcher(lexicon, ()))
        for b in batches:
            phrases, toxic = [], []
            for x, y in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                text = f" {' '.join(fold(x.as_py()).split())} "
                own = set()
                for at, _ in made[0].hits(text):
                    end = text.index(" ", at)
                    own.add(text[text.rfind(" ", 0, at - 1) + 1 : end].strip())
                    own.add(text[at : text.find(" ", end + 1) if text.find(" ", end + 1) > 0 else end])
                own = {o for o in own if " " in o}
                phrases += own
                toxic += [int(bool(y))] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(phrases, pa.string()), pa.array(toxic, pa.int64())], names=["phrase", "toxic"])

    counts = map_arrow(train.select("text", "toxic"), fn, "phrase string, toxic long").groupBy("phrase").agg(F.sum("toxic").alias("pos"), F.count(F.lit(1)).alias("n"))
    return tuple(sorted(r[0] for r in counts.filter((F.col("pos") == 0) & (F.col("n") >= LEAST_DOCS)).select("phrase").collect()))


def _fit(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Logistic slope and intercept by Newton's steps, lightly regularised."""
    a, b = 0.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * x + b)))
        w = np.maximum(n * p * (1 - p), 1e-9)
        g = np.array([(n * (p - y) * x).sum() + 0.1 * a, (n * (p - y)).sum() + 0.01 * b])
        h = np.array([[(w * x * x).sum() + 0.1, (w * x).sum()], [(w * x).sum(), w.sum() + 0.01]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, exceptions: tuple[str, ...] = EXCEPTIONS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, n_hits, n_words.

    Labels are learned from rows whose crc32(doc_id as text) mod 4 is not 2,
    at most `sample_rows` of them (those of the smallest hashed ids; a label
    given twice counts once, the higher). Lexicon: stems at word starts, and
    whole words of up to three letters, that stand in five toxic documents, between five different pairs
    of neighbours there, and are rare elsewhere; both numbers are the same at every size. Weights are log-odds.
    Homoglyphs and digit substitutions are folded before words are counted or
    matched. A document's weights are summed, without hits inside exception
    phrases, divided by the log of its length, and a logistic curve fitted on
    the learned rows gives the score.

    Null or empty text: no hits, the score of a text without hits. Very long texts are
    matched whole, by one task each. A score of exactly the threshold is predicted 1. No labels, or of one class: no
    lexicon; every score is the share of toxic labels learned from, 0 if none.
    Rows that share an id, or have none: each row by itself (a null id is not held out). Other
    columns are ignored; an empty table gives an empty result.
    """
    own = with_row_ids(docs)
    sample = settle(_sample(labels, sample_rows), "sample")
    train = settle(own.join(F.broadcast(sample), "doc_id").select("text", "toxic"), "train")  # at most sample_rows ids
    lexicon = learn_lexicon(train)
    exceptions = (*exceptions, *learn_exceptions(train, lexicon))
    made: list[Matcher] = []

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(Matcher(lexicon, exceptions))
        for b in batches:
            v = [made[0].value(x.as_py()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in v], pa.float64()), pa.array([x[1] for x in v], pa.int64()), pa.array([x[2] for x in v], pa.int64())], names=["doc_id", "x", "n_hits", "n_words"])

    values = settle(map_arrow(own.select("doc_id", "text"), fn, "doc_id long, x double, n_hits long, n_words long"), "values")
    bins = values.join(F.broadcast(sample), "doc_id").groupBy(F.round("x", 2).alias("x"), (F.col("toxic") > 0).cast("double").alias("y")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    got = bins.orderBy("x", "y").toPandas()
    y = (got.y * got.n).sum() / max(got.n.sum(), 1)
    if lexicon and 0 < y < 1:
        a, b = _fit(got.x.to_numpy(), got.y.to_numpy(), got.n.to_numpy())
        score = 1 / (1 + F.exp(-(F.col("x") * a + b)))
    else:
        score = F.lit(float(y))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    out = values.select("doc_id", held.alias("held_out"), score.alias("score"), "n_hits", "n_words")
    return out.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_hits", "n_words")
