"""Cross-entropy difference of two matched n-gram models."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_count, by_group, joined, map_arrow, mix2, pack, pack_sorted, settle, text_bytes, unpack, unpack_sorted, word_names

BIGRAM_WEIGHT = 0.7
#: Tokens that the background's unigrams add to the target's.
PRIOR = 1000
_START = np.uint64(0x5DEECE66D1CE4E5B)
_CHUNK_TOKENS = 1_000_000
_CHUNK_DOCS = 200_000
_NAME_BYTES = 1 << 21
_FLUSH_WORDS = 700_000
CHUNKS = "chunk long, ids array<long>, sizes binary, words binary, at binary"
COUNTED = "chunk long, bucket int, n_words int, code binary, n binary, t binary, e binary, s binary"
ANSWERS = "chunk long, bucket int, n_words int, n binary, t binary, e binary, s binary, n_total long, t_total long"
SCORES = "doc_id long, n_tokens long, loss_target double, loss_background double, score double"


def _tokens(text: str | None) -> list[str]:
    return (text or "").lower().split()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts; each task sends its own sums."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def out():
            words = list(seen)
            for i in range(0, len(words), 100_000):
                w = words[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array([seen[x] for x in w], pa.int64())], names=["word", "n"])
            seen.clear()

        for b in batches:
            for x in b.column(0):
                seen.update(_tokens(x.as_py()))
                if len(seen) > _FLUSH_WORDS:
                    yield from out()
        yield from out()

    return map_arrow(docs.select("text"), fn, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame, share: float) -> dict[str, int]:
    """Ids from 2; 0 is any other word, 1 the start of a text. At most 1/share words.

    For callers that want a bounded list of words; scores do not use it.
    """
    counts = settle(word_counts(docs), "words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    kept = counts.filter(F.col("n") >= share * total).select("word").collect()
    return {w: i + 2 for i, w in enumerate(sorted(r[0] for r in kept))}


class Chunk:
    """Words and bigrams of some documents by name, in the order of names, which is that of buckets."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray, at: np.ndarray, buckets: int):
        """words: ascending names, with that of the start of a text; at: the place in words of each token."""
        self.sizes, self.words, self.buckets = sizes, words, buckets
        self.second = at.astype(np.int64)
        start = int(np.searchsorted(words, _START))
        first = np.r_[start, self.second[:-1]] if len(at) else self.second
        full = sizes[sizes > 0]
        first[np.cumsum(full) - full] = start
        self.first, self.start = first, start
        self.last = np.cumsum(full) - 1
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        pairs, self.pair = np.unique(first * len(words) + self.second, return_inverse=True)
        self.pairs = mix2(words[pairs // len(words)], words[pairs % len(words)])
        self.orders = [np.argsort(x) for x in (self.words, self.pairs)]

    def bucket_of(self, names: np.ndarray) -> np.ndarray:
        """A range of names each, so that sorted names differ by little."""
        return ((names >> np.uint64(32)) * np.uint64(self.buckets) >> np.uint64(32)).astype(np.int64)

    def counts(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of words, of words that end a text, and of bigrams, in these documents (a boolean for each)."""
        mark, ends = docs[self.doc], self.last[docs[self.sizes > 0]]
        words = np.bincount(self.second[mark], minlength=len(self.words))
        words[self.start] = len(ends)
        return words, np.bincount(self.second[ends], minlength=len(self.words)), np.bincount(self.pair[mark], minlength=len(self.pairs))

    def within(self, what: np.ndarray) -> np.ndarray:
        """For each token, how often its document has the same."""
        _, which, n = np.unique(self.doc * (int(what.max(initial=0)) + 1) + what, return_inverse=True, return_counts=True)
        return n[which]

    def losses(self, models: list[tuple], vocabulary: int, weight: float) -> list[np.ndarray]:
        """Mean loss of each document by each model: (words, words that end a text, bigrams, tokens, its documents).

        A document of a model is scored by what the model counts in its other
        documents. The first model's unigrams lean on the uniform distribution, each later
        one's on the first's.
        """
        own = [self.within(x) for x in (self.second, self.first, self.pair)]
        out, base = [], None
        for words, ends, pairs, tokens, docs in models:
            mine = docs[self.doc]
            c = words[self.second] - own[0] * mine
            x = words[self.first] - ends[self.first] - own[1] * mine
            b = pairs[self.pair] - own[2] * mine
            one = unigram(c, tokens - (self.sizes * docs)[self.doc], *((1 / max(vocabulary, 1), vocabulary) if base is None else (base, PRIOR)))
            base = one if base is None else base
            p = interpolated(one, x, b, weight)
            out.append(np.bincount(self.doc, -np.log(p), len(self.sizes)) / np.maximum(self.sizes, 1))
        return out


def unigram(word: np.ndarray, tokens, prior: np.ndarray | float, strength: float) -> np.ndarray:
    """Probability of a word; as if `strength` tokens more had been seen, dealt out by the prior."""
    return (word + strength * prior) / (tokens + strength)


def interpolated(one: np.ndarray, context: np.ndarray, bigram: np.ndarray, weight: float) -> np.ndarray:
    """Probability of a word after another. A context that the model lacks leaves all to the unigram."""
    return np.where(context > 0, (1 - weight) * one + weight * bigram / np.maximum(context, 1), one)


def tokenised(docs: DataFrame) -> DataFrame:
    """Chunks of documents with their tokens. docs: (doc_id, text)."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        ids: list[int | None] = []
        sizes: list[int] = []
        names: list[np.ndarray] = []
        texts: list[str] = []
        waiting, tokens = 0, 0

        def named():
            nonlocal waiting
            if texts:
                names.append(word_names(np.frombuffer(" ".join(texts).encode(), np.uint8))[0])
            texts.clear()
            waiting = 0

        def out():
            nonlocal chunk, tokens
            named()
            words, at = np.unique(np.concatenate([np.array([_START], np.uint64), *names]), return_inverse=True)
            row = (chunk, list(ids), pack(np.array(sizes, np.uint32)), pack_sorted(words), pack(at[1:].astype(np.uint32)))
            kinds = (pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 3)
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=[x.split()[0] for x in CHUNKS.split(", ")])
            for x in (ids, sizes, names):
                x.clear()
            chunk, tokens = chunk + 1, 0

        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                w = _tokens(x.as_py())
                ids.append(i)
                sizes.append(len(w))
                if w:
                    texts.append(" ".join(w))
                    waiting += len(texts[-1])
                    tokens += len(w)
                if waiting > _NAME_BYTES:
                    named()
                if tokens > _CHUNK_TOKENS or len(ids) >= _CHUNK_DOCS:
                    yield from out()
        if ids:
            yield from out()

    return map_arrow(docs.select("doc_id", "text"), fn, CHUNKS)


def _chunk_of(row: dict, buckets: int) -> tuple[Chunk, np.ndarray]:
    """The chunk of a row, and which of its documents are of the target."""
    got = Chunk(unpack(row["sizes"]).astype(np.int64), unpack_sorted(row["words"]), unpack(row["at"]), buckets)
    target = np.zeros(len(got.sizes), bool)
    target[row["marks"] or []] = True
    return got, target


def counted(chunks: DataFrame, buckets: int) -> DataFrame:
    """A row for each chunk and bucket: the chunk's counts of the bucket's words and bigrams."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                got, target = _chunk_of(row, buckets)
                both = [got.counts(x) for x in (np.ones(len(target), bool), target)]
                none = (np.zeros(0, np.uint64), *[np.zeros(0, np.uint32)] * 4)
                rows: dict[int, list] = {}
                for kind, (codes, order) in enumerate(zip((got.words, got.pairs), got.orders, strict=True)):
                    values = [x[2 * kind] for x in both] + ([x[1] for x in both] if kind == 0 else [])
                    for to, *x in by_group(got.bucket_of(codes[order]), codes[order], *(v[order].astype(np.uint32) for v in values)):
                        rows.setdefault(int(to), [none, none])[kind] = x
                made = [(row["chunk"], to, len(w[0]), pack_sorted(np.r_[w[0], b[0]]), pack(np.r_[w[1], b[1]]), pack(np.r_[w[2], b[2]]), pack(w[3]), pack(w[4])) for to, (w, b) in rows.items()]
                kinds = (pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 5)
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in made], k) for c, k in enumerate(kinds)], names=[x.split()[0] for x in COUNTED.split(", ")])

    return map_arrow(chunks, fn, COUNTED)


def _answers(t: pa.Table) -> pa.Table:
    """What the corpus counts of each chunk's entries, in the chunk's order, and the bucket's totals in a row without chunk."""
    code, n, m, e, s = (list(map(f, t.column(c).to_pylist())) for c, f in (("code", unpack_sorted), ("n", unpack), ("t", unpack), ("e", unpack), ("s", unpack)))
    words = t.column("n_words").to_pylist()
    chunks, bucket = t.column("chunk").to_pylist(), t.column("bucket")[0].as_py()
    whole: list[list[list[np.ndarray]]] = [[], []]
    totals = (0, 0, 0)
    for kind in (0, 1):
        cut = lambda x, w, kind=kind: x[:w] if kind == 0 else x[w:]
        own = [[cut(x, w) for x, w in zip(xs, words, strict=True)] for xs in ((code, n, m, e, s) if kind == 0 else (code, n, m))]
        keys, at = np.unique(joined(own[0], np.uint64), return_inverse=True)
        sums = [np.bincount(at, joined(x, np.uint32), len(keys)).astype(np.int64) for x in own[1:]]
        if kind == 0:
            word = keys != _START
            totals = (int(word.sum()), *(int(x[word].sum()) for x in sums[:2]))
        ends = np.cumsum([len(x) for x in own[0]])[:-1]
        whole[kind] = [np.split(x[at], ends) for x in sums]
    parts = [[pack(np.r_[a, b]) for a, b in zip(whole[0][i], whole[1][i], strict=True)] for i in (0, 1)] + [list(map(pack, whole[0][i])) for i in (2, 3)]
    k = len(chunks)
    return pa.table(
        [pa.array([*chunks, None], pa.int64()), pa.array([bucket] * (k + 1), pa.int32()), pa.array([*words, totals[0]], pa.int32()), *(pa.array([*x, None], pa.binary()) for x in parts), *(pa.array([None] * k + [x], pa.int64()) for x in totals[1:])],
        names=[x.split()[0] for x in ANSWERS.split(", ")],
    )


def _score(buckets: int, totals: tuple[int, int, int], weight: float):
    def fn(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        own = next(r for r in rows if r["ids"] is not None)
        got, target = _chunk_of(own, buckets)
        told = sorted((r for r in rows if r["ids"] is None), key=lambda r: r["bucket"])

        def placed(which: str, kind: int) -> np.ndarray:
            order = got.orders[kind]
            x = [(unpack(r[which]), r["n_words"]) for r in told]
            c = np.zeros(len(order))
            c[order] = joined((y[:w] if kind == 0 else y[w:] for y, w in x), np.int64)
            return c

        models = [(placed(c, 0), placed(e, 0), placed(c, 1), n, docs) for c, e, n, docs in (("n", "e", totals[1], np.ones(len(target), bool)), ("t", "s", totals[2], target))]
        g, m = got.losses(models, totals[0], weight)
        return pa.table([pa.array(own["ids"], pa.int64()), pa.array(got.sizes), pa.array(m), pa.array(g), pa.array(m - g)], names=[x.split()[0] for x in SCORES.split(", ")])

    return fn


def cross_entropy_difference(docs: DataFrame, target: DataFrame, weight: float = BIGRAM_WEIGHT) -> DataFrame:
    """doc_id, n_tokens, loss_target, loss_background, score = the mean over tokens of the loss difference; lower: more like the target.

    target: (doc_id), the documents of the target domain. Both models are
    interpolated bigram models of one order, vocabulary (all words) and weight, and hold
    every word and bigram; the background's counts cover all documents, the
    target's all target documents. Unigrams of the background have one added to each word's count, those of the target
    PRIOR tokens dealt out by the background's, so that words which the target lacks count against it.
    Probabilities sum to one over the vocabulary, after every context. A document of a model is scored by the model without it. Words are lower-cased and split at white space.
    No task holds a model: chunks of documents send their own counts to
    buckets of 64-bit names, which sum them and answer each chunk for its
    entries, and a chunk scores its documents from the answers. Target ids meet the
    ids of the chunks, not the texts.

    Null or wordless text: no tokens, losses and score 0. Rows that share an
    id, or have none, and repeated rows: each row by itself, a target if its id is. Target ids
    that are null, repeated or without a document do nothing. Very long texts are
    read whole; one is a chunk of its own. Other columns are ignored; an
    empty table gives an empty result.
    """
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    ids = target.select(target["doc_id"].cast("long").alias("doc_id")).filter("doc_id is not null").distinct()
    buckets = bucket_count(docs.sparkSession, text_bytes(own) / 9)
    chunks = settle(tokenised(own), "chunks")
    places = chunks.select("chunk", F.posexplode("ids").alias("place", "doc_id")).join(ids, "doc_id")
    marks = settle(places.groupBy("chunk").agg(F.collect_list("place").alias("marks")), "marks")
    held = chunks.join(marks, "chunk", "left")
    entries = counted(held.select("chunk", "ids", "sizes", "words", "at", "marks"), buckets)
    answers = settle(entries.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_answers, ANSWERS), "answers")
    totals = tuple(x or 0 for x in answers.filter("chunk is null").agg(F.sum("n_words"), F.sum("n_total"), F.sum("t_total")).first())
    none = lambda fields: (F.lit(None).cast(k).alias(c) for c, k in fields)
    told = answers.filter("chunk is not null").select("chunk", "bucket", "n_words", "n", "t", "e", "s", *none((("ids", "array<long>"), ("sizes", "binary"), ("words", "binary"), ("at", "binary"), ("marks", "array<int>"))))
    held = held.select("chunk", *none((("bucket", "int"), ("n_words", "int"), ("n", "binary"), ("t", "binary"), ("e", "binary"), ("s", "binary"))), "ids", "sizes", "words", "at", "marks")
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), chunks.count() // 4 + 1)
    return held.unionByName(told).repartition(parts, "chunk").groupBy("chunk").applyInArrow(_score(buckets, totals, weight), SCORES)
