"""SentencePiece encoding and decoding with shared prefixes."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks_of_docs, map_arrow, utf8

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
CACHE_WORDS = 250_000
GROUP_CHARS = 4_000_000
_UNIT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


class Codec:
    """Pieces of a BPE model with byte fallback, white space kept and a dummy prefix.

    Marked words: runs of marks with what follows up to the next mark; no
    piece has a mark after another character, so words are encoded alone.
    A Viterbi pass keeps, for each prefix of a word, the score of its best path, the last piece
    of that path and where it starts. The score of a path is the sum of its pieces' scores in the
    model. A step is allowed if, joined to the last piece before it, the merges part the two
    there again: the model is BPE, whose encoding is not the best sum of scores over all
    paths, but the only path whose steps are all allowed. The words are sorted into a trie, which the pass
    goes through depth-first: forward scores of a prefix that words share are made once.
    """

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.size = sp.vocab_size()
        self.pieces = [sp.id_to_piece(i) for i in range(self.size)]
        self.score = [sp.get_score(i) for i in range(self.size)]
        special = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i)
        self.ids = {p: i for i, p in enumerate(self.pieces) if not special(i)}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece runs over the start of a word")
        self.longest = max(map(len, self.ids))
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(self.size) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        self.raw = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]
        self.raw[self.unknown] = " ⁇ ".encode()
        self.fits: dict[int, bool] = {}
        self.whole = {p for p in self.ids if len(p) == 1 or self.merge(p) == [p]}
        self.number: dict[str, int] = {}  # of whole pieces, and of single characters as they turn up
        self.text: list[str] = []
        self.packed: list[bytes] = []
        self.gain: list[float] = []  # score of each
        self.worst = min(self.score) - 10
        for p in sorted(self.whole):
            self.add(p)
        ends: dict[str, set[int]] = {}
        for p in self.whole:
            if len(p) > 1:
                ends.setdefault(p[-2:], set()).add(len(p))
        # lengths of pieces, by their last two characters
        self.lengths = {e: tuple(sorted(n, reverse=True)) for e, n in ends.items()}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merge(self, text: str) -> list[str]:
        """Plain BPE of a short string: the best adjacent pair first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                t = self.ids.get(parts[i] + parts[i + 1])
                if t is not None and (best is None or self.score[t] > best):
                    best, at = self.score[t], i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def add(self, piece: str) -> int:
        n = self.number[piece] = len(self.text)
        self.text.append(piece)
        self.packed.append(np.array(self.tokens(piece), "<i4").tobytes())
        self.gain.append(self.score[self.ids[piece]] if piece in self.ids else self.worst)
        return n

    def parted(self, a: int, b: int) -> bool:
        """Do the merges of the two together keep them apart and whole?"""
        if len(self.fits) > 500_000:
            self.fits.clear()
        left, right = self.text[a], self.text[b]
        fit = self.fits[a << 21 | b] = self.merge(left + right) == [left, right]
        return fit

    def tokens(self, piece: str) -> list[int]:
        t = self.ids.get(piece)
        if t is not None:
            return [t]
        if self.bytes:
            return [self.bytes[b] for b in piece.encode()]
        return [self.unknown]

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Token ids, as packed <i4, of distinct words."""
        out: dict[str, bytes] = {}
        # of each prefix of the word: the best path's score, its last piece, and where that starts
        forward: list[float] = [0.0]
        last: list[int] = [-1]
        back: list[int] = [-1]
        before, number, lengths, fits, parted, packed, gain = "", self.number, self.lengths, self.fits, self.parted, self.packed, self.gain
        nothing = ()
        for word in sorted(words):
            n, m = 0, min(len(before), len(word))
            while n < m and before[n] == word[n]:
                n += 1
            del forward[n + 1 :], last[n + 1 :], back[n + 1 :]
            for end in range(n + 1, len(word) + 1):
                best = start = piece = None
                for size in lengths.get(word[end - 2 : end], nothing) if end > 1 else nothing:
                    at = end - size
                    if at < 0:
                        continue
                    p = number.get(word[at:end])
                    if p is None:
                        continue
                    if at:
                        fit = fits.get(last[at] << 21 | p)
                        if not (parted(last[at], p) if fit is None else fit):
                            continue
                    score = forward[at] + gain[p]
                    if best is None or score > best:
                        best, start, piece = score, at, p
                if best is None:  # one character where no longer piece is allowed
                    start = end - 1
                    piece = number.get(word[start])
                    if piece is None:
                        piece = self.add(word[start])
                    best = forward[start] + gain[piece]
                forward.append(best)
                last.append(piece)
                back.append(start)
            before = word
            code, end = [], len(word)
            while end:
                code.append(packed[last[end]])
                end = back[end]
            code.reverse()
            out[word] = b"".join(code)
        return out

    def marked(self, text: str) -> list[str]:
        return _UNIT.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        split = [self.marked(t or "") for t in texts]
        known, older = self.words, self.older
        new = set()
        for w in {w for s in split for w in s}:
            if w not in known:
                if w in older:
                    known[w] = older[w]
                else:
                    new.add(w)
        long = self.encode_words([w for w in new if len(w) > 64])  # used, but not kept
        known.update(self.encode_words([w for w in new if len(w) <= 64]))
        get = known.get if not long else lambda w: known.get(w) or long[w]
        out = [b"".join(map(get, s)) for s in split]
        if len(known) > CACHE_WORDS:
            self.words, self.older = {}, known
        return out

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.raw.__getitem__, ids.tolist())).decode(errors="replace")
        return text[1:] if text.startswith(" ") else text


@cache
def codec(model: bytes) -> Codec:
    return Codec(model)


def read_model(model: str) -> bytes:
    """Read once, by the driver; the bytes go along with the plan, so executors need no such file."""
    return Path(model).read_bytes()


def groups(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a bounded size; a longer text stands alone."""
    _, offsets = utf8(batch.column(1))
    for i, j in chunks_of_docs(offsets, GROUP_CHARS):
        yield batch.slice(i, j - i)


def encode(docs: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids array<int>): the ids that the library gives for each whole text.

    Null or empty text: no ids. Repeated rows, null or repeated ids: each row
    by itself. Very long texts are encoded whole, one at a time; words of more than 64 characters are
    not kept for later texts. Other columns are ignored; an empty table gives an empty result.
    """
    proto = read_model(model)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(proto)
        for b in batches:
            for part in groups(b):
                packed = c.encode_batch(part.column(1).to_pylist())
                sizes = np.fromiter((len(x) // 4 for x in packed), np.int32, len(packed))
                values = pa.array(np.frombuffer(b"".join(packed), "<i4"))
                ids = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), values)
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=[id_col, "ids"])

    return map_arrow(docs.select(docs[id_col].cast("long").alias(id_col), docs[text_col].cast("string").alias(text_col)), fn, f"{id_col} long, ids array<int>")


def decode(encoded: DataFrame, model: str = MODEL, id_col: str = "doc_id") -> DataFrame:
    """(id_col, text) of the ids, each row by itself; null or no ids give empty text, an empty table an empty one."""
    proto = read_model(model)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(proto)
        for b in batches:
            text = [c.decode(np.asarray(x.values if x.is_valid else [], np.int64)) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string())], names=[id_col, "text"])

    return map_arrow(encoded.select(id_col, "ids"), fn, f"{id_col} long, text string")


def digests(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, round_trip: encoded and decoded in one pass.

    round_trip: the decoded text is the text, whose marks (U+2581) count as
    the spaces that they decode to. Nulls, empty, very long and repeated rows
    and other columns: as encode(); no ids have the digest of nothing.
    """
    proto = read_model(model)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(proto)
        for b in batches:
            n, digest, back, same = [], [], [], []
            for part in groups(b):
                texts = part.column(1).to_pylist()
                for t, packed in zip(texts, c.encode_batch(texts), strict=True):
                    ids = np.frombuffer(packed, "<i4")
                    text = c.decode(ids)
                    n.append(len(ids))
                    digest.append(hashlib.sha256(packed).hexdigest())
                    back.append(hashlib.sha256(text.encode()).hexdigest())
                    same.append(text == (t or "").replace(MARK, " "))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(back, pa.string()), pa.array(same, pa.bool_())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"])

    return map_arrow(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")), fn, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean")
