"""Substring dedup over words, by level-wise doubling.

Windows of a quarter of the length are looked at first. Those that repeat,
alone, are extended to twice the length, and those of them that repeat again, until
windows have the full length or none survives:

1. Of the short windows inside a full one, one is chosen by its content alone (the
   leftmost of the smallest name), so equal full windows choose the same one at
   the same place. Those that occur once are finished, with all full windows that chose them.
2. A survivor is extended to both sides, each for the full windows that hold
   the extension. Extensions that occur once are finished. One whose full
   windows all cover the same words as an earlier one's is settled, without a look at each of them.
3. The full windows of what survives are compared one by one.

A word and a window have two independent 64-bit names, keyed and made from all bytes: equal pairs
stand for equal words, but for a chance of 2**-128. Levels 1 and 2 drop windows by one of the
names, where a clash costs work and loses nothing; what is removed is told by both.

Entries travel as packed columns, one row for each bucket and map task. A task first
settles what it can by itself, and sends one entry for a window that it has seen repeat, however
often, so no bucket grows with the largest group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RID, SPACES, bucket_count, by_group, chunks_of_docs, joined, map_arrow, mix, pack, pack_sorted, settle, text_bytes, unpack, unpack_sorted, utf8, with_row_ids

WORDS = 20
KEY = b"words of the corpus"
_KEYS = np.frombuffer(hashlib.blake2b(KEY, digest_size=16).digest(), "<u8")
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
LONG_WORD = 256
CHUNK_BYTES, PART_WORDS, FLUSH = 1 << 20, 100_000, 1_000_000
OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
#: k, c: names; d, s, m: document, first window and a bit for each further one; f: k repeats in the task; o: survivors; z: windows to cut.
SENT = "bucket int, k binary, c binary, e binary, d binary, s binary, m binary, f binary, o_d binary, o_s binary, o_m binary, z_d binary, z_s binary, z_m binary"
TOLD = "bucket int, o_d binary, o_s binary, o_m binary, z_d binary, z_s binary, z_m binary"


def halves(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(two names of each word, where it starts). Each is made from the length and all bytes, eight at once, by a mix of its own that is one to one in each eight."""
    gap = np.r_[True, SPACES[data], True]
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    start, size = edge[::2], edge[1::2] - edge[::2]
    eights = np.lib.stride_tricks.sliding_window_view(np.r_[data, np.zeros(8, np.uint8)], 8)
    out = np.stack([mix(size.astype(np.uint64) ^ key, 1) for key in _KEYS], axis=1)
    at, left = np.flatnonzero(size <= LONG_WORD), size.copy()
    where = start.copy()
    while len(at):
        block = np.ascontiguousarray(eights[where[at]]).view("<u8")[:, 0] & _FIRST_BYTES[np.minimum(left[at], 8)]
        for i, key in enumerate(_KEYS):
            out[at, i] = mix(out[at, i] ^ block, key)
        where[at] += 8
        left[at] -= 8
        at = at[left[at] > 0]
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = np.frombuffer(hashlib.blake2b(data[start[i] : start[i] + size[i]].tobytes(), digest_size=16, key=KEY).digest(), "<u8")
    return out, start


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(two names of each word, words of each document); a long document is cut part by part, at a space."""
    n = len(offsets) - 1
    if n == 1 and offsets[1] - offsets[0] > 2 * CHUNK_BYTES:
        text, parts, at = data[offsets[0] : offsets[1]], [], 0
        while at < len(text):
            ahead = np.flatnonzero(SPACES[text[at + CHUNK_BYTES : at + 2 * CHUNK_BYTES]])
            end = at + CHUNK_BYTES + int(ahead[0]) if len(ahead) else _next_gap(text, at + 2 * CHUNK_BYTES)
            parts.append(halves(text[at:end])[0])
            at = end
        out = np.concatenate(parts)
        return out, np.array([len(out)])
    sizes = np.diff(offsets)
    spaced = np.full(int(sizes.sum()) + n, 0x20, np.uint8)
    spaced[np.arange(int(sizes.sum())) + np.repeat(np.arange(n), sizes)] = data[offsets[0] : offsets[-1]]
    out, start = halves(spaced)
    own = np.searchsorted(offsets[:-1] - offsets[0] + np.arange(n), start, side="right") - 1
    return out, np.bincount(own, minlength=n)[:n]


def _next_gap(text: np.ndarray, at: int) -> int:
    while at < len(text):
        ahead = np.flatnonzero(SPACES[text[at : at + CHUNK_BYTES]])
        if len(ahead):
            return at + int(ahead[0])
        at += CHUNK_BYTES
    return len(text)


def doubled(h: np.ndarray, length: int) -> np.ndarray:
    """Names of the windows of `length` units, each the pair of two names of half the length (or, at last, more)."""
    p = 1
    while p * 2 <= length:
        h = mix(mix(h[: max(len(h) - p, 0)], h[p:]), p)
        p *= 2
    return h if p == length else mix(mix(h[: max(len(h) - (length - p), 0)], h[length - p :]), length)


class Level:
    """The words of some documents, `length` empty ones apart, and the short windows that their full windows choose."""

    def __init__(self, halves: np.ndarray, sizes: np.ndarray, length: int):
        self.length, self.short = length, max(1, length // 4)
        n = len(sizes)
        self.first = np.cumsum(np.r_[0, sizes[:-1] + length]) + length if n else np.zeros(0, np.int64)
        units = np.zeros((int(sizes.sum()) + length * (n + 2), 2), np.uint64)
        units[np.arange(len(halves)) + np.repeat(self.first - np.cumsum(np.r_[0, sizes[:-1]]), sizes)] = halves
        self.halves = [np.ascontiguousarray(units[:, i]) for i in (0, 1)]
        many = np.maximum(sizes - length + 1, 0)
        total = int(many.sum())
        start = np.repeat(self.first - np.cumsum(np.r_[0, many[:-1]]), many) + np.arange(total) if n else np.zeros(0, np.int64)
        self.names = doubled(self.halves[0], self.short)
        at = self._chosen()[start]
        head = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if total else np.zeros(0, np.int64)
        self.at, self.lo = at[head], start[head]
        self.hi = start[np.r_[head[1:], total] - 1] if total else self.lo
        self.doc = np.searchsorted(self.first, self.lo, side="right") - 1

    def _chosen(self) -> np.ndarray:
        m = (mix(self.names, 0x27D4EB2F) & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(self.names), dtype=np.uint64)
        width, w = 1, self.length - self.short + 1
        while width * 2 <= w:
            m = np.minimum(m[:-width], m[width:])
            width *= 2
        if width < w:
            m = np.minimum(m[: -(w - width)], m[w - width :])
        return (m & np.uint64(0xFFFFFFFF)).astype(np.int64)

    def extended(self, which: np.ndarray) -> tuple[np.ndarray, ...]:
        """(k, c, e, index, lo, hi) of the extensions of chosen windows to twice their length, to the right and to the left."""
        twice = min(2 * self.short, self.length)
        # a full window that begins at most this far before the short one holds it with what follows, another with what goes before
        far = self.length - twice
        names = doubled(self.halves[0], twice)
        at, lo, hi = self.at[which], self.lo[which], self.hi[which]
        right, left = hi >= at - far, lo < at - far
        index = np.r_[which[right], which[left]]
        lo, hi = np.r_[np.maximum(lo, at - far)[right], lo[left]], np.r_[hi[right], np.minimum(hi, at - far - 1)[left]]
        k = np.r_[names[at[right]], mix(names[at[left] - (twice - self.short)], 1)]
        full = [doubled(h, self.length) for h in self.halves]
        span = (hi - lo).astype(np.uint64)
        c, e = (mix(mix(f[lo], f[hi]), span) for f in full)
        return k, c, e, index, lo, hi


def _bits(n: np.ndarray) -> np.ndarray:
    """A bit for each of n windows."""
    return ((np.uint64(1) << n.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)


def resolve(k: np.ndarray, c: np.ndarray, e: np.ndarray, d: np.ndarray, s: np.ndarray, flag: np.ndarray, level: int):
    """What the entries tell among themselves; four arrays of indices.

    open: survivors. done: to be cut. keep: entries that others need; told: of
    these, those whose k is known to repeat.
    Level 1: k that occur twice survive. Level 2: an entry with the k, c and e of an earlier
    one is done; where one k has several c and e, the others survive. Level 3: the same without survivors.
    """
    none = np.zeros(0, np.int64)
    if not len(k):
        return none, none, none, none
    o = np.lexsort((s, d, k)) if level == 1 else np.lexsort((s, d, e, c, k))
    new = np.r_[True, k[o][1:] != k[o][:-1]]
    head = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    told = np.logical_or.reduceat(flag[o], head)
    if level == 1:
        told |= np.diff(np.r_[head, len(o)]) > 1
        return o[told[group]], none, o[new | ~told[group]], o[new & told[group]]
    kind = new | np.r_[True, (c[o][1:] != c[o][:-1]) | (e[o][1:] != e[o][:-1])]
    if level == 3:
        return none, o[~kind], o[kind], none
    told |= np.add.reduceat(kind.astype(np.int64), head) > 1
    open_ = kind & told[group]
    return o[open_], o[~kind], o[kind & (new | ~told[group])], o[new & told[group]]


def _bucket_of(names: np.ndarray, buckets: int) -> np.ndarray:
    return ((names.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % buckets


def _aside(docs: np.ndarray, s: np.ndarray, m: np.ndarray, buckets: int) -> dict[int, list]:
    return {int(b): [pack(x), pack(y), pack(z)] for b, x, y, z in by_group(_bucket_of(docs, buckets), docs, s.astype(np.uint32), m)}


def _table(rows: dict[int, list], schema: str) -> pa.RecordBatch:
    names = [x.split()[0] for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int32()), *(pa.array([r[i] for r in rows.values()], pa.binary()) for i in range(len(names) - 1))], names=names)


def _flush(parts: list[tuple], level: int, buckets: int) -> Iterator[pa.RecordBatch]:
    if not parts:
        return
    k, c, e, d, s, m = (np.concatenate(x) for x in zip(*parts, strict=True))
    open_, done, keep, told = resolve(k, c, e, d, s, np.zeros(len(k), bool), level)
    flag = np.zeros(len(k), np.uint8)
    flag[told] = 1
    rows: dict[int, list] = {}
    keep = keep[np.argsort(k[keep], kind="stable")]
    for b, x in by_group(_bucket_of(k[keep], buckets), keep):
        rows[int(b)] = [pack_sorted(k[x]), *((pack(c[x]), pack(e[x])) if level > 1 else (None, None)), pack(d[x]), pack(s[x].astype(np.uint32)), pack(m[x]), pack(flag[x]), *[None] * 6]
    # what is told alone travels on its own; a level's survivors that are sent are told by the bucket
    open_ = open_[~np.isin(open_, keep, assume_unique=True)]
    for i, at in ((7, open_), (10, done)):
        for b, x in _aside(d[at], s[at], m[at], buckets).items():
            rows.setdefault(b, [None] * 13)[i : i + 3] = x
    yield _table(rows, SENT)


def _met(level: int, buckets: int) -> Callable[[pa.Table], pa.Table]:
    """Reduce: the survivors and the windows to cut among what one bucket was sent."""

    def fn(t: pa.Table) -> pa.Table:
        get = lambda name, kind, f=unpack: joined((f(x) for x in t.column(name).to_pylist() if x is not None), kind)
        k, d, s, m, f = get("k", np.uint64, unpack_sorted), get("d", np.int64), get("s", np.uint32), get("m", np.uint32), get("f", np.uint8)
        c, e = (get("c", np.uint64), get("e", np.uint64)) if level > 1 else (k, k)
        open_, done, _, _ = resolve(k, c, e, d, s.astype(np.int64), f > 0, level)
        rows: dict[int, list] = {}
        for i, (x, at) in enumerate((("o", open_), ("z", done))):
            own = [np.concatenate([v[at], get(f"{x}_{n}", v.dtype)]) for v, n in ((d, "d"), (s, "s"), (m, "m"))]
            for b, y in _aside(*own, buckets).items():
                rows.setdefault(b, [None] * 6)[3 * i : 3 * i + 3] = y
        return pa.Table.from_batches([_table(rows, TOLD)])

    return fn


def _starts_by_document(t: pa.Table) -> pa.Table:
    """(_rid, starts): first windows and bits of survivors, or the windows to cut, of each document."""
    d, s, m = (joined((unpack(x) for x in t.column(c).to_pylist()), np.int64) for c in ("d", "s", "m"))
    rows = []
    for doc, a, b in by_group(d, s, m):
        rows.append((int(doc), np.unique(np.concatenate([a[(b >> i & 1) > 0] + i for i in range(32)])).astype("<u4").tobytes()))
    return pa.table([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=[RID, "starts"])


def _levels(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, int, Level]]:
    """(i, j, base, level) of documents i to j; the windows of a longer document come in parts that start at word base."""
    for i, j in chunks_of_docs(offsets, CHUNK_BYTES):
        words, sizes = words_of(data, offsets[i : j + 1])
        if j > i + 1 or len(words) <= 2 * PART_WORDS:
            yield i, j, 0, Level(words, sizes, length)
            continue
        for base in range(0, len(words), PART_WORDS):
            part = words[base : base + PART_WORDS + length - 1]
            yield i, j, base, Level(part, np.array([len(part)], np.int64), length)


def _looked_at(length: int, level: int, buckets: int):
    """Map: the entries of one level. Above the first, of the full windows whose starts have survived."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = utf8(batch.column(1))
            starts = batch.column(2).to_pylist() if level > 1 else []
            for i, j, base, x in _levels(data, offsets, length):
                if level > 1:
                    alive = np.concatenate([np.frombuffer(y, "<u4").astype(np.int64) + (x.first[c] - base) for c, y in enumerate(starts[i:j])])
                if level == 1:
                    index, lo, hi = np.arange(len(x.at)), x.lo, x.hi
                    k = c = e = x.names[x.at]
                elif level == 2:
                    k, c, e, index, lo, hi = x.extended(np.flatnonzero(np.isin(x.lo, alive, assume_unique=True)))
                else:
                    # the starts of each part of a document that are among those alive
                    total = len(x.halves[0])
                    lo = hi = alive[(alive >= x.lo.min(initial=total)) & (alive <= x.hi.max(initial=-1))]
                    index = np.searchsorted(x.lo, lo, side="right") - 1
                    k, c = (doubled(h, length)[lo] for h in x.halves)
                    e = c
                doc = x.doc[index]
                parts.append((k, c, e, ids[i:j][doc], lo - x.first[doc] + base, _bits(hi - lo + 1)))
                n += len(k)
                if n >= FLUSH:
                    yield from _flush(parts, level, buckets)
                    parts, n = [], 0
        yield from _flush(parts, level, buckets)

    return fn


def later_windows(docs: DataFrame, length: int = WORDS) -> DataFrame:
    """(_rid, cut binary): the starts, as packed <u4, of windows of words that also start earlier. docs: (_rid, text)."""
    own = docs.select(RID, "text")
    buckets = bucket_count(own.sparkSession, text_bytes(own) / (2 * length), 500_000)
    dealt = lambda df: df.repartition(buckets, "bucket").groupBy("bucket")
    found, alive = [], own
    for level in (1, 2, 3):
        told = settle(dealt(map_arrow(alive, _looked_at(length, level, buckets), SENT)).applyInArrow(_met(level, buckets), TOLD), f"level{level}")
        of = lambda x, told=told: told.filter(f"{x}_d is not null").select("bucket", F.col(f"{x}_d").alias("d"), F.col(f"{x}_s").alias("s"), F.col(f"{x}_m").alias("m"))
        found.append(of("z"))
        survivors = of("o")
        if level == 3 or survivors.isEmpty():
            break
        alive = own.join(dealt(survivors).applyInArrow(_starts_by_document if level == 2 else _first_by_document, f"{RID} long, starts binary"), RID)
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return dealt(out).applyInArrow(_starts_by_document, f"{RID} long, starts binary").withColumnRenamed("starts", "cut")


def _first_by_document(t: pa.Table) -> pa.Table:
    """(_rid, starts): the first windows alone, which tell chosen short windows apart."""
    d, s = (joined((unpack(x) for x in t.column(c).to_pylist()), np.int64) for c in ("d", "s"))
    rows = [(int(doc), np.unique(a).astype("<u4").tobytes()) for doc, a in by_group(d, s)]
    return pa.table([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=[RID, "starts"])


def removed_mask(size: int, cut: bytes | None, length: int) -> np.ndarray:
    """Words that a window to cut covers."""
    mark = np.zeros(size + 1, np.int64)
    at = np.frombuffer(cut or b"", "<u4").astype(np.int64)
    mark[at] += 1
    np.add.at(mark, at + length, -1)
    return np.cumsum(mark)[:-1] > 0


def repeated_words(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text: words without repeats of `words` or more.

    A word `[^\\x20\\x09-\\x0D]+` goes if a window of `words` words that covers it
    occurs earlier: in a document with a smaller id, or earlier in the same one.
    Windows are judged on the input. See the head of this module for the way.

    Null or empty text: no words, the digest of nothing. Fewer than `words`
    words: kept whole. Very long texts are read whole, by one task each, their windows in
    parts; a very long word is one word. Ties (equal rows): the smaller id keeps its
    words. Rows that share an id, or have none: see with_row_ids().
    Other columns are ignored; an empty table gives an empty result.
    """
    if not 2 <= words <= 40:
        raise ValueError("a window has 2 to 40 words")
    own = with_row_ids(docs)
    rows = own.join(later_windows(own, words), RID, "left").select("doc_id", "text", "cut")

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, gone, digest, text = [], [], [], []
            for x, cut in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                w = (x or "").encode().split()
                kept = [w[i] for i in np.flatnonzero(~removed_mask(len(w), cut, words)).tolist()] if cut else w
                out = b" ".join(kept)
                n.append(len(w))
                gone.append(len(w) - len(kept))
                digest.append(hashlib.sha256(out).hexdigest())
                text.append(out.decode())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string()), pa.array(text, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return map_arrow(rows, fn, OUT)
