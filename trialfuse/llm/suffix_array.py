"""Substring dedup over bytes, by bucket-pointer refinement of suffixes.

1. Suffixes are put into buckets by a q-gram. One suffix for each window is
   enough: of the q-grams in a `length`-byte window one is chosen by its
   content alone (the leftmost of the smallest name), so equal windows choose
   the same one at the same place. Buckets of a single document are finished.
2. The suffixes that are left go to their buckets with the bytes around them,
   all that any of their windows can cover. There the places of these bytes
   are sorted into buckets of eight bytes, and each bucket is refined by sorting it on the
   bucket pointers of later offsets: pointers of 8 bytes give those of 16, these those
   of 32, and so on up to `length`. A pointer is overwritten as soon as its bucket
   is refined, and the next level reads it. What shares a bucket with one document only
   is finished at once.

Names (64-bit hashes) choose q-grams and find the buckets of step 1, where a clash
costs work and loses nothing. Step 2 compares the bytes themselves, so results
are exact.

Rows travel as packed columns, one for each bucket and map task. A task sends
equal surroundings once. A q-gram of more suffixes than a bucket should hold has its
windows dealt out one by one: a window is sent once by each task, so no bucket grows with
the largest group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RID, bucket_count, by_group, chunks_of_docs, joined, map_arrow, mix, pack, pack_sorted, settle, text_bytes, unpack, unpack_sorted, utf8, with_row_ids

BYTES, QGRAM = 50, 26
#: Suffixes of a q-gram above which its windows are dealt out one by one, and q-grams that may be so at most.
HOT, HOT_NAMES = 20_000, 1 << 24
CHUNK_BYTES, FLUSH, FLUSH_ROWS, BATCH = 1 << 19, 2_000_000, 150_000, 4096
OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
SAMPLED = "bucket int, k binary, d binary, p binary, n binary, open_d binary, open_p binary"
OPENED = "bucket int, open_d binary, open_p binary, hot binary"
AROUND = "bucket int, rows binary, many binary, d binary, lo binary, cut_d binary, cut_lo binary, cut_mask binary"
CUT = "bucket int, cut_d binary, cut_lo binary, cut_mask binary"


def _bucket_of(names: np.ndarray, buckets: int) -> np.ndarray:
    return ((names.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % buckets


def _starts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)


class Suffixes:
    """The chosen suffixes of some documents, whose bytes stand `length` empty bytes apart."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int, q: int):
        self.length, self.q, self.reach = length, q, length - q
        n, sizes = len(offsets) - 1, np.diff(offsets)
        self.first = np.cumsum(np.r_[0, sizes[:-1] + length]) + length if n else np.zeros(0, np.int64)
        self.buf = np.zeros(int(sizes.sum()) + length * (n + 2) + 8, np.uint8)
        units = data[offsets[0] : offsets[-1]]
        self.buf[np.arange(len(units)) + np.repeat(self.first - np.cumsum(np.r_[0, sizes[:-1]]), sizes)] = units
        self.words = np.lib.stride_tricks.as_strided(self.buf, (len(self.buf) - 7, 8), (1, 1)).copy().view("<u8").ravel()
        many = np.maximum(sizes - length + 1, 0)  # windows of each document
        total = int(many.sum())
        start = np.repeat(self.first - np.cumsum(np.r_[0, many[:-1]]), many) + np.arange(total) if n else np.zeros(0, np.int64)
        at = self._chosen()[start]
        head = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if total else np.zeros(0, np.int64)
        self.at = at[head]
        self.doc = np.searchsorted(self.first, self.at, side="right") - 1
        self.p = self.at - self.first[self.doc]
        #: the first and last window that chose it
        self.lo = start[head] - self.first[self.doc]
        self.hi = start[np.r_[head[1:], total] - 1] - self.first[self.doc] if total else self.lo.copy()

    def _chosen(self) -> np.ndarray:
        """For each place, the chosen q-gram of the window that starts there."""
        half = min(8, self.q - 8)
        order = mix(self.words[: len(self.words) - half], self.words[half:])
        m = (order & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(order), dtype=np.uint64)
        width, w = 1, self.reach + 1
        while width * 2 <= w:
            m = np.minimum(m[:-width], m[width:])
            width *= 2
        if width < w:
            m = np.minimum(m[: -(w - width)], m[w - width :])
        return (m & np.uint64(0xFFFFFFFF)).astype(np.int64)

    def names(self) -> np.ndarray:
        out = np.full(len(self.at), self.q, np.uint64)
        for off in (*range(0, self.q - 8, 8), self.q - 8):
            out = mix(self.words[self.at + off], out)
        return mix(out, 1)

    def around(self, at: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Bytes from `reach` before to `length` after each place; those not within [at - left, at + right) are zero."""
        i = np.arange(-self.reach, self.length)
        rows = self.buf[at[:, None] + i]
        rows[(i < -left[:, None]) | (i >= right[:, None])] = 0
        return rows


def pieces(data: np.ndarray, offsets: np.ndarray, length: int, q: int) -> Iterator[tuple[int, int, int, Suffixes]]:
    """(i, j, base, suffixes) of documents i to j; windows of a longer document come in parts, which start at byte base."""
    for i, j in chunks_of_docs(offsets, CHUNK_BYTES):
        begin, end = int(offsets[i]), int(offsets[j])
        if j > i + 1 or end - begin <= 2 * CHUNK_BYTES:
            yield i, j, 0, Suffixes(data, offsets[i : j + 1], length, q)
            continue
        for base in range(0, end - begin, CHUNK_BYTES):
            s = Suffixes(data, np.array([begin + base, min(begin + base + CHUNK_BYTES + length - 1, end)]), length, q)
            for x in (s.p, s.lo, s.hi):
                x += base
            yield i, j, base, s


def _sampled(length: int, q: int, buckets: int):
    """Map: the chosen suffixes by name. A name that meets two documents in a task is sent once."""

    def flush(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        k, d, p = (np.concatenate(x) for x in zip(*parts, strict=True))
        o = np.argsort(k, kind="stable")
        k, d, p = k[o], d[o], p[o]
        head = _starts(k)
        size = np.diff(np.r_[head, len(k)])
        shared = np.minimum.reduceat(d, head) != np.maximum.reduceat(d, head)
        of = np.repeat(np.arange(len(head)), size)
        send = ~shared[of]
        send[head] = True
        n = np.where(shared, size, 1)[of]
        rows: dict[int, list] = {}
        for b, *x in by_group(_bucket_of(k[send], buckets), k[send], d[send], p[send], n[send]):
            rows[int(b)] = [pack_sorted(x[0]), pack(x[1]), pack(x[2].astype(np.uint32)), pack(x[3].astype(np.uint32)), None, None]
        for b, *x in by_group(_bucket_of(d[~send], buckets), d[~send], p[~send]):
            rows.setdefault(int(b), [None] * 6)[4:] = [pack(x[0]), pack(x[1].astype(np.uint32))]
        yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int32()), *(pa.array([r[i] for r in rows.values()], pa.binary()) for i in range(6))], names=["bucket", "k", "d", "p", "n", "open_d", "open_p"])

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = utf8(batch.column(1))
            for i, j, _, s in pieces(data, offsets, length, q):
                if len(s.at):
                    parts.append((s.names(), ids[i:j][s.doc], s.p))
                    n += len(s.at)
                if n >= FLUSH:
                    yield from flush(parts)
                    parts, n = [], 0
        if parts:
            yield from flush(parts)

    return fn


def _opened(buckets: int, hot: int):
    """Reduce: the places of names that occur in two documents, and the names of more than `hot` suffixes."""

    def fn(t: pa.Table) -> pa.Table:
        get = lambda name, f: [f(x) for x in t.column(name).to_pylist() if x is not None]
        k, d, p, n = joined(get("k", unpack_sorted), np.uint64), joined(get("d", unpack), np.int64), joined(get("p", unpack), np.uint32), joined(get("n", unpack), np.uint32)
        o = np.argsort(k, kind="stable")
        k, d, p, n = k[o], d[o], p[o], n[o].astype(np.int64)
        head = _starts(k)
        often = np.zeros(0, np.uint64)
        keep = np.zeros(0, bool)
        if len(k):
            shared = (np.minimum.reduceat(d, head) != np.maximum.reduceat(d, head)) | (np.maximum.reduceat(n, head) > 1)
            keep = np.repeat(shared, np.diff(np.r_[head, len(k)]))
            often = k[head[shared & (np.add.reduceat(n, head) > hot)]]
        d = np.concatenate([d[keep], *get("open_d", unpack)])
        p = np.concatenate([p[keep], *get("open_p", unpack)])
        rows = [(int(b), pack(x), pack(y), None) for b, x, y in by_group(_bucket_of(d, buckets), d, p)]
        if len(often):
            rows.append((-1, None, None, often.astype("<u8").tobytes()))
        return pa.table([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2, 3))], names=["bucket", "open_d", "open_p", "hot"])

    return fn


def _open_by_document(t: pa.Table) -> pa.Table:
    d, p = (joined((unpack(x) for x in t.column(c).to_pylist()), np.int64) for c in ("open_d", "open_p"))
    rows = [(int(x), np.unique(y).astype("<u4").tobytes()) for x, y in by_group(d, p)]
    return pa.table([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=[RID, "open"])


def _names_of_rows(rows: np.ndarray) -> np.ndarray:
    w = np.ascontiguousarray(rows).view("<u8")
    out = np.full(len(w), w.shape[1], np.uint64)
    for i in range(w.shape[1]):
        out = mix(out ^ w[:, i], i + 1)
    return out


def distinct_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first of each distinct row, which of these each row is): found by names, settled by the bytes."""
    names = _names_of_rows(rows)
    _, first, which = np.unique(names, return_index=True, return_inverse=True)
    if not (rows == rows[first[which]]).all():  # names clash: sort the bytes
        w = np.ascontiguousarray(rows).view("<u8")
        o = np.lexsort(w.T)
        new = np.r_[True, (w[o][1:] != w[o][:-1]).any(axis=1)]
        which = np.empty(len(rows), np.int64)
        which[o] = np.cumsum(new) - 1
        first = o[new]
    return first, which


def _width(length: int, q: int) -> int:
    """Bytes of a row: the surroundings, least and most distance of a window's start, and zeros up to whole words."""
    return -(-(2 * length - q + 2) // 8) * 8


def _around(length: int, q: int, buckets: int, often: np.ndarray):
    """Map: the distinct surroundings of opened suffixes. A later document's equal surroundings are cut at once. often: names of hot q-grams."""
    reach, width = length - q, _width(length, q)

    def flush(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        rows, to, d, lo, span = (np.concatenate(x) for x in zip(*parts, strict=True))
        first, which = distinct_rows(rows)
        low = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(low, which, d)
        later = d > low[which]
        out: dict[int, list] = {}
        o = np.flatnonzero(~later)
        o = o[np.lexsort((which[o], to[first[which[o]]]))]
        for b, at in by_group(to[first[which[o]]], o):
            head = _starts(which[at])
            out[int(b)] = [pack(rows[at[head]].reshape(-1)), pack(np.diff(np.r_[head, len(at)]).astype(np.uint32)), pack(d[at]), pack(lo[at].astype(np.uint32)), None, None, None]
        full = ((np.uint64(1) << span[later].astype(np.uint64)) - np.uint64(1)).astype(np.uint32)
        for b, *x in by_group(_bucket_of(d[later], buckets), d[later], lo[later].astype(np.uint32), full):
            out.setdefault(int(b), [None] * 7)[4:] = [pack(y) for y in x]
        names = [x.split()[0] for x in AROUND.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), *(pa.array([r[i] for r in out.values()], pa.binary()) for i in range(7))], names=names)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = utf8(batch.column(1))
            places = batch.column(2).to_pylist()
            for i, j, base, s in pieces(data, offsets, length, q):
                opened = np.concatenate([np.frombuffer(x, "<u4").astype(np.int64) + (s.first[c] - base) for c, x in enumerate(places[i:j])])
                k = np.flatnonzero(np.isin(s.at, opened, assume_unique=True))
                names = s.names()[k]
                single = np.isin(names, often)
                # each: one suffix with all its windows, or one window of a hot q-gram
                spans = [(k[~single], s.lo[k[~single]], s.hi[k[~single]])]
                h = k[single]
                if len(h):
                    many = s.hi[h] - s.lo[h] + 1
                    each = np.repeat(h, many)
                    lo = np.repeat(s.lo[h] - np.cumsum(np.r_[0, many[:-1]]), many) + np.arange(int(many.sum()))
                    spans.append((each, lo, lo))
                for kind, (x, lo, hi) in enumerate(spans):
                    for a in range(0, len(x), FLUSH_ROWS):
                        y, y_lo, y_hi = x[a : a + FLUSH_ROWS], lo[a : a + FLUSH_ROWS], hi[a : a + FLUSH_ROWS]
                        most, least = s.p[y] - y_lo, s.p[y] - y_hi
                        rows = np.zeros((len(y), width), np.uint8)
                        rows[:, : reach + length] = s.around(s.at[y], most, length - least)
                        rows[:, reach + length], rows[:, reach + length + 1] = least, most
                        to = _bucket_of(_names_of_rows(rows) if kind else names[~single][a : a + FLUSH_ROWS], buckets)
                        parts.append((rows, to, ids[i:j][s.doc[y]], y_lo, y_hi - y_lo + 1))
                        n += len(y)
                        if n >= FLUSH_ROWS:
                            yield from flush(parts)
                            parts, n = [], 0
        if parts:
            yield from flush(parts)

    return fn


def refine(rows: np.ndarray, docs: np.ndarray, length: int, q: int) -> np.ndarray:
    """For each row of surroundings, a bit for each of its windows, from the first: it starts in a smaller document.

    docs: the document of each row. Windows are equal only where the q-gram and
    its place in them are, so a bucket holds places at one distance from one q-gram.
    """
    reach, size = length - q, 2 * length - q
    out = np.zeros(len(rows), np.uint32)
    words = np.lib.stride_tricks.sliding_window_view(rows, 8, axis=1)[:, : size - 7]
    core = np.stack([np.ascontiguousarray(words[:, reach + o]).view("<u8")[:, 0] for o in (*range(0, q - 8, 8), q - 8)])
    order = np.lexsort(core)
    new = np.r_[True, (core[:, order][:, 1:] != core[:, order][:, :-1]).any(axis=0)] if len(rows) else np.zeros(0, bool)
    group = np.empty(len(rows), np.int64)
    group[order] = np.cumsum(new) - 1
    head = np.flatnonzero(new)
    some = np.minimum.reduceat(docs[order], head) != np.maximum.reduceat(docs[order], head) if len(rows) else new
    order = order[some[group[order]]]  # a q-gram of one document is finished
    ends = np.r_[_starts(group[order]), len(order)]
    at = 0
    while at < len(ends) - 1:  # whole groups of q-grams, some thousand rows at once
        to = min(max(int(np.searchsorted(ends, ends[at] + BATCH, side="right")) - 1, at + 1), len(ends) - 1)
        c = order[ends[at] : ends[to]]
        at = to
        begin, end = reach - rows[c, size + 1].astype(np.int64), reach - rows[c, size].astype(np.int64) + length
        doc, base = docs[c], np.arange(len(c)) * size
        pointer = np.full(len(c) * size, -1, np.int64)
        span = end - begin - 7
        x = np.repeat(base + begin - np.cumsum(np.r_[0, span[:-1]]), span) + np.arange(int(span.sum()))
        row, held = x // size, x
        last = (base + end)[row]
        value = np.ascontiguousarray(words[c]).view("<u8")[:, :, 0].ravel()[row * (size - 7) + x % size]
        place = group[c][row] * size + x % size
        sort = np.lexsort((value, place))
        new = np.r_[True, (value[sort][1:] != value[sort][:-1]) | (place[sort][1:] != place[sort][:-1])]
        now = 8
        while True:
            heads = np.flatnonzero(new)
            d = doc[row[sort]]
            low = np.minimum.reduceat(d, heads)
            live = low != np.maximum.reduceat(d, heads)
            which = np.cumsum(new) - 1
            if now == length:
                hit = sort[d > low[which]]
                np.bitwise_or.at(out, c[row[hit]], np.uint32(1) << (x[hit] - (base + begin)[row[hit]]).astype(np.uint32))
                break
            pointer[held] = -1  # also of places that are finished since
            held, kept = x, live[which]
            pointer[x[sort[kept]]] = which[kept]
            later = now if now * 2 <= length else length - now
            now = min(now * 2, length)
            keep = (pointer[x] >= 0) & (x + now <= last)
            x, row, last = x[keep], row[keep], last[keep]
            keep = pointer[x + later] >= 0
            x, row, last = x[keep], row[keep], last[keep]
            if not len(x):
                break
            key = pointer[x] * len(heads) + pointer[x + later]
            sort = np.argsort(key, kind="stable")
            new = np.r_[True, key[sort][1:] != key[sort][:-1]]
    return out


def _refined(length: int, q: int, buckets: int) -> Callable[[pa.Table], pa.Table]:
    """Reduce: the windows of each suffix that start in a smaller document."""
    width, size = _width(length, q), 2 * length - q

    def fn(t: pa.Table) -> pa.Table:
        get = lambda name, kind: joined((unpack(x) for x in t.column(name).to_pylist() if x is not None), kind)
        rows, many, d, lo = get("rows", np.uint8).reshape(-1, width), get("many", np.uint32), get("d", np.int64), get("lo", np.uint32)
        cut = [[get("cut_d", np.int64)], [get("cut_lo", np.uint32)], [get("cut_mask", np.uint32)]]
        if len(rows):
            first, which = distinct_rows(rows)
            rows = rows[first]
            which = np.repeat(which, many)
            low = np.full(len(first), np.iinfo(np.int64).max)
            np.minimum.at(low, which, d)
            span = (rows[:, size + 1].astype(np.int64) - rows[:, size] + 1).astype(np.uint64)
            full = ((np.uint64(1) << span) - np.uint64(1)).astype(np.uint32)
            mask = np.where(d > low[which], full[which], refine(rows, low, length, q)[which])
            hit = mask > 0
            for to, x in zip(cut, (d, lo, mask), strict=True):
                to.append(x[hit])
        d, lo, mask = (np.concatenate(x) for x in cut)
        out = [(int(b), *map(pack, x)) for b, *x in by_group(_bucket_of(d, buckets), d, lo, mask)]
        return pa.table([pa.array([r[0] for r in out], pa.int32()), *(pa.array([r[i] for r in out], pa.binary()) for i in (1, 2, 3))], names=[x.split()[0] for x in CUT.split(", ")])

    return fn


def _cut_by_document(t: pa.Table) -> pa.Table:
    """The starts of windows to cut, of each document in one row."""
    d, lo, mask = (joined((unpack(x) for x in t.column(c).to_pylist()), np.int64) for c in ("cut_d", "cut_lo", "cut_mask"))
    rows = []
    for doc, a, m in by_group(d, lo, mask):
        at = np.concatenate([a[(m >> i & 1) > 0] + i for i in range(32)])
        rows.append((int(doc), np.unique(at).astype("<u4").tobytes()))
    return pa.table([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=[RID, "cut"])


def later_windows(docs: DataFrame, length: int = BYTES, q: int = QGRAM) -> DataFrame:
    """(_rid, cut binary): the starts, as packed <u4, of windows that also start in a document of smaller _rid.

    docs: (_rid, text).
    """
    own = docs.select(RID, "text")
    size = text_bytes(own)
    entries = int(size * 2 / (length - q + 2))
    buckets, wide = bucket_count(own.sparkSession, entries), bucket_count(own.sparkSession, entries / 2, 200_000)
    dealt = lambda df, n: df.repartition(n, "bucket").groupBy("bucket")
    opened = settle(dealt(map_arrow(own, _sampled(length, q, buckets), SAMPLED), buckets).applyInArrow(_opened(buckets, max(HOT, entries // HOT_NAMES)), OPENED), "opened")
    hot = opened.filter("hot is not null").select("hot").collect()  # HOT_NAMES at most
    hot = np.sort(joined((np.frombuffer(r[0], "<u8") for r in hot), np.uint64))
    places = dealt(opened.filter("open_d is not null").select("bucket", "open_d", "open_p"), buckets).applyInArrow(_open_by_document, f"{RID} long, open binary")
    around = map_arrow(own.join(places, RID).select(RID, "text", "open"), _around(length, q, wide, hot), AROUND)
    cut = settle(dealt(around, wide).applyInArrow(_refined(length, q, wide), CUT), "cut")
    return dealt(cut, wide).applyInArrow(_cut_by_document, f"{RID} long, cut binary")


def removed_mask(size: int, cut: bytes | None, length: int) -> np.ndarray:
    """Bytes that a window to cut covers."""
    mark = np.zeros(size + 1, np.int64)
    at = np.frombuffer(cut or b"", "<u4").astype(np.int64)
    mark[at] += 1
    np.add.at(mark, at + length, -1)
    return np.cumsum(mark)[:-1] > 0


def repeated_bytes(docs: DataFrame, length: int = BYTES, qgram: int = QGRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept: bytes without strings of other documents.

    A byte goes if a `length`-byte string that covers it also starts in a
    document with a smaller id; strings are judged on the input and never
    cross documents. See the head of this module for the way.

    Null or empty text: no bytes, the digest of nothing. Shorter than
    `length`: kept whole. Very long texts are read whole, by one task each in parts of half a megabyte; a
    text of one repeated byte has each suffix chosen. Ties (equal rows): the smaller id keeps its bytes. Rows that share an
    id, or have none, are earlier and later documents: see with_row_ids(). Other columns are ignored; an empty table gives an empty
    result. kept may be invalid UTF-8 where a character lost some of its bytes.
    """
    if not 9 <= qgram < length or length - qgram > 31 or length > 200:
        raise ValueError("9 <= qgram < length <= 200, and at most 31 bytes between them")
    own = with_row_ids(docs)
    rows = own.join(later_windows(own, length, qgram), RID, "left").select("doc_id", "text", "cut")

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, gone, spans, digest, kept = [], [], [], [], []
            for x, cut in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                raw = (x or "").encode()
                out, lost, runs = raw, 0, 0
                if cut:
                    mask = removed_mask(len(raw), cut, length)
                    out = np.frombuffer(raw, np.uint8)[~mask].tobytes()
                    lost = len(raw) - len(out)
                    runs = int(np.count_nonzero(np.diff(mask.astype(np.int8), prepend=0) == 1))
                n.append(len(raw))
                gone.append(lost)
                spans.append(runs)
                digest.append(hashlib.sha256(out).hexdigest())
                kept.append(out)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(v, pa.int64()) for v in (n, gone, spans)), pa.array(digest, pa.string()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return map_arrow(rows, fn, OUT)
