"""SimHash near-duplicates, candidates by Golay-code fuzzy hashing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RID, bucket_count, components, joined, map_arrow, mix, pack, pack_sorted, settle, unpack, unpack_sorted, with_row_ids

SHINGLE, BITS, SEED = 4, 4, 42
#: 64 = 22 + 21 + 21. With 4 bits wrong, some two segments have at most 2 wrong between them.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    k = min(shingle, len(words))
    xx = xxhash.xxh64_intdigest
    h = np.fromiter((xx(line[s:e], SEED) for s, e in zip(start[: len(words) - k + 1].tolist(), end[k - 1 :].tolist(), strict=True)), np.uint64, len(words) - k + 1)
    votes = np.zeros(64, np.int64)
    for i in range(0, len(h), 4096):
        votes += np.unpackbits(h[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(_rid, doc_id, fp long)."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(x.as_py(), shingle) for x in b.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp)], names=[RID, "doc_id", "fp"])

    return map_arrow(docs.select(RID, "doc_id", "text"), fn, f"{RID} long, doc_id long, fp long")


@cache
def golay() -> np.ndarray:
    """Index of the codeword of the binary (23, 12) Golay code within 3 bits of each 23-bit word."""
    message = np.arange(4096, dtype=np.uint32)
    rest = message << 11
    for bit in range(22, 10, -1):  # systematic form, generator x^11+x^9+x^7+x^6+x^5+x+1
        rest = np.where(rest >> bit & 1, rest ^ (np.uint32(0b101011100011) << (bit - 11)), rest)
    words = (message << 11) | rest
    one = np.uint32(1) << np.arange(23, dtype=np.uint32)
    a, b, c = np.meshgrid(one, one, one, indexing="ij")
    errors = np.unique(np.concatenate([[np.uint32(0)], one, (a | b | c).ravel()]))
    errors = errors[np.bitwise_count(errors) <= 3]
    table = np.zeros(1 << 23, np.int16)
    for i in range(0, len(errors), 64):
        table[words[:, None] ^ errors[None, i : i + 64]] = message[:, None].astype(np.int16)
    return table


def nearby(segment: np.ndarray, bits: int) -> np.ndarray:
    """(n, 6) codeword indices, -1 where fewer: words at most 2 bits apart share one.

    A word between two such words is at most one bit from either, and its
    codeword is among those of all words at most one bit away.
    """
    table = golay()
    x = segment.astype(np.uint32)
    near = np.sort(np.stack([table[x], *(table[x ^ np.uint32(1 << i)] for i in range(bits))], axis=1), axis=1)
    new = np.concatenate([np.ones((len(x), 1), bool), near[:, 1:] != near[:, :-1]], axis=1)
    out = np.full((len(x), 6), -1, np.int32)
    row, col = np.nonzero(new)
    rank = (np.cumsum(new, axis=1) - 1)[row, col]
    out[row, rank] = near[row, col]
    return out


def keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, row): fingerprints at most 4 bits apart share a key."""
    found = [nearby(fp >> np.uint64(at) & np.uint64((1 << n) - 1), n) for at, n in SEGMENTS]
    out_k, out_r = [], []
    for which, (a, b) in enumerate(PAIRS):
        for i in range(6):
            for j in range(6):
                row = np.flatnonzero((found[a][:, i] >= 0) & (found[b][:, j] >= 0))
                out_k.append((which << 24 | found[a][row, i] << 12 | found[b][row, j]).astype(np.uint32))
                out_r.append(row)
    return np.concatenate(out_k), np.concatenate(out_r)


def linked(fp: np.ndarray, bits: int, block: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(member, root) places that span the components of fp, not all pairs.

    Each place is compared once with those not yet reached.
    """
    left = np.arange(len(fp))
    while len(left) > 1:
        root, left = left[:1], left[1:]
        edge = root
        while len(edge) and len(left):
            now, edge = edge[:block], edge[block:]
            hit = (np.bitwise_count(fp[now][:, None] ^ fp[left][None, :]) <= bits).any(axis=0)
            if hit.any():
                yield left[hit], np.full(int(hit.sum()), root[0])
                edge, left = np.concatenate([edge, left[hit]]), left[~hit]


def spanning_links(key: np.ndarray, fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) of verified links that connect what shares a key. key is sorted."""
    a, b = [], []
    n = len(key)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[cut, n])
    most = 24
    small = np.repeat(size <= most, size)
    at = np.flatnonzero(small)
    for off in range(1, most):
        at = at[at + off < n]
        at = at[key[at] == key[at + off]]
        if not len(at):
            break
        ok = at[np.bitwise_count(fp[at] ^ fp[at + off]) <= bits]
        a.append(ok)
        b.append(ok + off)
    for s, m in zip(cut[size > most].tolist(), size[size > most].tolist(), strict=True):
        for x, y in linked(fp[s : s + m], bits):
            a.append(x + s)
            b.append(y + s)
    return joined(a, np.int64), joined(b, np.int64)


def near_links(classes: DataFrame, bits: int = BITS) -> DataFrame:
    """(a, b) representatives whose fingerprints differ in at most `bits` bits, enough to connect all.

    classes: (fp, rep), one row for each distinct fingerprint.
    """
    if bits > 4:
        raise ValueError("the segments serve up to 4 bits")
    spark = classes.sparkSession
    n = classes.count()
    buckets = bucket_count(spark, n * 85)

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Fingerprints and their documents, a bounded number at once."""
        parts, n = [], 0
        for b in batches:
            parts.append((b.column(0).to_numpy(zero_copy_only=False).view(np.uint64), b.column(1).to_numpy(zero_copy_only=False)))
            n += b.num_rows
            if n >= 20000:
                yield tuple(np.concatenate(x) for x in zip(*parts, strict=True))
                parts, n = [], 0
        if n:
            yield tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fp, rep in gathered(batches):
            key, row = keys(fp)
            to = (mix(key.astype(np.uint64)) >> np.uint64(33)).astype(np.int64) % buckets
            order = np.lexsort((key, to))
            key, row, to = key[order], row[order], to[order]
            cut = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
            ends = np.r_[cut[1:], len(to)]
            cols = [(int(to[s]), pack_sorted(key[s:e]), fp[row[s:e]].tobytes(), pack(rep[row[s:e]])) for s, e in zip(cut.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([c[0] for c in cols], pa.int32()), *(pa.array([c[i] for c in cols], pa.binary()) for i in (1, 2, 3))], names=["bucket", "k", "fp", "rep"])

    def meet(t: pa.Table) -> pa.Table:
        key = joined(map(unpack_sorted, t.column("k").to_pylist()), np.uint32)
        fp = joined((np.frombuffer(x, np.uint64) for x in t.column("fp").to_pylist()), np.uint64)
        rep = joined(map(unpack, t.column("rep").to_pylist()), np.int64)
        order = np.argsort(key, kind="stable")
        key, fp, rep = key[order], fp[order], rep[order]
        a, b = spanning_links(key, fp, bits)
        pairs = np.unique(np.stack([np.minimum(rep[a], rep[b]), np.maximum(rep[a], rep[b])], axis=1), axis=0)
        return pa.table([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    even = classes.select("fp", "rep").repartition(int(max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // 20000 + 1)), "fp")
    return map_arrow(even, spread, "bucket int, k binary, fp binary, rep binary").repartition(buckets, "bucket").groupBy("bucket").applyInArrow(meet, "a long, b long")


def simhash_groups(docs: DataFrame, bits: int = BITS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint, component_id, class_id, is_first, _rid: one row for each document.

    A-Z in lower case, words `[^\\x20\\x09-\\x0D]+`, shingles of `shingle` words
    (fewer words: the whole sequence; none: fingerprint zero). Fingerprints
    at most `bits` bits apart link; component_id is the smallest id reachable,
    class_id the smallest id with the same fingerprint, is_first marks one document of each component. Equal fingerprints are one class
    before any key is made. Keys: two of three segments, each decoded to
    the nearby codewords of the Golay code; links are verified on all 64 bits.

    Null and empty texts have fingerprint zero and link like any other. A bit set in exactly half
    the hashes is 0. Very long texts are read whole, by one task each, and repeated rows
    are one class. Rows that share an
    id, or have none: see with_row_ids(). Other columns are ignored; an empty
    table gives an empty result.
    """
    return groups_of(with_row_ids(docs), bits, shingle)


def groups_of(own: DataFrame, bits: int = BITS, shingle: int = SHINGLE) -> DataFrame:
    """The same of rows from with_row_ids()."""
    prints = settle(fingerprints(own, shingle), "prints")
    classes = settle(prints.groupBy("fp").agg(F.min(RID).alias("rep"), F.min("doc_id").alias("class_id")), "classes")
    found = components(near_links(classes, bits)).withColumnRenamed("node", "rep")
    label = settle(classes.join(found, "rep", "left").select("fp", "class_id", F.coalesce("component", "rep").alias("first")), "labels")
    lowest = label.groupBy("first").agg(F.min("class_id").alias("component_id"))
    out = prints.join(label.join(lowest, "first"), "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "class_id", (F.col(RID) == F.col("first")).alias("is_first"), RID)
