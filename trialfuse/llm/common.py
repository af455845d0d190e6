"""Shared pieces: row ids, written intermediate tables, packed columns, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RID = "_rid"
ARROW_ROWS = 1000
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a local one only where none is named (tests, local mode)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="spark-")
    return _OWN[app]


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write df into the shared folder and read it back: cuts lineage, survives lost executors.

    The plan runs this once, so Spark drops its shuffle files when the write is done.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what settle() wrote, once nothing reads it any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.settled_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def arrow_batches(spark: SparkSession) -> None:
    """Small Arrow batches: a batch of very long texts still fits a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def with_row_ids(df: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """(doc_id, text, carry..., _rid): _rid is the id where ids are unique and not null.

    Otherwise rows that share an id, or have none, count as documents of their
    own, ordered by (id, nulls first; hash of text and what is carried; place in the input), and _rid ascends
    in that order: one range-partitioned sort, whose keys are short and which parts rows of one id too.
    """
    own = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carry)
    seen = own.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("doc_id").isNull() | (F.col("n") > 1))
    if seen.isEmpty():
        return own.withColumn(RID, F.col("doc_id"))
    placed = own.withColumn("_h", F.xxhash64("text", *carry)).withColumn("_in", F.monotonically_increasing_id())
    placed = placed.sort(F.asc_nulls_first("doc_id"), "_h", "_in").drop("_h", "_in")
    return settle(placed.withColumn(RID, F.monotonically_increasing_id()), "rows")


def text_bytes(df: DataFrame, text_col: str = "text") -> int:
    return df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0


def bucket_count(spark: SparkSession, entries: float, per_bucket: int = 1_500_000) -> int:
    """Buckets of bounded size: their number follows the data."""
    return int(max(int(spark.conf.get("spark.sql.shuffle.partitions")), entries // per_bucket + 1))


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary()) if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else col.cast(pa.large_string())
    if col.null_count:
        col = pc.fill_null(col, "" if pa.types.is_large_string(col.type) else b"")
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64, len(col) + 1, col.offset * 8) if len(col) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(a: np.ndarray, b: np.ndarray | int = 0) -> np.ndarray:
    """64-bit name of a pair of names."""
    x = a * _M1
    x ^= x >> np.uint64(29)
    x += b if isinstance(b, np.ndarray) else np.uint64(b)
    x *= _M2
    x ^= x >> np.uint64(32)
    return x


def mix2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(mix(a, b), 0x165667B19E3779F9)


def pack(a: np.ndarray) -> bytes:
    """Compressed, byte plane by byte plane."""
    a = np.ascontiguousarray(a)
    head = a.dtype.str.encode().ljust(4)
    planes = a.view(np.uint8).reshape(-1, a.itemsize).T if len(a) else np.zeros((0, 0), np.uint8)
    return head + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(b: bytes) -> np.ndarray:
    kind = np.dtype(b[:4].decode().strip())
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b[4:]), np.uint8)
    return np.ascontiguousarray(raw.reshape(kind.itemsize, -1).T).reshape(-1).view(kind)


def pack_sorted(a: np.ndarray) -> bytes:
    """For ascending integers."""
    return pack(np.diff(a, prepend=a.dtype.type(0)))


def unpack_sorted(b: bytes) -> np.ndarray:
    a = unpack(b)
    return np.cumsum(a, dtype=a.dtype)


def joined(parts: Iterable[np.ndarray], kind) -> np.ndarray:
    parts = list(parts)
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def by_group(keys: np.ndarray, *values: np.ndarray) -> Iterator[tuple]:
    """(key, values...) of each key; a stable grouping."""
    if not len(keys):
        return
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    cut = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    ends = np.r_[cut[1:], len(k)]
    cols = [v[order] for v in values]
    for s, e in zip(cut.tolist(), ends.tolist(), strict=True):
        yield (k[s], *(c[s:e] for c in cols))


#: Powers of a fixed odd base and their inverses modulo 2**64, and a fixed random table of bytes.
_BASE = 0xD6E8FEB86659FD93
_POW: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
BYTE_NAMES = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW[0]) < n:
        n = 1 << n.bit_length()
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            with np.errstate(over="ignore"):
                _POW[i] = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, base, np.uint64)], dtype=np.uint64)
    return _POW[0], _POW[1]


SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True


def word_names(data: np.ndarray, names: np.ndarray = BYTE_NAMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, start, end) of each word [^\\x20\\x09-\\x0D]+ of the bytes."""
    gap = np.r_[True, SPACES[data], True]
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    start, end = edge[::2], edge[1::2]
    up, down = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(names[data] * up[: len(data)], out=total[1:])
        h = (total[end] - total[start]) * down[start]
        h = mix(h, (end - start).astype(np.uint64))
    return h, start, end


def chunks_of_docs(offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """[i, j) ranges of documents of about `size` bytes; a longer document stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    arrow_batches(df.sparkSession)
    return df.mapInArrow(fn, schema)


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 50) -> DataFrame:
    """(node, component): the smallest node that is reachable.

    Alternating large and small stars; each round is written to the shared
    folder. A hub's rows are pre-aggregated by min() before they are shuffled,
    and its join is split by AQE.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    e = settle(e, "edges")
    last = None
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, e = e, settle(small.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "edges")
        discard(before)
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components: no fixed point")
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
