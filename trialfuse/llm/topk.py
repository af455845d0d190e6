"""Exact top-k inner products by an impact-ordered index, read score at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batches, settle
from .vectors import integer_vectors, matrix

K, EVERY = 20, 20
#: Classes of one index block and of one block of queries.
INDEX_BLOCK, QUERY_BLOCK = 65_536, 512
#: Queries that read the index together, and rows of their sums at once.
TOGETHER, ROWS = 64, 512
#: After this share of the postings, the bounds are looked at; so many best guesses are scored for a threshold.
CHECKS, GUESSES = (0.5, 0.6, 0.7, 0.8), 64
#: As soon as no more than this share of a block can still be among the best, the rest is rescored instead.
FEW = 0.25
#: Bytes of an index block that travel as one row, and blocks of queries that meet one copy of an index block, at most.
PIECE, LOT = 1 << 20, 16
#: What a block of the index is made of.
BLOBS = ("x", "ids", "offsets", "dim", "impact", "start", "postings")


def narrow(x: np.ndarray) -> np.ndarray:
    """The same integers in the smallest type that holds them."""
    most = int(np.abs(x).max(initial=0))
    return x.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64)


def classes_of(vectors: DataFrame, k: int) -> DataFrame:
    """(x, ids): each distinct vector with its k + 1 smallest ids; no more can be among the best k of any query."""
    first = Window.partitionBy("x").orderBy("vec_id")
    ids = vectors.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= k + 1)
    return settle(ids.groupBy("x").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "classes")


def index(classes: DataFrame, dims: int, k: int = K, per_block: int = INDEX_BLOCK) -> DataFrame:
    """The index: (block, n, x, ids, offsets, dim, impact, start, postings), one row for each block of classes.

    A posting segment is the list of a block's members with one impact (the integer
    x) in one dimension; segments of a dimension lie by falling impact.
    Every class is in one block; blocks hold `per_block` classes on average.
    """
    blocks = classes.count() // per_block + 1

    def fn(t: pa.Table) -> pa.Table:
        x = narrow(matrix(t.column("x").combine_chunks(), dims))
        lists = t.column("ids").combine_chunks()
        ids = lists.flatten().to_numpy(zero_copy_only=False)
        offsets = np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))].astype(np.int64)
        postings, dim, impact, start = [], [], [], []
        for d in range(dims):
            order = np.argsort(-x[:, d].astype(np.int64), kind="stable")
            v = x[order, d]
            cut = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
            postings.append(order.astype(np.uint16 if len(x) <= 1 << 16 else np.uint32))
            dim.append(np.full(len(cut), d, np.int32))
            impact.append(v[cut].astype(np.int64))
            start.append(cut + d * len(x))
        blobs = {"x": x, "ids": ids, "offsets": offsets, "dim": np.concatenate(dim), "impact": np.concatenate(impact), "start": np.concatenate(start).astype(np.int64), "postings": np.concatenate(postings)}
        return pa.table({"block": t.column("block").slice(0, 1), "n": pa.array([len(x)], pa.int32())} | {name: pa.array([packed(a)], pa.binary()) for name, a in blobs.items()})

    placed = classes.withColumn("block", F.pmod(F.xxhash64("x"), F.lit(blocks)).cast("int"))
    schema = "block int, n int, x binary, ids binary, offsets binary, dim binary, impact binary, start binary, postings binary"
    out = settle(placed.groupBy("block").applyInArrow(fn, schema), "index")
    out.blocks = blocks
    return out


def packed(a: np.ndarray) -> bytes:
    return a.dtype.str.encode().ljust(4) + np.ascontiguousarray(a).tobytes()


def unpacked(b: bytes) -> np.ndarray:
    return np.frombuffer(b, np.dtype(b[:4].decode().strip()), offset=4)


def runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run, one after another."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


class Block:
    """One block of the index, in memory."""

    def __init__(self, row: dict, dims: int):
        self.n = row["n"]
        self.x = unpacked(row["x"]).reshape(self.n, dims)
        self.ids, self.offsets = unpacked(row["ids"]), unpacked(row["offsets"])
        self.dim, self.impact = unpacked(row["dim"]), unpacked(row["impact"])
        self.postings = unpacked(row["postings"]).astype(np.intp)
        self.start = unpacked(row["start"])
        self.end = np.r_[self.start[1:], len(self.postings)]
        self.dims = dims
        self.first = np.searchsorted(self.dim, np.arange(dims))  # of each dimension's segments
        self.most = int(np.abs(self.x.astype(np.int64)).max(initial=0))
        self.real = self.x.astype(np.float32)

    def scores(self, q: np.ndarray, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        most = int(np.abs(q).max(initial=0)) * self.most * self.dims
        if most < 1 << 24:  # floats are exact here, and faster
            return (self.real[at] @ q.astype(np.float32)).astype(np.int64)
        if most >= 1 << 63:
            raise OverflowError("a score is larger than a long")
        return self.x[at].astype(np.int64) @ q

    def possible(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(members, exact scores) that hold all of the block's best k of a query, ties included."""
        return next(self.possibles(q[None], k))

    def possibles(self, asked: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """possible() of some queries, which read the index together.

        Segments are read by falling impact, either sign, times the dimension's largest weight in the queries. A dimension's
        unread segments lie between two impacts, so each member's sum and the number of its dimensions that are still unread
        bound its score from above. The k-th of the exact scores of some guesses is a threshold:
        who can't reach it is out, and reading stops once few are left to nearly all queries.
        """
        k = min(k, self.n)
        most = int(np.abs(asked).max(initial=0)) * self.most * self.dims
        if self.n <= 4 * GUESSES or k > GUESSES or most >= 1 << 61:
            yield from ((np.arange(self.n), self.scores(q)) for q in asked)
            return
        order = np.argsort(-np.abs(self.impact * np.abs(asked).max(axis=0)[self.dim]), kind="stable")
        read = np.cumsum((self.end - self.start)[order])
        kind = np.int32 if most < 1 << 30 else np.int64
        total, unread = np.zeros((self.n, len(asked)), kind), np.full(self.n, self.dims)
        waits, found, threshold = set(range(len(asked))), {}, [-most - 1] * len(asked)
        seen, at = np.zeros(len(order), bool), 0
        for share in CHECKS:
            until = int(np.searchsorted(read, share * len(self.postings)))
            part, at = np.sort(order[at:until]), until
            seen[part] = True
            for own in np.split(part, np.flatnonzero((np.diff(part) != 1) | (np.diff(self.dim[part]) != 0)) + 1) if len(part) else []:
                self._add(total, unread, own, asked[:, self.dim[own[0]]].astype(kind))
            high, low = (f.reduceat(np.where(seen, 0, self.impact), self.first) for f in (np.maximum, np.minimum))
            left = -np.sort(-np.maximum(asked * high, asked * low), axis=1)
            most_left = np.concatenate([np.zeros((len(asked), 1), np.int64), left.cumsum(axis=1)], axis=1).astype(kind)  # of so many unread dimensions
            sums = np.ascontiguousarray(total.T)
            for i in sorted(waits):
                guess = np.argpartition(sums[i], self.n - GUESSES)[-GUESSES:]
                threshold[i] = max(threshold[i], int(np.partition(self.scores(asked[i], guess), GUESSES - k)[GUESSES - k]))
                found[i] = np.flatnonzero(sums[i] + np.take(most_left[i], unread) >= threshold[i])
                if len(found[i]) <= FEW * self.n:
                    waits.discard(i)
            if 4 * len(waits) <= len(asked):
                break
        for i, q in enumerate(asked):
            yield found[i], self.scores(q, found[i])

    def _add(self, total: np.ndarray, unread: np.ndarray, segments: np.ndarray, weights: np.ndarray) -> None:
        """Read neighbouring segments of one dimension, in which no member occurs twice."""
        start, end = int(self.start[segments[0]]), int(self.end[segments[-1]])
        gains = (self.impact[segments, None] * weights).astype(total.dtype)
        which = np.repeat(np.arange(len(segments)), self.end[segments] - self.start[segments])
        unread[self.postings[start:end]] -= 1
        whole = total.view(f"V{total.strides[0]}")[:, 0]  # rows as one value each, which numpy copies faster
        for s in range(start, end, ROWS):
            ids = self.postings[s : min(s + ROWS, end)]
            rows = np.take(total, ids, axis=0, mode="clip")
            rows += np.take(gains, which[s - start : s - start + len(ids)], axis=0, mode="clip")
            whole[ids] = rows.view(whole.dtype)[:, 0]

    def best(self, asked: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, scores) of the k + 1 best rows of the block, for each query: highest score first, ties to the smaller id."""
        for at in range(0, len(asked), TOGETHER):
            for members, score in self.possibles(asked[at : at + TOGETHER], k + 1):
                if len(members) > k + 1:
                    keep = score >= np.partition(score, len(score) - k - 1)[len(score) - k - 1]
                    members, score = members[keep], score[keep]
                count = self.offsets[members + 1] - self.offsets[members]
                ids = self.ids[runs(self.offsets[members], count)]
                score = np.repeat(score, count)
                order = np.lexsort((ids, -score))[: k + 1]
                yield ids[order], score[order]


def lots_of(parts: int, blocks: int, cores: int) -> int:
    """How often a block of the index is sent out: enough for all cores, and once for LOT blocks of queries at least."""
    return min(parts, max(-(-parts // LOT), -(-8 * cores // blocks)))


def pieces(blocks: DataFrame, lots: int) -> DataFrame:
    """(block, lot, n, name, at, bytes): the blocks of the index once for each lot, in rows of PIECE bytes at most."""
    each = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("whole")) for c in BLOBS])
    out = blocks.select("block", "n", F.inline(each))
    last = F.floor((F.octet_length("whole") - 1) / PIECE).cast("int")
    out = out.select("block", "n", "name", "whole", F.explode(F.sequence(F.lit(0), last)).alias("at"))
    out = out.select("block", "n", "name", "at", F.substring("whole", F.col("at") * PIECE + 1, F.lit(PIECE)).alias("bytes"))
    return out.select(F.explode(F.sequence(F.lit(0), F.lit(lots - 1))).alias("lot"), "*")


def put_together(t: pa.Table) -> dict:
    """The row of an index block from its pieces."""
    found: dict[str, dict] = {c: {} for c in BLOBS}
    for name, at, part in zip(t.column("name").to_pylist(), t.column("at").to_pylist(), t.column("bytes").to_pylist(), strict=True):
        found[name][at] = part
    return {"n": t.column("n")[0].as_py()} | {c: b"".join(x[at] for at in sorted(x)) for c, x in found.items()}


def search(blocks: DataFrame, queries: DataFrame, dims: int, k: int = K, per_block: int = QUERY_BLOCK) -> DataFrame:
    """(query, found array<struct<low, vec_id>>): the k + 1 best rows of each query vector, low being the negative score.

    queries: (query long, x). Blocks of queries are single rows. A lot of them meets a block of the index in one group: index
    blocks are large, so they are sent once for each lot, in pieces, and the small rows of queries come to them.
    Spark merges their best rows, k + 1 of each index block for a query.
    """
    spark = queries.sparkSession
    arrow_batches(spark)
    parts = queries.count() // per_block + 1
    lots = lots_of(parts, blocks.blocks, spark.sparkContext.defaultParallelism)

    def gather(t: pa.Table) -> pa.Table:
        x = narrow(matrix(t.column("x").combine_chunks(), dims))
        return pa.table({"part": t.column("part").slice(0, 1), "q": pa.array([packed(x)], pa.binary()), "names": pa.array([packed(t.column("query").to_numpy())], pa.binary())})

    asked = queries.select("query", "x", F.pmod(F.xxhash64("query"), F.lit(parts)).cast("int").alias("part"))
    asked = settle(asked.groupBy("part").applyInArrow(gather, "part int, q binary, names binary"), "asked")
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks.blocks - 1))).alias("block"), (F.col("part") % lots).alias("lot"), "q", "names")
    tasks = max(4 * lots * blocks.blocks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    by = ("block", "lot")

    def fn(own: pa.Table, index: pa.Table) -> pa.Table:
        names, lows, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        block = Block(put_together(index), dims) if len(own) and len(index) else None
        for row in own.to_pylist() if block else []:
            found = list(block.best(unpacked(row["q"]).reshape(-1, dims).astype(np.int64), k))
            names.append(np.repeat(unpacked(row["names"]), [len(f[0]) for f in found]))
            ids += [f[0] for f in found]
            lows += [-f[1] for f in found]
        return pa.table({"query": np.concatenate(names), "low": np.concatenate(lows), "vec_id": np.concatenate(ids)})

    left, right = asked.repartition(tasks, *by).groupBy(*by), pieces(blocks, lots).repartition(tasks, *by).groupBy(*by)
    best = Window.partitionBy("query").orderBy("low", "vec_id")
    found = left.cogroup(right).applyInArrow(fn, "query long, low long, vec_id long").withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= k + 1)
    return found.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("low", "vec_id"))).alias("found"))


def top_k(rows: DataFrame, k: int = K, every: int = EVERY, id_col: str = "vec_id", values_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query, ties to the smaller id.

    x = floor(64 * c). Queries are the rows whose id `every` divides, candidates all rows but the query's own.
    Equal vectors are one class in the index and are asked once; a query's own row is taken
    out of its class's k + 1 best rows afterwards. Scores are exact; a score beyond a long raises.

    Null, empty and not finite vectors, those of another length than most (see
    integer_vectors()), and rows without an id take no part. Rows that share an id are
    rows of their own: each is a candidate of the other. Fewer than k candidates: all of them, or no
    rows for a query alone in the table. Other columns are ignored; an empty table gives an empty result.
    """
    own = integer_vectors(rows, 0, id_col, values_col)
    dims = own.dims
    if not dims:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    own = own.filter("vec_id is not null")
    asked = own.filter(F.col("vec_id") % every == 0).withColumnRenamed("vec_id", "query_id")
    queries = settle(asked.select("x").distinct().withColumn("query", F.monotonically_increasing_id()), "queries")
    found = search(index(classes_of(own, k), dims, k), queries, dims, k)
    low = F.aggregate("x", F.lit(0).cast("long"), lambda s, v: s - v * v)  # of the query's own row
    each = asked.join(queries.join(found, "query").select("x", "found"), "x").withColumn("own", F.array_position("found", F.struct(low.alias("low"), F.col("query_id").alias("vec_id"))))
    each = each.select("query_id", "own", F.posexplode("found").alias("at", "f")).filter(F.col("at") + 1 != F.col("own"))
    rank = F.col("at") + F.when((F.col("own") > 0) & (F.col("at") + 1 > F.col("own")), 0).otherwise(1)
    return each.select("query_id", rank.cast("int").alias("rank"), F.col("f.vec_id").alias("vec_id"), (-F.col("f.low")).alias("score")).filter(F.col("rank") <= k)
