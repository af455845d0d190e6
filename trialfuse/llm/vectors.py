"""Embedding columns as exact integers, for the operators that must not round."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle

STEPS = 64
#: Times 64, entries up to here are whole numbers that doubles and longs both hold.
LARGEST = 2.0**46


def finite(values: Column) -> Column:
    """True where an array is there, has entries, and all of them are numbers that a long can hold."""
    return F.coalesce((F.size(values) > 0) & F.forall(values, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= LARGEST)), F.lit(False))


def integer_vectors(rows: DataFrame, offset: int = 0, id_col: str = "vec_id", values_col: str = "embedding") -> DataFrame:
    """(vec_id long, x array<long>): x = floor(64 * c) + offset, written once; .dims has the common length.

    Null vectors, empty ones and those that hold a null, a NaN, an infinity or an entry
    beyond 2**46 are left out. Vectors of another length than the most
    frequent one (ties: the longer) have no place in the same space and are left out too.
    """
    values = F.col(values_col).cast("array<double>")
    whole = rows.select(F.col(id_col).cast("long").alias("vec_id"), values.alias("c")).filter(finite(F.col("c")))
    out = settle(whole.select("vec_id", F.transform("c", lambda c: F.floor(c * STEPS) + F.lit(offset).cast("long")).alias("x")), "vectors")
    lengths = out.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(2).collect()
    dims = lengths[0]["d"] if lengths else 0
    if len(lengths) > 1:
        out = out.filter(F.size("x") == dims)
    out.dims = dims
    return out


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """(rows, dims) of a column of lists."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def batches_of(batches: Iterator[pa.RecordBatch], rows: int = 4096) -> Iterator[pa.Table]:
    """Arrow batches put together to about `rows` rows, so that matrix products are worth their call."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()
