"""Whitening of embeddings; the components come from contour integrals of the covariance's resolvent."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, settle
from .vectors import batches_of, integer_vectors, matrix

COMPONENTS = 16
OFFSET = 1_000_000
#: Nodes of the quadrature on the half circle, most eigenvalues of one interval, rounds of subspace iteration.
NODES, MOST_INSIDE, ROUNDS = 16, 6, 30
#: Of the largest eigenvalue: what is smaller is rounding, and intervals that are narrower are not parted.
NOISE, NARROW = 1e-11, 1e-13
_EPS = np.finfo(float).eps


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(diagonal, squares beside it) of a tridiagonal matrix similar to the symmetric a: reflections, column by column."""
    a = a.copy()
    n = len(a)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        size = v @ v
        if size > 0:
            part = a[k + 1 :, k:]
            part -= np.outer(v, 2 / size * (v @ part))
            part = a[k:, k + 1 :]
            part -= np.outer(2 / size * (part @ v), v)
    return np.diag(a).copy(), np.diag(a, -1) ** 2


def inertia(t: tuple[np.ndarray, np.ndarray], shift: float) -> int:
    """How many eigenvalues lie above shift: positive pivots of the shifted tridiagonal matrix."""
    above, pivot = 0, 1.0
    for d, b in zip(t[0].tolist(), [0.0, *t[1].tolist()], strict=True):
        pivot = d - shift - b / pivot
        if pivot == 0:
            pivot = -_EPS * _EPS
        above += pivot > 0
    return above


def clear(t: tuple[np.ndarray, np.ndarray], border: float, low: float, high: float, steps: int = 40) -> float:
    """The middle of the gap between eigenvalues around border, as far as it lies in [low, high]: there a filter separates best."""
    above, ends = inertia(t, border), []
    for end in (low, high):
        near, far = border, end
        for _ in range(steps):
            middle = (near * far) ** 0.5
            near, far = (middle, far) if inertia(t, middle) == above else (near, middle)
        ends.append(near)
    return sum(ends) / 2


def intervals(a: np.ndarray, count: int) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues inside) from the top down, until at least `count` eigenvalues above the noise are inside.

    Counts come from inertia alone. A wide interval, or one with more than a few, is
    parted at its geometric middle unless it is too narrow to part what is in it.
    """
    t = tridiagonal(a)
    bound = float(np.abs(a).sum(axis=1).max()) * 2
    noise = bound * NOISE
    out: list[tuple[float, float, int]] = []
    todo = [(noise, bound, 0, inertia(t, noise))]  # (low, high, above high, above low)
    got = 0
    while todo and got < count:
        low, high, top, all_above = todo.pop()
        inside = all_above - top
        if not inside:
            continue
        if high / low > 16 or inside > MOST_INSIDE and high - low > NARROW * bound:
            middle = (low * high) ** 0.5
            above = inertia(t, middle)
            todo += [(low, middle, above, all_above), (middle, high, top, above)]
            continue
        out.append((clear(t, low, low / 2, high), clear(t, high, low, 2 * high), inside))
        got += inside
    return out


def feast(a: np.ndarray, low: float, high: float, inside: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenpairs of a in (low, high), as many as inertia has counted.

    A subspace is filtered by the quadrature of (z - a)^-1 on a circle over the
    interval and reduced by Rayleigh and Ritz, again and again, until the residuals inside are at rounding.
    """
    n, size = len(a), float(np.linalg.norm(a, 2 if len(a) < 3 else None))
    width = min(n, max(2 * inside, inside + 4))
    for _ in range(3):
        x, w = np.polynomial.legendre.leggauss(NODES)
        angle = np.pi / 2 * (1 - x)
        centre, radius = (low + high) / 2, (high - low) / 2
        turn = np.exp(1j * angle)
        basis = np.linalg.qr(np.random.default_rng(n).standard_normal((n, width)))[0]
        best = np.inf
        for _ in range(ROUNDS):
            q = np.zeros((n, width))
            for weight, e in zip(w, turn, strict=True):
                q += (weight / 2 * radius * e * np.linalg.solve((centre + radius * e) * np.eye(n) - a, basis.astype(complex))).real
            q = np.linalg.qr(q)[0]
            ritz, s = np.linalg.eigh(q.T @ a @ q)
            basis = q @ s
            hold = (ritz > low) & (ritz < high)
            worst = np.linalg.norm(a @ basis[:, hold] - basis[:, hold] * ritz[hold], axis=0).max(initial=0)
            if int(hold.sum()) == inside and worst <= 64 * _EPS * size and worst >= best / 2:
                return ritz[hold], basis[:, hold]
            best = min(best, worst) if int(hold.sum()) == inside else np.inf
        if int(hold.sum()) == inside and worst <= 4096 * _EPS * size:
            return ritz[hold], basis[:, hold]
        width = min(n, 2 * width)
    raise ArithmeticError(f"{int(hold.sum())} of {inside} eigenvalues between {low} and {high} were found")


def components(covariance: np.ndarray, count: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of the largest `count` eigenvalues above rounding."""
    if not len(covariance) or not covariance.any():
        return np.zeros(0), np.zeros((len(covariance), 0))
    scale = float(np.abs(covariance).max())
    a = covariance / scale
    vectors = np.concatenate([feast(a, *part)[1] for part in intervals(a, count)], axis=1)
    q = np.linalg.qr(vectors)[0]  # what came from two intervals becomes exactly orthogonal
    values, s = np.linalg.eigh(q.T @ a @ q)
    order = np.argsort(-values, kind="stable")[:count]
    lowest = values[order[-1]] if len(order) else 0.0
    gap, t = 64 * _EPS * len(a), tridiagonal(a)
    if not inertia(t, lowest + gap) <= len(order) <= inertia(t, lowest - gap):
        raise ArithmeticError("an eigenvalue is missing")
    return values[order] * scale, (q @ s)[:, order]


def gram(fit: DataFrame, dims: int, low: np.ndarray, rest: np.ndarray, project: np.ndarray) -> np.ndarray:
    """Sum over rows of w w', w = (x - low - rest) project: a matrix product for each batch, entries added by Spark."""
    k = project.shape[1]
    at_i, at_j = np.triu_indices(k)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for t in batches_of(batches):
            w = ((matrix(t.column(0).combine_chunks(), dims) - low).astype(float) - rest) @ project
            total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(at_i, pa.int32()), pa.array(at_j, pa.int32()), pa.array(total[at_i, at_j])], names=["i", "j", "v"])

    out = np.zeros((k, k))
    for r in map_arrow(fit.select("x"), fn, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["v"]
    return out


def exact_squares(z: np.ndarray) -> list[int | None]:
    """Sums of squares of each row, in Python's integers where longs could overflow; null where the sum is no long."""
    most = int(np.abs(z).max(initial=0))
    if most * most * z.shape[1] < 1 << 63:
        return (z * z).sum(axis=1).tolist()
    sums = ((v.astype(object) ** 2).sum() for v in z)
    return [int(s) if s < 1 << 63 else None for s in sums]


def whiten(rows: DataFrame, count: int = COMPONENTS, id_col: str = "vec_id", values_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: one row for each vector and component.

    x = floor(64 * c) + 1000000. The fit list holds each distinct x vector
    once; its sums are exact, and its covariance (divisor n) is of entries that
    are centred first, by the whole part of the mean in integers and by the rest in doubles. Components are
    found on the driver from that dims x dims matrix; rows never travel there.

    Null, empty and not finite vectors, and those of another length than most
    vectors, have no rows (see integer_vectors()). Components
    whose eigenvalue is zero to rounding can't be scaled and are absent: none are left if all
    vectors are equal. Repeated rows and equal vectors count once in the
    fit and have rows of their own. Null ids stay null. Equal eigenvalues: any orthonormal
    choice, the same for all rows. deviation is null where it is larger than a long.
    Other columns are ignored; an empty table gives an empty result.
    """
    own = integer_vectors(rows, OFFSET, id_col, values_col)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    dims = own.dims
    if not dims:
        return rows.sparkSession.createDataFrame([], schema)
    fit = settle(own.select("x").distinct(), "fit")
    row = fit.agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(dims))).first()
    n, sums = int(row["n"]), [int(row[f"s{i}"]) for i in range(dims)]
    low = np.array([s // n for s in sums], np.int64)
    left = np.array([s % n for s in sums], np.int64)
    rest = left / n
    covariance = gram(fit, dims, low, rest, np.eye(dims)) / n
    values, vectors = components(covariance, count)
    scaled = vectors / np.sqrt(values)
    error = float(np.abs(gram(fit, dims, low, rest, scaled) / n - np.eye(len(values))).max(initial=0))
    explained = values / np.trace(covariance) if len(values) else values
    k = len(values)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches_of(batches, 1024):
            y = matrix(t.column("x").combine_chunks(), dims) - low
            m = len(y)
            w = (y.astype(float) - rest) @ scaled
            wide = int(np.abs(y).max(initial=0)) * n + n >= 1 << 63
            z = y.astype(object) * n - left if wide else y * n - left
            far = pa.array(exact_squares(z), pa.int64())
            each = np.repeat(np.arange(m), k)
            columns = [
                t.column("vec_id").combine_chunks().take(pa.array(each)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, n, np.int64)),
                far.take(pa.array(each)),
                pa.array(w.reshape(-1)),
                pa.array(np.tile(explained, m)),
                pa.array(np.full(m * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return map_arrow(own, fn, schema)
