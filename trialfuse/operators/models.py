"""Linear, mixed and logistic models from distributed sufficient statistics.

Data are reduced to k x k sums by Spark; only those reach the driver. k is
the number of design columns, whatever the number of rows, groups and sizes of groups. All outcomes
of a call are summed in one pass over the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import coding as C
from ..functions import dist
from ..sources.scratch import written
from .trial import keep_first

MOST_LEVELS = 100
RESULT = "outcome string, term string, estimate double, se double, statistic double, p_value double, ci_low double, ci_high double, model string, n long, n_groups long, group_variance double, note string"


@dataclass
class Term:
    """factors: column -> categorical? A product of columns is one term."""

    factors: dict[str, bool] = field(default_factory=dict)

    @property
    def name(self) -> str:
        return ":".join(f"C({c})" if cat else c for c, cat in self.factors.items())


def parse_terms(predictors: Sequence[str]) -> list[Term]:
    """'x', 'C(x)', 'a:b', and 'a*b' for all its parts."""
    one = lambda t: (t[2:-1], True) if t.startswith("C(") else (t, False)
    out: list[Term] = []
    for p in predictors:
        parts = [one(t.strip()) for t in p.replace(":", "*").split("*")]
        picks = [[parts[i] for i in range(len(parts)) if mask >> i & 1] for mask in range(1, 1 << len(parts))] if "*" in p else [parts]
        for t in sorted(picks, key=len):
            term = Term(dict(t))
            if term not in out:
                out.append(term)
    return out


class Design(list):
    """The (name, column) pairs of a design, and how to make its columns from fewer: `raw` are codes of factors (0 is the reference) and
    numbers, `cells` has, for each pair, the raw columns whose product it is, each with the code that counts (None: the number itself).
    `rows` is the number of rows that the levels were found in."""

    def __init__(self, pairs: Sequence[tuple[str, Column]] = (), raw: Sequence[Column] = (), cells: Sequence[tuple] = (), rows: int = 0):
        super().__init__(pairs)
        self.raw, self.cells, self.rows = list(raw), list(cells), rows

    @classmethod
    def of(cls, cols: Sequence[tuple[str, Column]]) -> Design:
        """Columns without a known origin are raw themselves."""
        return cols if isinstance(cols, cls) else cls(cols, [c.cast("double") for _, c in cols], [((i, None),) for i in range(len(cols))])


def seen_in(df: DataFrame, factors: Sequence[str], numbers: Sequence[str]) -> dict:
    """_n: the rows; of each factor its sorted levels, of each number its least and greatest value. One pass: the ranges
    of the numbers in each cell of the factors, then the levels and ranges of all cells."""
    cells = df.groupBy(*[F.col(c).cast("string").alias(c) for c in factors]).agg(F.count(F.lit(1)).alias("_n"), *[f(C.num(c)).alias(f"_{n}_{c}") for c in numbers for n, f in (("lo", F.min), ("hi", F.max))])
    return cells.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_n"), *[F.array_sort(F.collect_set(c)).alias(c) for c in factors], *[F.array(F.min(f"_lo_{c}"), F.max(f"_hi_{c}")).alias(c) for c in numbers]).first().asDict()


def design(df: DataFrame, terms: Sequence[Term], seen: dict | None = None) -> Design:
    """(name, column) of an intercept and each usable term: treatment coding, the first sorted level is the reference.

    A term is kept only if all its columns exist with more than one value. One pass finds the levels of all factors,
    unless `seen` has them.
    """
    columns = {c: cat for t in terms for c, cat in t.factors.items() if c in df.columns}
    if not columns:
        return Design([("Intercept", F.lit(1.0))], [], [()])
    seen = seen or seen_in(df, [c for c in columns if columns[c]], [c for c in columns if not columns[c]])
    levels: dict[str, list] = {}
    for c, cat in columns.items():
        values = list(seen[c] or [])
        if cat and len(values) > MOST_LEVELS:
            raise ValueError(f"{c} has {len(values)} levels; a factor has at most {MOST_LEVELS}")
        if cat and len(values) > 1:
            levels[c] = values[1:]
        elif not cat and values and values[0] is not None and values[0] != values[1]:
            levels[c] = [None]
    out: list[tuple[str, Column]] = [("Intercept", F.lit(1.0))]
    raw: dict[tuple[str, bool], Column] = {}
    made: list[tuple] = [()]
    for t in terms:
        if any(c not in levels for c in t.factors):
            continue
        cells: list[tuple[str, Column, tuple]] = [("", F.lit(1.0), ())]
        for c, cat in t.factors.items():
            if (c, cat) not in raw:
                raw[c, cat] = F.array_position(F.array(*[F.lit(x) for x in levels[c]]), F.col(c).cast("string")).cast("tinyint") if cat else C.num(c)
            at = list(raw).index((c, cat))
            parts = [(f"C({c})[T.{x}]", F.when(F.col(c).cast("string") == x, 1.0).when(F.col(c).isNotNull(), 0.0), (at, i)) for i, x in enumerate(levels[c], 1)] if cat else [(c, C.num(c), (at, None))]
            cells = [(f"{n}:{part}" if n else part, v * w, (*from_, own)) for n, v, from_ in cells for part, w, own in parts]
        out += [(n, v) for n, v, _ in cells]
        made += [m for _, _, m in cells]
    return Design(out, raw.values(), made, seen["_n"])


#: log of the variance ratio at which groups are summed; between these points sums are interpolated to some 1e-11.
GRID_STEP, GRID_END, NEAR = 0.25, 17.0, 24
GRID = np.arange(-GRID_END, GRID_END + GRID_STEP / 2, GRID_STEP)
#: Up to so many distinct rows of a design are a table for the driver; beyond, each of Newton's steps is a job over them.
PATTERNS = 100_000
#: Sums of groups leave a task whenever they have this many bytes; and a task gathers the groups of so many rows.
HELD_BYTES, ROWS_A_TASK = 64 << 20, 500_000


def _independent(c: np.ndarray, k: int) -> list[int]:
    """Columns that are not linear combinations of earlier ones."""
    kept: list[int] = []
    for j in range(k):
        trial = [*kept, j]
        s = np.sqrt(np.maximum(np.diag(c)[trial], 1e-300))
        m = c[np.ix_(trial, trial)] / np.outer(s, s)
        if np.linalg.eigvalsh(m)[0] > 1e-10:
            kept = trial
    return kept


@dataclass
class Sums:
    """Of one outcome: rows, sum of w w' (w: design columns and the outcome), groups, the largest group, and for each point
    of GRID the sums over groups of theta/(1 + m theta) s s' and of log(1 + m theta), s being a group's sum of w and m its rows."""

    n: int
    gram: np.ndarray
    groups: int = 0
    largest: int = 0
    within: np.ndarray | None = None
    logdet: np.ndarray | None = None

    def at(self, theta: float) -> tuple[np.ndarray, float]:
        """The group sums for any theta: barycentric interpolation on the nearest points of the grid."""
        if theta <= 0:
            return np.zeros_like(self.gram), 0.0
        u = min(max(math.log(theta), -GRID_END), GRID_END)
        first = int(min(max(np.searchsorted(GRID, u) - NEAR // 2, 0), len(GRID) - NEAR))
        x = GRID[first : first + NEAR]
        near = np.abs(x - u) < 1e-13
        if near.any():
            w = near.astype(float)
        else:
            w = np.array([(-1) ** i * math.comb(NEAR - 1, i) for i in range(NEAR)]) / (u - x)
        w = w / w.sum()
        return np.tensordot(w, self.within[first : first + NEAR], 1), float(w @ self.logdet[first : first + NEAR])


def _group_sums(counts: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """[groups, largest, then of each point of GRID: logdet, within] of groups with `counts` rows and column sums `sums`."""
    k = sums.shape[1]
    theta = np.exp(GRID)
    if not len(counts):
        return np.zeros(2 + len(GRID) * (1 + k * k))
    sizes, at = np.unique(counts, return_inverse=True)
    s = np.zeros((len(sizes), k, k))
    for i in range(len(sizes)):
        rows = sums[at == i]
        s[i] = rows.T @ rows
    number = np.bincount(at, minlength=len(sizes))
    weight = theta[:, None] / (1 + sizes[None, :] * theta[:, None])
    within = (weight @ s.reshape(len(sizes), -1)).reshape(len(GRID), -1)
    logdet = np.log1p(sizes[None, :] * theta[:, None]) @ number
    return np.concatenate([[len(counts), sizes.max()], np.concatenate([logdet[:, None], within], axis=1).ravel()])


def _columns(raw: Sequence[np.ndarray], cells: Sequence[tuple], n: int) -> np.ndarray:
    """The design's columns as rows of a matrix, from its raw columns; indicators and products of the first factors are made once."""
    out, marks, done = np.empty((len(cells), n)), {}, {}
    for i, parts in enumerate(cells):
        for part in parts:
            if part not in marks:
                at, code = part
                marks[part] = raw[at] if code is None else (raw[at] == code).astype(float)
        if len(parts) < 2:
            out[i] = marks[parts[0]] if parts else 1.0
        else:
            before = done[parts[:-1]] if parts[:-1] in done else math.prod((marks[x] for x in parts[1:-1]), start=marks[parts[0]])
            np.multiply(before, marks[parts[-1]], out=out[i])
        done[parts] = out[i]
    return out


class _Totals:
    """Rows of sums by key."""

    def __init__(self, width: int):
        self.at: dict[str, int] = {}
        self.sums = np.zeros((256, width))

    def add(self, keys: Sequence[str], rows: np.ndarray) -> None:
        """keys: without repeats"""
        at = self.at
        where = np.fromiter((at.setdefault(k, len(at)) for k in keys), np.int64, len(keys))
        while len(at) > len(self.sums):
            self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)])
        self.sums[where] += rows

    def rows(self) -> np.ndarray:
        return self.sums[: len(self.at)]


def sums_of(df: DataFrame, cols: Sequence[tuple[str, Column]], outcomes: Sequence[str], group: str | None) -> dict[str, Sums]:
    """Sums of each outcome over the rows that have it, all design columns and the group: one pass, one shuffle.

    Tasks get the codes and numbers that the design is made from, not its columns. They
    send a k x k sum for each outcome and, of each group that they meet, a row of column sums, so a group's
    size does not matter. Tasks that gather whole groups add them up at the points of GRID: what is
    collected has the size of the grid, not of the groups.
    """
    cols = Design.of(cols)
    k, models, cells = len(cols), len(outcomes), cols.cells
    wide = k + 1
    key = [F.col(group).cast("string").alias("g")] if group else []
    d = df.select(*key, *[c.alias(f"x{i}") for i, c in enumerate(cols.raw)], *[C.num(y).alias(f"y{j}") for j, y in enumerate(outcomes)])
    needed = [*(["g"] if group else []), *[f"x{i}" for i in range(len(cols.raw))]]
    d = d.dropna(subset=needed) if needed else d
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1, math.ceil(cols.rows / ROWS_A_TASK))
    width, n_raw, least = models * (wide + 1), len(cols.raw), 1 if group else 0

    def batch_of(keys, values):
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([v.tobytes() for v in values], pa.binary())], names=["key", "v"])

    def first(batches):
        grams, n, held = np.zeros((models, wide, wide)), np.zeros(models), _Totals(width)
        for b in batches:
            if not b.num_rows:
                continue
            columns = [b.column(i).to_numpy(zero_copy_only=False) for i in range(least, b.num_columns)]
            if group:
                names = b.column(0).dictionary_encode()
                code = names.indices.to_numpy()
                order = np.argsort(code, kind="stable")
                columns = [c[order] for c in columns]
                cut = np.flatnonzero(np.r_[True, np.diff(code[order]) != 0])
                totals = np.zeros((len(cut), models, wide + 1))
            x, y = _columns(columns[:n_raw], cells, b.num_rows), np.stack(columns[n_raw :])
            known = np.isfinite(y)
            sure = known.all(axis=1)
            if sure.any():
                square = x @ x.T
                if group:
                    sums = np.add.reduceat(x, cut, axis=1).T
                    sizes = np.diff(np.r_[cut, b.num_rows])
            for j in range(models):
                if sure[j]:
                    own, cross, size = square, x @ y[j], b.num_rows
                    z, v = x, y[j]
                else:
                    z, v = x * known[j], np.where(known[j], y[j], 0.0)
                    own, cross, size = z @ z.T, z @ v, known[j].sum()
                grams[j, :k, :k] += own
                grams[j, :k, k] += cross
                grams[j, k, :k] += cross
                grams[j, k, k] += v @ v
                n[j] += size
                if group:
                    totals[:, j, 0] = sizes if sure[j] else np.add.reduceat(known[j].astype(float), cut)
                    totals[:, j, 1:wide] = sums if sure[j] else np.add.reduceat(z, cut, axis=1).T
                    totals[:, j, wide] = np.add.reduceat(v, cut)
            if group:
                held.add([f"g{g}" for g in names.dictionary.to_pylist()], totals.reshape(len(cut), width))
                if held.rows().nbytes > HELD_BYTES:
                    yield batch_of(held.at, held.rows())
                    held = _Totals(width)
        if held.at:
            yield batch_of(held.at, held.rows())
        yield batch_of([f"m{j}" for j in range(models)], [np.concatenate([[n[j]], grams[j].ravel()]) for j in range(models)])

    def second(batches):
        whole: dict[str, np.ndarray] = {}
        held = _Totals(width)
        for b in batches:
            there: dict[str, int] = {}
            rows = []
            for name, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                v = np.frombuffer(v)
                if name[0] == "m":
                    whole[name] = whole[name] + v if name in whole else v
                elif name in there:
                    rows[there[name]] = rows[there[name]] + v
                else:
                    there[name] = len(rows)
                    rows.append(v)
            if rows:
                held.add(there, np.stack(rows))
        out = whole
        if held.at:
            every = held.rows().reshape(-1, models, wide + 1)
            for j in range(models):
                rows = every[every[:, j, 0] > 0, j]
                v = _group_sums(rows[:, 0], rows[:, 1:])
                out[f"g{j}"] = v[:2]
                out |= {f"g{j}.{i}": r for i, r in enumerate(v[2:].reshape(len(GRID), -1))}
        yield batch_of(out, out.values())

    def third(batches):
        """The points of the grid one by one, so that no task holds those of many."""
        out: dict[str, np.ndarray] = {}
        for b in batches:
            for name, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                v, was = np.frombuffer(v), out.get(name)
                out[name] = v if was is None else was + v if name[0] == "m" or "." in name else np.array([was[0] + v[0], max(was[1], v[1])])
        yield batch_of(out, out.values())

    schema = "key string, v binary"
    met = d.mapInArrow(first, schema).repartition(parts, "key").mapInArrow(second, schema).repartition("key").mapInArrow(third, schema).collect()  # two rows for each outcome, and its grid
    got = {r.key: np.frombuffer(bytes(r.v)) for r in met}
    out = {}
    for j, y in enumerate(outcomes):
        m = got.get(f"m{j}", np.zeros(1 + wide * wide))
        out[y] = Sums(int(m[0]), m[1:].reshape(wide, wide))
        if f"g{j}" in got:
            groups, largest = got[f"g{j}"]
            grid = np.stack([got[f"g{j}.{i}"] for i in range(len(GRID))])
            out[y] = Sums(int(m[0]), m[1:].reshape(wide, wide), int(groups), int(largest), grid[:, 1:].reshape(-1, wide, wide), grid[:, 0])
    return out


@dataclass
class Fit:
    names: list[str]
    beta: np.ndarray
    se: np.ndarray
    n: int
    n_groups: int
    group_variance: float | None
    residual_variance: float
    loglik: float
    model: str
    df: float | None


def _solve(c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, float]:
    inv = np.linalg.inv(c[:k, :k])
    beta = inv @ c[:k, k]
    return beta, inv, float(c[k, k] - c[:k, k] @ beta)


def fit_ols(df: DataFrame, y: str, cols: Sequence[tuple[str, Column]]) -> Fit | None:
    return ols_from(sums_of(df, cols, [y], None)[y], [c for c, _ in cols])


def fit_lmm(df: DataFrame, y: str, cols: Sequence[tuple[str, Column]], group: str) -> Fit | None:
    return lmm_from(sums_of(df, cols, [y], group)[y], [c for c, _ in cols])


def ols_from(sums: Sums, names: list[str]) -> Fit | None:
    m, n = sums.gram, sums.n
    keep = _independent(m, len(names)) if n else []
    if n <= len(keep) or not keep:
        return None
    beta, inv, rss = _solve(m[np.ix_([*keep, len(names)], [*keep, len(names)])], len(keep))
    s2 = max(rss, 0.0) / (n - len(keep))
    return Fit([names[i] for i in keep], beta, np.sqrt(np.diag(inv) * s2), n, 0, None, s2, math.nan, "OLS", float(n - len(keep)))


def lmm_from(sums: Sums, names: list[str]) -> Fit | None:
    """Random-intercept model by maximum likelihood; OLS if there is one group or the group variance has no information.

    With theta the variance ratio, W'V^-1 W = C - sum over groups of theta/(1 + m theta) s s',
    and log|V| = sum over groups of log(1 + m theta).
    """
    c, n, k = sums.gram, sums.n, len(names)
    keep = _independent(c, k) if n else []
    if n <= len(keep) + 1 or not keep:
        return None
    if sums.groups < 2 or sums.largest < 2:
        return ols_from(sums, names)
    at = np.ix_([*keep, k], [*keep, k])

    def profile(theta: float):
        within, logdet = sums.at(theta)
        beta, inv, rss = _solve(c[at] - within[at], len(keep))
        s2 = max(rss, 1e-300) / n
        return -0.5 * (n * math.log(2 * math.pi * s2) + n + logdet), beta, inv, s2

    grid = np.linspace(-14, 14, 57)
    values = [profile(math.exp(g))[0] for g in grid]
    best = int(np.argmax(values))
    lo, hi = grid[max(best - 1, 0)], grid[min(best + 1, len(grid) - 1)]
    gold = (math.sqrt(5) - 1) / 2
    for _ in range(80):
        a, b = hi - gold * (hi - lo), lo + gold * (hi - lo)
        if profile(math.exp(a))[0] >= profile(math.exp(b))[0]:
            hi = b
        else:
            lo = a
    theta = math.exp((lo + hi) / 2)
    if profile(0.0)[0] >= profile(theta)[0]:
        theta = 0.0
    ll, beta, inv, s2 = profile(theta)
    return Fit([names[i] for i in keep], beta, np.sqrt(np.diag(inv) * s2), n, sums.groups, theta * s2, s2, ll, "LMM", None)


def patterns(df: DataFrame, y: str, cols: Sequence[tuple[str, Column]]) -> DataFrame:
    """(x0, x1, ..., n, s): each distinct row of the design with its rows and its successes; with rows of the same pattern go all that a logit needs."""
    d = df.select(*[c.cast("double").alias(f"x{i}") for i, (_, c) in enumerate(cols)], C.binary_outcome(y).cast("double").alias("_y")).dropna()
    return d.groupBy(*[f"x{i}" for i in range(len(cols))]).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("_y").alias("s"))


def _newton_sums(x: np.ndarray, n: np.ndarray, s: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Score and information, one after the other."""
    p = 1 / (1 + np.exp(-(x @ beta)))
    return np.concatenate([x.T @ (s - n * p), ((x * (n * p * (1 - p))[:, None]).T @ x).ravel()])


def fit_logit(df: DataFrame, y: str, cols: Sequence[tuple[str, Column]], rounds: int = 40) -> Fit | None:
    """Binary logit by Newton's steps over the patterns: the data are read once.

    Up to PATTERNS of them are collected; more stay a written table, and each step is one job over it.
    """
    names, k = [c for c, _ in cols], len(cols)
    table = written(patterns(df, y, cols), "patterns")
    if table.count() <= PATTERNS:
        rows = np.array([tuple(r) for r in table.collect()], float).reshape(-1, k + 2)
        reduce = lambda f: f(rows)
    else:

        def reduce(f):
            def part(batches):
                total = 0.0
                for b in batches:
                    total = total + f(np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns]))
                v = np.atleast_1d(total).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(v)), pa.int32()), pa.array(v)], names=["i", "v"])

            got = table.mapInArrow(part, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
            return np.array([r.v for r in got])

    m = np.asarray(reduce(lambda r: np.concatenate([(r[:, :k] * r[:, k : k + 1]).T @ r[:, :k], [[r[:, k].sum()] * k, [r[:, k + 1].sum()] * k]]).ravel())).reshape(k + 2, k)
    n, ones = int(m[k, 0]), m[k + 1, 0]
    if not n or ones in (0, n):
        return None
    keep = _independent(m[:k], k)
    beta = np.zeros(len(keep))
    for _ in range(rounds):
        now = beta
        got = np.asarray(reduce(lambda r: _newton_sums(r[:, keep], r[:, k], r[:, k + 1], now)))  # noqa: B023
        inv = np.linalg.pinv(got[len(keep) :].reshape(len(keep), len(keep)))
        step = inv @ got[: len(keep)]
        beta = beta + step
        if np.abs(step).max() < 1e-10:
            break
        if np.abs(beta).max() > 50:
            return None  # the classes are separable
    return Fit([names[i] for i in keep], beta, np.sqrt(np.diag(inv)), n, 0, None, math.nan, math.nan, "Logit", None)


def result_rows(spark, outcome: str, fit: Fit | None, note: str = "") -> list[tuple]:
    if fit is None:
        return [(outcome, None, None, None, None, None, None, None, "none", 0, 0, None, note or "not estimable")]
    rows = []
    crit = float(dist.t_ppf(0.975, fit.df)) if fit.df else 1.959963984540054
    for name, b, s in zip(fit.names, fit.beta.tolist(), fit.se.tolist(), strict=True):
        z = b / s if s > 0 else math.nan
        p = None if math.isnan(z) else float(dist.t_sf2(z, fit.df)) if fit.df else dist.norm_sf2(z)
        rows.append((outcome, name, b, s, None if math.isnan(z) else z, p, b - crit * s, b + crit * s, fit.model, fit.n, fit.n_groups, fit.group_variance, note))
    return rows


def fit_models(df: DataFrame, outcomes: Sequence[str], predictors: Sequence[str], kind: str = "lmm", group: str = "participant_id", unit: str = "row", keys: Sequence[str] = ("participant_id", "scene_id"), order: Sequence[str] = ()) -> DataFrame:
    """Coefficient rows of each outcome. unit: 'trial' takes the first row of each trial, 'row' all rows.

    A missing outcome gives one diagnostic row.
    """
    base = keep_first(df, keys, order or [F.xxhash64(*df.columns)]) if unit == "trial" else df
    terms = parse_terms(predictors)
    # the levels, and the sums of each outcome, all read the same narrow rows
    with _kept(base, {*outcomes, *(c for t in terms for c in t.factors), *([group] if kind == "lmm" else [])}) as rows:
        return _fitted(rows, outcomes, terms, kind, group)


@contextmanager
def _kept(df: DataFrame, columns: Iterable[str]) -> Iterator[DataFrame]:
    """Those columns of df that exist, made once for all that reads them inside."""
    used = set(columns)
    rows = df.select(*[c for c in df.columns if c in used]).persist()
    try:
        yield rows
    finally:
        rows.unpersist()


def _fitted(df: DataFrame, outcomes: Sequence[str], terms: Sequence[Term], kind: str = "lmm", group: str = "participant_id", seen: dict | None = None) -> DataFrame:
    spark, rows = df.sparkSession, []
    cols = design(df, terms, seen)
    names, there = [c for c, _ in cols], [y for y in outcomes if y in df.columns]
    sums = sums_of(df, cols, there, group if kind == "lmm" else None) if there and kind != "logit" else {}
    for y in outcomes:
        if y not in df.columns:
            rows += result_rows(spark, y, None, "missing outcome")
            continue
        fit = fit_logit(df, y, cols) if kind == "logit" else ols_from(sums[y], names) if kind == "ols" else lmm_from(sums[y], names)
        rows += result_rows(spark, y, fit)
    return spark.createDataFrame(rows, RESULT)


def family_models(df: DataFrame, families: dict[str, dict]) -> DataFrame:
    """families: name -> {outcomes, predictors, kind, unit}; adds a family column."""
    out = None
    for name, f in families.items():
        part = fit_models(df, f["outcomes"], f["predictors"], f.get("kind", "lmm"), unit=f.get("unit", "row")).withColumn("family", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def varying(df: DataFrame, categories: Sequence[str], numbers: Sequence[str]) -> set[str]:
    """The columns that exist and have more than one value; those of numbers count as numeric. One pass."""
    cats, nums = ([c for c in cs if c in df.columns] for cs in (categories, numbers))
    value = {**{c: F.col(c).cast("string") for c in cats}, **{c: C.num(c) for c in nums}}
    if not value:
        return set()
    got = df.agg(*[(F.min(v) < F.max(v)).alias(c) for c, v in value.items()]).first()
    return {c for c in value if got[c]}


def core_terms(have: set[str]) -> list[str]:
    """Design factors crossed where all three vary, else one by one; then gender, batch, age, block and position where they vary."""
    factors = ("WWR", "Complexity", "ExperienceGroup")
    crossed = ["*".join(f"C({c})" for c in factors)] if have >= set(factors) else [f"C({c})" for c in factors if c in have]
    return crossed + [f"C({c})" for c in ("Gender", "RecruitmentBatch") if c in have] + [c for c in ("Age", "block", "position") if c in have]


def peak_terms(have: set[str]) -> list[str]:
    factors = ("Complexity", "ExperienceGroup")
    crossed = ["*".join(f"C({c})" for c in factors)] if have >= set(factors) else [f"C({c})" for c in factors if c in have]
    return crossed + (["C(Gender)"] if "Gender" in have else []) + (["Age"] if "Age" in have else [])


_CATEGORIES, _NUMBERS = ("WWR", "Complexity", "ExperienceGroup", "Gender", "RecruitmentBatch", "order_scheme"), ("Age", "block", "position", "TrialIndex")


def _seen(df: DataFrame) -> tuple[dict, set[str]]:
    """What seen_in() finds in the columns of designs, and those that vary."""
    seen = seen_in(df, *([c for c in cs if c in df.columns] for cs in (_CATEGORIES, _NUMBERS)))
    return seen, {c for c, v in seen.items() if c != "_n" and len(v) > 1 and v[0] is not None and v[0] != v[-1]}


def eeg_core_models(df: DataFrame, outcomes: Sequence[str]) -> DataFrame:
    with _kept(df, {*outcomes, *_CATEGORIES, *_NUMBERS, "participant_id"}) as rows:
        seen, have = _seen(rows)
        return _fitted(rows, outcomes, parse_terms(core_terms(have)), seen=seen)


def trial_index_models(df: DataFrame, outcomes: Sequence[str]) -> DataFrame:
    """The core terms without the position, and TrialIndex (position, else scene, by columns) alone and with group and order scheme."""
    at = next((c for c in ("position", "scene_id") if c in df.columns), None)
    df = df.withColumn("TrialIndex", C.num(at)) if at else df
    with _kept(df, {*outcomes, *_CATEGORIES, *_NUMBERS, "participant_id"}) as rows:
        seen, have = _seen(rows)
        terms = [t for t in core_terms(have) if t != "position"]
        if "TrialIndex" in have:
            terms.append("TrialIndex")
            if "ExperienceGroup" in have:
                terms.append("C(ExperienceGroup):TrialIndex")
            if "order_scheme" in have:
                terms += ["C(order_scheme)", "C(order_scheme):TrialIndex"]
        return _fitted(rows, outcomes, parse_terms(terms), seen=seen)


MODEL_TABLE = ("family", "outcome", "term", "estimate", "se", "p_value", "ci_low", "ci_high", "n")


def model_table(results: DataFrame) -> DataFrame:
    """The nine published columns that exist."""
    return results.select(*[c for c in MODEL_TABLE if c in results.columns])


def peak_index_models(df: DataFrame, outcomes: Sequence[str], level: str = "WWR", by: Sequence[str] = ("participant_id", "Complexity", "ExperienceGroup", "Gender", "Age")) -> DataFrame:
    """A mixed model of each outcome's peak index per participant and condition, by the factors, gender and age that vary."""
    from .diagnostics import subject_peak_index

    out = None
    for y in outcomes:
        peaks = subject_peak_index(df, y, level, [c for c in by if c in df.columns])
        with _kept(peaks, {"peak", *_CATEGORIES, *_NUMBERS, "participant_id"}) as rows:
            seen, have = _seen(rows)
            part = _fitted(rows, ["peak"], parse_terms(peak_terms(have)), seen=seen).withColumn("outcome", F.lit(f"{y}_peak"))
        out = part if out is None else out.unionByName(part)
    return out
