"""Whitening, exact top-k and the Merkle manifest against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from trialfuse.llm import merkle, topk, vectors, whitening

SF = "/root/testdata/sf0.01"
ROWS = "vec_id long, embedding array<double>, x string, ids string, n int, rank int, query string, component string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", "x", 1, 1, "x", "x") for i, v in rows], ROWS)


def odd_rows():
    rnd = np.random.default_rng(3)
    rows = [(i, rnd.normal(0, 0.2, 6).round(3).tolist()) for i in range(300)]
    rows += [(300 + i, rows[i % 3][1]) for i in range(120)]  # copies
    rows += [(500, None), (501, [0.1, None, 0.0, 0.0, 0.0, 0.0]), (502, [float("nan")] + [0.0] * 5), (503, [float("-inf")] + [0.0] * 5), (504, []), (505, [1.0, 2.0])]
    rows += [(None, rows[5][1]), (20, rows[7][1]), (20, rows[7][1]), (None, [0.0] * 6)]
    return rows


def usable(rows):
    return [(i, v) for i, v in rows if v is not None and len(v) == 6 and all(c is not None and np.isfinite(c) for c in v)]


# whitening


def brute_whitening(rows):
    x = np.array([[int(np.floor(64 * c)) + 1_000_000 for c in v] for _, v in rows], dtype=object)
    fit = np.array(sorted(set(map(tuple, x.tolist()))), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    deviation = [int(d) for d in ((n * x - sums) ** 2).sum(axis=1)]
    centred = ((n * fit - sums) / n).astype(float)
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)
    white = ((n * x - sums) / n).astype(float) @ basis[:, order] / np.sqrt(values[order])
    return n, deviation, white, values[order] / values.sum()


def test_whitening_matches_brute_force(spark):
    rows = odd_rows()
    got = whitening.whiten(table(spark, rows)).collect()
    own = usable(rows)
    n, deviation, white, explained = brute_whitening(own)
    assert len(got) == len(own) * 6
    want = Counter((i, k + 1, n, deviation[r], round(abs(float(white[r, k])), 8)) for r, (i, _) in enumerate(own) for k in range(6))
    assert Counter((r.vec_id, r.component, r.n, r.deviation, round(abs(r.whitened), 8)) for r in got) == want
    assert all(abs(r.explained - explained[r.component - 1]) < 1e-9 and r.identity_error < 1e-9 for r in got)
    signs = defaultdict(set)  # one sign for all rows
    place = {i: r for r, (i, _) in enumerate(own) if i not in (None, 20)}  # 20 has several vectors
    for r in got:
        if r.vec_id in place and abs(r.whitened) > 1e-6:
            signs[r.component].add(r.whitened * white[place[r.vec_id], r.component - 1] > 0)
    assert all(len(s) == 1 for s in signs.values())


def test_whitening_edge_cases(spark):
    assert whitening.whiten(table(spark, [])).collect() == []
    assert whitening.whiten(table(spark, [(1, None), (2, []), (3, [None])])).collect() == []
    assert whitening.whiten(table(spark, [(1, [0.5, 0.5]), (2, [0.5, 0.5])])).collect() == []  # no variance
    flat = whitening.whiten(table(spark, [(i, [i / 8, i / 4, 0.0]) for i in range(9)])).collect()
    assert len(flat) == 9 and {r.component for r in flat} == {1} and flat[0].explained == pytest.approx(1)
    assert sum(r.whitened**2 for r in flat) / 9 == pytest.approx(1)


def test_whitening_of_the_query_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = whitening.whiten(spark.read.parquet(f"{SF}/embeddings.parquet")).collect()
    n, deviation, white, _ = brute_whitening(rows)
    at = {i: r for r, (i, _) in enumerate(rows)}
    assert len(got) == len(rows) * 16
    for r in got:
        assert r.n == n and r.deviation == deviation[at[r.vec_id]] and abs(abs(r.whitened) - abs(white[at[r.vec_id], r.component - 1])) < 1e-7


@pytest.mark.parametrize("seed", range(6))
def test_contours_find_every_eigenvalue(seed):
    rnd = np.random.default_rng(seed)
    for _ in range(12):
        d = int(rnd.integers(1, 66))
        basis = np.linalg.qr(rnd.standard_normal((d, d)))[0]
        ev = 10.0 ** rnd.uniform(-16, 4, d)
        ev[rnd.random(d) < 0.3] = ev[0]  # ties
        a = (basis * ev) @ basis.T
        a = (a + a.T) / 2
        want = np.linalg.eigvalsh(a)[::-1]
        values, found = whitening.components(a)
        k = len(values)
        assert k == min(16, d) or want[k] < 1e-10 * want[0]
        assert np.abs(values - want[:k]).max() < 1e-13 * want[0] * d
        assert np.abs(a @ found - found * values).max() < 1e-13 * want[0] * d
        assert np.abs(found.T @ found - np.eye(k)).max() < 1e-12
        shift = float(rnd.uniform(0, 2))
        assert whitening.inertia(whitening.tridiagonal(a), shift) == int((want > shift).sum())
    assert len(whitening.components(np.zeros((4, 4)))[0]) == 0
    assert len(whitening.components(np.eye(64))[0]) == 16


def test_large_deviations():
    z = np.array([[3_000_000_000, 1], [5, 5]], dtype=object)
    assert whitening.exact_squares(z) == [9 * 10**18 + 1, 50]
    assert whitening.exact_squares(np.array([[4_000_000_000, 0]], dtype=object)) == [None]


# top k


def brute_top(rows, k=20, every=20):
    own = [(i, np.floor(64 * np.array(v)).astype(int)) for i, v in usable(rows) if i is not None]
    out = Counter()
    for a, (i, x) in enumerate(own):
        if i % every == 0:
            best = sorted((-int(x @ y), j) for b, (j, y) in enumerate(own) if b != a)[:k]
            out.update((i, r + 1, j, -s) for r, (s, j) in enumerate(best))
    return out


@pytest.mark.parametrize("per_block", [40, 1 << 15])
def test_top_k(spark, monkeypatch, per_block):
    monkeypatch.setattr(topk.index, "__defaults__", (topk.K, per_block))
    monkeypatch.setattr(topk.search, "__defaults__", (topk.K, 7 if per_block == 40 else 1024))
    rows = odd_rows()
    got = topk.top_k(table(spark, rows)).collect()
    assert Counter((r.query_id, r.rank, r.vec_id, r.score) for r in got) == brute_top(rows)


def test_top_k_edge_cases(spark):
    assert topk.top_k(table(spark, [])).collect() == []
    assert topk.top_k(table(spark, [(20, [1.0, 2.0])])).collect() == []
    zeros = [(i, [0.0] * 6) for i in range(60)]  # all scores are equal
    got = topk.top_k(table(spark, zeros)).collect()
    assert Counter((r.query_id, r.rank, r.vec_id, r.score) for r in got) == brute_top(zeros)


def test_reading_stops_on_proof_alone(spark):
    """Blocks large enough for the bounds: members left out can't be among the best, and most are left out."""
    rnd = np.random.default_rng(5)
    rows = [(i, v.tolist()) for i, v in enumerate(rnd.normal(0, 0.125, (3000, 64)) + rnd.normal(0, 0.1, (10, 64))[np.arange(3000) % 10])]
    own = vectors.integer_vectors(table(spark, rows))
    made = topk.index(topk.classes_of(own, 20), 64).collect()
    assert len(made) == 1
    block = topk.Block(made[0].asDict(), 64)
    left = []
    for q in block.x[::97].astype(np.int64):
        members, scores = block.possible(q, 21)
        truth = block.x.astype(int) @ q
        assert (scores == truth[members]).all()
        assert set(np.flatnonzero(truth >= np.sort(truth)[-21])) <= set(members.tolist())
        left.append(len(members))
    assert np.median(left) <= 0.3 * block.n


def test_index_blocks_travel_in_pieces_and_for_many_queries_at_once(spark, monkeypatch):
    """No row of a whole block for each block of queries: 6 GB of documents' vectors would be 610 rows of 18 MB."""
    assert topk.lots_of(61, 10, 12) == 10 and topk.lots_of(11, 2, 12) == 11 and topk.lots_of(6100, 100, 12) == 382 and topk.lots_of(1, 1, 1) == 1
    monkeypatch.setattr(topk, "PIECE", 1000)
    rows = odd_rows()
    own = vectors.integer_vectors(table(spark, rows)).filter("vec_id is not null")
    blocks = topk.index(topk.classes_of(own, 20), 6, 20, 100)
    sent = topk.pieces(blocks, 3)
    size = sum(len(r[c]) for r in blocks.collect() for c in topk.BLOBS)
    lengths = [len(r["bytes"]) for r in sent.select("bytes").collect()]
    assert max(lengths) == 1000 and sum(lengths) == 3 * size
    for r in blocks.collect():
        again = topk.put_together(sent.filter((sent.block == r.block) & (sent.lot == 1)).toArrow())
        assert again == {c: r[c] if c == "n" else bytes(r[c]) for c in ("n", *topk.BLOBS)}
    got = topk.top_k(table(spark, rows)).collect()
    assert Counter((r.query_id, r.rank, r.vec_id, r.score) for r in got) == brute_top(rows)


# manifest


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_audit(rows):
    """Counter of the query's rows; documents are (doc_id, text, lang, source, n_chars)."""
    leaf = lambda d, t, g, s, n: sha(enc(d), enc(s), enc(g), enc(n), enc(t))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
        return out

    def steps(tree, i):
        out = []
        for level in tree[:-1]:
            run = level[i - i % 2 : i - i % 2 + 2]
            out.append((i % 2, [x for j, x in enumerate(run) if j != i % 2]))
            i //= 2
        return out

    langs = defaultdict(list)
    for r in rows:
        langs[r[2]].append(r)
    order = sorted(langs, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels([leaf(*r) for r in sorted(langs[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))]) for g in order}
    top = levels([trees[g][-1][0] for g in order])
    out = Counter()
    for at, g in enumerate(order):
        for i, r in enumerate(sorted(langs[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))):
            proof = steps(trees[g], i) + steps(top, at)
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None
            node = leaf(*r[:4], r[4] + 1) if hit else leaf(*r)
            for digit, others in proof:
                node = sha(node, *others) if digit == 0 else sha(*others, node)
            out[r[0], leaf(*r), trees[g][-1][0], top[-1][0], sha(*(x for _, o in proof for x in o)), node, node == top[-1][0]] += 1
    return out


DOCS = "doc_id long, text string, lang string, source string, n_chars long, tree string, leaf string, rank string, digest string"


def documents(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], DOCS)


@pytest.mark.parametrize("levels", [1, 2, 3, 10])
def test_manifest(spark, levels):
    rnd = random.Random(levels)
    langs = [None, "", "de", "en", "en", "en", "fr", "é", "z"]
    rows = [(i, rnd.choice([None, "", "text", "ünï 字 " * 3]), rnd.choice(langs), rnd.choice([None, "a", "b:1"]), rnd.choice([None, 0, 5, 99])) for i in rnd.sample(range(10_000), 120)]
    rows += [rows[0]] * 3 + [(None, "t", "en", None, 1)] * 2 + [(7, "one", "en", "s", 3), (7, "two", "en", "s", 3), (-5, "w " * 50_000, "en", "s", 3)]
    got = merkle.audit(documents(spark, rows), levels).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert Counter(map(tuple, got)) == brute_audit(rows)
    assert 0 < sum(not r.verified for r in got) < len(got)


def test_manifest_of_few_rows(spark):
    assert merkle.audit(documents(spark, [])).collect() == []
    for rows in ([(1, "a", "en", "s", 1)], [(1, "a", None, None, None), (2, "b", "en", "s", 2)]):
        got = merkle.audit(documents(spark, rows)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
        assert Counter(map(tuple, got)) == brute_audit(rows)


def test_proofs_of_some_leaves_and_of_another_manifest(spark):
    rows = [(i, f"text {i}", "en" if i % 3 else "de", "s", i) for i in range(50)]
    made = merkle.Manifest(documents(spark, rows), 2)
    every = {(r.tree, r.rank): r for r in made.proofs().collect()}
    asked = spark.createDataFrame([("=en", 0), ("=en", 7), ("=de", 16), ("=de", 99)], "tree string, rank long")
    got = made.proofs(asked).collect()
    assert {(r.tree, r.rank) for r in got} == {("=en", 0), ("=en", 7), ("=de", 16)}
    assert all(r.proof == every[r.tree, r.rank].proof and merkle.folded(r.leaf, r.proof) == made.root for r in got)
    assert merkle.folded("0" * 64, got[0].proof) != made.root
    records = made.forest.bands[0].select("records").collect()
    assert all(x.digest == hashlib.sha256("".join(x.children).encode()).hexdigest() for r in records for x in r.records)
