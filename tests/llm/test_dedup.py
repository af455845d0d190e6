"""Substring, suffix, line and SimHash dedup against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from trialfuse.llm import lines, simhash, substring, suffix_array
from trialfuse.llm.common import components

SCHEMA = "doc_id long, text string, lang string, done string, l string, _rid string"


def corpus(seed=3, n=60):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)] + ["é", "übung", "x" * 70]
    passage = " ".join(rnd.choice(vocab) for _ in range(60))
    texts = []
    for i in range(n):
        words = [rnd.choice(vocab) for _ in range(rnd.choice((0, 3, 19, 20, 21, 40, 120)))]
        kind = rnd.random()
        if kind < 0.25:
            a = rnd.randint(0, 30)
            words[len(words) // 2 : len(words) // 2] = passage.split()[a : a + rnd.randint(10, 30)]
        elif kind < 0.4 and texts:
            words = (rnd.choice(texts) or "").split()
            if words and rnd.random() < 0.7:
                words[rnd.randrange(len(words))] = "edit"
        elif kind < 0.5:
            words = words[:30] * 3
        texts.append(rnd.choice((" ", "  ", "\n", "\t")).join(words))
    texts += [None, "", " ", "a", "a b c", "x" * 200, "x" * 200, "\n\n\n\n", "same\nsame\nsame\nsame\nsame\nsame"]
    return [(i * 3, t, "en", "1", "2", "3") for i, t in enumerate(texts)]


def brute_words(rows, n):
    first, out = {}, {}
    for i, text, *_ in sorted(rows):
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
        gone = set()
        for s in range(len(w) - n + 1):
            key = tuple(w[s : s + n])
            if key in first:
                gone.update(range(s, s + n))
            else:
                first[key] = (i, s)
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def brute_bytes(rows, n):
    seen, out = set(), {}
    for i, text, *_ in sorted(rows):
        b = (text or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        own = set()
        for s in range(len(b) - n + 1):
            if b[s : s + n] in seen:
                gone[s : s + n] = True
            own.add(b[s : s + n])
        seen |= own
        kept = np.frombuffer(b, np.uint8)[~gone[:-1]].tobytes()
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_words(spark, seed):
    rows = corpus(seed)
    got = substring.repeated_words(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute_words(rows, 20)
    assert len(got) == len(rows) and any(r.n_removed for r in got)


@pytest.mark.parametrize("seed", [1, 2])
def test_bytes(spark, seed):
    rows = corpus(seed)
    got = suffix_array.repeated_bytes(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute_bytes(rows, 50)
    assert any(r.n_spans > 1 for r in got)


def test_names_that_clash_lose_and_add_nothing(spark, monkeypatch):
    """Rows of surroundings of one name are told apart by their bytes."""
    rnd = np.random.default_rng(4)
    rows = rnd.integers(97, 99, (200, 8), dtype=np.uint8).repeat(2, axis=0)
    rows[::3, :7] = 97
    want = len({r.tobytes() for r in rows})
    for clash in (False, True):
        if clash:
            monkeypatch.setattr(suffix_array, "_names_of_rows", lambda r: np.zeros(len(r), np.uint64))
        first, which = suffix_array.distinct_rows(rows)
        assert len(first) == want and (rows[first[which]] == rows).all()


def test_refinement_by_bucket_pointers():
    """Windows around one q-gram against brute force, for lengths that are and are not twice another."""
    rnd = np.random.default_rng(5)
    for length, q in ((50, 26), (32, 16), (64, 33), (20, 12)):
        reach, n = length - q, 300
        rows = np.zeros((n, suffix_array._width(length, q)), np.uint8)
        rows[:, : 2 * length - q] = rnd.integers(97, 99, (n, 2 * length - q), dtype=np.uint8)
        base = rows[:4].copy()
        for i in range(n):
            if i % 3:
                rows[i] = base[i % 4]
                k = rnd.integers(0, 2 * length - q)
                rows[i, k if i % 2 else 0] ^= 3
        rows[:, reach : reach + q] = np.where(np.arange(n)[:, None] % 5 == 4, 100, 101)
        rows[:, 2 * length - q], rows[:, 2 * length - q + 1] = 0, reach
        rows[::7, 2 * length - q] = 3
        docs = rnd.integers(0, 60, n)
        seen = {}
        for r, d in zip(rows, docs):
            for a in range(r[2 * length - q], reach + 1):
                key = (a, r[reach - a : reach - a + length].tobytes())
                seen[key] = min(seen.get(key, 99), int(d))
        want = [sum(1 << (reach - a) for a in range(r[2 * length - q], reach + 1) if seen[a, r[reach - a : reach - a + length].tobytes()] < d) for r, d in zip(rows, docs)]
        assert suffix_array.refine(rows, docs, length, q).tolist() == want and any(want)


@pytest.mark.parametrize("hot", [0, 10**9])
def test_hot_qgrams_and_very_long_texts(spark, monkeypatch, hot):
    """All windows dealt out one by one, or none; texts of many parts."""
    monkeypatch.setattr(suffix_array, "HOT", hot)
    rnd = random.Random(7)
    word = lambda: f"w{rnd.randrange(5000)}"
    passage = " ".join(word() for _ in range(3000))
    # the edges of a part lie in a repeated passage
    long = [" ".join(word() for _ in range(40_000 + 70_000 * i)) + passage * 45 + " ".join(word() for _ in range(99_000)) for i in range(2)]
    assert min(len(x) for x in long) > 3 * suffix_array.CHUNK_BYTES
    rows = [(1, long[0]), (2, long[1]), (3, "-" * 3000), (4, "-" * 900), (5, "a " + "-" * 60), (6, passage)]
    df = spark.createDataFrame([(i, t, "", "", "", "") for i, t in rows], SCHEMA)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_array.repeated_bytes(df).collect()}
    assert got == brute_bytes(rows, 50)
    assert got[2][1] > len(passage) and got[4][1] == 900


def clashing_words(n=1024):
    """Two words that a polynomial modulo 2**64 cannot tell apart, whatever its base."""
    a = "".join("ab"[i.bit_count() % 2] for i in range(n))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_words_of_one_polynomial_hash(spark):
    a, b = clashing_words()
    rest = " ".join(f"r{i}" for i in range(19))
    rows = [(1, f"{a} {rest}"), (2, f"{b} {rest}"), (3, f"{a} {rest}")]
    got = {r.doc_id: r.n_removed for r in substring.repeated_words(spark.createDataFrame([(*r, "", "", "", "") for r in rows], SCHEMA)).collect()}
    assert got == {1: 0, 2: 0, 3: 20}


def test_levels_double_what_repeats(spark):
    """Survivors of each level: five words, then ten around them, then twenty; none after the level that loses all."""
    w = lambda x, n: [f"{x}_{i}" for i in range(n)]
    both = lambda n: [sum((w(f"{x}{j}", 30) + w(f"s{j}", n) for j in range(20)), []) for x in "ab"]
    cases = {"once": both(0), "five": both(7), "fifteen": both(15), "thirty": both(30)}
    found = {}
    for name, docs in cases.items():
        data = [" ".join(d).encode() for d in docs]
        batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([d.decode() for d in data])], names=["_rid", "text"])
        alive, seen = batch, []
        for level in (1, 2, 3):
            sent = [pa.Table.from_batches([x]) for x in substring._looked_at(20, level, 1)(iter([alive]))]
            told = substring._met(level, 1)(pa.concat_tables(sent))
            get = lambda c: np.concatenate([np.zeros(0, np.int64), *(substring.unpack(x).astype(np.int64) for x in told.column(c).to_pylist() if x is not None)])  # noqa: B023, E731
            o = list(zip(get("o_d").tolist(), get("o_s").tolist(), get("o_m").tolist()))
            seen.append((len(o), len(get("z_d"))))
            if not o:
                break
            starts = [np.unique([s + i for d, s, m in o if d == x for i in range(32 if level > 1 else 1) if m >> i & 1]).astype("<u4").tobytes() for x in (1, 2)]
            alive = pa.RecordBatch.from_arrays([*batch.columns, pa.array(starts)], names=["_rid", "text", "starts"])
        found[name] = seen
    assert found["once"] == [(0, 0)]
    assert [len(found[x]) for x in ("five", "fifteen", "thirty")] == [2, 3, 3]
    assert found["five"][0][0] > 0 == found["five"][1][0]
    assert found["fifteen"][1][0] > 0 == found["fifteen"][2][1]
    assert sum(z for _, z in found["thirty"]) > 0 and found["thirty"][0][0] < 400


@pytest.mark.parametrize("length", [2, 3, 7, 20, 33])
def test_word_windows_of_other_lengths(spark, length):
    rows = corpus(8, 40)
    got = substring.repeated_words(spark.createDataFrame(rows, SCHEMA), length).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute_words(rows, length)


def test_very_long_texts_of_words(spark, monkeypatch):
    rnd = random.Random(17)
    word = lambda: f"w{rnd.randrange(3000)}"
    passage = [word() for _ in range(500)]
    long = [[word() for _ in range(150_000)] + passage + [word() for _ in range(99_900 + i)] + passage for i in range(2)]
    rows = [(1, " ".join(long[0])), (2, "\n".join(long[1])), (3, "x" * 300_000 + " y"), (4, " ".join(passage)), (5, "z " * 60_000)]
    assert min(len(x) for x in long) > 2 * substring.PART_WORDS
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.repeated_words(spark.createDataFrame([(*r, "", "", "", "") for r in rows], SCHEMA)).collect()}
    assert got == brute_words(rows, 20)
    assert got[4][1] == 500


def test_hot_passage_in_many_partitions(spark):
    rnd = random.Random(9)
    hot = " ".join(f"h{rnd.randrange(1000)}" for _ in range(45))
    rows = [(i, f"a{i} b{i} {hot} c{i} " + " ".join(f"u{rnd.randrange(9999)}" for _ in range(30)), "", "", "", "") for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(13)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.repeated_words(df).collect()}
    assert got == brute_words(rows, 20)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_array.repeated_bytes(df).collect()}
    assert got == brute_bytes(rows, 50)


def test_sampled_corpus_of_real_rows(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.repeated_words(df).collect()}
    assert got == brute_words(rows, 20)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_array.repeated_bytes(df).collect()}
    assert got == brute_bytes(rows, 50)


def test_lines(spark):
    rows = [
        (1, "a\nb\nc\nd", "", "", "", ""),
        (2, "x\na\nb\nc\nd\ny", "", "", "", ""),
        (3, "q\nq\nq\nq\nq", "", "", "", ""),
        (4, None, "", "", "", ""),
        (5, "", "", "", "", ""),
        (6, "a\nb", "", "", "", ""),
        (7, "a\nb\nc", "", "", "", ""),
    ]
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept_text) for r in lines.repeated_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: (4, 0, "a\nb\nc\nd"), 2: (6, 4, "x\ny"), 3: (5, 4, "q"), 4: (0, 0, None), 5: (1, 0, ""), 6: (2, 0, "a\nb"), 7: (3, 3, "")}


def test_lines_against_brute_force(spark):
    rnd = random.Random(21)
    some = [f"line {i}" for i in range(25)] + ["", " "]
    rows = []
    for i in range(80):
        t = [rnd.choice(some) for _ in range(rnd.choice((0, 1, 2, 3, 8, 40)))]
        rows.append((i * 2, "\n".join(t) if i % 9 else None))
    rows += [(900, "\n".join(f"unique {i}" for i in range(100_000)) + "\n" + "\n".join(some[:5])), (901, "\n".join(some[:5])), (902, "y" * 500_000), (903, "y" * 500_000)]
    first, want = set(), {}
    for i, t in sorted(rows):
        if t is None:
            want[i] = (0, 0, None)
            continue
        own, gone = t.split("\n"), set()
        for k in range(len(own) - 2):
            w = tuple(own[k : k + 3])
            gone |= {k, k + 1, k + 2} if w in first else set()
            first.add(w)
        want[i] = (len(own), len(gone), "\n".join(x for k, x in enumerate(own) if k not in gone))
    df = spark.createDataFrame([(*r, "", "", "", "") for r in rows], SCHEMA)
    for hot in (1000, 2):
        lines.HOT = hot
        try:
            got = {r.doc_id: (r.n_lines, r.n_removed, r.kept_text) for r in lines.repeated_lines(df).collect()}
        finally:
            lines.HOT = 1000
        assert got == want


def test_simhash_ties_and_very_long_texts(spark):
    """A bit set in exactly half the hashes is 0; two different shingles decide by what they share."""
    long = "word " * 300_000 + "end"
    rows = [(1, "a b c d e"), (2, long), (3, "x" * 400_000), (4, "A B c D\te"), (5, "a b c"), (6, None)]
    got = {r.doc_id: r for r in simhash.simhash_groups(spark.createDataFrame([(*r, "", "", "", "") for r in rows], SCHEMA)).collect()}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{brute_print(t):016x}" for i, t in rows}
    h = [xxhash.xxh64_intdigest(s, 42) for s in (b"a b c d", b"b c d e")]
    assert int(got[1].fingerprint, 16) == h[0] & h[1] and got[4].component_id == 1 and got[6].fingerprint == "0" * 16


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    sh = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(prints):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_simhash(spark):
    rnd = random.Random(4)
    base = [f"k{rnd.randrange(500)}" for _ in range(400)]
    rows = corpus(5, 40)
    for i in range(60):
        w = list(base)
        for _ in range(rnd.randint(0, 6)):
            w[rnd.randrange(len(w))] = f"e{rnd.randrange(9)}"
        rows.append((1000 + i, " ".join(w), "", "", "", ""))
    got = simhash.simhash_groups(spark.createDataFrame(rows, SCHEMA)).collect()
    prints = {i: brute_print(t) for i, t, *_ in rows}
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {r.doc_id: r.component_id for r in got} == brute_groups(prints)
    assert sum(r.is_first for r in got) == len({r.component_id for r in got})


def test_keys_lose_no_link():
    rnd = np.random.default_rng(0)
    fp = rnd.integers(0, 2**63, 400, dtype=np.uint64)
    other = fp.copy()
    for i in range(len(other)):
        for b in rnd.choice(64, rnd.integers(0, 5), replace=False):
            other[i] ^= np.uint64(1) << np.uint64(b)
    own = [set() for _ in fp]
    for k, r in zip(*simhash.keys(fp), strict=True):
        own[r].add(int(k))
    met = np.zeros(len(fp), bool)
    for k, r in zip(*simhash.keys(other), strict=True):
        met[r] |= int(k) in own[r]
    assert met.all()


def test_spanning_links_of_a_large_group():
    rnd = np.random.default_rng(1)
    fp = np.unique(np.concatenate([np.uint64(12345) ^ (np.uint64(1) << rnd.integers(0, 64, 500).astype(np.uint64)), rnd.integers(0, 2**63, 100, dtype=np.uint64)]))
    a, b = simhash.spanning_links(np.zeros(len(fp), np.uint32), fp, 4)
    assert (np.bitwise_count(fp[a] ^ fp[b]) <= 64).all() and len(a) < len(fp)
    prints = dict(enumerate(fp.tolist()))
    want = brute_groups(prints)
    root = {i: i for i in prints}
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = want[x], want[y]
        assert x == y
    assert len(a) == len(fp) - len(set(want.values()))
    assert root


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


@pytest.mark.parametrize("fn", [substring.repeated_words, suffix_array.repeated_bytes, lines.repeated_lines, simhash.simhash_groups])
def test_empty_null_and_shared_ids(spark, fn):
    assert fn(spark.createDataFrame([], SCHEMA)).collect() == []
    text = "\n".join(f"line number {i} of some text" for i in range(12))
    rows = [(None, text, "", "", "", ""), (None, text, "", "", "", ""), (5, text, "", "", "", ""), (5, None, "", "", "", ""), (5, "short", "", "", "", "")]
    got = fn(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in got) == [(False, 0)] * 2 + [(True, 5)] * 3
    if "n_removed" in got[0]:
        # of the three copies one is whole, and it is one without an id
        assert sorted(r.n_removed > 0 for r in got) == [False] * 3 + [True] * 2
    else:
        assert sum(r.is_first for r in got) == 3
