"""Queries of the numbered operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, lines, lm_scoring, media, merkle, quality, sentencepiece_codec, simhash, substring, suffix_array, topk, whitening
from . import toxicity as tox


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_shingles", "n_shared")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.align(media.fingerprints(media.render(_table(spark, sf_dir, "embeddings"))))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = _table(spark, sf_dir, "labels").filter("quality = 1")
    return lm_scoring.cross_entropy_difference(_table(spark, sf_dir, "documents"), good)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tox.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents")).drop("_rid")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_words(_table(spark, sf_dir, "documents")).drop("kept_text")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.repeated_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array.repeated_bytes(_table(spark, sf_dir, "documents")).drop("kept")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digests(_table(spark, sf_dir, "documents"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(_table(spark, sf_dir, "documents")).drop("tree", "rank", "proof")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1,
    "op2_audio_fingerprints": op2,
    "op3_lm_scoring": op3,
    "op4_toxicity": op4,
    "op5_quality_classifier": op5,
    "op6_substring_dedup": op6,
    "op7_line_dedup": op7,
    "op8_suffix_array_dedup": op8,
    "op9_sentencepiece": op9,
    "op10_simhash": op10,
    "op11_whitening": op11,
    "op12_exact_top_k": op12,
    "op13_merkle_manifest": op13,
}

ORACLE_SQL: dict[str, str] = {
    "op1_decontamination": r"""
WITH d0 AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
b0 AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
m AS (SELECT DISTINCT least(len(w), 5) AS m FROM b0 WHERE len(w) > 0),
d AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS s FROM d0, m WHERE len(w) >= m),
b AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS s FROM b0 JOIN m ON least(len(w), 5) = m),
n AS (SELECT item_id, count(*) AS n_shingles FROM b GROUP BY item_id)
SELECT doc_id, item_id, n_shingles, count(*) AS n_shared FROM d JOIN b USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n_shingles HAVING count(*) >= ceil(round(n_shingles * 0.8, 6))""",
    "op6_substring_dedup": r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w)),
m AS (SELECT doc_id, i, row_number() OVER (PARTITION BY x ORDER BY doc_id, i) > 1 AS later FROM s),
g AS (SELECT DISTINCT doc_id, i + k AS i FROM m, (SELECT unnest(range(0, 20)) AS k) WHERE later),
u AS (SELECT doc_id, i, w[i] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w)),
k AS (SELECT u.doc_id, count(*) AS n_kept, string_agg(u.x, ' ' ORDER BY u.i) AS t FROM u ANTI JOIN g ON u.doc_id = g.doc_id AND u.i = g.i GROUP BY u.doc_id)
SELECT w.doc_id, len(w.w) AS n_words, len(w.w) - coalesce(k.n_kept, 0) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM w LEFT JOIN k ON w.doc_id = k.doc_id""",
    "op7_line_dedup": r"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
s AS (SELECT doc_id, i, array_to_string(l[i:i + 2], chr(10)) AS x FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS i FROM l)),
m AS (SELECT doc_id, i, row_number() OVER (PARTITION BY x ORDER BY doc_id, i) > 1 AS later FROM s),
g AS (SELECT DISTINCT doc_id, i + k AS i FROM m, (SELECT unnest(range(0, 3)) AS k) WHERE later),
u AS (SELECT doc_id, i, l[i] AS x FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM l)),
k AS (SELECT u.doc_id, count(*) AS n_kept, string_agg(u.x, chr(10) ORDER BY u.i) AS t FROM u ANTI JOIN g ON u.doc_id = g.doc_id AND u.i = g.i GROUP BY u.doc_id)
SELECT l.doc_id, coalesce(len(l.l), 0) AS n_lines, coalesce(len(l.l), 0) - coalesce(k.n_kept, 0) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM l LEFT JOIN k ON l.doc_id = k.doc_id""",
    "op8_suffix_array_dedup": r"""
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, c, substr(h, 2000 * c + 1, 2098) AS t FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2000 + 1)) AS c FROM b)),
s AS (SELECT doc_id, 1000 * c + j AS i, substr(t, 2 * j - 1, 100) AS x FROM (SELECT doc_id, c, t, unnest(range(1, least(1000, len(t) // 2 - 49) + 1)) AS j FROM c)),
f AS (SELECT x, min(doc_id) AS first FROM s GROUP BY x HAVING count(*) > 1),
m AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS step FROM s JOIN f USING (x) WHERE first < doc_id),
r AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS z FROM (SELECT doc_id, i, count_if(step IS NULL OR step > 50) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS k FROM m) GROUP BY doc_id, k),
p AS (SELECT doc_id, lag(z, 1, 1) OVER (PARTITION BY doc_id ORDER BY a) AS a, a AS z FROM r UNION ALL SELECT doc_id, max(z), NULL FROM r GROUP BY doc_id),
g AS (SELECT p.doc_id, string_agg(substr(h, 2 * a - 1, 2 * (coalesce(z, len(h) // 2 + 1) - a)), '' ORDER BY a) AS t, count(*) - 1 AS n_spans FROM p JOIN b USING (doc_id) GROUP BY p.doc_id)
SELECT doc_id, len(h) // 2 AS n_bytes, (len(h) - len(coalesce(t, h))) // 2 AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(t, h))) AS kept_sha256 FROM b LEFT JOIN g USING (doc_id)""",
    "op12_exact_top_k": r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(64 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = len(embedding)),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i])) AS BIGINT) AS score
FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20""",
    "op13_merkle_manifest": r"""
WITH RECURSIVE f AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, n_chars,
coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
coalesce(strlen(text) || ':' || text, '-') AS tail,
list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)) AS crc FROM documents),
l AS (SELECT doc_id, tree, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
CASE WHEN xor(crc, 4294967295) % 7 = 0 AND n_chars IS NOT NULL THEN sha256(head || strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1) || tail) END AS changed FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank, count(*) OVER (PARTITION BY tree) AS n FROM l),
t AS (SELECT tree, 0 AS h, rank AS i, leaf AS d, n FROM r UNION ALL
SELECT tree, h + 1, i // 2, sha256(string_agg(d, '' ORDER BY i)), (n + 1) // 2 FROM t WHERE n > 1 GROUP BY tree, h, i // 2, n),
s AS (SELECT tree, d AS subroot, row_number() OVER (ORDER BY tree) - 1 AS rank, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS h, rank AS i, subroot AS d, n FROM s UNION ALL
SELECT h + 1, i // 2, sha256(string_agg(d, '' ORDER BY i)), (n + 1) // 2 FROM u WHERE n > 1 GROUP BY h, i // 2, n),
p AS (SELECT r.tree, r.rank, t.h AS h, (r.rank >> t.h) % 2 AS digit, o.d AS other FROM r JOIN t ON t.tree = r.tree AND t.i = r.rank >> t.h AND t.n > 1
LEFT JOIN t o ON o.tree = t.tree AND o.h = t.h AND o.i = xor(t.i, 1)
UNION ALL SELECT r.tree, r.rank, 1000 + u.h, (s.rank >> u.h) % 2, o.d FROM r JOIN s USING (tree) JOIN u ON u.i = s.rank >> u.h AND u.n > 1 LEFT JOIN u o ON o.h = u.h AND o.i = xor(u.i, 1)),
g AS (SELECT tree, rank, sha256(coalesce(string_agg(other, '' ORDER BY h), '')) AS proof_sha256, list(struct_pack(g := digit, o := coalesce(other, '')) ORDER BY h) AS steps FROM p GROUP BY tree, rank),
k AS (SELECT r.tree, r.rank, coalesce(r.changed, r.leaf) AS d, coalesce(g.steps, []) AS steps, 1 AS z FROM r LEFT JOIN g USING (tree, rank) UNION ALL
SELECT tree, rank, sha256(CASE WHEN steps[z].g = 0 THEN d || steps[z].o ELSE steps[z].o || d END), steps, z + 1 FROM k WHERE z <= len(steps))
SELECT r.doc_id, r.leaf, s.subroot, u.d AS root, coalesce(g.proof_sha256, sha256('')) AS proof_sha256, k.d AS folded_root, k.d = u.d AS verified
FROM r JOIN s USING (tree) JOIN u ON u.n = 1 LEFT JOIN g ON g.tree = r.tree AND g.rank = r.rank JOIN k ON k.tree = r.tree AND k.rank = r.rank AND k.z > len(k.steps)""",
}
