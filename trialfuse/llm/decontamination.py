"""Benchmark decontamination: size-partitioned MinHash containment search, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import RID, settle

SHINGLE, CONTAINMENT = 5, 0.8
BROADCAST_BYTES = 64 << 20
_ITEM = "_item"


def words(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _each(w: Column, k: int, fn) -> Column:
    """fn of each shingle of k words; fewer words have none."""
    return F.when(F.size(w) < k, F.array()).otherwise(F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)), lambda i: fn(F.slice(w, i, k))))


def shingle_names(w: Column, k: int) -> Column:
    return _each(w, k, F.xxhash64)


def shingle_texts(w: Column, k: int) -> Column:
    return _each(w, k, lambda s: F.array_join(s, " "))


def _of_lengths(w: Column, lengths: list[int], fn) -> Column:
    return F.concat(*[fn(w, m) for m in lengths])


def small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Marked for broadcast where its counted size is under the limit; else Spark shuffles it."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def item_signatures(items: DataFrame, k: int = SHINGLE, containment: float = CONTAINMENT) -> tuple[DataFrame, DataFrame, list[int]]:
    """((_item, item_id, n, need, shingles), (_item, h), lengths of shingles that occur).

    An item of fewer than k words is one shingle of its own length, so at most
    k lengths occur. _item names the row of an item, whose id may be null or
    shared. Items are partitioned by size: n distinct shingles belong to the
    partition of the next power of two, u. An item's signature is its
    floor(u * (1 - containment)) + 1 smallest shingle hashes (all, if it has
    fewer), a bottom-k MinHash. The length serves every size in the partition: a
    document that holds the share `containment` of the n lacks at most
    floor(n * (1 - containment)) of them, fewer than the signature has, so it
    holds one of the signature. No item can be missed.
    """
    own = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("_t"))
    own = own.select("item_id", F.xxhash64(F.coalesce("item_id", F.lit(-1)), "_t").alias(_ITEM), words(F.col("_t")).alias("_w")).filter("size(_w) > 0")
    own = own.withColumn("_k", F.least(F.size("_w"), F.lit(k)))
    lengths = sorted(r[0] for r in own.select("_k").distinct().collect())
    if not lengths:
        lengths = [k]
    own = own.withColumn("shingles", F.array_distinct(F.coalesce(*[F.when(F.col("_k") == m, shingle_texts(F.col("_w"), m)) for m in lengths])))
    need = lambda n: F.ceil(F.round(n * containment, 6))
    own = own.withColumn("n", F.size("shingles")).withColumn("need", need(F.col("n")).cast("int"))
    own = own.withColumn("u", F.pow(F.lit(2.0), F.ceil(F.round(F.log2("n"), 9))))
    length = F.least(F.col("n"), F.floor(F.round(F.col("u") * (1 - containment), 6)) + 1).cast("int")
    names = F.array_sort(F.transform(F.col("shingles"), lambda s: F.xxhash64(F.split(s, " "))))
    signatures = own.select(_ITEM, F.explode(F.slice(names, F.lit(1), length)).alias("h")).distinct()
    return own.select(_ITEM, "item_id", "n", "need", "shingles"), signatures, lengths


def leaks(docs: DataFrame, items: DataFrame, k: int = SHINGLE, containment: float = CONTAINMENT) -> DataFrame:
    """_rid, doc_id, item_id, n_shingles, n_shared: the items of which a document holds the share `containment`.

    Words are runs of letters and digits in lower case, shingles have k words;
    an item of fewer words is one shingle of its length, which a document may hold anywhere.
    Documents are long and items short, so whole-document MinHashes would say
    nothing; the signatures of the items, of a length set by their size partition, are
    sought among all shingle hashes of each document. Candidates alone are
    read again, and verified by exact shingle containment.

    Null or wordless texts and items match nothing. A share of exactly
    `containment` matches. Items that share an id, or have none, are items of their own
    with equal ids in the result. Rows of documents that share an id, or have
    none, are searched each by itself. Very long texts are searched whole: one
    row holds the shingle hashes of one text. Other columns are ignored; an empty table
    gives an empty result.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return leaks_of(own.withColumn(RID, F.xxhash64("doc_id", "text")), items, k, containment)


def leaks_of(own: DataFrame, items: DataFrame, k: int = SHINGLE, containment: float = CONTAINMENT) -> DataFrame:
    """The same of rows (_rid, doc_id, text). Rows with one _rid share candidates; each is verified by itself.

    Only ids travel: the second pass meets the counted candidate ids where the
    texts are read, and cuts words of those texts alone.
    """
    own = own.select(RID, "doc_id", "text")
    tests, signatures, lengths = item_signatures(items, k, containment)
    # word arrays are columns of their own: inside a shingle's lambda they would be cut again for each shingle
    seen = own.select(RID, words(F.col("text")).alias("_w")).select(RID, F.explode(_of_lengths(F.col("_w"), lengths, shingle_names)).alias("h"))
    candidates = settle(seen.join(small(signatures, 48), "h").select(RID, _ITEM).distinct(), "candidates")
    n = candidates.count()
    few = n * 96 <= BROADCAST_BYTES
    wanted = candidates.groupBy(RID).agg(F.collect_list(_ITEM).alias("items"))
    met = own.join(F.broadcast(wanted) if few else wanted, RID)
    met = met.select(RID, "doc_id", "items", words(F.col("text")).alias("_w")).select(RID, "doc_id", "items", _of_lengths(F.col("_w"), lengths, shingle_texts).alias("_has"))
    size = tests.agg(F.sum(F.aggregate("shingles", F.lit(64).cast("long"), lambda a, s: a + F.octet_length(s) + 16))).first()[0] or 0
    pairs = met.select(RID, "doc_id", "_has", F.explode("items").alias(_ITEM)).join(F.broadcast(tests) if size <= BROADCAST_BYTES else tests, _ITEM)
    pairs = pairs.withColumn("n_shared", F.size(F.array_intersect("shingles", "_has"))).filter("n_shared >= need")
    return pairs.select(RID, "doc_id", "item_id", F.col("n").cast("long").alias("n_shingles"), F.col("n_shared").cast("long").alias("n_shared"))
