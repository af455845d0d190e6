"""Merkle manifest of a table: a store of digest-to-children records, and proofs by descent from the root."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, settle

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Two nodes make one. A segment has so many levels, so at most 2**LEVELS nodes at its foot.
FAN, LEVELS = 2, 10
TAMPERED = 7
_TOP = "top"


def encoded(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*columns: Column) -> Column:
    return F.sha2(F.concat(*map(encoded, columns)), 256)


def hashed(nodes: list[str]) -> str:
    return sha256("".join(nodes).encode()).hexdigest()


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, tree, leaf, changed): the leaf of each row, and that of the row with n_chars + 1 where tampering hits it.

    tree names the rows' language: empty for null, else after `=`, so that trees sort as languages do, null first.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("n_chars").cast("long").alias("n_chars"), F.col("text").cast("string").alias("text"))
    hit = F.crc32(F.col("doc_id").cast("string")) % TAMPERED == 0
    changed = digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars") + 1, F.col("text"))
    leaf = digest(*map(F.col, FIELDS))
    return own.select("doc_id", F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("tree"), leaf.alias("leaf"), F.when(hit & F.col("n_chars").isNotNull(), changed).alias("changed"))


def ranked(nodes: DataFrame, *order: str) -> DataFrame:
    """nodes with rank, a row's place in its tree from 0: one range sort, then offsets of trees and partitions.

    Rows that agree in all of `order` are parted by their place in the input, so that ties never make one partition.
    The windows run over one row for each tree and partition.
    """
    placed = nodes.withColumn("_in", F.monotonically_increasing_id()).sort("tree", *(F.asc_nulls_first(c) for c in order), "_in").drop("_in")
    placed = settle(placed.withColumn("_at", F.monotonically_increasing_id()), "sorted").withColumn("_part", F.shiftright("_at", 33))
    counts = placed.groupBy("tree", "_part").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("_first"))
    before = F.sum("n").over(Window.partitionBy("tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("tree", "_part", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"))
    return placed.join(starts, ["tree", "_part"]).withColumn("rank", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def levels_of(n: int, levels: int = LEVELS) -> int:
    """Levels above n nodes until one is left, at most `levels`."""
    return min(levels, max(n - 1, 0).bit_length())


def raised(nodes: list[str], levels: int) -> tuple[str, list[tuple[str, list[str]]]]:
    """(the node on top, records of each node above and its children)."""
    records = []
    for _ in range(levels):
        parts = [nodes[i : i + FAN] for i in range(0, len(nodes), FAN)]
        nodes = [hashed(p) for p in parts]
        records += zip(nodes, parts, strict=True)
    return nodes[0], records


def packed(nodes: DataFrame, levels: int, *carry: str) -> DataFrame:
    """(tree, seg, nodes array<struct<rank, digest, carry...>>): what lies under each segment by rank, at most 2**levels nodes."""
    items = F.sort_array(F.collect_list(F.struct("rank", "digest", *carry)))
    return settle(nodes.withColumn("seg", F.shiftright("rank", levels)).groupBy("tree", "seg").agg(items.alias("nodes")), "segments")


class Forest:
    """Trees in the store: .bands from the foot up, .foot as packed() made it, .roots (tree, digest, band).

    A band is a written table (tree, rank, size, digest, levels, records): a segment of the tree below `digest`,
    as records of a digest and its children.
    """

    def __init__(self, nodes: DataFrame, *carry: str, levels: int = LEVELS):
        """nodes: (tree, rank, digest, carry...)."""
        self.levels, self.bands, self.foot, roots = levels, [], None, []
        sizes = nodes.groupBy("tree").agg(F.count(F.lit(1)).alias("size"))
        while True:
            segments = packed(nodes, levels, *carry)
            band = settle(self._raise(segments.join(sizes, "tree").select("tree", "seg", "size", F.col("nodes.digest").alias("digests"))), "band")
            if self.foot is None:
                self.foot, carry = segments, ()
            roots.append(band.filter("size = 1").select("tree", "digest", F.lit(len(self.bands)).alias("band")))
            self.bands.append(band)
            nodes = band.filter("size > 1").select("tree", "rank", "size", "digest")
            if nodes.isEmpty():
                break
            sizes = nodes.select("tree", "size").distinct()
            nodes = nodes.drop("size")
        self.roots = roots[0]
        for r in roots[1:]:
            self.roots = self.roots.unionByName(r)

    def _raise(self, segments: DataFrame) -> DataFrame:
        most = self.levels
        record = pa.struct([("digest", pa.string()), ("children", pa.list_(pa.string()))])
        kinds = {"tree": pa.string(), "rank": pa.int64(), "size": pa.int64(), "digest": pa.string(), "levels": pa.int32(), "records": pa.list_(record)}

        def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out: dict[str, list] = {name: [] for name in kinds}
                for tree, seg, size, digests in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    levels = levels_of(size, most)
                    top, records = raised(digests, levels)
                    row = (tree, seg, (size - 1 >> most) + 1, top, levels, [{"digest": d, "children": c} for d, c in records])
                    for name, value in zip(kinds, row, strict=True):
                        out[name].append(value)
                yield pa.RecordBatch.from_arrays([pa.array(out[name], kind) for name, kind in kinds.items()], names=list(kinds))

        return map_arrow(segments, fn, "tree string, rank long, size long, digest string, levels int, records array<struct<digest string, children array<string>>>")

    def store(self, band: int) -> DataFrame:
        """The records of a band, addressed by content: equal digests are one row."""
        return self.bands[band].select("digest", "levels", "records").dropDuplicates(["digest"])

    def descend(self, entries: DataFrame, asked: DataFrame) -> DataFrame:
        """(tree, seg, digest, path) of the segments asked, on band 0: down from where each tree is entered.

        entries: (tree, digest, band, path), the roots; asked: (tree, seg), each segment once.
        """
        states = None
        for band in reversed(range(len(self.bands))):
            here = entries.filter(F.col("band") == band).select("tree", F.lit(0).cast("long").alias("seg"), "digest", "path")
            states = here if states is None else states.unionByName(here)
            if band:
                below = asked.select("tree", F.shiftright("seg", self.levels * (band - 1)).alias("rank")).distinct()
                below = below.groupBy("tree", F.shiftright("rank", self.levels).alias("seg")).agg(F.sort_array(F.collect_list("rank")).alias("ranks"))
                states = settle(step(states.join(self.store(band), "digest").join(below, ["tree", "seg"])), "states")
        return states


def walk(top: str, levels: int, records: list[dict], ranks: list[int], path: list[str]) -> Iterator[tuple[str, list[str]]]:
    """(digest, path) of each rank: down from top by the ranks' digits, those with the same digits together.

    A step of a path is the chosen child's parent as it was hashed, with `*` in place of the child.
    """
    children = {r["digest"]: r["children"] for r in records}
    at = [(top, 0, len(ranks), path)]
    for level in reversed(range(levels)):
        below = []
        for node, low, high, way in at:
            kids = children[node]
            while low < high:
                place = ranks[low] // FAN**level
                end = bisect_left(ranks, (place + 1) * FAN**level, low, high)
                i = place % FAN
                below.append((kids[i], low, end, [*way, "".join([*kids[:i], "*", *kids[i + 1 :]])]))
                low = end
        at = below
    for node, low, high, way in at:
        for _ in range(low, high):
            yield node, way


def step(met: DataFrame) -> DataFrame:
    """(tree, seg, digest, path) of the nodes asked at a band's foot."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                found = list(walk(r["digest"], r["levels"], r["records"], r["ranks"], r["path"]))
                columns = [pa.array([r["tree"]] * len(found), pa.string()), pa.array(r["ranks"], pa.int64()), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=["tree", "seg", "digest", "path"])

    return map_arrow(met.select("tree", "digest", "path", "levels", "records", "ranks"), fn, "tree string, seg long, digest string, path array<string>")


def folded(node: str, proof: list[str]) -> str:
    """The root that a node and its proof lead to."""
    for preimage in proof:
        node = sha256(preimage.replace("*", node).encode()).hexdigest()
    return node


def prove(states: DataFrame, forest: Forest, requests: DataFrame) -> DataFrame:
    """tree, rank, doc_id, leaf, changed, proof array<string>, proof_sha256, folded_root of each request.

    states: (tree, seg, digest, path) of band 0. requests: (tree, seg, nodes array<struct<rank, digest, doc_id, changed>>),
    by rank. The path from the root is reversed, so a proof begins at the leaf.
    """
    kinds = {"tree": pa.string(), "rank": pa.int64(), "doc_id": pa.int64(), "leaf": pa.string(), "changed": pa.string(), "proof": pa.list_(pa.string()), "proof_sha256": pa.string(), "folded_root": pa.string()}

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):
                r = b.slice(at, 1).to_pylist()[0]
                out: dict[str, list] = {name: [] for name in kinds}
                found = walk(r["digest"], r["levels"], r["records"], [x["rank"] for x in r["nodes"]], r["path"])
                for x, (leaf, path) in zip(r["nodes"], found, strict=True):
                    if leaf != x["digest"]:
                        raise ValueError(f"rank {x['rank']} of {r['tree']!r} is another leaf in the manifest")
                    proof = path[::-1]
                    row = (r["tree"], x["rank"], x["doc_id"], leaf, x["changed"], proof, hashed([p.replace("*", "") for p in proof]), folded(x["changed"] or leaf, proof))
                    for name, value in zip(kinds, row, strict=True):
                        out[name].append(value)
                yield pa.RecordBatch.from_arrays([pa.array(out[name], kind) for name, kind in kinds.items()], names=list(kinds))

    met = states.join(forest.store(0), "digest").join(requests, ["tree", "seg"]).select("tree", "digest", "path", "levels", "records", "nodes")
    return map_arrow(met, fn, "tree string, rank long, doc_id long, leaf string, changed string, proof array<string>, proof_sha256 string, folded_root string")


class Manifest:
    """Leaves of documents, a tree for each language, and a tree over their roots: .forest, .top, .subroots, .root."""

    def __init__(self, docs: DataFrame, levels: int = LEVELS):
        found = settle(leaves(docs), "leaves").withColumnRenamed("leaf", "digest")
        self.root, self.spark = None, docs.sparkSession
        if found.isEmpty():
            return
        self.forest = Forest(ranked(found, "doc_id", "digest"), "doc_id", "changed", levels=levels)
        roots = self.forest.roots.select(F.lit(_TOP).alias("tree"), F.col("tree").alias("name"), "digest", "band")
        self.subroots = settle(ranked(roots, "name"), "subroots")
        self.top = Forest(self.subroots.select("tree", "rank", "digest"), levels=levels)
        self.root = self.top.roots.first()["digest"]

    def proofs(self, requests: DataFrame | None = None) -> DataFrame:
        """prove() with subroot and root, of all leaves or of requests (tree, rank)."""
        none = F.array().cast("array<string>")
        asked = self.forest.foot
        if requests is not None:
            wanted = asked.select("tree", "seg", F.explode("nodes").alias("x")).withColumn("rank", F.col("x.rank")).join(requests.select("tree", "rank").distinct(), ["tree", "rank"], "left_semi")
            asked = settle(wanted.groupBy("tree", "seg").agg(F.sort_array(F.collect_list("x")).alias("nodes")), "requests")
        names = asked.select("tree").distinct().select(F.col("tree").alias("name"))
        ranks = self.subroots.join(names, "name", "left_semi").select("tree", "rank")
        tops = self.top.descend(self.top.roots.withColumn("path", none), ranks.select("tree", F.shiftright("rank", self.top.levels).alias("seg")).distinct())
        groups = ranks.groupBy("tree", F.shiftright("rank", self.top.levels).alias("seg")).agg(F.sort_array(F.collect_list("rank")).alias("ranks"))
        paths = step(tops.join(self.top.store(0), "digest").join(groups, ["tree", "seg"])).select(F.col("seg").alias("rank"), "path")
        entries = settle(self.subroots.select(F.col("name").alias("tree"), "rank", "digest", "band").join(paths, "rank").drop("rank"), "entries")
        states = self.forest.descend(entries, asked.select("tree", "seg"))
        subroots = entries.select("tree", F.col("digest").alias("subroot"))
        return prove(states, self.forest, asked).join(subroots, "tree").withColumn("root", F.lit(self.root))


def audit(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, tree, rank, proof: one row for each document.

    A leaf is the SHA-256 of doc_id, source, lang, n_chars and text. Per language leaves
    ascend by doc_id and are hashed in twos until one is left; the roots of all languages, by
    language, likewise. Where 7 divides the CRC-32 of the id, folded_root starts from the leaf of the row with n_chars + 1.

    Null fields are hashed as `-`; a null n_chars can't be tampered with, nor can a row without an id. Null and
    empty languages are two languages. Null ids come first in their language. Rows
    that share an id and a language are leaves of their own, by digest; repeated rows have the same leaf and
    places of their own. Very long texts are hashed whole. Other columns are ignored; an
    empty table gives an empty result and has no root.
    """
    made = Manifest(docs, levels)
    if made.root is None:
        return made.spark.createDataFrame([], "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, tree string, rank long, proof array<string>")
    out = made.proofs().withColumn("verified", F.col("folded_root") == F.col("root"))
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "tree", "rank", "proof")
