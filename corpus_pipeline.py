"""Corpus cleaning in five stages over the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialfuse.llm import decontamination, lines, quality, sentencepiece_codec, simhash
from trialfuse.llm.common import RID, settle, with_row_ids

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
REST = COLUMNS[2:]


def without(own: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of own whose _rid is not in gone; ids alone travel while their counted size allows it."""
    return own.join(decontamination.small(gone.select(RID), 48), RID, "left_anti").select(*COLUMNS)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps.

    Null, empty and wordless texts go. Very long texts count whole. Rows that
    share an id, or have none, are judged each by itself, and so are repeated rows. A score of
    exactly the threshold is kept. Other columns are dropped; an empty table stays empty.
    """
    own = with_row_ids(docs, REST)
    return without(own, settle(quality.classify_rows(own).filter("not keep").select(RID), "rejected"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later repeats of three lines; n_chars is counted anew.

    Every row stays: null texts as they are (n_chars null), texts that lose all lines as empty ones.
    Very long texts are cut into lines whole. Repeated rows: the first keeps its lines. Rows that share an id, or have none:
    see with_row_ids(). Other columns are dropped; an empty table stays empty.
    """
    out = lines.lines_of(with_row_ids(docs, REST[:2]))
    return out.select("doc_id", F.col("kept_text").alias("text"), *REST[:2], F.length("kept_text").cast("long").alias("n_chars"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component, that of the smallest id.

    Null and empty texts have one fingerprint, so one of them stays. Rows that
    share an id, or have none, are documents of their own; of repeated rows one stays. Very long texts
    are read whole. Other columns are dropped; an empty table stays empty.
    """
    own = with_row_ids(docs, REST)
    return without(own, settle(simhash.groups_of(own).filter("not is_first").select(RID), "copies"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none and stay. Rows that share an id, or have
    none, and repeated rows are judged each by itself; very long texts are searched whole. Other columns are
    dropped; an empty table stays empty, and an empty benchmark drops nothing.
    """
    own = with_row_ids(docs, REST)
    return without(own, settle(decontamination.leaks_of(own, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(RID).distinct(), "leaks"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and the ids of the whole text; every row by itself.

    Null and empty texts have no ids; an empty table gives an empty one.
    """
    return sentencepiece_codec.encode(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_leaks),
    ("SentencePiece encoding", encode),
]

#: A fitted scorer and a tokenizer are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
