"""Line dedup by overlapping windows of three lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RID, settle, with_row_ids

LINES = 3
#: Places of a window above which its join is not dealt out by the window, and windows that may be so at most.
HOT, HOT_WINDOWS = 1_000, 100_000


def repeated_lines(docs: DataFrame, lines: int = LINES) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_text, _rid: texts without later repeats of `lines` lines in a row.

    Lines are what newlines part, unchanged; a window is `lines` consecutive lines
    of one document. A window that also starts earlier (smaller id, or same
    document, earlier line) is a later occurrence, and all positions that such windows
    cover go. Windows are judged on the input. The first place of each window
    is a minimum, which is pre-aggregated; windows that occur once drop out before the
    join. Frequent windows, a bounded number of them, go to the places instead.

    Null text: no lines, kept_text null. Empty text: one empty line. Fewer
    than `lines` lines: kept whole. Very long texts are cut into lines whole, and of
    repeated rows the first keeps its lines. Rows that share an id, or have none: see
    with_row_ids(). Other columns are ignored; an empty table gives an empty result.
    """
    return lines_of(with_row_ids(docs), lines)


def lines_of(own: DataFrame, lines: int = LINES) -> DataFrame:
    """The same of rows from with_row_ids(); other columns are kept."""
    rest = [c for c in own.columns if c not in ("doc_id", "text", RID)]
    parts, lost = "_l", "_gone"
    while {parts, lost} & set(rest):
        parts, lost = parts + "_", lost + "_"
    split = own.select(RID, F.split("text", "\n", -1).alias("l")).filter(F.size("l") >= lines)
    hashed = split.select(RID, F.transform("l", lambda x: F.xxhash64(x)).alias("h"), F.transform("l", lambda x: F.hash(x)).alias("g"))
    windows = hashed.select(
        RID,
        F.posexplode(
            F.transform(
                F.sequence(F.lit(1), F.size("h") - (lines - 1)),
                lambda i: F.struct(F.xxhash64(F.slice("h", i, lines)).alias("a"), F.xxhash64(F.slice("g", i, lines)).alias("b")),
            )
        ).alias("at", "w"),
    ).select(RID, "at", "w.a", "w.b")
    windows = settle(windows, "windows")
    first = windows.groupBy("a", "b").agg(F.min(F.struct(RID, "at")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    first = settle(first, "first")
    total = first.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(first.filter(F.col("n") > max(HOT, total // HOT_WINDOWS)).select("a", "b", "first"))  # HOT_WINDOWS rows at most
    rest_of = windows.join(hot, ["a", "b"], "left_anti").join(first.select("a", "b", "first"), ["a", "b"])
    later = windows.join(hot, ["a", "b"]).unionByName(rest_of)
    later = later.filter((F.col(RID) != F.col(f"first.{RID}")) | (F.col("at") != F.col("first.at")))
    cut = later.groupBy(RID).agg(F.collect_list("at").alias("at"))
    gone = F.array_distinct(F.flatten(F.transform("at", lambda x: F.sequence(x, x + (lines - 1)))))
    cut = cut.select(RID, gone.alias(lost))
    joined = own.join(cut, RID, "left").withColumn(parts, F.split("text", "\n", -1))
    places = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(lost))
    kept = F.when(F.col(lost).isNull(), F.col("text")).otherwise(F.array_join(F.transform(places, lambda i: F.get(parts, i)), "\n"))
    return joined.select(
        "doc_id",
        F.when(F.col(parts).isNull(), 0).otherwise(F.size(parts)).cast("long").alias("n_lines"),
        F.coalesce(F.size(lost), F.lit(0)).cast("long").alias("n_removed"),
        kept.alias("kept_text"),
        RID,
        *rest,
    )
