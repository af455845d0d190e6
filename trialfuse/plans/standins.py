"""The driver's tables seen as gaze samples, polygons, answers, EEG scenes, markers and signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import POINTS
from ..sources.discovery import list_files
from ..sources.scratch import new_path

#: Polygons over x in 0-99 and y in 0-490; `notch` is not convex.
POLYGONS = {
    "left": [(0, 0), (50, 0), (50, 100), (0, 100)],
    "middle": [(25, 0), (75, 0), (75, 200), (25, 200)],
    "notch": [(50, 0), (99, 0), (99, 100), (75, 40), (50, 100)],
}
SCREEN = (99.0, 400.0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def gaze(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    t_ms = F.floor(t / 1000).cast("long")
    return e.select(
        F.col("user_id").cast("string").alias("participant_id"),
        (F.dayofmonth("ts") % 3 + 1).cast("long").alias("scene_id"),
        F.col("event_id").alias("seq"),
        t_ms.alias("t_ms"),
        (t_ms % 86400000).alias("clock_ms"),
        F.get_json_object("props", "$.k").cast("double").alias("gx"),
        F.col("value").alias("gy"),
        (F.col("event_id") % 8).alias("fix_id"),
        F.col("value").alias("fix_dur"),
        F.col("event_type").alias("val_l"),
        F.col("value").alias("pupil_l"),
        F.when(F.col("event_id") % 3 > 0, F.get_json_object("props", "$.k").cast("double")).alias("pupil_r"),
        F.col("event_type").alias("type"),
    )


ACCEPTED = ("click", "view", "purchase", "scroll", "login", "logout", "signup")


def polygons(spark: SparkSession) -> DataFrame:
    rows = [(n, 1, [(float(x), float(y)) for x, y in p]) for n, p in POLYGONS.items()]
    return spark.createDataFrame(rows, f"class_name string, polygon_id int, points {POINTS}")


#: Line items of one task in the joins of answers(), about.
ANSWERS_A_TASK = 250_000


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their orders and customers. Beyond ANSWERS_A_TASK for each core or partition of the session, more
    partitions share the joins and what is grouped behind them, and none are merged, so that a task's memory stays as it is."""
    li, o, c = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    parts = -(-li.count() // ANSWERS_A_TASK)
    if parts > min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism):
        li, o, c = li.repartition(parts, "l_orderkey"), o.repartition(parts, "o_orderkey"), c.repartition(parts, "c_custkey")
        o_li = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).repartition(parts, "o_custkey")
    else:
        o_li = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    d = o_li.join(c, F.col("o_custkey") == F.col("c_custkey"))
    level = F.when(F.col("o_orderstatus") == "F", 15).when(F.col("o_orderstatus") == "O", 45).when(F.col("o_orderstatus") == "P", 75)
    return d.select(
        F.col("o_custkey").cast("string").alias("participant_id"),
        F.col("l_orderkey").alias("scene_id"),
        level.alias("WWR"),
        F.col("l_quantity").alias("S1"),
        (F.col("l_discount") * 100).alias("S2"),
        (F.col("l_tax") * 100).alias("S3"),
        F.col("l_linenumber").cast("double").alias("S4"),
        F.col("c_mktsegment").alias("ExperienceGroup"),
        F.col("l_returnflag").alias("Complexity"),
        F.col("l_linestatus").alias("Gender"),
    )


def eeg_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order; orders without line items have no metrics."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("rms_mean_uV"), F.round(F.avg("l_discount"), 6).alias("hf_ratio_20_40Hz"), F.count(F.lit(1)).cast("double").alias("view_dur_s"))
    o = table(spark, sf_dir, "orders")
    return o.join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_custkey").cast("string").alias("participant_id"), F.col("o_orderkey").alias("scene_id"), "rms_mean_uV", "hf_ratio_20_40Hz", "view_dur_s")


def markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaze(spark, sf_dir).select(F.col("participant_id").alias("subject_id"), F.col("seq").alias("ev_ix"), "type", F.col("t_ms").alias("latency"))


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("segment"), F.concat(F.lit("roi"), F.col("label").cast("string")).alias("roi"), F.posexplode("embedding").alias("sample_ix", "uV")).withColumn("uV", F.col("uV").cast("double")).withColumn("channel", F.col("sample_ix") % 4)


def folder(size: str = "p_size", key: str = "p_partkey") -> Column:
    """Scene folder names of both schemes, folders for getting used to the device, and names of neither."""
    cond, wwr, block = f"({key} % 2)", f"(15 + 30 * ({key} % 3))", f"(1 + {key} % 5 % 2)"
    at = f"(1 + {key} % 6)"
    return F.expr(
        f"CASE {size} % 5 WHEN 0 THEN concat({block}, '-C', {cond}, 'W', {wwr}) WHEN 1 THEN concat('(1-', {block}, '-', {at}, '、2-', {block}, '-', 7 - {at}, ') 组', {cond}, '-C', {cond}, 'W', {wwr})"
        f" WHEN 2 THEN concat({block}, '-c', {cond}, 'w', {wwr}) WHEN 3 THEN '适应 1' ELSE concat('folder ', {key}) END"
    )


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of recordings: one for each part and part name."""
    p = table(spark, sf_dir, "part").withColumn("folder", folder())
    day = F.date_format(F.date_add(F.lit("2026-04-01").cast("date"), (F.col("p_partkey") % 60).cast("int")), "yyMMdd")
    name = F.concat(F.lit("raw_name"), F.col("p_partkey") % 40, F.when(F.col("p_partkey") % 7 == 0, "-12-3").otherwise(""), F.lit("_"), day, F.lit("1200_"), F.col("p_partkey"), F.lit(".csv"))
    root = F.concat(F.lit("/root/"), F.col("folder"))
    return p.select(F.concat(root, F.lit("/"), F.when(F.col("p_size") % 11 == 0, F.lit("notes.csv")).otherwise(name)).alias("path"), root.alias("dir"), "folder", F.col("p_partkey").alias("length"))


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Participants as they are entered: texts on experience, gender and age."""
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit(" "), F.col("c_custkey").cast("string")).alias("participant_id"),
        F.expr("element_at(array('从不', '每月1-2次', '每月3-4次', '≥5次', 'Often', 'rarely', '', 'nan', 'other'), cast(1 + c_nationkey % 9 AS int))").alias("Experience"),
        F.expr("element_at(array('男', 'F', '女生', 'man', 'none', '', 'x'), cast(1 + c_custkey % 7 AS int))").alias("Gender"),
        F.when(F.col("c_nationkey") > 3, F.col("c_acctbal").cast("string")).otherwise("?").alias("Age"),
        F.when(F.col("c_mktsegment") == "BUILDING", "Supplement").otherwise("Original").alias("RecruitmentBatch"),
        F.when(F.col("c_acctbal") < 0, "Yes").alias("exclude"),
    )


def survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A survey export: a column for each question and item."""
    c = table(spark, sf_dir, "customer")
    points = lambda x: F.concat((F.col("c_nationkey") % x).cast("string"), F.lit("分"))
    return c.select(F.col("c_custkey").cast("string").alias("participant_id"), points(7).alias("Q2.1_S1"), points(5).alias("Q2.5_S5"), points(6).alias("Q8.1_B1"), points(4).alias("Q9.1_S1"), F.when(F.col("c_acctbal") > 0, points(3)).alias("Q15.2_B2"), points(2).alias("Q16.1_x"))


# Views with gaps: what a study lacks here and there, so that joins and presence flags have something to find.


def eye_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials with an eye recording of over half a second."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").cast("string").alias("participant_id"), F.col("o_orderkey").alias("scene_id"), (F.floor(F.col("o_totalprice") / 1000) / 100).alias("eye_duration_s")).filter("eye_duration_s > 0.5")


def eeg_timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EEG scenes that have a duration."""
    return eeg_scenes(spark, sf_dir).filter("view_dur_s is not null")


def eeg_quiet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EEG scenes with little high-frequency power."""
    return eeg_scenes(spark, sf_dir).filter("hf_ratio_20_40Hz < 0.06")


def eeg_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EEG scenes of over two seconds."""
    return eeg_scenes(spark, sf_dir).filter("view_dur_s > 2")


def answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers whose first item is over 5."""
    return answers(spark, sf_dir).filter("S1 > 5")


def late_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers from the fourth item on."""
    return answers(spark, sf_dir).filter("S4 > 3")


def designed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of scenes with a window level."""
    return answers(spark, sf_dir).filter("WWR is not null")


def gaze_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaze samples of early fixations without errors."""
    return gaze(spark, sf_dir).filter("val_l <> 'error' and fix_id < 6")


def flagged_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers (o_custkey) with a returned line item of a high discount."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return li.filter("l_returnflag = 'R' and l_discount > 0.09").join(o, F.col("l_orderkey") == F.col("o_orderkey"))


def customers_above(spark: SparkSession, sf_dir: str, least: int = 0) -> DataFrame:
    """Customers with a balance above `least`."""
    return table(spark, sf_dir, "customer").filter(F.col("c_acctbal") > least)


def manual_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A short table of aliases."""
    c = table(spark, sf_dir, "customer").filter("c_custkey % 50 = 0")
    return c.select(F.concat(F.lit("name"), F.col("c_custkey").cast("string")).alias("alias"), F.col("c_name").alias("participant_id"))


def summary_with_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An EEG scene summary by subject, with repeated keys and other names of its columns."""
    return eeg_scenes(spark, sf_dir).withColumnsRenamed({"participant_id": "subject_id", "rms_mean_uV": "O_alpha"}).withColumn("scene_id", F.col("scene_id") % 50)


def gaze_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest of CSV files that hold the samples of ten participants: one file a trial, three kinds of headers in other orders."""
    g = gaze(spark, sf_dir).withColumn("_p", F.col("participant_id").cast("long") % 10)
    g = g.withColumn("trial", F.concat_ws("_", F.concat(F.lit("P"), "_p"), "scene_id"))
    kinds = (
        {"Recording Time Stamp[ms]": "t_ms", "Gaze Point X[px]": "gx", "Gaze Point Y[px]": "gy", "Fixation Index": "fix_id", "Fixation Duration[ms]": "fix_dur"},
        {"FixationIndex": "fix_id", "Y": "gy", "X": "gx", "FixationDuration[ms]": "fix_dur", "time_ms": "t_ms"},
        {"fixation_duration_ms": "fix_dur", "Other": "type", "timestamp_ms": "t_ms", "GazePointY[px]": "gy", "GazePointX[px]": "gx", "fixation_index": "fix_id"},
    )
    root = new_path(spark, "gaze")
    for i, kind in enumerate(kinds):
        own = g.filter(F.col("_p") % 3 == i).repartition("trial").sortWithinPartitions("trial", "seq")
        own.select("trial", *[F.col(c).alias(name) for name, c in kind.items()]).write.partitionBy("trial").option("header", True).csv(f"{root}/kind{i}")
    polygon = lambda p: "[{\"points\": [" + ", ".join(f"[{x}, {y}]" for x, y in p) + "]}]"
    text = "{\"aoi_classes\": {" + ", ".join(f"\"{n}\": {polygon(p)}" for n, p in POLYGONS.items()) + "}}"
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{root}/aoi")
    aoi = list_files(spark, f"{root}/aoi", "*.txt").first()["path"]
    trial = F.split(F.regexp_extract("path", r"trial=([^/]+)/", 1), "_")
    return list_files(spark, root, "*.csv").select(trial[0].alias("participant_id"), trial[1].alias("scene_id"), F.col("path").alias("eye_csv_path"), F.lit(aoi).alias("aoi_json_path"))
