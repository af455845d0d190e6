"""Gaze samples to area-of-interest metrics: mask, segments, hits and one two-level aggregation.

gaze columns: the trial keys, seq (file order), t_ms, x, y, fix_id, fix_dur, and
where they exist clock_ms, validity, pupil_l, pupil_r. aoi columns: class_name,
polygon_id, points, and aoi_set where trials differ in their polygons.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry
from ..functions.coding import ratio
from . import spatial

KEYS = ("participant_id", "scene_id")
METRICS = ("samples", "FC", "TFD", "TTFF", "FFD", "MFD", "MPD", "RFF", "visited", "attention_share", "share_pct", "FC_share", "FC_rate")


def small(df: DataFrame, most_rows: int) -> DataFrame:
    """Marked for broadcast if it has at most `most_rows` rows; otherwise Spark chooses a shuffle join."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def point_source(columns: Sequence[str], source: str = "auto") -> tuple[str, str]:
    """auto: fixation points if the columns exist, else gaze points."""
    have = {"fixation": {"fx", "fy"} <= set(columns), "gaze": {"gx", "gy"} <= set(columns)}
    pick = source if source != "auto" else "fixation" if have["fixation"] else "gaze"
    if not have.get(pick):
        raise ValueError(f"no {pick} point columns")
    return ("fx", "fy") if pick == "fixation" else ("gx", "gy")


def with_point(gaze: DataFrame, source: str = "auto") -> DataFrame:
    """Adds x and y. Where files of several kinds are one table, has_fixation_point says for each row what its file had."""
    x, y = point_source(gaze.columns, source)
    if source == "auto" and x == "fx" and {"has_fixation_point", "gx", "gy"} <= set(gaze.columns):
        return gaze.withColumns({"x": F.when(F.col("has_fixation_point"), F.col("fx")).otherwise(F.col("gx")), "y": F.when(F.col("has_fixation_point"), F.col("fy")).otherwise(F.col("gy"))})
    return gaze.withColumns({"x": F.col(x), "y": F.col(y)})


def valid_mask(gaze: DataFrame, width: float, height: float, accepted: Sequence[str] | None = None, codes: Sequence[str] = ("val_l", "val_r")) -> DataFrame:
    """Adds finite_xy, in_screen, validity_ok and valid; drops nothing. Codes count where all their columns exist, in any case of letters."""
    finite = F.col("x").isNotNull() & F.col("y").isNotNull()
    screen = F.coalesce(F.col("x").between(0, width) & F.col("y").between(0, height), F.lit(False))
    ok: Column = F.lit(True)
    if accepted and set(codes) <= set(gaze.columns):
        known = [a.strip().lower() for a in accepted]
        for c in codes:
            ok = ok & F.coalesce(F.lower(F.trim(F.col(c).cast("string"))).isin(*known), F.lit(False))
    out = gaze.withColumns({"finite_xy": finite, "in_screen": screen, "validity_ok": ok})
    return out.withColumn("valid", F.col("finite_xy") & F.col("in_screen") & F.col("validity_ok"))


def mask_ratios(masked: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    marks = ("finite_xy", "in_screen", "validity_ok", "valid")
    return masked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_samples"),
        *[F.count_if(m).alias(f"n_{m}") for m in marks],
        *[F.avg(F.col(m).cast("double")).alias(f"{m}_ratio") for m in marks],
    )


def segments(gaze: DataFrame, keys: Sequence[str] = KEYS, gap_ms: float = 5000.0, clock: str = "clock_ms") -> DataFrame:
    """Adds is_reset, is_gap, segment, baseline and, for what is measured later, seg_clock, the clock itself. A null clock breaks nothing on either side."""
    order = Window.partitionBy(*keys).orderBy("seq")
    step = F.col(clock) - F.lag(clock).over(order)
    out = gaze.withColumns({"is_reset": F.coalesce(step < 0, F.lit(False)), "is_gap": F.coalesce(step > gap_ms, F.lit(False))})
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = out.withColumn("segment", F.sum((F.col("is_reset") | F.col("is_gap")).cast("long")).over(running))
    return out.withColumns({"baseline": F.min(clock).over(Window.partitionBy(*keys, "segment")), "seg_clock": F.col(clock)})


def long_segments(gaze: DataFrame, keys: Sequence[str] = KEYS, gap_ms: float = 5000.0, clock: str = "clock_ms", block_rows: int = 100_000) -> DataFrame:
    """segments() for recordings too long for one task: a prefix scan over blocks of block_rows places of the file order.

    Blocks find their own breaks and the clocks at their ends. A table of one row for each block
    carries the last clock and the number of breaks on to the next; and one row for each
    block and segment in it carries the lowest clocks. No window holds more than a block of samples.
    """
    by = [*keys, "_block"]
    rows = gaze.withColumn("_block", F.floor(F.col("seq") / block_rows))
    order = Window.partitionBy(*by).orderBy("seq")
    step = F.col(clock) - F.lag(clock).over(order)
    rows = rows.withColumns({"_head": F.row_number().over(order) == 1, "_reset": F.coalesce(step < 0, F.lit(False)), "_gap": F.coalesce(step > gap_ms, F.lit(False))})
    broken = (F.col("_reset") | F.col("_gap")).cast("long")
    ends = rows.groupBy(*by).agg(F.min_by(clock, "seq").alias("_first"), F.max_by(clock, "seq").alias("_last"), F.sum(broken).alias("_n"))
    blocks = Window.partitionBy(*keys).orderBy("_block")
    between = F.col("_first") - F.lag("_last").over(blocks)
    ends = ends.withColumns({"_h_reset": F.coalesce(between < 0, F.lit(False)), "_h_gap": F.coalesce(between > gap_ms, F.lit(False))})
    ends = ends.withColumn("_own", (F.col("_h_reset") | F.col("_h_gap")).cast("long"))
    ends = ends.withColumn("_before", F.sum(F.col("_n") + F.col("_own")).over(blocks.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n"))
    out = rows.join(ends.select(*by, "_h_reset", "_h_gap", "_before"), by)
    running = F.sum(broken).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = out.withColumns({"is_reset": F.col("_reset") | (F.col("_head") & F.col("_h_reset")), "is_gap": F.col("_gap") | (F.col("_head") & F.col("_h_gap")), "segment": F.col("_before") + running})
    low = out.groupBy(*by, "segment").agg(F.min(clock).alias("_low"))
    low = low.withColumn("baseline", F.min("_low").over(Window.partitionBy(*keys, "segment"))).drop("_low")
    out = out.join(low, [*by, "segment"]).withColumn("seg_clock", F.col(clock))
    return out.drop("_block", "_head", "_reset", "_gap", "_h_reset", "_h_gap", "_before")


def segment_counts(segmented: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return segmented.groupBy(*keys).agg(
        F.count_if("is_gap").alias("gap_count"), F.count_if("is_reset").alias("reset_count"), (F.max("segment") + 1).alias("segments")
    )


def hits(gaze: DataFrame, aoi: DataFrame, how: str = "inner") -> DataFrame:
    """Samples with the polygons that hold them, see spatial.inside()."""
    return spatial.inside(gaze, aoi, how)


def pupil_mean(columns: Sequence[str]) -> Column:
    """Mean of both eyes, of one if the other is missing; pixels only where no mm column exists."""
    pairs = (("pupil_l", "pupil_r"), ("pupil_l_px", "pupil_r_px"))
    have = next(([c for c in p if c in columns] for p in pairs if any(c in columns for c in p)), [])
    if not have:
        return F.lit(None).cast("double")
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in have), F.lit(0.0))
    return ratio(total, sum((F.col(c).isNotNull().cast("int") for c in have), F.lit(0)))


def aoi_metrics(gaze: DataFrame, aoi: DataFrame, keys: Sequence[str] = KEYS, level: str = "class", dwell_mode: str = "fixation") -> DataFrame:
    """One row for each trial and AOI (class or polygon), also without samples.

    gaze: valid samples with what segments() adds; TTFF and the trial's seconds go by its clock (seconds by t_ms
    where fewer than two samples have a clock). Without a fix_id column every sample
    is a fixation of its own. A class is the union of its polygons. segments() has dealt the samples out by trial; every step here
    groups by the trial and more, so the whole plan needs no other exchange.

    Entries are islands: a trial's fixations are numbered by their begin, and a fixation
    on a class enters it unless the one before was on it too. No row is made for a fixation and a class that it misses;
    zero rows come from the trial's first row, once for each class.
    """
    unit = ["class_name"] if level == "class" else ["class_name", "polygon_id"]
    by = list(keys)
    gaze = gaze.withColumn("_pupil", pupil_mean(gaze.columns))
    if "fix_id" not in gaze.columns:
        gaze = gaze.withColumn("fix_id", F.col("seq"))
    total = F.sum("fix_dur").over(Window.partitionBy(*by)) if dwell_mode == "row" else F.lit(None).cast("double")
    own = list(dict.fromkeys([*by, "seq", "t_ms", "seg_clock", "baseline", "fix_id", "fix_dur", "_pupil", "_total", "x", "y", *(["aoi_set"] if "aoi_set" in gaze.columns else [])]))
    hit = hits(gaze.withColumn("_total", total).select(*own), aoi, "left")
    if level == "class":
        hit = hit.dropDuplicates([*by, "seq", "class_name"])

    since = F.col("seg_clock") - F.col("baseline")
    timed = F.when(F.col("seg_clock").isNotNull(), F.struct("seg_clock", "seq"))
    first = F.when(F.col("t_ms").isNotNull(), F.struct("t_ms", "seq"))
    # samples without a fixation are one group of the trial; samples outside all AOIs have a null class
    cell = hit.groupBy(*by, "fix_id", *unit).agg(
        F.min("t_ms").alias("first_ts"),
        F.max("t_ms").alias("last_ts"),
        F.max("fix_dur").alias("dur"),
        F.sum("fix_dur").alias("rows_dur"),
        F.count(F.lit(1)).alias("n"),
        F.min_by(F.struct(since.alias("s")), first).alias("head"),
        F.min(first).alias("at"),
        F.max(first).alias("to"),
        F.min(timed).alias("c_at"),
        F.max(timed).alias("c_to"),
        F.sum("_pupil").alias("p_sum"),
        F.count("_pupil").alias("p_n"),
        F.max("_total").alias("_total"),
    )
    real, inside = F.col("fix_id").isNotNull(), F.col("class_name").isNotNull()
    of_fixation = Window.partitionBy(*by, "fix_id")
    cell = cell.withColumns({"f_first": F.min("first_ts").over(of_fixation), "f_dur": F.max("dur").over(of_fixation), "_once": real & (F.row_number().over(of_fixation.orderBy(*unit)) == 1)})
    cell = cell.withColumn("_place", F.dense_rank().over(Window.partitionBy(*by).orderBy(F.col("fix_id").isNull(), F.asc_nulls_last("f_first"), "fix_id")))
    before = F.lag("_place").over(Window.partitionBy(*by, *unit).orderBy("_place"))
    cell = cell.withColumn("_entry", real & inside & F.coalesce(before < F.col("_place") - 1, F.lit(True)))

    earliest = F.when(real & inside, F.struct(F.col("first_ts").isNull().alias("late"), F.col("first_ts").alias("ts"), F.col("fix_id").alias("id")))
    per = cell.groupBy(*by, *unit).agg(
        F.sum("n").alias("samples"),
        F.count_if(real).alias("FC"),
        (F.sum(F.when(real, F.col("dur"))) if dwell_mode == "fixation" else F.sum("rows_dur")).alias("TFD"),
        F.min_by("head.s", "at").alias("TTFF"),
        F.min_by("dur", earliest).alias("FFD"),
        F.avg(F.when(real, F.col("dur"))).alias("MFD"),
        ratio(F.sum("p_sum"), F.sum("p_n")).alias("MPD"),
        F.greatest(F.count_if("_entry") - 1, F.lit(0)).alias("RFF"),
        F.sum(F.when(F.col("_once"), F.col("f_dur"))).alias("t_dur"),
        F.count_if("_once").alias("t_fc"),
        F.max("_total").alias("t_rows"),
        F.min("first_ts").alias("t_first"),
        F.max("last_ts").alias("t_last"),
        F.min("at").alias("t_at"),
        F.max("to").alias("t_to"),
        F.min("c_at").alias("t_c_at"),
        F.max("c_to").alias("t_c_to"),
    )
    trial = Window.partitionBy(*by)
    over = {"t_dur": F.sum, "t_fc": F.sum, "t_rows": F.max, "t_first": F.min, "t_last": F.max, "t_at": F.min, "t_to": F.max, "t_c_at": F.min, "t_c_to": F.max}
    per = per.withColumns({name: f(name).over(trial) for name, f in over.items()})
    mine = F.struct(*unit)
    per = per.withColumns({"_head": F.row_number().over(trial.orderBy(*unit)) == 1, "_own": F.when(inside, mine)})
    got = ("samples", "FC", "TFD", "TTFF", "FFD", "MFD", "MPD", "RFF")
    if "aoi_set" in aoi.columns and "aoi_set" in by:
        per = per.join(aoi.groupBy("aoi_set").agg(F.collect_set(mine).alias("_all")), "aoi_set")
    else:
        per = per.withColumn("_all", F.coalesce(aoi.agg(F.collect_set(mine).alias("_all")).scalar(), F.array()))
    targets = F.when(F.col("_head"), F.col("_all")).otherwise(F.array_compact(F.array("_own")))
    each = per.withColumn("_unit", F.explode(targets)).withColumn("_got", F.when(F.col("_unit").eqNullSafe(F.col("_own")), F.struct(*got)))
    out = each.groupBy(*by, *[F.col("_unit")[u].alias(u) for u in unit]).agg(F.max("_got").alias("m"), *[F.max(c).alias(c) for c in over])
    seconds = F.coalesce(
        F.when(F.col("t_c_at") < F.col("t_c_to"), (F.col("t_c_to.seg_clock") - F.col("t_c_at.seg_clock")) / 1000.0),
        F.when(F.col("t_at") < F.col("t_to"), (F.col("t_last") - F.col("t_first")) / 1000.0),
    )
    fc, samples = F.coalesce("m.FC", F.lit(0)), F.coalesce("m.samples", F.lit(0))
    share = ratio(F.col("m.TFD"), F.col("t_dur") if dwell_mode == "fixation" else F.col("t_rows"))
    return out.select(
        *by,
        *unit,
        samples.alias("samples"),
        fc.alias("FC"),
        *[F.col(f"m.{c}").alias(c) for c in got[2:7]],
        F.coalesce("m.RFF", F.lit(0)).alias("RFF"),
        ((fc > 0) | (samples > 0)).alias("visited"),
        share.alias("attention_share"),
        (share * 100).alias("share_pct"),
        ratio(fc, F.col("t_fc")).alias("FC_share"),
        ratio(fc, seconds).alias("FC_rate"),
    )


def batch_metrics(gaze: DataFrame, aoi: DataFrame, manifest: DataFrame, participants: DataFrame, keys: Sequence[str] = KEYS, level: str = "class", dwell_mode: str = "row") -> DataFrame:
    """The older batch: metrics of the trials that both the manifest and the participants name, with the manifest's columns and the share of valid samples.

    gaze: samples with the marks of valid_mask(); metrics are of the valid ones.
    """
    from .trial import DIMENSION_ROWS

    who = participants.select("participant_id").distinct()
    trials = manifest.join(small(who, DIMENSION_ROWS), "participant_id", "left_semi")
    own = gaze.join(small(trials.select(*keys), DIMENSION_ROWS), list(keys), "left_semi")
    cut = segments(own.filter("valid"), keys)
    out = aoi_metrics(cut, aoi, keys, level, dwell_mode).join(mask_ratios(own, keys).select(*keys, "n_samples", "valid_ratio"), list(keys))
    return out.join(small(trials.drop(*[c for c in trials.columns if c in out.columns and c not in keys]), DIMENSION_ROWS), list(keys))


def whole_scene(gaze: DataFrame, keys: Sequence[str] = KEYS, dwell_mode: str = "fixation", legacy_ttff: bool = False) -> DataFrame:
    """One row for each trial without AOIs, class whole_scene."""
    real = F.col("fix_id").isNotNull()
    gaze = gaze if "fix_id" in gaze.columns else gaze.withColumn("fix_id", F.col("seq"))
    t = "seg_clock" if "seg_clock" in gaze.columns else "t_ms"
    fix = gaze.groupBy(*keys, "fix_id").agg(F.min(t).alias("c_lo"), F.max(t).alias("c_hi"), F.count(t).alias("c_n"), F.max("fix_dur").alias("dur"), F.sum("fix_dur").alias("rows_dur"), F.count(F.lit(1)).alias("n"), F.min("t_ms").alias("lo"), F.max("t_ms").alias("hi"), F.count("t_ms").alias("nt"))
    out = fix.groupBy(*keys).agg(
        F.sum("n").alias("samples"),
        F.count("fix_id").alias("FC"),
        (F.sum(F.when(real, F.col("dur"))) if dwell_mode == "fixation" else F.sum("rows_dur")).alias("TFD"),
        F.avg(F.when(real, F.col("dur"))).alias("MFD"),
        F.coalesce(F.when(F.sum("c_n") > 1, (F.max("c_hi") - F.min("c_lo")) / 1000.0), F.when(F.sum("nt") > 1, (F.max("hi") - F.min("lo")) / 1000.0)).alias("_s"),
    )
    out = out.withColumns({"class_name": F.lit("whole_scene"), "visited": F.col("samples") > 0, "FC_rate": ratio(F.col("FC"), F.col("_s")), "TTFF": F.lit(0.0 if legacy_ttff else None).cast("double")})
    return out.drop("_s")


def aoi_validation(metrics: DataFrame, aoi: DataFrame) -> DataFrame:
    """Polygon area and box, with the share of trials that visited the class."""
    rate = metrics.groupBy("class_name").agg(F.avg(F.col("visited").cast("double")).alias("visited_rate"))
    p = F.col("points")
    box = geometry.bounding_box(p)
    shape = aoi.select("class_name", "polygon_id", F.size(p).alias("n_points"), geometry.area(p).alias("area"), (box["max_x"] - box["min_x"]).alias("bbox_w"), (box["max_y"] - box["min_y"]).alias("bbox_h"))
    return shape.join(rate, "class_name", "left")


def aoi_overlap(gaze: DataFrame, aoi: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Class pairs with common samples, over all trials: counts, and shares of either class and of their union.

    Common samples are paired within one sample's list of classes, which has at most one entry per class.
    """
    per = hits(gaze, aoi).groupBy(*keys, "seq").agg(F.array_sort(F.collect_set("class_name")).alias("c"))
    sizes = per.select(F.explode("c").alias("class_name")).groupBy("class_name").agg(F.count(F.lit(1)).alias("n"))
    pairs = F.flatten(F.transform("c", lambda a, i: F.transform(F.slice("c", i + 2, F.size("c")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    both = per.filter(F.size("c") > 1).select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("n_both"))
    out = both.join(sizes.select(F.col("class_name").alias("a"), F.col("n").alias("n_a")), "a").join(sizes.select(F.col("class_name").alias("b"), F.col("n").alias("n_b")), "b")
    return out.select(F.col("a").alias("class_a"), F.col("b").alias("class_b"), "n_a", "n_b", "n_both", (F.col("n_both") / F.col("n_a")).alias("ratio_a"), (F.col("n_both") / F.col("n_b")).alias("ratio_b"), (F.col("n_both") / (F.col("n_a") + F.col("n_b") - F.col("n_both"))).alias("jaccard"))


def file_stats(gaze: DataFrame, keys: Sequence[str] = KEYS, bin_ms: float = 2000.0, offset_ms: float = 0.0) -> DataFrame:
    """Sample count, time range and the number of bins of each trial."""
    out = gaze.groupBy(*keys).agg(F.count(F.lit(1)).alias("sample_count"), F.min("t_ms").alias("first_ts"), F.max("t_ms").alias("last_ts"))
    span = F.greatest(F.col("last_ts") - F.col("first_ts") + offset_ms, F.lit(0.0))
    return out.withColumn("duration_ms", F.col("last_ts") - F.col("first_ts")).withColumn("timebin_count", F.ceil(span / bin_ms).cast("long"))
