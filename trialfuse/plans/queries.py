"""One query for each operator over the stand-in views. The same in SQL is in oracle.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import coding as C
from ..functions import geometry
from ..operators import batch, clock, diagnostics, models, qc, scales, signal, trial
from ..operators import gaze as G
from ..operators import timebin as T
from ..sources import discovery, io
from ..sources.scratch import new_path
from ..streaming import gaze_stream
from . import standins as S

DAY = 86_400_000.0
BIN_MS = 5 * DAY
ITEMS = ("S1", "S2", "S3", "S4")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded: sums do not depend on the order of the rows."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _valid(spark: SparkSession, sf_dir: str, source: str = "gaze") -> DataFrame:
    g = G.with_point(S.gaze(spark, sf_dir), source)
    return G.valid_mask(g, *S.SCREEN, accepted=S.ACCEPTED, codes=("val_l",)).filter("valid")


def _segmented(spark, sf_dir, clock_col="t_ms", gap=3 * DAY):
    return G.segments(_valid(spark, sf_dir), gap_ms=gap, clock=clock_col)


def aoi_metrics(spark, sf_dir):
    return rounded(G.aoi_metrics(_segmented(spark, sf_dir), S.polygons(spark)), 8)


def aoi_metrics_rows_mode(spark, sf_dir):
    out = G.aoi_metrics(_segmented(spark, sf_dir), S.polygons(spark), level="polygon", dwell_mode="row")
    return rounded(out.select("participant_id", "scene_id", "class_name", "polygon_id", "samples", "TFD", "attention_share"))


def whole_scene(spark, sf_dir):
    return rounded(G.whole_scene(_segmented(spark, sf_dir)).select("participant_id", "scene_id", "samples", "FC", "TFD", "MFD", "FC_rate", "visited"))


def aoi_overlap(spark, sf_dir):
    return rounded(G.aoi_overlap(_valid(spark, sf_dir), S.polygons(spark)))


def aoi_validation(spark, sf_dir):
    hit = G.hits(_valid(spark, sf_dir), S.polygons(spark)).select(*G.KEYS, "class_name").distinct()
    trials = _valid(spark, sf_dir).select(*G.KEYS).distinct()
    visits = trials.crossJoin(F.broadcast(S.polygons(spark).select("class_name"))).join(hit.withColumn("visited", F.lit(True)), [*G.KEYS, "class_name"], "left").withColumn("visited", F.coalesce("visited", F.lit(False)))  # three polygons
    return rounded(G.aoi_validation(visits, S.polygons(spark)))


def gaze_valid_qc(spark, sf_dir):
    g = G.valid_mask(G.with_point(S.gaze(spark, sf_dir), "gaze"), *S.SCREEN, accepted=S.ACCEPTED, codes=("val_l",))
    return rounded(G.mask_ratios(g))


def screen_filter(spark, sf_dir):
    return _valid(spark, sf_dir).select("participant_id", "scene_id", "seq", "x", "y")


def time_segments(spark, sf_dir):
    s = G.segments(S.gaze(spark, sf_dir), gap_ms=6 * 3_600_000.0)
    return s.select("participant_id", "scene_id", "seq", "is_reset", "is_gap", "segment", "baseline")


def segment_counts(spark, sf_dir):
    return G.segment_counts(G.segments(S.gaze(spark, sf_dir), gap_ms=3 * DAY, clock="t_ms"))


def gaze_file_stats(spark, sf_dir):
    return rounded(G.file_stats(S.gaze(spark, sf_dir), bin_ms=BIN_MS))


def _binned(spark, sf_dir):
    return T.assign_bins(_valid(spark, sf_dir), BIN_MS)


def timebin_assign(spark, sf_dir):
    return _binned(spark, sf_dir).select("participant_id", "scene_id", "seq", "bin_index")


def timebin_metrics(spark, sf_dir):
    out = T.timebin_metrics(_binned(spark, sf_dir), S.polygons(spark), gap_ms=3 * DAY, clock="t_ms")
    return rounded(out.select("participant_id", "scene_id", "bin_index", "class_name", "samples", "FC", "TFD", "TTFF", "MFD", "RFF", "visited", "attention_share"))


def timebin_whole_scene(spark, sf_dir):
    out = T.timebin_whole_scene(_binned(spark, sf_dir))
    return rounded(out.select("participant_id", "scene_id", "bin_index", "samples", "FC", "TFD", "MFD"))


def _eye_times(spark, sf_dir):
    """A trial is a customer's order status; both modalities time it by dates, here in seconds."""
    o, li = S.table(spark, sf_dir, "orders"), S.table(spark, sf_dir, "lineitem")
    day = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1_000_000.0
    who, scene = F.col("o_custkey").cast("string").alias("participant_id"), F.ascii("o_orderstatus").cast("long").alias("scene_id")
    eye = o.groupBy(who, scene).agg(F.min(day("o_orderdate")).alias("x_start"), F.max(day("o_orderdate")).alias("x_end"))
    eeg = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(who, scene).agg(F.min(day("l_shipdate")).alias("y_start"), F.max(day("l_shipdate")).alias("y_end"))
    return eye, eeg


def _landmarks(spark, sf_dir):
    eye, eeg = _eye_times(spark, sf_dir)
    t = eye.join(eeg, list(G.KEYS))
    gap = F.abs((F.col("x_end") - F.col("x_start")) - (F.col("y_end") - F.col("y_start")))
    return clock.landmarks(t.withColumn("outlier", gap > 100 * DAY / 1000))


def clock_fit(spark, sf_dir):
    return rounded(clock.fit(_landmarks(spark, sf_dir), 60 * DAY / 1000), 2)


def clock_residuals(spark, sf_dir):
    marks = _landmarks(spark, sf_dir)
    return rounded(clock.residuals(marks, clock.fit(marks, 60 * DAY / 1000)), 2)


def clock_quality(spark, sf_dir):
    marks = _landmarks(spark, sf_dir)
    return rounded(clock.quality(clock.residuals(marks, clock.fit(marks, 60 * DAY / 1000))), 2)


def scene_alignment(spark, sf_dir):
    eye, eeg = _eye_times(spark, sf_dir)
    return rounded(
        clock.scene_alignment(
            eye.select("participant_id", "scene_id", F.col("x_start").alias("eye_start"), F.col("x_end").alias("eye_end")),
            eeg.select("participant_id", "scene_id", F.col("y_start").alias("eeg_start"), F.col("y_end").alias("eeg_end")),
            DAY / 10,
        )
    )


def _sync(spark, sf_dir):
    eye = S.eye_durations(spark, sf_dir)
    return qc.sync_qc(S.eeg_scenes(spark, sf_dir).select(*G.KEYS), eye, S.eeg_timed(spark, sf_dir).select(*G.KEYS, F.col("view_dur_s").alias("eeg_duration_s")), 2.0, 10), eye


def sync_qc(spark, sf_dir):
    return rounded(_sync(spark, sf_dir)[0])


def _flags(spark, sf_dir):
    return qc.eeg_flags(S.eeg_scenes(spark, sf_dir), qc.EegPolicy(k=3.0, min_duration_s=2.0))


def qc_exclusions(spark, sf_dir):
    sync, eye = _sync(spark, sf_dir)
    return qc.qc_exclusions(sync, S.answered(spark, sf_dir).select(*G.KEYS), eye, S.eeg_timed(spark, sf_dir), _flags(spark, sf_dir))


def qc_kept_rows(spark, sf_dir):
    return qc.apply_exclusions(S.eeg_scenes(spark, sf_dir), qc_exclusions(spark, sf_dir)).select("participant_id", "scene_id", "view_dur_s")


def robust_mad_thresholds(spark, sf_dir):
    return rounded(qc.robust_thresholds(S.eeg_scenes(spark, sf_dir), ("hf_ratio_20_40Hz", "rms_mean_uV"), 3.0))


def robust_mad_flags(spark, sf_dir):
    return _flags(spark, sf_dir).select("participant_id", "scene_id", "qc_policy", "candidate_reasons", "reasons", "bad_eeg_quality")


def subject_exclusion(spark, sf_dir):
    return qc.exclude_subjects(_flags(spark, sf_dir), 0.2).select("participant_id", "scene_id", "subject_excluded", "reasons", "bad_eeg_quality")


def subject_qc(spark, sf_dir):
    return rounded(qc.subject_qc(qc.exclude_subjects(_flags(spark, sf_dir), 0.2)))


def eeg_metric_summary(spark, sf_dir):
    return rounded(qc.metric_summary(_flags(spark, sf_dir), ("hf_ratio_20_40Hz", "rms_mean_uV", "view_dur_s")))


def contract(spark, sf_dir):
    return qc.contract_findings(S.summary_with_repeats(spark, sf_dir))


def group_balance(spark, sf_dir):
    return rounded(qc.factor_levels(S.table(spark, sf_dir, "customer"), ("c_mktsegment", "c_nationkey")))


def design_balance(spark, sf_dir):
    return qc.factor_levels(S.answers(spark, sf_dir), ("WWR", "Complexity"), "NA").drop("percent")


def participant_flow(spark, sf_dir):
    c = S.table(spark, sf_dir, "customer").withColumn("exclude", F.when(F.col("c_acctbal") < 0, "Yes").when(F.col("c_nationkey") == 3, "y"))
    return qc.participant_flow(c, batch="c_mktsegment")


def active_participants(spark, sf_dir):
    c = S.table(spark, sf_dir, "customer").withColumn("exclude", F.when(F.col("c_acctbal") < 0, "Yes").when(F.col("c_nationkey") == 3, "y"))
    return trial.active_rows(c).select("c_custkey", "c_name")


def trial_index(spark, sf_dir):
    scenes = S.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("participant_id"), F.col("o_orderkey").alias("scene_id"))
    who = S.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("participant_id"), F.col("c_mktsegment").alias("ExperienceGroup"), (F.col("c_acctbal") < 0).alias("exclude"))
    return trial.trial_index(scenes, who).drop("exclude")


def dup_keys(spark, sf_dir):
    return trial.duplicate_keys(S.table(spark, sf_dir, "lineitem"), ("l_orderkey", "l_linenumber"))


def keep_first_rows(spark, sf_dir):
    order = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"]
    return trial.keep_first(S.table(spark, sf_dir, "lineitem"), ["l_orderkey"], order).select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice")


def presence_reasons(spark, sf_dir):
    ids = lambda df, col: df.select(F.col(col).cast("string").alias("participant_id"))
    return trial.presence({"eeg": ids(S.flagged_customers(spark, sf_dir), "o_custkey"), "eye": ids(S.table(spark, sf_dir, "orders"), "o_custkey"), "questionnaire": ids(S.customers_above(spark, sf_dir), "c_custkey")})


def alias_resolution(spark, sf_dir):
    o = S.table(spark, sf_dir, "orders")
    named = F.concat(F.lit("name"), F.col("o_custkey").cast("string"), F.when(F.col("o_orderkey") % 5 == 0, "-32-40").otherwise(""))
    rows = o.select("o_orderkey", (F.col("o_orderkey") % 4000).cast("string").alias("record_id"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("User"), F.col("o_orderkey").cast("string"))).otherwise(named).alias("subject"))
    return trial.resolve_aliases(rows, S.manual_aliases(spark, sf_dir)).select("o_orderkey", "subject", "participant_id", "alias_source")


def analysis_master(spark, sf_dir):
    trials = S.eeg_scenes(spark, sf_dir).select(*G.KEYS)
    q = S.answers(spark, sf_dir).groupBy(*G.KEYS).agg(F.avg("S1").alias("S1"), F.avg("S2").alias("S2"))
    eeg = S.eeg_scenes(spark, sf_dir).select(*G.KEYS, "hf_ratio_20_40Hz", "view_dur_s")
    eye = S.answers(spark, sf_dir).groupBy(*G.KEYS, F.col("Complexity").alias("class_name")).agg(F.count(F.lit(1)).alias("FC"), F.sum("S1").alias("TFD"))
    return rounded(trial.analysis_master(trials, q, eeg, eye))


def aligned_scenes(spark, sf_dir):
    e = S.eeg_scenes(spark, sf_dir)
    eye = S.answers(spark, sf_dir).groupBy(*G.KEYS).agg(F.max("S1").alias("eye_max"))
    return rounded(trial.aligned_scenes(e.select(*G.KEYS), eye, S.eeg_quiet(spark, sf_dir).select(*G.KEYS, "view_dur_s")))


def scene_fallback(spark, sf_dir):
    a = S.late_answers(spark, sf_dir).select(*G.KEYS, F.lit("answers").alias("Cond"))
    e = S.eeg_long(spark, sf_dir).select(*G.KEYS, F.lit("eeg").alias("Cond"))
    return trial.scene_fallback([a, e])


def id_sets(spark, sf_dir):
    """In both tables, and in the first alone."""
    o = S.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"))
    c = S.customers_above(spark, sf_dir, 5000).select(F.col("c_custkey").alias("id"))
    return o.intersect(c).withColumn("kind", F.lit("both")).unionByName(o.distinct().join(c, "id", "left_anti").withColumn("kind", F.lit("orders_only")))


def wide_to_long(spark, sf_dir):
    wide = S.designed_answers(spark, sf_dir).groupBy("participant_id").pivot("WWR", [15, 45, 75]).agg(F.round(F.avg("S1"), 6).alias("a"), F.round(F.avg("S2"), 6).alias("b"))
    names = {f"{x}_{k}": f"S{1 if k == 'a' else 2}_{i + 1}" for i, x in enumerate((15, 45, 75)) for k in "ab"}
    return scales.wide_to_long(wide.withColumnsRenamed(names))


def composites(spark, sf_dir):
    a = S.answers(spark, sf_dir).withColumn("S2", F.when(F.col("S2") > 2, F.col("S2")))
    out = scales.composites(a.withColumns({"S1": F.when(F.col("S1") < 40, F.col("S1")), "S5": F.col("S4") + 1}), least=3, b_items=(), ipq=("S3", "S4"))
    return rounded(out.select("participant_id", "scene_id", "S1", "S2", "S3", "S4", "Afford4", "S5_7", "IPQ_mean"))


def item_qc(spark, sf_dir):
    return rounded(scales.item_qc(S.answers(spark, sf_dir).withColumn("S2", F.when(F.col("S2") > 2, F.col("S2"))), ITEMS))


def scale_range_qc(spark, sf_dir):
    return rounded(scales.scale_range_qc(S.answers(spark, sf_dir), ITEMS))


def c1_only_qc(spark, sf_dir):
    a = S.answers(spark, sf_dir)
    return scales.c1_only_qc(a.withColumn("B1", F.when(F.col("S1") > 48, F.col("S1"))), ("B1",), C.is_c1(F.when(F.col("Complexity") == "A", "1").otherwise("0"), F.lit(None)))


def item_descriptives(spark, sf_dir):
    d = scales.descriptives(S.answers(spark, sf_dir), ITEMS, ("WWR", "Complexity", "ExperienceGroup"), ci=False)
    return rounded(d.drop("jarque_bera_p"), 5)


def descriptive_intervals(spark, sf_dir):
    return rounded(scales.descriptives(S.answers(spark, sf_dir), ITEMS, ("WWR", "ExperienceGroup")), 5)


def subject_means(spark, sf_dir):
    return rounded(scales.subject_means(S.answers(spark, sf_dir), ITEMS))


def cronbach_alpha(spark, sf_dir):
    return rounded(scales.cronbach(S.answers(spark, sf_dir), ITEMS, by=("ExperienceGroup",)))


def poly_contrasts(spark, sf_dir):
    return rounded(scales.poly_contrasts(S.answers(spark, sf_dir), ITEMS, "WWR", p_values=False), 5)


def contrast_p_values(spark, sf_dir):
    return rounded(scales.poly_contrasts(S.answers(spark, sf_dir), ITEMS, "WWR"), 5)


def welch_pairs(spark, sf_dir):
    return rounded(scales.welch_pairs(S.answers(spark, sf_dir), "S1", "ExperienceGroup", p_values=False), 5)


def welch_p_values(spark, sf_dir):
    return rounded(scales.welch_pairs(S.answers(spark, sf_dir), "S2", "Complexity"), 5)


def marginal_means(spark, sf_dir):
    return rounded(scales.marginal_means(S.answers(spark, sf_dir), "S1", ("WWR", "Complexity", "ExperienceGroup")))


def order_corr(spark, sf_dir):
    a = S.answers(spark, sf_dir).withColumn("flat", F.lit(1.0))
    return rounded(diagnostics.order_correlation(a, ("S1", "S2", "S3", "flat"), "S4"))


def factor_sensitivity(spark, sf_dir):
    return rounded(diagnostics.factor_sensitivity(S.answers(spark, sf_dir), ("S1", "S2"), ("WWR", "Complexity")))


def peak_index(spark, sf_dir):
    return rounded(diagnostics.peak_index(S.answers(spark, sf_dir), ITEMS, "WWR"))


def subject_peak_index(spark, sf_dir):
    return rounded(diagnostics.subject_peak_index(S.answers(spark, sf_dir), "S1", "WWR", ("participant_id", "ExperienceGroup")))


def power_sensitivity(spark, sf_dir):
    return diagnostics.power_sensitivity(S.answers(spark, sf_dir), "ExperienceGroup")


def level_contrasts(spark, sf_dir):
    return rounded(diagnostics.level_contrast_rows(S.answers(spark, sf_dir), "S1", "WWR"))


def modality_convergence(spark, sf_dir):
    e = S.eeg_scenes(spark, sf_dir)
    return rounded(diagnostics.modality_convergence(e, {"eeg": ("hf_ratio_20_40Hz", "rms_mean_uV"), "timing": ("view_dur_s",)}), 4)


def weighted_rollup(spark, sf_dir):
    cells = S.answers(spark, sf_dir).groupBy("ExperienceGroup", "Complexity", "WWR").agg(F.avg("S1").alias("mean"), F.count("S1").alias("n"))
    return rounded(diagnostics.weighted_rollup(cells, ("ExperienceGroup",)))


def claim_support(spark, sf_dir):
    p = S.table(spark, sf_dir, "part")
    claims = p.select(F.col("p_partkey").alias("claim_id"), F.split("p_name", " ").alias("required"))
    return diagnostics.claim_support(claims, ("ring", "red", "small")).select("claim_id", "missing", "level")


def top_correlations(spark, sf_dir):
    return rounded(diagnostics.top_correlations(diagnostics.order_correlation(S.answers(spark, sf_dir), ITEMS, "WWR"), 3))


def source_index(spark, sf_dir):
    p = S.table(spark, sf_dir, "part")
    return diagnostics.source_index(p.select("p_partkey", F.concat_ws(";", F.split("p_name", " "), F.lit(" ")).alias("sources")))


def coding_columns(spark, sf_dir):
    p = S.table(spark, sf_dir, "part")
    return p.select(
        "p_partkey",
        C.first_number("p_brand").alias("brand_number"),
        C.condition_id(F.when(F.col("p_size") % 2 == 0, F.col("p_size") % 3), F.lit("X"), F.when(F.col("p_size") > 5, F.col("p_size"))).alias("condition_id"),
        C.coded_by_patterns("p_name", ("small", "red"), ("large", "blue")).alias("coded"),
        C.truthy(F.col("p_type")).alias("truthy"),
    )


def polygon_area(spark, sf_dir):
    """Triangles whose corners come from each part."""
    p = S.table(spark, sf_dir, "part")
    d = lambda x: F.lit(x).cast("double") if isinstance(x, int) else x.cast("double")
    pt = lambda x, y: F.struct(d(x).alias("x"), d(y).alias("y"))
    return p.select("p_partkey", F.array(pt(0, 0), pt(F.col("p_size"), 0), pt(F.col("p_partkey") % 7, F.col("p_partkey") % 11)).alias("points")).select("p_partkey", F.round(geometry.area(F.col("points")), 6).alias("area"))


def ols_coefficients(spark, sf_dir):
    got = models.fit_models(S.answers(spark, sf_dir), ("S1", "S2"), ("S4",), "ols")
    return rounded(got.select("outcome", "term", "estimate", "n"))


def lmm_fixed_effects(spark, sf_dir):
    return rounded(models.fit_models(S.answers(spark, sf_dir), ("S1", "S2"), ("C(WWR)*C(Complexity)", "C(ExperienceGroup)")), 4)


def logit(spark, sf_dir):
    a = S.answers(spark, sf_dir).withColumn("visited", F.col("S1") + 3 * F.col("S4") > 30)
    return rounded(models.fit_models(a, ("visited",), ("C(Complexity)", "S2"), "logit"), 4)


def batch_from_files(spark, sf_dir):
    """From the files that a manifest names to class metrics."""
    manifest = S.gaze_files(spark, sf_dir)
    people = manifest.select("participant_id").distinct().withColumn("exclude", F.when(F.col("participant_id") == "P9", "yes"))
    out = batch.run_batch(spark, manifest, people, screen=S.SCREEN, gap_ms=3 * DAY)["class"]
    return rounded(out.select("participant_id", "scene_id", "class_name", "samples", "FC", "TFD", "TTFF", "FFD", "MFD", "RFF", "visited", "attention_share", "FC_share", "FC_rate"))


def batch_file_qc(spark, sf_dir):
    """What each file of a manifest holds."""
    manifest = S.gaze_files(spark, sf_dir)
    out = batch.run_batch(spark, manifest, manifest.select("participant_id", F.lit("").alias("exclude")))["qc"]
    return rounded(out.select("participant_id", "scene_id", "missing_eye_file", "missing_aoi_file", "sample_count", "first_ts", "last_ts", "duration_ms", "timebin_count"))


def lmm_slope(spark, sf_dir):
    """A mixed model that SQL can fit as well: one slope."""
    a = S.answers(spark, sf_dir).withColumn("y", F.col("S1") + 3 * (F.col("participant_id").cast("long") % 7))
    return rounded(models.fit_models(a, ("y",), ("S4",)).select("term", "estimate", "se", "n", "n_groups", "group_variance"), 4)


def logit_slope(spark, sf_dir):
    a = S.answers(spark, sf_dir).withColumn("visited", F.col("S1") + 3 * F.col("S4") > 30)
    return rounded(models.fit_models(a, ("visited",), ("S4",), "logit").select("term", "estimate", "se", "n"), 5)


def model_families(spark, sf_dir):
    f = {"means": {"outcomes": ("S1", "absent"), "predictors": ("C(WWR)",), "kind": "ols"}, "mixed": {"outcomes": ("S3",), "predictors": ("C(WWR)", "S4"), "unit": "trial"}}
    return rounded(models.family_models(S.answers(spark, sf_dir), f), 4)


STATES = {("click", "view"): "view", ("view", "click"): "gray", ("view", "purchase"): "gray", ("signup", "view"): "view"}


def marker_segments(spark, sf_dir):
    return signal.marker_segments(S.markers(spark, sf_dir), STATES).select("subject_id", "ev_ix", "condition", "latency", "end_latency", "scene_id", "block", "position")


def view_gray_pairs(spark, sf_dir):
    return signal.next_in_scene(signal.marker_segments(S.markers(spark, sf_dir), STATES))


def signal_qc(spark, sf_dir):
    return rounded(signal.signal_qc(S.signal(spark, sf_dir)))


def band_power(spark, sf_dir):
    return rounded(signal.band_power(S.signal(spark, sf_dir), 32.0, bands={"theta": (4, 8), "alpha": (8, 13), "beta": (13, 16)}))


def _event_stream(spark, sf_dir):
    return S.table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("participant_id"), (F.col("event_id") % 8).alias("fix_id"), F.col("value").alias("fix_dur"))


def stream_bins(spark, sf_dir):
    """The streaming plan over the table as one batch."""
    out = gaze_stream.stream_bins(_event_stream(spark, sf_dir), ["participant_id"], size="6 hours").drop("fixations")
    return rounded(out.select(F.unix_micros("bin_start").alias("bin_start"), F.unix_micros("bin_end").alias("bin_end"), "participant_id", "samples", "mean_value"))


def stream_segments(spark, sf_dir):
    out = gaze_stream.stream_segments(_event_stream(spark, sf_dir), ["participant_id"], gap="6 hours")
    return out.select(F.unix_micros("segment_start").alias("segment_start"), F.unix_micros("segment_end").alias("segment_end"), "participant_id", "samples")


def root_summary(spark, sf_dir):
    o, e = (S.table(spark, sf_dir, t) for t in ("orders", "events"))
    return discovery.root_summary({"orders": o.withColumnRenamed("o_custkey", "participant_id"), "customer": S.customers_above(spark, sf_dir).withColumnRenamed("c_custkey", "participant_id"), "events": e.withColumnRenamed("user_id", "participant_id")})


def eye_timing(spark, sf_dir):
    g = S.gaze(spark, sf_dir)
    return trial.eye_timing(g.select(*G.KEYS).distinct(), S.gaze_kept(spark, sf_dir))


def eye_qc_table(spark, sf_dir):
    g = G.valid_mask(G.with_point(S.gaze(spark, sf_dir), "gaze"), *S.SCREEN, accepted=S.ACCEPTED, codes=("val_l",))
    out = qc.eye_qc_table(g.select(*G.KEYS).distinct(), g, gap_ms=3 * DAY, clock="t_ms")
    return rounded(out.select(*G.KEYS, "n_samples", "n_valid", "valid_ratio", "gap_count", "reset_count", "segments", "point_source", "missing_file"))


def eeg_scene_qc(spark, sf_dir):
    return qc.eeg_scene_qc(qc.exclude_subjects(_flags(spark, sf_dir), 0.2)).drop("candidate_reasons", "reasons")


def eeg_derived(spark, sf_dir):
    e = S.eeg_scenes(spark, sf_dir).select(*G.KEYS, F.col("view_dur_s").alias("dur_s"), F.col("rms_mean_uV").alias("gray_O_alpha"), F.col("hf_ratio_20_40Hz").alias("view_O_alpha"))
    return rounded(trial.eeg_derived(e))


def scale_reliability(spark, sf_dir):
    a = S.answers(spark, sf_dir)
    return rounded(scales.reliability(a, {"four": ITEMS, "two": ("S1", "S4"), "means": ("S2", "S3")}, F.col("Complexity") == "A", ("two",), ("means",)))


def panel_sources(spark, sf_dir):
    a = S.answers(spark, sf_dir)
    d = diagnostics
    parts = [
        d.descriptive_panel(scales.descriptives(a, ("S1",), ("WWR", "Complexity"), ci=False), "a", "WWR", "Complexity"),
        d.contrast_panel(scales.poly_contrasts(a, ("S1", "S2"), "WWR", p_values=False), "b"),
        d.convergence_panel(d.modality_convergence(S.eeg_scenes(spark, sf_dir), {"timing": ("view_dur_s",)}), "c"),
        d.correlation_panel(d.order_correlation(a, ITEMS, "WWR"), "d", 3),
        d.claim_panel(claim_support(spark, sf_dir), "e"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return rounded(out.select("panel", "metric", "group_name", "subgroup", "value", "mean", "sem", "n", "label", "source"), 5)


def peak_index_models(spark, sf_dir):
    return rounded(models.model_table(models.peak_index_models(S.answers(spark, sf_dir), ("S1",))), 4)


def trial_index_models(spark, sf_dir):
    a = S.answers(spark, sf_dir).withColumns({"position": F.col("S4"), "Order": F.col("Gender")})
    return rounded(models.model_table(models.trial_index_models(a, ("S1",))), 4)


def eeg_core_models(spark, sf_dir):
    return rounded(models.model_table(models.eeg_core_models(S.answers(spark, sf_dir), ("S2",))), 4)


def scene_folders(spark, sf_dir):
    p = S.table(spark, sf_dir, "part").select("p_partkey", S.folder().alias("folder"))
    return p.select("p_partkey", *[c.alias(n) for n, c in discovery.parse_scene_folder(F.col("folder")).items()])


def gaze_scan(spark, sf_dir):
    return discovery.scan_gaze(S.listing(spark, sf_dir)).select("path", "subject", "record_id", "split_id", "condition_code", "folder_scene_id")


def resolved_orders(spark, sf_dir):
    """Recordings of either folder scheme, with the orders 1, 2 and none by turns."""
    rows = discovery.scan_gaze(S.listing(spark, sf_dir)).filter("condition_code is not null").withColumn("Order", F.expr("CASE CAST(split_id AS bigint) % 3 WHEN 0 THEN 'order 2' WHEN 1 THEN '1' END"))
    return discovery.resolve_orders(rows).select("split_id", "participant_order", "order_missing", "order_scheme", "order_code", "block", "position", "scene_id")


def recording_aliases(spark, sf_dir):
    return trial.resolve_aliases(discovery.scan_gaze(S.listing(spark, sf_dir))).select("split_id", "subject", "participant_id", "alias_source")


def participants(spark, sf_dir):
    out = trial.standardize_participants(S.people(spark, sf_dir))
    return out.select("participant_id", "ExperienceRaw", "ExperienceGroup", "Gender", "GenderRaw", "Age", "RecruitmentBatch", "SupplementFlag", "exclude")


def scene_table(spark, sf_dir):
    p = S.table(spark, sf_dir, "part")
    rows = p.select(F.col("p_brand").alias("participant_id"), F.col("p_partkey").cast("string").alias("scene_id"), F.concat(F.lit("W"), F.col("p_size"), F.lit("%")).alias("WWR"), (F.col("p_size") % 2).alias("Complexity"), F.concat(F.col("p_brand"), F.lit(".csv")).alias("eye_csv_path"))
    out = trial.standardize_scenes(rows, "/data")
    return out.select("participant_id", "scene_id", "WWR_numeric", "eye_csv_path", F.col("block").isNull().alias("no_block"))


def answers_with_design(spark, sf_dir):
    a = S.eeg_scenes(spark, sf_dir).select(*G.KEYS, F.col("view_dur_s").cast("string").alias("S1"))
    scenes = S.table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("participant_id"), F.col("o_orderkey").alias("scene_id"), F.col("o_orderstatus").alias("Cond"), F.col("o_orderpriority").alias("block"))
    who = trial.standardize_participants(S.people(spark, sf_dir))
    out = trial.attach_design(trial.standardize_answers(a, ("S1", "S2")), scenes, who)
    return out.select(*G.KEYS, "S1", "Cond", "block", "ExperienceGroup", "Gender")


def survey_long(spark, sf_dir):
    return scales.survey_to_long(S.survey(spark, sf_dir))


def survey_metadata(spark, sf_dir):
    c = S.people(spark, sf_dir)
    named = c.select(F.concat(F.trim("participant_id"), F.lit("·x")).alias("姓名"), F.col("Experience").alias("Q1.4"), F.col("Gender").alias("Q1.2"), (F.length("participant_id") % 3).cast("string").alias("Q1.8"))
    return discovery.survey_metadata(named).select("questionnaire_subject_id", "participant_id", "Order", "Experience", "Gender", "GenderRaw", "Age")


def name_coding(spark, sf_dir):
    p = S.table(spark, sf_dir, "part")
    return p.select(
        "p_partkey",
        C.canonical_name(F.concat(F.col("p_brand"), F.lit(" • "), F.col("p_name"))).alias("canonical"),
        C.canonical_name(F.concat(F.lit("·"), F.col("p_brand"))).alias("single"),
        C.without_note(F.concat(F.col("p_brand"), F.lit("-"), F.col("p_size"), F.when(F.col("p_size") % 2 == 0, "-7").otherwise("x"))).alias("bare"),
    )


def term_support(spark, sf_dir):
    p = S.table(spark, sf_dir, "part").select(F.col("p_type").alias("term"), ((F.col("p_partkey") % 97) / 100.0).alias("p_value"))
    return diagnostics.term_support(p.withColumn("p_value", F.when(~F.col("term").contains("STEEL"), F.col("p_value")).otherwise(0.5)), ("promo", "steel", "absent"))


def support_scores(spark, sf_dir):
    p = S.table(spark, sf_dir, "part")
    level = F.expr("element_at(array('moderate', 'see_diagnostics', 'now exploratory', 'unsupported_no_data', 'none'), cast(1 + p_size % 5 AS int))")
    return p.select("p_partkey", diagnostics.support_score(level).alias("score"))


def empty_bins(spark, sf_dir):
    return T.empty_bins(_binned(spark, sf_dir), BIN_MS).select(*G.KEYS, "bin_index", "bin_start_ms", "bin_end_ms", "class_name", "samples", "visited")


def eeg_durations(spark, sf_dir):
    e = S.eeg_scenes(spark, sf_dir).select(*G.KEYS, F.lit(0.0).alias("view_start_s"), F.col("view_dur_s").alias("view_end_s"))
    return trial.eeg_duration_table(e)


def recording_summary(spark, sf_dir):
    scanned = discovery.scan_gaze(S.listing(spark, sf_dir))
    signals = S.table(spark, sf_dir, "customer").select(F.concat(F.lit("name"), F.col("c_custkey")).alias("stem"), (F.col("c_acctbal") > 0).alias("has_data"))
    return discovery.recording_summary(scanned, trial.resolve_aliases(scanned), signals)


def hf_ratio(spark, sf_dir):
    return rounded(signal.hf_ratio(S.signal(spark, sf_dir), 64.0))


def _named_recordings(spark, sf_dir):
    return trial.resolve_aliases(discovery.scan_gaze(S.listing(spark, sf_dir)))


def recording_lists(spark, sf_dir):
    c = S.table(spark, sf_dir, "customer")
    name = F.concat(F.lit("name"), F.col("c_custkey"))
    return discovery.recording_lists(_named_recordings(spark, sf_dir), c.select((name).alias("stem")).filter(F.col("c_custkey") % 3 > 0), c.select(name.alias("participant_id")).filter(F.col("c_custkey") % 4 > 0))


def alias_list(spark, sf_dir):
    return discovery.alias_list(_named_recordings(spark, sf_dir))


def run_summary(spark, sf_dir):
    """Rows of each stage, as its own write counts them."""
    trials = _valid(spark, sf_dir)
    stages = {"gaze_valid": trials, "trials": trials.select("participant_id", "scene_id").distinct(), "answers": S.answers(spark, sf_dir), "eeg_scenes": S.eeg_scenes(spark, sf_dir)}
    return io.write_stages(stages, new_path(spark, "stages")).select("stage", "rows")


def segment_marks(spark, sf_dir):
    seg = signal.marker_segments(S.markers(spark, sf_dir).withColumn("latency", F.col("latency") / 1000), STATES)
    return rounded(signal.segment_marks(seg, 3600.0, 0.5).select("subject_id", "ev_ix", "view_dur_s", "near_boundary", "segment_valid_duration"))


_NOT_QUERIES = {"rounded"}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    k: v for k, v in list(globals().items()) if callable(v) and getattr(v, "__module__", "") == __name__ and not k.startswith("_") and k not in _NOT_QUERIES
}
