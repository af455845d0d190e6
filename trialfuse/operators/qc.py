"""Quality rules and what they exclude."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import coding as C
from ..sources.scratch import written
from .gaze import KEYS

#: A median's last step collects about so many distinct values; a step before it cuts the middle in so many parts.
FEW_VALUES, CUTS = 10_000, 16

# Names of quality columns, texts of a duration that is not valid, and the defaults of EegPolicy.
QC_ALIASES = {
    "view_hf_ratio": "hf_ratio_20_40Hz",
    "hf_ratio": "hf_ratio_20_40Hz",
    "view_rms_mean": "rms_mean_uV",
    "rms_mean": "rms_mean_uV",
    "rms_uV": "rms_mean_uV",
    "ptp_uV": "peak_to_peak_uV",
    "peak_to_peak": "peak_to_peak_uV",
    "valid_duration": "segment_valid_duration",
}
QC_COLUMNS = ("hf_ratio_20_40Hz", "rms_mean_uV", "peak_to_peak_uV", "nan_fraction", "flat_fraction", "near_boundary", "segment_valid_duration")
NOT_VALID = ("false", "0", "no", "n", "invalid")
POLICIES = ("off", "audit_only", "legacy_0_4", "robust")


@dataclass(frozen=True)
class EegPolicy:
    """policy: off, audit_only, legacy_0_4 or robust."""

    policy: str = "robust"
    min_duration_s: float = 1.0
    max_nan_fraction: float = 0.2
    max_flat_fraction: float = 0.2
    legacy_hf_ratio: float = 0.4
    k: float = 3.5
    min_n: int = 4
    metrics: tuple[str, ...] = ("hf_ratio_20_40Hz", "rms_mean_uV", "peak_to_peak_uV")
    subject_threshold: float = 0.3


def alias_qc_columns(df: DataFrame) -> DataFrame:
    """Each standard name that is missing, from the first of its aliases that exists."""
    first: dict[str, str] = {}
    for a, to in QC_ALIASES.items():
        if a in df.columns and to not in df.columns:
            first.setdefault(to, a)
    return df.withColumns({to: F.col(a) for to, a in first.items()})


def exact_medians(long: DataFrame, few: int = FEW_VALUES) -> dict[str, tuple[int, float]]:
    """metric -> (n, median) of long (metric, v), null values apart: by bisection of values, all metrics in the same jobs.

    A sketch bounds the middle. While more than `few` values lie there, their range is cut into CUTS parts and
    counted; what is collected in the end is some distinct values of the middle with their counts. No
    window and no sort runs over the values. The frame is read once for each job: write it first if it is costly.
    """
    spark = long.sparkSession
    rows = long.filter("v is not null").groupBy("metric").agg(F.count("v").alias("n"), F.percentile_approx("v", F.array(F.lit(0.4995), F.lit(0.5005)), F.lit(10_000)).alias("q")).collect()
    bounds = {r.metric: (r.q[0], r.q[1]) for r in rows}
    n = {r.metric: r.n for r in rows}
    # the sketch's middle holds about a thousandth of the values
    wide = {m for m in bounds if n[m] / 1000 > few and bounds[m][0] < bounds[m][1]}
    while wide:
        edges = {m: [bounds[m][0] + (bounds[m][1] - bounds[m][0]) * i / CUTS for i in range(CUTS)] for m in wide}
        table = spark.createDataFrame([(m, e, bounds[m][1]) for m, e in edges.items()], "metric string, e array<double>, last double")
        met = long.join(F.broadcast(table), "metric").filter("v is not null and v <= last")  # a row for each metric
        part = F.aggregate("e", F.lit(0), lambda k, x: k + (F.col("v") >= x).cast("int"))
        counts: dict[str, list[int]] = {m: [0] * (CUTS + 1) for m in wide}
        for r in met.groupBy("metric", part.alias("k")).count().collect():
            counts[r.metric][r.k] = r["count"]
        done = set()
        for m, c in counts.items():
            ranks, upto = ((n[m] - 1) // 2, n[m] // 2), list(accumulate(c))
            first, last = (next(i for i, u in enumerate(upto) if u > k) for k in ranks)
            low, high = edges[m][first - 1], edges[m][last] if last < CUTS else bounds[m][1]
            if sum(c[first : last + 1]) <= few or (low, high) == bounds[m]:
                done.add(m)
            bounds[m] = (low, high)
        wide -= done
    table = spark.createDataFrame([(m, *x) for m, x in bounds.items()], "metric string, low double, high double")
    middle = long.join(F.broadcast(table), "metric").filter("v <= high").groupBy("metric", F.when(F.col("v") >= F.col("low"), F.col("v")).alias("v")).count()
    found: dict[str, list[tuple]] = {m: [] for m in bounds}
    for r in middle.collect():
        found[r.metric].append((r.v, r["count"]))
    out = {}
    for m, values in found.items():
        values.sort(key=lambda x: (x[0] is not None, x[0] or 0.0))  # what lies below comes first
        upto = list(accumulate(c for _, c in values))
        at = [values[next(i for i, u in enumerate(upto) if u > k)][0] for k in ((n[m] - 1) // 2, n[m] // 2)]
        out[m] = (n[m], (at[0] + at[1]) / 2)
    return out


def robust_thresholds(df: DataFrame, metrics: Sequence[str], k: float = 3.5, min_n: int = 4) -> DataFrame:
    """metric, n, median, mad, threshold over the whole table; the latter three are null under min_n values. All metrics together.

    df runs once: its metrics are written, and both medians read that.
    """
    spark = df.sparkSession
    long = written(df.select(*[C.num(m).alias(m) for m in metrics]).unpivot([], list(metrics), "metric", "v").filter("v is not null"), "metrics")
    mid = exact_medians(long)
    table = spark.createDataFrame([(m, x[1]) for m, x in mid.items()], "metric string, median double")
    off = exact_medians(long.join(F.broadcast(table), "metric").select("metric", F.abs(F.col("v") - F.col("median")).alias("v"))) if mid else {}
    rows = [(m, x[0], *((x[1], off[m][1], x[1] + k * off[m][1]) if x[0] >= min_n else (None, None, None))) for m, x in mid.items()]
    return spark.createDataFrame(rows, "metric string, n long, median double, mad double, threshold double")


def eeg_flags(df: DataFrame, p: EegPolicy = EegPolicy()) -> DataFrame:  # noqa: B008
    """Adds hard, robust and legacy reasons, candidate_reasons, reasons and bad_eeg_quality.

    Without any QC column the policy is unavailable, nothing is bad and there are no reasons. An unknown policy raises.
    """
    if p.policy not in POLICIES:
        raise ValueError(f"unknown EEG policy: {p.policy}")
    df = alias_qc_columns(df)
    have = set(df.columns)
    null = F.lit(None).cast("string")
    metrics = [m for m in p.metrics if m in have]
    hard = []
    if "view_dur_s" in have:
        d = C.num("view_dur_s")
        hard.append(F.when(d.isNull() | (d < p.min_duration_s), "segment_duration"))
    if "segment_valid_duration" in have:
        hard.append(F.when(F.lower(F.trim(F.col("segment_valid_duration").cast("string"))).isin(*NOT_VALID), "segment_valid_duration"))
    for c, most in (("nan_fraction", p.max_nan_fraction), ("flat_fraction", p.max_flat_fraction)):
        if c in have:
            hard.append(F.when(F.coalesce(C.num(c) > most, F.lit(False)), c))
    robust = []
    if metrics:
        most = {r.metric: r.threshold for r in robust_thresholds(df, metrics, p.k, p.min_n).collect()}  # a row for each metric
        robust = [F.when(F.coalesce(C.num(m) > F.lit(most.get(m)).cast("double"), F.lit(False)), f"robust_{m}") for m in metrics]
    legacy = [F.when(F.coalesce(C.num("hf_ratio_20_40Hz") > p.legacy_hf_ratio, F.lit(False)), "legacy_hf_ratio")] if "hf_ratio_20_40Hz" in have else []
    listed = lambda xs: F.array_compact(F.array(*(xs or [null])))
    df = df.withColumns({"hard_reasons": listed(hard), "robust_reasons": listed(robust), "legacy_reasons": listed(legacy)})
    policy = p.policy if have & set(QC_COLUMNS) else "unavailable"
    formal = {"legacy_0_4": ("hard_reasons", "legacy_reasons"), "robust": ("hard_reasons", "robust_reasons")}.get(policy, ())
    reasons = C.ordered_join(F.concat(*[F.col(c) for c in formal])) if formal else F.lit("")
    df = df.withColumns({"qc_policy": F.lit(policy), "candidate_reasons": C.ordered_join(F.concat("hard_reasons", "robust_reasons", "legacy_reasons")) if policy != "unavailable" else F.lit(""), "reasons": reasons})
    return df.withColumn("bad_eeg_quality", F.col("reasons") != "").drop("hard_reasons", "robust_reasons", "legacy_reasons")


def exclude_subjects(df: DataFrame, threshold: float = 0.3, who: str = "participant_id") -> DataFrame:
    """Every row of a participant with more than `threshold` bad rows is bad, unless the policy is off or audit_only. Candidate reasons stay."""
    share = df.groupBy(who).agg(F.avg(F.col("bad_eeg_quality").cast("double")).alias("_share")).filter(F.col(who).isNotNull() & (F.col("_share") > threshold))
    out = df.join(share.select(who, F.lit(True).alias("_out")), who, "left")
    formal = ~F.col("qc_policy").isin("off", "audit_only") if "qc_policy" in df.columns else F.lit(True)
    out = out.withColumn("subject_excluded", F.col("_out").isNotNull() & formal).select(*df.columns, "subject_excluded")
    why = F.concat_ws(";", F.nullif("reasons", F.lit("")), F.when(F.col("subject_excluded"), "eeg_subject_quality_exclusion"))
    return out.withColumns({"reasons": why, "bad_eeg_quality": F.col("bad_eeg_quality") | F.col("subject_excluded")})


def subject_qc(df: DataFrame, who: str = "participant_id") -> DataFrame:
    return df.groupBy(who).agg(F.count(F.lit(1)).alias("n_scenes"), F.count_if("bad_eeg_quality").alias("n_bad"), F.avg(F.col("bad_eeg_quality").cast("double")).alias("bad_fraction"), F.bool_or("subject_excluded").alias("any_exclusion"))


def metric_summary(df: DataFrame, metrics: Sequence[str], bad: str | None = "bad_eeg_quality") -> DataFrame:
    """n, missing and mean of each metric, and the rows that are bad."""
    flag = F.col(bad).cast("int") if bad else F.lit(0)
    long = df.select(flag.alias("_bad"), *[C.num(m).alias(m) for m in metrics]).unpivot(["_bad"], list(metrics), "metric", "v")
    return long.groupBy("metric").agg(F.count("v").alias("n"), F.count_if(F.col("v").isNull()).alias("missing"), F.avg("v").alias("mean"), F.sum("_bad").cast("long").alias("n_bad"))


def sync_qc(trials: DataFrame, eye: DataFrame, eeg: DataFrame, tolerance_s: float = 2.0, expected_scenes: int = 12, keys: Sequence[str] = KEYS) -> DataFrame:
    """eye: (keys, eye_duration_s); eeg: (keys, eeg_duration_s). A missing difference counts as a mismatch."""
    scenes = trials.groupBy("participant_id").agg(F.count_distinct("scene_id").alias("scene_count"))
    out = trials.select(*keys).join(eye, list(keys), "left").join(eeg, list(keys), "left").join(scenes, "participant_id", "left")
    delta = F.col("eye_duration_s") - F.col("eeg_duration_s")
    return out.withColumns({"duration_delta_s": delta, "duration_mismatch": F.coalesce(F.abs(delta) > tolerance_s, F.lit(True)), "scene_count_mismatch": F.col("scene_count") != expected_scenes})


def qc_exclusions(sync: DataFrame, questionnaire: DataFrame, eye: DataFrame, eeg: DataFrame, bad_eeg: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Six reasons in order, and keep."""
    out = sync
    for name, df in (("questionnaire", questionnaire), ("eye", eye), ("eeg", eeg)):
        out = out.join(df.select(*keys).distinct().withColumn(f"_has_{name}", F.lit(True)), list(keys), "left")
    out = out.join(bad_eeg.filter("bad_eeg_quality").select(*keys).distinct().withColumn("_bad", F.lit(True)), list(keys), "left")
    why = F.concat_ws(
        ";",
        *[F.when(F.col(f"_has_{n}").isNull(), F.lit(f"missing_{n}")) for n in ("questionnaire", "eye", "eeg")],
        F.when(F.col("_bad"), F.lit("bad_eeg_quality")),
        F.when(F.col("duration_mismatch"), F.lit("duration_mismatch")),
        F.when(F.col("scene_count_mismatch"), F.lit("scene_count_mismatch")),
    )
    return out.select(*keys, why.alias("reasons"), (why == "").alias("keep"))


def apply_exclusions(master: DataFrame, exclusions: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return master.join(exclusions.filter("keep").select(*keys), list(keys), "left_semi")


def factor_levels(df: DataFrame, factors: Sequence[str], missing: str = "Unknown") -> DataFrame:
    """factor, level, n, percent of all rows."""
    long = df.select(*[F.coalesce(F.col(f).cast("string"), F.lit(missing)).alias(f) for f in factors]).unpivot([], list(factors), "factor", "level")
    n = long.groupBy("factor", "level").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("factor"))
    return n.withColumn("percent", F.col("n") / F.greatest(total, F.lit(1)) * 100)


def participant_flow(df: DataFrame, flag: str = "exclude", batch: str = "RecruitmentBatch") -> DataFrame:
    """step, n: all, excluded, active, and a row for each batch."""
    out = C.truthy(flag, "flow")
    total = df.groupBy().agg(F.count(F.lit(1)).alias("total"), F.count_if(out).alias("excluded"), F.count_if(~out).alias("active"))
    steps = total.unpivot([], ["total", "excluded", "active"], "step", "n")
    per = df.groupBy(F.concat(F.lit("batch_"), F.coalesce(F.col(batch).cast("string"), F.lit("Unknown"))).alias("step")).agg(F.count(F.lit(1)).alias("n"))
    return steps.unionByName(per)


# Columns of an EEG scene summary.
SUMMARY_IDS = ("participant_id", "subject_id")
SUMMARY_DURATIONS = ("view_dur_s", "duration_s", "dur_s", "view_duration_s", "eeg_view_dur_s")
SUMMARY_TIMING = ("view_start_s", "view_end_s")
SUMMARY_CORE = ("O_theta", "F_theta", "O_alpha")
SUMMARY_QC = ("hf_ratio_20_40Hz", "rms_mean_uV", "peak_to_peak_uV", "nan_fraction", "flat_fraction", "segment_valid_duration")


def contract_findings(df: DataFrame) -> DataFrame:
    """severity, finding, n: what an EEG scene summary lacks; a table without findings gives one pass row.

    Errors: no participant identifier, no scene, no core metric, duplicate keys (n: rows beyond the first of their
    key). Warnings: no duration column, and timing and quality columns that are missing.
    """
    spark, have = df.sparkSession, set(df.columns)
    who = next((c for c in SUMMARY_IDS if c in have), None)
    fixed = [] if who else [("error", "missing_identifier", 1)]
    fixed += [] if "scene_id" in have else [("error", "missing_scene_id", 1)]
    fixed += [] if have & set(SUMMARY_CORE) else [("error", "no_core_metric", 1)]
    fixed += [] if have & set(SUMMARY_DURATIONS) else [("warning", "missing_duration", 1)]
    fixed += [("warning", f"missing_{c}", 1) for c in (*SUMMARY_TIMING, *SUMMARY_QC) if c not in have]
    out = spark.createDataFrame(fixed, "severity string, finding string, n long")
    if who and "scene_id" in have:
        dup = df.groupBy(who, "scene_id").agg(F.count(F.lit(1)).alias("c")).agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("n"))
        out = out.unionByName(dup.filter("n > 0").select(F.lit("error").alias("severity"), F.lit("duplicate_keys").alias("finding"), F.col("n").cast("long")))
    none = out.groupBy().agg(F.count(F.lit(1)).alias("c")).filter("c = 0").select(F.lit("pass").alias("severity"), F.lit("pass").alias("finding"), F.lit(0).cast("long").alias("n"))
    return out.unionByName(none)


def contract_status(findings: DataFrame) -> DataFrame:
    """status: error before warning before pass."""
    return findings.agg(F.when(F.count_if(F.col("severity") == "error") > 0, "error").when(F.count_if(F.col("severity") == "warning") > 0, "warning").otherwise("pass").alias("status"))


# Columns of the scene quality table.
SCENE_QC = ("participant_id", "scene_id", "view_dur_s", "hf_ratio_20_40Hz", "rms_mean_uV", "peak_to_peak_uV", "nan_fraction", "flat_fraction", "near_boundary", "segment_valid_duration", "qc_policy", "candidate_reasons", "reasons", "subject_excluded", "bad_eeg_quality")


def eeg_scene_qc(df: DataFrame) -> DataFrame:
    """The scene quality columns that exist."""
    return df.select(*[c for c in SCENE_QC if c in df.columns])


def eye_qc_table(trials: DataFrame, masked: DataFrame, point_source: str = "gaze", gap_ms: float = 5000.0, clock: str = "clock_ms", keys: Sequence[str] = KEYS) -> DataFrame:
    """Validity counts and ratios with time segments of each trial; one exchange of the samples serves both."""
    from .gaze import mask_ratios, segment_counts, segments

    cut = segments(masked, keys, gap_ms, clock)
    return trials.select(*keys).join(mask_ratios(cut, keys), list(keys), "left").join(segment_counts(cut, keys), list(keys), "left").withColumns({"point_source": F.lit(point_source), "missing_file": F.col("n_samples").isNull()})
