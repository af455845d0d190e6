"""Affine clock fits between two modalities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WHO = "participant_id"


def landmarks(trials: DataFrame, min_trials: int = 2) -> DataFrame:
    """Start and end of each trial as (x, y) in ms. used: the fit uses it; trials of outlying duration only where fewer than `min_trials` others exist.

    trials: participant_id, scene_id, x_start, x_end, y_start, y_end, outlier.
    """
    ok = trials.filter("x_start is not null and x_end is not null and y_start is not null and y_end is not null")
    n = ok.groupBy(WHO).agg(F.count_if(~F.col("outlier")).alias("_n"))
    used = ok.join(n, WHO).withColumn("used", (F.col("_n") < min_trials) | ~F.col("outlier"))
    pick = F.explode(F.array(F.struct(F.lit("start").alias("edge"), F.col("x_start").alias("x"), F.col("y_start").alias("y")), F.struct(F.lit("end").alias("edge"), F.col("x_end").alias("x"), F.col("y_end").alias("y"))))
    return used.select(WHO, "scene_id", "outlier", "used", pick.alias("m")).select(WHO, "scene_id", "outlier", "used", "m.edge", "m.x", "m.y")


def _ols(marks: DataFrame) -> DataFrame:
    """Slope 1 where x does not vary."""
    d = marks.groupBy(WHO).agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.covar_pop("x", "y").alias("cxy"), F.var_pop("x").alias("vx"))
    slope = F.coalesce(F.try_divide(F.col("cxy"), F.nullif("vx", F.lit(0.0))), F.lit(1.0))
    return d.select(WHO, "n", slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"))


def fit(marks: DataFrame, max_residual_ms: float = 3000.0, min_kept: int = 4) -> DataFrame:
    """participant_id, slope, intercept, n_landmarks, n_used: a line, fitted again without far landmarks if enough remain."""
    marks = marks.filter("used")
    first = _ols(marks)
    near = marks.join(first, WHO).filter(F.abs(F.col("y") - F.col("slope") * F.col("x") - F.col("intercept")) <= max_residual_ms).select(WHO, "x", "y")
    again = _ols(near).filter(F.col("n") >= min_kept).select(WHO, F.col("n").alias("n2"), F.col("slope").alias("s2"), F.col("intercept").alias("i2"))
    out = first.join(again, WHO, "left")
    return out.select(WHO, F.coalesce("s2", "slope").alias("slope"), F.coalesce("i2", "intercept").alias("intercept"), F.col("n").alias("n_landmarks"), F.coalesce("n2", "n").alias("n_used"))


def residuals(marks: DataFrame, fits: DataFrame) -> DataFrame:
    """residual_ms = predicted - y of every landmark, also of those that the fit leaves out."""
    out = marks.join(fits.select(WHO, "slope", "intercept"), WHO)
    predicted = F.col("slope") * F.col("x") + F.col("intercept")
    return out.select(WHO, "scene_id", "edge", "outlier", "x", "y", predicted.alias("predicted"), (predicted - F.col("y")).alias("residual_ms"))


def quality(res: DataFrame) -> DataFrame:
    """Median, 95th percentile and maximum of |residual| over landmarks that are not outliers, of all if there are no others."""
    count = res.groupBy(WHO).agg(F.count_if(~F.col("outlier")).alias("_n"))
    used = res.join(count, WHO).filter((F.col("_n") == 0) | ~F.col("outlier")).withColumn("a", F.abs("residual_ms"))
    q = used.groupBy(WHO).agg(F.percentile("a", F.array(F.lit(0.5), F.lit(0.95))).alias("q"), F.max("a").alias("max_abs_ms"), F.count(F.lit(1)).alias("n"))
    return q.select(WHO, F.col("q")[0].alias("median_abs_ms"), F.col("q")[1].alias("p95_abs_ms"), "max_abs_ms", "n")


def scene_alignment(eye: DataFrame, eeg: DataFrame, tolerance_s: float = 2.0) -> DataFrame:
    """eye: keys, eye_start, eye_end; eeg: keys, eeg_start, eeg_end (s). An outlier has a duration difference over the tolerance; without a difference there is none."""
    out = eye.join(eeg, [WHO, "scene_id"], "left")
    delta = (F.col("eye_end") - F.col("eye_start")) - (F.col("eeg_end") - F.col("eeg_start"))
    return out.withColumns({"duration_delta_s": delta, "outlier": F.coalesce(F.abs(delta) > tolerance_s, F.lit(False))})
