"""Metrics inside time bins that start with the trial."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import gaze as G


def assign_bins(gaze: DataFrame, bin_ms: float = 2000.0, offset_ms: float = 0.0, keys: Sequence[str] = G.KEYS) -> DataFrame:
    """Adds bin_index = floor((t - first t of the trial + offset) / bin); rows without a time go."""
    if bin_ms <= 0:
        raise ValueError("a bin has a positive length")
    start = F.min("t_ms").over(Window.partitionBy(*keys))
    return gaze.filter("t_ms is not null").withColumn("bin_index", F.floor((F.col("t_ms") - start + offset_ms) / bin_ms))


def timebin_metrics(binned: DataFrame, aoi: DataFrame, keys: Sequence[str] = G.KEYS, gap_ms: float = 5000.0, clock: str = "clock_ms", dwell_mode: str = "fixation") -> DataFrame:
    """AOI metrics inside each bin that has samples; totals, segments and baselines are the bin's own."""
    by = [*keys, "bin_index"]
    return G.aoi_metrics(G.segments(binned, by, gap_ms, clock), aoi, by, dwell_mode=dwell_mode)


def empty_bins(binned: DataFrame, bin_ms: float = 2000.0, keys: Sequence[str] = G.KEYS) -> DataFrame:
    """Bins with samples of trials without any AOI: one row each, class '' and no metrics."""
    n = lambda c: F.lit(None).cast("double").alias(c)
    zero = lambda c: F.lit(0).cast("long").alias(c)
    out = binned.select(*keys, "bin_index").distinct()
    at = F.col("bin_index") * bin_ms
    return out.select(
        *keys, "bin_index", at.alias("bin_start_ms"), (at + bin_ms).alias("bin_end_ms"), F.lit("").alias("class_name"), zero("polygon_count"), zero("samples"), zero("FC"), n("TFD"), n("TTFF"), n("FFD"), n("MFD"), n("MPD"), zero("RFF"),
        F.lit(False).alias("visited"), n("attention_share"), n("FC_share"), n("FC_rate"),
    )


def timebin_whole_scene(binned: DataFrame, keys: Sequence[str] = G.KEYS, dwell_mode: str = "fixation") -> DataFrame:
    return G.whole_scene(binned, [*keys, "bin_index"], dwell_mode)


def aligned_timebins(bins: DataFrame, trials: DataFrame, eeg: DataFrame, keys: Sequence[str] = G.KEYS) -> DataFrame:
    """Bins with the trial's columns and its EEG scene metrics, prefixed eeg_."""
    named = eeg.select(*keys, *[F.col(c).alias(c if c.startswith("eeg_") else f"eeg_{c}") for c in eeg.columns if c not in keys])
    return bins.join(trials, list(keys), "left").join(named, list(keys), "left")
