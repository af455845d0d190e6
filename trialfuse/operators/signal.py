"""Marker segmentation, signal quality and band power of sampled signals."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coding import ratio

# Band limits in Hz.
BANDS = {"theta": (4, 7), "alpha": (8, 12), "beta": (13, 30), "low_beta": (13, 20), "high_beta": (20, 30), "low_gamma": (30, 45)}


def marker_segments(markers: DataFrame, states: dict[tuple[str, str], str], who: str = "subject_id", order: str = "ev_ix", view: str = "view", per_block: int = 6) -> DataFrame:
    """Segments between consecutive markers: condition by the pair of types; views count up as scenes, six to a block."""
    w = Window.partitionBy(who).orderBy(order)
    pair = F.concat_ws("\u0001", F.col("type"), F.lead("type").over(w))
    table = F.create_map(*[F.lit(x) for (a, b), s in states.items() for x in (f"{a}\u0001{b}", s)])
    out = markers.withColumns({"next_type": F.lead("type").over(w), "end_latency": F.lead("latency").over(w), "_pair": pair})
    out = out.withColumn("condition", F.when(F.col("next_type").isNotNull(), table[F.col("_pair")])).filter("condition is not null")
    running = Window.partitionBy(who).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = out.withColumn("scene_id", F.sum((F.col("condition") == view).cast("long")).over(running))
    return out.withColumns({"block": F.ceil(F.col("scene_id") / per_block).cast("long"), "position": F.when(F.col("scene_id") > 0, (F.col("scene_id") - 1) % per_block + 1)}).drop("_pair")


def next_in_scene(segments: DataFrame, first: str = "view", then: str = "gray", who: str = "subject_id", order: str = "ev_ix") -> DataFrame:
    """Each `first` segment with the first later `then` segment of the same scene."""
    # from the last row to the first, so that the frame only grows
    w = Window.partitionBy(who, "scene_id").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)
    later = F.last(F.when(F.col("condition") == then, F.struct(order, "latency", "end_latency")), ignorenulls=True).over(w)
    return segments.withColumn("_next", later).filter(F.col("condition") == first).select(who, "scene_id", F.col(order).alias(f"{first}_ix"), F.col("latency").alias(f"{first}_start"), F.col("end_latency").alias(f"{first}_end"), F.col(f"_next.{order}").alias(f"{then}_ix"), F.col("_next.latency").alias(f"{then}_start"), F.col("_next.end_latency").alias(f"{then}_end"))


def signal_qc(samples: DataFrame, by: Sequence[str] = ("segment",), channel: str = "channel", value: str = "uV", flat_sd: float = 1e-6) -> DataFrame:
    """Mean of the channels' RMS and peak to peak, non-finite and flat shares of each segment; channels first, segments from those."""
    v = F.when(~F.isnan(value) & (F.abs(F.col(value)) < float("inf")), F.col(value))
    per = samples.withColumn("_v", v).groupBy(*by, channel).agg(F.count(F.lit(1)).alias("n"), F.count("_v").alias("ok"), F.sqrt(F.avg(F.col("_v") * F.col("_v"))).alias("rms"), (F.max("_v") - F.min("_v")).alias("ptp"), F.stddev_samp("_v").alias("sd"))
    return per.groupBy(*by).agg(F.avg("rms").alias("rms_mean_uV"), F.avg("ptp").alias("peak_to_peak_uV"), (1 - ratio(F.sum("ok"), F.sum("n"))).alias("nan_fraction"), F.avg((F.coalesce("sd", F.lit(0.0)) < flat_sd).cast("double")).alias("flat_fraction"), F.sum("n").alias("n_samples"))


def hf_ratio(samples: DataFrame, fs: float, by: Sequence[str] = ("segment",), order: str = "sample_ix", value: str = "uV", legacy: float = 0.4) -> DataFrame:
    """by, hf_ratio_20_40Hz, eeg_legacy_hf_flag: power of 20-40 Hz over that of 1-45 Hz, of the mean signal over the channels."""
    p = band_power(samples.withColumn("_roi", F.lit("all")), fs, by, "_roi", order, value, {"hf": (20, 40), "total": (1, 45)})
    share = ratio(F.col("hf"), F.col("total"))
    return p.select(*by, share.alias("hf_ratio_20_40Hz"), F.coalesce(share > legacy, F.lit(False)).alias("eeg_legacy_hf_flag"))


def segment_marks(segments: DataFrame, fs: float, min_s: float = 1.0) -> DataFrame:
    """Adds view_dur_s, near_boundary (either marker's type names one) and segment_valid_duration to segments of marker_segments()."""
    seconds = (F.col("end_latency") - F.col("latency")) / fs
    near = F.lower(F.concat_ws(" ", "type", "next_type")).contains("boundary")
    return segments.withColumns({"view_dur_s": seconds, "near_boundary": near, "segment_valid_duration": F.coalesce(seconds >= min_s, F.lit(False))})


def window_of(n: int, fs: float) -> tuple[int, int]:
    """(samples of a window, step to the next): two seconds, at least 8 samples, at most all; half overlapping."""
    win = min(n, max(int(2 * fs), 8))
    return win, win - win // 2


def periodograms(x: np.ndarray, fs: float) -> tuple[np.ndarray, np.ndarray]:
    """(frequencies, one-sided power of each row) of windows of equal length: Hamming, no detrending."""
    win = x.shape[1]
    nfft = max(1 << (win - 1).bit_length(), win)
    w = np.hamming(win)
    p = np.abs(np.fft.rfft(x * w, nfft, axis=1)) ** 2 / (fs * (w * w).sum())
    p[:, 1 : -1 if nfft % 2 == 0 else None] *= 2
    return np.fft.rfftfreq(nfft, 1 / fs), p


def welch_psd(x: np.ndarray, fs: float) -> tuple[np.ndarray, np.ndarray]:
    """Averaged periodograms of the whole signal."""
    win, step = window_of(len(x), fs)
    f, p = periodograms(np.stack([x[i : i + win] for i in range(0, len(x) - win + 1, step)]), fs)
    return f, p.mean(axis=0)


def band_power(samples: DataFrame, fs: float, by: Sequence[str] = ("segment",), roi: str = "roi", order: str = "sample_ix", value: str = "uV", bands: dict[str, tuple[float, float]] = BANDS) -> DataFrame:
    """Band power of each segment and ROI: the mean signal over its channels, then Welch. Null under max(8, fs) finite samples.

    A row is one window of two seconds, however long the segment; tasks transform batches of windows, and as
    the power of a band is linear in the spectrum, the mean over a segment's windows is its band power.
    """
    names, key = list(bands), [*by, roi]
    mean = samples.groupBy(*key, order).agg(F.avg(F.when(~F.isnan(value), F.col(value))).alias("_v"))
    known = mean.filter(F.abs("_v") < float("inf"))
    known = known.withColumns({"_i": F.row_number().over(Window.partitionBy(*key).orderBy(order)).cast("long") - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy(*key))}).filter(F.col("_n") >= max(8, fs))
    most = max(int(2 * fs), 8)
    known = known.withColumn("_win", F.least(F.col("_n"), F.lit(most))).withColumn("_step", F.col("_win") - F.floor(F.col("_win") / 2))
    first = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("_i") - F.col("_win") + 1) / F.col("_step")))
    last = F.least(F.floor(F.col("_i") / F.col("_step")), F.floor((F.col("_n") - F.col("_win")) / F.col("_step")))
    rows = known.withColumns({"_a": first, "_b": last}).filter("_a <= _b").withColumn("_k", F.explode(F.sequence("_a", "_b")))
    windows = rows.groupBy(*key, "_k").agg(F.sort_array(F.collect_list(F.struct("_i", "_v"))).alias("_x")).select(*key, F.col("_x._v").alias("_x"))

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(len(key))
            size, flat = lists.value_lengths().to_numpy(), lists.flatten().to_numpy(zero_copy_only=False)
            start = np.cumsum(size) - size
            out = np.full((b.num_rows, len(names)), np.nan)
            for win in np.unique(size):
                at = np.flatnonzero(size == win)
                f, p = periodograms(flat[start[at][:, None] + np.arange(win)[None, :]], fs)
                for j, (lo, hi) in enumerate(bands.values()):
                    use = (f >= lo) & (f <= hi)
                    if use.sum() > 1:
                        out[at, j] = np.trapezoid(p[:, use], f[use], axis=1)
            columns = [pa.array(out[:, j], from_pandas=True) for j in range(len(names))]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(key))), *columns], names=[*key, *names])

    fields = {f.name: f.dataType.simpleString() for f in mean.schema.fields}
    schema = ", ".join([*[f"`{c}` {fields[c]}" for c in key], *[f"`{b}` double" for b in names]])
    power = windows.mapInArrow(fn, schema).groupBy(*key).agg(*[F.avg(b).alias(b) for b in names])
    got = mean.select(*key).distinct().join(power, key, "left")
    if {"theta", "alpha", "beta"} <= set(names):
        got = got.withColumns({"TAR": ratio(F.col("theta"), F.col("alpha")), "TBR": ratio(F.col("theta"), F.col("beta")), "BA": ratio(F.col("beta"), F.col("alpha"))})
    return got


def segment_table(samples: DataFrame, fs: float, by: Sequence[str] = ("segment",), roi: str = "roi", channel: str = "channel", order: str = "sample_ix", value: str = "uV", legacy: float = 0.4) -> DataFrame:
    """One row for each segment: bands and ratios of each ROI side by side (F_theta, O_alpha, F_TBR, ...), the QC of signal_qc(), hf_ratio_20_40Hz and the legacy flag."""
    power = band_power(samples, fs, by, roi, order, value)
    rois = [r[0] for r in samples.select(roi).distinct().orderBy(roi).collect()]  # a handful
    metrics = [c for c in power.columns if c not in (*by, roi)]
    wide = power.groupBy(*by).agg(*[F.max(F.when(F.col(roi) == r, F.col(m))).alias(f"{r}_{m}") for r in rois for m in metrics])
    return wide.join(signal_qc(samples, by, channel, value), list(by)).join(hf_ratio(samples, fs, by, order, value, legacy), list(by))
