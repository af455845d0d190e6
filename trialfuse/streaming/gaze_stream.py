"""Streaming forms of time bins and gap segments.

stream_bins() and stream_segments() are windows of event time: bins are aligned to the clock, not to the trial's start,
distinct fixations are counted approximately, and a gap of exactly the threshold ends a session.
trial_bins() and trial_segments() keep a state for each trial and give what the batch operators give.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_bins(stream: DataFrame, keys: Sequence[str], ts: str = "ts", size: str = "2 seconds", delay: str = "10 seconds", fix_id: str = "fix_id", value: str = "fix_dur") -> DataFrame:
    d = stream.withWatermark(ts, delay).groupBy(F.window(ts, size).alias("w"), *keys)
    return d.agg(F.count(F.lit(1)).alias("samples"), F.approx_count_distinct(fix_id).alias("fixations"), F.avg(value).alias("mean_value")).select(F.col("w.start").alias("bin_start"), F.col("w.end").alias("bin_end"), *keys, "samples", "fixations", "mean_value")


def stream_segments(stream: DataFrame, keys: Sequence[str], ts: str = "ts", gap: str = "5 seconds", delay: str = "10 seconds") -> DataFrame:
    d = stream.withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("w"), *keys)
    return d.agg(F.count(F.lit(1)).alias("samples")).select(F.col("w.start").alias("segment_start"), F.col("w.end").alias("segment_end"), *keys, "samples")


def _by_trial(stream: DataFrame, keys: Sequence[str], ts: str, delay: str, value: Column, add: Callable, close: Callable, columns: dict[str, str]) -> DataFrame:
    """Rows of each trial in the order of time, once the watermark has passed them; rows that come later still are left out.

    A trial's state is what waits for the watermark and one open bin or segment: add(open, t, value) gives
    (open, what it closes), close(open, watermark) whether the open one can have no more rows. Times are milliseconds.
    """
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], *[f"{c} {t}" for c, t in columns.items()]])

    def fn(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.getCurrentWatermarkMs()
        wait, now = map(json.loads, state.get) if state.exists else ([], None)
        for p in parts:
            for t, v in zip(p["_t"].tolist(), p["_v"].tolist(), strict=True):
                if t > mark:
                    wait.append([t, None if pd.isna(v) else v])
        ready = sorted((w for w in wait if w[0] <= mark), key=lambda w: w[0])
        wait, out = [w for w in wait if w[0] > mark], []
        for t, v in ready:
            now, done = add(now, t, v)
            out += [] if done is None else [done]
        if now is not None and close(now, mark) and not now.get("closed"):
            now, done = add(now, None, None)
            out += [done]
        state.update((json.dumps(wait), json.dumps(now)))
        ahead = [w[0] for w in wait] + ([now["until"]] if now is not None and not now.get("closed") else [])
        if ahead:
            state.setTimeoutTimestamp(int(max(min(ahead), mark + 1)))
        if out:
            yield pd.DataFrame([(*key, *row) for row in out], columns=[*keys, *columns])

    rows = stream.withWatermark(ts, delay).select(*keys, ts, (F.unix_micros(ts) / 1000).alias("_t"), value.cast("double").alias("_v"))
    return rows.groupBy(*keys).applyInPandasWithState(fn, schema, "wait string, now string", "append", GroupStateTimeout.EventTimeTimeout)


def trial_bins(stream: DataFrame, keys: Sequence[str], ts: str = "ts", bin_ms: float = 2000.0, delay: str = "10 seconds", fix_id: str = "fix_id") -> DataFrame:
    """(keys, bin_index, bin_start_ms, samples, fixations): bins from the trial's first sample on, distinct fixations exact; empty bins have no row."""

    def add(now: dict | None, t: float | None, v: float | None):
        row = lambda: (now["k"], now["k"] * bin_ms, now["n"], len(now["ids"]))
        if t is None:
            return now | {"closed": True}, row()
        start = t if now is None else now["start"]
        k = int((t - start) // bin_ms)
        done = row() if now is not None and k != now["k"] and not now.get("closed") else None
        if now is None or k != now["k"]:
            now = {"start": start, "k": k, "n": 0, "ids": [], "until": start + (k + 1) * bin_ms}
        now["n"] += 1
        if v is not None and v not in now["ids"]:
            now["ids"].append(v)
        return now, done

    return _by_trial(stream, keys, ts, delay, F.col(fix_id), add, lambda now, mark: mark >= now["until"], {"bin_index": "long", "bin_start_ms": "double", "samples": "long", "fixations": "long"})


def trial_segments(stream: DataFrame, keys: Sequence[str], ts: str = "ts", gap_ms: float = 5000.0, delay: str = "10 seconds") -> DataFrame:
    """(keys, segment, start_ms, end_ms, samples): a pause ends a segment only if it is longer than gap_ms."""

    def add(now: dict | None, t: float | None, v: float | None):
        row = lambda: (now["k"], now["first"], now["last"], now["n"])
        if t is None:
            return now | {"closed": True}, row()
        if now is not None and t - now["last"] <= gap_ms:
            return now | {"last": t, "n": now["n"] + 1, "until": t + gap_ms}, None
        done = row() if now is not None and not now.get("closed") else None
        return {"k": 0 if now is None else now["k"] + 1, "first": t, "last": t, "n": 1, "until": t + gap_ms}, done

    return _by_trial(stream, keys, ts, delay, F.lit(None), add, lambda now, mark: mark > now["until"], {"segment": "long", "start_ms": "double", "end_ms": "double", "samples": "long"})
