import random
import re
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as entry
from trialfuse.operators import gaze, timebin
from trialfuse.plans import oracle, queries
from trialfuse.streaming import gaze_stream

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
ROOT = Path(__file__).resolve().parents[1]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if v is None or v != v:
        return "null"
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    try:
        return repr(round(float(v), 6) + 0.0)
    except (TypeError, ValueError):
        return str(v)


@pytest.mark.parametrize("name", sorted(oracle.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    cur = duck.execute(oracle.ORACLE_SQL[name])
    cols = [c[0] for c in cur.description]
    assert sorted(got.columns) == sorted(cols)
    want = sorted(tuple(plain(v) for v in r) for r in cur.fetchall())
    assert sorted(tuple(plain(v) for v in r) for r in got.select(*cols).collect()) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_streams_run(spark, tmp_path):
    rows = [(1, f"2024-01-01 00:00:{s:02d}", s % 2, 1.0) for s in (0, 1, 2, 3, 20, 21, 59)]
    df = spark.createDataFrame(rows, "p long, t string, fix_id long, fix_dur double").select("p", F.to_timestamp("t").alias("ts"), "fix_id", "fix_dur")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, out in (("bins", gaze_stream.stream_bins(stream, ["p"])), ("segments", gaze_stream.stream_segments(stream, ["p"]))):
        q = out.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}_state")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    bins = spark.read.parquet(str(tmp_path / "bins")).collect()
    assert sorted(r.samples for r in bins) == [2, 2, 2]  # the last window is still open
    assert sorted(r.samples for r in spark.read.parquet(str(tmp_path / "segments")).collect()) == [2, 4]


def test_streams_with_a_state_equal_the_batch(spark, tmp_path):
    """Bins from the trial's start and strict gaps, rows out of order, a restart from the checkpoint, and a row that is too late."""
    rnd = random.Random(2)
    rows = [(p, float(t), rnd.randrange(4)) for p in ("a", "b") for t in sorted(rnd.sample(range(0, 60_000, 250), 60)) + [70_000, 75_000, 80_001]]
    rows.sort(key=lambda r: r[1])
    cut = [rows[:50], rows[50:90], rows[90:]]
    for c in cut:
        rnd.shuffle(c)
    cut[2] += [("a", 100.0, 9), ("z", 10_000_000.0, 0)]  # too late; and one that moves the watermark on
    schema = "p string, t double, fix_id long"
    stamp = F.timestamp_millis(F.lit(1_700_000_000_000) + F.col("t").cast("long"))
    frames = [spark.createDataFrame(c, schema).select("p", stamp.alias("ts"), "fix_id").coalesce(1) for c in cut]
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    made = {"bins": gaze_stream.trial_bins(stream, ["p"], bin_ms=2000.0, delay="5 seconds"), "segments": gaze_stream.trial_segments(stream, ["p"], gap_ms=5000.0, delay="5 seconds")}
    for n in ([0, 1], [2]):  # a query for each part, over the same checkpoint
        for i in n:
            frames[i].write.mode("append").parquet(str(tmp_path / "in"))
        for name, out in made.items():
            q = out.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}_state")).trigger(availableNow=True).start()
            assert q.awaitTermination(120)
    g = spark.createDataFrame(rows, schema).withColumns({"scene_id": F.lit(1), "t_ms": F.col("t"), "clock_ms": F.col("t"), "participant_id": F.col("p"), "seq": F.row_number().over(Window.partitionBy("p").orderBy("t"))})
    want = timebin.assign_bins(g, 2000.0).groupBy("p", F.col("bin_index").cast("long")).agg(F.count(F.lit(1)), F.count_distinct("fix_id"))
    got = spark.read.parquet(str(tmp_path / "bins")).filter("p <> 'z'")
    assert sorted(map(tuple, got.select("p", "bin_index", "samples", "fixations").collect())) == sorted(map(tuple, want.collect()))
    want = gaze.segments(g, gap_ms=5000.0).groupBy("p", "segment").agg(F.min("t"), F.max("t"), F.count(F.lit(1)))
    got = spark.read.parquet(str(tmp_path / "segments")).filter("p <> 'z'")
    assert sorted((r.p, r.segment, r.start_ms - 1_700_000_000_000, r.end_ms - 1_700_000_000_000, r.samples) for r in got.collect()) == sorted(map(tuple, want.collect()))
    assert max(r.segment for r in got.collect()) > 1


def test_nothing_outside_llm_imports_it():
    for p in (ROOT / "trialfuse").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"(import|from)\s+.*\bllm\b", p.read_text()), p


def test_entry_without_the_llm_folder(tmp_path):
    import shutil

    shutil.copytree(ROOT / "trialfuse", tmp_path / "trialfuse", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'aoi_metrics' in q and 'pipeline' not in q and not any(k.startswith('op1_') for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
