import json
import math
import random

import pytest
from pyspark.sql import functions as F

from trialfuse.functions import geometry
from trialfuse.functions.geometry import POINTS
from trialfuse.operators import batch, spatial
from trialfuse.operators import gaze as G
from trialfuse.operators import timebin as T
from trialfuse.sources import io

SQUARE = [(0.0, 0.0), (100.0, 0.0), (100.0, 100.0), (0.0, 100.0)]
GAZE = "participant_id string, scene_id long, seq long, t_ms double, clock_ms double, gx double, gy double, fx double, fy double, fix_id long, fix_dur double, val_l string, val_r string, pupil_l double, pupil_r double"


@pytest.fixture(scope="module")
def trial(spark):
    """Five samples with a long gap before the last two; the last is invalid."""
    t, fx, fy = [0, 100, 200, 6100, 6200], [60, 60, 120, 10, 300], [60, 60, 60, 10, 60]
    fid, dur, ok = [1, 1, 2, 3, 4], [100, 100, 150, 200, 100], "11110"
    left, right = [3.0, 3.1, 3.2, 3.3, 3.4], [3.2, 3.3, 3.4, 3.5, 3.6]
    rows = [("P1", 1, i, float(t[i]), float(t[i]), float(fx[i]), float(fy[i]), float(fx[i]), float(fy[i]), fid[i], float(dur[i]), ok[i], ok[i], left[i], right[i]) for i in range(5)]
    return spark.createDataFrame(rows, GAZE)


@pytest.fixture(scope="module")
def aoi(spark):
    middle = [(50.0, 0.0), (150.0, 0.0), (150.0, 100.0), (50.0, 100.0)]
    far = [(180.0, 180.0), (190.0, 180.0), (190.0, 190.0)]
    return spark.createDataFrame([("left", 0, SQUARE), ("middle", 0, middle), ("far", 0, far)], f"class_name string, polygon_id int, points {POINTS}")


@pytest.fixture(scope="module")
def valid(trial):
    m = G.valid_mask(G.with_point(trial), 200, 200, ["1"])
    return G.segments(m.filter("valid"), gap_ms=5000)


def test_mask_and_segments(trial, valid):
    m = G.valid_mask(G.with_point(trial), 200, 200, ["1"])
    q = G.mask_ratios(m).first()
    assert (q.n_samples, q.n_valid, q.valid_ratio) == (5, 4, 0.8)
    s = G.segment_counts(valid).first()
    assert (s.gap_count, s.reset_count, s.segments) == (1, 0, 2)


def test_metrics(valid, aoi):
    got = {r.class_name: r for r in G.aoi_metrics(valid, aoi).collect()}
    left, middle, far = got["left"], got["middle"], got["far"]
    assert (left.FC, left.TFD, left.RFF, left.samples) == (2, 300, 1, 3)
    assert left.attention_share == pytest.approx(300 / 450) and left.FC_rate == pytest.approx(2 / 6.1)
    assert (middle.FC, middle.MFD, middle.TTFF, middle.FFD) == (2, 125, 0, 100)
    assert left.MPD == pytest.approx((3.1 + 3.2 + 3.4) / 3)
    assert (far.FC, far.TFD, far.visited, far.samples, far.RFF) == (0, None, False, 0, 0)


def test_overlap(valid, aoi):
    (r,) = G.aoi_overlap(valid, aoi).collect()
    assert (r.class_a, r.class_b, r.n_both, r.n_a, r.n_b) == ("left", "middle", 2, 3, 3)


def test_union_of_polygons_counts_a_sample_once(spark, valid):
    two = spark.createDataFrame([("left", 0, SQUARE), ("left", 1, SQUARE)], f"class_name string, polygon_id int, points {POINTS}")
    (r,) = G.aoi_metrics(valid, two).collect()
    assert (r.samples, r.TFD) == (3, 300)
    assert [x.samples for x in G.aoi_metrics(valid, two, level="polygon").collect()] == [3, 3]


def test_two_clocks(spark, aoi):
    """TTFF and the trial's seconds go by the clock of the segments, which need not be that of t_ms."""
    rows = [("P", 1, i, 1000.0 + 10 * i, 5.0 + i, 50.0, 50.0, None, None, i, 10.0, "1", "1", None, None) for i in range(3)]
    df = spark.createDataFrame(rows, GAZE).withColumns({"x": F.col("gx"), "y": F.col("gy")})
    r = G.aoi_metrics(G.segments(df), aoi.filter("class_name = 'left'")).first()
    assert (r.TTFF, r.FC_rate) == (0, pytest.approx(3 / 0.002))
    late = df.withColumn("clock_ms", F.when(F.col("seq") == 0, F.col("clock_ms")))
    assert G.aoi_metrics(G.segments(late), aoi.filter("class_name = 'left'")).first().FC_rate == pytest.approx(3 / 0.02)


def test_without_fixation_ids(valid, aoi):
    got = {r.class_name: r for r in G.aoi_metrics(valid.drop("fix_id"), aoi).collect()}
    assert (got["left"].FC, got["left"].TFD, got["far"].FC) == (3, 400, 0)
    assert G.whole_scene(valid.drop("fix_id")).first().FC == 4


def test_empty_bins(valid):
    got = T.empty_bins(T.assign_bins(valid, 2000)).orderBy("bin_index").collect()
    assert [(r.bin_index, r.bin_start_ms, r.bin_end_ms, r.class_name, r.samples, r.TFD) for r in got] == [(0, 0, 2000, "", 0, None), (3, 6000, 8000, "", 0, None)]


def test_row_mode_and_whole_scene(valid, aoi):
    got = {r.class_name: r.TFD for r in G.aoi_metrics(valid, aoi, dwell_mode="row").collect()}
    assert got["left"] == 400
    w = G.whole_scene(valid).first()
    assert (w.FC, w.TFD, w.samples, w.visited, w.TTFF) == (3, 450, 4, True, None)
    assert G.whole_scene(valid, legacy_ttff=True).first().TTFF == 0


def test_point_in_polygon(spark):
    notch = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (5.0, 2.0), (0.0, 10.0)]
    cases = [(SQUARE, 100, 50, True), (SQUARE, 101, 50, False), (SQUARE, 50, 50, True), (SQUARE, 0, 0, True), (SQUARE, -1, 3, False), (notch, 5, 6, False), (notch, 1, 6, True), (SQUARE[:2], 50, 0, False)]
    df = spark.createDataFrame([(i, p, float(x), float(y)) for i, (p, x, y, _) in enumerate(cases)], f"i int, points {POINTS}, x double, y double")
    got = df.withColumn("edge", geometry.edges(F.col("points"))).select("i", geometry.in_polygon(F.col("x"), F.col("y"), F.col("edge")).alias("hit"), geometry.area(F.col("points")).alias("a")).collect()
    assert [r.hit for r in sorted(got)] == [c[3] for c in cases]
    assert {r.i: r.a for r in got}[0] == 10000 and {r.i: r.a for r in got}[7] == 0


def test_point_source(spark, aoi):
    df = spark.createDataFrame([("P", 1, 0, 0.0, 0.0, 140.0, 50.0, 100.0, 50.0, 1, 10.0, "1", "1", 1.0, 1.0)], GAZE)
    one = aoi.filter("class_name = 'left'")
    run = lambda s: G.aoi_metrics(G.segments(G.with_point(df, s)), one).first()
    assert (run("auto").FC, run("auto").samples, run("gaze").FC, run("gaze").samples) == (1, 1, 0, 0)
    with pytest.raises(ValueError):
        G.point_source(["gx"], "fixation")


def test_null_clock_breaks_nothing(spark):
    rows = [("P", 1, i, None, c, *[None] * 10) for i, c in enumerate([0.0, None, 9000.0, 100.0, 200.0])]
    got = [r.segment for r in G.segments(spark.createDataFrame(rows, GAZE)).orderBy("seq").collect()]
    assert got == [0, 0, 0, 1, 1]


def test_bins(valid, aoi):
    b = T.assign_bins(valid, 2000)
    assert {r.bin_index for r in b.select("bin_index").collect()} == {0, 3}
    got = {(r.bin_index, r.class_name): r for r in T.timebin_metrics(b, aoi).collect()}
    assert len(got) == 6 and got[3, "left"].TFD == 200 and got[3, "left"].attention_share == 1 and got[3, "middle"].samples == 0
    with pytest.raises(ValueError):
        T.assign_bins(valid, 0)
    assert G.file_stats(valid).first().timebin_count == 4  # 6100 ms by ceil
    assert T.timebin_whole_scene(b).count() == 2


def test_aoi_json_layouts(spark):
    poly = [[0, 0], [1, 0], [1, 1]]
    docs = [("a", {"aoi_classes": {"t": [{"points": poly}, {"polygon": poly}]}}), ("b", {"classes": {"w": [{"vertices": [{"x": 0, "y": 0}, {"x": 2, "y": 0}, {"x": 2, "y": 2}]}]}}), ("c", {"aois": [{"class": "k", "points": poly}]})]
    got = io.parse_aoi_json(spark.createDataFrame([(n, json.dumps(d)) for n, d in docs], "aoi_set string, value string")).collect()
    assert sorted((r.aoi_set, r.class_name, r.polygon_id, len(r.points)) for r in got) == [("a", "t", 0, 3), ("a", "t", 1, 3), ("b", "w", 0, 3), ("c", "k", 0, 3)]
    assert {r.class_name: r.points[1].x for r in got}["w"] == 2


def test_gaze_files(spark, tmp_path):
    head = "﻿Recording Time Stamp[ms],Gaze Point X[px],Gaze Point Y[px],Fixation Index,Fixation Duration[ms]"
    for who in ("P01", "P02"):
        (tmp_path / f"{who}_scene01.csv").write_text(head + "\n" + "\n".join(f"{9 - i},{i},nan,{i // 2},x" for i in range(9)) + "\n")
    got = io.read_gaze_files(spark, str(tmp_path)).orderBy("participant_id", "seq").collect()
    assert [(r.participant_id, r.scene_id, r.seq, r.t_ms) for r in got[:3]] == [("P01", 1, 0, 9.0), ("P01", 1, 1, 8.0), ("P01", 1, 2, 7.0)]
    assert len(got) == 18 and got[0].gy is None and got[0].fix_dur is None and got[2].fix_id == 1
    (tmp_path / "a.json").write_text(json.dumps({"aois": [{"class": "k", "points": [[0, 0], [1, 0], [1, 1]]}]}))
    assert io.read_aoi(spark, str(tmp_path / "a.json")).count() == 1
    (tmp_path / "b.json").write_text("{}")
    with pytest.raises(ValueError):
        io.read_aoi(spark, str(tmp_path / "b.json"))


def test_older_batch(spark, trial, aoi):
    m = G.valid_mask(G.with_point(trial), 200, 200, ["1"])
    manifest = spark.createDataFrame([("P1", 1, 45, "a"), ("P2", 1, 15, "b")], "participant_id string, scene_id long, WWR int, samples string")
    who = spark.createDataFrame([("P1",), ("P1",), ("P3",)], "participant_id string")
    got = {r.class_name: r for r in G.batch_metrics(m, aoi, manifest, who).collect()}
    assert set(got) == {"left", "middle", "far"} and (got["left"].TFD, got["left"].WWR, got["left"].n_samples, got["left"].valid_ratio) == (400, 45, 5, 0.8)
    assert G.batch_metrics(m, aoi, manifest.filter("participant_id = 'P2'"), who).count() == 0
    assert {r.polygon_id for r in G.batch_metrics(m, aoi, manifest, who, level="polygon").collect()} == {0}


def test_aligned_bins(spark, valid, aoi):
    b = T.timebin_metrics(T.assign_bins(valid, 2000), aoi)
    trials = spark.createDataFrame([("P1", 1, 45)], "participant_id string, scene_id long, WWR int")
    eeg = spark.createDataFrame([("P1", 1, 3.0, 4.0)], "participant_id string, scene_id long, O_theta double, eeg_hf double")
    got = T.aligned_timebins(b, trials, eeg).collect()
    assert len(got) == 6 and all((r.WWR, r.eeg_O_theta, r.eeg_hf) == (45, 3.0, 4.0) for r in got)


def test_tables_on_disk(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\ufeffid,name\n1,x\n2,\n", encoding="utf-8")
    df = io.read_table(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["id", "name"] and [tuple(r) for r in df.orderBy("id").collect()] == [("1", "x"), ("2", None)]
    for fmt in ("csv", "parquet"):
        io.write_table(df, str(tmp_path / fmt), fmt)
        back = io.read_table(spark, str(tmp_path / fmt)) if fmt == "csv" else spark.read.parquet(str(tmp_path / fmt))
        assert sorted(map(tuple, back.collect())) == [("1", "x"), ("2", None)]
    io.write_table(df, str(tmp_path / "parts"), "parquet", ["id"])
    assert {p.name for p in (tmp_path / "parts").iterdir() if p.is_dir()} == {"id=1", "id=2"}


def test_alias_headers(spark):
    df = spark.createDataFrame([("1", "2", "3", "4")], "`RecordingTimeStamp[ms]` string, `GazePointX[px]` string, Y string, `Validity (Left)` string")
    assert io.resolve_aliases(df).columns == ["t_ms", "gx", "gy", "val_l"]
    two = spark.createDataFrame([("1", None), (None, "2")], "t_ms string, time_ms string")
    assert [r.t_ms for r in io.coalesce_aliases(two).collect()] == ["1", "2"]


# the grid


def brute_inside(points, polygons):
    def held(x, y, p):
        odd = on = False
        for (ax, ay), (bx, by) in zip(p, p[1:] + p[:1], strict=True):
            near = min(ax, bx) - 1e-6 <= x <= max(ax, bx) + 1e-6 and min(ay, by) - 1e-6 <= y <= max(ay, by) + 1e-6
            on |= near and abs((x - ax) * (by - ay) - (y - ay) * (bx - ax)) <= 1e-6
            odd ^= (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / ((by - ay) + 1e-12) + ax
        return on or odd

    return {(i, c, n) for i, x, y, s in points if x is not None and y is not None for t, c, n, p in polygons if s == t and len(p) >= 3 and held(x, y, p)}


@pytest.mark.parametrize("shuffled", [False, True])
def test_grid_join_equals_brute_force(spark, monkeypatch, shuffled):
    """Polygons of very different sizes, concave ones, lines, points on edges and corners; by broadcast, and by shuffle with hot cells."""
    if shuffled:
        monkeypatch.setattr(spatial, "BROADCAST_CELLS", 0)
        monkeypatch.setattr(spatial, "HOT_CELL", 20)
    rnd = random.Random(4)
    polygons = []
    for k in range(60):
        cx, cy, r = rnd.uniform(-50, 50), rnd.uniform(-50, 50), 10 ** rnd.uniform(-2, 2)
        angles = sorted(rnd.uniform(0, 6.283) for _ in range(rnd.choice((3, 4, 7, 12))))
        polygons.append((rnd.choice("ab"), f"c{k % 7}", k, [(cx + r * rnd.uniform(0.3, 1) * math.cos(a), cy + r * rnd.uniform(0.3, 1) * math.sin(a)) for a in angles]))
    polygons += [("a", "sq", 100, [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]), ("a", "line", 101, [(0.0, 0.0), (5.0, 5.0), (9.0, 9.0)]), ("a", "two", 102, [(0.0, 0.0), (1.0, 1.0)])]
    points = [(i, rnd.uniform(-80, 80), rnd.uniform(-80, 80), rnd.choice("ab")) for i in range(600)]
    points += [(1000 + i, float(rnd.randrange(-1, 12)), float(rnd.randrange(-1, 12)), "a") for i in range(300)]
    points += [(2000 + i, 3.0, 4.0, "a") for i in range(60)] + [(3000, None, 1.0, "a"), (3001, 1.0, None, "a")]
    points += [(4000 + k, x, y, s) for k, (s, _, _, p) in enumerate(polygons) for x, y in p[:1]]
    g = spark.createDataFrame(points, "i long, x double, y double, aoi_set string")
    aoi = spark.createDataFrame(polygons, f"aoi_set string, class_name string, polygon_id int, points {geometry.POINTS}")
    got = spatial.inside(g, aoi).select("i", "class_name", "polygon_id").collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == brute_inside(points, polygons)
    outside = {r.i for r in spatial.inside(g, aoi, "left").collect()}
    assert outside == {p[0] for p in points}
    assert spatial.inside(g, aoi.limit(0)).count() == 0


def test_fifty_thousand_polygons(spark):
    """One class for each tile of 10 x 10; the plan joins on cells."""
    n = 50_000
    tile = lambda k: [(float(k % 250 * 10), float(k // 250 * 10)), (float(k % 250 * 10 + 9), float(k // 250 * 10)), (float(k % 250 * 10 + 9), float(k // 250 * 10 + 9)), (float(k % 250 * 10), float(k // 250 * 10 + 9))]
    aoi = spark.range(n).select(F.concat(F.lit("t"), "id").alias("class_name"), F.lit(0).alias("polygon_id"), F.array(*[F.struct((F.col("id") % 250 * 10 + dx).cast("double").alias("x"), (F.floor(F.col("id") / 250) * 10 + dy).cast("double").alias("y")) for dx, dy in ((0, 0), (9, 0), (9, 9), (0, 9))]).alias("points"))
    rnd = random.Random(9)
    points = [(i, rnd.uniform(-5, 2505), rnd.uniform(-5, 2005)) for i in range(2000)]
    got = spatial.inside(spark.createDataFrame(points, "i long, x double, y double"), aoi)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    want = {(i, f"t{int(x // 10) + 250 * int(y // 10)}") for i, x, y in points if 0 <= x < 2500 and 0 <= y < 2000 and x % 10 <= 9 and y % 10 <= 9}
    assert {(r.i, r.class_name) for r in got.collect()} == want and len(tile(0)) == 4


def test_metrics_make_no_rows_for_misses(spark):
    """No join but that of cells, and as many rows as trials times classes."""
    rows = [(f"p{i % 3}", 1, i, float(i * 100), float(i % 7 * 30), 50.0, i // 2, 10.0) for i in range(200)]
    g = G.segments(spark.createDataFrame(rows, "participant_id string, scene_id long, seq long, t_ms double, x double, y double, fix_id long, fix_dur double"), clock="t_ms")
    aoi = spark.createDataFrame([("a", 0, [(0.0, 0.0), (60.0, 0.0), (60.0, 99.0), (0.0, 99.0)]), ("b", 0, [(50.0, 0.0), (100.0, 0.0), (100.0, 99.0), (50.0, 99.0)]), ("far", 0, [(900.0, 0.0), (950.0, 0.0), (950.0, 9.0)])], f"class_name string, polygon_id int, points {geometry.POINTS}")
    out = G.aoi_metrics(g, aoi)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = {(r.participant_id, r.class_name): r for r in out.collect()}
    assert len(got) == 9 and all(not got[p, "far"].visited and got[p, "far"].FC == 0 and got[p, "far"].RFF == 0 for p in ("p0", "p1", "p2"))
    for p in ("p0", "p1", "p2"):
        fix = sorted({r[6] for r in rows if r[0] == p})
        on = [any(r[6] == f and r[0] == p and r[4] <= 60 for r in rows) for f in fix]
        entries = sum(1 for i, x in enumerate(on) if x and (i == 0 or not on[i - 1]))
        assert (got[p, "a"].FC, got[p, "a"].RFF) == (sum(on), max(entries - 1, 0))


@pytest.mark.parametrize("block", [1, 3, 7, 1000])
def test_long_recordings_in_blocks(spark, block):
    rnd = random.Random(block)
    rows = []
    for p in ("a", "b"):
        t = 0.0
        for i in range(120):
            t = rnd.choice((t + 10, t + 10, t + 10, t + 9000, max(t - 500, 0.0)))
            rows.append((p, 1, i, None if rnd.random() < 0.1 else t))
    g = spark.createDataFrame(rows, "participant_id string, scene_id long, seq long, clock_ms double")
    cols = ["participant_id", "seq", "is_reset", "is_gap", "segment", "baseline", "seg_clock"]
    want = G.segments(g).select(cols).collect()
    assert sorted(map(repr, G.long_segments(g, block_rows=block).select(cols).collect())) == sorted(map(repr, want))
    assert len({r.segment for r in want}) > 5


# files and manifests


def gaze_files(root):
    (root / "(1-1-1、2-1-4) 组0-C0W15").mkdir(parents=True)
    (root / "2-C1W45 [x]").mkdir()
    (root / "A_scene01.csv").write_text("﻿Recording Time Stamp[ms],Gaze Point X[px],Gaze Point Y[px],Fixation Index\n0,11,22,1\n5,12,23,1\n", encoding="utf-8")
    (root / "(1-1-1、2-1-4) 组0-C0W15" / "B_scene02.csv").write_text("Gaze Point Y[px],Gaze Point X[px],Fixation Index,Recording Time Stamp[ms]\n22,11,1,0\n")
    (root / "2-C1W45 [x]" / "C+ä%20_scene03.csv").write_text('"time_ms", x ,y,Fixation Point X[px],Fixation Point Y[px],Other\n0,11,22,1,2,z\n')
    (root / "D_scene04.csv").write_text("")


def test_files_with_other_headers(spark, tmp_path):
    gaze_files(tmp_path)
    df = io.read_gaze_files(spark, str(tmp_path))
    got = {(r.participant_id, r.seq): (r.scene_id, r.t_ms, r.gx, r.gy, r.fx, r.has_fixation_point) for r in df.collect()}
    assert got == {("A", 0): (1, 0.0, 11.0, 22.0, None, False), ("A", 1): (1, 5.0, 12.0, 23.0, None, False), ("B", 0): (2, 0.0, 11.0, 22.0, None, False), ("C+ä%20", 0): (3, 0.0, 11.0, 22.0, 1.0, True)}
    points = {r.participant_id: (r.x, r.y) for r in G.with_point(df).collect() if r.seq == 0}
    assert points == {"A": (11.0, 22.0), "B": (11.0, 22.0), "C+ä%20": (1.0, 2.0)}
    assert io._names("﻿a, ,A,\"b,c\"") == ["a", "_c1", "A_2", "b,c"]


def test_rows_of_files_in_blocks(spark, tmp_path):
    """Numbering block by block equals numbering the whole file."""
    (tmp_path / "A_scene01.csv").write_text("t_ms,x,y\n" + "".join(f"{i},{i},{i}\n" for i in range(3000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        raw = spark.read.schema("t_ms string, x string, y string").option("header", True).csv(str(tmp_path)).withColumns({"_path": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start")})
        assert raw.select("_block").distinct().count() > 3
        for whole in (True, False):
            assert all(r.seq == int(r.t_ms) for r in io.with_file_order(raw, ["_path"], whole).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_manifest_to_metrics(spark, tmp_path):
    """Files of a manifest with headers of their own, one without polygons, one that is not there, and recordings named raw_*."""
    gaze_files(tmp_path)
    (tmp_path / "raw_U_7_1.csv").write_text("x,t_ms,y,fixation_index,fixation_duration_ms\n50,0,50,1,100\n60,100,50,1,100\n500,200,50,2,80\n")
    (tmp_path / "aoi.json").write_text('{"aoi_classes": {"table": [{"points": [[0, 0], [100, 0], [100, 100], [0, 100]]}], "far": [{"points": [[900, 900], [901, 900], [901, 901]]}]}}')
    m = [("P1", "1", "A_scene01.csv", "aoi.json", 5.0, 15), (" P2 ", "2.0", str(tmp_path / "(1-1-1、2-1-4) 组0-C0W15" / "B_scene02.csv"), "", None, 45), ("P3", "3", "2-C1W45 [x]/C+ä%20_scene03.csv", "aoi.json", 0.0, 75), ("P4", "1", "none.csv", "aoi.json", 0.0, 15), ("P5", "1", "raw_U_7_1.csv", "aoi.json", 0.0, 15), ("P6", "1", "raw_U_7_1.csv", "aoi.json", 0.0, 15)]
    manifest = spark.createDataFrame(m, "participant_id string, scene_id string, eye_csv_path string, aoi_json_path string, eye_offset_ms double, WWR int")
    people = spark.createDataFrame([("P1", "no"), ("P2", ""), ("P3", None), ("P4", "0"), ("P5", "no"), ("P6", "yes")], "participant_id string, exclude string")
    out = batch.run_batch(spark, manifest, people, str(tmp_path))
    by = {(r.participant_id, r.class_name): r for r in out["class"].collect()}
    assert set(by) == {("P1", "table"), ("P1", "far"), ("P2", "whole_scene"), ("P3", "table"), ("P3", "far"), ("P5", "table"), ("P5", "far")}
    r = by["P5", "table"]
    assert (r.samples, r.FC, r.TFD, r.attention_share, r.WWR, by["P5", "far"].FC) == (2, 1, 100.0, pytest.approx(100 / 180), 15, 0)
    assert by["P3", "table"].samples == 1 and by["P2", "whole_scene"].samples == 1 and by["P2", "whole_scene"].TTFF == 0
    assert out["polygon"].count() == 6
    qc = {r.participant_id: r for r in out["qc"].collect()}
    assert set(qc) == {"P1", "P2", "P3", "P4", "P5"}
    assert (qc["P4"].missing_eye_file, qc["P4"].sample_count, qc["P2"].missing_aoi_file, qc["P1"].missing_aoi_file) == (True, None, True, False)
    assert (qc["P1"].sample_count, qc["P1"].duration_ms, qc["P1"].timebin_count) == (2, 5.0, 1)
    with pytest.raises(ValueError):
        batch.run_batch(spark, manifest.unionByName(manifest.limit(1)), people, str(tmp_path))
    assert batch.run_batch(spark, manifest.filter("eye_csv_path = 'none.csv'"), people, str(tmp_path))["class"] is None
