import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialfuse.functions import coding as C
from trialfuse.operators import clock, diagnostics, models, qc, scales, signal, trial
from trialfuse.sources import discovery


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    ("value", "expr", "want"),
    [
        ("5.0", C.int_key, 5), ("nan", C.num, None), ("x", C.num, None), ("Y", C.truthy, True), ("y", lambda c: C.truthy(c, "flow"), False), ("maybe", lambda c: C.truthy(c, "legacy"), True),
        ("男", C.gender, "Male"), (" ", C.gender, "Unknown"), ("Other", C.gender, "Other"), ("W45.5%", C.first_number, 45.5), ("-3", lambda c: C.first_number(c, True), -3.0),
        ("01:02:03.5", C.clock_ms, 3723500.0), ("12", C.clock_ms, 12.0), ("Ann·x", C.canonical_name, "Ann"), ("A•B", C.canonical_name, "A"), ("11 • 12", C.canonical_name, "11"), ("·x", C.canonical_name, "·x"), ("X-325-400", C.without_note, "X"), ("男生", C.gender, "Male"), ("unknown", C.gender, "Unknown"), ("nan", C.coded_by_patterns, "Unknown"), ("order 2!", C.order_code, "2"), (None, C.order_code, "1"),
        ("low or high", lambda c: C.coded_by_patterns(c, ("low",), ("high",)), "Low"), ("1.0", lambda c: C.is_c1(c, F.lit(None)), True), (None, lambda c: C.is_c1(c, F.lit("C1")), True), (None, lambda c: C.is_c1(c, F.lit(None)), None),
        ("0", lambda c: C.condition_id(c, F.lit("C9"), F.lit("15.0")), "C0_W15"), (None, lambda c: C.condition_id(c, F.lit(None).cast("string"), c), "CNA_WNA"),
    ],
)
def test_coding(spark, value, expr, want):
    assert one(spark, value, expr) == want


def folder_rows(spark, rows):
    """(folder, record_id, Order) with what the folder tells."""
    df = spark.createDataFrame(rows, "folder string, record_id string, Order string")
    return df.withColumns(discovery.parse_scene_folder(F.col("folder")))


def test_scene_folders(spark):
    coded = "(1-1-1、2-1-4) 组0-C0W15"
    got = {r.folder: r for r in folder_rows(spark, [(f, "", "") for f in ("2-C1W45", coded, "junk", "C1W45-2")]).collect()}
    r = got["2-C1W45"]
    assert (r.folder_block, r.folder_position, r.folder_scene_id, r.condition_code, r.Cond, r.WWR, r.Complexity, r.folder_order_scheme) == (2, 5, 11, "C1W45", "C1", 45, 1, "simple_condition_folder")
    r = got[coded]
    assert (r.order_code_1, r.order_code_2, r.scene_group, r.condition_code, r.Complexity, r.folder_scene_id) == ("1-1-1", "2-1-4", "组0", "C0W15", 0, None)
    assert got["junk"].condition_code is None and got["C1W45-2"].folder_block is None


def test_orders_by_record_date(spark):
    coded = "(1-1-2、2-1-4) 组0-C0W75"
    rows = folder_rows(spark, [(coded, "260501120000", "2"), (coded, "260430120000", "order 2"), (coded, "bad", None), ("2-C1W45", "260501120000", "2")])
    got = [(r.order_scheme, r.order_code, r.block, r.position, r.scene_id, r.order_missing) for r in discovery.resolve_orders(rows).collect()]
    assert got == [("neworder2", "1", 1, 1, 1, False), ("order2", "2-1-4", 1, 4, 4, False), ("order1", "1-1-2", 1, 2, 2, True), ("simple_condition_folder", "C1W45", 2, 5, 11, False)]
    with pytest.raises(ValueError, match="no place"):
        discovery.resolve_orders(folder_rows(spark, [("(1-1-2、2-1-4) 组0-C0W99", "260501120000", "2")]))
    with pytest.raises(ValueError, match="no place"):
        discovery.resolve_orders(folder_rows(spark, [("junk", "1", "1")]))


def test_scan_and_manifest(spark, tmp_path):
    for folder, names in (("1-C0W15", ["raw_Ann_260101_1.csv", "notes.csv"]), ("2-C1W45", ["raw_user1_260101_2.csv", "raw_Bob-325-400_260102_1.csv"]), ("适应", ["raw_Ann_260101_0.csv"]), ("practice", ["raw_Ann_260101_9.csv"])):
        (tmp_path / folder).mkdir()
        for n in names:
            (tmp_path / folder / n).write_text("x\n")
    (tmp_path / "1-C0W15" / "1-C0W15.json").write_text("{}")
    files = discovery.list_files(spark, str(tmp_path))
    scanned = discovery.match_aoi(discovery.scan_gaze(files), files)
    assert {(r.subject, r.record_id, r.split_id, r.folder_scene_id) for r in scanned.collect()} == {("Ann", "260101", "1", 1), ("user1", "260101", "2", 11), ("Bob-325-400", "260102", "1", 11)}
    assert discovery.scan_gaze(files, include_adaptation=True).count() == 5
    who = spark.createDataFrame([("Ann", "1", "no"), ("Bob", None, ""), ("Eve", "2", "yes")], "participant_id string, Order string, exclude string")
    got = {(r.participant_id, r.scene_id): r for r in discovery.scene_manifest(scanned, who).collect()}
    assert set(got) == {("Ann", 1), ("Ann", 11), ("Bob", 11)}
    assert got["Ann", 11].alias_source == "record_id" and got["Bob", 11].alias_source == "suffix_note" and got["Bob", 11].order_missing
    assert got["Ann", 1].aoi_json_path.endswith("1-C0W15.json") and got["Ann", 11].aoi_json_path is None
    with pytest.raises(ValueError, match="duplicate"):
        discovery.scene_manifest(scanned.union(scanned), who)
    signals = spark.createDataFrame([("Ann", True), ("Zoe", False)], "stem string, has_data boolean")
    n = {r.metric: r.n for r in discovery.recording_summary(scanned, trial.resolve_aliases(scanned), signals).collect()}
    assert (n["eye_csv_count"], n["eye_subject_count_raw"], n["eye_subject_count_after_alias"], n["matched_subject_count"], n["eye_suffix_note_alias_rows"], n["eye_missing_aoi_json_rows"], n["eeg_fdt_count"]) == (3, 3, 2, 1, 1, 2, 1)


def test_aliases(spark):
    rows = spark.createDataFrame([("r1", "Ann-325-400"), ("r1", "user"), ("r1", "test"), ("r2", "user12"), ("r3", "Bob")], "record_id string, subject string")
    manual = spark.createDataFrame([("Bob", "P8", 1), ("Bob", "P7", 2), ("Ann", "P1", 0)], "alias string, participant_id string, row int")
    run = lambda m: {r.subject: (r.participant_id, r.alias_source) for r in trial.resolve_aliases(rows, m).collect()}
    assert run(None) == {"Ann-325-400": ("Ann", "suffix_note"), "user": ("Ann", "record_id"), "test": ("Ann", "record_id"), "user12": ("user12", ""), "Bob": ("Bob", "")}
    assert run(manual) == {"Ann-325-400": ("P1", "manual"), "user": ("P1", "manual"), "test": ("P1", "manual"), "user12": ("user12", ""), "Bob": ("P7", "manual")}


def test_manual_aliases_act_in_sequence(spark):
    """Chains, circles, ties of rows, a rule to itself and aliases of the raw name, against rules applied one by one."""

    def applied(subject, rules):
        now = subject
        for _, a, to in sorted(rules):
            if a in (now, subject):
                now = to
        return now

    subjects = ["A", "B", "C", "D", "E", "Z"]
    sets = [[(1, "A", "B"), (2, "B", "C")], [(2, "A", "B"), (1, "B", "C")], [(1, "A", "B"), (2, "B", "A"), (3, "A", "D")], [(1, "A", "A"), (2, "A", "B")], [(1, "A", "B"), (1, "B", "C"), (1, "C", "D")], [(1, "A", "B"), (2, "B", "C"), (3, "A", "D"), (4, "C", "E")]]
    rnd = random.Random(8)
    sets += [[(rnd.randrange(12), rnd.choice("ABCDE"), rnd.choice("ABCDE")) for _ in range(15)] for _ in range(4)]
    rows = spark.createDataFrame([("r", s) for s in subjects], "record_id string, subject string")
    for rules in sets:
        manual = spark.createDataFrame([(a, to, i) for i, a, to in rules], "alias string, participant_id string, row int")
        got = {r.subject: r.participant_id for r in trial.resolve_aliases(rows, manual).collect()}
        assert got == {s: applied(s, set(rules)) for s in subjects}, rules


def test_levels_from_text(spark):
    rows = [(p, f"{w} %", f"W{w}", float(w + i)) for i, p in enumerate("abcd") for w in (15, 45, 75)]
    df = spark.createDataFrame(rows, "participant_id string, WWR string, code string, v double")
    number = df.withColumn("WWR", F.regexp_extract("WWR", r"\d+", 0).cast("int"))
    for level in ("WWR", "code"):
        got = scales.poly_contrasts(df, ["v"], level, p_values=False).orderBy("term").collect()
        assert got == scales.poly_contrasts(number, ["v"], "WWR", p_values=False).orderBy("term").collect() and got[0].n == 4
    assert diagnostics.peak_index(df, ["v"], "WWR").first() == diagnostics.peak_index(number, ["v"], "WWR").first()
    given = df.withColumns({"WWR": F.lit("none"), "WWR_numeric": F.regexp_extract("code", r"\d+", 0)})
    assert scales.poly_contrasts(given, ["v"], "WWR", p_values=False).orderBy("term").first().n == 4


def test_participants(spark):
    df = spark.createDataFrame([("A ", "每月1-2次", "男生", "x"), ("B", "每周", "", "20"), ("C", "", "other", None)], "participant_id string, Experience string, Gender string, Age string")
    got = [(r.participant_id, r.ExperienceGroup, r.Gender, r.Age, r.RecruitmentBatch, r.SupplementFlag, r.exclude) for r in trial.standardize_participants(df).collect()]
    assert got == [("A", "Low", "Male", None, "Original", False, False), ("B", "High", "Unknown", 20.0, "Original", False, False), ("C", "Unknown", "other", None, "Original", False, False)]
    batch = trial.standardize_participants(df.withColumn("RecruitmentBatch", F.lit("Supplement")))
    assert all(r.SupplementFlag for r in batch.collect())
    four = ["从不", "每月1-2次", "每月3-4次", "≥5次"]
    assert [one(spark, x, C.coded_by_patterns) for x in four] == ["Low", "Low", "High", "High"]


def test_scene_tables(spark):
    scenes = spark.createDataFrame([("P1 ", "1", "45%", "1", "eye/a.csv"), ("P1", "2", None, "0", "/abs/b.csv")], "participant_id string, scene_id string, WWR string, Complexity string, eye_csv_path string")
    got = {r.scene_id: r for r in trial.standardize_scenes(scenes, "/data").collect()}
    assert (got[1].WWR_numeric, got[1].eye_csv_path, got[1].block, got[2].eye_csv_path) == (45.0, "/data/eye/a.csv", None, "/abs/b.csv")
    with pytest.raises(ValueError, match="duplicate"):
        trial.standardize_scenes(scenes.union(scenes))
    answers = spark.createDataFrame([("P1", 1, "5"), ("P9", 1, "x")], "participant_id string, scene_id long, S1 string")
    who = trial.standardize_participants(spark.createDataFrame([("P1", "often")], "participant_id string, Experience string"))
    long = trial.attach_design(trial.standardize_answers(answers, ["S1", "S2"]), trial.standardize_scenes(scenes), who)
    assert {(r.participant_id, r.S1, r.WWR_numeric, r.ExperienceGroup) for r in long.collect()} == {("P1", 5.0, 45.0, "High"), ("P9", None, None, None)}
    assert trial.manifest_scenes(scenes.withColumn("eye_offset_ms", F.lit("x"))).first().eye_offset_ms == 0
    with pytest.raises(ValueError, match="missing"):
        trial.manifest_participants(answers)
    assert trial.eeg_duration_table(answers.withColumns({"duration_s": F.lit("3"), "dur_s": F.lit("2")})).first().eeg_view_dur_s == 2


def test_coalesced_design(spark):
    df = spark.createDataFrame([(None, 45, 1), (15, 75, 2)], "WWR int, q_WWR int, block_qdup int").withColumn("x_block", F.lit(7))
    got = trial.coalesce_design(df).collect()
    assert [(r.WWR, r.block) for r in got] == [(45, 7), (15, 7)] and "q_WWR" in got[0]


def test_survey_metadata(spark):
    df = spark.createDataFrame([("古丽·A", "2", "女生"), ("nan", "1", ""), ("李", "", "男")], "`Q1.0_姓名：` string, `Q1.8` string, `Q1.2_性别：` string")
    got = {r.participant_id: (r.questionnaire_subject_id, r.Order, r.Gender, r.Age) for r in discovery.survey_metadata(df.toDF("Q1.0_姓名：", "Q1.8", "Q1.2_性别：")).collect()}
    assert got == {"古丽": ("古丽·A", 2, "Female", ""), "李": ("李", None, "Male", "")}
    with pytest.raises(ValueError, match="duplicate"):
        discovery.survey_metadata(df.union(df))


def test_keys_and_columns(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "participant_id string, scene_id long")
    assert [r.n_rows for r in trial.duplicate_keys(df).collect()] == [2]
    with pytest.raises(ValueError, match="duplicate"):
        trial.require_unique(df)
    with pytest.raises(ValueError, match="missing"):
        trial.require_columns(df, ["x"])


def test_duration_choice_is_by_column():
    assert "view_dur_s" in str(trial.eeg_duration(["start_s", "end_s", "view_dur_s"]))
    assert "dur_s" in str(trial.eeg_duration(["duration_s", "dur_s"])) and "duration_s" not in str(trial.eeg_duration(["duration_s", "dur_s"]))


def test_wide_and_survey(spark):
    wide = spark.createDataFrame([("P1", "1", "2", "x"), ("P2", "3", "4", "5")], "participant_id string, S1_1 string, S1_2 string, scene2_S2 string")
    got = sorted(tuple(r) for r in scales.wide_to_long(wide).collect())
    assert got == [("P1", 1, 1.0, None), ("P1", 2, 2.0, None), ("P2", 1, 3.0, None), ("P2", 2, 4.0, 5.0)]
    survey = spark.createDataFrame([("P1", "5分", "8", "6", "7", "2", "4")], "`participant_id` string, `Q2.1_S1` string, `Q2.5_S5` string, `Q8.1_B1` string, `Q9.1_S1` string, `Q15.2_B2` string, `Q16.1_x` string")
    got = {r.scene_id: r for r in scales.survey_to_long(survey).collect()}
    assert (got[1].S1, got[1].S5, got[6].B1, got[7].S1, got[12].B2) == (5, 8, 6, 7, 2) and all(r.IPQ1 == 4 for r in got.values())


def test_labels_of_scales(spark):
    df = spark.createDataFrame([("P", 1, 1.0, 9.0, 0.5), ("Q", 1, 7.0, 2.0, 3.0)], "participant_id string, scene_id long, S1 double, S5 double, S2 double")
    got = {r.item: r.status for r in scales.scale_range_qc(df, ("S1", "S2", "S5")).collect()}
    assert got == {"S1": "within_1_7_expected_range", "S5": "S5_detected_9_point_scale_S5_7_created", "S2": "outside_1_7_expected_range_review_required"}
    rows = [(f"P{i}", lv, v + i / 10) for i in range(4) for lv, v in ((15, 1.0), (45, 5.0 + i), (75, 2.0))]
    c = {r.term: r.direction for r in scales.poly_contrasts(spark.createDataFrame(rows, "participant_id string, WWR int, y double"), ["y"], "WWR").collect()}
    assert c == {"Linear": "linear_increase_15_to_75", "Quadratic": "inverted_u_45_highest"}
    wide = spark.createDataFrame([("P", "1", "2", "3", "4")], "participant_id string, `S1-scene2` string, `3.B1` string, ipq2_12 string, other_1 string")
    assert sorted((r.scene_id, r.S1, r.B1, r.IPQ2) for r in scales.wide_to_long(wide).collect()) == [(2, 1.0, None, None), (3, None, 2.0, None), (12, None, None, 3.0)]


def test_composites(spark):
    df = spark.createDataFrame([("P", 1, 1.0, 2.0, 3.0, None, 9.0), ("P", 2, 1.0, None, None, None, 1.0)], "participant_id string, scene_id long, S1 double, S2 double, S3 double, S4 double, S5 double")
    got = scales.composites(df, b_items=(), ipq=("S1", "S5")).orderBy("scene_id").collect()
    assert [r.Afford4 for r in got] == [2.0, None] and [r.S5_7 for r in got] == [7.0, 1.0] and got[0].IPQ_mean == 3.0


def test_descriptives_and_alpha(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(30, 3)) + rng.normal(size=(30, 1))
    df = spark.createDataFrame([(f"P{i}", "g", *map(float, r)) for i, r in enumerate(x)], "participant_id string, g string, a double, b double, c double")
    d = scales.descriptives(df, ["a"], ["g"]).first()
    v = x[:, 0]
    n, m = 30, v - v.mean()
    g1 = (m**3).mean() / (m**2).mean() ** 1.5
    assert d.skew == pytest.approx(g1 * np.sqrt(n * (n - 1)) / (n - 2)) and d.n_subjects == 30
    assert d.ci_high - d["mean"] == pytest.approx(2.045229642 * v.std(ddof=1) / np.sqrt(n))
    alpha = 3 / 2 * (1 - x.var(axis=0, ddof=1).sum() / x.sum(axis=1).var(ddof=1))
    assert scales.cronbach(df, ["a", "b", "c"]).first().alpha == pytest.approx(alpha)
    assert scales.cronbach(df.limit(2), ["a", "b", "c"]).first().status == "insufficient"


def test_contrasts_and_welch(spark):
    rng = np.random.default_rng(1)
    rows = [(f"P{i}", lv, float(rng.normal() + k)) for i in range(12) for k, lv in enumerate((15, 45, 75))] + [("Q", 15, 1.0)]
    df = spark.createDataFrame(rows, "participant_id string, WWR int, y double")
    m = np.array([r[2] for r in rows[:-1]]).reshape(12, 3)
    s = m @ [-1, 0, 1]
    t = s.mean() / (s.std(ddof=1) / np.sqrt(12))
    got = {r.term: r for r in scales.poly_contrasts(df, ["y"], "WWR").collect()}
    assert got["Linear"].n == 12 and got["Linear"].t == pytest.approx(t) and got["Linear"].F == pytest.approx(t * t)
    assert 0 < got["Linear"].p_value < 0.01 and got["Quadratic"].p_value > 0.0
    w = scales.welch_pairs(df, "y", "WWR").collect()
    assert len(w) == 3 and all(0 <= r.p_value <= 1 for r in w)


def dense_lmm(y, x, g, theta):
    z = (g[:, None] == np.unique(g)[None, :]).astype(float)
    v = np.eye(len(y)) + theta * z @ z.T
    vi = np.linalg.inv(v)
    xtx = np.linalg.inv(x.T @ vi @ x)
    b = xtx @ x.T @ vi @ y
    r = y - x @ b
    s2 = r @ vi @ r / len(y)
    return b, np.sqrt(np.diag(xtx) * s2), s2, -0.5 * (len(y) * np.log(2 * np.pi * s2) + len(y) + np.linalg.slogdet(v)[1])


def test_mixed_model_equals_dense_likelihood(spark):
    rng = np.random.default_rng(2)
    g = np.repeat(np.arange(15), rng.integers(2, 6, 15))
    x = rng.normal(size=len(g))
    c = rng.integers(0, 3, len(g))
    y = 1 + 0.5 * x + (c == 2) * 0.7 + rng.normal(size=15)[g] + 0.5 * rng.normal(size=len(g))
    df = spark.createDataFrame([(str(a), float(b), f"l{k}", float(d)) for a, b, k, d in zip(g, x, c, y, strict=True)], "participant_id string, x double, c string, y double")
    fit = models.fit_lmm(df, "y", models.design(df, models.parse_terms(["x", "C(c)"])), "participant_id")
    assert fit.names == ["Intercept", "x", "C(c)[T.l1]", "C(c)[T.l2]"]
    design = np.stack([np.ones(len(y)), x, c == 1, c == 2], axis=1).astype(float)
    theta = fit.group_variance / fit.residual_variance
    b, se, s2, ll = dense_lmm(y, design, g, theta)
    assert np.allclose(fit.beta, b) and np.allclose(fit.se, se) and fit.loglik == pytest.approx(ll)
    assert all(ll >= dense_lmm(y, design, g, theta * f)[3] - 1e-9 for f in (0.9, 1.1, 0.5, 2))


def test_ols_logit_and_diagnostics(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=400)
    y = 2 + 3 * x + rng.normal(size=400)
    v = rng.random(400) < 1 / (1 + np.exp(-(0.3 + 1.2 * x)))
    df = spark.createDataFrame([(str(i % 7), float(a), float(b), bool(k)) for i, (a, b, k) in enumerate(zip(x, y, v, strict=True))], "participant_id string, x double, y double, visited boolean")
    df = df.withColumns({"twice": F.col("x") * 2, "flat": F.lit(1)})
    got = {r.term: r for r in models.fit_models(df, ["y"], ["x", "twice", "flat"], "ols").collect()}
    b = np.linalg.lstsq(np.stack([np.ones(400), x], axis=1), y, rcond=None)[0]
    assert set(got) == {"Intercept", "x"} and got["x"].estimate == pytest.approx(b[1])
    logit = {r.term: r for r in models.fit_models(df, ["visited"], ["x"], "logit").collect()}
    d, w = np.stack([np.ones(400), x], axis=1), np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-d @ w))
        w += np.linalg.solve(d.T @ (d * (p * (1 - p))[:, None]), d.T @ (v - p))
    assert [logit["Intercept"].estimate, logit["x"].estimate] == pytest.approx(list(w))
    assert models.fit_models(df, ["absent"], ["x"]).first().note == "missing outcome"
    assert models.fit_models(df.filter("visited"), ["visited"], ["x"], "logit").first().note == "not estimable"
    r = diagnostics.order_correlation(df, ["y", "flat"], "x").collect()
    assert {q.outcome: q.r for q in r} == {"y": pytest.approx(np.corrcoef(x, y)[0, 1]), "flat": None}


def test_terms_of_the_model_families(spark):
    have = {"WWR", "Complexity", "ExperienceGroup", "Gender", "Age", "position"}
    assert models.core_terms(have) == ["C(WWR)*C(Complexity)*C(ExperienceGroup)", "C(Gender)", "Age", "position"]
    assert models.core_terms({"WWR", "block"}) == ["C(WWR)", "block"] and models.peak_terms({"Complexity", "Age"}) == ["C(Complexity)", "Age"]
    df = spark.createDataFrame([(1, "a", None, 1.0), (2, "a", None, 2.0)], "WWR int, Gender string, Age double, block double")
    assert models.varying(df, ("WWR", "Gender", "Absent"), ("Age", "block")) == {"WWR", "block"}


def test_distribution_values(spark):
    from trialfuse.functions import dist

    assert dist.t_sf2([2.0, 5.0, 0.0], [10, 3, 7]).tolist() == pytest.approx([0.07338803, 0.01539244, 1.0], abs=1e-8)
    assert dist.f_sf([3.0, 1.0], [2, 4], [20, 10]).tolist() == pytest.approx([0.07253815, 0.45155505], abs=1e-8)
    assert dist.t_ppf(0.975, [1, 29]).tolist() == pytest.approx([12.7062047, 2.0452296], abs=1e-6)
    df = spark.createDataFrame([(2.0, 10.0, 11), (None, 3.0, 1), (1.0, 0.0, 2)], "t double, df double, n long")
    got = dist.with_t_quantile(dist.with_p_values(df, "t", "t", "df"), "n").collect()
    assert [r.p_value for r in got] == [pytest.approx(0.07338803), None, None] and got[0].t_crit == pytest.approx(2.2281389) and got[1].t_crit is None


def test_interaction_terms():
    assert [t.name for t in models.parse_terms(["C(a)*b"])] == ["C(a)", "b", "C(a):b"]


def test_clock(spark):
    rows = [("P", 1, 1000.0, 3000.0, 11000.0, 13000.0, False), ("P", 2, 5000.0, 7000.0, 15000.0, 17000.0, False), ("P", 3, 0.0, 90000.0, 0.0, 1000.0, True)]
    t = spark.createDataFrame(rows, "participant_id string, scene_id long, x_start double, x_end double, y_start double, y_end double, outlier boolean")
    marks = clock.landmarks(t)
    f = clock.fit(marks).first()
    assert (f.slope, f.intercept, f.n_landmarks) == (pytest.approx(1), pytest.approx(10000), 4)
    res = clock.residuals(marks, clock.fit(marks))
    assert clock.quality(res).first().max_abs_ms == pytest.approx(0, abs=1e-6)
    # a trial of outlying duration has residuals too: predicted less measured
    assert {(r.edge, round(r.residual_ms)) for r in res.filter("scene_id = 3").collect()} == {("start", 10000), ("end", 99000)}
    eye = spark.createDataFrame([("P", 1, 0.0, 5.0), ("P", 2, 0.0, None)], "participant_id string, scene_id long, eye_start double, eye_end double")
    eeg = spark.createDataFrame([("P", 1, 0.0, 1.0)], "participant_id string, scene_id long, eeg_start double, eeg_end double")
    assert {r.scene_id: r.outlier for r in clock.scene_alignment(eye, eeg).collect()} == {1: True, 2: False}


def test_eeg_policies(spark):
    rows = [("P1", i, h, r, p) for i, (h, r, p) in enumerate(zip([0.10, 0.11, 0.12, 0.80], [10.0, 11.0, 12.0, 13.0], [50.0, 51.0, 52.0, 53.0], strict=True))]
    df = spark.createDataFrame(rows, "participant_id string, scene_id long, hf_ratio_20_40Hz double, rms_mean_uV double, peak_to_peak_uV double")
    run = lambda **k: {r.scene_id: r for r in qc.eeg_flags(df, qc.EegPolicy(min_n=4, **k)).collect()}
    robust = run()
    assert [robust[i].bad_eeg_quality for i in range(4)] == [False, False, False, True]
    assert robust[3].reasons == "robust_hf_ratio_20_40Hz" and "legacy_hf_ratio" in robust[3].candidate_reasons
    assert run(policy="legacy_0_4")[3].reasons == "legacy_hf_ratio" and not run(policy="off")[3].bad_eeg_quality
    out = qc.exclude_subjects(qc.eeg_flags(df, qc.EegPolicy(min_n=4)), 0.2).collect()
    assert all(r.bad_eeg_quality and "eeg_subject_quality_exclusion" in r.reasons for r in out)
    assert not any(r.subject_excluded for r in qc.exclude_subjects(qc.eeg_flags(df)).collect())  # a quarter is not over 0.3
    with pytest.raises(ValueError, match="unknown EEG policy"):
        qc.eeg_flags(df, qc.EegPolicy(policy="strict"))
    marked = spark.createDataFrame([("P1", 1, "true"), ("P1", 2, "false"), ("P1", 3, "invalid"), (None, 4, "n")], "participant_id string, scene_id long, valid_duration string")
    got = {r.scene_id: r for r in qc.exclude_subjects(qc.eeg_flags(marked)).collect()}
    assert [got[i].reasons for i in (1, 2, 4)] == ["eeg_subject_quality_exclusion", "segment_valid_duration;eeg_subject_quality_exclusion", "segment_valid_duration"]
    assert not any(r.bad_eeg_quality for r in qc.exclude_subjects(qc.eeg_flags(marked, qc.EegPolicy(policy="audit_only"))).collect())
    bare = spark.createDataFrame([("P", 1, 3.0)], "participant_id string, scene_id long, view_dur_s double")
    r = qc.eeg_flags(bare).first()
    assert (r.qc_policy, r.bad_eeg_quality, r.candidate_reasons) == ("unavailable", False, "")


def test_fusion_qc(spark):
    k = "participant_id string, scene_id long"
    trials = spark.createDataFrame([("P01", 1), ("P01", 2), ("P02", 1)], k)
    eye = spark.createDataFrame([("P01", 1, 2.0), ("P01", 2, 5.0), ("P02", 1, 2.0)], f"{k}, eye_duration_s double")
    eeg = spark.createDataFrame([(*x, 2.0) for x in (("P01", 1), ("P01", 2), ("P02", 1))], f"{k}, eeg_duration_s double")
    sync = qc.sync_qc(trials, eye, eeg, 2.0, 2)
    bad = trials.limit(0).withColumn("bad_eeg_quality", F.lit(True))
    got = {(r.participant_id, r.scene_id): r.reasons for r in qc.qc_exclusions(sync, trials, eye, eeg, bad).collect()}
    assert got == {("P01", 1): "", ("P01", 2): "duration_mismatch", ("P02", 1): "scene_count_mismatch"}
    got = {(r.participant_id, r.scene_id): r.reasons for r in qc.qc_exclusions(qc.sync_qc(trials, eye, eeg.limit(0), 2.0, 2), trials, eye, eeg.limit(0), bad).collect()}
    assert got["P01", 1] == "missing_eeg;duration_mismatch"


def test_contract(spark):
    full = spark.createDataFrame([("s", 1, *[1.0] * 10)], "subject_id string, scene_id long, O_alpha double, view_start_s double, view_end_s double, dur_s double, hf_ratio_20_40Hz double, rms_mean_uV double, peak_to_peak_uV double, nan_fraction double, flat_fraction double, segment_valid_duration double")
    assert "error" not in {r.severity for r in qc.contract_findings(full.withColumnRenamed("subject_id", "participant_id")).collect()}
    assert qc.contract_status(qc.contract_findings(full.select("subject_id", "scene_id", "O_alpha"))).first().status == "warning"
    assert [r.severity for r in qc.contract_findings(full).collect()] == ["pass"]
    assert "error" in {r.severity for r in qc.contract_findings(full.drop("scene_id")).collect()}
    assert {r.severity for r in qc.contract_findings(full.select("subject_id", "scene_id", "O_alpha")).collect()} == {"warning"}
    assert "duplicate_keys" in {r.finding for r in qc.contract_findings(full.union(full)).collect()}


def test_claims_and_panels(spark):
    claims = spark.createDataFrame([("c1", ["a", "b"]), ("c2", ["z"]), ("c3", ["a", "z"])], "claim_id string, required array<string>")
    got = {r.claim_id: r.level for r in diagnostics.claim_support(claims, ["a", "b"]).collect()}
    assert got == {"c1": "moderate_pending_effect_tests", "c2": "exploratory_incomplete_modalities", "c3": "exploratory_incomplete_modalities"}
    assert {r.level for r in diagnostics.claim_support(claims, []).collect()} == {"unsupported_no_data"}
    issues = spark.createDataFrame([("i1", "c1", "x"), ("i2", "c2", "x"), ("i3", "c1", None)], "issue string, claim_id string, evidence string")
    got = {r.issue: r.readiness for r in diagnostics.issue_matrix(issues, diagnostics.claim_support(claims, ["a", "b"])).collect()}
    assert got == {"i1": "ready", "i2": "weak_support", "i3": "missing_evidence"}
    assert len(diagnostics.empty_panel(spark, "p").columns) == 13
    assert [one(spark, x, diagnostics.support_score) for x in ("see_diagnostics", "now moderate_pending", "exploratory_only_three_levels", "else")] == [1.5, 2.0, 1.0, None]
    coef = spark.createDataFrame([("C(WWR)[T.45]", 0.01), ("x", 0.5), (None, None)], "term string, p_value double")
    level = lambda df: {r.fragment: r.level for r in diagnostics.term_support(df, ["wwr", "x", "zz"]).collect()}
    assert level(coef) == {"wwr": "moderate", "x": "exploratory", "zz": "unsupported_no_term"}
    assert set(level(coef.limit(0)).values()) == {"unsupported_no_model"}


def test_band_power_of_a_tone(spark):
    fs, n = 64.0, 512
    rows = [("s", "F", i, ch, float(np.sin(2 * np.pi * 10 * i / fs))) for i in range(n) for ch in "ab"] + [("t", "F", i, "a", 1.0) for i in range(20)]
    df = spark.createDataFrame(rows, "segment string, roi string, sample_ix int, channel string, uV double")
    got = {r.segment: r for r in signal.band_power(df, fs).collect()}
    assert got["s"].alpha == pytest.approx(0.5, rel=0.02) and got["s"].theta < 0.01 and got["t"].alpha is None
    q = {r.segment: r for r in signal.signal_qc(df).collect()}
    assert q["s"].rms_mean_uV == pytest.approx(np.sqrt(0.5), rel=0.01) and q["t"].flat_fraction == 1
    two = spark.createDataFrame([("s", c, i, float(v)) for c, vs in (("a", (0, 2)), ("b", (0, 10))) for i, v in enumerate(vs)], "segment string, channel string, sample_ix int, uV double")
    assert signal.signal_qc(two).first().peak_to_peak_uV == 6
    hf = {r.segment: r for r in signal.hf_ratio(df, fs).collect()}
    assert hf["s"].hf_ratio_20_40Hz < 0.01 and not hf["s"].eeg_legacy_hf_flag and hf["t"].hf_ratio_20_40Hz is None
    seg = spark.createDataFrame([("V", "G", 0.0, 640.0), ("V", "Boundary", 0.0, 32.0)], "type string, next_type string, latency double, end_latency double")
    assert [(r.view_dur_s, r.near_boundary, r.segment_valid_duration) for r in signal.segment_marks(seg, fs).collect()] == [(10.0, False, True), (0.5, True, False)]


def test_markers(spark):
    rows = [("s", i, t, 10.0 * i) for i, t in enumerate("AVGBVG")]
    df = spark.createDataFrame(rows, "subject_id string, ev_ix int, type string, latency double")
    seg = signal.marker_segments(df, {("A", "V"): "rest", ("V", "G"): "view", ("G", "B"): "gray", ("B", "V"): "rest"})
    assert [(r.ev_ix, r.condition, r.scene_id) for r in seg.orderBy("ev_ix").collect()] == [(0, "rest", 0), (1, "view", 1), (2, "gray", 1), (3, "rest", 1), (4, "view", 2)]
    got = [(r.view_ix, r.gray_ix) for r in signal.next_in_scene(seg).orderBy("view_ix").collect()]
    assert got == [(1, 2), (4, None)]


def test_subjects_and_inventory(spark, tmp_path):
    eeg = spark.createDataFrame([("s1", 1), (" s2", 2), ("s9", 3)], "subject_id string, scene_id long")
    who = spark.createDataFrame([("P1", "s1"), ("P2", "s2"), ("P3", None)], "participant_id string, eeg_subject_id string")
    known, unknown = trial.map_subjects(eeg, who)
    assert {(r.participant_id, r.scene_id) for r in known.collect()} == {("P1", 1), ("P2", 2)} and [r.subject_id for r in unknown.collect()] == ["s9"]
    for n in ("a.set", "a.fdt", "b.set", "c.fdt"):
        (tmp_path / n).write_text("x")
    assert {(r.stem, r.has_data) for r in discovery.signal_inventory(discovery.list_files(spark, str(tmp_path))).collect()} == {("a", True), ("b", False)}


def test_trial_columns(spark):
    df = spark.createDataFrame([("P", 1, 45, "x", 2)], "participant_id string, scene_id long, WWR int, other string, block int")
    assert trial.trial_base(df).columns == ["participant_id", "scene_id", "WWR", "block"]
    assert trial.ordered_columns(df.select("other", "block", "scene_id", "WWR", "participant_id")).columns == ["participant_id", "scene_id", "WWR", "block", "other"]
    assert trial.prefixed(df, "q_").columns == ["participant_id", "scene_id", "WWR", "q_other", "block"]


def test_medians_by_bisection(spark, monkeypatch):
    rnd = random.Random(3)
    sets = {"a": [rnd.gauss(0, 1) for _ in range(5001)], "b": [float(rnd.randrange(3)) for _ in range(4000)], "c": [7.0] * 999, "d": [1.0], "e": [1.0, 2.0], "f": [rnd.lognormvariate(0, 9) for _ in range(3000)], "g": [-1e300, 0.0, 1e300, 5e-324]}
    long = spark.createDataFrame([(m, v) for m, vs in sets.items() for v in vs] + [("a", None), ("none", None)], "metric string, v double")
    want = {m: (len(vs), float(np.median(vs))) for m, vs in sets.items()}
    assert qc.exact_medians(long) == want
    some = long.filter("metric in ('a', 'b', 'c', 'e')")
    assert qc.exact_medians(some, 2) == {m: want[m] for m in "abce"}
    wide = spark.createDataFrame([(float(i), 2.0, None) for i in range(9)], "x double, y double, z double")
    got = {r.metric: tuple(r)[1:] for r in qc.robust_thresholds(wide, ["x", "y", "z"]).collect()}
    assert got == {"x": (9, 4.0, 2.0, 11.0), "y": (9, 2.0, 0.0, 2.0)}
    assert qc.robust_thresholds(wide.limit(3), ["x"]).first().threshold is None
    assert qc.robust_thresholds(wide.limit(0), ["x"]).collect() == []


def dense_loglik(x, y, g, theta):
    v = np.eye(len(y)) + theta * (g[:, None] == g[None, :])
    inv = np.linalg.inv(v)
    beta = np.linalg.solve(x.T @ inv @ x, x.T @ inv @ y)
    r = y - x @ beta
    s2 = r @ inv @ r / len(y)
    return -0.5 * (len(y) * np.log(2 * np.pi * s2) + len(y) + np.linalg.slogdet(v)[1]), beta, s2


def test_sums_of_many_outcomes_in_one_pass(spark):
    """Each outcome with its own gaps; groups of one row to a third of all; against dense likelihoods."""
    rnd = np.random.default_rng(6)
    g = np.r_[np.repeat(np.arange(12), rnd.integers(1, 6, 12)), np.full(20, 99), np.arange(100, 106)]  # few rows: dense matrices stay small
    x = rnd.normal(size=len(g))
    y = np.stack([1 + 2 * x + rnd.normal(size=200)[g] * s + rnd.normal(size=len(g)) for s in (0.0, 0.5, 4.0)])
    y[rnd.random(y.shape) < 0.2] = np.nan
    rows = [(f"p{a}", float(b), *[None if np.isnan(v) else float(v) for v in c]) for a, b, c in zip(g, x, y.T, strict=True)]
    df = spark.createDataFrame([*rows, (None, 1.0, 1.0, 1.0, 1.0), ("p1", None, 1.0, 1.0, 1.0)], "participant_id string, x double, y0 double, y1 double, y2 double")
    cols = models.design(df, models.parse_terms(["x"]))
    sums = models.sums_of(df, cols, ["y0", "y1", "y2"], "participant_id")
    for j in range(3):
        ok = ~np.isnan(y[j])
        d = np.column_stack([np.ones(ok.sum()), x[ok]])
        s = sums[f"y{j}"]
        w = np.column_stack([d, y[j][ok]])
        assert s.n == ok.sum() and np.allclose(s.gram, w.T @ w) and s.groups == len(set(g[ok]))
        for theta in (1e-4, 0.3, 0.3001, 7.77, 1e5):
            want = sum(theta / (1 + len(r) * theta) * np.outer(r.sum(0), r.sum(0)) for r in (w[g[ok] == k] for k in set(g[ok])))
            within, logdet = s.at(theta)
            assert np.abs(within - want).max() < 1e-9 * np.abs(want).max()
            assert logdet == pytest.approx(sum(np.log1p(theta * (g[ok] == k).sum()) for k in set(g[ok])), rel=1e-9)
        fit = models.lmm_from(s, [c for c, _ in cols])
        ratio = fit.group_variance / fit.residual_variance
        ll, beta, s2 = dense_loglik(d, y[j][ok], g[ok], ratio)
        assert fit.loglik == pytest.approx(ll, rel=1e-9) and np.allclose(fit.beta, beta, rtol=1e-7) and fit.residual_variance == pytest.approx(s2, rel=1e-7)
        assert all(dense_loglik(d, y[j][ok], g[ok], ratio * f)[0] <= ll + 1e-9 for f in (0.5, 0.99, 1.01, 2))


@pytest.mark.parametrize("most", [100_000, 0])
def test_logit_from_patterns(spark, monkeypatch, most):
    """By the collected patterns and by jobs over them: the score is zero."""
    monkeypatch.setattr(models, "PATTERNS", most)
    rnd = np.random.default_rng(2)
    x, f = rnd.integers(0, 5, 400).astype(float), rnd.integers(0, 3, 400)
    y = rnd.random(400) < 1 / (1 + np.exp(-(0.4 * x - 1 + 0.5 * (f == 1))))
    df = spark.createDataFrame([(float(a), f"f{b}", bool(c)) for a, b, c in zip(x, f, y, strict=True)], "x double, f string, y boolean")
    cols = models.design(df, models.parse_terms(["C(f)", "x"]))
    assert models.patterns(df, "y", cols).count() == len(set(zip(x, f, strict=True)))
    fit = models.fit_logit(df, "y", cols)
    d = np.column_stack([np.ones(400), f == 1, f == 2, x]).astype(float)
    p = 1 / (1 + np.exp(-d @ fit.beta))
    assert np.abs(d.T @ (y - p)).max() < 1e-7 and fit.n == 400
    assert np.allclose(fit.se, np.sqrt(np.diag(np.linalg.inv((d * (p * (1 - p))[:, None]).T @ d))))
    assert models.fit_logit(df.withColumn("y", F.col("x") > 2), "y", models.design(df, models.parse_terms(["x"]))) is None
    assert models.fit_logit(df.filter("y"), "y", cols) is None


def test_band_power_by_windows(spark):
    """Segments of one and of many windows, odd lengths, gaps in the samples, two channels; against the whole signal."""
    rng, fs = np.random.default_rng(1), 20.0
    rows, want = [], {}
    for seg, n in (("a", 400), ("b", 40), ("c", 41), ("d", 25), ("e", 19), ("f", 397)):
        x = rng.normal(size=(n, 2))
        x[rng.random(n) < 0.1] = np.nan
        rows += [(seg, "F", f"c{c}", i, float(x[i, c])) for i in range(n) for c in range(2)]
        mean = x.mean(axis=1)
        mean = mean[np.isfinite(mean)]
        if len(mean) >= 20:
            f, p = signal.welch_psd(mean, fs)
            want[seg] = {b: float(np.trapezoid(p[(f >= lo) & (f <= hi)], f[(f >= lo) & (f <= hi)])) for b, (lo, hi) in signal.BANDS.items() if ((f >= lo) & (f <= hi)).sum() > 1}
    df = spark.createDataFrame(rows, "segment string, roi string, channel string, sample_ix long, uV double")
    got = {r.segment: r for r in signal.band_power(df, fs).collect()}
    assert set(got) == set("abcdef") and got["e"].theta is None and "a" in want
    for seg, bands in want.items():
        assert all(got[seg][b] == pytest.approx(v) for b, v in bands.items())
    table = {r.segment: r for r in signal.segment_table(df, fs).collect()}
    assert table["a"].F_theta == pytest.approx(got["a"].theta) and table["a"].F_TAR == pytest.approx(got["a"].TAR) and table["a"].nan_fraction > 0
    assert table["a"].hf_ratio_20_40Hz is None and not table["a"].eeg_legacy_hf_flag
