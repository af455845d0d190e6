"""What a job reads and holds, whatever the size of its tables."""

import re

import numpy as np
from trialfuse.operators import models


def _rows(spark, n=240):
    rng = np.random.default_rng(5)
    rows = [(f"P{i % 17}", int(rng.choice([15, 45, 75])) if i % 11 else None, f"c{rng.integers(3)}", f"e{rng.integers(2)}", f"g{rng.integers(2)}", float(rng.integers(1, 7)), float(rng.normal()) if i % 7 else None, float(rng.normal())) for i in range(n)]
    return spark.createDataFrame(rows, "participant_id string, WWR int, Complexity string, ExperienceGroup string, Gender string, position double, y double, z double")


def _counted(df, seen):
    """df, with its rows added to an accumulator whenever they are made."""

    def through(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return df.mapInArrow(through, df.schema)


def test_models_make_their_rows_once(spark):
    df = _rows(spark).localCheckpoint()
    for fit in (models.trial_index_models, models.eeg_core_models):
        seen = spark.sparkContext.accumulator(0)
        got = fit(_counted(df, seen), ["y"])
        assert seen.value == df.count()
        assert got.count() > 12


def test_sums_from_codes_equal_those_of_the_columns(spark):
    df = _rows(spark)
    cols = models.design(df, models.parse_terms(["C(WWR)*C(Complexity)*C(ExperienceGroup)", "position", "C(Complexity):position"]))
    assert len(cols) > 15 and len(cols.raw) == 4
    names = [n for n, _ in cols]
    rows = df.select("participant_id", *[c.alias(f"x{i}") for i, (_, c) in enumerate(cols)], "y", "z").dropna(subset=[f"x{i}" for i in range(len(cols))]).toPandas()
    for group in (None, "participant_id"):
        for how in (cols, list(cols)):
            sums = models.sums_of(df, how, ["y", "z"], group)
            for y in ("y", "z"):
                own = rows.dropna(subset=[y])
                w = own[[*[f"x{i}" for i in range(len(names))], y]].to_numpy(float)
                assert sums[y].n == len(own)
                np.testing.assert_allclose(sums[y].gram, w.T @ w, atol=1e-9)
                if group:
                    within, logdet = sums[y].at(0.7)
                    parts = [(len(g), w[g].sum(axis=0)) for g in (np.flatnonzero((own.participant_id == p).to_numpy()) for p in own.participant_id.unique())]
                    assert (sums[y].groups, sums[y].largest) == (len(parts), max(m for m, _ in parts))
                    np.testing.assert_allclose(within, sum(0.7 / (1 + m * 0.7) * np.outer(s, s) for m, s in parts), atol=1e-8)
                    assert abs(logdet - sum(np.log1p(m * 0.7) for m, _ in parts)) < 1e-8


def test_sums_of_groups_leave_in_parts(spark, monkeypatch):
    """A group's sums that a task sends several times are added up again."""
    df = _rows(spark).coalesce(1)
    cols = models.design(df, models.parse_terms(["position"]))
    whole = models.sums_of(df, cols, ["z"], "participant_id")["z"]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    monkeypatch.setattr(models, "HELD_BYTES", 0)
    try:
        parts = models.sums_of(df, cols, ["z"], "participant_id")["z"]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert (parts.n, parts.groups, parts.largest) == (whole.n, whole.groups, whole.largest)
    np.testing.assert_allclose(parts.within, whole.within, atol=1e-8)


def test_descriptives_keep_no_row_for_each_answer_of_a_person(spark):
    """Groups with nulls in the key, in the person and in the answers; constant answers have no skewness."""
    from trialfuse.operators import scales

    rng = np.random.default_rng(9)
    rows = [(f"P{i % 9}" if i % 13 else None, ("a", "b", None)[i % 3], float(rng.integers(0, 6)) if i % 5 else None, 0.1 if i % 3 else 0.7, float(rng.normal())) for i in range(300)]
    df = spark.createDataFrame(rows, "participant_id string, g string, x double, flat double, z double")
    got = scales.descriptives(df, ["x", "flat", "z"], ["g"], ci=False)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    groups = re.findall(r"Aggregate \[([^\]]*)\]", plan)
    assert groups and not [g for g in groups if re.search(r"participant_id|_who", g) and re.search(r"\bv#", g)]
    own = df.toPandas()
    for r in got.collect():
        v = own[own.g.isna() if r.g is None else own.g == r.g].dropna(subset=[r.item])
        m = v[r.item] - v[r.item].mean()
        assert (r.n_obs, r.n_subjects) == (len(v), v.participant_id.nunique())
        np.testing.assert_allclose([r["mean"], r.sd, r.median, r.min, r.max], [v[r.item].mean(), v[r.item].std(ddof=1), v[r.item].median(), v[r.item].min(), v[r.item].max()], atol=1e-9)
        if r.item == "flat" and v.flat.nunique() == 1:
            assert r.skew is None and r.kurtosis is None and r.jarque_bera_p is None
        else:
            np.testing.assert_allclose([r.skew, r.kurtosis], [v[r.item].skew(), v[r.item].kurt()], atol=1e-9)
    assert got.count() == 9


def test_batch_cuts_files_by_blocks(spark):
    """No window over samples holds a whole file's segments."""
    from trialfuse.plans import queries

    plan = queries.batch_from_files(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    windows = re.findall(r"windowspecdefinition\(([^()]*\bseq#\d+L? ASC[^()]*)", plan)
    assert windows and all("_block" in w for w in windows)


def test_answers_are_dealt_out_by_their_number(spark, monkeypatch):
    """As many partitions as the rows need, whatever the session has; the same rows."""
    from trialfuse.plans import standins

    d = "/root/testdata/sf0.001"
    few = standins.answers(spark, d)
    monkeypatch.setattr(standins, "ANSWERS_A_TASK", 200)
    many = standins.answers(spark, d)
    assert many.rdd.getNumPartitions() == -(-standins.table(spark, d, "lineitem").count() // 200)
    assert many.exceptAll(few).count() == 0 == few.exceptAll(many).count()
