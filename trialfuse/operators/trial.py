"""Trial index, joins of modalities and the analysis master."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import coding as C
from ..sources.scratch import written
from .gaze import KEYS, small

DIMENSION_ROWS = 200_000
# Column names of the design, of participants and of paths, in their order.
DESIGN = ("condition_id", "WWR", "WWR_numeric", "Cond", "Complexity", "block", "position", "round", "participant_order", "order_scheme", "order_code")
PARTICIPANT = ("participant_id", "eeg_subject_id", "eye_subject_id", "ExperienceRaw", "Experience", "ExperienceGroup", "SportFreq", "GenderRaw", "Gender", "Age", "RecruitmentBatch", "SupplementFlag", "exclude", "ExcludeReason")
PATHS = ("eye_csv_path", "aoi_json_path")
CORE = tuple(dict.fromkeys((*KEYS, *DESIGN, *PARTICIPANT, *PATHS)))
# Names under which sources give durations, start and end times and the missing mark, in the order in which they are tried.
DURATIONS = ("eeg_view_dur_s", "view_dur_s", "view_duration_s", "dur_s", "duration_s")
INTERVALS = (("view_start_s", "view_end_s"), ("start_s", "end_s"))
DERIVED_DURATIONS = ("duration_s", "dur_s", "view_duration_s", "eeg_view_dur_s")
DELTAS = (("O_alpha_gray", "O_alpha_view"), ("gray_O_alpha", "view_O_alpha"), ("gray_O_alpha", "O_alpha"))
MISSING_MARKS = ("subject_id", "view_dur_s", "dur_s", "duration_s", "O_theta", "F_theta")


def active_rows(df: DataFrame, flag: str = "exclude") -> DataFrame:
    return df.filter(~C.truthy(flag)) if flag in df.columns else df


def standardize_participants(df: DataFrame, low: tuple[str, ...] = C.LOW_EXPERIENCE, high: tuple[str, ...] = C.HIGH_EXPERIENCE) -> DataFrame:
    """Columns that are missing, by columns and not by rows: experience coded, batch Original, the supplement flag from the batch. Gender coded, age numeric."""
    have = lambda *cs: next((F.col(c) for c in cs if c in df.columns), None)
    text = lambda c: F.lit("") if c is None else c.cast("string")
    raw = text(have("ExperienceRaw", "Experience"))
    batch = F.lit("Original") if have("RecruitmentBatch") is None else F.col("RecruitmentBatch")
    gender = text(have("Gender"))
    given = have("GenderRaw")
    gender_raw = gender if given is None else F.when(F.coalesce(F.lower(F.trim(given.cast("string"))), F.lit("")).isin("", "nan", "none"), gender).otherwise(given)
    return df.withColumns(
        {
            "participant_id": C.text_key("participant_id"),
            "exclude": C.truthy(F.lit(False) if have("exclude") is None else F.col("exclude")),
            "ExperienceRaw": raw,
            "ExperienceGroup": C.coded_by_patterns(raw, low, high) if have("ExperienceGroup") is None else F.col("ExperienceGroup"),
            "RecruitmentBatch": batch,
            "SupplementFlag": F.coalesce(F.lower(batch.cast("string")) == "supplement", F.lit(False)) if have("SupplementFlag") is None else C.truthy("SupplementFlag"),
            "GenderRaw": gender_raw,
            "Gender": C.gender(gender_raw),
            "Age": C.num(F.lit(None) if have("Age") is None else F.col("Age")),
        }
    )


def standardize_scenes(df: DataFrame, base: str = "") -> DataFrame:
    """A scene table: keys normalised and unique, WWR_numeric and condition_id where they are missing, null block, position and round, paths joined to base."""
    require_columns(df, KEYS, "scene manifest")
    out = df.withColumns({"participant_id": C.text_key("participant_id"), "scene_id": C.int_key("scene_id")})
    if "WWR" in df.columns and "WWR_numeric" not in df.columns:
        out = out.withColumn("WWR_numeric", C.first_number("WWR"))
    if "condition_id" not in df.columns and {"WWR", "Complexity"} <= set(df.columns):
        out = out.withColumn("condition_id", C.condition_id("Complexity", F.col("Cond") if "Cond" in df.columns else F.lit(None), "WWR"))
    out = out.withColumns({c: F.lit(None).cast("long") for c in ("block", "position", "round") if c not in df.columns})
    for c in PATHS:
        if c in df.columns:
            p = F.coalesce(F.trim(F.col(c).cast("string")), F.lit(""))
            whole = (p == "") | p.rlike(r"^(/|[A-Za-z][A-Za-z0-9+.-]*:)")
            out = out.withColumn(c, F.when(whole | F.lit(not base), p).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), p)))
    return require_unique(out, what="scene manifest")


def manifest_scenes(df: DataFrame) -> DataFrame:
    """An older manifest: keys normalised and unique, and a numeric eye_offset_ms, 0 by default."""
    offset = C.num("eye_offset_ms") if "eye_offset_ms" in df.columns else F.lit(None).cast("double")
    out = require_columns(df, KEYS, "scene manifest").withColumns({"participant_id": C.text_key("participant_id"), "scene_id": C.int_key("scene_id"), "eye_offset_ms": F.coalesce(offset, F.lit(0.0))})
    return require_unique(out, what="scene manifest")


def manifest_participants(df: DataFrame) -> DataFrame:
    """Older participants: three id columns, trimmed, and exclude as a boolean."""
    ids = ("participant_id", "eeg_subject_id", "eye_subject_id")
    out = require_columns(df, ids, "participants").withColumns({c: C.text_key(c) for c in ids})
    return out.withColumn("exclude", C.truthy("exclude") if "exclude" in df.columns else F.lit(False))


def eye_classes(df: DataFrame) -> DataFrame:
    """Older class metrics, unique by participant, scene and class."""
    keys = (*KEYS, "class_name")
    out = require_columns(df, keys, "eye classes").withColumns({"participant_id": C.text_key("participant_id"), "scene_id": C.int_key("scene_id")})
    return require_unique(out, keys, "eye classes")


def standardize_answers(df: DataFrame, items: Sequence[str]) -> DataFrame:
    """A long questionnaire: keys normalised and unique, items numeric where they exist."""
    out = require_columns(df, KEYS, "questionnaire").withColumns({"participant_id": C.text_key("participant_id"), "scene_id": C.int_key("scene_id"), **{c: C.num(c) for c in items if c in df.columns}})
    return require_unique(out, what="questionnaire")


def attach_design(answers: DataFrame, scenes: DataFrame, participants: DataFrame) -> DataFrame:
    """Answers with design columns by both keys and participant columns by the participant; answers without either stay."""
    design = [c for c in ("WWR", "WWR_numeric", "Complexity", "Cond", "block", "position", "round", "condition_id") if c in scenes.columns and c not in answers.columns]
    person = [c for c in ("ExperienceGroup", "ExperienceRaw", "Experience", "SportFreqGroup", "Gender", "Age", "RecruitmentBatch", "SupplementFlag") if c in participants.columns and c not in answers.columns]
    out = answers.join(scenes.select(*KEYS, *design), list(KEYS), "left")
    who = keep_first(participants.select("participant_id", *person), ["participant_id"], [F.xxhash64(*person)] if person else ["participant_id"])
    return out.join(small(who, DIMENSION_ROWS), "participant_id", "left")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key, in a stated order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def duplicate_keys(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Keys with more than one row, and how many."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def require_unique(df: DataFrame, keys: Sequence[str] = KEYS, what: str = "table") -> DataFrame:
    found = duplicate_keys(df, keys).limit(10).collect()
    if found:
        raise ValueError(f"{what}: duplicate keys, such as {[tuple(r)[:-1] for r in found]}")
    return df


def require_columns(df: DataFrame, columns: Sequence[str], what: str = "table") -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what}: missing columns {missing}")
    return df


def trial_index(scenes: DataFrame, participants: DataFrame) -> DataFrame:
    """Scenes of active participants with participant columns."""
    who = keep_first(active_rows(participants), ["participant_id"], [F.xxhash64(*participants.columns)])
    rest = [c for c in who.columns if c != "participant_id" and c not in scenes.columns]
    return scenes.join(small(who.select("participant_id", *rest), DIMENSION_ROWS), "participant_id")


def map_subjects(df: DataFrame, participants: DataFrame, subject: str = "subject_id", to: str = "eeg_subject_id") -> tuple[DataFrame, DataFrame]:
    """(rows with participant_id, rows whose subject is unknown)."""
    ids = participants.select(C.text_key(to).alias("_s"), C.text_key("participant_id").alias("participant_id")).filter("_s is not null and _s <> ''").dropDuplicates(["_s"])
    known = df.drop("participant_id").join(small(ids, DIMENSION_ROWS), C.text_key(subject) == F.col("_s")).drop("_s")
    return known, df.join(small(ids, DIMENSION_ROWS), C.text_key(subject) == F.col("_s"), "left_anti")


def prefixed(df: DataFrame, prefix: str, core: Sequence[str] = (*KEYS, *DESIGN)) -> DataFrame:
    return df.withColumnsRenamed({c: f"{prefix}{c}" for c in df.columns if c not in core and not c.startswith(prefix)})


def coalesce_design(df: DataFrame, design: Sequence[str] = DESIGN) -> DataFrame:
    """Each design column filled from the columns that end with its name or start with q_, eeg_ or eye_ and its name, in column order; these stay."""
    for d in design:
        found = [c for c in df.columns if c != d and (c.endswith(f"_{d}") or c.startswith((f"q_{d}", f"eeg_{d}", f"eye_{d}")))]
        if found:
            df = df.withColumn(d, F.coalesce(*([d] if d in df.columns else []), *found))
    return df


def ordered_columns(df: DataFrame, core: Sequence[str] = CORE) -> DataFrame:
    return df.select(*[c for c in core if c in df.columns], *[c for c in df.columns if c not in core])


def eeg_duration(columns: Sequence[str]) -> Column:
    """By columns, not rows: the first duration column that exists, else the first interval, else null."""
    for c in DURATIONS:
        if c in columns:
            return C.num(c)
    for a, b in INTERVALS:
        if a in columns and b in columns:
            return C.num(b) - C.num(a)
    return F.lit(None).cast("double")


def aligned_scenes(trials: DataFrame, eye: DataFrame, eeg: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """All trials with eye and EEG columns; missing_eeg_scene by the first marker column that there is."""
    out = trials.join(eye, list(keys), "left").join(eeg, list(keys), "left")
    mark = next((c for c in MISSING_MARKS if c in out.columns), None)
    return out.withColumn("missing_eeg_scene", F.col(mark).isNull() if mark else F.lit(True))


def analysis_master(trials: DataFrame, questionnaire: DataFrame, eeg: DataFrame, eye: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Trials with answers (q_), EEG (eeg_) and eye metrics; a row for each AOI of a trial. One partitioning serves all three joins."""
    core = [*keys, *[c for c in trials.columns if c not in keys]]
    out = trials
    for df, prefix in ((questionnaire, "q_"), (eeg, "eeg_"), (eye, "")):
        named = prefixed(df, prefix, keys) if prefix else df
        clash = [c for c in named.columns if c in core and c not in keys]
        out = out.join(named.drop(*clash), list(keys), "left")
    return out


def presence(sources: dict[str, DataFrame], id_col: str = "participant_id") -> DataFrame:
    """Ids of any source with has_<source> flags and the reasons, ';'-joined, for what is missing."""
    out = None
    for name, df in sources.items():
        ids = df.select(C.text_key(id_col).alias(id_col)).filter(F.col(id_col).isNotNull()).distinct().withColumn(f"has_{name}", F.lit(True))
        out = ids if out is None else out.join(ids, id_col, "full_outer")
    flags = {f"has_{n}": F.coalesce(f"has_{n}", F.lit(False)) for n in sources}
    out = out.withColumns(flags)
    why = F.concat_ws(";", *[F.when(~F.col(f"has_{n}"), F.lit(f"missing_{n}")) for n in sources])
    return out.withColumns({"complete": F.forall(F.array(*[F.col(f) for f in flags]), lambda x: x), "reasons": why})


def scene_fallback(tables: Sequence[DataFrame], keys: Sequence[str] = KEYS, design: Sequence[str] = DESIGN) -> DataFrame:
    """A scene table from the modality tables, where there is no manifest: the first table wins."""
    parts = [t.select(*keys, *[c for c in design if c in t.columns]).withColumn("_rank", F.lit(i)) for i, t in enumerate(tables)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    rest = [c for c in out.columns if c not in (*keys, "_rank")]
    return keep_first(out, keys, ["_rank", *[F.asc_nulls_last(c) for c in rest]]).drop("_rank")


# Names that devices give to subjects.
GENERIC_SUBJECTS = ("user", "user1", "user2", "test", "pilot", "practice")


def alias_chains(manual: DataFrame) -> DataFrame:
    """(_at, _alias, _end): where each rule leads once the rules behind it have acted on its result.

    A rule's successor is the first later one whose alias is its name; pointers are doubled until all are at
    an end, so a chain of n rules takes log n rounds.
    """
    at = F.col("row") if "row" in manual.columns else F.monotonically_increasing_id()
    rules = manual.select(at.cast("double").alias("_row"), F.trim("alias").alias("_alias"), F.trim("participant_id").alias("_end")).filter("_alias <> '' and _end <> ''")
    rules = written(rules.select(F.struct("_row", "_alias", F.col("_end").alias("_name")).alias("_at"), "_alias", "_end").distinct(), "aliases")
    both = rules.select(F.col("_alias").alias("_k"), "_at", F.lit(True).alias("_rule"), "_end").unionByName(rules.select(F.col("_end").alias("_k"), "_at", F.lit(False).alias("_rule"), "_end"))
    later = Window.partitionBy("_k").orderBy(F.desc("_at"), "_rule").rowsBetween(Window.unboundedPreceding, -1)
    follow = both.withColumn("_next", F.last(F.when(F.col("_rule"), F.col("_at")), ignorenulls=True).over(later)).filter("not _rule").select("_at", "_next")
    # a rule of a name to itself stands before itself in the window
    now = written(rules.join(follow, "_at"), "aliases")
    while not now.filter("_next is not null").isEmpty():
        then = now.select(F.col("_at").alias("_next"), F.col("_next").alias("_after"), F.col("_end").alias("_far"))
        now = written(now.join(then, "_next", "left").select("_at", "_alias", F.coalesce("_far", "_end").alias("_end"), F.col("_after").alias("_next")), "aliases")
    return now.drop("_next")


def resolve_aliases(rows: DataFrame, manual: DataFrame | None = None, record: str = "record_id", subject: str = "subject") -> DataFrame:
    """subject -> participant_id. A suffix note is cut; a generic name takes the one proper name of its record; a manual alias wins over both.

    alias_source: empty, suffix_note, record_id or manual. manual: (alias, participant_id) and,
    where it has one, a number `row` (else the order of the files counts; equal rows go by alias and name).
    Rules act one after another: each on rows whose raw subject is its alias and on rows that the rules
    before it have given that name. Every alias of the raw subject acts in the end, so the last of them
    starts a chain; else the first rule of the present name does. Chains only go forward, so circles end.
    """
    bare = C.without_note(subject)
    name = F.lower(F.trim(F.col("_base")))
    rows = rows.withColumn("_base", bare).withColumn("_generic", name.isin(*GENERIC_SUBJECTS) | name.rlike(r"^user\d+$"))
    one = rows.filter(F.col(record).isNotNull()).groupBy(record).agg(F.count_distinct(F.when(~F.col("_generic"), F.col("_base"))).alias("_named"), F.min(F.when(~F.col("_generic"), F.col("_base"))).alias("_name"), F.count_if("_generic").alias("_any"))
    out = rows.join(one.filter("_named = 1 and _any > 0").select(record, "_name"), record, "left")
    taken = F.col("_generic") & F.col("_name").isNotNull()
    out = out.withColumns({"_now": F.when(taken, F.col("_name")).otherwise(F.col("_base")), "_raw": F.trim(F.col(subject).cast("string"))})
    if manual is not None:
        rules = alias_chains(manual)
        first, last = rules.groupBy("_alias").agg(F.min_by("_end", "_at").alias("_m2")), rules.groupBy("_alias").agg(F.max_by("_end", "_at").alias("_m1"))
        out = out.join(last.withColumnRenamed("_alias", "_raw"), "_raw", "left").join(first.withColumnRenamed("_alias", "_now"), "_now", "left")
        out = out.withColumn("_manual", F.coalesce("_m1", "_m2")).drop("_m1", "_m2")
    else:
        out = out.withColumn("_manual", F.lit(None).cast("string"))
    pid = F.coalesce("_manual", "_now")
    source = F.when(F.col("_manual").isNotNull(), "manual").when(taken, "record_id").when(F.col("_base") != F.col("_raw"), "suffix_note").otherwise("")
    return out.withColumns({"participant_id": pid, "alias_source": source}).drop("_base", "_generic", "_name", "_manual", "_now", "_raw")


def eeg_duration_table(eeg: DataFrame) -> DataFrame:
    return eeg.select(*KEYS, eeg_duration(eeg.columns).alias("eeg_view_dur_s"))


def eeg_derived(df: DataFrame) -> DataFrame:
    """view_dur_s where the column is missing, and delta_O_alpha = gray - view by the first naming scheme whose columns exist."""
    own = next((c for c in DERIVED_DURATIONS if c in df.columns), None)
    out = df.withColumn("view_dur_s", C.num(own)) if own and "view_dur_s" not in df.columns else df
    pair = next(((g, v) for g, v in DELTAS if g in df.columns and v in df.columns), None)
    return out.withColumn("delta_O_alpha", C.num(pair[0]) - C.num(pair[1])) if pair else out


def trial_base(df: DataFrame, keys: Sequence[str] = KEYS, design: Sequence[str] = DESIGN) -> DataFrame:
    """Keys and the design columns that exist."""
    return df.select(*keys, *[c for c in design if c in df.columns])


def eye_timing(trials: DataFrame, gaze: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Start, end, duration (s) and samples of each trial; missing_eye where it has none, missing_time where no sample has a time."""
    t = gaze.groupBy(*keys).agg(F.min("t_ms").alias("eye_start_ms"), F.max("t_ms").alias("eye_end_ms"), F.count(F.lit(1)).alias("n_samples"), F.count("t_ms").alias("_timed"))
    out = trials.select(*keys).join(t, list(keys), "left")
    span = F.when(F.col("_timed") > 1, (F.col("eye_end_ms") - F.col("eye_start_ms")) / 1000.0)
    return out.withColumns({"eye_duration_s": span, "missing_eye": F.col("n_samples").isNull(), "missing_time": F.coalesce(F.col("_timed") == 0, F.lit(True)), "n_samples": F.coalesce("n_samples", F.lit(0))}).drop("_timed")
