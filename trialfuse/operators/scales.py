"""Questionnaire reshaping, composites, reliability, descriptives and contrasts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import coding as C
from ..functions import dist

# The three levels of the ordered factor and their contrast weights.
LEVELS = (15, 45, 75)
LINEAR, QUADRATIC = (-1, 0, 1), (1, -2, 1)
# Names of items in wide tables, and the labels of quality rows, of alpha and of contrasts.
WIDE_ITEMS = r"S[1-5]|B[1-3]|IPQ[1-6]|IPQ"
WIDE_NAMES = (rf"(?i)^(?P<item>{WIDE_ITEMS})[_\-. ]?(?:scene)?(?P<scene>\d{{1,2}})$", rf"(?i)^(?:scene)?(?P<scene>\d{{1,2}})[_\-. ]?(?P<item>{WIDE_ITEMS})$")
WITHIN, NINE_POINT, OUTSIDE = "within_1_7_expected_range", "S5_detected_9_point_scale_S5_7_created", "outside_1_7_expected_range_review_required"
B_OUTSIDE_C1 = "c0_row_has_b_values_review_required"
ALPHA = {"insufficient": None, "acceptable_diagnostic": 0.70, "check_before_composite": 0.60, "low_do_not_force_composite": None}
DIRECTIONS = {
    "Linear": ("linear_increase_15_to_75", "linear_decrease_15_to_75", "linear_flat"),
    "Quadratic": ("u_shape_45_lowest", "inverted_u_45_highest", "quadratic_flat"),
}


def wide_to_long(df: DataFrame, who: str = "participant_id") -> DataFrame:
    """S1_3 and scene3_S1 columns to one row per participant and scene, one column per item."""
    import re

    found: dict[tuple[str, int], str] = {}
    for c in df.columns:
        for pattern in WIDE_NAMES:
            m = re.match(pattern, c)
            if m:
                found.setdefault((m["item"].upper(), int(m["scene"])), c)
                break
    items = sorted({i for i, _ in found})
    scenes = sorted({s for _, s in found})
    null = F.lit(None).cast("double")
    row = lambda s: F.struct(F.lit(s).cast("long").alias("scene_id"), *[(C.num(f"`{found[i, s]}`") if (i, s) in found else null).alias(i) for i in items])
    rows = F.explode(F.array(*[row(s) for s in scenes])).alias("r")
    return df.select(C.text_key(who).alias(who), rows).select(who, "r.*")


def survey_to_long(df: DataFrame, who: str = "participant_id", presence: int = 16) -> DataFrame:
    """Q<q>.<k>_<item> columns: questions 2-7 are scenes 1-6, 9-14 scenes 7-12, 8 and 15 the extra items of scenes 6 and 12; `presence` questions belong to the participant."""
    import re

    place = {**{q: q - 1 for q in range(2, 8)}, **{q: q - 2 for q in range(9, 15)}, 8: 6, 15: 12}
    cells: dict[tuple[int, str], str] = {}
    ipq: dict[str, str] = {}
    for c in df.columns:
        m = re.match(r"^Q(\d+)\.(\d+)_(\w*)", c)
        if m and int(m[1]) in place and m[3]:
            cells[place[int(m[1])], m[3]] = c
        elif m and int(m[1]) == presence:
            ipq[f"IPQ{int(m[2])}"] = c
    items = sorted({i for _, i in cells})
    null = F.lit(None).cast("double")
    number = lambda c: C.first_number(F.col(f"`{c}`"), signed=True)
    rows = [F.struct(F.lit(s).cast("long").alias("scene_id"), *[(number(cells[s, i]) if (s, i) in cells else null).alias(i) for i in items]) for s in sorted({s for s, _ in cells})]
    return df.select(C.text_key(who).alias(who), *[number(c).alias(n) for n, c in sorted(ipq.items())], F.explode(F.array(*rows)).alias("r")).select(who, "r.*", *sorted(ipq))


def row_mean(columns: Sequence[str], least: int) -> Column:
    values = F.array_compact(F.array(*[C.num(c) for c in columns]))
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(values) >= least, total / F.size(values))


def composites(df: DataFrame, afford: Sequence[str] = ("S1", "S2", "S3", "S4"), least: int = 3, b_items: Sequence[str] = ("B1", "B2", "B3"), ipq: Sequence[str] = (), nine_point: str = "S5", who: str = "participant_id") -> DataFrame:
    """Afford4, Bmean, S5_7 (S5 rescaled, if the whole column's maximum is in (7, 9]; else null) and IPQ_mean (mean of a participant's item means)."""
    add = {"Afford4": row_mean([c for c in afford if c in df.columns], least)}
    if [c for c in b_items if c in df.columns]:
        add["Bmean"] = row_mean([c for c in b_items if c in df.columns], 1)
    out = df.withColumns(add)
    if nine_point in df.columns:
        top = df.agg(F.max(C.num(nine_point)).alias("_top"))  # one row
        v = C.num(nine_point)
        out = out.crossJoin(F.broadcast(top)).withColumn(f"{nine_point}_7", F.when((F.col("_top") > 7) & (F.col("_top") <= 9), 1 + (v - 1) * 6 / 8)).drop("_top")
    if ipq:
        means = df.groupBy(who).agg(*[F.avg(C.num(c)).alias(c) for c in ipq]).select(who, row_mean(ipq, 1).alias("IPQ_mean"))
        out = out.join(means, who, "left")
    return out


def item_qc(df: DataFrame, items: Sequence[str]) -> DataFrame:
    long = df.select(*[C.num(i).alias(i) for i in items]).unpivot([], list(items), "item", "v")
    return long.groupBy("item").agg(F.count("v").alias("n"), F.count_if(F.col("v").isNull()).alias("missing"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), F.min("v").alias("min"), F.max("v").alias("max"))


def scale_range_qc(df: DataFrame, items: Sequence[str], nine_point: str = "S5") -> DataFrame:
    q = item_qc(df, items).select("item", "min", "max")
    nine = (F.col("item") == nine_point) & (F.col("max") > 7) & (F.col("max") <= 9)
    return q.withColumn("status", F.when(nine, NINE_POINT).when((F.col("min") < 1) | (F.col("max") > 7), OUTSIDE).otherwise(WITHIN))


def c1_only_qc(df: DataFrame, b_items: Sequence[str], c1: Column, keys: Sequence[str] = ("participant_id", "scene_id")) -> DataFrame:
    """Rows outside C1 that have a B value; one pass row if none."""
    bad = df.filter(~F.coalesce(c1, F.lit(True)) & F.coalesce(*[C.num(b) for b in b_items]).isNotNull()).select(*[F.col(k).cast("string").alias(k) for k in keys], F.lit(B_OUTSIDE_C1).alias("status"))
    one = df.sparkSession.range(1).select(F.lit("pass").alias("_pass"))
    none = one.crossJoin(F.broadcast(bad.limit(1).agg(F.count(F.lit(1)).alias("n")))).filter("n = 0")  # one row each
    return bad.unionByName(none.select(*[F.lit(None).cast("string").alias(k) for k in keys], F.col("_pass").alias("status")))


def descriptives(df: DataFrame, items: Sequence[str], by: Sequence[str], who: str = "participant_id", ci: bool = True) -> DataFrame:
    """Per item and group (null groups kept): n_subjects, n_obs, mean, sd, median, min, max, bias-corrected skew and kurtosis, jarque_bera_p, and the t interval of the mean.

    jarque_bera_p takes the place of a rank-based normality test: its moments merge, so it has no upper limit of rows.
    Rows are reduced at once: to equal answers of a group with their counts, which give the moments and, ranked, the median; and to one
    row for each person and group, which says what items it answers.
    """
    key, at = ["item", *by], range(len(items))
    rows = df.select(F.col(who).alias("_who"), *by, *[C.num(i).alias(f"_v{j}") for j, i in enumerate(items)])
    long = rows.select(*by, F.explode(F.array(*[F.struct(F.lit(i).alias("item"), F.col(f"_v{j}").alias("v")) for j, i in enumerate(items)])).alias("_a")).select("_a.item", *by, "_a.v").filter("v is not null")
    cells = long.groupBy(*key, "v").agg(F.count(F.lit(1)).alias("_c"))
    whole = cells.groupBy(*key).agg(F.sum("_c").alias("n_obs"), (F.sum(F.col("v") * F.col("_c")) / F.sum("_c")).alias("_mean"), F.min("v").alias("min"), F.max("v").alias("max"), F.percentile("v", F.lit(0.5), F.col("_c")).alias("median"))
    whole = whole.withColumn("mean", F.when(F.col("min") < F.col("max"), F.col("_mean")).otherwise(F.col("min"))).drop("_mean")
    own = rows.groupBy("_who", *by).agg(*[F.count(f"_v{j}").alias(f"_n{j}") for j in at]).groupBy(*by).agg(*[F.count_if(F.col("_who").isNotNull() & (F.col(f"_n{j}") > 0)).alias(f"_n{j}") for j in at])
    people = own.select(*by, F.explode(F.array(*[F.struct(F.lit(i).alias("item"), F.col(f"_n{j}").alias("n_subjects")) for j, i in enumerate(items)])).alias("_a")).select("_a.item", *by, "_a.n_subjects")

    def meet(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
        b = b.withColumnsRenamed({c: f"_k{i}" for i, c in enumerate(key)})
        return a.join(b, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(key)], how).drop(*[f"_k{i}" for i in range(len(key))])

    off = F.col("v") - F.col("mean")
    powers = meet(cells, whole.select(*key, "mean")).groupBy(*key).agg(*[F.sum(F.col("_c") * F.pow(off, F.lit(float(i)))).alias(f"_m{i}") for i in (2, 3, 4)])
    d = meet(meet(whole, powers), people, "left").withColumn("n_subjects", F.coalesce("n_subjects", F.lit(0)))
    var = F.col("_m2") / F.col("n_obs")
    d = d.withColumns({"sd": F.sqrt(F.try_divide(F.col("_m2"), F.col("n_obs") - 1)), "_var": var, "_g1": F.try_divide(F.col("_m3") / F.col("n_obs"), F.pow(var, F.lit(1.5))), "_g2": F.try_divide(F.col("_m4") / F.col("n_obs"), var * var) - 3})
    d = d.select(*key, "n_subjects", "n_obs", "mean", "sd", "median", "min", "max", "_var", "_g1", "_g2")
    n = F.col("n_obs").cast("double")
    some = F.col("_var") > 0
    d = d.withColumns(
        {
            "skew": F.when(some & (n > 2), F.col("_g1") * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))),
            "kurtosis": F.when(some & (n > 3), F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * F.col("_g2") + 6)),
            "jarque_bera_p": F.when(some & (n > 2), dist.jarque_bera_p(n, F.col("_g1"), F.col("_g2"))),
        }
    ).drop("_var", "_g1", "_g2")
    if not ci:
        return d
    half = F.col("t_crit") * F.col("sd") / F.sqrt(n)
    return dist.with_t_quantile(d, "n_obs").withColumns({"ci_low": F.col("mean") - half, "ci_high": F.col("mean") + half}).drop("t_crit")


def subject_means(df: DataFrame, items: Sequence[str], who: str = "participant_id", first: Sequence[str] = (), order: str = "scene_id") -> DataFrame:
    """A participant's item means, with the first non-null value of `first` columns by `order`."""
    return df.groupBy(who).agg(*[F.avg(C.num(i)).alias(i) for i in items], *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in first])


def cronbach(df: DataFrame, items: Sequence[str], by: Sequence[str] = (), scale: str = "scale") -> DataFrame:
    """alpha over complete rows, and its status; null under three rows, two items or without variance."""
    k = len(items)
    full = df.select(*by, *[C.num(i).alias(i) for i in items]).dropna(subset=list(items))
    total = sum((F.col(i) for i in items), F.lit(0.0))
    d = full.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.var_samp(i).alias(f"_v{j}") for j, i in enumerate(items)], F.var_samp(total).alias("_total"))
    parts = sum((F.col(f"_v{j}") for j in range(k)), F.lit(0.0))
    alpha = F.when((F.col("n") >= 3) & (F.col("_total") > 0), (1 - parts / F.col("_total")) * k / (k - 1)) if k > 1 else F.lit(None).cast("double")
    status = F.when(alpha.isNull(), "insufficient").when(alpha >= ALPHA["acceptable_diagnostic"], "acceptable_diagnostic").when(alpha >= ALPHA["check_before_composite"], "check_before_composite").otherwise("low_do_not_force_composite")
    return d.select(*by, F.lit(scale).alias("scale"), F.lit(k).alias("n_items"), "n", alpha.alias("alpha"), status.alias("status"))


def reliability(df: DataFrame, scales: dict[str, Sequence[str]], c1: Column | None = None, c1_scales: Sequence[str] = (), subject_scales: Sequence[str] = (), who: str = "participant_id") -> DataFrame:
    out = None
    for name, items in scales.items():
        rows = df.filter(c1) if c1 is not None and name in c1_scales else df
        rows = subject_means(rows, items, who) if name in subject_scales else rows
        part = cronbach(rows, items, scale=name)
        out = part if out is None else out.unionByName(part)
    return out


def level_means(df: DataFrame, value: str, level: str, who: str, levels: Sequence = LEVELS, by: Sequence[str] = ()) -> DataFrame:
    """One row per participant with all levels: m0, m1, ..."""
    d = df.withColumn("_level", C.level_number(df, level)).filter(F.col(who).isNotNull()).groupBy(who, *by).agg(*[F.avg(F.when(F.col("_level") == x, C.num(value))).alias(f"m{i}") for i, x in enumerate(levels)])
    return d.dropna(subset=[f"m{i}" for i in range(len(levels))])


def poly_contrasts(df: DataFrame, values: Sequence[str], level: str, who: str = "participant_id", levels: Sequence = LEVELS, p_values: bool = True) -> DataFrame:
    """Linear and quadratic contrasts of participants' level means: mean, sd, se, t, F, p and partial eta squared."""
    # all outcomes in one aggregate of a participant's level means
    at = range(len(levels))
    wide = df.withColumn("_level", C.level_number(df, level)).filter(F.col(who).isNotNull()).groupBy(who).agg(*[F.avg(F.when(F.col("_level") == x, C.num(v))).alias(f"_{j}_{i}") for j, v in enumerate(values) for i, x in enumerate(levels)])
    own = F.explode(F.array(*[F.struct(F.lit(v).alias("outcome"), *[F.col(f"_{j}_{i}").alias(f"m{i}") for i in at]) for j, v in enumerate(values)])).alias("o")
    means = wide.select(own).select("o.*").dropna(subset=[f"m{i}" for i in at])
    score = lambda w: sum((F.col(f"m{i}") * x for i, x in enumerate(w) if x), F.lit(0.0))
    rows = F.explode(F.array(F.struct(F.lit("Linear").alias("term"), score(LINEAR).alias("s")), F.struct(F.lit("Quadratic").alias("term"), score(QUADRATIC).alias("s")))).alias("c")
    out = means.select("outcome", rows).groupBy(F.col("c.term").alias("term"), "outcome").agg(F.count(F.lit(1)).alias("n"), F.avg("c.s").alias("mean"), F.stddev_samp("c.s").alias("sd"))
    se = F.col("sd") / F.sqrt(F.col("n"))
    out = out.withColumn("se", se).withColumn("t", C.ratio(F.col("mean"), F.col("se"))).withColumn("F", F.col("t") * F.col("t"))
    out = out.withColumns({"df2": (F.col("n") - 1).cast("double"), "partial_eta_sq": C.ratio(F.col("F"), F.col("F") + F.col("n") - 1), "direction": reduce(lambda c, t: c.when(F.col("term") == t, F.when(F.col("mean") > 0, DIRECTIONS[t][0]).when(F.col("mean") < 0, DIRECTIONS[t][1]).otherwise(DIRECTIONS[t][2])), DIRECTIONS, F.when(F.col("mean").isNull(), ""))})
    if not p_values:
        return out.drop("df2")
    return dist.with_p_values(out.withColumn("_d1", F.lit(1.0)), "f", "F", "_d1", "df2").drop("_d1", "df2")


def welch_pairs(df: DataFrame, value: str, level: str, p_values: bool = True) -> DataFrame:
    """Each pair of levels (a < b): n, means, t, degrees of freedom, p. Levels are few: pairs of group rows, not of data rows."""
    g = df.select(F.col(level).alias("lv"), C.num(value).alias("v")).dropna().groupBy("lv").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("m"), F.var_samp("v").alias("var"))
    a, b = g.select(*[F.col(c).alias(f"{c}_a") for c in g.columns]), g.select(*[F.col(c).alias(f"{c}_b") for c in g.columns])
    d = a.join(b, F.col("lv_a") < F.col("lv_b")).filter("n_a > 1 and n_b > 1")
    qa, qb = F.col("var_a") / F.col("n_a"), F.col("var_b") / F.col("n_b")
    d = d.withColumns({"t": C.ratio(F.col("m_a") - F.col("m_b"), F.sqrt(qa + qb)), "df": C.ratio((qa + qb) * (qa + qb), qa * qa / (F.col("n_a") - 1) + qb * qb / (F.col("n_b") - 1))})
    d = d.select(F.col("lv_a").alias("level_a"), F.col("lv_b").alias("level_b"), "n_a", "n_b", F.col("m_a").alias("mean_a"), F.col("m_b").alias("mean_b"), "t", "df")
    return dist.with_p_values(d, "t", "t", "df") if p_values else d


def marginal_means(df: DataFrame, value: str, factors: Sequence[str]) -> DataFrame:
    long = df.select(C.num(value).alias("v"), *[F.col(f).cast("string").alias(f) for f in factors]).unpivot(["v"], list(factors), "factor", "level")
    return long.filter("v is not null and level is not null").groupBy("factor", "level").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"))


