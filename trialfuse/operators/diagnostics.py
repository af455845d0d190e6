"""Robustness tables, claims and panel sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import coding as C
from .scales import LEVELS

# Levels of support and their ordinal scores.
SUPPORT = {
    "unsupported_no_data": 0.0,
    "unsupported_no_model": 0.0,
    "unsupported_no_term": 0.0,
    "exploratory_incomplete_modalities": 1.0,
    "exploratory": 1.0,
    "exploratory_only_three_levels": 1.0,
    "see_diagnostics": 1.5,
    "moderate_pending_effect_tests": 2.0,
    "moderate": 2.0,
}
PANEL = "panel string, metric string, group_name string, subgroup string, value double, mean double, sem double, n long, label string, unit string, source string, order_index long, note string"


def outcome_columns(columns: Sequence[str], tokens: Sequence[str]) -> list[str]:
    return [c for c in columns if any(t.lower() in c.lower() for t in tokens)]


def order_correlation(df: DataFrame, outcomes: Sequence[str], index: str = "position") -> DataFrame:
    """Pearson r of each outcome with the trial index: pairwise complete, more than two pairs, neither constant."""
    long = df.select(C.num(index).alias("x"), *[C.num(o).alias(o) for o in outcomes]).unpivot(["x"], list(outcomes), "outcome", "y").dropna(subset=["x", "y"])
    d = long.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.covar_pop("x", "y").alias("c"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"), F.min("x").alias("lx"), F.max("x").alias("hx"), F.min("y").alias("ly"), F.max("y").alias("hy"))
    fit = (F.col("n") > 2) & (F.col("lx") < F.col("hx")) & (F.col("ly") < F.col("hy"))
    return d.select("outcome", "n", F.when(fit, F.try_divide(F.col("c"), F.sqrt(F.col("vx") * F.col("vy")))).alias("r"))


def factor_sensitivity(df: DataFrame, outcomes: Sequence[str], factors: Sequence[str]) -> DataFrame:
    """n and mean of each outcome per factor level; null levels are kept."""
    long = df.select(*[F.col(f).cast("string").alias(f) for f in factors], *[C.num(o).alias(o) for o in outcomes]).unpivot(list(factors), list(outcomes), "outcome", "v")
    lv = F.explode(F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).alias("level")) for f in factors])).alias("l")
    return long.select("outcome", "v", lv).groupBy("outcome", "l.factor", "l.level").agg(F.count("v").alias("n"), F.avg("v").alias("mean"))


def _peak() -> Column:
    return F.col("m1") - (F.col("m0") + F.col("m2")) / 2


def peak_index(df: DataFrame, outcomes: Sequence[str], level: str, levels: Sequence = LEVELS) -> DataFrame:
    """Level means and peak = middle - mean of the outer two, and the strength of a claim from them."""
    long = df.select(C.level_number(df, level).alias("_l"), *[C.num(o).alias(o) for o in outcomes]).unpivot(["_l"], list(outcomes), "outcome", "v")
    d = long.groupBy("outcome").agg(*[F.avg(F.when(F.col("_l") == x, F.col("v"))).alias(f"m{i}") for i, x in enumerate(levels)])
    return d.withColumn("peak", _peak()).withColumn("claim", F.when(F.col("peak").isNull(), "insufficient_wwr_granularity").otherwise("exploratory_only_three_levels"))


def subject_peak_index(df: DataFrame, outcome: str, level: str, by: Sequence[str], levels: Sequence = LEVELS) -> DataFrame:
    """peak per group; only groups with all levels."""
    d = df.withColumn("_level", C.level_number(df, level)).groupBy(*by).agg(*[F.avg(F.when(F.col("_level") == x, C.num(outcome))).alias(f"m{i}") for i, x in enumerate(levels)])
    return d.dropna(subset=["m0", "m1", "m2"]).withColumn("peak", _peak())


def power_sensitivity(df: DataFrame, group: str, who: str = "participant_id") -> DataFrame:
    g = df.groupBy(F.coalesce(F.col(group).cast("string"), F.lit("Unknown")).alias("group_name")).agg(F.count_distinct(who).alias("n"))
    return g.unionByName(g.agg(F.min("n").alias("n")).select(F.lit("min_group_n").alias("group_name"), "n"))


def level_contrast_rows(df: DataFrame, outcome: str, level: str, levels: Sequence = LEVELS) -> DataFrame:
    """Long rows: a mean for each level, and the peak contrast."""
    p = peak_index(df, [outcome], level, levels)
    rows = F.array(*[F.struct(F.lit(f"mean_{x}").alias("term"), F.col(f"m{i}").alias("estimate")) for i, x in enumerate(levels)], F.struct(F.lit("peak").alias("term"), F.col("peak").alias("estimate")))
    return p.select("outcome", F.explode(rows).alias("r")).select("outcome", "r.term", "r.estimate")


def modality_convergence(df: DataFrame, metrics: dict[str, Sequence[str]]) -> DataFrame:
    modality = {c: m for m, cs in metrics.items() for c in cs}
    long = df.select(*[C.num(c).alias(c) for c in modality]).unpivot([], list(modality), "metric", "v")
    tag = F.create_map(*[F.lit(x) for kv in modality.items() for x in kv])
    return long.groupBy("metric").agg(F.count("v").alias("n"), F.avg("v").alias("mean")).withColumn("modality", tag[F.col("metric")])


def claim_support(claims: DataFrame, available: Sequence[str]) -> DataFrame:
    """claims: claim_id, required array<string>. level: moderate if all required modalities are available, exploratory if any at all is."""
    have = F.array(*[F.lit(a) for a in available]) if available else F.array().cast("array<string>")
    missing = F.array_except("required", have)
    level = F.when(F.size(missing) == 0, "moderate_pending_effect_tests").otherwise(F.lit("exploratory_incomplete_modalities" if available else "unsupported_no_data"))
    return claims.withColumns({"missing": F.array_join(F.array_sort(missing), ";"), "level": level})


def term_support(coefficients: DataFrame, fragments: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """fragment, level: moderate if a term with the fragment has p < alpha, exploratory if a term has the fragment; else unsupported, for want of a model or of a term."""
    t = F.lower(F.coalesce("term", F.lit("")))
    none = F.when(F.count(F.lit(1)) == 0, "unsupported_no_model").otherwise("unsupported_no_term")
    level = lambda f: F.when(F.coalesce(F.bool_or(t.contains(f.lower()) & (F.col("p_value") < alpha)), F.lit(False)), "moderate").when(F.count_if(t.contains(f.lower())) > 0, "exploratory").otherwise(none)
    return coefficients.agg(*[level(f).alias(f) for f in fragments]).unpivot([], list(fragments), "fragment", "level")


def issue_matrix(issues: DataFrame, claims: DataFrame) -> DataFrame:
    """issues joined to claims on claim_id; weak support overrides what evidence says."""
    out = issues.join(claims, "claim_id", "left")
    ready = F.when(F.coalesce("evidence", F.lit("")) != "", "ready").otherwise("missing_evidence")
    weak = F.coalesce(F.col("level").rlike("(?i)unsupported|exploratory"), F.lit(False))
    return out.withColumn("readiness", F.when(weak, "weak_support").otherwise(ready))


def support_score(c: Column) -> Column:
    """The score of a level, else of the first level that the text contains."""
    t = F.trim(c.cast("string"))
    exact = F.create_map(*[F.lit(x) for kv in SUPPORT.items() for x in kv])[t]
    return F.coalesce(exact, *[F.when(t.contains(k), v) for k, v in SUPPORT.items()])


def weighted_rollup(df: DataFrame, by: Sequence[str], value: str = "mean", weight: str = "n") -> DataFrame:
    w = F.when(F.col(value).isNotNull(), F.col(weight))
    return df.groupBy(*by).agg(F.try_divide(F.sum(F.col(value) * w), F.sum(w)).alias("weighted_mean"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("sem"), F.sum(w).alias("n"))


def panel_rows(df: DataFrame, panel: str, **columns: Column) -> DataFrame:
    """The unified panel row; columns that are not given are null."""
    spec = [f.split(" ") for f in PANEL.split(", ")]
    return df.select(*[(F.lit(panel) if n == "panel" else columns[n].cast(t) if n in columns else F.lit(None).cast(t)).alias(n) for n, t in spec])


def empty_panel(spark, panel: str) -> DataFrame:
    return panel_rows(spark.range(1), panel, note=F.lit("no source rows"))


def top_correlations(corr: DataFrame, k: int = 12) -> DataFrame:
    return corr.filter("r is not null").orderBy(F.abs("r").desc(), "outcome").limit(k)


def source_index(df: DataFrame, column: str = "sources") -> DataFrame:
    """One row for each ';'-separated source that is not blank."""
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, F.explode(F.split(column, ";")).alias("source")).withColumn("source", F.trim("source")).filter("source <> ''")


def descriptive_panel(desc: DataFrame, panel: str, group: str, subgroup: str) -> DataFrame:
    """From scales.descriptives(): means with standard errors."""
    sem = F.col("sd") / F.sqrt(F.col("n_obs"))
    return panel_rows(desc, panel, metric=F.col("item"), group_name=F.col(group).cast("string"), subgroup=F.col(subgroup).cast("string"), mean=F.col("mean"), sem=sem, n=F.col("n_obs"), source=F.lit("descriptives"))


def contrast_panel(contrasts: DataFrame, panel: str) -> DataFrame:
    return panel_rows(contrasts, panel, metric=F.col("outcome"), group_name=F.col("term"), value=F.col("t"), mean=F.col("mean"), sem=F.col("se"), n=F.col("n"), label=F.col("direction"), source=F.lit("contrasts"))


def convergence_panel(convergence: DataFrame, panel: str) -> DataFrame:
    return panel_rows(convergence, panel, metric=F.col("metric"), group_name=F.col("modality"), value=F.col("mean"), n=F.col("n"), source=F.lit("convergence"))


def correlation_panel(corr: DataFrame, panel: str, k: int = 12) -> DataFrame:
    return panel_rows(top_correlations(corr, k), panel, metric=F.col("outcome"), value=F.col("r"), n=F.col("n"), source=F.lit("order_correlation"))


def claim_panel(claims: DataFrame, panel: str) -> DataFrame:
    return panel_rows(claims, panel, metric=F.col("claim_id").cast("string"), value=support_score(F.col("level")), label=F.col("level"), source=F.lit("claims"))
