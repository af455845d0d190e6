"""Column expressions that normalise and code raw values. Nothing raises on bad data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Texts that count as true, per rule.
TRUE_ACTIVE = ("true", "1", "yes", "y")
TRUE_FLOW = ("true", "1", "yes")
FALSE_TEXTS = ("false", "0", "no", "n", "")

# Gender texts, and those that count as none.
MALE = ("m", "male", "man", "男", "男性", "男生")
FEMALE = ("f", "female", "woman", "女", "女性", "女生")
NO_GENDER = ("nan", "none", "unknown")

# Texts in answers on experience.
LOW_EXPERIENCE = (
    "never", "rare", "rarely", "low", "none", "从不", "极少", "较少", "少于", "每月<1", "每月＜1", "每月少于", "偶尔", "1-2次", "1–2次", "每月1-2", "每月1–2",
)
HIGH_EXPERIENCE = (
    "sometimes", "often", "frequent", "weekly", "high", "有时", "经常", "3-4次", "3–4次", "每月3-4", "每月3–4", "≥5次", ">=5次", "每周",
)

NUMBER = r"([0-9]+(?:\.[0-9]+)?)"
SIGNED_NUMBER = r"(-?[0-9]+(?:\.[0-9]+)?)"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def num(c: Column | str) -> Column:
    """Double, or null for text that is no number and for NaN."""
    d = _c(c).try_cast("double")
    return F.when(~F.isnan(d), d)


def text_key(c: Column | str) -> Column:
    return F.trim(_c(c).cast("string"))


def int_key(c: Column | str) -> Column:
    """'5', '5.0' and 5 are 5; anything else is null."""
    return num(c).try_cast("long")


def truthy(c: Column | str, mode: str = "active") -> Column:
    """active: true, 1, yes, y. flow: without y. legacy: any text that is not a false one."""
    t = F.lower(F.trim(F.coalesce(_c(c).cast("string"), F.lit(""))))
    if mode == "legacy":
        return ~t.isin(*FALSE_TEXTS)
    return t.isin(*(TRUE_ACTIVE if mode == "active" else TRUE_FLOW))


def binary_outcome(c: Column | str) -> Column:
    """1 / 0 / null for a visited-like outcome."""
    t = F.lower(F.trim(_c(c).cast("string")))
    return F.when(t.isin("true", "1", "1.0", "yes", "y"), 1).when(t.isin("false", "0", "0.0", "no", "n"), 0).cast("int")


def gender(c: Column | str) -> Column:
    raw = F.trim(_c(c).cast("string"))
    t = F.lower(raw)
    return F.when(t.isNull() | (t == "") | t.isin(*NO_GENDER), "Unknown").when(t.isin(*MALE), "Male").when(t.isin(*FEMALE), "Female").otherwise(raw)


def coded_by_patterns(c: Column | str, low: tuple[str, ...] = LOW_EXPERIENCE, high: tuple[str, ...] = HIGH_EXPERIENCE) -> Column:
    """Low where a low pattern is in the text, else High, else the raw text; blank and nan are Unknown."""
    raw = F.trim(_c(c).cast("string"))
    t = F.lower(raw)
    has = lambda ps: reduce(lambda a, b: a | b, [t.contains(p.lower()) for p in ps])
    return F.when(t.isNull() | t.isin("", "nan"), "Unknown").when(has(low), "Low").when(has(high), "High").otherwise(raw)


def first_number(c: Column | str, signed: bool = False) -> Column:
    t = F.regexp_extract(_c(c).cast("string"), SIGNED_NUMBER if signed else NUMBER, 1)
    return F.nullif(t, F.lit("")).try_cast("double")


def level_number(df: DataFrame, level: str) -> Column:
    """The number of a factor's level: of <level>_numeric if that column has any value, else the first number in its text ('45 %' is 45)."""
    kind = dict(df.dtypes).get(level, "string")
    own = F.col(level) if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal") else first_number(level)
    given = f"{level}_numeric"
    if given not in df.columns:
        return own
    return F.when(df.agg(F.count(num(given)).alias("n")).scalar() > 0, num(given)).otherwise(own.cast("double"))


def condition_id(complexity: Column | str, cond: Column | str, wwr: Column | str) -> Column:
    """C{complexity}_W{wwr}; a missing part is NA. Complexity 0 is a value."""
    c = F.coalesce(_c(complexity).cast("string"), _c(cond).cast("string"), F.lit("NA"))
    w = F.coalesce(num(wwr).try_cast("long").cast("string"), F.lit("NA"))
    return F.concat(F.lit("C"), c, F.lit("_W"), w)


def is_c1(complexity: Column | str, cond: Column | str, missing: bool | None = None) -> Column:
    """Complexity 1 or high, else condition C1; `missing` where neither is given."""
    k, d = F.lower(F.trim(_c(complexity).cast("string"))), F.upper(F.trim(_c(cond).cast("string")))
    return F.when(k.isNotNull() & (k != ""), k.isin("1", "1.0", "c1", "high", "true")).when(d.isNotNull() & (d != ""), d == "C1").otherwise(F.lit(missing).cast("boolean"))


def without_note(c: Column | str) -> Column:
    """Without a -n-n suffix."""
    return F.regexp_replace(F.trim(_c(c).cast("string")), r"^(.+?)-\d+-\d+$", "$1")


def canonical_name(c: Column | str) -> Column:
    """The first part of a name that a middle dot or a bullet parts."""
    t = F.trim(_c(c).cast("string"))
    parts = F.filter(F.transform(F.split(t, "[·•]"), lambda p: F.trim(p)), lambda p: p != "")
    return F.when(F.size(parts) > 1, parts[0]).otherwise(t)


def clock_ms(c: Column | str) -> Column:
    """Milliseconds: a number as it is, HH:mm:ss.ms text parsed."""
    t = F.trim(_c(c).cast("string"))
    p = F.split(t, ":")
    parsed = (p[0].try_cast("double") * 3600 + p[1].try_cast("double") * 60 + p[2].try_cast("double")) * 1000
    return F.when(t.rlike(r"^\d+:\d+:\d+(\.\d+)?$"), parsed).otherwise(num(t))


def record_date(c: Column | str) -> Column:
    """The date of a yymmdd... record id."""
    t = F.substring(F.trim(_c(c).cast("string")), 1, 6)
    return F.to_date(F.when(t.rlike(r"^\d{6}$"), F.try_to_timestamp(F.concat(F.lit("20"), t), F.lit("yyyyMMdd"))))


def order_code(c: Column | str, default: str = "1") -> Column:
    found = F.regexp_extract(F.coalesce(_c(c).cast("string"), F.lit("")), "[12]", 0)
    return F.coalesce(F.nullif(found, F.lit("")), F.lit(default))


def scene_of(block: Column, position: Column, per_block: int = 6) -> Column:
    return ((block - 1) * per_block + position).cast("long")


def ordered_join(reasons: Column) -> Column:
    """Distinct non-null reasons in order, joined by ';'."""
    return F.array_join(F.array_distinct(F.array_compact(reasons)), ";")


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, F.nullif(b, F.lit(0)))
