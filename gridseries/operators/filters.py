"""Row filters. Predicates are plain columns, so they reach the file scan."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridseries.functions.missing import finite, is_finite
from gridseries.functions.quantiles import broadcast_if_small


def _all(parts) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def _any(parts) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def period_months(period: tuple[int, int], months=None, year: str = "year", month: str = "month") -> Column:
    """Inclusive year range and optional month list."""
    cond = F.col(year).between(*period)
    return cond if not months else cond & F.col(month).isin(*months)


def baseline_only(value: Column, period: tuple[int, int], year: str = "year") -> Column:
    """Value inside the baseline years, else null (for conditional aggregates)."""
    return F.when(F.col(year).between(*period), value)


def finite_rows(df: DataFrame, *cols: str) -> DataFrame:
    """Coerce the columns to numbers and keep rows where all are finite."""
    numbers = {c: F.col(c).try_cast("double") for c in cols}
    return df.withColumns(numbers).where(_all(is_finite(F.col(c)) for c in cols))


def off_diagonal(x: Column, y: Column, rel_tol: float) -> Column:
    """|y-x| > tol * max(|x|, |y|, 1)."""
    return F.abs(y - x) > rel_tol * F.greatest(F.abs(x), F.abs(y), F.lit(1.0))


def wildcard(text: Column, pattern: str) -> Column:
    """Case-insensitive whole match where ``*`` stands for any text."""
    body = ".*".join(re.sub(r"([^A-Za-z0-9_ ])", r"\\\1", part) for part in pattern.split("*"))
    return text.rlike(f"(?is)^{body}$")


ROW_KEY_COLUMNS = [
    "metrickey", "metricdomain", "metrictype", "variable", "source_id", "member_id", "experiment_id", "comparison_code",
]


def row_key_text(df: DataFrame) -> Column:
    """Key columns joined by ``__``; absent columns are empty."""
    have = set(df.columns)
    return F.concat_ws("__", *[F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have else F.lit("") for c in ROW_KEY_COLUMNS])


def filter_row_keys(df: DataFrame, all_of=(), any_of=(), none_of=()) -> DataFrame:
    """AND / OR / NOT wildcard lists on the row key text."""
    key = row_key_text(df)
    cond = _all(wildcard(key, p) for p in all_of)
    if any_of:
        cond = cond & _any(wildcard(key, p) for p in any_of)
    return df.where(cond & ~_any(wildcard(key, p) for p in none_of))


def filter_columns(df: DataFrame, all_of: dict | None = None, any_of: dict | None = None, none_of: dict | None = None) -> DataFrame:
    """Substring filters per column; absent columns are skipped."""
    def hits(mapping):
        out = []
        for col, pats in (mapping or {}).items():
            pats = [pats] if isinstance(pats, str) else list(pats)
            if col in df.columns and pats:
                out.append(_any(F.lower(F.col(col).cast("string")).contains(p.lower()) for p in pats))
        return out

    cond = _all(F.coalesce(h, F.lit(False)) for h in hits(all_of))
    if any_of:
        cond = cond & _any(F.coalesce(h, F.lit(False)) for h in hits(any_of))
    return df.where(cond & ~_any(F.coalesce(h, F.lit(False)) for h in hits(none_of)))


def glob_to_regex(pattern: str) -> str:
    """``*`` and ``?`` to a regular expression over the whole text."""
    out = "".join(".*" if ch == "*" else "." if ch == "?" else re.escape(ch) for ch in pattern)
    return f"^{out}$"


def matching_scenarios(df: DataFrame, column: str, patterns: list[str]) -> DataFrame:
    """Rows whose scenario matches any pattern (glob)."""
    return df.where(_any(F.col(column).rlike(glob_to_regex(p)) for p in patterns))


def unmatched_patterns(df: DataFrame, column: str, patterns: list[str]) -> DataFrame:
    """Patterns that match no scenario: one flag per pattern in a single pass."""
    flags = df.agg(*[F.max(F.col(column).rlike(glob_to_regex(p)).cast("int")).alias(f"p{i}") for i, p in enumerate(patterns)])
    rows = F.array(*[F.struct(F.lit(p).alias("pattern"), F.coalesce(F.col(f"p{i}"), F.lit(0)).alias("hit")) for i, p in enumerate(patterns)])
    return flags.select(F.inline(rows)).where("hit = 0").select("pattern")


def is_natural(experiment: Column, suffix: str = "-nat") -> Column:
    """Natural-forcing runs carry the suffix."""
    return F.lower(experiment).endswith(suffix)


def select_catalogue(
    df: DataFrame, whitelist=None, blacklist=None, member_pattern: str | None = None, one_member: bool = False
) -> DataFrame:
    """White / black list on sources, member pattern, first member only."""
    cond = F.lit(True)
    if whitelist:
        cond = cond & F.col("source_id").isin(*whitelist)
    if blacklist:
        cond = cond & ~F.col("source_id").isin(*blacklist)
    if member_pattern:
        cond = cond & F.col("member_id").rlike(f"^{member_pattern}$")
    out = df.where(cond)
    if not one_member:
        return out
    # min is combined map-side; a window would move every member of a source.
    first = out.groupBy("source_id", "experiment_id").agg(F.min("member_id").alias("member_id"))
    return out.join(first, ["source_id", "experiment_id", "member_id"], "left_semi")


def complete_years(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of years that hold each of the twelve months exactly once."""
    counts = df.groupBy(*keys, "year").agg(F.count(F.lit(1)).alias("_n"), F.count_distinct("month").alias("_m"))
    good = counts.where("_n = 12 AND _m = 12").select(*keys, "year")
    return df.join(good, [*keys, "year"], "left_semi")


def event_month(df: DataFrame, keys: list[str], value: str, month: int = 12) -> DataFrame:
    """One finite value per key and year for one month; a second one is an error."""
    picked = df.where((F.col("month") == month) & is_finite(F.col(value)))
    agg = picked.groupBy(*keys, "year").agg(F.count(F.lit(1)).alias("_n"), F.max(value).alias("_v"))
    message = F.concat(F.lit("several values for event month of year "), F.col("year").cast("string"))
    return agg.select(*keys, "year", F.when(F.col("_n") > 1, F.raise_error(message).cast("double")).otherwise(F.col("_v")).alias(value))


def complete_window(df: DataFrame, series: list[str], period: tuple[int, int], strict: bool = True) -> DataFrame:
    """Years of a window; a series without all of them is an error (or dropped)."""
    inside = df.where(F.col("year").between(*period))
    want = period[1] - period[0] + 1
    # One row per year and series, so the window is bounded by the period.
    counted = inside.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*series)))
    if strict:
        guard = F.when(F.col("_n") != want, F.raise_error(F.lit(f"incomplete window {period}")).cast("bigint")).otherwise(F.col("_n"))
        counted = counted.withColumn("_n", guard)
    return counted.where(F.col("_n") == want).drop("_n")


def contract_filter(records: DataFrame, contract: DataFrame, strict: bool = False) -> DataFrame:
    """Keep records whose metric type is allowed.

    ``contract`` holds (variable, metrictype); a null variable is the default
    list, used for variables that have no list of their own.
    """
    # At most one row per (variable, metric type) of the contract.
    own = contract.where("variable IS NOT NULL").distinct()
    listed = own.select("variable").distinct().withColumn("_own", F.lit(True))
    default = contract.where("variable IS NULL").select("metrictype").distinct().withColumn("_default", F.lit(True))
    own = own.select("variable", "metrictype").withColumn("_hit", F.lit(True))
    tagged = (
        records.join(broadcast_if_small(listed), "variable", "left")
        .join(broadcast_if_small(own), ["variable", "metrictype"], "left")
        .join(broadcast_if_small(default), "metrictype", "left")
    )
    allowed = F.when(F.col("_own"), F.col("_hit").isNotNull()).otherwise(F.col("_default").isNotNull())
    kept = tagged.where(allowed).select(*records.columns)
    if strict and kept.isEmpty():
        raise ValueError("no record is left after the contract filter")
    return kept


def primary_lane(df: DataFrame, baseline: tuple[int, int], treatment: str, aggregation: str, window: tuple[int, int]) -> DataFrame:
    """Ratio rows of the primary lane of a summary table."""
    return df.where(
        (F.col("record_type") == "probability_ratio")
        & (F.col("baseline_start") == baseline[0]) & (F.col("baseline_end") == baseline[1])
        & (F.col("rsds_treatment") == treatment) & (F.col("aggregation") == aggregation)
        & (F.col("window_start") == window[0]) & (F.col("window_end") == window[1])
    )


def null_if_not_finite(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: finite(F.col(c)) for c in cols})
