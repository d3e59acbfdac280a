"""Forcing tables and emulator predictors."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridseries.functions.quantiles import broadcast_if_small
from gridseries.operators.timeseries import edge_trend_mean, fill_gaps
from gridseries.session import task_count

MAX_HOLD_MONTHS = 24


def assemble_predictors(df: DataFrame, variables: list[str], model_index: Column) -> DataFrame:
    """month, sin/cos of the month, model index and the variables; absent ones are 0."""
    angle = (F.col("month") - 1) / 12.0 * (2.0 * math.pi)
    have = set(df.columns)
    cols = {"model_index": model_index, "sin_time": F.sin(angle), "cos_time": F.cos(angle)}
    cols |= {v: F.coalesce(F.col(v), F.lit(0.0)) if v in have else F.lit(0.0) for v in variables}
    return df.withColumns(cols)


def combine_variables(df: DataFrame, adding: list[str], subtracting: list[str], out: str, units: dict[str, str] | None = None,
                      fallback: tuple[list[str], list[str]] | None = None) -> DataFrame:
    """Sum minus differences of columns of one unit, with a fallback formula."""
    used = [*adding, *subtracting]
    if units and len({units[v] for v in used if v in units}) > 1:
        raise ValueError(f"units differ: { {v: units.get(v) for v in used} }")

    def formula(plus, minus):
        total = F.col(plus[0])
        for v in plus[1:]:
            total = total + F.col(v)
        for v in minus:
            total = total - F.col(v)
        return total

    value = formula(adding, subtracting)
    return df.withColumn(out, value if fallback is None else F.coalesce(value, formula(*fallback)))


def counterfactual(df: DataFrame, series: list[str], zero: list[str] = (), freeze_first: list[str] = (), freeze_last: list[str] = (), time: str = "month_idx") -> DataFrame:
    """Zero some predictors and hold others at their first or last value."""
    w = Window.partitionBy(*series)
    cols = {c: F.lit(0.0) for c in zero}
    cols |= {c: F.min_by(c, time).over(w) for c in freeze_first}
    cols |= {c: F.max_by(c, time).over(w) for c in freeze_last}
    return df.withColumns(cols)


def nearest_in_time(targets: DataFrame, source: DataFrame, keys: list[str], value: str, out: str, max_hold: int = MAX_HOLD_MONTHS) -> DataFrame:
    """Value of the nearest source month (the earlier one on a tie); ends are held.

    Both sides are merged per series and bracketed by windows; a gap of more
    than ``max_hold`` months beyond the ends is an error.
    """
    a = targets.select(*keys, "month_idx").distinct().select(*keys, "month_idx", F.lit(None).cast("double").alias("_v"), F.lit(1).alias("_target"))
    b = source.where(F.col(value).isNotNull()).select(*keys, "month_idx", F.col(value).cast("double").alias("_v"), F.lit(0).alias("_target"))
    w = Window.partitionBy(*keys).orderBy("month_idx", "_target")
    point = F.when(F.col("_target") == 0, F.struct(F.col("month_idx").alias("t"), F.col("_v").alias("v")))
    both = a.unionByName(b).withColumns({
        "_b": F.last(point, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "_a": F.first(point, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)),
    }).where("_target = 1")
    gap_b, gap_a = F.col("month_idx") - F.col("_b.t"), F.col("_a.t") - F.col("month_idx")
    nearest = F.when(gap_a.isNull() | (gap_b <= gap_a), F.col("_b.v")).otherwise(F.col("_a.v"))
    outside = F.col("_b").isNull() | F.col("_a").isNull()
    far = outside & (F.coalesce(gap_b, gap_a, F.lit(10**9)) > max_hold)
    guarded = F.when(far, F.raise_error(F.lit(f"request beyond {max_hold} months of the source")).cast("double")).otherwise(nearest)
    found = both.select(*keys, "month_idx", guarded.alias(out))
    return targets.join(found, [*keys, "month_idx"], "left")


def sum_and_count(df: DataFrame, keys: list[str], value: str, period: tuple[int, int]) -> DataFrame:
    """Sum and count per (keys, month, year) over all members."""
    return df.where(F.col("year").between(*period)).groupBy(*keys, "month", "year").agg(
        F.sum(value).alias("total"), F.count(value).alias("n")
    )


def radiation_offsets(
    reference: DataFrame, models: DataFrame, value: str, period: tuple[int, int], window: int = 21, fit_years: int = 10, extension: int = 11,
    keys: list[str] | None = None,
) -> DataFrame:
    """Smoothed reference minus smoothed model mean per (keys, point, month, year).

    ``keys`` (the model source) separates the models; members are summed before
    anything is smoothed. Gaps are filled along the years.
    """
    keys = keys or []
    cell = ["point_id", "month"]

    def smooth(df, by, name):
        mean = sum_and_count(df, [*by, "point_id"], value, period).select(*by, *cell, "year", F.when(F.col("n") > 0, F.col("total") / F.col("n")).alias("m"))
        full = mean.select(*by, *cell).distinct().withColumn("year", F.explode(F.sequence(F.lit(period[0]), F.lit(period[1]))))
        filled = full.join(mean, [*by, *cell, "year"], "left")
        return edge_trend_mean(filled, [*by, *cell], "m", name, window, fit_years, extension).drop("m")

    ref = smooth(reference, [], "_r")
    both = smooth(models, keys, "_m").join(ref, [*cell, "year"], "left").withColumn("_d", F.col("_r") - F.col("_m"))
    return fill_gaps(both, [*keys, *cell], "year", "_d", "offset").select(*keys, *cell, "year", "offset")


def apply_offsets(df: DataFrame, offsets: DataFrame, value: str, period: tuple[int, int], natural: Column, out: str) -> DataFrame:
    """Add the offset of the clipped year; natural runs use the first year."""
    year = F.when(natural, F.lit(period[0])).otherwise(F.least(F.greatest(F.col("year"), F.lit(period[0])), F.lit(period[1])))
    staged = df.withColumn("_year", year)
    table = broadcast_if_small(offsets.withColumnRenamed("year", "_year"))
    joined = staged.join(table, ["point_id", "month", "_year"], "left")
    return joined.withColumn(out, F.col(value) + F.coalesce("offset", F.lit(0.0))).drop("_year", "offset")


def natural_or_base(runs: DataFrame, forcing: DataFrame, suffix: str = "-nat") -> DataFrame:
    """Natural scenario's value, else the base scenario's, else zero."""
    def side(name):
        return forcing.select(F.col("scenario").alias(f"_{name}"), "run_id", "variable", "year", F.col("value").alias(name))

    staged = runs.withColumns({"_nat": F.concat("scenario", F.lit(suffix)), "_base": F.col("scenario")})
    keys = ["run_id", "variable", "year"]
    joined = staged.join(side("nat"), ["_nat", *keys], "left").join(side("base"), ["_base", *keys], "left")
    return joined.withColumn("value", F.coalesce("nat", "base", F.lit(0.0))).drop("_nat", "_base", "nat", "base")


def consolidate(parts: dict[str, DataFrame], keys: list[str], axis: DataFrame) -> DataFrame:
    """Wide monthly table of several variables on one time axis.

    ``parts`` maps a column name to (keys, month_idx, value) rows. All parts go
    through one union and one groupBy instead of a chain of joins. Rows are
    partitioned before they are grouped: a row meets no other of its key before,
    and a task that makes a part would hold all its keys once more.
    """
    long = None
    for name, df in parts.items():
        one = df.select(*keys, "month_idx", F.lit(name).alias("_name"), F.col("value").cast("double").alias("_v"))
        long = one if long is None else long.unionByName(one)
    on_axis = axis.select(*keys, "month_idx").distinct().withColumns({"_name": F.lit(None).cast("string"), "_v": F.lit(None).cast("double")})
    both = long.unionByName(on_axis).repartition(task_count(axis.sparkSession), *keys, "month_idx")
    agg = both.groupBy(*keys, "month_idx").agg(
        F.max(F.col("_name").isNull()).alias("_axis"), *[F.max(F.when(F.col("_name") == n, F.col("_v"))).alias(n) for n in parts]
    )
    return agg.where("_axis").drop("_axis")


def composite_scenario(df: DataFrame, keys: list[str], scenarios: list[str], name: str) -> DataFrame:
    """New scenario: the first one's variables, gaps filled from the next in order."""
    prio = F.array_position(F.array(*[F.lit(s) for s in scenarios]), F.col("scenario"))
    kept = df.where(prio > 0).withColumn("_p", prio)
    known = kept.where("_p = 1").select("variable").distinct()
    kept = kept.join(broadcast_if_small(known), "variable", "left_semi")
    filled = kept.groupBy(*keys).agg(F.min_by("value", F.when(F.col("value").isNotNull(), F.col("_p"))).alias("value"))
    return filled.withColumn("scenario", F.lit(name))


def forcing_components(df: DataFrame, mapping: DataFrame, keys: list[str], fix: dict[str, list[str]] | None = None, base_year: int = 1850) -> DataFrame:
    """Sum of mapped variables per component; single-forcing scenarios hold the others.

    ``fix`` maps a scenario to the components that keep their time series; all
    others of that scenario take their ``base_year`` value.
    """
    summed = df.join(broadcast_if_small(mapping), "variable").groupBy(*keys, "scenario", "component", "year").agg(F.sum("value").alias("value"))
    if not fix:
        return summed
    w = Window.partitionBy(*keys, "scenario", "component")
    base = F.max(F.when(F.col("year") == base_year, F.col("value"))).over(w)
    held = F.lit(False)
    for scenario, survivors in fix.items():
        held = held | ((F.col("scenario") == scenario) & ~F.col("component").isin(*survivors))
    return summed.withColumn("value", F.when(held, base).otherwise(F.col("value")))


def join_history(df: DataFrame, keys: list[str], historical: str, future: str, last_historical: int = 2014) -> DataFrame:
    """Historical scenario up to its last year, then the future scenario."""
    past = (F.col("scenario") == historical) & (F.col("year") <= last_historical)
    later = (F.col("scenario") == future) & (F.col("year") > last_historical)
    return df.where(past | later).select(*keys, "year", "value")


def co2_forcing(year: Column, multiplier: float | None, base: float = 278.0, doubling: float = 3.71, start: int = 1850) -> Column:
    """a*ln(c/c0) for an abrupt multiple, or for one percent per year."""
    a = doubling / math.log(2.0)
    if multiplier is not None:
        return F.when(year > start, F.lit(a * math.log(multiplier))).otherwise(0.0)
    return F.when(year > start, a * F.log(F.pow(F.lit(1.01), year - start))).otherwise(0.0)


def delta_map(draws: DataFrame, keys: list[str], factual: Column, value: str) -> DataFrame:
    """Mean over factual draws less the mean over the others, per key that both have."""
    agg = draws.groupBy(*keys).agg(F.avg(F.when(factual, F.col(value))).alias("_a"), F.avg(F.when(~factual, F.col(value))).alias("_b"))
    return agg.where("_a IS NOT NULL AND _b IS NOT NULL").select(*keys, (F.col("_a") - F.col("_b")).alias("delta"))
