"""Ensemble statistics: climatologies, changes, percentile bands, subsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridseries.functions.hashing import hash32, hash_mod, key_text
from gridseries.functions.quantiles import broadcast_if_small, grouped_percentiles
from gridseries.functions.ranks import row_numbers, running_sums
from gridseries.session import cut_lineage


def anomalies(df: DataFrame, series: list[str], value: str, out: str, clim: str) -> DataFrame:
    """Deviation from the month mean of each series."""
    mean = F.avg(value).over(Window.partitionBy(*series, "month"))
    return df.withColumn(clim, mean).withColumn(out, F.col(value) - F.col(clim))


def annual_means(df: DataFrame, series: list[str], value: str) -> DataFrame:
    return df.groupBy(*series, "year").agg(F.avg(value).alias(value))


def annual_extremes(df: DataFrame, point: list[str], member: list[str], value: str, years: tuple[int, int]) -> DataFrame:
    """Largest, smallest and mean annual mean per point over members and years."""
    annual = annual_means(df.where(F.col("year").between(*years)), [*point, *member], value)
    return annual.groupBy(*point).agg(
        F.max(value).alias("max_annual"), F.min(value).alias("min_annual"), F.avg(value).alias("mean_annual")
    )


def period_mean(value: Column, period: tuple[int, int]) -> Column:
    return F.avg(F.when(F.col("year").between(*period), value))


def period_change(df: DataFrame, keys: list[str], value: str, baseline: tuple[int, int], future: tuple[int, int]) -> DataFrame:
    """Baseline mean, future mean and their difference per key, in one pass."""
    v = F.col(value)
    agg = df.groupBy(*keys).agg(period_mean(v, baseline).alias("base"), period_mean(v, future).alias("future"))
    return agg.withColumn("delta", F.col("future") - F.col("base"))


def change_stats(changes: DataFrame, keys: list[str], value: str = "delta") -> DataFrame:
    """5/50/95 % of member changes and their number."""
    return grouped_percentiles(changes, keys, value, [0.05, 0.5, 0.95], ["p05", "median", "p95"])


def band_change_stats(bands: DataFrame, keys: list[str], baseline: tuple[int, int], future: tuple[int, int]) -> DataFrame:
    """Changes of percentile bands, ordered so that p05 <= p95."""
    agg = bands.groupBy(*keys).agg(
        *[(period_mean(F.col(c), future) - period_mean(F.col(c), baseline)).alias(c) for c in ("p05", "p50", "p95")]
    )
    return agg.select(*keys, F.least("p05", "p95").alias("p05"), "p50", F.greatest("p05", "p95").alias("p95"))


def percentile_bands(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """min/p05/p17/p50/p83/p95/max per key."""
    return grouped_percentiles(
        df, keys, value, [0.0, 0.05, 0.17, 0.5, 0.83, 0.95, 1.0], ["min", "p05", "p17", "p50", "p83", "p95", "max"]
    )


def draw_summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean and p05/p10/p50/p90/p95 of draws per key."""
    quant = grouped_percentiles(df, keys, value, [0.05, 0.1, 0.5, 0.9, 0.95], ["p05", "p10", "p50", "p90", "p95"])
    mean = df.groupBy(*keys).agg(F.avg(value).alias("pred_mean"))
    return quant.join(mean, keys).withColumnRenamed("n", "n_draws")


def warming_by_run(df: DataFrame, run: list[str], rows: list[str], value: str, period1: tuple[int, int], period2: tuple[int, int]) -> DataFrame:
    """Mean over period 2 minus mean over period 1, averaged over the rows of a run."""
    per_row = period_change(df, [*run, *rows], value, period1, period2)
    return per_row.groupBy(*run).agg(F.avg("delta").alias("warming")).where("warming IS NOT NULL")


def exceedance(reference: DataFrame, samples: DataFrame, ref_value: str, value: str, keys: list[str], id_cols: list[str]) -> DataFrame:
    """Share of samples <= reference for each reference row, samples matched on ``keys``.

    Counts of distinct sample values and the reference values go through one
    running count in value order, so no sample meets every reference. Reference
    rows are stored once: they are found again by their value, and a mean that is
    computed anew may differ in its last digit.
    """
    ref = reference.where(F.col(ref_value).isNotNull()).select(*id_cols, *[k for k in keys if k not in id_cols], F.col(ref_value).cast("double").alias("_v"))
    ref = cut_lineage(ref)
    counts = samples.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"), F.lit(1).cast("bigint").alias("_c"))
    marks = counts.unionByName(ref.select(*keys, "_v", F.lit(0).cast("bigint").alias("_c"))).groupBy(*keys, "_v").agg(F.sum("_c").alias("_c"))
    ranked = running_sums(marks, keys, "_v", "_c", "_upto", "_all").where("_all > 0").select(*keys, "_v", (F.col("_upto") / F.col("_all")).alias("p"))
    return ref.join(ranked, [*keys, "_v"]).select(*id_cols, "p")


def probability_ratio(p_all: Column, p_nat: Column) -> Column:
    """Ratio where the natural probability is positive."""
    return F.when(p_nat > 0, p_all / p_nat)


def six_digits(c: Column) -> Column:
    """Six significant digits."""
    magnitude = F.floor(F.log10(F.abs(c)))
    scale = F.pow(F.lit(10.0), 5 - magnitude)
    return F.when(c == 0, 0.0).otherwise(F.bround(c * scale) / scale)


SUMMARY = [0.1, 0.33, 0.5, 0.67, 0.9]
SUMMARY_NAMES = ["p10", "p33", "p50", "p67", "p90"]


def probability_summary(df: DataFrame, keys: list[str], value: str, return_periods: bool = True) -> DataFrame:
    """p10/p33/p50/p67/p90 to six digits, with return periods 1/p."""
    q = grouped_percentiles(df, keys, value, SUMMARY, SUMMARY_NAMES)
    q = q.withColumns({c: six_digits(F.col(c)) for c in SUMMARY_NAMES})
    if return_periods:
        q = q.withColumns({f"rp_{c}": F.when(F.col(c) > 0, 1.0 / F.col(c)) for c in SUMMARY_NAMES})
    return q


def ratio_summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, extremes and percentiles of ratios to six digits."""
    q = grouped_percentiles(df, keys, value, [0.0, *SUMMARY, 1.0], ["min", *SUMMARY_NAMES, "max"])
    mean = df.groupBy(*keys).agg(F.avg(value).alias("mean"))
    out = q.join(mean, keys) if keys else q.join(F.broadcast(mean))  # one row each without keys
    return out.withColumns({c: six_digits(F.col(c)) for c in ["mean", "min", *SUMMARY_NAMES, "max"]})


def risk_lines(df: DataFrame, value: str, return_periods: list[int], time: tuple[str, ...] = ("year", "month")) -> DataFrame:
    """Percentile 100/RP of the ensemble per time step, one row per return period."""
    names = [f"_rp{i}" for i in range(len(return_periods))]
    q = grouped_percentiles(df, list(time), value, [1.0 / rp for rp in return_periods], names)
    rows = F.array(*[F.struct(F.lit(rp).alias("return_period"), F.col(n).alias("level")) for rp, n in zip(return_periods, names, strict=True)])
    return q.select(*time, F.inline(rows))


def histogram(df: DataFrame, keys: list[str], value: str, width: float = 0.2) -> DataFrame:
    """Counts in bins aligned to multiples of the width."""
    b = F.floor(F.col(value) / width)
    out = df.where(F.col(value).isNotNull()).groupBy(*keys, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return out.withColumns({"bin_left": F.col("bin") * width, "bin_right": (F.col("bin") + 1) * width})


def plume(df: DataFrame, member: list[str], value: str, point: str = "point_id") -> DataFrame:
    """Per-year min/median/max over members of the member's typical value.

    A member's value is the mean over points of the median over the months of
    the year.
    """
    by_point = df.groupBy(*member, "year", point).agg(F.percentile(value, 0.5).alias("_m"))  # twelve months at most
    by_member = by_point.groupBy(*member, "year").agg(F.avg("_m").alias("_v"))
    return grouped_percentiles(by_member, ["year"], "_v", [0.0, 0.5, 1.0], ["low", "mid", "high"])


def extreme_years(df: DataFrame, member: list[str], value: str, point_median_keys: list[str]) -> DataFrame:
    """Years of the largest and the smallest point median over all members."""
    med = grouped_percentiles(df, [*member, *point_median_keys], value, [0.5], ["_m"])
    order = F.struct(F.col("_m"), *[(-F.col(k)).alias(k) for k in point_median_keys])
    low = F.struct("_m", *point_median_keys)
    return med.agg(F.max_by("year", order).alias("year_of_max"), F.min_by("year", low).alias("year_of_min"))


def map_snapshot(df: DataFrame, point: list[str], value: str, year: int, month: int) -> DataFrame:
    """Field of one month; copies of a point are averaged."""
    return df.where((F.col("year") == year) & (F.col("month") == month)).groupBy(*point).agg(F.avg(value).alias(value))


def column_median(df: DataFrame, time: list[str], value: str) -> DataFrame:
    """Median over points (or members) per time step."""
    return grouped_percentiles(df, time, value, [0.5], ["median"])


def pooled_months(df: DataFrame, member: list[str], value: str, years: tuple[int, int], points: str = "point_id") -> DataFrame:
    """Region-mean samples of all members per calendar month, as long rows."""
    inside = df.where(F.col("year").between(*years))
    return inside.groupBy(*member, "year", "month").agg(F.avg(value).alias(value)).where(F.col(value).isNotNull())


def median_anchored(runs: DataFrame, group: list[str], run: str, value: str, size: int, seed: str = "0", strategy: str = "random") -> DataFrame:
    """Subset of ``size`` runs per group that keeps the median.

    Two runs around the median are fixed; equally many are drawn below and
    above, at random (hash order) or evenly spaced. Places in the order of values
    are counted over range partitions, and the draws of a side are its ``k`` rows
    of smallest hash, which Spark limits before the shuffle, so no task holds a
    group.
    """
    if size < 2 or size % 2:
        raise ValueError("the subset size must be even")
    if strategy not in ("random", "stratified"):
        raise ValueError(f"unknown strategy {strategy!r}")
    k = size // 2 - 1
    placed = row_numbers(runs, group, [value, run], "_r", "_n")
    mid = F.floor(F.col("_n") / 2)
    at = lambda step: F.max(F.when(F.col("_r") == mid + step, F.col(value)))
    middle = placed.groupBy(*group).agg(at(-1).alias("_lag"), at(0).alias("_v"), at(1).alias("_lead"))
    middle = middle.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], "_lag", "_v", "_lead")
    same = F.lit(True)
    for i, g in enumerate(group):
        same &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    v = F.col("_v")
    lower_closer = F.coalesce(F.col("_lead").isNull() | (F.abs((F.col("_lag") + v) / 2 - v) <= F.abs((v + F.col("_lead")) / 2 - v)), F.lit(False))
    lo = F.when((F.col("_n") % 2 == 0) | lower_closer, mid - 1).otherwise(mid)
    staged = placed.join(broadcast_if_small(middle), same).withColumn("_lo", lo)
    above = F.col("_n") - F.col("_lo") - 2
    short = (F.col("_n") < size) | (F.col("_lo") < k) | (above < k)
    enough = F.when(short, F.raise_error(F.lit("not enough runs around the median")).cast("boolean")).otherwise(True)
    staged = staged.withColumns({
        "_side": F.when(F.col("_r") < F.col("_lo"), -1).when(F.col("_r") > F.col("_lo") + 1, 1).otherwise(0),
        "_i": F.when(F.col("_r") < F.col("_lo"), F.col("_r")).otherwise(F.col("_r") - F.col("_lo") - 2),
        "_m": F.when(F.col("_r") < F.col("_lo"), F.col("_lo")).otherwise(above),
    }).where(enough)
    fixed, pool = staged.where("_side = 0"), staged.where("_side <> 0")
    if strategy == "random":
        key = hash32(key_text(seed, *[F.col(g) for g in group], F.col(run)))
        drawn = pool.withColumn("_h", F.row_number().over(Window.partitionBy(*group, "_side").orderBy(key, run))).where(F.col("_h") <= k)
    elif k == 0:
        drawn = pool.where(F.lit(False))
    elif k == 1:
        drawn = pool.where("_i = 0")
    else:
        picks = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (F.col("_m") - 1) / F.lit(k - 1)))
        drawn = pool.where(F.array_contains(picks, F.col("_i").cast("double")))
    return fixed.select(*runs.columns).unionByName(drawn.select(*runs.columns))


def random_search(runs: DataFrame, group: list[str], run: str, value: str, size: int, attempts: int, seed: str = "0") -> DataFrame:
    """Best of ``attempts`` random subsets by distance of the medians.

    Draws are hash ranks per attempt. Ties keep the earlier attempt.
    """
    full = grouped_percentiles(runs, group, value, [0.5], ["full_median"]).withColumnRenamed("n", "n_runs")
    tries = runs.where(F.col(value).isNotNull()).withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(attempts))))
    key = hash32(key_text(seed, *[F.col(g) for g in group], F.col("attempt"), F.col(run)))
    w = Window.partitionBy(*group, "attempt").orderBy(key, run)
    picked = tries.withColumn("_h", F.row_number().over(w)).where(F.col("_h") <= size)
    med = picked.groupBy(*group, "attempt").agg(F.percentile(value, 0.5).alias("subset_median"), F.sort_array(F.collect_list(run)).alias("runs"))
    scored = med.join(broadcast_if_small(full), group).withColumn("diff", F.abs(F.col("subset_median") - F.col("full_median")))
    return scored.groupBy(*group).agg(
        F.min_by(F.struct("attempt", "subset_median", "full_median", "diff", "runs"), F.struct(F.round("diff", 9), "attempt")).alias("b")
    ).select(*group, "b.*")


def resample_residuals(conditioned: DataFrame, fitted: DataFrame, group: list[str], n: int, seed: str, probs, names: list[str]) -> DataFrame:
    """Quantiles of random conditioned value + random residual over n draws.

    ``conditioned`` holds (group, value); ``fitted`` holds (group, truth, fit).
    Rows are numbered in value order and each draw picks a number by hash.
    """
    base = row_numbers(conditioned.where("value IS NOT NULL").select(*group, "value"), group, ["value"], "_i", "_nb")
    resid = fitted.select(*group, (F.col("truth") - F.col("fit")).alias("resid")).where("resid IS NOT NULL")
    resid = row_numbers(resid, group, ["resid"], "_j", "_nr")
    sizes = base.groupBy(*group).agg(F.max("_nb").alias("_nb")).join(resid.groupBy(*group).agg(F.max("_nr").alias("_nr")), group)
    g = [F.col(c) for c in group]
    draws = sizes.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(n)))).repartition(*group, "draw")
    draws = draws.withColumns({
        "_i": hash_mod(key_text(seed, "base", *g, F.col("draw")), F.col("_nb")),
        "_j": hash_mod(key_text(seed, "resid", *g, F.col("draw")), F.col("_nr")),
    }).select(*group, "draw", "_i", "_j")
    sample = (
        draws.join(broadcast_if_small(base.select(*group, "_i", "value")), [*group, "_i"])
        .join(broadcast_if_small(resid.select(*group, "_j", "resid")), [*group, "_j"])
        .withColumn("sample", F.col("value") + F.col("resid"))
    )
    return grouped_percentiles(sample, group, "sample", probs, names)


def value_limits(df: DataFrame, keys: list[str], value: str, pad: float = 1e-6) -> DataFrame:
    """Finite min and max, opened a little where they are equal."""
    agg = df.groupBy(*keys).agg(F.min(value).alias("_a"), F.max(value).alias("_b"))
    equal = F.col("_a") == F.col("_b")
    return agg.select(
        *keys, F.when(equal, F.col("_a") - pad).otherwise(F.col("_a")).alias("vmin"), F.when(equal, F.col("_b") + pad).otherwise(F.col("_b")).alias("vmax")
    )
