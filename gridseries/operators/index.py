"""Standardised index: rolling sums, month-wise fits, transforms.

All windows share the partitioning of the series (point, or member and point):
after the first exchange on ``series`` the month-wise windows need no other one.
A (series, month) group holds one row per year, a pooled (point, month) group
one row per member and year, so no window grows with the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridseries.functions.glo import glo_cdf, glo_params, lmoments, norm_ppf, pwm
from gridseries.functions.missing import with_settled

SIGMA_FLOOR = 1e-6
MIN_FIT_ROWS = 10
RECIPE_CLIP = 1e-6
ENSEMBLE_CLIP = 1e-15


def rolling_sum(df: DataFrame, series: list[str], value: str, k: int, out: str) -> DataFrame:
    """Trailing k-month sum, null unless all k months hold a value.

    The range frame on month_idx makes gaps count as missing, so the months need
    not be filled up first. Rows without a full window are kept as null.
    """
    w = Window.partitionBy(*series).orderBy("month_idx").rangeBetween(-(k - 1), 0)
    return df.withColumn(out, F.when(F.count(value).over(w) == k, F.sum(value).over(w)))


def drop_leading(df: DataFrame, series: list[str], value: str) -> DataFrame:
    """Drop the months of a series before its first value."""
    w = Window.partitionBy(*series).orderBy("month_idx")
    return df.withColumn("_seen", F.count(value).over(w)).where(F.col("_seen") > 0).drop("_seen")


def zscore_monthwise(df: DataFrame, series: list[str], value: str, out: str, calibration: Column | None = None) -> DataFrame:
    """(x-mu)/(sigma+1e-6) per series and calendar month.

    Moments come from calibration rows; a month without any uses all rows.
    """
    w = Window.partitionBy(*series, "month")
    x = F.col(value)
    mu, sd = F.avg(x).over(w), F.stddev_pop(x).over(w)
    if calibration is not None:
        inside = F.when(calibration, x)
        mu = F.coalesce(F.avg(inside).over(w), mu)
        sd = F.coalesce(F.stddev_pop(inside).over(w), sd)
    return df.withColumn(out, (x - mu) / (sd + SIGMA_FLOOR))


def glo_index(
    df: DataFrame, group: list[str], value: str, out: str, calibration: Column | None = None, clip: float = RECIPE_CLIP,
    keep_params: bool = False,
) -> DataFrame:
    """Probit of the fitted distribution function within each group.

    Fit rows are the calibration rows if there are at least ten, else all rows
    with a value. Without a usable fit the value is a z-score over all rows.
    """
    w = Window.partitionBy(*group)
    by_value = w.orderBy(F.col(value).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    has = F.col(value).isNotNull()
    cal = has & calibration if calibration is not None else has
    staged = (
        df.withColumn("_cal", F.coalesce(cal, F.lit(False)))
        .withColumn("_ncal", F.count(F.when(F.col("_cal"), 1)).over(w))
        .withColumn("_fit", F.when(F.col("_ncal") >= MIN_FIT_ROWS, F.col("_cal")).otherwise(has))
        .withColumn("_rank", F.count(F.when(F.col("_fit"), 1)).over(by_value) - 1)
        .withColumn("_n", F.count(F.when(F.col("_fit"), 1)).over(w))
    )
    terms = pwm(F.col("_rank"), F.col(value), F.col("_n"))
    sums = {f"_b{i}": F.sum(F.when(F.col("_fit"), t)).over(w) for i, t in enumerate(terms)}
    sums["_mu"] = F.avg(value).over(w)
    sums["_sd"] = F.stddev_pop(value).over(w) + SIGMA_FLOOR
    staged = staged.withColumns(sums)
    l1, l2, l3 = lmoments(F.col("_b0"), F.col("_b1"), F.col("_b2"))
    staged = staged.withColumns({"_l1": l1, "_l2": l2, "_t3": F.when(l2 > 0, l3 / l2)})
    fitted = glo_params(F.col("_l1"), F.col("_l2"), F.col("_t3"))
    enough = F.col("_n") >= 3
    staged = staged.withColumns({k: F.when(enough, c) for k, c in fitted.items()})
    cdf = glo_cdf(F.col(value), F.col("xi"), F.col("alpha"), F.col("kappa"))
    staged = staged.withColumn("_p", F.least(F.greatest(cdf, F.lit(clip)), F.lit(1.0 - clip)))
    z = (F.col(value) - F.col("_mu")) / F.col("_sd")
    index = F.when(has, F.when(F.col("alpha").isNotNull(), norm_ppf(F.col("_p"))).otherwise(z))
    res = with_settled(staged, {out: index})
    drop = ["_cal", "_ncal", "_fit", "_rank", "_n", "_b0", "_b1", "_b2", "_mu", "_sd", "_l1", "_l2", "_t3", "_p"]
    return res.drop(*drop, *([] if keep_params else ["xi", "alpha", "kappa"]))


def pwm_table(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """n, b0, b1, b2 and the L-moments per group (at least three values)."""
    w = Window.partitionBy(*group)
    ranked = df.where(F.col(value).isNotNull()).withColumns(
        {"_r": F.row_number().over(w.orderBy(value)) - 1, "_n": F.count(F.lit(1)).over(w)}
    )
    terms = pwm(F.col("_r"), F.col(value), F.col("_n"))
    agg = ranked.where(F.col("_n") >= 3).groupBy(*group).agg(
        F.max("_n").alias("n"), *[F.sum(t).alias(f"b{i}") for i, t in enumerate(terms)],
    )
    l1, l2, l3 = lmoments(F.col("b0"), F.col("b1"), F.col("b2"))
    return agg.withColumns({"lam1": l1, "lam2": l2, "lam3": l3, "tau3": F.when(l2 != 0, l3 / l2)})


def fit_baseline(df: DataFrame, group: list[str], value: str, min_rows: int = MIN_FIT_ROWS) -> DataFrame:
    """mu, sigma (population, +1e-6), n and xi/alpha/kappa per group.

    The distribution is fitted only where there are ``min_rows`` values that are
    not all equal.
    """
    w = Window.partitionBy(*group)
    ranked = df.where(F.col(value).isNotNull()).withColumns(
        {"_r": F.row_number().over(w.orderBy(value)) - 1, "_n": F.count(F.lit(1)).over(w)}
    )
    terms = pwm(F.col("_r"), F.col(value), F.col("_n"))
    agg = ranked.groupBy(*group).agg(
        F.max("_n").alias("n"),
        F.avg(value).alias("mu"),
        (F.stddev_pop(value) + SIGMA_FLOOR).alias("sigma"),
        *[F.sum(F.when(F.col("_n") >= 3, t)).alias(f"_b{i}") for i, t in enumerate(terms)],
    )
    l1, l2, l3 = lmoments(F.col("_b0"), F.col("_b1"), F.col("_b2"))
    staged = agg.withColumns({"_l1": l1, "_l2": l2, "_t3": F.when(l2 > 0, l3 / l2)})
    enough = (F.col("n") >= min_rows) & (F.col("sigma") > SIGMA_FLOOR)
    fitted = {k: F.when(enough, c) for k, c in glo_params(F.col("_l1"), F.col("_l2"), F.col("_t3")).items()}
    return with_settled(staged, fitted).select(*group, "n", "mu", "sigma", "xi", "alpha", "kappa")


def apply_baseline(
    df: DataFrame, params: DataFrame, group: list[str], value: str, out: str, fit: str = "loglogistic", clip: float = ENSEMBLE_CLIP
) -> DataFrame:
    """Standardise with a parameter table; z-score where it holds no fit."""
    x = F.col(value)
    joined = df.join(params.drop("n"), group, "left")
    sigma = F.when(F.col("sigma") > 0, F.col("sigma")).otherwise(1.0)
    z = (x - F.col("mu")) / sigma
    if fit == "zscore":
        return joined.withColumn(out, z).drop("mu", "sigma", "xi", "alpha", "kappa")
    cdf = glo_cdf(x, F.col("xi"), F.col("alpha"), F.col("kappa"), support=1e-15)
    joined = joined.withColumn("_p", F.least(F.greatest(cdf, F.lit(clip)), F.lit(1.0 - clip)))
    index = F.when(F.col("alpha").isNotNull(), norm_ppf(F.col("_p"))).otherwise(z)
    return with_settled(joined, {out: F.when(x.isNotNull(), index)}).drop("_p", "mu", "sigma", "xi", "alpha", "kappa")


def shared_index(
    factual: DataFrame, target: DataFrame, group: list[str], value: str, out: str, baseline: tuple[int, int]
) -> DataFrame:
    """Index of target rows fitted on factual baseline years.

    Both sets enter one window: with too few baseline rows, or without a fit,
    the statistics come from the values of both.
    """
    cols = [c for c in target.columns if c in factual.columns]
    both = factual.select(*cols, F.lit(False).alias("_target")).unionByName(target.select(*cols, F.lit(True).alias("_target")))
    cal = ~F.col("_target") & F.col("year").between(*baseline)
    return glo_index(both, group, value, out, cal).where("_target").drop("_target")
