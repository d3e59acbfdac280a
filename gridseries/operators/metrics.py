"""Goodness of fit: errors of aligned fields, skill tables and audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridseries.functions.missing import is_finite, ratio
from gridseries.functions.quantiles import broadcast_if_small, grouped_percentiles, percentiles
from gridseries.operators.spatial import cos_lat, weighted_mean


def align(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Inner alignment of two series: keys, a, b."""
    left = a.select(*keys, F.col(value).alias("a"))
    return left.join(b.select(*keys, F.col(value).alias("b")), keys)


def error_columns(a: Column, b: Column) -> dict[str, Column]:
    """RMSE and mean deviation of a-b as aggregates."""
    d = a - b
    return {"rmse": F.sqrt(F.avg(d * d)), "dev": F.avg(d)}


def rmse_and_deviation(pairs: DataFrame, keys: list[str]) -> DataFrame:
    cols = error_columns(F.col("a"), F.col("b"))
    return pairs.groupBy(*keys).agg(*[c.alias(k) for k, c in cols.items()])


def time_mean_rmse(pairs: DataFrame, keys: list[str], point: list[str], lat: str = "lat") -> DataFrame:
    """Area-weighted RMSE of time-mean fields."""
    mean = pairs.groupBy(*keys, *point, lat).agg(F.avg("a").alias("a"), F.avg("b").alias("b"))
    d = F.col("a") - F.col("b")
    return mean.groupBy(*keys).agg(F.sqrt(weighted_mean(d * d, cos_lat(F.col(lat)))).alias("rmse"))


def ensemble_mean_rmse(a: DataFrame, b: DataFrame, keys: list[str], time: list[str], value: str) -> DataFrame:
    """RMSE between the ensemble means of two sets of members."""
    def mean(df):
        return df.groupBy(*keys, *time).agg(F.avg(value).alias(value))

    return rmse_and_deviation(align(mean(a), mean(b), [*keys, *time], value), keys)


CENTILES = [i / 100 for i in range(1, 100)]


def quantile_rmse(pairs: DataFrame, cell: list[str], probs=None) -> DataFrame:
    """L2 distance of the quantile functions per cell (a cell holds one row per month)."""
    probs = probs or CENTILES
    q = pairs.groupBy(*cell).agg(percentiles(F.col("a"), probs).alias("qa"), percentiles(F.col("b"), probs).alias("qb"))
    total = F.aggregate(F.zip_with("qa", "qb", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return q.select(*cell, F.sqrt(total / len(probs)).alias("qrmse"))


def paired_difference_sd(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Sample standard deviation of y-x over finite pairs; null below two pairs."""
    ok = is_finite(F.col(x)) & is_finite(F.col(y))
    agg = df.where(ok).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.stddev_samp(F.col(y) - F.col(x)).alias("sd"))
    return agg.withColumn("sd", F.when(F.col("n") >= 2, F.col("sd")))


def count_audit(df: DataFrame) -> DataFrame:
    """Counts per (version, domain) and (version, experiment) with sub-totals."""
    parts = []
    for kind in ("metricdomain", "experiment_id"):
        r = df.rollup("version_tag", kind).agg(F.count(F.lit(1)).alias("n"))
        parts.append(r.select(F.lit(kind).alias("kind"), "version_tag", F.col(kind).alias("item"), "n"))
    return parts[0].unionByName(parts[1])


def overview(df: DataFrame, hierarchy: list[str], value: str = "value") -> DataFrame:
    """Median, extremes and count per hierarchy level."""
    return grouped_percentiles(df, hierarchy, value, [0.0, 0.5, 1.0], ["min", "median", "max"])


def scan_summary(df: DataFrame, range_cols: list[str]) -> DataFrame:
    """Range, scenario sets and train/test counts per variable."""
    lo, hi = F.least(*range_cols), F.greatest(*range_cols)
    test = F.col("is_test")
    return df.groupBy("variable").agg(
        F.min(lo).alias("value_min"), F.max(hi).alias("value_max"),
        F.sort_array(F.collect_set("model")).alias("models"), F.sort_array(F.collect_set("scenario")).alias("scenarios"),
        F.sort_array(F.collect_set(F.when(~test, F.col("scenario")))).alias("training_scenarios"),
        F.sort_array(F.collect_set(F.when(test, F.col("scenario")))).alias("test_scenarios"),
        F.count(F.lit(1)).alias("rows"), F.sum(test.cast("bigint")).alias("test_rows"),
    )


def skill_table(df: DataFrame, keys: list[str], lo: str = "pred_p10", hi: str = "pred_p90") -> DataFrame:
    """rmse, bias, r2, means, interval width and coverage per key."""
    ok = is_finite(F.col("obs")) & is_finite(F.col("pred_mean"))
    obs, pred = F.when(ok, F.col("obs")), F.when(ok, F.col("pred_mean"))
    err = pred - obs
    agg = df.groupBy(*keys).agg(
        F.max("is_test").alias("is_test"), F.avg("obs").alias("obs_mean"), F.avg("pred_mean").alias("pred_mean"),
        F.avg(F.col(hi) - F.col(lo)).alias("interval_width_mean"),
        F.avg(F.coalesce(F.col("obs").between(F.col(lo), F.col(hi)), F.lit(False)).cast("double")).alias("coverage"),
        F.count(obs).alias("n"), F.sqrt(F.avg(err * err)).alias("rmse"), F.avg(err).alias("bias"),
        F.sum(err * err).alias("_res"), F.var_pop(obs).alias("_var"),
    )
    enough = F.col("n") >= 2
    r2 = 1.0 - F.col("_res") / (F.col("n") * F.col("_var"))
    return agg.withColumns({
        "rmse": F.when(enough, F.col("rmse")), "bias": F.when(enough, F.col("bias")), "r2": F.when(enough & (F.col("_var") > 0), r2)
    }).drop("_res", "_var")


def flag_outliers(table: DataFrame, variable: str = "variable", k: float = 1.5, minimum: int = 4) -> DataFrame:
    """rmse above median + 1.5 IQR among held-out rows of a variable (four or more)."""
    q = grouped_percentiles(table.where("is_test"), [variable], "rmse", [0.25, 0.5, 0.75], ["_q1", "_q2", "_q3"])
    limit = q.select(variable, F.when(F.col("n") >= minimum, F.col("_q2") + k * (F.col("_q3") - F.col("_q1"))).alias("_limit"))
    joined = table.join(broadcast_if_small(limit), variable, "left")
    flag = F.coalesce(F.col("is_test") & (F.col("rmse") > F.col("_limit")), F.lit(False))
    return joined.withColumn("rmse_outlier", flag).drop("_limit")


def annual_blocks(df: DataFrame, keys: list[str], values: list[str], complete: bool = True) -> DataFrame:
    """Means of twelve-month blocks of month_idx; short blocks dropped if asked."""
    year = F.floor(F.col("month_idx") / 12).alias("year_idx")
    agg = df.groupBy(*keys, year).agg(*[F.avg(v).alias(v) for v in values], F.count(F.lit(1)).alias("_n"))
    return (agg.where("_n = 12") if complete else agg).drop("_n")


def forcing_response(predictions: DataFrame, forcing: DataFrame, keys: list[str]) -> DataFrame:
    """Annual forcing, observation and prediction on common years."""
    resp = annual_blocks(predictions, keys, ["obs", "pred_mean"], complete=False)
    drive = annual_blocks(forcing, ["scenario"], ["forcing"], complete=False)
    return resp.join(broadcast_if_small(drive), ["scenario", "year_idx"])


def mean_rmse(df: DataFrame, unit: list[str], keys: list[str]) -> DataFrame:
    """RMSE per unit, then its mean per key."""
    err = F.col("pred_mean") - F.col("obs")
    per = df.groupBy(*unit).agg(F.sqrt(F.avg(err * err)).alias("_rmse"))
    return per.groupBy(*keys).agg(F.avg("_rmse").alias("mean_rmse"), F.count(F.lit(1)).alias("n"))


def inverse_normalise(df: DataFrame, scale: DataFrame, variable: str, value: str, out: str) -> DataFrame:
    """(y - post) / pre with a table of one row per variable."""
    joined = df.join(broadcast_if_small(scale), variable)
    return joined.withColumn(out, ratio(F.col(value) - F.col("post"), F.col("pre"))).drop("pre", "post")


def null_any(cols: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols])
