"""Band-limited periodograms of cell series.

A cell's series is one array of bounded length (its months), so the transform
runs on batches of arrays with numpy's FFT instead of unfolding time x frequency
rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridseries.session import cut_lineage

MIN_LENGTH = 8


def band_indices(n: int, period_min: int, period_max: int | None) -> tuple[int, int]:
    """First and last frequency index of a period band for n steps."""
    longest = max(2, min(int(period_max) if period_max else n // 2, n // 2))
    first = max(1, n // longest)
    return first, max(first, n // max(2, int(period_min)))


def _power(times, values, lo: int, hi: int, period_min: int, period_max: int | None) -> list[float] | None:
    n = hi - lo + 1
    if n < MIN_LENGTH:
        return None
    x = np.full(n, np.nan)
    x[np.asarray(times, dtype=int) - lo] = np.asarray(values, dtype=float)
    seen = np.isfinite(x)
    x = np.where(seen, x - x[seen].mean() if seen.any() else 0.0, 0.0)
    first, last = band_indices(n, period_min, period_max)
    spec = np.abs(np.fft.rfft(x * np.hanning(n)))[first: last + 1] ** 2
    return (spec / max(spec.sum(), 1e-12)).tolist()


def power_udf(period_min: int, period_max: int | None):
    """Vectorised spectrum of (times, values, first month, last month)."""
    @F.pandas_udf("array<double>")
    def power(t: pd.Series, v: pd.Series, lo: pd.Series, hi: pd.Series) -> pd.Series:
        return pd.Series([_power(a, b, c, d, period_min, period_max) for a, b, c, d in zip(t, v, lo, hi, strict=True)])

    return power


def periodogram(df: DataFrame, cell: list[str], value: str, period_min: int = 2, period_max: int | None = 120) -> DataFrame:
    """(cell, n, kmin, power[]) on the time axis of the whole table.

    Months without a value count as zero after centring. Series shorter than
    eight months have a null spectrum.
    """
    axis = df.agg(F.min("month_idx").alias("_lo"), F.max("month_idx").alias("_hi"))
    rows = df.where(F.col(value).isNotNull()).groupBy(*cell).agg(
        F.collect_list("month_idx").alias("_t"), F.collect_list(value).alias("_v")
    )

    power = power_udf(period_min, period_max)
    joined = rows.join(F.broadcast(axis))  # one row
    n = F.col("_hi") - F.col("_lo") + 1
    longest = F.greatest(F.lit(2), F.least(F.lit(period_max) if period_max else F.floor(n / 2), F.floor(n / 2)))
    return joined.select(
        *cell, n.alias("n"), F.greatest(F.lit(1), F.floor(n / longest)).alias("kmin"), power("_t", "_v", "_lo", "_hi").alias("power")
    )


def spectral_rmse(a: DataFrame, b: DataFrame, cell: list[str], value: str, period_min: int = 2, period_max: int | None = 120) -> DataFrame:
    """RMSE of two normalised spectra per cell, on the months both tables hold."""
    keep = [*cell, "month_idx", value]
    rows = cut_lineage(a.select(F.lit("a").alias("_side"), *keep).unionByName(b.select(F.lit("b").alias("_side"), *keep)))
    times = rows.groupBy("month_idx").agg(F.count_distinct("_side").alias("_n")).where("_n = 2").select("month_idx")
    power = periodogram(rows.join(times, "month_idx", "left_semi"), ["_side", *cell], value, period_min, period_max)
    of = lambda s: F.first(F.when(F.col("_side") == s, F.struct("power")), True)
    both = power.groupBy(*cell).agg(of("a").alias("_a"), of("b").alias("_b")).where("_a IS NOT NULL AND _b IS NOT NULL")
    both = both.select(*cell, F.col("_a.power").alias("pa"), F.col("_b.power").alias("pb"))
    total = F.aggregate(F.zip_with("pa", "pb", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return both.select(*cell, F.sqrt(total / F.size("pa")).alias("spec_rmse"))


def dominant_period(df: DataFrame, cell: list[str], value: str, period_min: int = 2, period_max: int | None = 120) -> DataFrame:
    """Period (months) with the largest power; the first one among equals."""
    p = periodogram(df, cell, value, period_min, period_max)
    peak = F.array_position(F.col("power"), F.array_max("power")) - 1
    return p.select(*cell, (F.col("n") / (F.col("kmin") + peak)).alias("dominant_period"))
