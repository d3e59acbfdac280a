"""Robust local regression of long series in chunks with halos.

Every pass fits a tricube-weighted line at each sample, over its nearest ``span``
samples. Samples are dealt to chunks, each with the neighbours its windows reach,
so tasks see bounded pieces; between passes the residuals' median of each series
is found by counts and turns into bisquare weights.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridseries.functions.missing import is_finite
from gridseries.functions.quantiles import grouped_percentiles
from gridseries.functions.ranks import row_numbers
from gridseries.session import cut_lineage

CHUNK = 1024


def tricube(r: np.ndarray) -> np.ndarray:
    return np.where(r >= 0.999, 0.0, np.where(r <= 0.001, 1.0, (1 - r**3) ** 3))


def lines_at(at: np.ndarray, first: int, y: np.ndarray, weight: np.ndarray, size: int, span: int) -> np.ndarray:
    """Local lines at the places ``at`` of a series of ``size`` samples; ``y`` and ``weight`` begin at place ``first``."""
    left = np.clip(at - (span - 1) // 2, 0, size - span)
    xs = left[:, None] + np.arange(span)
    apart = np.abs(xs - at[:, None]).astype(float)
    radius = apart.max(axis=1, keepdims=True)
    w = tricube(apart / np.where(radius > 0, radius, 1.0)) * weight[xs - first]
    total = w.sum(axis=1, keepdims=True)
    w = w / np.where(total > 0, total, 1.0)
    own = y[xs - first]
    mean_x = (w * xs).sum(axis=1, keepdims=True)
    variance = (w * (xs - mean_x) ** 2).sum(axis=1)
    slope = (w * (xs - mean_x) * own).sum(axis=1) / np.where(variance > 1e-12, variance, np.inf)
    return np.where(total[:, 0] > 0, (w * own).sum(axis=1) + slope * (at - mean_x[:, 0]), y[at - first])


def loess(df: DataFrame, series: list[str], value: str, out: str, span: int, passes: int = 3, time: str = "month_idx", chunk: int = CHUNK) -> DataFrame:
    """series, time, value and ``out``: local regression over ``span`` samples with ``passes`` reweightings.

    Rows without a finite value get null and don't take part: their neighbours
    in time follow each other.
    """
    chunk = max(chunk, span)
    rows = df.select(*series, time, F.col(value).cast("double").alias(value))
    numbered = row_numbers(rows.where(is_finite(F.col(value))), series, [time], "_at", "_n")
    state = cut_lineage(numbered.withColumn("_w", F.lit(1.0)))
    fitted_schema = numbered.withColumn("_fit", F.lit(0.0)).schema

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_at")
        own = pdf[pdf["_at"] // chunk == pdf["_chunk"]]
        size = int(own["_n"].iloc[0])
        line = lines_at(own["_at"].to_numpy(), int(pdf["_at"].iloc[0]), pdf[value].to_numpy(), pdf["_w"].to_numpy(), size, min(size, span))
        return own.assign(_fit=line)[[f.name for f in fitted_schema]]

    last = F.floor((F.col("_n") - 1) / chunk)
    reach = F.sequence(F.greatest(F.floor((F.col("_at") - span + 1) / chunk), F.lit(0)), F.least(F.floor((F.col("_at") + span - 1) / chunk), last))
    for turn in range(passes + 1):
        dealt = state.withColumn("_chunk", F.explode(reach))
        fitted = cut_lineage(dealt.groupBy(*series, "_chunk").applyInPandas(fit, fitted_schema))
        if turn == passes:
            break
        residual = F.abs(F.col(value) - F.col("_fit"))
        middle = grouped_percentiles(fitted.withColumn("_r", residual), series, "_r", [0.5], ["_median"])
        middle = middle.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(series)], "_median")
        same = F.lit(True)
        for i, c in enumerate(series):
            same &= F.col(c).eqNullSafe(F.col(f"_k{i}"))
        u = F.when(F.col("_median") > 0, residual / (6.0 * F.col("_median"))).otherwise(F.when(residual > 0, 1.0).otherwise(0.0))
        square = 1.0 - u * u
        bisquare = F.when(u >= 0.999, 0.0).when(u <= 0.001, 1.0).otherwise(square * square)
        state = fitted.join(middle, same).select(*numbered.columns, bisquare.alias("_w"))
    missing = rows.where(~is_finite(F.col(value)) | F.col(value).isNull()).withColumn(out, F.lit(None).cast("double"))
    return fitted.select(*series, time, value, F.col("_fit").alias(out)).unionByName(missing)
