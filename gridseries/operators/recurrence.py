"""Linear recurrences over long series as a scan of affine maps.

A difference equation of order n carries n numbers from sample to sample, and a
run of samples maps that state to another by an affine map. Chunks of a series
compute their map in parallel; maps of neighbouring chunks compose, so the state
at every chunk's start follows from prefix sums of vectors (full chunks share one
matrix), and a second look at the chunks gives the output. All of it is built-in
expressions; a series of any length spreads over many tasks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridseries.functions.missing import is_finite
from gridseries.functions.ranks import row_numbers
from gridseries.session import cut_lineage

CHUNK = 256


#: One second-order (or first-order) section: numerator and denominator, the latter beginning with 1.
Section = tuple[tuple[float, ...], tuple[float, ...]]


def cascade(sections: list[Section], state: list, x) -> tuple[list, object]:
    """State after one input of a chain of sections, and the output; for numbers and columns alike.

    Sections are kept apart, since the coefficients of their product would lose
    digits for low cut-offs.
    """
    after, at = [], 0
    for b, a in sections:
        n = len(a) - 1
        own = state[at : at + n]
        y = b[0] * x + own[0]
        after += [b[k + 1] * x + (own[k + 1] if k + 1 < n else 0.0) - a[k + 1] * y for k in range(n)]
        x, at = y, at + n
    return after, x


def state_size(sections: list[Section]) -> int:
    return sum(len(a) - 1 for _, a in sections)


def state_matrix(sections: list[Section]) -> np.ndarray:
    """Linear map of the state by one zero input."""
    n = state_size(sections)
    return np.array([cascade(sections, list(row), 0.0)[0] for row in np.eye(n)]).T


def steady_state(sections: list[Section]) -> np.ndarray:
    """State that a constant input of one leaves unchanged."""
    n = state_size(sections)
    driven = np.array(cascade(sections, [0.0] * n, 1.0)[0])
    return np.linalg.solve(np.eye(n) - state_matrix(sections), driven)


def _combined(matrix: np.ndarray, vector: list[Column]) -> list[Column]:
    return [sum((F.lit(float(m)) * v for m, v in zip(row, vector, strict=True)), F.lit(0.0)) for row in matrix]


def recursive_filter(df: DataFrame, series: list[str], pos: str, value: str, out: str, sections: list[Section], keep: list[str] = (), chunk: int = CHUNK) -> DataFrame:
    """series, pos, value, keep and ``out``: the chain of sections along ``pos``, which counts from 0 without gaps.

    The filter starts in the steady state of the first sample.
    """
    n = state_size(sections)
    names = [f"z{k}" for k in range(n)]
    level = steady_state(sections)

    def step(state: Column, x: Column) -> tuple[list[Column], Column]:
        return cascade(sections, [state[z] for z in names], x)

    def state(values: list[Column]) -> list[Column]:
        return [v.alias(z) for z, v in zip(names, values, strict=True)]

    samples = F.array_sort(F.collect_list(F.struct(F.col(pos), F.col(value), *keep)))
    chunks = df.groupBy(*series, F.floor(F.col(pos) / chunk).alias("_chunk")).agg(samples.alias("_xs"))
    end = F.aggregate("_xs", F.struct(*state([F.lit(0.0)] * n)), lambda s, x: F.struct(*state(step(s, x[value])[0])))
    chunks = cut_lineage(chunks.withColumn("_end", end))
    most = chunks.agg(F.max("_chunk")).first()[0] or 0
    if most:
        power = np.linalg.matrix_power(state_matrix(sections), chunk)
        first = F.col("_xs")[0][value]
        started = [F.col("_end")[z] + F.when(F.col("_chunk") == 0, first * float(v)).otherwise(0.0) for z, v in zip(names, power @ level, strict=True)]
        scan = chunks.select(*series, "_chunk", *[c.alias(f"_s{k}") for k, c in enumerate(started)])
        # Each round doubles the number of chunks that a vector accounts for.
        along = Window.partitionBy(*series).orderBy("_chunk")
        reach = 1
        sums = [f"_s{k}" for k in range(n)]
        while reach <= most:
            scan = scan.withColumns({f"_e{k}": F.coalesce(F.lag(s, reach).over(along), F.lit(0.0)) for k, s in enumerate(sums)})
            more = _combined(power, [F.col(f"_e{k}") for k in range(n)])
            scan = scan.withColumns({s: F.col(s) + m for s, m in zip(sums, more, strict=True)})
            reach, power = 2 * reach, power @ power
        scan = scan.select(*[F.col(c).alias(f"_g{k}") for k, c in enumerate(series)], (F.col("_chunk") + 1).alias("_next"), *sums)
        same = F.col("_chunk") == F.col("_next")
        for k, c in enumerate(series):
            same &= F.col(c).eqNullSafe(F.col(f"_g{k}"))
        chunks = chunks.join(scan, same, "left")
    else:
        chunks = chunks.withColumns({f"_s{k}": F.lit(None).cast("double") for k in range(n)})
    start = [F.when(F.col("_chunk") == 0, F.col("_xs")[0][value] * float(v)).otherwise(F.col(f"_s{k}")) for k, v in enumerate(level)]
    outputs = F.aggregate(
        "_xs", F.struct(*state(start), F.array().cast("array<double>").alias("ys")),
        lambda s, x: F.struct(*state(step(s, x[value])[0]), F.concat(s["ys"], F.array(step(s, x[value])[1])).alias("ys")),
        lambda s: s["ys"],
    )
    pairs = chunks.select(*series, F.explode(F.arrays_zip(F.col("_xs").alias("x"), outputs.alias("y"))).alias("_p"))
    return pairs.select(*series, *[F.col(f"_p.x.{c}").alias(c) for c in (pos, value, *keep)], F.col("_p.y").alias(out))


def lowpass_removed(df: DataFrame, series: list[str], value: str, out: str, sections: list[Section], time: str = "month_idx", chunk: int = CHUNK) -> DataFrame:
    """series, time, value and ``out``: the value minus its trend, filtered forward and backward.

    The series is extended at both ends by point reflection over three times the
    filter's length, its order plus one (less where it is shorter). Rows without a finite value get
    null and don't take part: their neighbours in time follow each other.
    """
    x = F.col(value).cast("double")
    rows = df.select(*series, time, x.alias(value))
    present = row_numbers(rows.where(is_finite(F.col(value))), series, [time], "_at", "_n")
    ends = present.groupBy(*series).agg(F.min_by(value, "_at").alias("_x0"), F.max_by(value, "_at").alias("_x1"))
    ends = ends.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(series)], "_x0", "_x1")
    same = F.lit(True)
    for i, c in enumerate(series):
        same &= F.col(c).eqNullSafe(F.col(f"_k{i}"))
    pad = F.least(F.lit(3 * (state_size(sections) + 1)), F.col("_n") - 1)
    at, last = F.col("_at"), F.col("_n") - 1

    def copy(place: Column, v: Column, own: bool) -> Column:
        return F.struct(place.cast("bigint").alias("_p"), v.alias("_x"), F.lit(own).alias("_own"))

    copies = F.array(
        copy(at + pad, F.col(value), True),
        F.when((at >= 1) & (at <= pad), copy(pad - at, 2.0 * F.col("_x0") - F.col(value), False)),
        F.when((at >= last - pad) & (at < last), copy(pad + last + (last - at), 2.0 * F.col("_x1") - F.col(value), False)),
    )
    wide = present.join(ends, same).select(*series, time, (F.col("_n") + 2 * pad).alias("_total"), F.explode(F.array_compact(copies)).alias("_c"))
    flat = wide.select(*series, time, "_total", "_c.*")
    forward = recursive_filter(flat, series, "_p", "_x", "_f", sections, ["_own", time, "_total"], chunk)
    turned = forward.withColumn("_p", F.col("_total") - 1 - F.col("_p"))
    back = recursive_filter(turned, series, "_p", "_f", "_t", sections, ["_own", time, "_x"], chunk)
    kept = back.where("_own").select(*series, time, F.col("_x").alias(value), (F.col("_x") - F.col("_t")).alias(out))
    missing = rows.where(~is_finite(F.col(value)) | F.col(value).isNull()).withColumn(out, F.lit(None).cast("double"))
    return kept.unionByName(missing)
