"""Smoothing, interpolation, splicing and detrending of series.

A series has one row per time step, so its windows are bounded by the calendar.
Filters that reach along a whole series work on chunks of it (``recurrence``,
``local_lines``).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridseries.functions.calendar import month_of, year_of
from gridseries.functions.quantiles import broadcast_if_small
from gridseries.functions.ranks import row_numbers
from gridseries.operators import local_lines, recurrence


def centred_mean(df: DataFrame, series: list[str], time: str, value: str, before: int, after: int, out: str, min_count: int = 1) -> DataFrame:
    """Mean over [t-before, t+after]; null below ``min_count`` values."""
    w = Window.partitionBy(*series).orderBy(time).rangeBetween(-before, after)
    return df.withColumn(out, F.when(F.count(value).over(w) >= min_count, F.avg(value).over(w)))


def _edge_fits(df: DataFrame, series: list[str], time: str, x: Column, value: str, left: Column, right: Column) -> DataFrame:
    """Lines through the first and last rows of each series."""
    def side(flag, tag, pick):
        y, xx = F.when(flag, F.col(value)), F.when(flag, x)
        return [
            F.regr_slope(y, xx).alias(f"{tag}_slope"), F.regr_intercept(y, xx).alias(f"{tag}_base"),
            F.count(y).alias(f"{tag}_n"), pick(F.when(flag & F.col(value).isNotNull(), F.col(value)), F.col(time)).alias(f"{tag}_one"),
        ]

    return df.groupBy(*series).agg(
        F.min(time).alias("_t0"), F.max(time).alias("_t1"), F.count(value).alias("_any"),
        *side(left, "left", F.min_by), *side(right, "right", F.min_by),
    )


def _extended(fits: DataFrame, series: list[str], time: str, value: str, pad: int, x_of) -> DataFrame:
    t = F.col(time)

    def part(tag, start, stop):
        line = F.when(F.col(f"{tag}_n") >= 2, F.col(f"{tag}_slope") * x_of(t) + F.col(f"{tag}_base")).otherwise(F.col(f"{tag}_one"))
        rows = fits.where(F.col("_any") > 0).withColumn(time, F.explode(F.sequence(start, stop)))
        return rows.select(*series, time, line.alias(value), F.lit(True).alias("_ext"))

    before = part("left", F.col("_t0") - pad, F.col("_t0") - 1)
    return before.unionByName(part("right", F.col("_t1") + 1, F.col("_t1") + pad))


def edge_trend_mean(
    df: DataFrame, series: list[str], value: str, out: str, window: int = 21, fit_years: int = 10, extension: int = 11, time: str = "year"
) -> DataFrame:
    """Centred mean of an annual series whose ends are extended by trend lines.

    The lines are fitted to the first and last ``fit_years`` years that hold a
    value; a single value is held constant.
    """
    half = window // 2
    pad = max(half, extension)
    base = df.select(*series, time, value)
    w = Window.partitionBy(*series)
    present = F.col(value).isNotNull()
    ranked = base.withColumns({
        "_l": F.count(value).over(w.orderBy(F.col(time).asc())),
        "_r": F.count(value).over(w.orderBy(F.col(time).desc())),
    })
    x = F.col(time).cast("double")
    fits = _edge_fits(ranked, series, time, x, value, present & (F.col("_l") <= fit_years), present & (F.col("_r") <= fit_years))
    ext = _extended(fits, series, time, value, pad, lambda t: t.cast("double"))
    both = base.withColumn("_ext", F.lit(False)).unionByName(ext)
    smooth = centred_mean(both, series, time, value, half, half, out)
    return smooth.where(~F.col("_ext")).drop("_ext")


def trend_extended_running_mean(df: DataFrame, series: list[str], value: str, out: str, years: int = 20) -> DataFrame:
    """Running mean over ``years`` of a monthly series with trend-extended ends.

    Only full windows count; the window of even length reaches one month less
    into the future than into the past.
    """
    n = years * 12
    base = df.select(*series, "month_idx", value)
    w = Window.partitionBy(*series)
    y = year_of(F.col("month_idx"))
    ranked = base.withColumns({"_first": F.min(y).over(w), "_last": F.max(y).over(w)})
    x = F.col("month_idx") / 12.0
    left, right = y <= F.col("_first") + years - 1, y >= F.col("_last") - years + 1
    fits = _edge_fits(ranked, series, "month_idx", x, value, left, right)
    ext = _extended(fits, series, "month_idx", value, n, lambda t: t / 12.0)
    both = base.withColumn("_ext", F.lit(False)).unionByName(ext)
    smooth = centred_mean(both, series, "month_idx", value, n // 2, n - n // 2 - 1, out, min_count=n)
    return smooth.where(~F.col("_ext")).drop("_ext")


def annual_to_monthly(df: DataFrame, series: list[str], value: str, years: tuple[int, int], out: str = "value") -> DataFrame:
    """Linear interpolation from annual points at the start of their year.

    Several values of a year are averaged; outside the first and last point the
    end value is held. Each annual row creates its own months, so no as-of join
    is needed.
    """
    lo, hi = years[0] * 12, years[1] * 12 + 11
    annual = df.groupBy(*series, "year").agg(F.avg(value).alias("_v")).where("_v IS NOT NULL")
    w = Window.partitionBy(*series).orderBy("year")
    y0 = (F.col("year") * 12).cast("int")
    staged = annual.withColumns({"_y0": y0, "_next": F.lead("year").over(w) * 12, "_vn": F.lead("_v").over(w), "_prev": F.lag("year").over(w)})
    start = F.when(F.col("_prev").isNull(), F.least(F.lit(lo), F.col("_y0"))).otherwise(F.col("_y0"))
    stop = F.when(F.col("_next").isNull(), F.greatest(F.lit(hi), F.col("_y0"))).otherwise(F.col("_next") - 1)
    months = staged.withColumn("month_idx", F.explode(F.sequence(start.cast("int"), stop.cast("int")))).where(F.col("month_idx").between(lo, hi))
    share = (F.col("month_idx") - F.col("_y0")) / (F.col("_next") - F.col("_y0"))
    inside = F.col("_next").isNotNull() & (F.col("month_idx") >= F.col("_y0"))
    val = F.when(inside, F.col("_v") + (F.col("_vn") - F.col("_v")) * share).otherwise(F.col("_v"))
    return months.select(
        *series, year_of(F.col("month_idx")).alias("year"), month_of(F.col("month_idx")).alias("month"), "month_idx", val.alias(out)
    )


def repeat_monthly(df: DataFrame) -> DataFrame:
    """Each annual row twelve times."""
    return df.withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))


def fill_gaps(df: DataFrame, series: list[str], time: str, value: str, out: str) -> DataFrame:
    """Linear inside gaps, held at the ends, zero where a series has no value."""
    w = Window.partitionBy(*series).orderBy(time)
    point = F.when(F.col(value).isNotNull(), F.struct(F.col(time).alias("t"), F.col(value).cast("double").alias("v")))
    before = F.last(point, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.first(point, ignorenulls=True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    staged = df.withColumns({"_b": before, "_a": after})
    b, a = F.col("_b"), F.col("_a")
    line = b["v"] + (a["v"] - b["v"]) * (F.col(time) - b["t"]) / (a["t"] - b["t"])
    val = (
        F.when(F.col(value).isNotNull(), F.col(value))
        .when(b.isNotNull() & a.isNotNull(), line)
        .otherwise(F.coalesce(b["v"], a["v"], F.lit(0.0)))
    )
    return staged.withColumn(out, val).drop("_a", "_b")


GUARD = (-3.0, 3.0)


def splice(
    base: DataFrame, reference: DataFrame, series: list[str], value: str = "value", start_years: int = 5, end_years: int = 5, mode: str = "shift",
    out: str = "value",
) -> DataFrame:
    """Model series with the reference inside, faded in and out.

    The base is aligned to the reference over the first and the last years of
    the reference (``shift``, ``scale``, or ``guarded_scale`` with factors held
    in [-3, 3] and a shift after it), fades in over the first years, fades out
    over the last ones, and continues aligned on both sides. ``reference`` holds
    (month_idx, value).
    """
    if mode not in ("shift", "scale", "guarded_scale"):
        raise ValueError(f"unknown splice mode {mode!r}")
    ref = reference.select("month_idx", F.col(value).alias("_ref"))
    ends = ref.where("_ref IS NOT NULL").agg(F.min("month_idx").alias("_r0"), F.max("month_idx").alias("_r1"))
    idx = F.col("month_idx")
    # The reference is one series: one row per month. Its ends are one row.
    merged = base.join(F.broadcast(ref), "month_idx", "left").join(F.broadcast(ends))
    s0 = F.floor(F.col("_r0") / 12) * 12
    s1 = F.least(s0 + start_years * 12 - 1, F.col("_r1"))
    e1 = F.least(F.floor(F.col("_r1") / 12) * 12 + 11, F.col("_r1"))
    e0 = F.greatest(e1 - end_years * 12 + 1, s0)
    staged = merged.withColumns({"_s0": s0, "_s1": s1, "_e0": e0, "_e1": e1})
    w = Window.partitionBy(*series)
    first, last = idx.between(F.col("_s0"), F.col("_s1")), idx.between(F.col("_e0"), F.col("_e1"))
    v = F.col(value)
    staged = staged.withColumns({
        "_bs": F.avg(F.when(first, v)).over(w), "_rs": F.avg(F.when(first, F.col("_ref"))).over(w),
        "_be": F.avg(F.when(last, v)).over(w), "_re": F.avg(F.when(last, F.col("_ref"))).over(w),
        # A fade runs over the months that exist in its window.
        "_fs0": F.min(F.when(first, idx)).over(w), "_fs1": F.max(F.when(first, idx)).over(w),
        "_fe0": F.min(F.when(last, idx)).over(w), "_fe1": F.max(F.when(last, idx)).over(w),
    })

    def aligned(b: str, r: str) -> Column:
        src, tgt = F.col(b), F.col(r)
        usable = src.isNotNull() & tgt.isNotNull()
        if mode == "shift":
            return v + F.when(usable, tgt - src).otherwise(0.0)
        factor = F.when(usable & (F.abs(src) >= 1e-8), tgt / src).otherwise(1.0)
        if mode == "scale":
            return v * factor
        held = F.least(F.greatest(factor, F.lit(GUARD[0])), F.lit(GUARD[1]))
        return v * held + F.when(usable, tgt - src * held).otherwise(0.0)

    head, tail = aligned("_bs", "_rs"), aligned("_be", "_re")

    def weight(lo: str, hi: str) -> Column:
        return F.when(F.col(hi) > F.col(lo), (idx - F.col(lo)) / (F.col(hi) - F.col(lo))).otherwise(1.0)

    ws, we = weight("_fs0", "_fs1"), weight("_fe0", "_fe1")
    zone = (
        F.when(last & F.lit(end_years > 0), F.col("_ref") * (1 - we) + tail * we)
        .when(first & F.lit(start_years > 0), head * (1 - ws) + F.col("_ref") * ws)
        .when(idx < F.col("_s0"), head)
        .when(idx > F.col("_e1"), tail)
        .otherwise(F.col("_ref"))
    )
    return staged.select(*series, "month_idx", F.coalesce(zone, F.col("_ref"), tail).alias(out))


def anchor(df: DataFrame, series: list[str], value: str, target: float, baseline: tuple[int, int], out: str) -> DataFrame:
    """Shift a series so that its baseline mean equals ``target``."""
    w = Window.partitionBy(*series)
    mean = F.avg(F.when(F.col("year").between(*baseline), F.col(value))).over(w)
    return df.withColumn(out, F.col(value) + (F.lit(target) - mean))


def first_per_month(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Keep the first row of each (keys, year, month).

    ``min_by`` is combined map-side, so copies of one month never meet in a sort.
    """
    rest = [c for c in df.columns if c not in (*keys, "year", "month")]
    picked = df.groupBy(*keys, "year", "month").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, "year", "month", *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def yearly_delta(output: DataFrame, predictor: DataFrame, series: list[str], window: int = 21) -> DataFrame:
    """Per-year smoothed output minus predictor (both annual means of ``value``)."""
    half = window // 2
    annual = output.groupBy(*series, "year").agg(F.avg("value").alias("_out"))
    smooth = centred_mean(annual, series, "year", "_out", half, half, "_smooth")
    pred = predictor.groupBy(*series, "year").agg(F.avg("value").alias("_pred"))
    return smooth.join(pred, [*series, "year"]).select(*series, "year", (F.col("_smooth") - F.col("_pred")).alias("delta"))


def corrected_predictor(predictor: DataFrame, delta: DataFrame, series: list[str], out: str = "corrected") -> DataFrame:
    """value - delta/10 by year; years without a delta use the series mean."""
    mean = delta.groupBy(*series).agg(F.avg("delta").alias("_mean"))
    joined = predictor.join(delta, [*series, "year"], "left").join(broadcast_if_small(mean), series, "left")
    step = F.coalesce(F.col("delta"), F.col("_mean"), F.lit(0.0))
    return joined.withColumn(out, F.col("value") - step / 10.0).drop("delta", "_mean")


def tail_mean(df: DataFrame, series: list[str], time: str, value: str, last: int) -> DataFrame:
    """Mean of the finite values among the last ``last`` rows of each series."""
    w = Window.partitionBy(*series).orderBy(F.col(time).desc())
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= last).groupBy(*series).agg(F.avg(value).alias(value))


def detrend(df: DataFrame, series: list[str], x: Column, value: str, out: str) -> DataFrame:
    """Subtract the least-squares line of each series.

    Line parameters are running sums over an unordered window, so the rows move
    once.
    """
    w = Window.partitionBy(*series)
    staged = df.withColumns({"_x": x.cast("double"), "_y": F.col(value)})
    both = F.col("_x").isNotNull() & F.col("_y").isNotNull()
    xx, yy = F.when(both, F.col("_x")), F.when(both, F.col("_y"))
    staged = staged.withColumns({"_mx": F.avg(xx).over(w), "_my": F.avg(yy).over(w)})
    dx, dy = F.col("_x") - F.col("_mx"), F.col("_y") - F.col("_my")
    staged = staged.withColumns({"_sxy": F.sum(dx * dy).over(w), "_sxx": F.sum(F.when(both, dx * dx)).over(w)})
    slope = F.when(F.col("_sxx") > 0, F.col("_sxy") / F.col("_sxx")).otherwise(0.0)
    return staged.withColumn(out, dy - slope * dx).drop("_x", "_y", "_mx", "_my", "_sxy", "_sxx")


def lag_correlation(df: DataFrame, series: list[str], time: str, a: str, b: str, lags: int) -> DataFrame:
    """corr(a_t, b_{t+l}) for l = 0..lags-1 as (series, lag, corr) rows.

    ``time`` counts steps, so a lag means the same across gaps.
    """
    w = Window.partitionBy(*series).orderBy(time)
    staged = df.withColumns({f"_l{i}": F.max(b).over(w.rangeBetween(i, i)) for i in range(lags)})
    agg = staged.groupBy(*series).agg(*[F.corr(a, f"_l{i}").alias(f"c{i}") for i in range(lags)])
    rows = F.array(*[F.struct(F.lit(i).alias("lag"), F.col(f"c{i}").alias("corr")) for i in range(lags)])
    return agg.select(*series, F.inline(rows))


def autocorrelation(df: DataFrame, series: list[str], time: str, value: str, lags: int) -> DataFrame:
    """sum x_t x_{t+l} / sum x^2 for l = 1..lags; ``time`` counts steps, so a lag means the same across gaps."""
    w = Window.partitionBy(*series).orderBy(time)
    staged = df.withColumns({f"_l{i}": F.max(value).over(w.rangeBetween(i, i)) for i in range(1, lags + 1)})
    agg = staged.groupBy(*series).agg(
        F.sum(F.col(value) * F.col(value)).alias("_s0"), *[F.sum(F.col(value) * F.col(f"_l{i}")).alias(f"s{i}") for i in range(1, lags + 1)]
    )
    rows = F.array(*[F.struct(F.lit(i).alias("lag"), (F.col(f"s{i}") / (F.col("_s0") + 1e-10)).alias("acf")) for i in range(1, lags + 1)])
    return agg.select(*series, F.inline(rows))


def numbered(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Zero-based index within a group, and the size of the group."""
    return row_numbers(df, group, order, "index_in_group", "group_size")


def time_windows(spans: DataFrame, keys: list[str], years: int = 20, mode: str = "triple", cap: int | None = None, forced=None) -> DataFrame:
    """(start, end, label) windows on the overlap of two series.

    ``spans`` holds a0, a1, b0, b1 (first and last years). Forced windows win;
    ``cap`` is the last year to use, if any.
    """
    if forced:
        rows = F.array(*[F.struct(F.lit(a).alias("start_year"), F.lit(b).alias("end_year")) for a, b in forced])
        out = spans.select(*keys, F.inline(rows))
    else:
        y0, y1 = F.greatest("a0", "b0"), F.least("a1", "b1", *([] if cap is None else [F.lit(cap)]))
        y1 = F.greatest(y1, y0)
        mid = y0 + F.floor((y1 - y0) / 2)
        half = years // 2
        kinds = {
            "single_start": (y0, F.least(y1, y0 + years - 1)),
            "single_mid": (F.greatest(y0, mid - half), F.least(y1, mid + half - 1)),
            "single_end": (F.greatest(y0, y1 - years + 1), y1),
        }
        names = ["single_start", "single_mid", "single_end"] if mode == "triple" else [mode if mode in kinds else "single_end"]
        rows = F.array(*[F.struct(kinds[n][0].cast("int").alias("start_year"), kinds[n][1].cast("int").alias("end_year")) for n in names])
        out = spans.select(*keys, F.inline(rows))
    return out.withColumn("label", F.concat_ws("to", F.col("start_year").cast("string"), F.col("end_year").cast("string")))


def common_times(df: DataFrame, group: str, time: list[str], value: str) -> DataFrame:
    """Long matrix of the times at which every group has a value.

    Counts of groups per time replace the pairwise intersection.
    """
    present = df.where(F.col(value).isNotNull())
    n = present.agg(F.count_distinct(group).alias("_n"))
    full = present.groupBy(*time).agg(F.count_distinct(group).alias("_c")).join(F.broadcast(n), F.col("_c") == F.col("_n"))
    return present.join(full.select(*time), time, "left_semi")


# --- recursive and local filters on single series --------------------------------


def butterworth_lowpass(order: int, cutoff: float) -> tuple[np.ndarray, np.ndarray]:
    """Digital low-pass coefficients (b, a); cutoff as a share of the Nyquist rate.

    Analogue prototype poles, pre-warped and mapped by the bilinear transform.
    """
    warped = 4.0 * math.tan(math.pi * cutoff / 2.0)
    k = np.arange(1, order + 1)
    poles = warped * np.exp(1j * math.pi * (2 * k + order - 1) / (2 * order))
    z = (4.0 + poles) / (4.0 - poles)
    a = np.real(np.poly(z))
    b = np.poly(-np.ones(order))
    return b * a.sum() / b.sum(), a


def butterworth_sections(order: int, cutoff: float) -> list[recurrence.Section]:
    """The same filter as a chain of sections of first and second order, each of unit gain for constants."""
    warped = 4.0 * math.tan(math.pi * cutoff / 2.0)
    sections = []
    for k in range(1, (order + 1) // 2 + 1):
        pole = warped * complex(math.cos(math.pi * (2 * k + order - 1) / (2 * order)), math.sin(math.pi * (2 * k + order - 1) / (2 * order)))
        z = (4.0 + pole) / (4.0 - pole)
        single = 2 * k - 1 == order
        a = (1.0, -z.real) if single else (1.0, -2.0 * z.real, abs(z) ** 2)
        b = tuple(c * sum(a) / 2.0 ** (len(a) - 1) for c in ((1.0, 1.0) if single else (1.0, 2.0, 1.0)))
        sections.append((b, a))
    return sections


def _recursion(b, a, x, state):
    y = np.empty_like(x)
    z = state.copy()
    for i, v in enumerate(x):
        y[i] = b[0] * v + z[0]
        z[:-1] = b[1:-1] * v + z[1:] - a[1:-1] * y[i]
        z[-1] = b[-1] * v - a[-1] * y[i]
    return y


def forward_backward(b, a, x) -> np.ndarray:
    """Zero-phase filtering with odd extension and steady initial state."""
    n = len(a) - 1
    pad = min(3 * len(a), len(x) - 1)
    ext = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2:-pad - 2:-1]]) if pad > 0 else x
    # Steady state for a unit input: solve the state equation of the recursion.
    lhs = np.eye(n)
    lhs[:, 0] += a[1:]
    lhs[:-1, 1:] -= np.eye(n - 1)
    rhs = b[1:] - a[1:] * b[0]
    zi = np.linalg.solve(lhs, rhs)
    fwd = _recursion(b, a, ext, zi * ext[0])
    back = _recursion(b, a, fwd[::-1], zi * fwd[-1])[::-1]
    return back[pad: len(back) - pad] if pad > 0 else back


def lowpass_removed(df: DataFrame, series: list[str], value: str, out: str, cutoff_years: float = 30.0, order: int = 4, chunk: int = recurrence.CHUNK) -> DataFrame:
    """Monthly series minus their low-pass trend; series of any length are filtered in chunks."""
    return recurrence.lowpass_removed(df, series, value, out, butterworth_sections(order, (1.0 / cutoff_years) / 6.0), chunk=chunk)


def local_regression(y: np.ndarray, span: int, passes: int = 3) -> np.ndarray:
    """Tricube local lines over the ``span`` nearest points of one short series, with bisquare passes."""
    n = len(y)
    robust, fit = np.ones(n), y
    for _ in range(passes + 1):
        fit = local_lines.lines_at(np.arange(n), 0, y, robust, n, span)
        resid = np.abs(y - fit)
        scale = 6.0 * np.median(resid)
        u = resid / scale if scale > 0 else np.where(resid > 0, 1.0, 0.0)
        robust = np.where(u >= 0.999, 0.0, np.where(u <= 0.001, 1.0, (1 - u**2) ** 2))
    return fit


def loess(df: DataFrame, series: list[str], value: str, out: str, period_years: int = 21, chunk: int = local_lines.CHUNK) -> DataFrame:
    """Robust local regression of monthly series; series of any length are fitted in chunks with halos."""
    return local_lines.loess(df, series, value, out, period_years * 12, chunk=chunk)


def _starts(pdf: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Places where a series begins in rows that are sorted by ``keys``; null equals null."""
    fresh = np.zeros(len(pdf), bool)
    for k in keys:
        here, last = pdf[k], pdf[k].shift()
        fresh |= ((here != last) & ~(here.isna() & last.isna())).to_numpy(bool)
    fresh[:1] = True
    return np.flatnonzero(fresh)


def apply_to_series(df: DataFrame, keys: list[str], fn, schema: str, order: tuple[str, ...] = (), many: bool = False) -> DataFrame:
    """``fn(pandas) -> pandas`` on whole series, in the order of ``order``.

    Series come to Python in batches of many, so that a short one costs no batch
    of its own. With ``many`` the function gets a batch of whole series at once, one
    after the other, for functions that work on all of them by vectors; otherwise
    it gets one series at a time. A task holds a batch and one series.
    """
    names = T.StructType.fromDDL(schema).names

    def run(batches):
        def out(parts):
            rows = pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0].reset_index(drop=True)
            if many:
                return fn(rows)[names]
            ends = [*_starts(rows, keys), len(rows)]
            return pd.concat([fn(rows.iloc[a:b].reset_index(drop=True))[names] for a, b in zip(ends, ends[1:], strict=False)], ignore_index=True)

        held = []  # rows of the last series, which may go on in the next batch
        for pdf in batches:
            if not len(pdf):
                continue
            if held and len(_starts(pd.concat([held[-1].iloc[-1:], pdf.iloc[:1]], ignore_index=True), keys)) > 1:
                yield out(held)
                held = []
            last = _starts(pdf, keys)[-1]
            if last:
                yield out([*held, pdf.iloc[:last]])
                held = []
            held.append(pdf.iloc[last:])
        if held:
            yield out(held)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def chunked_apply(df: DataFrame, series: list[str], fn, schema: str, chunk: int, context: int, many: bool = False) -> DataFrame:
    """Apply ``fn(pandas) -> pandas`` to chunks of a series with warm-up rows.

    Each row goes to its own chunk and, as context, to the following chunks that
    need it; rows before the chunk start are dropped after the call. The output
    must carry month_idx. With ``many`` the function gets many chunks at once, one
    after the other and told apart by series and ``_start``, the first month of the
    chunk; its rows keep the index of their input rows.
    """
    w = Window.partitionBy(*series)
    pos = F.col("month_idx") - F.min("month_idx").over(w)
    last = F.max("month_idx").over(w) - F.min("month_idx").over(w)
    own = F.floor(pos / chunk)
    reach = F.least(F.floor((pos + context) / chunk), F.floor(last / chunk))
    staged = df.withColumns({"_own": own, "_reach": reach, "_origin": F.min("month_idx").over(w)})
    copies = staged.withColumn("_chunk", F.explode(F.sequence(F.col("_own"), F.col("_reach"))))
    user_cols = [c for c in df.columns]
    copies = copies.select(*user_cols, (F.col("_origin") + F.col("_chunk") * chunk).alias("_start"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        if many:
            res = fn(pdf)
            return res[res["month_idx"].to_numpy() >= pdf["_start"].loc[res.index].to_numpy()]
        res = fn(pdf[user_cols])
        return res[res["month_idx"] >= pdf["_start"].iloc[0]]

    return apply_to_series(copies, [*series, "_start"], one, schema, ("month_idx",), many)
