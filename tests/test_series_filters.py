import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridseries.operators import scores as sc
from gridseries.operators import spectral as spx
from gridseries.operators import timeseries as ts


def test_butterworth_passes_constants_and_halves_power_at_cutoff():
    b, a = ts.butterworth_lowpass(4, 0.25)
    assert b.sum() / a.sum() == pytest.approx(1.0)
    z = np.exp(1j * np.pi * 0.25)
    h = np.polyval(b[::-1], 1 / z) / np.polyval(a[::-1], 1 / z)
    assert abs(h) == pytest.approx(np.sqrt(0.5), abs=1e-9)
    z = np.exp(1j * np.pi)
    assert abs(np.polyval(b[::-1], 1 / z)) < 1e-9


def test_forward_backward_keeps_constants_and_ramps():
    b, a = ts.butterworth_lowpass(2, 0.1)
    np.testing.assert_allclose(ts.forward_backward(b, a, np.full(60, 3.0)), 3.0, atol=1e-9)
    ramp = np.arange(80.0)
    np.testing.assert_allclose(ts.forward_backward(b, a, ramp)[20:60], ramp[20:60], atol=0.05)


def test_lowpass_removed_keeps_fast_waves(spark):
    t = np.arange(480)
    slow, fast = 5 + 0.01 * t, np.sin(2 * np.pi * t / 12)
    df = spark.createDataFrame(pd.DataFrame({"s": "x", "month_idx": t.astype("int32"), "v": slow + fast}))
    out = ts.lowpass_removed(df, ["s"], "v", "o", cutoff_years=4.0).orderBy("month_idx").toPandas()["o"].to_numpy()
    assert np.abs(out - fast)[80:-80].max() < 0.05


@pytest.mark.parametrize("order, cutoff", [(1, 0.2), (2, 0.1), (3, 0.3), (4, 0.25), (5, 0.05)])
def test_sections_are_the_filter(order, cutoff):
    num, den = np.ones(1), np.ones(1)
    for b, a in ts.butterworth_sections(order, cutoff):
        num, den = np.convolve(num, b), np.convolve(den, a)
    b, a = ts.butterworth_lowpass(order, cutoff)
    np.testing.assert_allclose(num, b, atol=1e-12)
    np.testing.assert_allclose(den, a, atol=1e-9)


@pytest.mark.parametrize("chunk", [3, 16, 1000])
def test_scan_of_chunks_equals_one_pass(spark, chunk):
    """Several series, gaps in time, nulls and NaN, shorter than the extension and of one sample."""
    rng = np.random.default_rng(7)
    rows, want = [], {}
    for name, n in [("a", 150), ("b", 40), (None, 5), ("one", 1), ("empty", 0)]:
        months = np.sort(rng.choice(400, n, replace=False))
        x = rng.normal(size=n).cumsum() + 280.0
        b, a = ts.butterworth_lowpass(3, 1 / 24)
        want |= {(name, int(m)): v for m, v in zip(months, x - (ts.forward_backward(b, a, x) if n else x), strict=True)}
        rows += [(name, int(m), float(v)) for m, v in zip(months, x, strict=True)] + [(name, 500, None), (name, 501, float("nan"))]
    df = spark.createDataFrame(rows, "s string, month_idx int, v double")
    got = {(r["s"], r["month_idx"]): r["o"] for r in ts.lowpass_removed(df, ["s"], "v", "o", cutoff_years=4.0, order=3, chunk=chunk).collect()}
    assert set(got) == {(r[0], r[1]) for r in rows}
    assert all(got[k] is None for k in got if k[1] >= 500)
    keys = list(want)
    np.testing.assert_allclose([got[k] for k in keys], [want[k] for k in keys], atol=1e-8)


@pytest.mark.parametrize("chunk", [40, 70, 1000])
def test_chunks_with_halos_equal_one_pass(spark, chunk):
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for name, n in [("a", 200), (None, 61), ("short", 20), ("one", 1)]:
        y = rng.normal(size=n).cumsum()
        y[n // 2] += 30.0
        rows += [(name, 3 * k, float(v)) for k, v in enumerate(y)] + [(name, 1000, None)]
        want |= {(name, 3 * k): v for k, v in enumerate(ts.local_regression(y, min(36, n)))}
    df = spark.createDataFrame(rows, "s string, month_idx int, v double")
    got = {(r["s"], r["month_idx"]): r["o"] for r in ts.loess(df, ["s"], "v", "o", period_years=3, chunk=chunk).collect()}
    assert all(got.pop((name, 1000)) is None for name in ("a", None, "short", "one"))
    assert got.keys() == want.keys()
    np.testing.assert_allclose([got[k] for k in want], list(want.values()), atol=1e-9)


def local_line(y, i, span):
    """One local regression point without robust passes, by weighted least squares."""
    n = len(y)
    left = min(max(i - (span - 1) // 2, 0), n - span)
    x = np.arange(left, left + span)
    d = np.abs(x - i) / np.abs(x - i).max()
    w = np.where(d >= 0.999, 0, np.where(d <= 0.001, 1, (1 - d**3) ** 3))
    return np.polyval(np.polyfit(x, y[x], 1, w=np.sqrt(w)), i)


def test_local_regression_matches_least_squares():
    rng = np.random.default_rng(0)
    y = rng.normal(size=50).cumsum()
    got = ts.local_regression(y, 15, passes=0)
    np.testing.assert_allclose(got, [local_line(y, i, 15) for i in range(50)], atol=1e-9)


def test_loess_keeps_lines_and_resists_outliers(spark):
    t = np.arange(120)
    line = 1.0 + 0.5 * t
    spike = line + np.random.default_rng(1).normal(scale=0.1, size=120)
    spike[60] += 100
    df = spark.createDataFrame(pd.DataFrame({"s": ["a"] * 120 + ["b"] * 120, "month_idx": np.tile(t, 2).astype("int32"), "v": np.concatenate([line, spike])}))
    out = ts.loess(df, ["s"], "v", "o", period_years=3).toPandas().sort_values(["s", "month_idx"])
    np.testing.assert_allclose(out[out.s == "a"]["o"], line, atol=1e-9)
    assert np.abs(out[out.s == "b"]["o"].to_numpy() - line).max() < 1.0


def test_periodogram_against_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=60)
    x[10] = np.nan
    rows = [(1, i, None if np.isnan(v) else float(v)) for i, v in enumerate(x)]
    got = spx.periodogram(spark.createDataFrame(rows, "c int, month_idx int, v double"), ["c"], "v", 2, 24).first()
    xc = np.where(np.isfinite(x), x - np.nanmean(x), 0) * np.hanning(60)
    p = np.abs(np.fft.rfft(xc))[2:31] ** 2
    np.testing.assert_allclose(got["power"], p / p.sum(), rtol=1e-9)
    assert (got["kmin"], got["n"]) == (2, 60)


def test_short_series_have_no_spectrum(spark):
    df = spark.createDataFrame([(1, i, float(i)) for i in range(7)], "c int, month_idx int, v double")
    assert spx.periodogram(df, ["c"], "v").first()["power"] is None


def test_pair_distances_in_blocks_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    v = {"hot": rng.normal(size=(57, 4)), "cold": rng.normal(size=(3, 4)), "one": rng.normal(size=(1, 4))}
    rows = [(k, i, x.tolist()) for k, m in v.items() for i, x in enumerate(m)]
    df = spark.createDataFrame(rows, "k string, i int, vec array<double>")
    got = {r["k"]: r for r in sc.mean_pair_distance(df, ["k"], "i", "vec", block=8).collect()}
    for k, m in v.items():
        d = [np.linalg.norm(m[i] - m[j]) for i in range(len(m)) for j in range(i + 1, len(m))]
        assert got[k]["n_pairs"] == len(d)
        assert got[k]["mean_distance"] == pytest.approx(np.mean(d) if d else 0.0)


def test_chunked_apply_equals_whole_series(spark):
    df = spark.range(100).select(F.lit("s").alias("s"), F.col("id").cast("int").alias("month_idx"), (F.col("id") * 7 % 13).cast("double").alias("v"))

    def total(pdf):
        return pdf.assign(t=pdf["v"].rolling(4, min_periods=1).sum())[["s", "month_idx", "t"]]

    got = ts.chunked_apply(df, ["s"], total, "s string, month_idx int, t double", chunk=11, context=3).orderBy("month_idx").toPandas()
    want = total(df.toPandas())
    np.testing.assert_allclose(got["t"], want["t"])


def test_splice_zones(spark):
    base = spark.createDataFrame([("m", i, 10.0) for i in range(240, 360)], "s string, month_idx int, value double")
    ref = spark.createDataFrame([(i, 12.0) for i in range(276, 324)], "month_idx int, value double")
    got = {r["month_idx"]: r["value"] for r in ts.splice(base, ref, ["s"], start_years=1, end_years=1).collect()}
    assert len(got) == 120 and all(v == pytest.approx(12.0) for v in got.values())
    scaled = ts.splice(base, ref.withColumn("value", F.lit(-100.0)), ["s"], start_years=1, end_years=1, mode="guarded_scale").collect()
    assert all(r["value"] == pytest.approx(-100.0) for r in scaled)
