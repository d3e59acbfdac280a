"""Formulas and protocol rules on small fixtures, against plain numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridseries.functions import pet
from gridseries.functions.glo import norm_ppf
from gridseries.operators import attribution as at
from gridseries.operators import ensemble as en
from gridseries.operators import filters as flt
from gridseries.operators import index as ix
from gridseries.operators import metrics as mt
from gridseries.operators import predictors as pr
from gridseries.operators import timeseries as ts
from gridseries.operators.spatial import area_mean


def glo_reference(values, fit):
    """Index of ``values`` with a distribution fitted to ``fit``."""
    x = np.sort(fit)
    n, i = len(x), np.arange(len(fit))
    b0, b1 = x.mean(), (i * x).sum() / (n * (n - 1))
    b2 = (i * (i - 1) * x).sum() / (n * (n - 1) * (n - 2))
    l1, l2, l3 = b0, 2 * b1 - b0, 6 * b2 - 6 * b1 + b0
    k = -l3 / l2
    alpha = l2 * math.sin(math.pi * k) / (math.pi * k)
    xi = l1 - alpha * (1 / k - math.pi / math.sin(math.pi * k))
    y = -np.log(1 - k * (np.asarray(values) - xi) / alpha) / k
    p = np.clip(1 / (1 + np.exp(-y)), 1e-6, 1 - 1e-6)
    return p


def test_hargreaves_value(spark):
    df = spark.createDataFrame([(293.15, 287.15, 299.15, 20e6 / 86400, 2001, 6)], "t double, a double, b double, r double, y int, m int")
    row = df.select(pet.hargreaves(F.col("t"), F.col("a"), F.col("b"), F.col("y"), F.col("m"), rsds=F.col("r")).alias("p")).first()
    assert row["p"] == pytest.approx(0.0023 * 0.408 * 20 * 37.8 * math.sqrt(12) * 30)


def test_area_mean_weights(spark):
    df = spark.createDataFrame([(1, 0.0, 2.0), (1, 60.0, 5.0), (1, 0.0, None)], "k int, lat double, v double")
    assert area_mean(df, ["k"], "v").first()["value"] == pytest.approx((2 + 0.5 * 5) / 1.5)
    assert area_mean(df, ["k"], "v", full_weight=True).first()["value"] == pytest.approx((2 + 0.5 * 5) / 2.5)


def test_corrected_predictor(spark):
    p = spark.createDataFrame([("s", 2000, 1.0), ("s", 2001, 2.0)], "s string, year int, value double")
    d = spark.createDataFrame([("s", 2000, 0.5)], "s string, year int, delta double")
    got = [r["corrected"] for r in ts.corrected_predictor(p, d, ["s"]).orderBy("year").collect()]
    assert got == pytest.approx([0.95, 1.95])


def test_event_month_rejects_duplicates(spark):
    df = spark.createDataFrame([(1, 2000, 12, 1.0), (1, 2000, 11, 9.0), (1, 2001, 12, float("nan"))], "k int, year int, month int, v double")
    assert [(r["year"], r["v"]) for r in flt.event_month(df, ["k"], "v").collect()] == [(2000, 1.0)]
    with pytest.raises(Exception, match="several values"):
        flt.event_month(df.union(df), ["k"], "v").collect()


def test_incomplete_window_is_an_error(spark):
    df = spark.createDataFrame([(1, y) for y in (2000, 2002)], "m int, year int")
    with pytest.raises(Exception, match="incomplete window"):
        flt.complete_window(df, ["m"], (2000, 2002)).collect()


def events(spark, matrix):
    rows = [("g", m, 2000 + y, int(v)) for m, row in enumerate(matrix) for y, v in enumerate(row)]
    return spark.createDataFrame(rows, "g string, member int, year int, event int")


def test_event_blocks_are_circular(spark):
    m = np.array([[1, 0, 0, 1, 0, 1, 1]])
    got = {r["start"]: (r["full"], r["tail"]) for r in at.event_blocks(events(spark, m), ["g"]).collect()}
    ring = np.concatenate([m[0], m[0]])
    assert got == {s: (ring[s: s + 5].sum(), ring[s: s + 2].sum()) for s in range(7)}


def test_bootstrap_repeats_and_bounds(spark):
    rng = np.random.default_rng(3)
    e = events(spark, rng.integers(0, 2, (4, 10)))
    a = [r["p"] for r in at.bootstrap(e, ["g"], 50).orderBy("rep").collect()]
    b = [r["p"] for r in at.bootstrap(e.repartition(7), ["g"], 50).orderBy("rep").collect()]
    assert a == b and all(0 <= x <= 1 for x in a) and len(set(a)) > 3


def test_no_event_has_exact_upper_bound(spark):
    e = events(spark, np.zeros((2, 10))).withColumn("value", F.lit(1.0))
    draws = at.bootstrap(e, ["g"], 20)
    row = at.probability_rows(e, draws, ["g"], "value", F.lit(0.0)).first()
    assert row["one_sided"] and row["lower"] == 0.0
    assert row["upper"] == pytest.approx(1 - 0.05 ** (1 / 4))


def test_index_against_numpy(spark):
    rng = np.random.default_rng(5)
    v = rng.gamma(2.0, 3.0, 40)
    df = spark.createDataFrame([(1, 1980 + i, float(x)) for i, x in enumerate(v)], "g int, year int, v double")
    got = ix.glo_index(df, ["g"], "v", "z", F.col("year") < 2005).orderBy("year").toPandas()["z"].to_numpy()
    p = glo_reference(v, v[:25])
    want = [r["z"] for r in spark.createDataFrame([(i, float(x)) for i, x in enumerate(p)], "i int, p double").select("i", norm_ppf(F.col("p")).alias("z")).orderBy("i").collect()]
    np.testing.assert_allclose(got, want, rtol=1e-9)


def test_index_fallbacks(spark):
    rows = [("two", 1.0), ("two", 3.0), ("flat", 2.0), ("flat", 2.0), ("flat", 2.0), ("gap", None)]
    got = {}
    for r in ix.glo_index(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", "z").collect():
        got.setdefault(r["g"], []).append(r["z"])
    assert sorted(got["two"]) == pytest.approx([-1 / (1 + 1e-6), 1 / (1 + 1e-6)])
    assert got["flat"] == pytest.approx([0.0] * 3) and got["gap"] == [None]


def test_shared_fit_keeps_a_shift(spark):
    base = [(1, m, 1980 + y, float(y % 7 + m)) for m in range(3) for y in range(41)]
    f = spark.createDataFrame(base, "p int, member int, year int, v double")
    t = f.withColumn("v", F.col("v") + 3)
    z = ix.shared_index(f, t, ["p"], "v", "z", (1980, 2014)).agg(F.avg("z"), F.count("z")).first()
    assert z[0] > 0 and z[1] == len(base)


def test_norm_ppf_symmetry(spark):
    df = spark.createDataFrame([(0.5,), (0.001,), (0.999,), (0.975,)], "p double").select("p", norm_ppf(F.col("p")).alias("x"))
    x = {r["p"]: r["x"] for r in df.collect()}
    assert x[0.5] == 0 and x[0.001] == pytest.approx(-x[0.999]) and x[0.975] == pytest.approx(1.959964, abs=1e-6)


def test_edge_trend_mean_keeps_constants_and_lines(spark):
    rows = [("c", 1990 + y, 5.0) for y in range(30)] + [("l", 1990 + y, 2.0 * y) for y in range(30)] + [("n", 1990 + y, None) for y in range(3)]
    df = spark.createDataFrame(rows, "s string, year int, v double")
    for r in ts.edge_trend_mean(df, ["s"], "v", "m").collect():
        want = {"c": 5.0, "l": 2.0 * (r["year"] - 1990), "n": None}[r["s"]]
        assert r["m"] == (pytest.approx(want) if want is not None else None)


def test_paired_difference_needs_two_pairs(spark):
    rows = [("a", 1.0, 2.0), ("a", 1.0, 4.0), ("a", float("nan"), 1.0), ("a", float("inf"), 1.0), ("b", 1.0, 2.0)]
    got = {r["k"]: (r["n"], r["sd"]) for r in mt.paired_difference_sd(spark.createDataFrame(rows, "k string, x double, y double"), ["k"], "x", "y").collect()}
    assert got["a"] == (2, pytest.approx(math.sqrt(2))) and got["b"] == (1, None)


def test_median_anchored_keeps_the_median(spark):
    rng = np.random.default_rng(2)
    rows = [("g", f"r{i}", float(v)) for i, v in enumerate(rng.random(40))]
    df = spark.createDataFrame(rows, "g string, run string, w double")
    for strategy in ("random", "stratified"):
        sub = [r["w"] for r in en.median_anchored(df, ["g"], "run", "w", 10, "1", strategy).collect()]
        assert len(sub) == 10 and np.median(sub) == pytest.approx(np.median([r[2] for r in rows]))
    with pytest.raises(ValueError):
        en.median_anchored(df, ["g"], "run", "w", 9)
    with pytest.raises(Exception, match="not enough runs"):
        en.median_anchored(df.limit(5), ["g"], "run", "w", 10).collect()


def test_nearest_in_time_holds_and_rejects(spark):
    src = spark.createDataFrame([("s", 100, 1.0), ("s", 112, 2.0)], "s string, month_idx int, v double")
    ask = spark.createDataFrame([("s", i) for i in (90, 105, 106, 107, 130)], "s string, month_idx int")
    got = {r["month_idx"]: r["x"] for r in pr.nearest_in_time(ask, src, ["s"], "v", "x").collect()}
    assert got == {90: 1.0, 105: 1.0, 106: 1.0, 107: 2.0, 130: 2.0}
    with pytest.raises(Exception, match="beyond 24 months"):
        pr.nearest_in_time(ask.union(spark.createDataFrame([("s", 200)], ask.schema)), src, ["s"], "v", "x").collect()


def test_radiation_offsets_of_constant_fields(spark):
    rows = [(p, y, m, 100.0 + p) for p in (1, 2) for y in range(1980, 1992) for m in (1, 7)]
    ref = spark.createDataFrame(rows, "point_id int, year int, month int, rsds double")
    mod = ref.withColumn("rsds", F.col("rsds") - 7).where("NOT (year = 1985 AND point_id = 1)")
    got = pr.radiation_offsets(ref, mod, "rsds", (1980, 1991)).collect()
    assert len(got) == len(rows) and all(r["offset"] == pytest.approx(7.0) for r in got)


def test_nearest_on_sphere_against_brute_force(spark):
    from gridseries.operators.spatial import nearest_on_sphere

    rng = np.random.default_rng(9)
    lat = np.concatenate([rng.uniform(-89, 89, 40), [90.0, -90.0, 0.1, 0.1]])
    lon = np.concatenate([rng.uniform(0, 360, 40), [0.0, 0.0, 359.9, 0.1]])
    df = spark.createDataFrame([(i, float(a), float(o)) for i, (a, o) in enumerate(zip(lat, lon))], "point_id int, lat double, lon double")
    xyz = np.stack([np.cos(np.radians(lat)) * np.cos(np.radians(lon)), np.cos(np.radians(lat)) * np.sin(np.radians(lon)), np.sin(np.radians(lat))], 1)
    want = {i: list(np.lexsort((np.arange(44), np.round(1 - xyz @ xyz[i], 12)))[:3]) for i in range(44)}
    got = {}
    for r in nearest_on_sphere(df, 3, 8.0).orderBy("point_id", "rank").collect():
        got.setdefault(r["point_id"], []).append(r["neighbour_id"])
    assert got == want
