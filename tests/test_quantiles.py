import numpy as np
import pytest
from pyspark.sql import functions as F

from gridseries.functions.quantiles import grouped_percentiles
from gridseries.functions.ranks import row_numbers

PROBS = [0.0, 0.05, 0.33, 0.5, 0.95, 1.0]
NAMES = [f"q{i}" for i in range(len(PROBS))]


def check(spark, data, **kw):
    rows = [(k, float(v)) for k, vs in data.items() for v in vs]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r["k"]: r for r in grouped_percentiles(df, ["k"], "v", PROBS, NAMES, **kw).collect()}
    assert set(got) == set(data)
    for k, vs in data.items():
        assert got[k]["n"] == len(vs)
        np.testing.assert_allclose([got[k][n] for n in NAMES], np.quantile(vs, PROBS), rtol=1e-12, atol=1e-12)


def sets():
    rng = np.random.default_rng(1)
    return {
        "hot": rng.normal(size=3000), "ties": rng.integers(0, 3, 900).astype(float), "outlier": np.append(rng.random(700), [1e30, -1e30]),
        "small": rng.random(7), "one": np.array([4.0]), "constant": np.full(500, 2.5), "exp": np.exp(rng.normal(size=800) * 20),
    }


def test_no_hot_group(spark):
    check(spark, sets())


def test_hot_groups_by_selection(spark):
    check(spark, sets(), hot_rows=60)


def test_all_groups_hot(spark):
    check(spark, {"a": np.arange(100.0), "b": -np.arange(50.0)}, hot_rows=1)


def test_no_keys_and_nulls(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 10 > 0, F.col("id").cast("double")).alias("v"))
    row = grouped_percentiles(df, [], "v", [0.5], ["m"], hot_rows=50).collect()[0]
    want = [i for i in range(1000) if i % 10]
    assert row["n"] == len(want) and row["m"] == pytest.approx(np.median(want))


def test_row_numbers_of_hot_groups_in_bins(spark):
    df = spark.range(2000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise((F.col("id") % 7).cast("string")).alias("g"), (F.col("id") * F.col("id") % 997).alias("v"), "id",
        F.timestamp_seconds(F.col("id") % 50).alias("t"),
    )
    for order in (["v", "id"], ["t", "id"]):
        plain = {tuple(r) for r in row_numbers(df, ["g"], order, "i", "n").select("id", "i", "n").collect()}
        binned = {tuple(r) for r in row_numbers(df, ["g"], order, "i", "n", parts=16).select("id", "i", "n").collect()}
        assert plain == binned and len(plain) == 2000


@pytest.mark.parametrize("hot_rows", [5, 4_000_000])
def test_missing_values_on_both_ways(spark, hot_rows):
    """NaN, infinities and null groups give the same rows whichever way answers."""
    values = [float(i) for i in range(39)] + [float("inf"), float("-inf"), float("nan"), None]
    df = spark.createDataFrame([(k, v) for k in ("a", None) for v in values] + [("empty", None), ("empty", float("nan"))], "k string, v double")
    got = {r["k"]: (r["n"], r["m"]) for r in grouped_percentiles(df, ["k"], "v", [0.5], ["m"], hot_rows=hot_rows).collect()}
    assert got == {"a": (39, 19.0), None: (39, 19.0)}


def test_tiny_differences_end(spark):
    df = spark.createDataFrame([(5e-324 * (i % 2),) for i in range(40)], "v double")
    row = grouped_percentiles(df, [], "v", [0.0, 1.0], ["lo", "hi"], hot_rows=5).first()
    assert (row["lo"], row["hi"]) == (0.0, 5e-324)


def test_row_numbers_of_nulls_and_text(spark):
    rows = [(g, o, i) for i, (g, o) in enumerate([("a", None), ("a", "x"), ("a", "b"), (None, "z"), (None, None), ("a", "b")])]
    df = spark.createDataFrame(rows, "g string, o string, id int")
    got = {r["id"]: (r["i"], r["n"]) for r in row_numbers(df, ["g"], ["o", "id"], "i", "n", parts=4).collect()}
    assert got == {0: (0, 4), 2: (1, 4), 5: (2, 4), 1: (3, 4), 4: (0, 2), 3: (1, 2)}
