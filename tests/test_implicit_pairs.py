import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridseries.operators import scores as sc


def vectors(spark, groups):
    rows = [(s, item, k, [float(x) for x in v]) for (s, item), vs in groups.items() for k, v in enumerate(vs)]
    return spark.createDataFrame(rows, "s int, item string, model int, vec array<double>")


def brute(groups, item):
    d = [np.sqrt(((a - b) ** 2).sum()) for (_, it), vs in groups.items() if it == item for i, a in enumerate(vs) for b in vs[i + 1:]]
    d = [x for x in d if x > 0]
    return np.median(d) if d else None


@pytest.mark.parametrize("bins, values", [(4, 3), (1024, 4096), (2, 1)])
def test_median_of_implicit_pairs(spark, bins, values):
    """Ties, equal vectors (distance 0), single vectors and several blocks."""
    rng = np.random.default_rng(2)
    groups = {(1, "a"): rng.normal(size=(30, 3)), (2, "a"): rng.integers(0, 2, (25, 3)).astype(float), (1, "b"): np.ones((4, 3)), (1, "c"): rng.normal(size=(1, 3)), (1, "d"): rng.integers(0, 2, (40, 2)).astype(float), (3, "e"): rng.normal(size=(2, 3))}
    got = {r["item"]: r["m"] for r in sc.pair_distance_median(vectors(spark, groups), ["s", "item"], ["item"], "model", "vec", "m", block=8, bins=bins, values=values).collect()}
    want = {i: brute(groups, i) for i in "abcde"}
    assert set(got) == {i for i, m in want.items() if m is not None} == {"a", "d", "e"}
    for i, m in got.items():
        assert m == pytest.approx(want[i], abs=1e-12)


def test_no_pairs(spark):
    empty = spark.createDataFrame([], "s int, item string, model int, vec array<double>")
    assert sc.pair_distance_median(empty, ["s", "item"], ["item"], "model", "vec", "m").count() == 0


def test_summary_computes_scores_once(spark):
    """All pairs of a table are behind the scores; sizes and percentiles both read them."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame([("a" if k % 2 else "b", float(k)) for k in range(40)], "cls string, s double")
    got = {r["cls"]: (r["n"], r["median_s"], r["iqr"]) for r in sc.score_summary(rows.mapInArrow(counted, rows.schema), ["cls"]).collect()}
    assert got == {"a": (20, 20.0, 19.0), "b": (20, 19.0, 19.0)}
    assert seen.value == 40


def test_blocks_hold_null_components_and_null_keys(spark):
    """A pair with an unknown component has no distance; a group without a name is a group."""
    rows = [(None, 0, [0.0, 0.0]), (None, 1, [3.0, 4.0]), (None, 2, [3.0, 4.0, 9.0]), ("x", 0, [0.0, None]), ("x", 1, [1.0, 1.0]), ("y", 0, [2.0, 2.0])]
    blocks = spark.createDataFrame([(k, 0, 0, [c for j, _, v in rows if j == k for c in v[:2]], 2) for k in (None, "x", "y")], "k string, _b int, _other int, _m array<double>, _len int")
    found = sc._on_pairs(blocks.withColumn("_m2", F.col("_m")), ["k"], lambda d: [pa.array(d, pa.float64())], {"d": T.DoubleType()})
    got = sorted((r["k"] or "", r["d"]) for r in found.collect())
    assert got[:3] == [("", 0.0), ("", 5.0), ("", 5.0)] and got[3][0] == "x" and np.isnan(got[3][1]) and len(got) == 4
