"""Python functions on whole series that come in batches of many."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridseries.operators import recipes as rc
from gridseries.operators import timeseries as ts


@pytest.fixture(params=[7, 10_000])
def batch_rows(request, spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", request.param)
    yield request.param
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def series(spark):
    """Series of 1, 2, ... 30 rows and one of 60 without a key."""
    some = spark.range(1, 31).select(F.col("id").alias("k"), F.explode(F.sequence(F.lit(0), F.col("id") - 1)).alias("t"))
    return some.unionByName(spark.range(60).select(F.lit(None).cast("bigint").alias("k"), F.col("id").alias("t")))


@pytest.mark.parametrize("many", [False, True])
def test_series_are_whole(spark, batch_rows, many):
    def sizes(pdf):
        if not many:
            assert pdf["k"].nunique(dropna=False) == 1
        g = pdf.assign(n=pdf.groupby("k", dropna=False)["t"].transform("size")).drop_duplicates("k")
        return g[["k", "n"]]

    got = [(r["k"], r["n"]) for r in rc.fit_series(series(spark), ["k"], sizes, "k bigint, n bigint", many=many).collect()]
    assert sorted(got, key=str) == sorted([(None, 60), *[(k, k) for k in range(1, 31)]], key=str)


def test_short_series_share_calls(spark):
    df = spark.range(20_000).select((F.col("id") / 2).cast("bigint").alias("k"))
    calls = rc.fit_series(df, ["k"], lambda pdf: pdf.iloc[:1].assign(n=pdf["k"].nunique())[["n"]], "n bigint", many=True).collect()
    assert sum(r["n"] for r in calls) == 10_000 and len(calls) < 50


def test_many_chunks_equal_whole_series(spark, batch_rows):
    df = spark.range(400).select((F.col("id") % 4).alias("s"), F.floor(F.col("id") / 4).cast("int").alias("month_idx"), (F.col("id") * 7 % 13).cast("double").alias("v"))

    def total(pdf):
        rolled = pdf.groupby(["s", "_start"])["v"].rolling(4, min_periods=1).sum()
        return pdf[["s", "month_idx"]].assign(t=rolled.droplevel([0, 1]))

    got = ts.chunked_apply(df, ["s"], total, "s bigint, month_idx int, t double", chunk=11, context=3, many=True).toPandas().sort_values(["s", "month_idx"])
    whole = df.toPandas().sort_values(["s", "month_idx"])
    np.testing.assert_allclose(got["t"], whole.groupby("s")["v"].rolling(4, min_periods=1).sum())
