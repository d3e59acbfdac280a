"""Results that the last digit of a double must not change."""

import random

import duckdb
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from gridseries.operators import ensemble as en


def test_exceedance_of_references_that_vary_in_the_last_digit(spark):
    """Means computed anew may differ in their last digit; every reference row is answered all the same."""
    shaken = F.udf(lambda v: v + random.random() * 1e-9, "double").asNondeterministic()
    ref = spark.range(40).select(F.lit(1).alias("month"), F.col("id").cast("int").alias("year"), shaken(F.col("id") + 0.5).alias("v"))
    samples = spark.range(40).select(F.lit(1).alias("month"), F.col("id").cast("double").alias("s"))
    got = en.exceedance(ref, samples, "v", "s", ["month"], ["year", "month"]).collect()
    assert {r["year"]: r["p"] for r in got} == {k: (k + 1) / 40 for k in range(40)}


def test_points_on_slanted_edges(spark, tmp_path):
    """Positions that lie on an edge in decimals fall on the side that the SQL gives."""
    con = duckdb.connect()
    for name in ("nation", "region"):
        con.execute(f"COPY (SELECT * FROM '/root/testdata/sf0.001/{name}.parquet') TO '{tmp_path}/{name}.parquet'")
    con.execute(f"COPY (SELECT range AS s_suppkey, 's' AS s_name, CAST(range % 25 AS INT) AS s_nationkey, 0.0::DOUBLE AS s_acctbal FROM range(6000)) TO '{tmp_path}/supplier.parquet'")
    for name in ("nation", "region", "supplier"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    want = {tuple(r) for r in con.execute(oracle_sql()["join_11_polygon_cover"]).fetchall()}
    assert {tuple(r) for r in queries()["join_11_polygon_cover"](spark, str(tmp_path)).collect()} == want
