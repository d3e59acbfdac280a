"""Work that must not meet in one task."""

import random

from pyspark.sql import functions as F

from gridseries.operators import catalog as ct
from gridseries.operators import predictors as pd_
from gridseries.operators import recipes as rc
from gridseries.operators import spatial as sp
from gridseries.session import task_count


def test_nearest_of_crowded_sources(spark):
    """Crowds, copies of a position and lone points, against brute force; crowded cells are narrowed."""
    rng = random.Random(2)
    crowd = [(10 + k, rng.uniform(10, 12), rng.uniform(0, 2)) for k in range(600)]
    sources = [*crowd, *[(9000 - k, lat, lon) for k, lat, lon in crowd[:300]], (1, -80.0, 200.0), (2, 89.0, 359.5), (3, -80.0, 200.0)]
    asked = [(k, rng.uniform(9, 13), rng.uniform(-2, 4)) for k in range(200)] + [(500 + k, rng.uniform(-90, 90), rng.uniform(0, 360)) for k in range(60)]
    df = spark.createDataFrame(sources, "point_id int, lat double, lon double")
    got = {r["template_id"]: r["point_id"] for r in sp.nearest_on_grid(df, spark.createDataFrame(asked, "template_id int, lat double, lon double"), 4.0).collect()}

    def d(lat, lon, s):
        east = abs(s[2] % 360 - lon % 360)
        return round((s[1] - lat) ** 2 + min(east, 360 - east) ** 2, 9), s[0]

    assert got == {t: min(d(lat, lon, s) for s in sources)[1] for t, lat, lon in asked}
    positions = df.select(F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    assert sp.first_cell(positions, 4.0) < 0.5
    assert sp.first_cell(positions.limit(0), 4.0) == 4.0


def test_few_jobs_are_dealt_out(spark):
    jobs = spark.range(100).coalesce(1).select(F.col("id").alias("job"), F.array(F.lit("w1"), F.lit("w2")).alias("windows"))
    rows = ct.expected_records(jobs, [3], ["A_#X"], [], [])
    assert rows.select(F.spark_partition_id()).distinct().count() > 4 and rows.count() == 200


def test_consolidated_rows_are_partitioned_before_grouping(spark):
    axis = spark.range(2000).coalesce(1).select(F.col("id").alias("p"), F.lit(5).alias("month_idx"), F.lit(1.0).alias("value"))
    wide = pd_.consolidate({"a": axis, "b": axis.where("p < 10")}, ["p"], axis)
    assert wide.select(F.spark_partition_id()).distinct().count() == task_count(spark)
    assert wide.where("a IS NOT NULL").count() == 2000 and wide.where("b IS NOT NULL").count() == 10


def test_index_rows_are_dealt_by_their_number(spark, monkeypatch):
    """No task of the index holds more rows than its share, whatever their bytes."""
    held, rolling = [], rc.rolling_sum

    def watched(*args):
        out = rolling(*args)
        placed = out.select(F.spark_partition_id().alias("task"), args[-1]).groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.sum(args[-1]))
        held.append(placed.sort(F.desc("n")).first()["n"])
        return out

    monkeypatch.setattr(rc, "rolling_sum", watched)
    monkeypatch.setattr(rc, "INDEX_ROWS", 500, raising=False)
    months = spark.range(100 * 48).select(F.floor(F.col("id") / 48).alias("point_id"), (F.col("id") % 48 + 24000).cast("int").alias("month_idx"))
    rows = months.select("point_id", F.floor(F.col("month_idx") / 12).cast("int").alias("year"), (F.col("month_idx") % 12 + 1).alias("month"), "month_idx", F.rand(1).alias("wb"))
    out = rc.index_comparison(rows, rows.withColumn("wb", F.col("wb") + F.rand(2)), {"windows": [(2000, 2003)], "scales": [1, 3]})
    assert out.count() == 14 and len(held) == 2
    # 9,600 rows by two scales: 39 tasks, whose share of the 100 points varies.
    assert max(held) <= 960
