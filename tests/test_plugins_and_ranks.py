import sys

import pytest
from pyspark.sql import functions as F

from gridseries.functions.ranks import row_numbers
from gridseries.operators import catalog as ct
from gridseries.operators import recipes as rc


def test_hot_value_spreads_over_partitions(spark):
    """100,000 equal values: rows in several partitions, numbers without gaps."""
    df = spark.range(100_000).select(F.lit("g").alias("g"), F.lit(1.0).alias("v"), "id").unionByName(spark.range(50).select(F.lit("g").alias("g"), F.lit(0.0).alias("v"), "id"))
    out = row_numbers(df, ["g"], ["v"], "k", "n", parts=8)
    assert out.agg(F.count_distinct("k"), F.min("k"), F.max("k"), F.min("n")).first()[:] == (100_050, 0, 100_049, 100_050)
    assert out.where("v = 0").agg(F.max("k")).first()[0] == 49
    same = spark.range(100_000).select(F.lit("g").alias("g"), F.lit(1.0).alias("v"))
    for df_ in (df, same):
        spread = df_.repartition(16).repartitionByRange(8, "g", "v", F.xxhash64(*df_.columns, F.spark_partition_id()))
        assert spread.withColumn("p", F.spark_partition_id()).where("v = 1").agg(F.count_distinct("p")).first()[0] > 3
    numbered = row_numbers(same, ["g"], ["v"], "k", "n", parts=8)
    assert numbered.agg(F.count_distinct("k"), F.max("k")).first()[:] == (100_000, 99_999)


def test_member_order_of_any_size(spark):
    df = spark.createDataFrame([("s", f"r{k}i1p1f1") for k in (10, 2, 1, 33)] + [("t", "odd"), (None, "r1")], "source_id string, member_id string")
    got = {(r["source_id"], r["member_id"]): r["rank"] for r in ct.ordered_members(df, ["source_id"]).collect()}
    assert [got["s", f"r{k}i1p1f1"] for k in (1, 2, 10, 33)] == [1, 2, 3, 4] and got["t", "odd"] == got[None, "r1"] == 1


@pytest.fixture
def jobs(spark):
    return spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0), (None, 4.0)], "job string, x double")


def doubled(seen):
    def gof(a, b, cfg):
        seen.extend(r["job"] for r in a.select("job").collect())
        return a.join(b.withColumnRenamed("x", "y"), "job").select("job", F.explode(F.array(F.lit("sum"), F.lit("twice"))).alias("metrictype"), (F.col("x") + F.col("y")).alias("value"))

    return gof


def expected(jobs, cfg):
    return jobs.where("job <> 'c' OR job IS NULL").select("job", F.explode(F.array(F.lit("sum"), F.lit("twice"))).alias("metrictype"))


def test_stored_jobs_do_not_run(spark, jobs):
    """Whole jobs are skipped before the recipe sees them; a job without expected records never runs."""
    seen = []
    rc.recipe("doubled", expected)(doubled(seen))
    stored = spark.createDataFrame([("a", "sum"), ("a", "twice"), ("b", "sum")], "job string, metrictype string")
    open_ = rc.open_jobs("doubled", jobs, stored, ["job"], ["metrictype"], {})
    assert {r["job"] for r in open_.collect()} == {"b", None}
    got = rc.run_open_jobs("doubled", jobs, jobs, jobs, stored, ["job"], ["metrictype"], {})
    assert [tuple(r) for r in got.collect()] == [("b", "twice", 4.0)]
    assert set(seen) == {"b"}
    everything = stored.unionByName(spark.createDataFrame([("b", "twice"), (None, "sum"), (None, "twice")], stored.schema))
    assert rc.open_jobs("doubled", jobs, everything, ["job"], ["metrictype"], {}).count() == 0


def test_plugin_module(spark, jobs, tmp_path, monkeypatch):
    (tmp_path / "my_scores_plugin.py").write_text(
        "from gridseries.operators.recipes import recipe\n\n\n@recipe('Mine', lambda jobs, cfg: jobs.selectExpr('job', \"'m' AS metrictype\"))\ndef mine(a, b, cfg):\n    return a.selectExpr('job', \"'m' AS metrictype\", 'x AS value')\n"
    )
    monkeypatch.syspath_prepend(str(tmp_path))
    monkeypatch.setattr(rc, "RECIPES", dict(rc.RECIPES))
    monkeypatch.setattr(rc, "EXPECTED", dict(rc.EXPECTED))
    assert rc.load_plugin("my_scores_plugin") == ["Mine"]
    assert rc.open_jobs("Mine", jobs, jobs.selectExpr("job", "'m' AS metrictype"), ["job"], ["metrictype"], {}).count() == 0
    sys.modules.pop("my_scores_plugin")
    with pytest.raises(KeyError):
        rc.open_jobs("drought", jobs, jobs, ["job"], [], {})


def test_availability_rows(spark):
    cat = spark.createDataFrame([("s", "e", "m", "tab", "pr", "p1"), ("s", "e", "m", "tab", "pr", "p2"), ("s", "e", "m", "tab", "tas", "p3"), ("s", "e", "n", "tab", "xx", "p4")], "source_id string, experiment_id string, member_id string, table_id string, variable string, path string")
    wanted = spark.createDataFrame([("tab", "pr"), ("tab", "tas")], "table_id string, variable string")
    rows = {(r["member_id"], r["path"]): (r["n_variable"], r["n_triplet"]) for r in ct.availability_rows(cat, wanted, cat.select("source_id", "experiment_id", "member_id").distinct()).collect()}
    assert rows == {("m", "p1"): (2, 3), ("m", "p2"): (2, 3), ("m", "p3"): (1, 3), ("n", None): (0, 0)}
