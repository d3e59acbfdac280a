import json

import pytest
from pyspark.sql import functions as F

from gridseries.operators import catalog as ct
from gridseries.sources import readers as rd
from gridseries.sources import store as st
from gridseries.streaming import ingest as ig


def metric(spark, rows):
    return spark.createDataFrame(
        [("gofnc", "d", t, "v", "s", "m", "e", "c", "cm", float(x), tag, i) for t, x, tag, i in rows],
        "metrickey string, metricdomain string, metrictype string, variable string, source_id string, member_id string, experiment_id string,"
        "comp_source_id string, comp_member_id string, value double, version_tag string, i int",
    )


def test_row_key_is_md5_of_sorted_json(spark):
    import hashlib

    row = st.with_identity(metric(spark, [("t", 1, None, 0)])).first()
    parts = {"metrickey": "gofnc", "metricdomain": "d", "metrictype": "t", "variable": "v", "source_id": "s", "member_id": "m", "experiment_id": "e",
             "comp_source_id": "c", "comp_member_id": "cm", "version_tag": "versionless"}
    assert row["row_key"] == hashlib.md5(json.dumps(parts, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def test_metric_table_round_trip_and_upsert(spark, tmp_path):
    path = str(tmp_path / "metrics")
    first = st.with_identity(metric(spark, [("a", 1, "v1", 0), ("b", 2, "v2", 1)])).drop("i")
    st.write_metrics(first, path)
    again = st.with_identity(metric(spark, [("b", 9, "v2", 2)])).drop("i")
    st.write_metrics(again, path, mode="overwrite")
    got = {r["metrictype"]: r["value"] for r in spark.read.parquet(path).collect()}
    assert got == {"a": 1.0, "b": 9.0}


def test_append_runs_skips_stored_runs(spark, tmp_path):
    path = str(tmp_path / "runs")
    df = spark.createDataFrame([("f", 1, 1.0), ("f", 2, 2.0)], "forcing string, run_id int, v double")
    st.append_runs(df.where("run_id = 1"), path, ["forcing"])
    st.append_runs(df, path, ["forcing"])
    st.append_runs(df, path, ["forcing"])
    assert sorted(r["run_id"] for r in spark.read.parquet(path).collect()) == [1, 2]


def test_stream_upsert_is_idempotent(spark, tmp_path):
    src, table = tmp_path / "in", str(tmp_path / "table")
    src.mkdir()
    rows = metric(spark, [("a", 1, "v1", 0), ("a", 2, "v1", 1), ("b", 3, "v1", 2)])
    rows.coalesce(1).write.parquet(str(src / "p1"))
    stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(src))
    ig.start_upsert(stream, table, str(tmp_path / "c1"), ["i"]).awaitTermination()
    assert {r["metrictype"]: r["value"] for r in ig.current_table(spark, table).collect()} == {"a": 1.0, "b": 3.0}
    metric(spark, [("a", 7, "v1", 5), ("c", 8, "v1", 6)]).coalesce(1).write.parquet(str(src / "p2"))
    stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).parquet(str(src))
    ig.start_upsert(stream, table, str(tmp_path / "c1"), ["i"]).awaitTermination()
    got = {r["metrictype"]: r["value"] for r in ig.current_table(spark, table).collect()}
    assert got == {"a": 1.0, "b": 3.0, "c": 8.0}
    run = ig.upsert_batch(table, ["i"], False)
    run(metric(spark, [("a", 7, "v1", 5), ("c", 8, "v1", 6)]), 1)
    assert {r["metrictype"]: r["value"] for r in ig.current_table(spark, table).collect()} == got
    assert {r["metrictype"]: r["value"] for r in ig.current_table(spark, table, overwrite=True).collect()} == {"a": 7.0, "b": 3.0, "c": 8.0}
    ig.compact(spark, table, str(tmp_path / "small"))
    assert {r["metrictype"]: r["value"] for r in ig.current_table(spark, str(tmp_path / "small")).collect()} == got


def test_stream_first_wins_within_watermark(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = metric(spark, [("a", 1, "v1", 0), ("a", 1, "v1", 1), ("b", 3, "v1", 2)]).withColumn("timestamp", F.timestamp_seconds(F.lit(1_700_000_000)))
    rows.coalesce(1).write.parquet(src)
    out = ig.first_wins(ig.metric_stream(spark, src, rows.schema))
    job = out.writeStream.format("memory").queryName("first_wins").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    job.awaitTermination()
    assert sorted(r["metrictype"] for r in spark.table("first_wins").collect()) == ["a", "b"]


def test_payload_files(spark, tmp_path):
    folder = tmp_path / "pr"
    folder.mkdir()
    body = {"years": [2000, 2001], "percentiles": {k: [1.0, 2.0] for k in rd.PERCENTILE_KEYS}, "era5": {"years": [2001], "values": [9.0]}, "meta": {"n_members": 20}}
    (folder / "H.json").write_text(json.dumps(body, indent=1))
    rows = rd.read_payloads(spark, str(folder)).orderBy("year").collect()
    assert [(r["variable"], r["scenario"], r["year"], r["p50"], r["reference"]) for r in rows] == [("pr", "H", 2000, 1.0, None), ("pr", "H", 2001, 2.0, 9.0)]


def test_prediction_csv(spark, tmp_path):
    f = tmp_path / "p.csv"
    f.write_text("model,scenario,is_test,variable,obs,pred_mean,pred_p10,pred_p90\nm,s, TRUE,v,1,2,0,3\nm,s,no,v,,2,0,3\nm,x,1,v,1,2,0,3\nm,s,0,v,z,2,0,3\n")
    clean, counters = rd.clean_predictions(rd.read_text_csv(spark, str(f), rd.PREDICTION_TEXT), ["x"])
    assert [(r["model"], r["is_test"], r["obs"]) for r in clean.collect()] == [("m", True, 1.0)]
    assert tuple(counters.first()) == (4, 2, 1, 1)


def test_csv_structure_respects_quotes(spark):
    lines = spark.createDataFrame([(1, 'a,"b,c",d'), (2, "a,b"), (3, ""), (4, 'a,"x ""y"", z",c'), (5, "a,b,c,d")], "line_no int, line string")
    got = {r["line_no"]: r["fields"] for r in rd.structure_failures(lines, "line", "h1,h2,h3").collect()}
    assert got == {2: 2, 5: 4}


def test_year_columns_and_missing_years():
    assert rd.year_columns(["a", "1995", "1996.0", "1995"]) == {1995: "1995", 1996: "1996.0"}
    with pytest.raises(ValueError, match="missing years"):
        rd.period_columns(["1995"], 1995, 1996)


def test_summary_csv_has_sorted_columns(spark, tmp_path):
    out = tmp_path / "s"
    st.write_summary_csv(spark.createDataFrame([(1, 2.0)], "b int, a double"), str(out))
    text = next(out.glob("*.csv")).read_text().splitlines()
    assert text == ["a,b", "2.0,1"]


def test_emulator_names(spark):
    rows = [("/x/DAT_M1_ssp245_r1i1p1f1_pr-tas.nc",), ("/x/EMU-v1-dep-20240101-1200_M1_ssp245_r2i1p1f1_pr.nc",), ("/x/EMU-v1-2024Jan01_1200_ssp585_r3i1p1f1.nc",)]
    got = [tuple(r)[1:4] for r in ct.parse_names(spark.createDataFrame(rows, "path string")).collect()]
    assert got == [("M1", "ssp245", "r1i1p1f1"), ("M1", "ssp245", "r2i1p1f1"), ("GXE", "ssp585", "r3i1p1f1")]


def test_partner_blocks_cover_a_hot_group_once(spark):
    rows = [("hot", f"f{i:03d}") for i in range(83)] + [("cold", "x"), ("cold", "y")]
    b = ct.partner_blocks(spark.createDataFrame(rows, "g string, f string"), ["g"], "f", block=10).collect()
    seen = {}
    for r in b:
        pairs = [(x, y) for x in r["items_a"] for y in r["items_b"] if (x < y if r["block_a"] == r["block_b"] else True)]
        seen.setdefault(r["g"], []).extend(tuple(sorted(p)) for p in pairs)
    assert len(seen["hot"]) == len(set(seen["hot"])) == 83 * 82 // 2 and seen["cold"] == [("x", "y")]


def test_stitch_rejects_overlap(spark):
    p = spark.createDataFrame([(1, 10), (1, 12)], "k int, month_idx int")
    assert ct.stitch(p.where("month_idx = 10"), p.where("month_idx = 12"), ["k"]).count() == 2
    with pytest.raises(ValueError):
        ct.stitch(p, p, ["k"])


def test_pending_tasks(spark):
    t = spark.createDataFrame([("v1", "a"), ("v1", "b")], "version string, scenario string")
    ledger = spark.createDataFrame([("v1", "a", "completed"), ("v1", "b", "failed")], "version string, scenario string, status string")
    assert [r["scenario"] for r in ig.pending_tasks(t, ledger, ["version", "scenario"]).collect()] == ["b"]
