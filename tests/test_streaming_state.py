"""Keyed state: out-of-order rows, restarts, rows beyond the watermark."""

import pytest

from gridseries.streaming import state

SCHEMA = "k string, version bigint, ts timestamp, value double"


def feed(spark, folder, batch):
    rows = [(k, v, f"2024-01-{day:02d} 00:00:00", float(v)) for k, v, day in batch]
    spark.createDataFrame(rows, "k string, version bigint, ts string, value double").selectExpr("k", "version", "CAST(ts AS TIMESTAMP) AS ts", "value").coalesce(1).write.mode("append").parquet(folder)


def run(spark, tmp_path, batches, keep, delay="5 days", ttl_ms=10**10):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for batch in batches:
        feed(spark, src, batch)
        stream = spark.readStream.schema(SCHEMA).parquet(src)
        state.run_available(state.standing_rows(stream, "k", "version", "ts", delay, keep, ttl_ms), out, str(tmp_path / "check"))
    table = {r["k"]: r["version"] for r in state.standing_table(spark, out, "k", "version", keep).collect()}
    return table, spark.read.parquet(out).count()


def test_last_version_stands(spark, tmp_path):
    batches = [[("a", 3, 10), ("b", 1, 10), ("a", 2, 11)], [("a", 1, 12), ("b", 4, 9), ("c", 1, 12)], [("c", 9, 2), ("d", 1, 2), ("b", 2, 13)]]
    table, written = run(spark, tmp_path, batches, "last")
    assert table == {"a": 3, "b": 4, "c": 1}  # the rows of day 2 lie beyond the watermark
    assert written == 4  # a 3, b 1, b 4, c 1: rows that change nothing are not written


def test_first_batch_stands(spark, tmp_path):
    table, written = run(spark, tmp_path, [[("a", 3, 10), ("a", 2, 10)], [("a", 1, 11), ("b", 5, 11)], [("b", 1, 12)]], "first")
    assert table == {"a": 2, "b": 5} and written == 2


def test_expired_key_stands_anew(spark, tmp_path):
    batches = [[("a", 3, 1)], [("b", 1, 20)], [("c", 1, 25)], [("a", 1, 26)]]
    table, _ = run(spark, tmp_path, batches, "first", delay="1 day", ttl_ms=0)
    assert table == {"a": 3, "b": 1, "c": 1}
    assert spark.read.parquet(str(tmp_path / "out")).where("k = 'a'").count() == 2


def test_unknown_rule():
    with pytest.raises(ValueError):
        state.StandingRow("version", "ts", "best", 0)


@pytest.mark.parametrize("buckets", [1, 3])
def test_keys_of_one_bucket(spark, tmp_path, buckets):
    """Keys that share a state stand, expire and come anew each by its own rows."""
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for batch in [[("a", 3, 1), ("b", 5, 1), ("c", 2, 19)], [("c", 1, 20), ("d", 7, 20)], [("c", 9, 25)], [("a", 1, 26), ("b", 2, 27), ("c", 4, 26)]]:
        feed(spark, src, batch)
        stream = spark.readStream.schema(SCHEMA).parquet(src)
        state.run_available(state.standing_rows(stream, "k", "version", "ts", "1 day", "first", 3 * 86_400_000, buckets), out, str(tmp_path / "check"))
    rows = sorted((r["k"], r["version"]) for r in spark.read.parquet(out).collect())
    assert rows == [("a", 1), ("a", 3), ("b", 2), ("b", 5), ("c", 2), ("d", 7)]
