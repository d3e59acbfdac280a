"""Keyed state over micro-batches: which row of a key stands.

One number per key, the version of the row that stands, is kept as value state
with a time; rows come in any order and over any number of batches and restarts,
and only rows that change what stands are passed on. Rows older than the watermark
are dropped by Spark before they reach the state. Keys are dealt into buckets by
hash, and a bucket's keys are one state with one timer: every call to the state
goes through a socket, which is dear for a key at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

#: The state store that keyed processors need, and its setting.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


#: Buckets of keys; a batch reads and writes the buckets that its keys fall into. Fixed for a checkpoint.
BUCKETS = 2**12


class StandingRow(StatefulProcessor):
    """Keeps the versions of the standing rows of a bucket of keys.

    ``keep`` is ``last``: the largest version stands, whenever it comes; or
    ``first``: the first batch that brings the key decides, by its smallest
    version. State of a key is dropped when the watermark passes its newest row
    by ``ttl_ms``; for ``first`` a later row of the key would then stand anew.
    """

    def __init__(self, version: str, time: str, keep: str, ttl_ms: int, key: str = "row_key", key_type: T.DataType | None = None):
        if keep not in ("first", "last"):
            raise ValueError("keep is first or last")
        self.version, self.time, self.keep, self.ttl_ms = version, time, keep, ttl_ms
        self.key, self.key_type = key, key_type or T.StringType()

    def init(self, handle) -> None:
        self.handle = handle
        many = lambda kind: T.ArrayType(kind)
        fields = [("keys", many(self.key_type)), ("versions", many(T.LongType())), ("until", many(T.LongType())), ("due", T.LongType())]
        self.state = handle.getValueState("standing", T.StructType([T.StructField(n, t) for n, t in fields]))

    def _store(self, kept: dict, due: int | None) -> None:
        """Write the bucket's keys and move its timer to the first time at which one of them ends."""
        first = min((until for _, until in kept.values()), default=None)
        if first != due:
            if due is not None:
                self.handle.deleteTimer(due)
            if first is not None:
                self.handle.registerTimer(first)
        if kept:
            self.state.update((list(kept), [v for v, _ in kept.values()], [u for _, u in kept.values()], first))
        else:
            self.state.clear()

    def _load(self) -> tuple[dict, int | None]:
        stored = self.state.get() if self.state.exists() else None
        if stored is None:
            return {}, None
        return dict(zip(stored[0], zip(stored[1], stored[2], strict=True), strict=True)), stored[3]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[T.Row]:  # noqa: N802, N803
        came: dict = {}  # key: (best row, newest time) of this batch
        for row in rows:
            at = int(row[self.time].timestamp() * 1000)
            best, newest = came.get(row[self.key], (None, at))
            ahead = best is None or (row[self.version] > best[self.version] if self.keep == "last" else row[self.version] < best[self.version])
            came[row[self.key]] = (row if ahead else best, max(newest, at))
        kept, due = self._load()
        changed = []
        for k, (best, newest) in came.items():
            stored = kept.get(k)
            ahead = stored is None or (self.keep == "last" and best[self.version] > stored[0])
            kept[k] = (best[self.version] if ahead else stored[0], max(newest + self.ttl_ms, 0 if stored is None else stored[1]))
            if ahead:
                changed.append(best)
        self._store(kept, due)
        for best in changed:
            yield T.Row(**{c: best[c] for c in best.__fields__ if c != "_bucket"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[T.Row]:  # noqa: N802, N803
        kept, _ = self._load()
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        # The timer that has fired is gone already.
        self._store({k: e for k, e in kept.items() if e[1] > now}, None)
        return iter(())

    def close(self) -> None:
        pass


def standing_rows(stream: DataFrame, key: str, version: str, time: str, delay: str, keep: str = "last", ttl_ms: int = 0, buckets: int = BUCKETS) -> DataFrame:
    """The rows of ``stream`` that become their key's standing row, in update mode.

    ``version`` is a number without nulls; rows whose key, version or time is null
    are left out. ``delay`` is how late a row may be. ``buckets`` is the number of
    states that the keys share; a checkpoint keeps its number.
    """
    known = stream.where(F.col(key).isNotNull() & F.col(version).isNotNull() & F.col(time).isNotNull())
    watched = known.withWatermark(time, delay)
    processor = StandingRow(version, time, keep, ttl_ms, key, stream.schema[key].dataType)
    dealt = watched.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)))
    return dealt.groupBy("_bucket").transformWithState(processor, stream.schema, "Update", "EventTime")


def run_available(rows: DataFrame, folder: str, checkpoint: str) -> None:
    """Run over all files that are there, every batch into a folder of its own, and stop; a second call goes on where the first ended."""
    spark = rows.sparkSession

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    before = spark.conf.get(STORE[0], None)
    spark.conf.set(*STORE)
    try:
        job = rows.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        job.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(STORE[0])
        else:
            spark.conf.set(STORE[0], before)


def standing_table(spark: SparkSession, folder: str, key: str, version: str, keep: str = "last") -> DataFrame:
    """What stands after all batches: of a key's passed-on rows the one of the largest version, or of the first batch."""
    from gridseries.sources.store import deduplicate

    rows = spark.read.option("basePath", folder).parquet(folder)
    order = [version] if keep == "last" else ["batch"]
    return deduplicate(rows, key, order, keep).drop("batch")
