"""Session settings used by the bench, the tests and ad-hoc runs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "gridseries", master: str | None = None, **conf) -> SparkSession:
    """Session with AQE, UTC time and a bounded broadcast threshold.

    ``master`` is left to spark-submit on a cluster. Shuffle partitions are only
    a starting point: AQE coalesces or splits them from the observed sizes.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share.

    Where it is unset, a session with a local master (tests, a laptop) gets a
    temporary folder; on a cluster that is an error, since executors do not see
    each other's disks.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        master = context.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-shared-")
        context.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def task_count(spark: SparkSession) -> int:
    """Partitions for work that its bytes do not show, which adaptive execution would put into few tasks."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def tasks_for(spark: SparkSession, rows: int, held: int) -> int:
    """Partitions of at most about ``held`` of ``rows`` rows, one for each core at least."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // held))


def scratch_folder(spark: SparkSession, prefix: str) -> str:
    """New folder below the shared folder; its owner removes it or leaves it to the folder's retention."""
    return f"{shared_folder(spark).rstrip('/')}/{prefix}-{uuid.uuid4().hex}"
