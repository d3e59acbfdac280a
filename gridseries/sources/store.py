"""Metric identities, upserts and partitioned writes.

Upserts pick one row per key with ``min_by``/``max_by``, which combine before
the shuffle, so a key repeated over a third of the table stays cheap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridseries.functions.hashing import hash32, key_text
from gridseries.session import cut_lineage

# Columns that identify a metric row, and the metric table schema
KEY_COLUMNS = [
    "comp_member_id", "comp_source_id", "experiment_id", "member_id", "metricdomain", "metrickey", "metrictype", "source_id", "variable", "version_tag",
]
METRIC_COLUMNS = [
    "row_key", "metrickey", "metricdomain", "metrictype", "variable", "source_id", "member_id", "experiment_id",
    "comp_source_id", "comp_member_id", "value", "version_tag", "timestamp",
]


def row_key() -> Column:
    """MD5 of the key-sorted JSON object of the identity columns."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in KEY_COLUMNS]
    return F.md5(F.to_json(F.struct(*parts)))


def with_identity(df: DataFrame, default_version: str = "versionless") -> DataFrame:
    """Fill the version tag and absent columns, add row_key, order the columns."""
    tag = F.coalesce(F.when(F.trim("version_tag") != "", F.col("version_tag")), F.lit(default_version)) if "version_tag" in df.columns else F.lit(default_version)
    df = df.withColumn("version_tag", tag)
    for c in METRIC_COLUMNS:
        if c not in df.columns and c != "row_key":
            df = df.withColumn(c, F.lit(None).cast("double" if c == "value" else "string"))
    extra = [c for c in df.columns if c not in METRIC_COLUMNS]
    return df.withColumn("row_key", row_key()).select(*METRIC_COLUMNS, *extra)


def deduplicate(df: DataFrame, key: str | list[str], order: list[str], keep: str = "first") -> DataFrame:
    """One row per key: the first or the last in ``order``."""
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys]
    pick = F.min_by if keep == "first" else F.max_by
    agg = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_row"))
    return agg.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def upsert(existing: DataFrame, new: DataFrame, key: str | list[str], order: list[str], overwrite: bool = False) -> DataFrame:
    """Union with one row per key.

    Without ``overwrite`` stored rows win and the first new row fills a gap;
    with it the last new row wins.
    """
    keys = [key] if isinstance(key, str) else list(key)
    batch = deduplicate(new, keys, order, "last" if overwrite else "first").select(*existing.columns)
    if overwrite:
        return existing.join(batch.select(*keys), keys, "left_anti").unionByName(batch)
    return existing.unionByName(batch.join(existing.select(*keys), keys, "left_anti"))


def merge_rows(existing: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Ledger merge: new rows replace stored ones with the same key."""
    return upsert(existing, new, keys, order, overwrite=True)


def write_metrics(df: DataFrame, path: str, mode: str = "append") -> None:
    """Metric table partitioned by key and version; only touched partitions are rewritten."""
    writer = df.write.partitionBy("metrickey", "version_tag").mode(mode)
    if mode == "overwrite":
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def new_runs(df: DataFrame, stored: DataFrame, group: list[str], run: str = "run_id") -> DataFrame:
    """Rows of runs that the stored group does not hold yet."""
    return df.join(stored.select(*group, run).distinct(), [*group, run], "left_anti")


def append_runs(df: DataFrame, path: str, group: list[str], run: str = "run_id") -> None:
    """Append only new runs to a store partitioned by ``group``."""
    spark = df.sparkSession
    try:
        stored = spark.read.parquet(path)
    except Exception as exc:  # no store yet
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        stored = None
    fresh = df if stored is None else new_runs(df, stored, group, run)
    fresh.write.partitionBy(*group).mode("append").parquet(path)


def plotted_sample(df: DataFrame, key: list[str], groups: list[str], modulo: int = 64) -> DataFrame:
    """1-in-``modulo`` rows by key hash, and at least one row per group.

    The hash decides per row; a group without a hit keeps its smallest hash,
    found by an aggregate instead of a sort of the group.
    """
    text = key_text(*[F.col(k) for k in key])
    staged = df.withColumns({"_h": hash32(text), "_t": text})
    hit = F.col("_h") % modulo == 0
    first = staged.groupBy(*groups).agg(F.min(F.struct("_h", "_t")).alias("_f"), F.max(hit).alias("_any"))
    lonely = first.where(~F.col("_any")).select(*groups, F.col("_f._t").alias("_t"))
    return staged.where(hit).unionByName(staged.join(lonely, [*groups, "_t"], "left_semi")).drop("_h", "_t")


def write_summary_csv(df: DataFrame, path: str) -> None:
    """Small report as one CSV file with sorted columns.

    The report is computed and staged first, so that only its rows, not their
    computation, pass through the one task that writes.
    """
    cut_lineage(df.select(*sorted(df.columns))).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def normalise_record_ids(df: DataFrame) -> DataFrame:
    """Identity rules per comparison type.

    Needs comparison, model_a, member_a, member_b, token_a, token_b and
    scenario_a next to the identity columns. Pseudo suffixes after ``__`` are cut
    from member names.
    """
    c = F.col("comparison")
    plain = lambda name, other: F.when(F.col(name).contains("__"), F.split(name, "__")[0]).otherwise(F.col(other))
    joined = lambda token: F.concat_ws("_", token, "model_a")
    reference = c.isin("oc", "on")
    experiment = F.when(c == "on", F.when(~F.startswith("scenario_a", F.lit("historical")), F.lit("historical")).otherwise(F.col("scenario_a"))).otherwise(F.col("scenario_a"))
    experiment = F.when(experiment == "historical-ERA5", "historical").otherwise(experiment)
    emulated = F.startswith("comp_source_id", F.lit("EMU")) & ~F.col("comp_source_id").contains(F.concat(F.lit("_"), F.col("model_a")))
    return df.withColumns({
        "source_id": F.when(c.isin("nn", "on"), joined("token_a")).when(c == "oc", F.col("model_a")).otherwise(F.col("source_id")),
        "comp_source_id": F.when(c == "nn", joined("token_b")).when(reference, F.lit("ERA5")).when((c == "nc") & emulated, joined("token_b")).otherwise(F.col("comp_source_id")),
        "member_id": F.when(c == "nn", plain("member_id", "member_a")).when(c.isin("nc", "oc", "on"), F.col("member_a")).otherwise(F.col("member_id")),
        "comp_member_id": F.when(c == "nn", plain("comp_member_id", "member_b")).when(c == "nc", F.col("member_a")).when(
            reference, F.coalesce(F.col("member_b"), F.lit("r1i1p1f1"))).otherwise(F.col("comp_member_id")),
        "experiment_id": F.when(reference, experiment).otherwise(F.col("experiment_id")),
    })
