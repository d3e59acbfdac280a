"""Exact deduplication against a persistent digest index.

The index is a table (digest, keep_id) bucketed and sorted by digest. A load of
new documents is reduced to one row per digest, set against the index by a
sort-merge anti-join on the buckets (the index is not shuffled), and what is new
is appended. The first load that brings a text owns it; within a load the
largest id does. Ingesting a load twice changes nothing.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridseries.llm.common import clean_text, stage
from gridseries.session import scratch_folder

#: Digests a bucket should hold, and the least and largest number of buckets.
ROWS_PER_BUCKET, LEAST_BUCKETS, MOST_BUCKETS = 1_000_000, 12, 8192


def digest(text: str = "text") -> Column:
    """SHA-256 of the text in UTF-8 after lower-casing A-Z; a null text counts as empty."""
    lower = F.translate(clean_text(text), string.ascii_uppercase, string.ascii_lowercase)
    return F.unhex(F.sha2(lower.cast("binary"), 256))


@dataclass
class DigestIndex:
    """A bucketed index at ``path``; any session that sees the folder can open it under a table name of its own."""

    spark: SparkSession
    table: str
    path: str
    buckets: int

    @classmethod
    def open(cls, spark: SparkSession, path: str, table: str, buckets: int) -> DigestIndex:
        """Create the index, or open the one at ``path`` (made with the same number of buckets)."""
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {table} (digest BINARY, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )
        return cls(spark, table, path, buckets)

    def ingest(self, load: DataFrame) -> None:
        """Append the digests of ``load`` (doc_id, digest) that the index lacks.

        Rows of one digest meet after a map-side aggregate, so a text that makes
        up a third of the load sends one row per task.
        """
        firsts = load.groupBy("digest").agg(F.max("doc_id").alias("keep_id"))
        known = self.spark.table(self.table).select("digest")
        fresh = firsts.join(known.hint("merge"), "digest", "left_anti")
        fresh.repartition(self.buckets, "digest").select("digest", "keep_id").write.insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)

    def resolve(self, digests: DataFrame) -> DataFrame:
        """Every row of ``digests`` (doc_id, digest) with keep_id, group_size and kept.

        Sizes and owners meet on the buckets, one row per digest; the rows then
        join them with both sides shuffled, so that adaptive execution splits a
        hot digest.
        """
        sizes = digests.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
        groups = stage(sizes.join(self.spark.table(self.table).hint("merge"), "digest"), "digest-groups")
        return digests.join(groups.hint("merge"), "digest").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def buckets_for(rows: int) -> int:
    return max(LEAST_BUCKETS, min(MOST_BUCKETS, rows // ROWS_PER_BUCKET))


def exact_groups(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of ``docs``.

    Needs doc_id and text; other columns are ignored. Texts are equal when they
    are after lower-casing A-Z; null and empty are equal. The largest doc_id of a
    group stays; a null doc_id loses to any other, and a group of nulls keeps all
    its rows. Rows repeated with their id share the decision. An empty table
    gives an empty result.

    Without ``index`` a fresh one is filled in two loads, newer ids first, as
    the owner must be the largest.
    """
    spark = docs.sparkSession
    digests = stage(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), digest().alias("digest")), "digests")
    if index is None:
        rows, middle = digests.agg(F.count(F.lit(1)), F.percentile_approx("doc_id", 0.5)).first()
        path = scratch_folder(spark, "digest_index")
        index = DigestIndex.open(spark, path, path.rstrip("/").rsplit("/", 1)[-1].replace("-", "_"), buckets_for(rows))
        newer = F.coalesce(F.col("doc_id") > F.lit(middle), F.lit(False))
        index.ingest(digests.where(newer))
        index.ingest(digests.where(~newer))
        resolved = index.resolve(digests)
        spark.sql(f"DROP TABLE {index.table}")  # the name only; the files stay until the folder's retention
    else:
        index.ingest(digests)
        resolved = index.resolve(digests)
    return resolved.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one per text, with all their columns.

    As ``exact_groups``; of rows repeated with id and text, any one stays.
    """
    groups = exact_groups(docs)
    keys = groups.where("kept").groupBy(F.col("text_sha256").alias("_sha"), F.col("doc_id").alias("_id")).agg(F.count(F.lit(1)).alias("_n"))
    keys = stage(keys, "digest-owners")
    tagged = docs.withColumn("_digest", F.lower(F.hex(digest())))
    same = (F.col("_digest") == F.col("_sha")) & F.col("doc_id").cast("bigint").eqNullSafe(F.col("_id"))
    once = tagged.join(keys.where("_n = 1"), same, "left_semi").drop("_digest")
    repeated = keys.where("_n > 1")
    if repeated.isEmpty():
        return once
    several = tagged.join(repeated, same, "left_semi").dropDuplicates(["_digest"]).drop("_digest")
    return once.unionByName(several)
