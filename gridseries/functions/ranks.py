"""Row numbers within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridseries.session import cut_lineage


def row_numbers(df: DataFrame, group: list[str], order: list[str], index: str, size: str, parts: int | None = None) -> DataFrame:
    """Add the zero-based index in the group and the group size.

    Rows are range-partitioned by group, order and a hash of the row, from sampled
    boundaries, so a hot group spreads over many tasks whatever the type of its
    order columns, and so does a hot value within it. Equal rows are told apart by
    the partition they come from. The index is the group's rows in earlier
    partitions plus the rank within the own one; rows of equal order are numbered
    in any way. Nulls come first in the order, and null is a group of its own.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashed = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    spread = df.repartitionByRange(parts, *group, *order, F.xxhash64(*hashed, F.spark_partition_id()))
    ranged = cut_lineage(spread.withColumn("_part", F.spark_partition_id()))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_c")).withColumns({
        "_before": F.coalesce(F.sum("_c").over(earlier), F.lit(0)), size: F.sum("_c").over(Window.partitionBy(*group)),
    })
    counts = counts.select(*[F.col(g).alias(f"_g{k}") for k, g in enumerate(group)], F.col("_part").alias("_p"), "_before", size)
    local = F.row_number().over(Window.partitionBy(*group, "_part").orderBy(*order)) - 1
    same = F.col("_part") == F.col("_p")
    for k, g in enumerate(group):
        same &= F.col(g).eqNullSafe(F.col(f"_g{k}"))
    joined = ranged.withColumn("_local", local).join(counts, same)
    return joined.withColumn(index, F.col("_before") + F.col("_local")).select(*df.columns, index, size)


def running_sums(df: DataFrame, group: list[str], order: str, value: str, out: str, total: str, parts: int | None = None) -> DataFrame:
    """Add the sum of ``value`` up to and including equal ``order`` in the group, and the group's sum.

    Range-partitioned as ``row_numbers``; rows of equal order share a partition.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(df.repartitionByRange(parts, *group, order).withColumn("_part", F.spark_partition_id()))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy(*group, "_part").agg(F.sum(value).alias("_s")).withColumns({
        "_before": F.coalesce(F.sum("_s").over(earlier), F.lit(0)), total: F.sum("_s").over(Window.partitionBy(*group)),
    }).drop("_s")
    upto = Window.partitionBy(*group, "_part").orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    local = ranged.withColumn("_local", F.sum(value).over(upto))
    return local.join(sums, [*group, "_part"]).withColumn(out, F.col("_before") + F.col("_local")).select(*df.columns, out, total)
