"""Exact percentiles that survive hot groups.

``percentile`` keeps every distinct value of a group in one task. That is right
for groups whose size is bounded (the years of a cell, the members of a run) and
wrong for a group that may hold a third of a 100 TB table. Groups above
``hot_rows`` are answered by distributed selection instead: each pass counts the
rows of an interval in equal-width bins (map-side combined, at most ``bins``
rows per interval and task are shuffled), keeps the bin that holds the wanted
rank and narrows to that bin's real minimum and maximum. No values of a hot
group ever meet in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridseries.functions.missing import is_finite
from gridseries.session import cut_lineage

SMALL_BYTES = 64 * 1024 * 1024
HOT_ROWS = 4_000_000


def plan_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate of the plan, None where it is not available."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:
        return None


def is_small(df: DataFrame, limit: int = SMALL_BYTES) -> bool:
    """Estimated size within ``limit``; never for plans that multiply rows by a generator, which the estimate ignores."""
    size = plan_bytes(df)
    return size is not None and size <= limit and "Generate" not in df._jdf.queryExecution().optimizedPlan().toString()


def broadcast_if_small(df: DataFrame, limit: int = SMALL_BYTES) -> DataFrame:
    """Broadcast hint only behind a size check; otherwise Spark decides."""
    return F.broadcast(df) if is_small(df, limit) else df


def percentiles(value: Column, probs) -> Column:
    """Linear interpolation at (n-1)q; for groups of bounded size."""
    return F.percentile(value, F.array(*[F.lit(float(p)) for p in probs]))


def grouped_percentiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    probs,
    names: list[str],
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Exact percentiles per group for groups of any size.

    Returns ``keys``, ``n`` and one column per entry of ``names``. Nulls, NaN
    and infinities are ignored. Counted group sizes alone decide which groups
    the built-in aggregate answers; both ways give the same values.
    """
    clean = df.select(*keys, F.col(value).cast("double").alias("_v")).where(is_finite(F.col("_v")))
    probs = [float(p) for p in probs]

    def direct(part: DataFrame) -> DataFrame:
        agg = part.groupBy(*keys).agg(percentiles(F.col("_v"), probs).alias("_q"), F.count("*").alias("n"))
        return agg.select(*keys, "n", *[F.col("_q")[i].alias(nm) for i, nm in enumerate(names)])

    sizes = clean.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
    )
    hot = sizes.where(F.col("n") > hot_rows)
    if hot.isEmpty():
        return direct(clean)
    hot = cut_lineage(hot)
    if not keys:
        return _select_ranks(clean, hot, keys, probs, names, hot_rows)
    # At most total_rows / hot_rows groups can be hot, which bounds this broadcast.
    cold_rows = clean.alias("l").join(F.broadcast(hot.alias("r")), _same(keys), "left_anti")
    return direct(cold_rows).unionByName(_select_ranks(clean, hot, keys, probs, names, hot_rows))


def _same(cols: list[str], *more: Column) -> Column:
    """Null-safe equality of the named columns of sides ``l`` and ``r``."""
    parts = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in cols]
    return reduce(lambda a, b: a & b, [*parts, *more], F.lit(True))


def _select_ranks(
    clean: DataFrame, hot: DataFrame, keys: list[str], probs: list[float], names: list[str], hot_rows: int, bins: int = 4096
) -> DataFrame:
    position = (F.col("n") - 1) * F.col("_p")
    targets = (
        hot.withColumn("_pi", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(p).alias("p")) for i, p in enumerate(probs)])))
        .select(*keys, "n", "_lo", "_hi", F.col("_pi.i").alias("_i"), F.col("_pi.p").alias("_p"))
        .withColumn("_k", F.explode(F.array(F.floor(position), F.ceil(position))))
        .withColumn("_below", F.lit(0).cast("bigint"))
        .withColumn("_inside", F.col("n"))
    )
    interval = [*keys, "_lo", "_hi"]

    def members(open_targets: DataFrame) -> DataFrame:
        spans = open_targets.select(*interval).distinct().alias("r")
        within = F.col("l._v").between(F.col("r._lo"), F.col("r._hi"))
        joined = clean.alias("l").join(F.broadcast(spans), _same(keys, within))
        return joined.select(*[F.col(f"r.{c}") for c in interval], F.col("l._v"))

    last_rows = -1
    while True:
        targets = cut_lineage(targets)
        wide = targets.where((F.col("_inside") > hot_rows) & (F.col("_lo") < F.col("_hi")))
        state = wide.agg(F.count("*").alias("n"), F.sum("_inside").alias("rows")).first()
        if not state["n"]:
            break
        if state["rows"] == last_rows:
            raise ValueError("a selection pass narrowed no interval")
        last_rows = state["rows"]
        span = F.col("_hi") / 2 - F.col("_lo") / 2  # zero where the ends differ by less than a normal double
        share = F.when(span > 0, F.try_divide(F.col("_v") / 2 - F.col("_lo") / 2, span)).otherwise((F.col("_v") > F.col("_lo")).cast("double"))
        w = Window.partitionBy(*interval).orderBy("_bin")
        counts = (
            members(wide)
            .withColumn("_bin", F.least(F.floor(share * bins), F.lit(bins - 1)))
            .groupBy(*interval, "_bin")
            .agg(F.count("*").alias("_c"), F.min("_v").alias("_bmin"), F.max("_v").alias("_bmax"))
            .withColumn("_upto", F.sum("_c").over(w))
        )
        local = F.col("l._k") - F.col("l._below")
        before = F.col("r._upto") - F.col("r._c")
        hit = _same(interval, local >= before, local < F.col("r._upto"))
        narrowed = wide.alias("l").join(counts.alias("r"), hit).select(
            *[F.col(f"l.{k}") for k in keys], "l.n", F.col("r._bmin").alias("_lo"), F.col("r._bmax").alias("_hi"),
            "l._i", "l._p", "l._k", (F.col("l._below") + before).alias("_below"), F.col("r._c").alias("_inside"),
        )
        done = targets.where(~((F.col("_inside") > hot_rows) & (F.col("_lo") < F.col("_hi"))))
        targets = done.unionByName(narrowed)

    single = targets.where(F.col("_lo") == F.col("_hi")).withColumn("_x", F.col("_lo"))
    open_ = targets.where(F.col("_lo") < F.col("_hi"))
    # The remaining intervals hold at most hot_rows values each.
    ranked = members(open_).withColumn(
        "_r", F.row_number().over(Window.partitionBy(*interval).orderBy("_v")) - 1
    )
    rank_hit = _same(interval, F.col("l._k") - F.col("l._below") == F.col("r._r"))
    found = open_.alias("l").join(ranked.alias("r"), rank_hit).select(
        *[F.col(f"l.{c}") for c in open_.columns], F.col("r._v").alias("_x")
    )
    both = single.unionByName(found)
    frac = position - F.floor(position)
    per_q = both.groupBy(*keys, "n", "_i", "_p").agg(F.min("_x").alias("_a"), F.max("_x").alias("_b"))
    per_q = per_q.withColumn("_x", F.col("_a") + (F.col("_b") - F.col("_a")) * frac)
    return per_q.groupBy(*keys, "n").agg(
        *[F.max(F.when(F.col("_i") == i, F.col("_x"))).alias(nm) for i, nm in enumerate(names)]
    ).select(*keys, "n", *names)
