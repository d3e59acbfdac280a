"""Event probabilities with hierarchical block bootstrap, and their ratios."""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridseries.functions.hashing import key_text
from gridseries.functions.quantiles import percentiles

REPLICATES = 10_000
BLOCK_YEARS = 5
SEED = 20260711
#: Replicates of a group that a task computes at a time.
RANGE = 1000
INF = float("inf")


def event_blocks(events: DataFrame, groups: list[str], block_years: int = BLOCK_YEARS) -> DataFrame:
    """Events in the circular block that starts at each year of each member.

    ``events`` holds (groups, member, year, event). Besides the full block the
    count of the shortened last block is kept, so any number of years is exact.
    A member series is bounded by its years.
    """
    w = Window.partitionBy(*groups)
    years = events.groupBy(*groups, "member").agg(F.sort_array(F.collect_list(F.struct("year", "event"))).alias("_s"))
    flags = F.transform("_s", lambda s: s["event"])
    base = years.select(*groups, "member", flags.alias("_e"), F.size("_s").alias("n_years")).withColumns(
        {"n_members": F.count(F.lit(1)).over(w), "slot_index": F.row_number().over(w.orderBy("member")) - 1}
    )
    n = F.col("n_years")
    last = n - (F.ceil(n / block_years) - 1) * block_years
    ring = F.concat("_e", F.slice("_e", 1, block_years))
    rows = base.withColumn("_ring", ring).withColumn("start", F.explode(F.sequence(F.lit(0), n - 1)))

    def total(length) -> Column:
        return F.aggregate(F.slice("_ring", F.col("start") + 1, length), F.lit(0).cast("bigint"), lambda a, e: a + e)

    return rows.select(
        *groups, "n_members", "n_years", F.col("slot_index").alias("member_index"), "start",
        total(F.lit(block_years)).alias("full"), total(last.cast("int")).alias("tail"),
    )


def draw(key: bytes, n: int) -> int:
    """``hash_mod`` of a key: the first four bytes of its SHA-256 modulo ``n``."""
    return int.from_bytes(sha256(key).digest()[:4], "big") % n


def replicate_shares(prefix: bytes, reps: range, full: np.ndarray, tail: np.ndarray, block_years: int) -> np.ndarray:
    """Event share of each replicate; ``full`` and ``tail`` hold the events of blocks by member and start."""
    members, years = full.shape
    n_blocks = -(-years // block_years)
    picked, starts = [], []
    for rep in reps:
        for slot in range(members):
            key = b"%b|%d|%d" % (prefix, rep, slot)
            picked.append(draw(key, members))
            starts += [draw(b"%b|%d" % (key, block), years) for block in range(n_blocks)]
    member = np.repeat(np.array(picked), n_blocks).reshape(-1, n_blocks)
    start = np.array(starts).reshape(-1, n_blocks)
    events = full[member[:, :-1], start[:, :-1]].sum(axis=1) + tail[member[:, -1], start[:, -1]]
    return events.reshape(len(reps), members).sum(axis=1) / (members * years)


def bootstrap(events: DataFrame, groups: list[str], replicates: int = REPLICATES, seed=SEED, block_years: int = BLOCK_YEARS) -> DataFrame:
    """(groups, rep, p): event share of each replicate.

    Every member slot draws a member and ceil(years/block) block starts, the
    last block cut to the series length. Replicates are dealt out as ranges: a
    task gets a group's block counts (members x years) and a range, and returns
    one row per replicate.
    """
    blocks = event_blocks(events, groups, block_years).withColumn("_prefix", key_text(seed, *[F.col(c) for c in groups]))
    ranges = F.sequence(F.lit(0), F.lit((replicates - 1) // RANGE))
    dealt = blocks.withColumn("_range", F.explode(ranges))
    schema = T.StructType([*(events.schema[c] for c in groups), T.StructField("rep", T.IntegerType()), T.StructField("p", T.DoubleType())])

    def shares(pdf: pd.DataFrame) -> pd.DataFrame:
        members, years = int(pdf["n_members"].iloc[0]), int(pdf["n_years"].max())
        if (pdf["n_years"] != years).any():
            raise ValueError("members differ in length")
        tables = np.zeros((2, members, years), np.int64)
        tables[:, pdf["member_index"], pdf["start"]] = pdf[["full", "tail"]].to_numpy().T
        begin = int(pdf["_range"].iloc[0]) * RANGE
        reps = range(begin + 1, min(begin + RANGE, replicates) + 1)
        out = pd.DataFrame({"rep": np.arange(reps.start, reps.stop, dtype=np.int32), "p": replicate_shares(pdf["_prefix"].iloc[0].encode(), reps, *tables, block_years)})
        for k, c in enumerate(groups):
            out.insert(k, c, pdf[c].iloc[0])
        return out

    return dealt.groupBy(*groups, "_range").applyInPandas(shares, schema)


def probability_rows(
    values: DataFrame, draws: DataFrame, groups: list[str], value: str, threshold: Column, block_years: int = BLOCK_YEARS,
    zero_event: str = "exact",
) -> DataFrame:
    """Probability row per group: counts, estimate and interval.

    Without an event the interval is one-sided: upper bound
    1-0.05^(1/trials) (``exact``) or the 95 % quantile of the draws.
    """
    event = F.when(F.col(value) <= threshold, 1).otherwise(0)
    counts = values.groupBy(*groups).agg(
        F.max(threshold).alias("threshold"), F.count_distinct("member").alias("members"), F.count_distinct("year").alias("years_per_member"),
        F.sum(event).alias("events"), F.count(F.lit(1)).alias("opportunities"), F.avg(event.cast("double")).alias("estimate"),
    )
    q = draws.groupBy(*groups).agg(percentiles(F.col("p"), [0.025, 0.95, 0.975]).alias("_q"))  # one value per replicate
    joined = counts.join(q, groups)
    trials = F.col("members") * F.ceil(F.col("years_per_member") / block_years)
    exact = 1.0 - F.pow(F.lit(0.05), 1.0 / trials)
    upper0 = exact if zero_event == "exact" else F.col("_q")[1]
    some = F.col("estimate") > 0
    return joined.select(
        *groups, "threshold", "members", "years_per_member", "events", "opportunities", "estimate",
        F.when(some, F.col("_q")[0]).otherwise(0.0).alias("lower"), F.when(some, F.col("_q")[2]).otherwise(upper0).alias("upper"),
        (~some).alias("one_sided"), trials.alias("effective_block_trials"),
    )


def ratio_rows(rows: DataFrame, draws: DataFrame, groups: list[str], forcing: str = "forcing", factual: str = "factual", natural: str = "natural") -> DataFrame:
    """Ratio of factual to natural probability per group (without ``forcing``).

    Infinite where only the natural probability is zero, null where both are;
    one-sided also when 2.5 % or more of the draw ratios are not finite.
    """
    keys = [g for g in groups if g != forcing]

    def one(df, label, cols):
        return df.where(F.col(forcing) == label).select(*keys, *cols)

    f = one(rows, factual, [F.col("estimate").alias("factual_probability")])
    n = one(rows, natural, [F.col("estimate").alias("natural_probability"), F.col("upper").alias("_nup")])
    df = one(draws, factual, ["rep", F.col("p").alias("_pf")])
    dn = one(draws, natural, ["rep", F.col("p").alias("_pn")])
    both = df.join(dn, [*keys, "rep"])
    ratio = F.when(F.col("_pn") > 0, F.col("_pf") / F.col("_pn"))
    q = both.groupBy(*keys).agg(
        percentiles(ratio, [0.025, 0.05, 0.975]).alias("_q"),
        F.avg(F.when(ratio.isNull(), 1.0).otherwise(0.0)).alias("_bad"),
        F.percentile("_pf", 0.05).alias("_pf05"),
    )
    p1, p0 = F.col("factual_probability"), F.col("natural_probability")
    unbounded = (p0 == 0) & (p1 > 0)
    one_sided = (p0 == 0) | (F.col("_bad") >= 0.025)
    by_upper = lambda x: F.when(F.col("_nup") > 0, x / F.col("_nup")).otherwise(INF)
    lower = F.when(unbounded, by_upper(F.col("_pf05"))).when(one_sided, F.col("_q")[1]).otherwise(F.col("_q")[0])
    return f.join(n, keys).join(q, keys).select(
        *keys, "factual_probability", "natural_probability",
        F.when(unbounded, INF).when(p0 > 0, p1 / p0).alias("estimate"),
        lower.alias("lower"), F.when(one_sided, INF).otherwise(F.col("_q")[2]).alias("upper"),
        one_sided.alias("one_sided"), F.when(unbounded, by_upper(p1)).alias("one_sided_point_ratio_bound"),
    )
