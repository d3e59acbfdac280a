"""Mixing sources to target weights on a low-discrepancy schedule.

Every source is a stream of its documents in a fixed pseudo-random order, cut
into blocks of equal token counts. Slot i of the mix has the golden-ratio point
frac(i / phi), which the cumulative slot shares map to a source; the r-th slot of
a source takes its block r modulo the number of blocks. Only DataFrame functions
are used. Windows run over pieces of bounded size (a hash bucket of a source, a
run of slots), never over a whole source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridseries.llm.common import WORD, clean_text, stage, text_key

WEIGHTS = (5, 2, 1)
#: Largest block, and the slots that a source should get at least while blocks hold more than one word.
BLOCK_WORDS, LEAST_SLOTS = 256, 512
#: Hash buckets of a source are named by so many hexadecimal digits.
BUCKET_DIGITS = 3
#: Slots in one ranking window; bins of the unit interval in which points meet sources.
SLOT_RUN, BINS = 65_536, 1024
#: A Weyl sequence in integers: POINT_STEP / POINT_MODULUS is 1 / phi to 31 bits.
POINT_MODULUS, POINT_STEP = 2**31, 1_327_217_885

FIRST_TO_HERE = (Window.unboundedPreceding, Window.currentRow)
BEFORE = (Window.unboundedPreceding, -1)


def sizes_of(docs: DataFrame) -> DataFrame:
    """doc_id, skey (source key), source, size in words."""
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), text_key("source").alias("skey"),
        F.regexp_count(clean_text(), F.lit(WORD)).cast("bigint").alias("size"),
    )


def source_targets(sizes: DataFrame, share: float = 1.5, most: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """skey, source_size, target: one row per source.

    ``weights`` repeat over the sources by code point, null last. Targets stop at
    ``most`` times a source's size; the excess is shared again by weight until
    none is above. That end state is found directly: by rising size per weight, a
    source is capped if the level of all not yet capped reaches its cap.
    """
    per = sizes.groupBy("skey").agg(F.sum("size").alias("source_size"), F.first("source").alias("source"))
    every = Window.partitionBy()  # one row per source
    by_ratio = every.orderBy(F.col("cap") / F.col("w"), "skey").rowsBetween(*BEFORE)
    listed = F.array(*(F.lit(w).cast("bigint") for w in weights))
    level = (
        per.withColumn("n", F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1)
        .withColumn("w", F.element_at(listed, (F.col("n") % len(weights) + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * most)
        .withColumn("total", F.sum("source_size").over(every) * share)
        .withColumn("c_before", F.coalesce(F.sum("cap").over(by_ratio), F.lit(0)))
        .withColumn("w_left", F.sum("w").over(every) - F.coalesce(F.sum("w").over(by_ratio), F.lit(0)))
        .withColumn("capped", F.col("cap") * F.col("w_left") <= F.col("w") * (F.col("total") - F.col("c_before")))
        .withColumn("rest", F.col("total") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(every))
        .withColumn("w_rest", F.sum(F.when(F.col("capped"), 0).otherwise(F.col("w"))).over(every))
    )
    shared = F.col("w") * F.col("rest") / F.col("w_rest")
    return level.select("skey", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(shared).alias("target"))


def source_plan(targets: DataFrame) -> DataFrame:
    """Adds take, block (words), n_blocks, quota (slots), and the share [lo, hi) of the unit interval."""
    every = Window.partitionBy().orderBy("skey")  # one row per source
    sized = (
        targets.withColumn("take", F.floor("target"))
        .withColumn("block", F.greatest(F.lit(1), F.least(F.lit(BLOCK_WORDS), F.floor(F.col("target") / LEAST_SLOTS))).cast("bigint"))
        .withColumn("n_blocks", F.ceil(F.col("source_size") / F.col("block")))
        .withColumn("rounds", F.when(F.col("source_size") > 0, F.floor(F.col("take") / F.col("source_size"))).otherwise(0))
        .withColumn("quota", F.col("rounds") * F.col("n_blocks") + F.ceil((F.col("take") - F.col("rounds") * F.col("source_size")) / F.col("block")))
        .drop("rounds")
    )
    upto = F.sum("quota").over(every.rowsBetween(*FIRST_TO_HERE))
    whole = F.sum("quota").over(Window.partitionBy())
    return sized.withColumn("hi", upto / whole).withColumn("lo", (upto - F.col("quota")) / whole).where("quota > 0")


def slot_schedule(plan: DataFrame) -> DataFrame:
    """slot, skey, rank, block_no, words: the mix in order.

    Points meet sources bin by bin, an equi-join in which no bin holds more than
    its share of points. A source that the points leave short of its quota (by a
    few, as the sequence has low discrepancy) gets the rest at the end, and slots
    beyond it are dropped. The last slot of a source ends where its target does.
    """
    spark = plan.sparkSession
    slots = plan.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]
    point = (F.col("slot") % POINT_MODULUS) * POINT_STEP % POINT_MODULUS / POINT_MODULUS
    points = spark.range(slots).select(F.col("id").alias("slot")).withColumn("u", point).withColumn("bin", F.floor(F.col("u") * BINS))
    spans = plan.select("skey", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * BINS), F.least(F.floor(F.col("hi") * BINS), F.lit(BINS - 1)))).alias("bin"))
    drawn = points.join(spans, "bin").where("lo <= u and u < hi").select("slot", "skey", F.floor(F.col("slot") / SLOT_RUN).alias("run"))
    drawn = stage(drawn, "mix-points")
    runs = drawn.groupBy("skey", "run").agg(F.count(F.lit(1)).alias("n"))
    runs = runs.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("skey").orderBy("run").rowsBetween(*BEFORE)), F.lit(0)))
    local = F.row_number().over(Window.partitionBy("skey", "run").orderBy("slot")) - 1
    ranked = drawn.withColumn("local", local).join(runs, ["skey", "run"]).select("slot", "skey", (F.col("before") + F.col("local")).alias("rank"))
    got = runs.groupBy("skey").agg(F.sum("n").alias("got"))
    short = plan.join(got, "skey", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < quota")
    late = short.select("skey", F.explode(F.sequence(F.col("got"), F.col("quota") - 1)).alias("rank")).select((F.col("rank") + slots).alias("slot"), "skey", "rank")
    begin = F.col("block_no") * F.col("block")
    return (
        ranked.unionByName(late).join(plan, "skey").where("rank < quota")
        .withColumn("block_no", F.col("rank") % F.col("n_blocks"))
        .withColumn("full", F.least(F.col("block"), F.col("source_size") - begin))
        .withColumn("at", F.floor(F.col("rank") / F.col("n_blocks")) * F.col("source_size") + begin)
        .select("slot", "skey", "rank", "block_no", "full", F.least(F.col("full"), F.col("take") - F.col("at")).alias("words"))
    )


def shuffled_streams(sizes: DataFrame) -> DataFrame:
    """Adds start: the words of a source before the document, in the order of MD5 of the id.

    A prefix sum in two levels, over the buckets of a source and in each bucket.
    """
    keyed = sizes.withColumn("key", F.md5(F.concat(F.lit("mix-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))).withColumn("part", F.substring("key", 1, BUCKET_DIGITS))
    parts = keyed.groupBy("skey", "part").agg(F.sum("size").alias("part_size"))
    parts = parts.select("skey", "part", F.coalesce(F.sum("part_size").over(Window.partitionBy("skey").orderBy("part").rowsBetween(*BEFORE)), F.lit(0)).alias("part_start"))
    inside = F.coalesce(F.sum("size").over(Window.partitionBy("skey", "part").orderBy("key", "doc_id", "size").rowsBetween(*BEFORE)), F.lit(0))
    return keyed.withColumn("inside", inside).join(parts, ["skey", "part"]).withColumn("start", F.col("part_start") + F.col("inside")).drop("key", "part", "inside", "part_start")


def block_pieces(streams: DataFrame, plan: DataFrame) -> DataFrame:
    """doc_id, skey, start, size, block_no, begin, end: the part of each block that a document fills, in words of the block."""
    end = F.col("start") + F.col("size")
    cut = (
        streams.where("size > 0").join(plan.select("skey", "block"), "skey")
        .withColumn("block_no", F.explode(F.sequence(F.floor(F.col("start") / F.col("block")), F.floor((end - 1) / F.col("block")))))
    )
    first = F.col("block_no") * F.col("block")
    return cut.select(
        "doc_id", "skey", "start", "size", "block_no",
        F.greatest(F.col("start") - first, F.lit(0)).alias("begin"), F.least(end - first, F.col("block")).alias("end"),
    )


def mix(docs: DataFrame, share: float = 1.5, most: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: one row per row of ``docs``.

    Needs doc_id, text and source; other columns are ignored. A null text has
    size 0 and takes no part; null is a source of its own; rows repeated with
    their id are separate documents; an empty table gives an empty result. Every
    source's taken words are its target rounded down. Reruns agree.
    """
    sizes = stage(sizes_of(docs), "mix-sizes")
    plan = stage(source_targets(sizes, share, most, weights), "mix-targets")
    laid = source_plan(plan)
    schedule = slot_schedule(laid)
    whole = F.col("words") == F.col("full")
    blocks = schedule.groupBy("skey", "block_no").agg(F.sum(whole.cast("bigint")).alias("times"), F.coalesce(F.max(F.when(~whole, F.col("words"))), F.lit(0)).alias("part"))
    pieces = block_pieces(shuffled_streams(sizes), laid)
    words = F.col("times") * (F.col("end") - F.col("begin")) + F.greatest(F.least(F.col("end"), F.col("part")) - F.col("begin"), F.lit(0))
    taken = (
        pieces.join(blocks, ["skey", "block_no"], "left").groupBy("doc_id", "skey", "start", "size")
        .agg(F.sum(F.coalesce(words, F.lit(0))).alias("taken")).drop("start")
    )
    # A source without any words has no plan; documents without words are in no stream.
    planned = taken.unionByName(sizes.where("size = 0").select("doc_id", "skey", "size", F.lit(0).cast("bigint").alias("taken")))
    named = plan.withColumn("source", F.when(F.col("skey") != "n", F.expr("substring(skey, 2)")))
    return planned.join(named, "skey").select("doc_id", "source", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, share: float = 1.5, most: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with all their columns.

    A document is in or out as a whole: the one document of a source that its
    target cuts is rounded. Rows that share id, source and size share the words
    taken from them.
    """
    rows = mix(docs, share, most, weights).where("taken > 0").groupBy(F.col("doc_id").alias("_id"), text_key("source").alias("_skey"), F.col("size").alias("_size"))
    copies = rows.agg(F.round(F.sum("taken") / (F.count(F.lit(1)) * F.col("_size"))).cast("int").alias("_copies")).where("_copies > 0")
    keyed = docs.withColumn("_words", F.regexp_count(clean_text(), F.lit(WORD)).cast("bigint")).withColumn("_source", text_key("source"))
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col("_id")) & (F.col("_source") == F.col("_skey")) & (F.col("_words") == F.col("_size"))
    found = keyed.join(copies, same).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return found.select(*docs.columns)
