"""Member catalogues: names, selection, pairing, job lists and accounting.

Catalogue keys can be heavily repeated, so picks of a first element use ``min``
style aggregates or ``row_number() <= k`` filters, which Spark limits before the
shuffle. Unlimited partner sets are kept as blocks of files, never as rows per
pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridseries.functions.hashing import hash32, hash_mod, key_text
from gridseries.functions.quantiles import broadcast_if_small
from gridseries.session import cut_lineage, task_count
from gridseries.functions.ranks import row_numbers

# Variables a member file must hold for the drought protocol
PROTOCOL_VARIABLES = ["pr", "tas", "tasmin", "tasmax", "rsds", "sfcWind", "hurs", "psl"]


def parse_names(df: DataFrame, path: str = "path", emulator_prefix: str = "EMU") -> DataFrame:
    """source_id, experiment_id, member_id and variables from file names.

    ``DAT_<source>_<experiment>_<member>_<var-var>``; emulator files carry a run
    token first, or the short form ``<token>_<hhmm>_<experiment>_<member>``.
    """
    base = F.regexp_replace(F.element_at(F.split(F.col(path), "/"), -1), r"\.nc$", "")
    parts = F.split(base, "_", 5)
    emulator = F.startswith(base, F.lit(emulator_prefix))
    short = emulator & (F.size(parts) == 4) & parts[1].rlike(r"^\d{4}$")

    def part(i: int) -> Column:
        return F.get(parts, F.lit(i))

    return df.withColumns({
        "source_id": F.when(short, F.lit("GXE")).otherwise(part(1)),
        "experiment_id": part(2), "member_id": part(3), "variables": F.when(short, None).otherwise(part(4)),
        "run_token": F.when(emulator, part(0)),
    })


def member_token(path: Column) -> Column:
    """The rXiXpXfX part between underscores, null if there is none."""
    token = F.regexp_extract(path, r"_(r\d+i\d+p\d+f\d+)_", 1)
    return F.when(token != "", token)


def has_variables(variables: Column, required: list[str]) -> Column:
    wanted = F.array(*[F.lit(v) for v in required])
    return F.size(F.array_except(wanted, F.split(F.coalesce(variables, F.lit("")), "-"))) == 0


def logical_parts(df: DataFrame, column: str) -> DataFrame:
    """One row per part of a pipe-separated path list, numbered from 0."""
    return df.select("*", F.posexplode(F.split(column, r"\|")).alias("part", "part_path")).withColumn("part_path", F.trim("part_path"))


def member_number(member: Column) -> Column:
    """Realisation number; texts without one sort last."""
    return F.coalesce(F.regexp_extract(member, r"^r(\d+)", 1).try_cast("int"), F.lit(10**9))


def member_order(member: str = "member_id") -> list[Column]:
    return [member_number(F.col(member)).asc(), F.col(member).asc()]


def ordered_members(members: DataFrame, group: list[str]) -> DataFrame:
    """Members with their rank (from 1) in the natural order of their names; groups of any size."""
    keyed = members.withColumn("_number", member_number(F.col("member_id")))
    ranked = row_numbers(keyed, group, ["_number", "member_id"], "rank", "_size")
    return ranked.withColumn("rank", F.col("rank") + 1).select(*members.columns, "rank")


def first_members(df: DataFrame, group: list[str], n: int, order: list[Column] | None = None) -> DataFrame:
    """First n rows per group in natural member order."""
    w = Window.partitionBy(*group).orderBy(*(order or member_order()))
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def common_years(df: DataFrame, group: list[str], member: str = "member_id", year: str = "year") -> DataFrame:
    """Rows of the years that all members of a group hold."""
    n = df.groupBy(*group).agg(F.count_distinct(member).alias("_n"))
    per = df.groupBy(*group, year).agg(F.count_distinct(member).alias("_c"))
    full = per.join(broadcast_if_small(n), group).where("_c = _n").select(*group, year)
    return df.join(full, [*group, year], "left_semi")


def latest_common_month(a: DataFrame, b: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """Latest (year, month) with a value in both series."""
    keys = keys or []
    both = a.where(F.col(value).isNotNull()).select(*keys, "year", "month").distinct().join(
        b.where(F.col(value).isNotNull()).select(*keys, "year", "month").distinct(), [*keys, "year", "month"]
    )
    return both.groupBy(*keys).agg(F.max(F.struct("year", "month")).alias("_m")).select(*keys, "_m.year", "_m.month")


def member_year_matrix(df: DataFrame, keys: list[str], years: tuple[int, int], value: str) -> DataFrame:
    """Every member with every year, null where absent."""
    full = df.select(*keys).distinct().withColumn("year", F.explode(F.sequence(F.lit(years[0]), F.lit(years[1]))))
    return full.join(df.select(*keys, "year", value), [*keys, "year"], "left")


def attach_names(df: DataFrame, names: DataFrame, index: str = "model_index", name: str = "model") -> DataFrame:
    """Model name by index with a default label."""
    joined = df.join(broadcast_if_small(names), index, "left")
    return joined.withColumn(name, F.coalesce(F.col(name), F.concat(F.lit("model_index "), F.col(index).cast("string"))))


# --- pairing -------------------------------------------------------------------------


def pair_runs(originals: DataFrame, emulated: DataFrame, keep_unpaired: bool = False) -> DataFrame:
    """One row per (source, experiment, member) with both file lists' first files.

    Without an original the row is kept only on request and marked.
    """
    key = ["source_id", "experiment_id", "member_id"]
    o = originals.groupBy(*key).agg(F.min("path").alias("original_file"), F.count(F.lit(1)).alias("n_original"))
    e = emulated.groupBy(*key).agg(F.min("path").alias("emulated_file"), F.count(F.lit(1)).alias("n_emulated"))
    out = e.join(o, key, "left" if keep_unpaired else "inner")
    return out.withColumns({"emulated_only": F.col("original_file").isNull(), "n_original": F.coalesce("n_original", F.lit(0))})


def first_partners(df: DataFrame, group: list[str], item: str, n: int, main: DataFrame | None = None) -> DataFrame:
    """The first n other items of the group for each main item.

    The candidates of a group are its first n+1 items, so each main item meets
    at most n+1 rows whatever the size of the group.
    """
    head = df.select(*group, F.col(item).alias("partner")).distinct()
    head = head.withColumn("_rn", F.row_number().over(Window.partitionBy(*group).orderBy("partner"))).where(F.col("_rn") <= n + 1)
    short = head.groupBy(*group).agg(F.sort_array(F.collect_list("partner")).alias("_c"))
    mains = (main if main is not None else df).select(*group, item).distinct()
    others = F.slice(F.filter("_c", lambda c: c != F.col(item)), 1, n)
    return mains.join(broadcast_if_small(short), group).select(*group, item, F.explode(others).alias("partner"))


def first_other_models(df: DataFrame, n: int) -> DataFrame:
    """Up to n files of other sources of the same experiment, one file per source."""
    one = df.groupBy("experiment_id", "source_id").agg(F.min("path").alias("partner_path"))
    w = Window.partitionBy("experiment_id").orderBy("source_id")
    head = one.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n + 1)
    short = head.groupBy("experiment_id").agg(F.sort_array(F.collect_list(F.struct("source_id", "partner_path"))).alias("_c"))
    others = F.slice(F.filter("_c", lambda c: c["source_id"] != F.col("source_id")), 1, n)
    joined = df.join(broadcast_if_small(short), "experiment_id")
    return joined.select("experiment_id", "source_id", "path", F.explode(others).alias("_p")).select(
        "experiment_id", "source_id", "path", F.col("_p.source_id").alias("partner_source"), F.col("_p.partner_path").alias("partner_path")
    )


def partner_blocks(df: DataFrame, group: list[str], item: str, block: int = 1000) -> DataFrame:
    """All unordered partners of a group as pairs of blocks of at most ~``block`` items.

    A job on a block pair compares its items inside the task. (group, block_a,
    block_b, items_a, items_b); equal block numbers mean pairs within the block.
    """
    items = df.select(*group, item).distinct()
    n = items.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    tagged = items.join(broadcast_if_small(n), group).withColumn("_nb", F.ceil(F.col("_n") / block).cast("int"))
    tagged = tagged.withColumn("block_a", F.pmod(F.xxhash64(item), F.col("_nb")).cast("int"))
    blocks = tagged.groupBy(*group, "block_a").agg(F.sort_array(F.collect_list(item)).alias("items_a"), F.max("_nb").alias("_nb"))
    left = blocks.withColumn("block_b", F.explode(F.sequence(F.col("block_a"), F.col("_nb") - 1))).drop("_nb")
    right = blocks.select(*group, F.col("block_a").alias("block_b"), F.col("items_a").alias("items_b"))
    return left.join(right, [*group, "block_b"])


def partner_block_ids(df: DataFrame, group: list[str], item: str, block: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Members (group, item, block) and pairs (group, block_a <= block_b) that together stand for all unordered partners.

    Items are stored once, with the number of their block; a job on a pair of
    blocks joins the members it needs. Blocks hold about ``block`` items, dealt
    by hash.
    """
    items = df.select(*group, item).distinct()
    n = items.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_nb"))
    number = F.pmod(F.xxhash64(item), F.col("_nb")).cast("int")
    members = items.join(broadcast_if_small(n), group).select(*group, item, number.alias("block"))
    first = n.withColumn("block_a", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
    pairs = first.select(*group, "block_a", F.explode(F.sequence(F.col("block_a"), F.col("_nb") - 1)).alias("block_b"))
    return members, pairs


def job_matrix(
    pairs: DataFrame, files: DataFrame, recipes: list[str], member_limit: int = 1, model_limit: int = 5,
    emulated: DataFrame | None = None, emulated_limit: int = 1, observation: str | None = None, historical: tuple[str, ...] = ("historical",),
) -> DataFrame:
    """Comparison jobs per pair and recipe: nc, cc, cz, zz, nn, oc and on.

    ``pairs`` is :func:`pair_runs` output, ``files`` the original and
    ``emulated`` the emulated catalogue (needed for nn). oc and on compare the
    first member of each source's ``historical`` runs with the file
    ``observation``. Limits are features of the job list (partners per member,
    models per scenario).
    """
    group = ["source_id", "experiment_id"]
    pairs = cut_lineage(pairs)
    files = cut_lineage(files.select(*group, "path"))
    nc = pairs.where(F.col("original_file").isNotNull()).select(F.lit("nc").alias("comparison"), *group, F.col("original_file").alias("file_a"), F.col("emulated_file").alias("file_b"))
    mains = pairs.where(F.col("original_file").isNotNull()).select(*group, F.col("original_file").alias("path"))
    within = first_partners(files, group, "path", member_limit, mains)
    cc = within.select(F.lit("cc").alias("comparison"), *group, F.col("path").alias("file_a"), F.col("partner").alias("file_b"))
    others = first_other_models(files, model_limit)
    z = others.join(mains, [*group, "path"], "left_semi")
    cz = z.select(F.lit("cz").alias("comparison"), *group, F.col("path").alias("file_a"), F.col("partner_path").alias("file_b"))
    z_main = z.select(F.col("partner_source").alias("source_id"), "experiment_id", F.col("partner_path").alias("path")).distinct()
    z_within = first_partners(files, group, "path", member_limit, z_main)
    zz = z_within.select(F.lit("zz").alias("comparison"), *group, F.col("path").alias("file_a"), F.col("partner").alias("file_b"))
    jobs = nc.unionByName(cc).unionByName(cz).unionByName(zz)
    if emulated is not None:
        own = pairs.select(*group, F.col("emulated_file").alias("path"))
        other = first_partners(emulated.select(*group, "path"), group, "path", emulated_limit, own)
        jobs = jobs.unionByName(other.select(F.lit("nn").alias("comparison"), *group, F.col("path").alias("file_a"), F.col("partner").alias("file_b")))
    if observation is not None:
        past = pairs.where(F.col("experiment_id").isin(*historical))
        for name, side in (("oc", "original_file"), ("on", "emulated_file")):
            first = past.where(F.col(side).isNotNull()).groupBy(*group).agg(F.min_by(side, "member_id").alias("file_a"))
            jobs = jobs.unionByName(first.select(F.lit(name).alias("comparison"), *group, "file_a", F.lit(observation).alias("file_b")))
    return jobs.withColumn("recipe", F.explode(F.array(*[F.lit(r) for r in recipes])))


def guided_jobs(jobs: DataFrame, follower: str, leader: str, prune: bool, tag: str, candidate: Column | None = None) -> DataFrame:
    """Follower jobs take the reference file of the leader with the same (recipe, file_a).

    With ``prune`` followers without a leader are dropped, otherwise untagged.
    ``candidate`` limits both to some of the followers; the others stay untagged.
    """
    lead = jobs.where(F.col("comparison") == leader).groupBy("recipe", "file_a").agg(F.max("file_b").alias(tag))
    led = (F.col("comparison") == follower) & (F.lit(True) if candidate is None else F.coalesce(candidate, F.lit(False)))
    mine = jobs.where(led).join(broadcast_if_small(lead), ["recipe", "file_a"], "inner" if prune else "left")
    rest = jobs.where(~led).withColumn(tag, F.lit(None).cast("string"))
    return rest.unionByName(mine)


def observation_guided_jobs(jobs: DataFrame, historical: tuple[str, ...] = ("historical",)) -> DataFrame:
    """nn jobs of historical runs kept only with an on job of their file; cc jobs tagged by their oc job."""
    by_on = guided_jobs(jobs, "nn", "on", True, "on_reference_file", F.col("experiment_id").isin(*historical))
    return guided_jobs(by_on, "cc", "oc", False, "oc_reference_file")


def missing_records(expected: DataFrame, stored: DataFrame, job: list[str]) -> DataFrame:
    """Per job: expected and missing record counts, and whether all exist."""
    keys = stored.select("row_key").distinct().withColumn("_have", F.lit(True))
    joined = expected.join(keys, "row_key", "left")
    miss = F.sum(F.when(F.col("_have").isNull(), 1).otherwise(0))
    return joined.groupBy(*job).agg(F.count(F.lit(1)).alias("expected"), miss.alias("missing"), (miss == 0).alias("all_exist"))


def availability(catalogue: DataFrame, wanted: DataFrame, triplets: DataFrame, variables: list[str]) -> DataFrame:
    """Wide table of file lists per wanted variable for each triplet.

    ``variables`` names the pivot columns, so no extra pass finds them.
    """
    key = ["source_id", "experiment_id", "member_id"]
    hit = catalogue.join(broadcast_if_small(wanted), ["table_id", "variable"])
    listed = F.concat_ws("|", F.sort_array(F.collect_list("path")))
    wide = hit.groupBy(*key).pivot("variable", variables).agg(listed)
    return triplets.join(wide, key, "left")


def availability_rows(catalogue: DataFrame, wanted: DataFrame, triplets: DataFrame) -> DataFrame:
    """One row per triplet, wanted variable and path, with the number of paths of the variable and of the triplet.

    As ``availability``, but no list grows with a triplet's files; a triplet
    without a wanted file has one row without variable and path.
    """
    key = ["source_id", "experiment_id", "member_id"]
    hit = catalogue.join(broadcast_if_small(wanted), ["table_id", "variable"]).select(*key, "variable", "path")
    totals = hit.groupBy(*key, "variable").agg(F.count(F.lit(1)).alias("n_variable"))
    whole = totals.groupBy(*key).agg(F.sum("n_variable").alias("n_triplet"))
    counted = hit.join(totals, [*key, "variable"]).join(whole, key)
    return triplets.join(counted, key, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_variable", "n_triplet")})


def resolve_baselines(runs: DataFrame, catalogue: DataFrame, mode: str, experiment: str) -> tuple[DataFrame, DataFrame]:
    """(resolved, dropped) baseline per run.

    ``self``: the run itself; ``pooled``: all files of the experiment as one id;
    ``exact``: the file of the same source and member, else the run is dropped
    with a reason.
    """
    if mode == "self":
        own = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.nc$", "")
        return runs.withColumns({"baseline_path": F.col("path"), "baseline_id": F.concat(F.lit("self-"), own)}), runs.limit(0).withColumn("reason", F.lit(""))
    if mode == "pooled":
        return runs.withColumns({"baseline_path": F.lit(None).cast("string"), "baseline_id": F.lit(f"{experiment}-pooled")}), runs.limit(0).withColumn("reason", F.lit(""))
    base = catalogue.where(F.col("experiment_id") == experiment).groupBy(
        F.lower(F.trim("source_id")).alias("_s"), F.lower(F.trim("member_id")).alias("_m")
    ).agg(F.min("path").alias("baseline_path"))
    joined = runs.withColumns({"_s": F.lower(F.trim("source_id")), "_m": F.lower(F.trim("member_id"))}).join(
        broadcast_if_small(base), ["_s", "_m"], "left"
    )
    ident = F.concat_ws("-", F.lit(experiment), "source_id", "member_id")
    ok = joined.where(F.col("baseline_path").isNotNull()).withColumn("baseline_id", ident)
    reason = F.concat(F.lit(f"missing exact {experiment} baseline member for source_id="), "source_id", F.lit(", member_id="), "member_id")
    bad = joined.where(F.col("baseline_path").isNull()).withColumn("reason", reason)
    return ok.drop("_s", "_m"), bad.drop("_s", "_m", "baseline_path")


def one_member_per_source(catalogue: DataFrame, experiments: list[str], main: str) -> DataFrame:
    """Member of each source found in most experiments, then the first by name.

    Members of the main experiment are preferred where a source has any.
    """
    kept = catalogue.where(F.col("experiment_id").isin(*experiments))
    per = kept.groupBy("source_id", "member_id").agg(
        F.count_distinct("experiment_id").alias("_n"), F.max((F.col("experiment_id") == main).cast("int")).alias("_main"),
        *[F.min(F.when(F.col("experiment_id") == e, F.col("path"))).alias(f"file_{i}") for i, e in enumerate(experiments)],
    )
    cols = ["member_id", *[f"file_{i}" for i in range(len(experiments))]]
    best = per.groupBy("source_id").agg(F.min_by(F.struct(*cols), F.struct(-F.col("_main"), -F.col("_n"), F.col("member_id"))).alias("_b"))
    return best.select("source_id", *[F.col("_b")[c].alias(c) for c in cols])


def member_identity(source: Column, member: Column, experiment: Column) -> Column:
    return F.lower(F.concat_ws("|", source, member, experiment))


def resolve_scenarios(candidates: DataFrame, member_count: int | None = None) -> DataFrame:
    """Chosen source run per scenario by priority, run name and path.

    ``candidates`` has one row per file: scenario, root, priority, run_name,
    path, identity. Copies of a member are counted once. A scenario whose
    candidates do not have the wanted member count has a reason instead.
    """
    per = candidates.groupBy("scenario", "root", "priority", "run_name").agg(
        F.count_distinct("identity").alias("member_count"), F.min("path").alias("first_path")
    )
    rank = F.struct("priority", "run_name", "first_path")
    fits = F.lit(True) if member_count is None else F.col("member_count") == member_count
    # Per root: the best fitting run, else the best run.
    per_root = per.groupBy("scenario", "root").agg(
        F.max_by(F.struct("priority", "run_name", "first_path", "member_count", fits.alias("fits")), F.struct(fits, rank)).alias("c")
    ).select("scenario", "root", "c.*")
    agg = per_root.groupBy("scenario").agg(
        F.max_by(F.struct("root", "run_name", "member_count"), F.when(F.col("fits"), rank)).alias("best"),
        F.max("fits").alias("any"), F.sort_array(F.collect_set("member_count")).alias("counts"),
    )
    counts = F.concat_ws(",", F.transform("counts", lambda x: x.cast("string")))
    reason = F.when(~F.col("any"), F.when(F.size("counts") > 1, F.concat(F.lit("mixed_member_counts:"), counts)).otherwise(
        F.concat(F.lit(f"member_count_not_{member_count}:"), counts)))
    pick = lambda c: F.when(F.col("any"), F.col(f"best.{c}"))
    return agg.select("scenario", pick("root").alias("root"), pick("run_name").alias("run_name"), pick("member_count").alias("member_count"), reason.alias("excluded_reason"))


def catalogue_window(df: DataFrame, keys: list[str], path: str = "path") -> DataFrame:
    """Earliest start, latest end and months from ``_yyyymm-yyyymm`` in names."""
    start = F.regexp_extract(path, r"_(\d{6})-(\d{6})", 1).try_cast("int")
    end = F.regexp_extract(path, r"_(\d{6})-(\d{6})", 2).try_cast("int")
    agg = df.groupBy(*keys).agg(F.min(start).alias("start"), F.max(end).alias("end"))
    y = lambda c: F.floor(F.col(c) / 100) * 12 + F.col(c) % 100
    return agg.withColumn("n_months", (y("end") - y("start") + 1).cast("bigint"))


# --- accounting of pairing options ---------------------------------------------------

RUN_FIELDS = ["recipe", "comparison", "source_id", "experiment_id", "member_id", "comp_source_id", "comp_member_id"]


def run_key(include_version: bool = True) -> Column:
    fields = (["model_version"] if include_version else []) + RUN_FIELDS
    return F.concat_ws("|", *[F.lower(F.trim(F.col(c))) if c == "comparison" else F.trim(F.coalesce(F.col(c), F.lit(""))) for c in fields])


def window_label(start: Column, end: Column) -> Column:
    """``1995to2014``."""
    return F.concat_ws("to", start.cast("string"), end.cast("string"))


def clean_token(*parts: Column) -> Column:
    """Lower-case letters and digits of the joined parts, anything else one hyphen."""
    return F.regexp_replace(F.lower(F.concat_ws(" / ", *parts)), "[^a-z0-9]+", "-")


def normalise_runs(df: DataFrame, domains: dict[str, str]) -> DataFrame:
    """Add domain, bucket, run_key and the group in which cc runs can be reused."""
    domain = F.element_at(F.create_map(*[F.lit(x) for kv in domains.items() for x in kv]), F.trim("model_version"))
    comp = F.lower(F.trim("comparison"))
    short = F.regexp_replace(F.col("domain"), r"[()]", "")
    out = df.withColumns({"domain": domain, "comparison": comp})
    bucket = F.when(F.col("comparison").isin("nn", "cc"), F.concat(F.upper("comparison"), F.lit("_"), F.upper(short))).otherwise(F.upper("comparison"))
    return out.withColumns({"gof_bucket": bucket, "run_key": run_key(), "cc_reuse_group": F.when(F.col("comparison") == "cc", run_key(False)).otherwise("")})


COUNTS = ["i_completed_still_useful", "ii_existing_to_be_purged", "iii_missing", "iv_total_necessary"]


def _conditional_counts(expected: Column, completed: Column) -> list[Column]:
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return [
        one(expected & completed).alias(COUNTS[0]), one(~expected & completed).alias(COUNTS[1]),
        one(expected & ~completed).alias(COUNTS[2]), one(expected).alias(COUNTS[3]),
    ]


def strict_accounting(expected: DataFrame, completed: DataFrame) -> DataFrame:
    """useful / purge / missing / total per option, domain, bucket and recipe.

    Every option is compared with the same completed runs: those are counted per
    bucket once, and an option's purge count is what it does not need of them.
    """
    key = ["domain", "gof_bucket", "recipe"]
    exp = expected.select("option", *key, "run_key").distinct()
    done = completed.select(*key, "run_key").distinct()
    hit = exp.join(done.withColumn("_done", F.lit(True)), [*key, "run_key"], "left")
    per = hit.groupBy("option", *key).agg(F.count(F.lit(1)).alias("iv"), F.count("_done").alias("i"))
    totals = done.groupBy(*key).agg(F.count(F.lit(1)).alias("n_done"))
    # Options are a handful of names: each meets every bucket that holds runs.
    grid = totals.select(*key).unionByName(exp.select(*key)).distinct()
    options = exp.agg(F.collect_set("option").alias("_o"))
    full = grid.join(F.broadcast(options)).select(*key, F.explode("_o").alias("option"))
    out = full.join(per, ["option", *key], "left").join(totals, key, "left").na.fill(0, ["iv", "i", "n_done"])
    seen = out.where("iv > 0 OR n_done > 0")
    return seen.select(
        "option", *key, F.col("i").alias(COUNTS[0]), (F.col("n_done") - F.col("i")).alias(COUNTS[1]),
        (F.col("iv") - F.col("i")).alias(COUNTS[2]), F.col("iv").alias(COUNTS[3]),
    )


def reuse_groups(expected: DataFrame, completed: DataFrame, first_domain: str) -> DataFrame:
    """cc groups per option: domains expected and completed, owner, missing counts."""
    key = ["recipe", "cc_reuse_group"]
    exp = expected.where("comparison = 'cc'").groupBy("option", *key).agg(F.sort_array(F.collect_set("domain")).alias("exp"))
    done = completed.where("comparison = 'cc'").groupBy(*key).agg(F.sort_array(F.collect_set("domain")).alias("done"))
    options = expected.agg(F.collect_set("option").alias("_o"))
    every = done.join(F.broadcast(options)).select(*key, "done", F.explode("_o").alias("option"))
    both = exp.join(every, ["option", *key], "full")
    empty = F.array().cast("array<string>")
    both = both.withColumns({"exp": F.coalesce("exp", empty), "done": F.coalesce("done", empty)})

    def owner(arr: str) -> Column:
        return F.when(F.array_contains(arr, first_domain), F.lit(first_domain)).otherwise(F.get(F.col(arr), F.lit(0)))

    any_done, any_exp = F.size("done") > 0, F.size("exp") > 0
    return both.select(
        "option", *key, F.array_join("exp", ",").alias("expected_domains"), F.array_join("done", ",").alias("completed_domains"),
        (F.size("exp") > 1).alias("shared"), any_done.alias("completed_any"), any_exp.alias("expected_any"),
        F.coalesce(owner("exp"), owner("done")).alias("owner_domain"), F.size("exp").alias("strict_required"),
        F.when(any_exp & ~any_done, F.size("exp")).otherwise(0).alias("strict_missing"),
        F.when(any_exp & ~any_done, 1).otherwise(0).alias("reuse_missing"), F.when(any_exp, 1).otherwise(0).alias("reuse_required"),
    )


def reuse_accounting(strict: DataFrame, groups: DataFrame) -> DataFrame:
    """Counts per option and domain when shared cc groups are run once by their owner."""
    exp_arr, done_arr = F.split("expected_domains", ","), F.split("completed_domains", ",")
    kept = F.when(F.array_contains(done_arr, F.col("owner_domain")), F.col("owner_domain")).otherwise(F.get(done_arr, F.lit(0)))
    zero = F.lit(0)

    def row(domain, i=zero, ii=zero, iii=zero, iv=zero, shadow=zero):
        return F.struct(domain.alias("domain"), i.alias("i"), ii.alias("ii"), iii.alias("iii"), iv.alias("iv"), shadow.alias("shadow"))

    flag = lambda c: F.when(c, 1).otherwise(0)
    own = F.array(row(F.col("owner_domain"), flag(F.col("completed_any") & F.col("expected_any")), zero, F.col("reuse_missing"), F.col("reuse_required")))
    shadow = F.transform(F.filter(exp_arr, lambda d: (d != F.col("owner_domain")) & (d != "")), lambda d: row(d, shadow=F.lit(1)))
    stale = F.when(
        F.col("expected_any"), F.filter(done_arr, lambda d: (d != kept) & (d != ""))
    ).otherwise(F.filter(done_arr, lambda d: d != ""))
    purge = F.transform(stale, lambda d: row(d, ii=F.lit(1)))
    cc = groups.select("option", "recipe", F.inline(F.concat(own, shadow, purge))).groupBy("option", "domain", "recipe").agg(
        F.sum("i").alias(COUNTS[0]), F.sum("ii").alias(COUNTS[1]), F.sum("iii").alias(COUNTS[2]), F.sum("iv").alias(COUNTS[3]),
        F.sum("shadow").alias("cc_reuse_shadow_count"),
    ).withColumn("gof_bucket", F.concat(F.lit("CC_"), F.upper(F.regexp_replace("domain", r"[()]", ""))))
    rest = strict.where(~F.startswith("gof_bucket", F.lit("CC_"))).withColumn("cc_reuse_shadow_count", F.lit(0))
    return rest.unionByName(cc.select(*rest.columns))


def option_ranking(strict: DataFrame, reuse: DataFrame, groups: DataFrame) -> DataFrame:
    """Options by missing runs with reuse, missing runs, reused groups (few rows)."""
    s = strict.groupBy("option").agg(F.sum(COUNTS[2]).alias("strict_missing"), F.sum(COUNTS[3]).alias("strict_total"))
    r = reuse.groupBy("option").agg(F.sum(COUNTS[2]).alias("reuse_missing"), F.sum(COUNTS[3]).alias("reuse_total"))
    g = groups.groupBy("option").agg(F.sum(F.when(F.col("shared") & F.col("completed_any"), 1).otherwise(0)).alias("reused"))
    out = s.join(r, "option").join(g, "option", "left").na.fill(0, ["reused"]).withColumn("saved", F.col("strict_missing") - F.col("reuse_missing"))
    # One row per option: the ranking needs a single ordered list.
    w = Window.partitionBy(F.lit(0)).orderBy("reuse_missing", "strict_missing", F.col("reused").desc(), "option")
    return out.withColumn("rank", F.row_number().over(w))


# --- sorts and picks -----------------------------------------------------------------


def oldest_run(df: DataFrame, group: list[str], path: str = "path", modified: str = "modified") -> DataFrame:
    """File with the oldest time stamp in its run token, else the oldest file."""
    stamp = F.regexp_extract(path, r"(\d{8}-\d{4})_", 1)
    has = stamp != ""
    order = F.struct((~has).cast("int"), F.when(has, stamp).otherwise(""), F.col(modified), F.col(path))
    return df.groupBy(*group).agg(F.min_by(path, order).alias(path))


def even_stride(df: DataFrame, group: list[str], order: str, max_rows: int) -> DataFrame:
    """At most ``max_rows`` evenly spaced rows per group."""
    staged = row_numbers(df, group, [order], "_r", "_n")
    step = F.greatest(F.ceil(F.col("_n") / max_rows), F.lit(1))
    return staged.where(F.col("_r") % step == 0).drop("_r", "_n")


def temperature_score(name: Column, prefer_smoothed: bool) -> Column:
    """Heuristic score of a variable name as surface air temperature."""
    # Markers and their weights
    s = F.lower(name)
    marks = [("temperature", 100), ("surface air", 100), ("tas", 80), ("change", 30), ("smooth", 60 if prefer_smoothed else 10), ("blended", -30)]
    total = F.lit(0)
    for text, weight in marks:
        total = total + F.when(s.contains(text), weight).otherwise(0)
    return total


def pick_temperature(df: DataFrame, group: list[str], name: str, prefer_smoothed: bool = True) -> DataFrame:
    """Best-scored temperature variable; smoothed names first if preferred."""
    s = F.lower(name)
    likely = df.where(s.contains("temperature") | s.contains("tas") | s.contains("smooth"))
    smooth = s.contains("smooth").cast("int") if prefer_smoothed else F.lit(0)
    order = F.struct(-smooth, -temperature_score(F.col(name), prefer_smoothed), F.col(name))
    return likely.groupBy(*group).agg(F.min_by(name, order).alias(name))


def pick_level(df: DataFrame, group: list[str], level: str, preferred: str | None = None) -> DataFrame:
    """Preferred level value, else the first in order."""
    off = F.lit(1) if preferred is None else (F.col(level) != preferred).cast("int")
    return df.groupBy(*group).agg(F.min_by(level, F.struct(off, F.col(level))).alias(level))


def random_pick(df: DataFrame, group: list[str], item: str, n: int, seed: str) -> DataFrame:
    """n distinct items per group without replacement, in hash order."""
    key = hash32(key_text(seed, F.col(item)))
    w = Window.partitionBy(*group).orderBy(key, item)
    return df.select(*group, item).distinct().withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def anchor_member(df: DataFrame, group: list[str], member: str = "member_id") -> DataFrame:
    """Smallest member name per group."""
    return df.groupBy(*group).agg(F.min(member).alias(member))


def preferred_version(df: DataFrame, keys: list[str], version: str, priority: list[str]) -> DataFrame:
    """Row of the version that comes first in the priority list."""
    pos = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col(version).cast("string"))
    listed = df.where(pos > 0)
    rest = [c for c in df.columns if c not in keys]
    return listed.groupBy(*keys).agg(F.min_by(F.struct(*rest), pos).alias("_b")).select(*keys, *[F.col("_b")[c].alias(c) for c in rest])


def model_per_draw(models: DataFrame, draws: DataFrame, draw: str, index: str, seed: str, fixed: int | None = None) -> DataFrame:
    """Model index of each draw: fixed, or hash modulo the number of models."""
    if fixed is not None:
        return draws.withColumn(index, F.lit(fixed))
    # The index list of an emulator has one row per model.
    listed = models.agg(F.sort_array(F.collect_set(index)).alias("_m"))
    joined = draws.join(F.broadcast(listed))
    return joined.withColumn(index, F.get(F.col("_m"), hash_mod(key_text(seed, F.col(draw)), F.size("_m")).cast("int"))).drop("_m")


# --- sets ----------------------------------------------------------------------------


def stitch(parent: DataFrame, child: DataFrame, keys: list[str], time: str = "month_idx") -> DataFrame:
    """Parent followed by child; the parent must end before the child starts."""
    p = parent.groupBy(*keys).agg(F.max(time).alias("_pmax"))
    c = child.groupBy(*keys).agg(F.min(time).alias("_cmin"))
    clash = p.join(c, keys).where(F.col("_pmax") >= F.col("_cmin"))
    if not clash.isEmpty():
        raise ValueError("the parent run ends after the child run starts")
    return parent.unionByName(child)


def key_set_counts(expected: DataFrame, completed: DataFrame, key: str, groups: list[str]) -> DataFrame:
    """useful / purge / missing / total of two key sets by one full join."""
    e = expected.select(*groups, key).distinct().withColumn("_e", F.lit(True))
    c = completed.select(*groups, key).distinct().withColumn("_c", F.lit(True))
    both = e.join(c, [*groups, key], "full")
    return both.groupBy(*groups).agg(*_conditional_counts(F.col("_e").isNotNull(), F.col("_c").isNotNull()))


def common_variables(a: DataFrame, b: DataFrame, keys: list[str], variable: str = "variable", restrict: list[str] | None = None) -> DataFrame:
    """Sorted variables both sides hold per key."""
    both = a.select(*keys, variable).distinct().join(b.select(*keys, variable).distinct(), [*keys, variable])
    if restrict:
        both = both.where(F.col(variable).isin(*restrict))
    return both.groupBy(*keys).agg(F.sort_array(F.collect_set(variable)).alias("variables"))


def inventory(catalogue: DataFrame, historical: str, future: str, natural: str, max_members: int | None = None) -> DataFrame:
    """Factual members (historical and future files) and natural members."""
    key = ["source_id", "member_id"]

    def files(exp, name):
        return catalogue.where(F.col("experiment_id") == exp).groupBy(*key).agg(F.min("path").alias(name))

    factual = files(historical, "_h").join(files(future, "_f"), key).select(*key, F.lit("factual").alias("forcing"), F.array("_h", "_f").alias("paths"))
    nat = files(natural, "_n").select(*key, F.lit("natural").alias("forcing"), F.array("_n").alias("paths"))
    out = factual.unionByName(nat)
    return out if max_members is None else first_members(out, ["source_id", "forcing"], max_members)


def append_missing(existing: DataFrame, candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Existing lookup plus candidates whose key it lacks."""
    return existing.unionByName(candidates.join(existing, keys, "left_anti"))


def expected_records(jobs: DataFrame, scales: list[int], kinds: list[str], regional: list[str], regions: list[str], windows: str = "windows") -> DataFrame:
    """Expected metric types of each job: scales x windows x kinds, and regions.

    A fixed number of rows per job, made by explode; no join. Jobs are dealt out
    first, since a small table of them, in a task or two, becomes many rows.
    """
    jobs = jobs.repartition(task_count(jobs.sparkSession))

    def lits(xs):
        return F.array(*[F.lit(x) for x in xs])

    base = jobs.withColumn("_w", F.explode(windows)).withColumn("_s", F.explode(lits([str(s) for s in scales])))
    whole = F.transform(lits(kinds), lambda k: F.concat(F.lit("Map_"), F.replace(k, F.lit("#"), F.concat(F.lit("SPEI"), F.col("_s"))), F.lit("_"), F.col("_w")))
    pairs = [f"{k}|{r}" for k in regional for r in regions]
    parts = F.transform(lits(pairs), lambda p: F.concat(
        F.lit("Reg_"), F.replace(F.split(p, r"\|")[0], F.lit("#"), F.concat(F.lit("SPEI"), F.col("_s"))), F.lit("_"), F.split(p, r"\|")[1], F.lit("_"), F.col("_w")))
    return base.withColumn("metrictype", F.explode(F.concat(whole, parts) if pairs else whole)).drop("_w", "_s")


def missing_artifacts(scenarios: DataFrame, variables: list[str], regions: DataFrame, present: DataFrame) -> DataFrame:
    """Expected (scenario, variable, region) minus present, listed per scenario."""
    names = regions.agg(F.sort_array(F.collect_set("region")).alias("_r"))  # the region list of a report
    grid = scenarios.select("scenario").distinct().join(F.broadcast(names)).withColumn("region", F.explode("_r")).drop("_r")
    grid = grid.withColumn("variable", F.explode(F.array(*[F.lit(v) for v in variables])))
    gone = grid.join(present.select("scenario", "variable", "region").distinct(), ["scenario", "variable", "region"], "left_anti")
    item = F.concat_ws("/", "variable", "region")
    return gone.groupBy("scenario").agg(F.array_join(F.sort_array(F.collect_list(item)), ",").alias("missing"), F.count(F.lit(1)).alias("n_missing"))
