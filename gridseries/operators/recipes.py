"""Comparison recipes and the attribution summary.

A recipe is ``fn(a, b, cfg) -> DataFrame`` of (metrictype, value) rows; recipes
are looked up by name, and users add their own with :func:`recipe`.
"""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridseries.functions.pet import with_pet
from gridseries.functions.quantiles import broadcast_if_small, percentiles
from gridseries.operators import attribution as at
from gridseries.operators.catalog import common_years
from gridseries.operators.filters import complete_window
from gridseries.operators.index import glo_index, rolling_sum, shared_index
from gridseries.operators.metrics import CENTILES
from gridseries.operators.predictors import apply_offsets, radiation_offsets
from gridseries.operators.spatial import weighted_mean
from gridseries.operators.spectral import power_udf
from gridseries.operators.timeseries import apply_to_series
from gridseries.session import cut_lineage, tasks_for

#: Rows (by month, side, window and scale) that a task of the index sorts, of up to 1 KB each in its stacked windows.
INDEX_ROWS = 250_000

RECIPES: dict[str, Callable[[DataFrame, DataFrame, dict], DataFrame]] = {}
#: By recipe: the records that a table of jobs will give, without running it.
EXPECTED: dict[str, Callable[[DataFrame, dict], DataFrame]] = {}


def recipe(name: str, expected_records: Callable[[DataFrame, dict], DataFrame] | None = None):
    """Register a recipe: its scores and, if given, the records that it is expected to give for jobs."""
    def add(fn):
        RECIPES[name] = fn
        if expected_records is not None:
            EXPECTED[name] = expected_records
        return fn

    return add


def load_plugin(module: str) -> list[str]:
    """Import a module that registers recipes; the names it has added."""
    before = set(RECIPES)
    import_module(module)
    return sorted(set(RECIPES) - before)


def open_jobs(name: str, jobs: DataFrame, stored: DataFrame, job: list[str], record: list[str], cfg: dict) -> DataFrame:
    """The jobs of which an expected record is not stored; jobs that expect none are left out.

    ``expected_records`` gives (job, record) for the jobs, ``stored`` holds such
    keys; nothing of the recipe itself runs. Keys compare as text, null like null.
    """
    if name not in EXPECTED:
        raise KeyError(f"recipe {name!r} does not say which records it gives; known: {sorted(EXPECTED)}")
    keys = [*job, *record]
    have = stored.select(*[F.col(c).cast("string").alias(f"_{c}") for c in keys]).distinct()
    same = F.lit(True)
    for c in keys:
        same &= F.col(c).cast("string").eqNullSafe(F.col(f"_{c}"))
    missing = EXPECTED[name](jobs, cfg).join(have, same, "left_anti").select(*[F.col(c).alias(f"_{c}") for c in job]).distinct()
    wanted = F.lit(True)
    for c in job:
        wanted &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return jobs.join(missing, wanted, "left_semi")


def run_open_jobs(name: str, jobs: DataFrame, a: DataFrame, b: DataFrame, stored: DataFrame, job: list[str], record: list[str], cfg: dict) -> DataFrame:
    """Records of the open jobs only: the recipe's inputs are cut to them before it runs.

    ``a`` and ``b`` carry the job columns. Rows of records that are stored
    already, of jobs that lack others, are not given again.
    """
    open_ = open_jobs(name, jobs, stored, job, record, cfg).select(*job).distinct()
    mine = lambda df: df.join(broadcast_if_small(open_), job, "left_semi")
    fresh = run_recipe(name, mine(a), mine(b), cfg)
    have = stored.select(*job, *record).distinct()
    return fresh.join(have, [*job, *record], "left_anti")


def run_recipe(name: str, a: DataFrame, b: DataFrame, cfg: dict) -> DataFrame:
    if name not in RECIPES:
        raise KeyError(f"unknown recipe {name!r}; known: {sorted(RECIPES)}")
    return RECIPES[name](a, b, cfg)


def _l2(a: str, b: str):
    total = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(total / F.size(a))


@recipe("drought")
def index_comparison(a: DataFrame, b: DataFrame, cfg: dict) -> DataFrame:
    """Map and region metrics of two water-balance fields over windows and scales.

    ``a`` and ``b`` hold (point_id, year, month, month_idx, wb). cfg: windows
    [(y0, y1)], scales, regions (region_id, point_id, weight) or None, probs,
    period_min, period_max. Windows, scales and both sides are rows of one plan,
    so the fit runs once whatever their number.
    """
    scales, windows = cfg.get("scales", [3, 6, 24, 48]), cfg["windows"]
    probs, pmin, pmax = cfg.get("probs") or CENTILES, cfg.get("period_min", 2), cfg.get("period_max", 120)
    keep = ["point_id", "year", "month", "month_idx", "wb"]
    both = cut_lineage(a.select(F.lit("a").alias("side"), *keep).unionByName(b.select(F.lit("b").alias("side"), *keep)))
    spans = F.array(*[F.struct(F.lit(s).alias("w0"), F.lit(e).alias("w1")) for s, e in windows])
    # Windows and scales multiply the rows after they are dealt out, which their bytes don't show.
    dealt = both.repartition(tasks_for(both.sparkSession, both.count() * len(windows) * len(scales), INDEX_ROWS), "point_id")
    rows = dealt.withColumn("_w", F.explode(spans)).where(F.col("year").between(F.col("_w.w0"), F.col("_w.w1")))
    rows = rows.select("side", *keep, F.col("_w.w0").alias("w0"), F.col("_w.w1").alias("w1"))
    series = ["side", "w0", "w1", "point_id"]
    for k in scales:
        rows = rolling_sum(rows, series, "wb", k, f"acc{k}")
    long = rows.select(*series, "month", "month_idx", F.explode(F.array(*[F.struct(F.lit(k).alias("scale"), F.col(f"acc{k}").alias("acc")) for k in scales])).alias("_s"))
    long = long.select(*series, "month", "month_idx", "_s.scale", "_s.acc").where("acc IS NOT NULL")
    idx = glo_index(long, [*series, "scale", "month"], "acc", "z")

    unit = ["w0", "w1", "scale"]
    per_month = idx.groupBy(*unit, "point_id", "month_idx").agg(
        *[F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{c}_{s}") for s in ("a", "b") for c in ("z", "acc")]
    )
    per_month = cut_lineage(per_month)  # read by the map and the region metrics
    aligned = F.col("z_a").isNotNull() & F.col("z_b").isNotNull()
    power = power_udf(pmin, pmax)
    # Months both tables cover; a window loses scale-1 months at its start.
    of = lambda s: F.when(F.col("side") == s, F.col("month_idx"))
    reach = both.agg(F.min(of("a")).alias("_a0"), F.max(of("a")).alias("_a1"), F.min(of("b")).alias("_b0"), F.max(of("b")).alias("_b1"))  # one row
    def spectra(groups: DataFrame) -> DataFrame:
        lo = F.greatest("_a0", "_b0", F.col("w0") * 12) + F.col("scale") - 1
        hi = F.least("_a1", "_b1", F.col("w1") * 12 + 11)
        timed = groups.join(F.broadcast(reach)).withColumns({"_lo": lo.cast("int"), "_hi": hi.cast("int")})
        return timed.withColumns({"_pa": power("_t", "_va", "_lo", "_hi"), "_pb": power("_t", "_vb", "_lo", "_hi")})

    def distances(df: DataFrame, keys: list[str], extra=()) -> DataFrame:
        za, zb = F.when(aligned, F.col("z_a")), F.when(aligned, F.col("z_b"))
        g = df.groupBy(*keys).agg(
            percentiles(za, probs).alias("_qa"), percentiles(zb, probs).alias("_qb"),
            F.collect_list(F.when(aligned, F.col("month_idx"))).alias("_t"), F.collect_list(za).alias("_va"), F.collect_list(zb).alias("_vb"), *extra,
        )
        return spectra(g).withColumns({"distq": _l2("_qa", "_qb"), "spec": _l2("_pa", "_pb")})

    maps = distances(per_month, [*unit, "point_id"], [
        F.max("z_a").alias("max_a"), F.max("z_b").alias("max_b"), F.avg("acc_a").alias("mu_a"), F.avg("acc_b").alias("mu_b"),
        F.stddev_pop("acc_a").alias("sd_a"), F.stddev_pop("acc_b").alias("sd_b"),
    ])
    d = lambda n: F.col(f"{n}_a") - F.col(f"{n}_b")
    rms = lambda x: F.sqrt(F.avg(x * x))
    total = maps.groupBy(*unit).agg(
        rms(d("max")).alias("RMSE_MAX"), rms(d("mu")).alias("RMSE_MU"), F.avg(d("mu")).alias("Dev_MU"), rms(d("sd")).alias("RMSE_SD"),
        F.avg(d("sd")).alias("Dev_SD"), rms(F.col("distq")).alias("RMSE_DISTQ"), rms(F.col("spec")).alias("RMSE_SPEC"),
    )

    def name(prefix, kind, stat, region=None):
        middle = [F.lit(f"{prefix}_{kind}_SPEI"), F.col("scale").cast("string"), F.lit(stat)]
        tail = [F.lit("_")] + ([F.col(region), F.lit("_")] if region else [])
        return F.concat(*middle, *tail, F.col("w0").cast("string"), F.lit("to"), F.col("w1").cast("string"))

    stats = [("RMSE", "MAX"), ("RMSE", "MU"), ("Dev", "MU"), ("RMSE", "SD"), ("Dev", "SD"), ("RMSE", "DISTQ"), ("RMSE", "SPEC")]
    out = total.select(F.inline(F.array(*[F.struct(name("Map", k, s).alias("metrictype"), F.col(f"{k}_{s}").alias("value")) for k, s in stats])))
    regions = cfg.get("regions")
    if regions is None:
        return out
    tagged = per_month.join(broadcast_if_small(regions), "point_id")
    mean = tagged.groupBy("region_id", *unit, "month_idx").agg(*[weighted_mean(F.col(f"z_{s}"), F.col("weight")).alias(f"z_{s}") for s in ("a", "b")])
    reg = distances(mean, ["region_id", *unit])
    rows = F.array(*[F.struct(name("Reg", "RMSE", s, "region_id").alias("metrictype"), F.col(c).alias("value")) for s, c in (("DISTQ", "distq"), ("SPEC", "spec"))])
    return out.unionByName(reg.select(F.inline(rows)))


GRID, REGIONAL = "gridcell-spei-area-mean", "regional-water-balance-spei"
METHODS = ["penman-monteith", "hargreaves", "thornthwaite"]


def event_balance(df: DataFrame, series: list[str], weights: DataFrame, methods: list[str], scale: int, month: int = 12) -> DataFrame:
    """Event-month accumulated balance per method, at points and as regional sum.

    Regional rows carry point_id -1 and weight 1.
    """
    cell = [*series, "point_id"]
    for m in methods:
        df = with_pet(df, cell, m, f"pet_{m}")
    balances = F.array(*[F.struct(F.lit(m).alias("method"), (F.col("pr") - F.col(f"pet_{m}")).alias("wb")) for m in methods])
    long = df.select(*cell, "year", "month", "month_idx", F.inline(balances)).join(broadcast_if_small(weights), "point_id")
    region = long.groupBy(*series, "method", "year", "month", "month_idx").agg(F.sum(F.coalesce(F.col("wb") * F.col("weight"), F.lit(0.0))).alias("wb"))
    region = region.withColumns({"point_id": F.lit(-1).cast("bigint"), "weight": F.lit(1.0), "aggregation": F.lit(REGIONAL)})
    points = long.withColumns({"aggregation": F.lit(GRID), "point_id": F.col("point_id").cast("bigint")}).select(*region.columns)
    both = points.unionByName(region)
    acc = rolling_sum(both, [*series, "method", "aggregation", "point_id"], "wb", scale, "acc")
    return acc.where((F.col("month") == month) & F.col("acc").isNotNull()).select(*series, "method", "aggregation", "point_id", "weight", "year", "acc")


def _with_baselines(df: DataFrame, baselines: list[tuple[int, int]]) -> DataFrame:
    spans = F.array(*[F.struct(F.lit(a).alias("baseline_start"), F.lit(b).alias("baseline_end")) for a, b in baselines])
    return df.select("*", F.inline(spans))


def member_index(reference: DataFrame, members: DataFrame, weights: DataFrame, cfg: dict) -> tuple[DataFrame, DataFrame]:
    """(thresholds, member-year index) for every lane of the protocol.

    ``reference``: (point_id, lat, year, month, month_idx, pr, tas, ...);
    ``members``: the same with source, forcing (factual / natural) and member.
    cfg: methods, baselines [primary, second], offset_years, event_year, scale.
    """
    methods, baselines = cfg.get("methods", METHODS), cfg["baselines"]
    scale, period = cfg.get("scale", 48), cfg["offset_years"]
    unit = ["method", "aggregation", "baseline_start", "baseline_end"]
    in_baseline = F.col("year").between(F.col("baseline_start"), F.col("baseline_end"))

    ref = _with_baselines(event_balance(reference, [], weights, methods, scale), baselines)
    ref_idx = glo_index(ref, [*unit, "point_id"], "acc", "z", in_baseline)
    thresholds = ref_idx.where(F.col("year") == cfg["event_year"]).groupBy(*unit).agg(weighted_mean(F.col("z"), F.col("weight")).alias("threshold"))

    factual = members.where("forcing = 'factual'")
    smoothing = cfg.get("smoothing", (21, 10, 11))
    offsets = cut_lineage(radiation_offsets(reference, factual, "rsds", period, *smoothing, keys=["source"]))
    year0, year1 = period
    clipped = F.when(F.col("forcing") == "natural", F.lit(year0)).otherwise(F.least(F.greatest(F.col("year"), F.lit(year0)), F.lit(year1)))
    shifted = members.withColumn("_year", clipped).join(
        broadcast_if_small(offsets.withColumnRenamed("year", "_year")), ["source", "point_id", "month", "_year"], "left"
    ).withColumn("rsds", F.col("rsds") + F.coalesce("offset", F.lit(0.0))).drop("_year", "offset")
    treated = shifted.withColumn("treatment", F.lit("adjusted")).unionByName(members.withColumn("treatment", F.lit("unadjusted")))

    series = ["source", "forcing", "member", "treatment"]
    # One row per member, lane and year: kept because fits and targets both read it.
    dec = cut_lineage(event_balance(treated, series, weights, methods, scale))
    dec = common_years(dec, ["source", "forcing"], "member")
    # The four lanes of the protocol.
    lanes = _with_baselines(dec, baselines)
    primary = F.col("baseline_start") == baselines[0][0]
    adjusted, grid = F.col("treatment") == "adjusted", F.col("aggregation") == GRID
    lanes = lanes.where((primary & (adjusted | grid)) | (~primary & adjusted & grid))
    group = ["source", "treatment", *unit, "target", "point_id"]
    fit = lanes.where("forcing = 'factual'").withColumn("target", F.explode(F.array(F.lit("factual"), F.lit("natural"))))
    idx = shared_index_by(fit, lanes.withColumn("target", F.col("forcing")), group)
    values = idx.groupBy("source", "forcing", "member", "treatment", *unit, "year").agg(weighted_mean(F.col("z"), F.col("weight")).alias("value"))
    return thresholds, values


def shared_index_by(fit: DataFrame, target: DataFrame, group: list[str]) -> DataFrame:
    """Shared fit where the baseline years are columns of the rows."""
    cols = target.columns
    both = fit.select(*cols, F.lit(False).alias("_target")).unionByName(target.select(*cols, F.lit(True).alias("_target")))
    cal = ~F.col("_target") & F.col("year").between(F.col("baseline_start"), F.col("baseline_end"))
    return glo_index(both, group, "acc", "z", cal).where("_target").drop("_target")


def summarise_protocol(reference: DataFrame, members: DataFrame, weights: DataFrame, cfg: dict) -> DataFrame:
    """Probability and ratio rows of all lanes.

    cfg also needs window (y0, y1), replicates and block_years.
    """
    thresholds, values = member_index(reference, members, weights, cfg)
    window, block = cfg["window"], cfg.get("block_years", at.BLOCK_YEARS)
    lane = ["source", "treatment", "method", "aggregation", "baseline_start", "baseline_end"]
    groups = [*lane, "forcing"]
    unit = ["method", "aggregation", "baseline_start", "baseline_end"]
    inside = complete_window(values, [*groups, "member"], window).join(broadcast_if_small(thresholds), unit)
    inside = cut_lineage(inside)  # member-years of the window, used by counts and draws
    events = inside.withColumn("event", F.when(F.col("value") <= F.col("threshold"), 1).otherwise(0))
    draws = cut_lineage(at.bootstrap(events, groups, cfg.get("replicates", at.REPLICATES), cfg.get("seed", at.SEED), block))
    rows = at.probability_rows(inside, draws, groups, "value", F.col("threshold"), block)
    ratios = at.ratio_rows(rows, draws, groups)
    left = rows.withColumns({"record_type": F.lit("probability"), "window_start": F.lit(window[0]), "window_end": F.lit(window[1])})
    right = ratios.withColumns({
        "record_type": F.lit("probability_ratio"), "forcing": F.lit("factual/natural"), "window_start": F.lit(window[0]), "window_end": F.lit(window[1]),
    })
    return left.unionByName(right, allowMissingColumns=True)


def member_series(values: DataFrame, baseline: tuple[int, int]) -> DataFrame:
    """Series rows of the primary lane, members numbered per source and forcing."""
    kept = values.where(
        (F.col("baseline_start") == baseline[0]) & (F.col("treatment") == "adjusted") & (F.col("aggregation") == GRID)
    )
    w = Window.partitionBy("source", "forcing", "method").orderBy("member")
    return kept.select("source", "forcing", F.col("method").alias("pet_method"), F.dense_rank().over(w).alias("member_index"), "year", F.col("value").alias("december_spei48"))


def fit_series(df: DataFrame, series: list[str], fn, schema: str, many: bool = False) -> DataFrame:
    """User function on the pandas rows of one series (bounded by its months), or with ``many`` of many whole series at once."""
    return apply_to_series(df, series, fn, schema, many=many)


__all__ = [
    "EXPECTED", "RECIPES", "index_comparison", "load_plugin", "member_index", "member_series", "open_jobs", "recipe", "run_open_jobs", "run_recipe", "shared_index", "summarise_protocol",
]
