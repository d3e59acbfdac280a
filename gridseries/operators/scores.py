"""Energy scores and the recipe vectors they are computed on."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridseries.functions.quantiles import broadcast_if_small, grouped_percentiles, percentiles
from gridseries.operators.timeseries import autocorrelation, detrend, lag_correlation
from gridseries.session import cut_lineage

BLOCK = 256


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance over the common length of two arrays."""
    n = F.least(F.size(a), F.size(b))
    sq = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(sq, F.lit(0.0), lambda s, x: s + x))


def _block_pairs(vectors: DataFrame, keys: list[str], id_col: str, vec: str, block: int) -> DataFrame:
    """Pairs of blocks of a group, each block a flat array of its vectors.

    Pairs of single vectors are never rows: a group of n vectors gives about
    (n/block)^2/2 rows, spread by (group, block).
    """
    sizes = vectors.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(F.size(vec)).alias("_len"))
    tagged = vectors.join(broadcast_if_small(sizes), keys).withColumn("_nb", F.ceil(F.col("_n") / block).cast("int"))
    tagged = tagged.withColumn("_b", F.pmod(F.xxhash64(F.col(id_col)), F.col("_nb")).cast("int"))
    cut = F.slice(F.col(vec), 1, F.col("_len"))
    blocks = tagged.groupBy(*keys, "_b").agg(F.flatten(F.collect_list(cut)).alias("_m"), F.max("_nb").alias("_nb"), F.max("_len").alias("_len"))
    left = blocks.withColumn("_other", F.explode(F.sequence(F.col("_b"), F.col("_nb") - 1)))
    right = blocks.select(*keys, F.col("_b").alias("_other"), F.col("_m").alias("_m2"))
    return left.join(right, [*keys, "_other"])


def _pair_distances(a, b, length: int, same: bool) -> np.ndarray:
    x = np.asarray(a, dtype=float).reshape(-1, length)
    y = np.asarray(b, dtype=float).reshape(-1, length)
    out = []
    for i in range(len(x)):
        rest = y[i + 1:] if same else y
        if len(rest):
            out.append(np.sqrt(((rest - x[i]) ** 2).sum(axis=1)))
    return np.concatenate(out) if out else np.empty(0)


def _on_pairs(pairs: DataFrame, keys: list[str], found: Callable[..., list[pa.Array]], columns: dict[str, T.DataType], more: tuple[str, ...] = ()) -> DataFrame:
    """``keys`` and the ``columns`` that ``found(distances, *more)`` gives for each pair of blocks.

    Blocks are views of the Arrow batch, and what a pair gives leaves at once: a
    Python worker holds a batch (64 MB by Spark's default, however many pairs its
    task has) and the distances of one pair.
    """
    rows = pairs.select(*keys, "_m", "_m2", "_len", (F.col("_b") == F.col("_other")).alias("_same"), *more)
    schema = T.StructType([rows.schema[k] for k in keys] + [T.StructField(name, kind) for name, kind in columns.items()])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (at, x), (at2, y) = [(c.offsets.to_numpy(), c.values.to_numpy(zero_copy_only=False)) for c in (batch.column("_m"), batch.column("_m2"))]
            lengths, same = batch.column("_len").to_pylist(), batch.column("_same").to_pylist()
            for i in range(batch.num_rows):
                d = _pair_distances(x[at[i]: at[i + 1]], y[at2[i]: at2[i + 1]], lengths[i], same[i])
                given = found(d, *[batch.column(c)[i].as_py() for c in more])
                own = pa.array([i] * len(given[0]), pa.int64())
                yield pa.RecordBatch.from_arrays([*[batch.column(k).take(own) for k in keys], *given], names)

    return rows.mapInArrow(run, schema)


def mean_pair_distance(vectors: DataFrame, keys: list[str], id_col: str, vec: str, block: int = BLOCK) -> DataFrame:
    """Mean distance over all unordered pairs of a group (zero for a single vector)."""
    def partial(d: np.ndarray) -> list[pa.Array]:
        return [pa.array([d.sum()], pa.float64()), pa.array([len(d)], pa.int64())]

    pairs = _block_pairs(vectors, keys, id_col, vec, block)
    part = _on_pairs(pairs, keys, partial, {"_sum": T.DoubleType(), "_pairs": T.LongType()})
    agg = part.groupBy(*keys).agg(F.sum("_sum").alias("_s"), F.sum("_pairs").alias("n_pairs"))
    return agg.select(*keys, "n_pairs", F.when(F.col("n_pairs") > 0, F.col("_s") / F.col("n_pairs")).otherwise(0.0).alias("mean_distance"))


#: Bins of a pass over implicit pairs, and values of an interval that are looked at one by one.
PAIR_BINS, PAIR_VALUES = 1024, 4096


def bin_counts(d: np.ndarray, lo: float, hi: float, bins: int) -> list[tuple[int, int, float, float]]:
    """(bin, count, smallest, largest) of the values in [lo, hi], for bins that hold any."""
    d = np.sort(d[(d >= lo) & (d <= hi)])
    if not len(d):
        return []
    at = np.minimum(((d - lo) * (bins / (hi - lo))).astype(np.int64), bins - 1) if hi > lo else np.zeros(len(d), np.int64)
    begins = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    ends = np.append(begins[1:], len(d))
    return list(zip(at[begins].tolist(), (ends - begins).tolist(), d[begins].tolist(), d[ends - 1].tolist(), strict=True))


def pair_distance_median(vectors: DataFrame, keys: list[str], label: list[str], id_col: str, vec: str, out: str, block: int = BLOCK, bins: int = PAIR_BINS, values: int = PAIR_VALUES) -> DataFrame:
    """label, ``out``: median of the positive distances of all unordered pairs within ``keys``, by ``label`` (some of the keys).

    No pair becomes a row. A pass counts, in tasks that hold a pair of blocks, the
    distances of an interval in bins; the bin that holds the wanted rank, cut to
    its smallest and largest value, is the next interval, until it holds few
    values, which are then looked at. Labels without a positive distance are
    absent.
    """
    pairs = cut_lineage(_block_pairs(vectors, keys, id_col, vec, block))

    def extent(d: np.ndarray) -> list[pa.Array]:
        d = d[d > 0]
        ends = (d.min(), d.max()) if len(d) else (None, None)
        return [pa.array([len(d)], pa.int64()), *[pa.array([end], pa.float64()) for end in ends]]

    def counted(d: np.ndarray, targets: list[dict]) -> list[pa.Array]:
        d = d[d > 0]
        rows = [(t["target"], *row) for t in targets for row in bin_counts(d, t["lo"], t["hi"], bins)]
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.float64())
        return [pa.array([row[k] for row in rows], kind) for k, kind in enumerate(kinds)]

    def listed(d: np.ndarray, targets: list[dict]) -> list[pa.Array]:
        rows = [(t["target"], v) for t in targets for v in d[(d >= t["lo"]) & (d <= t["hi"]) & (d > 0)].tolist()]
        return [pa.array([t for t, _ in rows], pa.int32()), pa.array([v for _, v in rows], pa.float64())]

    number, whole, real = T.IntegerType(), T.LongType(), T.DoubleType()

    def by_label(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.join(broadcast_if_small(right), label) if label else left.join(F.broadcast(right))  # one row without a label

    ends = _on_pairs(pairs, label, extent, {"n": whole, "lo": real, "hi": real})
    sizes = ends.groupBy(*label).agg(F.sum("n").alias("_n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("_n > 0")
    ranks = F.array(F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2))
    # A target is a rank (from 0) and the interval that holds it: values below it, and values in it.
    state = sizes.select(*label, F.posexplode(ranks).alias("target", "rank"), "lo", "hi", F.lit(0).cast("bigint").alias("below"), F.col("_n").alias("inside"))
    state = cut_lineage(state)
    while not state.where((F.col("inside") > values) & (F.col("lo") < F.col("hi"))).isEmpty():
        wide = state.groupBy(*label).agg(F.collect_list(F.struct("target", "lo", "hi")).alias("_t"))
        hist = _on_pairs(by_label(pairs, wide), label, counted, {"target": number, "bin": number, "n": whole, "lo": real, "hi": real}, ("_t",))
        hist = hist.groupBy(*label, "target", "bin").agg(F.sum("n").alias("n"), F.min("lo").alias("blo"), F.max("hi").alias("bhi"))
        upto = Window.partitionBy(*label, "target").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # at most ``bins`` rows
        hist = hist.withColumn("earlier", F.coalesce(F.sum("n").over(upto), F.lit(0)))
        joined = state.join(hist, [*label, "target"])
        place = F.col("rank") - F.col("below")
        held = joined.where((place >= F.col("earlier")) & (place < F.col("earlier") + F.col("n")))
        state = cut_lineage(held.select(*label, "target", "rank", F.col("blo").alias("lo"), F.col("bhi").alias("hi"), (F.col("below") + F.col("earlier")).alias("below"), F.col("n").alias("inside")))
    fixed = state.where("lo = hi").select(*label, "target", F.col("lo").alias("value"))
    open_ = state.where("lo < hi")
    wide = open_.groupBy(*label).agg(F.collect_list(F.struct("target", "lo", "hi")).alias("_t"))
    few = _on_pairs(by_label(pairs, wide), label, listed, {"target": number, "value": real}, ("_t",))
    ordered = few.withColumn("_k", F.row_number().over(Window.partitionBy(*label, "target").orderBy("value")) - 1)  # at most ``values`` rows
    picked = ordered.join(open_, [*label, "target"]).where(F.col("_k") == F.col("rank") - F.col("below")).select(*label, "target", "value")
    return fixed.unionByName(picked).groupBy(*label).agg(F.avg("value").alias(out))


def energy_score(draws: DataFrame, truth: DataFrame, keys: list[str], id_col: str, vec: str) -> DataFrame:
    """mean|draw - truth| - mean|draw - draw'| / 2 per key."""
    t = truth.select(*keys, F.col(vec).alias("_t"))
    cross = draws.join(broadcast_if_small(t), keys).groupBy(*keys).agg(
        F.avg(distance(F.col(vec), F.col("_t"))).alias("cross"), F.count(F.lit(1)).alias("n_draws")
    )
    spread = mean_pair_distance(draws, keys, id_col, vec)
    return cross.join(spread, keys).select(
        *keys, "n_draws", "cross", F.col("mean_distance").alias("spread"), (F.col("cross") - 0.5 * F.col("mean_distance")).alias("es")
    )


def normalised_scores(es: DataFrame, truth: DataFrame, scenario: list[str], label: list[str], model: str, vec: str) -> DataFrame:
    """S = ES / median inter-model distance of the label; positive ones only."""
    ref = pair_distance_median(truth, [*scenario, *label], label, model, vec, "ref")
    joined = es.join(broadcast_if_small(ref), label) if label else es.join(F.broadcast(ref))  # one row without a label
    return joined.where("es > 0 AND ref > 0").withColumn("s", F.col("es") / F.col("ref"))


def score_summary(scores: DataFrame, keys: list[str]) -> DataFrame:
    """n, median, quartiles and IQR of S."""
    scores = cut_lineage(scores)  # read twice; all pairs are behind it
    q = grouped_percentiles(scores, keys, "s", [0.25, 0.5, 0.75], ["q1", "median_s", "q3"])
    return q.withColumn("iqr", F.col("q3") - F.col("q1"))


# --- recipe vectors ------------------------------------------------------------------
# Each takes long fields (run keys, variable, t, pix, lat, value) with t = 0.. and
# gives (run keys, recipe, label, idx, value). Vectors of one run are short.


def _emit(df: DataFrame, run: list[str], recipe: str, idx, value="value", label="variable") -> DataFrame:
    idx = F.col(idx) if isinstance(idx, str) else idx
    label = F.col(label) if isinstance(label, str) else label
    return df.select(*run, F.lit(recipe).alias("recipe"), label.alias("label"), idx.cast("bigint").alias("idx"), F.col(value).alias("value"))


def global_mean(df: DataFrame, run: list[str], max_months: int | None = None) -> DataFrame:
    kept = df if max_months is None else df.where(F.col("t") < max_months)
    return kept.groupBy(*run, "variable", "t").agg(F.avg("value").alias("value"))


def _whole_years(gm: DataFrame, run: list[str], least: int = 0) -> DataFrame:
    """Months of whole years; a series of fewer than ``least`` years has no rows."""
    n = F.max("t").over(Window.partitionBy(*run, "variable")) + 1
    return gm.withColumn("_n", F.floor(n / 12) * 12).where((F.col("t") < F.col("_n")) & (F.col("_n") >= 12 * least)).drop("_n")


def _unfold(df: DataFrame, keys: list[str], arr: str) -> DataFrame:
    return df.select(*keys, F.posexplode(arr).alias("idx", "value"))


def bias_maps(df, run):
    return _emit(df.groupBy(*run, "variable", "pix").agg(F.avg("value").alias("value")), run, "BiasMaps", "pix")


def global_timeseries(df, run):
    return _emit(global_mean(df, run), run, "GlobalTimeseries", "t")


def histograms(df, run, n_q=50):
    probs = np.linspace(0.01, 0.99, n_q).tolist()
    names = [f"_q{i}" for i in range(n_q)]
    q = grouped_percentiles(df, [*run, "variable"], "value", probs, names)
    return _emit(_unfold(q.withColumn("_a", F.array(*names)), [*run, "variable"], "_a"), run, "Histograms", "idx")


def seasonal_cycle(df, run):
    gm = _whole_years(global_mean(df, run, None), run)
    return _emit(gm.groupBy(*run, "variable", (F.col("t") % 12).alias("idx")).agg(F.avg("value").alias("value")), run, "SeasonalCycle", "idx")


def zonal_profiles(df, run, bands: int):
    """Band means of the time-mean field; a band without pixels is zero."""
    width = 180.0 / bands
    field = df.groupBy(*run, "variable", "pix", "lat").agg(F.avg("value").alias("value"))
    zm = field.groupBy(*run, "variable", F.floor((F.col("lat") + 90.0) / width).alias("idx")).agg(F.avg("value").alias("value"))
    entries = zm.groupBy(*run, "variable").agg(F.map_from_entries(F.collect_list(F.struct("idx", "value"))).alias("_m"))
    full = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.coalesce(F.element_at("_m", i.cast("bigint")), F.lit(0.0)))
    return _emit(_unfold(entries.withColumn("_a", full), [*run, "variable"], "_a"), run, "ZonalMeans", "idx")


def _deseasonalised(gm, run):
    clim = F.avg("value").over(Window.partitionBy(*run, "variable", F.col("t") % 12))
    return gm.withColumn("value", F.col("value") - clim)


def variability(df, run):
    """Deseasonalised, detrended global means of series of two whole years or more."""
    gm = _whole_years(global_mean(df, run), run, 2)
    out = detrend(_deseasonalised(gm, run), [*run, "variable"], F.col("t"), "value", "resid")
    return _emit(out, run, "Variability", "t", "resid")


def joint_evolution(df, run, variables: list[str], lags=12):
    """Lagged cross-correlations of each pair of variables, for runs of 24 months or more."""
    gm = global_mean(df, run).groupBy(*run, "t").pivot("variable", variables).agg(F.first("value"))
    gm = gm.withColumn("_n", F.max("t").over(Window.partitionBy(*run)) + 1).where("_n >= 24").drop("_n")
    pairs = [(a, b) for i, a in enumerate(variables) for b in variables[i + 1:]]
    rows = F.array(*[F.struct(F.lit(f"{a}_{b}").alias("variable"), F.col(a).alias("a"), F.col(b).alias("b")) for a, b in pairs])
    long = gm.select(*run, "t", F.inline(rows))
    return _emit(lag_correlation(long, [*run, "variable"], "t", "a", "b", lags), run, "JointEvolution", "lag", "corr")


def humidity_coupling(df, run, pairs: list[tuple[str, str]]):
    """Humidity and temperature series of each pair, interleaved."""
    used = sorted({v for p in pairs for v in p})
    gm = global_mean(df.where(F.col("variable").isin(*used)), run).groupBy(*run, "t").pivot("variable", used).agg(F.first("value"))
    rows = F.array(*[
        F.struct(F.lit(f"{h}_{t}").alias("variable"), (F.col("t") * 2 + k).alias("idx"), F.col(c).alias("value"))
        for h, t in pairs for k, c in ((0, h), (1, t))
    ])
    return _emit(gm.select(*run, F.inline(rows)), run, "HumidityCoupling", "idx")


def tail_quantiles(df, run, n_q=40):
    probs = np.concatenate([np.linspace(0.01, 0.10, n_q // 2), np.linspace(0.90, 0.99, n_q // 2)]).tolist()
    gm = global_mean(df, run, None).groupBy(*run, "variable").agg(percentiles(F.col("value"), probs).alias("_a"))
    return _emit(_unfold(gm, [*run, "variable"], "_a"), run, "IndicatorFreq", "idx")


def teleconnections(df, run, index_variable="tas", tropics=30.0, max_months: int | None = None):
    """Correlation of the tropical index with every pixel."""
    kept = df if max_months is None else df.where(F.col("t") < max_months)
    idx = kept.where((F.col("variable") == index_variable) & (F.abs("lat") < tropics)).groupBy(*run, "t").agg(F.avg("value").alias("_i"))
    joined = kept.join(broadcast_if_small(idx), [*run, "t"])
    agg = joined.groupBy(*run, "variable", "pix").agg(
        F.covar_pop("_i", "value").alias("_c"), F.stddev_pop("_i").alias("_si"), F.stddev_pop("value").alias("_sv")
    )
    corr = F.col("_c") / ((F.col("_si") + 1e-10) * (F.col("_sv") + 1e-10))
    return _emit(agg.withColumn("value", corr), run, "ENSOTeleconnections", "pix")


def index_characteristics(df, run, variables: list[str], tropics=30.0, lags=24):
    """Standard deviation, skewness and autocorrelation of tropical indices, for series of three whole years or more."""
    kept = df.where(F.col("variable").isin(*variables) & (F.abs("lat") < tropics))
    gm = _deseasonalised(_whole_years(global_mean(kept, run), run, 3), run)
    series = [*run, "variable"]
    centred = gm.withColumn("_d", F.col("value") - F.avg("value").over(Window.partitionBy(*series)))
    mom = centred.groupBy(*series).agg((F.stddev_pop("value") + 1e-10).alias("sigma"), F.avg(F.pow("_d", F.lit(3.0))).alias("_m3"))
    rows = F.array(
        F.struct(F.lit(0).alias("idx"), F.col("sigma").alias("value")),
        F.struct(F.lit(1).alias("idx"), (F.col("_m3") / F.pow("sigma", F.lit(3.0))).alias("value")),
    )
    head = mom.select(*series, F.inline(rows))
    acf = autocorrelation(gm, series, "t", "value", lags).select(*series, (F.col("lag") + 1).alias("idx"), F.col("acf").alias("value"))
    return _emit(head.unionByName(acf), run, "ENSOCharacteristics", "idx")


def collect_vectors(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Recipe rows to one array per (keys, recipe, label)."""
    agg = rows.groupBy(*keys, "recipe", "label").agg(F.sort_array(F.collect_list(F.struct("idx", "value"))).alias("_s"))
    return agg.select(*keys, "recipe", "label", F.transform("_s", lambda s: s["value"]).alias("vec"))
