"""Ensemble statistics, event probabilities and subsets."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridseries.functions.hashing import hash64_mod, hash_mod, key_text
from gridseries.operators import attribution as at
from gridseries.operators import ensemble as en
from gridseries.operators.filters import complete_window
from gridseries.plans.registry import query
from gridseries.plans.sqlparts import hash32
from gridseries.session import cut_lineage
from gridseries.plans.views import CELLS, ENSEMBLE, ENSEMBLE_MONTH, POINTS, cells, ensemble_month, ensemble_year, points, table

SEM = ["source_id", "experiment_id", "member_id"]


def q(expr: str, p: float) -> str:
    return f"quantile_cont({expr}, {p})"


@query("agg_06_annual_extremes", "source_id:s max_annual:d min_annual:d mean_annual:d", f"""
WITH {ENSEMBLE_MONTH}, a AS (SELECT source_id, experiment_id, member_id, year, avg(value) AS v FROM ensm WHERE year BETWEEN 1996 AND 2000 GROUP BY ALL)
SELECT source_id, max(v) AS max_annual, min(v) AS min_annual, avg(v) AS mean_annual FROM a GROUP BY 1""")
def agg_06(spark, sf_dir):
    """Largest, smallest and mean annual means over members."""
    return en.annual_extremes(ensemble_month(spark, sf_dir, (1996, 2000)), ["source_id"], ["experiment_id", "member_id"], "value", (1996, 2000))


CHANGE = ENSEMBLE + """, chg AS (SELECT source_id, experiment_id, member_id, avg(value) FILTER (year BETWEEN 1995 AND 1997) AS base,
  avg(value) FILTER (year BETWEEN 1999 AND 2001) AS future, avg(value) FILTER (year BETWEEN 1999 AND 2001) - avg(value) FILTER (year BETWEEN 1995 AND 1997) AS delta FROM ens GROUP BY 1, 2, 3)"""


def changes(spark, sf_dir):
    return en.period_change(ensemble_year(spark, sf_dir), SEM, "value", (1995, 1997), (1999, 2001))


@query("agg_07_period_change", "source_id:s experiment_id:s member_id:i base:d future:d delta:d", f"WITH {CHANGE} SELECT * FROM chg")
def agg_07(spark, sf_dir):
    """Change of period means per member."""
    return changes(spark, sf_dir)


@query("agg_08_change_stats", "source_id:s experiment_id:s n:i p05:d median:d p95:d", f"""
WITH {CHANGE} SELECT source_id, experiment_id, count(delta) AS n, {q("delta", .05)} AS p05, {q("delta", .5)} AS median, {q("delta", .95)} AS p95 FROM chg GROUP BY 1, 2""")
def agg_08(spark, sf_dir):
    """5/50/95 % of member changes."""
    return en.change_stats(changes(spark, sf_dir), ["source_id", "experiment_id"])


BANDS = ENSEMBLE + f""", bands AS (SELECT experiment_id, year, count(value) AS n, min(value) AS min, {q("value", .05)} AS p05, {q("value", .17)} AS p17, {q("value", .5)} AS p50,
  {q("value", .83)} AS p83, {q("value", .95)} AS p95, max(value) AS max FROM ens GROUP BY 1, 2)"""


def bands(spark, sf_dir):
    return en.percentile_bands(ensemble_year(spark, sf_dir), ["experiment_id", "year"], "value")


@query("agg_09_band_change", "experiment_id:s p05:d p50:d p95:d", f"""
WITH {BANDS}, d AS (SELECT experiment_id, avg(p05) FILTER (year >= 1999) - avg(p05) FILTER (year <= 1997) AS a, avg(p50) FILTER (year >= 1999) - avg(p50) FILTER (year <= 1997) AS b,
  avg(p95) FILTER (year >= 1999) - avg(p95) FILTER (year <= 1997) AS c FROM bands GROUP BY 1)
SELECT experiment_id, least(a, c) AS p05, b AS p50, greatest(a, c) AS p95 FROM d""")
def agg_09(spark, sf_dir):
    """Changes of bands with swapped ends put in order."""
    return en.band_change_stats(bands(spark, sf_dir), ["experiment_id"], (1995, 1997), (1999, 2001))


@query("agg_10_percentile_bands", "experiment_id:s year:i n:i min:d p05:d p17:d p50:d p83:d p95:d max:d", f"WITH {BANDS} SELECT * FROM bands")
def agg_10(spark, sf_dir):
    """Percentile bands per year."""
    return bands(spark, sf_dir)


@query("agg_11_draw_summary", "source_id:s year:i n_draws:i pred_mean:d p05:d p10:d p50:d p90:d p95:d", f"""
WITH {ENSEMBLE_MONTH} SELECT source_id, year, count(value) AS n_draws, avg(value) AS pred_mean, {q("value", .05)} AS p05, {q("value", .1)} AS p10, {q("value", .5)} AS p50,
  {q("value", .9)} AS p90, {q("value", .95)} AS p95 FROM ensm GROUP BY 1, 2""")
def agg_11(spark, sf_dir):
    """Mean and percentiles of draws."""
    return en.draw_summary(ensemble_month(spark, sf_dir), ["source_id", "year"], "value")


WARM = ENSEMBLE + """, warm AS (SELECT source_id, run, avg(d) AS warming FROM (
  SELECT source_id, experiment_id || '-' || member_id AS run, experiment_id, avg(value) FILTER (year >= 2000) - avg(value) FILTER (year <= 1996) AS d
  FROM ens GROUP BY ALL) GROUP BY 1, 2 HAVING avg(d) IS NOT NULL)"""


def warming(spark, sf_dir):
    e = ensemble_year(spark, sf_dir).withColumn("run", F.concat_ws("-", "experiment_id", F.col("member_id").cast("string")))
    return en.warming_by_run(e, ["source_id", "run"], ["experiment_id"], "value", (1995, 1996), (2000, 2001))


@query("agg_12_warming_by_run", "source_id:s run:s warming:d", f"WITH {WARM} SELECT * FROM warm")
def agg_12(spark, sf_dir):
    """End-of-period change per run."""
    return warming(spark, sf_dir)


EXC = ENSEMBLE_MONTH + """, ref AS (SELECT year, month, value AS v FROM (SELECT year, month, avg(value) AS value FROM ensm WHERE experiment_id = 'P' GROUP BY 1, 2) WHERE year BETWEEN 1998 AND 1999)"""


def exceed(spark, sf_dir, by):
    m = ensemble_month(spark, sf_dir)
    ref = m.where("experiment_id = 'P' AND year BETWEEN 1998 AND 1999").groupBy("year", "month").agg(F.avg("value").alias("v"))
    out = None
    for label, exp in (("p_all", "F"), ("p_nat", "O")):
        part = m.where(F.col("experiment_id") == exp)
        samples = part if by == ["month"] else part
        p = en.exceedance(ref, samples.select(*by, F.col("value").alias("s")), "v", "s", by, ["year", "month"]).withColumnRenamed("p", label)
        out = p if out is None else out.join(p, ["year", "month"])
    return out


def exceed_sql(on):
    return f"""e AS (SELECT ref.year, ref.month, avg(CAST(s.value <= v AS DOUBLE)) FILTER (s.experiment_id = 'F') AS p_all,
  avg(CAST(s.value <= v AS DOUBLE)) FILTER (s.experiment_id = 'O') AS p_nat FROM ref JOIN ensm s ON {on} GROUP BY 1, 2)"""


CURRENT = exceed_sql("ref.year = s.year AND ref.month = s.month")


@query("agg_25_exceedance_current", "year:i month:i p_all:d p_nat:d", f"WITH {EXC}, {CURRENT} SELECT * FROM e")
def agg_25(spark, sf_dir):
    """Share of members at or below the reference, matched by year and month."""
    return exceed(spark, sf_dir, ["year", "month"])


@query("agg_25_exceedance_by_month", "year:i month:i p_all:d p_nat:d", f"WITH {EXC}, {exceed_sql('ref.month = s.month')} SELECT * FROM e")
def agg_25_month(spark, sf_dir):
    """The same, matched by calendar month only."""
    return exceed(spark, sf_dir, ["month"])


@query("agg_26_probability_ratio", "year:i month:i ratio:d", f"WITH {EXC}, {CURRENT} SELECT *, CASE WHEN p_nat > 0 THEN p_all / p_nat END AS ratio FROM e")
def agg_26(spark, sf_dir):
    """Ratio of exceedance probabilities."""
    return exceed(spark, sf_dir, ["year", "month"]).withColumn("ratio", en.probability_ratio(F.col("p_all"), F.col("p_nat")))


def six(x):
    return f"CASE WHEN {x} = 0 THEN 0 ELSE round_even({x} * pow(10, 5 - floor(log10(abs({x})))), 0) / pow(10, 5 - floor(log10(abs({x})))) END"


@query("agg_27_probability_summary", "year:i n:i p10:d p33:d p50:d p67:d p90:d rp_p10:d rp_p50:d rp_p90:d", f"""
WITH {EXC}, {CURRENT}, s AS (SELECT year, count(p_all) AS n, {", ".join(f"{q('p_all', p)} AS a{int(p * 100)}" for p in en.SUMMARY)} FROM e GROUP BY 1),
r AS (SELECT year, n, {", ".join(f"{six(f'a{int(p * 100)}')} AS p{int(p * 100)}" for p in en.SUMMARY)} FROM s)
SELECT *, CASE WHEN p10 > 0 THEN 1 / p10 END AS rp_p10, CASE WHEN p50 > 0 THEN 1 / p50 END AS rp_p50, CASE WHEN p90 > 0 THEN 1 / p90 END AS rp_p90 FROM r""")
def agg_27(spark, sf_dir):
    """Percentiles of probabilities and return periods."""
    return en.probability_summary(exceed(spark, sf_dir, ["year", "month"]), ["year"], "p_all")


@query("agg_27_ratio_summary", "year:i n:i mean:d min:d p50:d max:d", f"""
WITH {EXC}, {CURRENT}, s AS (SELECT year, p_all / p_nat AS r FROM e WHERE p_nat > 0), t AS (SELECT year, count(r) AS n, avg(r) AS a, min(r) AS b, {q("r", .5)} AS c, max(r) AS d FROM s GROUP BY 1)
SELECT year, n, {six("a")} AS mean, {six("b")} AS min, {six("c")} AS p50, {six("d")} AS max FROM t""")
def agg_27_ratio(spark, sf_dir):
    """Summary of probability ratios."""
    r = exceed(spark, sf_dir, ["year", "month"]).withColumn("r", en.probability_ratio(F.col("p_all"), F.col("p_nat"))).where("r IS NOT NULL")
    return en.ratio_summary(r, ["year"], "r")


@query("agg_28_risk_lines", "year:i month:i return_period:i level:d", f"""
WITH {ENSEMBLE_MONTH}, q AS (SELECT year, month, {q("value", 1 / 5)} AS a, {q("value", 1 / 10)} AS b, {q("value", 1 / 50)} AS c FROM ensm GROUP BY 1, 2)
SELECT year, month, 5 AS return_period, a AS level FROM q UNION ALL SELECT year, month, 10, b FROM q UNION ALL SELECT year, month, 50, c FROM q""")
def agg_28(spark, sf_dir):
    """Levels of three return periods per month."""
    return en.risk_lines(ensemble_month(spark, sf_dir), "value", [5, 10, 50])


@query("agg_29_histogram", "source_id:s bin:i n:i bin_left:d", f"""
WITH {ENSEMBLE_MONTH} SELECT source_id, CAST(floor(value / 0.2) AS BIGINT) AS bin, count(*) AS n, floor(value / 0.2) * 0.2 AS bin_left FROM ensm GROUP BY ALL""")
def agg_29(spark, sf_dir):
    """Counts in bins of 0.2."""
    return en.histogram(ensemble_month(spark, sf_dir), ["source_id"], "value")


@query("agg_30_plume", "year:i low:d mid:d high:d", f"""
WITH {CELLS}, {POINTS}, m AS (SELECT region_id, year, point_id, quantile_cont(pr, 0.5) AS m FROM cells JOIN points USING (point_id) GROUP BY 1, 2, 3),
v AS (SELECT region_id, year, avg(m) AS v FROM m GROUP BY 1, 2) SELECT year, min(v) AS low, quantile_cont(v, 0.5) AS mid, max(v) AS high FROM v GROUP BY 1""")
def agg_30(spark, sf_dir):
    """Plume of member medians, members being regions."""
    c = cells(spark, sf_dir).join(points(spark, sf_dir).select("point_id", "region_id"), "point_id")
    return en.plume(c, ["region_id"], "pr")


@query("agg_31_extreme_years", "year_of_max:i year_of_min:i", f"""
WITH {ENSEMBLE_MONTH}, m AS (SELECT source_id, year, month, quantile_cont(value, 0.5) AS m FROM ensm GROUP BY 1, 2, 3)
SELECT (SELECT year FROM m ORDER BY m DESC, year, month LIMIT 1) AS year_of_max, (SELECT year FROM m ORDER BY m, year, month LIMIT 1) AS year_of_min""")
def agg_31(spark, sf_dir):
    """Years of the extreme ensemble medians."""
    return en.extreme_years(ensemble_month(spark, sf_dir), ["source_id"], "value", ["year", "month"])


@query("agg_57_map_snapshot", "point_id:i tas:d", f"WITH {CELLS} SELECT point_id, avg(tas) AS tas FROM cells WHERE year = 1999 AND month = 7 GROUP BY 1")
def agg_57(spark, sf_dir):
    """Field of July 1999."""
    return en.map_snapshot(cells(spark, sf_dir, (1999, 1999)), ["point_id"], "tas", 1999, 7)


@query("agg_57_column_median", "year:i month:i median:d", f"WITH {CELLS} SELECT year, month, quantile_cont(tas, 0.5) AS median FROM cells GROUP BY 1, 2")
def agg_57_median(spark, sf_dir):
    """Median over points per month."""
    return en.column_median(cells(spark, sf_dir), ["year", "month"], "tas")


@query("agg_58_pooled_months", "source_id:s member_id:i year:i month:i value:d", f"""
WITH {ENSEMBLE_MONTH} SELECT source_id, member_id, year, month, avg(value) AS value FROM ensm WHERE year BETWEEN 1997 AND 1999 GROUP BY 1, 2, 3, 4""")
def agg_58(spark, sf_dir):
    """Pooled samples per calendar month."""
    return en.pooled_months(ensemble_month(spark, sf_dir, (1997, 1999)), ["source_id", "member_id"], "value", (1997, 1999))


@query("agg_48_value_limits", "source_id:s vmin:d vmax:d", f"WITH {ENSEMBLE} SELECT source_id, min(value) AS vmin, max(value) AS vmax FROM ens GROUP BY 1")
def agg_48(spark, sf_dir):
    """Value limits per source."""
    return en.value_limits(ensemble_year(spark, sf_dir), ["source_id"], "value")


# --- bootstrap ---------------------------------------------------------------------

GROUPS = ["source_id", "forcing"]
R = 10_000
THRESHOLD = 205.0


def window_values(spark, sf_dir):
    """Factual and natural member-years of a complete six-year window."""
    e = ensemble_year(spark, sf_dir).where("experiment_id IN ('F', 'O')")
    forcing = F.when(F.col("experiment_id") == "F", "factual").otherwise("natural")
    v = e.select("source_id", forcing.alias("forcing"), F.col("member_id").alias("member"), "year", "value")
    # One source is too wet for any natural event, to reach the unbounded ratio.
    dry = F.when((F.col("source_id") == "5-LOW") & (F.col("forcing") == "natural"), F.col("value") + 1000).otherwise(F.col("value"))
    return complete_window(v.withColumn("value", dry), ["source_id", "forcing", "member"], (1995, 2000), strict=False)


WINDOW_VALUES = ENSEMBLE + """, wv AS (SELECT * FROM (SELECT source_id, CASE WHEN experiment_id = 'F' THEN 'factual' ELSE 'natural' END AS forcing, member_id AS member, year,
  CASE WHEN source_id = '5-LOW' AND experiment_id = 'O' THEN value + 1000 ELSE value END AS value,
  count(*) OVER (PARTITION BY source_id, experiment_id, member_id) AS n FROM ens WHERE experiment_id IN ('F', 'O') AND year BETWEEN 1995 AND 2000) WHERE n = 6)"""

BOOT = WINDOW_VALUES + f""",
ix AS (SELECT *, dense_rank() OVER (PARTITION BY source_id, forcing ORDER BY member) - 1 AS mi, year - 1995 AS yi, CASE WHEN value <= {THRESHOLD} THEN 1 ELSE 0 END AS ev FROM wv),
sz AS (SELECT source_id, forcing, max(mi) + 1 AS m FROM ix GROUP BY 1, 2),
sl AS (SELECT *, {hash32("concat_ws('|', '20260711', source_id, forcing, rep, slot)")} % m AS mi FROM (
  SELECT source_id, forcing, m, rep, unnest(range(0, m)) AS slot FROM (SELECT *, unnest(range(1, {R + 1})) AS rep FROM sz))),
bl AS (SELECT *, {hash32("concat_ws('|', '20260711', source_id, forcing, rep, slot, block)")} % 6 AS st FROM (SELECT *, unnest([0, 1]) AS block FROM sl)),
yr AS (SELECT *, (st + o) % 6 AS yi FROM (SELECT *, unnest(CASE WHEN block = 0 THEN [0, 1, 2, 3, 4] ELSE [0] END) AS o FROM bl)),
draw AS (SELECT yr.source_id, yr.forcing, rep, sum(ev) / max(m * 6.0) AS p FROM yr JOIN ix USING (source_id, forcing, mi, yi) GROUP BY 1, 2, 3)"""


def drawn(spark, sf_dir):
    v = window_values(spark, sf_dir)
    events = v.withColumn("event", F.when(F.col("value") <= THRESHOLD, 1).otherwise(0))
    return v, at.bootstrap(events, GROUPS, replicates=R)


@query("agg_34_bootstrap", "source_id:s forcing:s rep:i p:d", f"WITH {BOOT} SELECT * FROM draw")
def agg_34(spark, sf_dir):
    """Replicates of the hierarchical block bootstrap."""
    return drawn(spark, sf_dir)[1]


PROB = BOOT + f""",
qd AS (SELECT source_id, forcing, {q("p", .025)} AS lo, {q("p", .975)} AS hi FROM draw GROUP BY 1, 2),
pr AS (SELECT source_id, forcing, count(DISTINCT member) AS members, count(DISTINCT year) AS years_per_member, sum(CASE WHEN value <= {THRESHOLD} THEN 1 ELSE 0 END) AS events,
  count(*) AS opportunities, avg(CASE WHEN value <= {THRESHOLD} THEN 1.0 ELSE 0.0 END) AS estimate FROM wv GROUP BY 1, 2),
prow AS (SELECT pr.*, members * 2 AS effective_block_trials, CASE WHEN estimate > 0 THEN lo ELSE 0 END AS lower,
  CASE WHEN estimate > 0 THEN hi ELSE 1 - pow(0.05, 1.0 / (members * 2)) END AS upper, estimate = 0 AS one_sided FROM pr JOIN qd USING (source_id, forcing))"""


@query("agg_32_probability_rows", "source_id:s forcing:s members:i years_per_member:i events:i opportunities:i estimate:d lower:d upper:d one_sided:b effective_block_trials:i",
       f"WITH {PROB} SELECT * FROM prow")
def agg_32(spark, sf_dir):
    """Event probabilities with intervals; one group has no event."""
    v, d = drawn(spark, sf_dir)
    return at.probability_rows(v, d, GROUPS, "value", F.lit(THRESHOLD))


@query("agg_33_ratio_rows", "source_id:s factual_probability:d natural_probability:d estimate:d lower:d upper:d one_sided:b one_sided_point_ratio_bound:d", f"""
WITH {PROB}, j AS (SELECT f.source_id, f.rep, f.p AS pf, CASE WHEN n.p > 0 THEN f.p / n.p END AS r FROM draw f JOIN draw n ON f.source_id = n.source_id AND f.rep = n.rep AND f.forcing = 'factual' AND n.forcing = 'natural'),
a AS (SELECT source_id, {q("r", .025)} AS q1, {q("r", .05)} AS q2, {q("r", .975)} AS q3, avg(CASE WHEN r IS NULL THEN 1.0 ELSE 0.0 END) AS bad, {q("pf", .05)} AS pf5 FROM j GROUP BY 1),
b AS (SELECT a.*, f.estimate AS p1, n.estimate AS p0, n.upper AS nu, n.estimate = 0 OR bad >= 0.025 AS os, n.estimate = 0 AND f.estimate > 0 AS ub
  FROM a JOIN prow f ON a.source_id = f.source_id AND f.forcing = 'factual' JOIN prow n ON a.source_id = n.source_id AND n.forcing = 'natural')
SELECT source_id, p1 AS factual_probability, p0 AS natural_probability, CASE WHEN ub THEN 'inf'::DOUBLE WHEN p0 > 0 THEN p1 / p0 END AS estimate,
  CASE WHEN ub THEN pf5 / nu WHEN os THEN q2 ELSE q1 END AS lower, CASE WHEN os THEN 'inf'::DOUBLE ELSE q3 END AS upper, os AS one_sided, CASE WHEN ub THEN p1 / nu END AS one_sided_point_ratio_bound FROM b""")
def agg_33(spark, sf_dir):
    """Probability ratios; one of them unbounded."""
    v, d = drawn(spark, sf_dir)
    d = cut_lineage(d)  # read by both probability rows and the ratios
    rows = at.probability_rows(v, d, GROUPS, "value", F.lit(THRESHOLD))
    return at.ratio_rows(rows, d, GROUPS)


@query("agg_35_residual_resampling", "source_id:s n:i q025:d q50:d q975:d", f"""
WITH {ENSEMBLE}, b AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY source_id) AS nb FROM (SELECT source_id, value FROM ens WHERE experiment_id = 'F')),
r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY resid) - 1 AS j, count(*) OVER (PARTITION BY source_id) AS nr FROM (SELECT source_id, value - 200 AS resid FROM ens WHERE experiment_id = 'O')),
d AS (SELECT source_id, {hash32("concat_ws('|', '7', 'base', source_id, draw)")} % nb AS i, {hash32("concat_ws('|', '7', 'resid', source_id, draw)")} % nr AS j FROM (
  SELECT source_id, max(nb) AS nb, max(nr) AS nr, unnest(range(1, 2001)) AS draw FROM b JOIN (SELECT DISTINCT source_id, nr FROM r) USING (source_id) GROUP BY 1)),
s AS (SELECT source_id, value + resid AS x FROM d JOIN b USING (source_id, i) JOIN r USING (source_id, j))
SELECT source_id, count(*) AS n, {q("x", .025)} AS q025, {q("x", .5)} AS q50, {q("x", .975)} AS q975 FROM s GROUP BY 1""")
def agg_35(spark, sf_dir):
    """Quantiles of resampled conditioned values plus residuals."""
    e = ensemble_year(spark, sf_dir)
    cond = e.where("experiment_id = 'F'").select("source_id", "value")
    fit = e.where("experiment_id = 'O'").select("source_id", F.col("value").alias("truth"), F.lit(200.0).alias("fit"))
    return en.resample_residuals(cond, fit, ["source_id"], 2000, "7", [0.025, 0.5, 0.975], ["q025", "q50", "q975"])


def anchored_sql(strategy):
    drawn_ = ("h <= 4" if strategy == "random" else "list_contains([round_even(i * (m - 1) / 3.0, 0) for i in range(0, 4)], k)")
    return f"""
WITH {WARM}, a AS (SELECT *, row_number() OVER o - 1 AS r, count(*) OVER (PARTITION BY source_id) AS n, lag(warming) OVER o AS lg, lead(warming) OVER o AS ld FROM warm WINDOW o AS (PARTITION BY source_id ORDER BY warming, run)),
b AS (SELECT *, max(CASE WHEN r = n // 2 THEN CASE WHEN ld IS NULL OR abs((lg + warming) / 2 - warming) <= abs((warming + ld) / 2 - warming) THEN 1 ELSE 0 END END) OVER (PARTITION BY source_id) AS am FROM a),
c AS (SELECT *, CASE WHEN n % 2 = 0 OR am = 1 THEN n // 2 - 1 ELSE n // 2 END AS lo FROM b),
d AS (SELECT *, CASE WHEN r < lo THEN -1 WHEN r > lo + 1 THEN 1 ELSE 0 END AS side FROM c),
e AS (SELECT *, count(*) OVER (PARTITION BY source_id, side) AS m, row_number() OVER (PARTITION BY source_id, side ORDER BY r) - 1 AS k,
  row_number() OVER (PARTITION BY source_id, side ORDER BY {hash32("concat_ws('|', '11', source_id, run)")}, run) AS h FROM d)
SELECT source_id, run, warming FROM e WHERE side = 0 OR {drawn_}"""


@query("srt_05_median_anchored", "source_id:s run:s warming:d", anchored_sql("random"))
def srt_05(spark, sf_dir):
    """Ten runs per source around the median, hash-ordered."""
    return en.median_anchored(warming(spark, sf_dir), ["source_id"], "run", "warming", 10, "11")


@query("srt_05_median_anchored_stratified", "source_id:s run:s warming:d", anchored_sql("stratified"))
def srt_05_stratified(spark, sf_dir):
    """Ten runs per source around the median, evenly spaced."""
    return en.median_anchored(warming(spark, sf_dir), ["source_id"], "run", "warming", 10, "11", "stratified")


@query("srt_06_random_search", "source_id:s attempt:i subset_median:d full_median:d diff:d", f"""
WITH {WARM}, t AS (SELECT *, unnest(range(1, 101)) AS attempt FROM warm),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id, attempt ORDER BY {hash32("concat_ws('|', '5', source_id, attempt, run)")}, run) AS h FROM t) WHERE h <= 8),
m AS (SELECT source_id, attempt, {q("warming", .5)} AS subset_median FROM p GROUP BY 1, 2), f AS (SELECT source_id, {q("warming", .5)} AS full_median FROM warm GROUP BY 1),
s AS (SELECT *, abs(subset_median - full_median) AS diff FROM m JOIN f USING (source_id))
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY round(diff, 9), attempt) AS k FROM s) WHERE k = 1""")
def srt_06(spark, sf_dir):
    """Best of a hundred random subsets of eight runs."""
    return en.random_search(warming(spark, sf_dir), ["source_id"], "run", "warming", 8, 100, "5")


@query("str_02_stable_hash", "o_orderkey:i mod32:i mod64:i", f"""
SELECT o_orderkey, {hash32("concat_ws('|', 'k', o_orderkey)")} % 1000 AS mod32, CAST(('0x' || substr(sha256(concat_ws('|', 'k', o_orderkey)), 1, 16))::UBIGINT % 10000 AS BIGINT) AS mod64 FROM orders""")
def str_02(spark, sf_dir):
    """Stable hash modulo with 32 and with 64 bits."""
    o = table(spark, sf_dir, "orders")
    text = key_text("k", F.col("o_orderkey"))
    return o.select("o_orderkey", hash_mod(text, 1000).alias("mod32"), hash64_mod(text, 10000).alias("mod64"))
