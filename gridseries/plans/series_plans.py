"""Smoothing, interpolation, splicing and windows over series."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridseries.functions import calendar as cal
from gridseries.functions.quantiles import broadcast_if_small
from gridseries.operators import timeseries as ts
from gridseries.operators.recurrence import steady_state
from gridseries.operators.spatial import area_mean
from gridseries.plans.registry import query
from gridseries.plans.views import CELLS, ENSEMBLE, POINTS, SERIES_MONTH, cells, ensemble_year, points, series_month, table

COS = "cos(radians(lat))"


def annual(spark, sf_dir):
    """Annual means of the wet months of every point, with gaps."""
    wet = F.when(F.col("pr") >= 120, F.col("tas"))
    return cells(spark, sf_dir).groupBy("point_id", "year").agg(F.when(F.count(wet) >= 6, F.avg(wet)).alias("v"))


ANNUAL = CELLS + ", ann AS (SELECT point_id, year, CASE WHEN count(tas) FILTER (pr >= 120) >= 6 THEN avg(tas) FILTER (pr >= 120) END AS v FROM cells GROUP BY 1, 2)"


@query("win_02_centred_mean", "source_id:s month_idx:i value:d smooth:d", f"""
WITH {SERIES_MONTH} SELECT *, avg(value) OVER (PARTITION BY source_id ORDER BY month_idx RANGE BETWEEN 6 PRECEDING AND 6 FOLLOWING) AS smooth FROM ser""")
def win_02(spark, sf_dir):
    """Thirteen-month centred mean, at least one value."""
    return ts.centred_mean(series_month(spark, sf_dir), ["source_id"], "month_idx", "value", 6, 6, "smooth")


def edge_sql(src, series, n, pad, half):
    w = f"PARTITION BY {series} ORDER BY year"
    return f"""
rk AS (SELECT *, count(v) OVER ({w}) AS l, count(v) OVER ({w} DESC) AS r FROM {src}),
ft AS (SELECT {series}, min(year) AS t0, max(year) AS t1, count(v) AS n,
  regr_slope(v, year) FILTER (v IS NOT NULL AND l <= {n}) AS ls, regr_intercept(v, year) FILTER (v IS NOT NULL AND l <= {n}) AS li, count(v) FILTER (l <= {n}) AS ln,
  min_by(v, year) FILTER (v IS NOT NULL AND l <= {n}) AS lv,
  regr_slope(v, year) FILTER (v IS NOT NULL AND r <= {n}) AS rs, regr_intercept(v, year) FILTER (v IS NOT NULL AND r <= {n}) AS ri, count(v) FILTER (r <= {n}) AS rn,
  min_by(v, year) FILTER (v IS NOT NULL AND r <= {n}) AS rv FROM rk GROUP BY {series}),
ex AS (SELECT {series}, year, CASE WHEN ln >= 2 THEN ls * year + li ELSE lv END AS v, true AS e FROM (SELECT *, unnest(range(t0 - {pad}, t0)) AS year FROM ft WHERE n > 0)
  UNION ALL SELECT {series}, year, CASE WHEN rn >= 2 THEN rs * year + ri ELSE rv END, true FROM (SELECT *, unnest(range(t1 + 1, t1 + {pad} + 1)) AS year FROM ft WHERE n > 0)
  UNION ALL SELECT {series}, year, v, false FROM {src}),
sm AS (SELECT *, avg(v) OVER (PARTITION BY {series} ORDER BY year RANGE BETWEEN {half} PRECEDING AND {half} FOLLOWING) AS smooth FROM ex)"""


@query("win_03_edge_trend_mean", "point_id:i year:i smooth:d", f"""
WITH {ANNUAL}, {edge_sql("ann", "point_id", 3, 4, 3)} SELECT * FROM sm WHERE NOT e""")
def win_03(spark, sf_dir):
    """Seven-year mean with trend-extended ends (fits over three years)."""
    return ts.edge_trend_mean(annual(spark, sf_dir), ["point_id"], "v", "smooth", window=7, fit_years=3, extension=4)


@query("win_04_running_mean_extended", "source_id:s month_idx:i smooth:d", f"""
WITH {SERIES_MONTH}, f0 AS (SELECT *, min(year) OVER w AS y0, max(year) OVER w AS y1 FROM ser WINDOW w AS (PARTITION BY source_id)),
ft AS (SELECT source_id, min(month_idx) AS t0, max(month_idx) AS t1,
  regr_slope(value, month_idx / 12.0) FILTER (year <= y0 + 1) AS ls, regr_intercept(value, month_idx / 12.0) FILTER (year <= y0 + 1) AS li,
  regr_slope(value, month_idx / 12.0) FILTER (year >= y1 - 1) AS rs, regr_intercept(value, month_idx / 12.0) FILTER (year >= y1 - 1) AS ri FROM f0 GROUP BY 1),
ex AS (SELECT source_id, m AS month_idx, ls * m / 12.0 + li AS value, true AS e FROM (SELECT *, unnest(range(t0 - 24, t0)) AS m FROM ft)
  UNION ALL SELECT source_id, m, rs * m / 12.0 + ri, true FROM (SELECT *, unnest(range(t1 + 1, t1 + 25)) AS m FROM ft)
  UNION ALL SELECT source_id, month_idx, value, false FROM ser),
sm AS (SELECT *, CASE WHEN count(value) OVER w = 24 THEN avg(value) OVER w END AS smooth FROM ex WINDOW w AS (PARTITION BY source_id ORDER BY month_idx RANGE BETWEEN 12 PRECEDING AND 11 FOLLOWING))
SELECT * FROM sm WHERE NOT e""")
def win_04(spark, sf_dir):
    """Two-year running mean of monthly series with extended ends."""
    return ts.trend_extended_running_mean(series_month(spark, sf_dir), ["source_id"], "value", "smooth", years=2)


@query("win_12_annual_to_monthly", "source_id:s experiment_id:s member_id:i year:i month:i value:d", f"""
WITH {ENSEMBLE}, a AS (SELECT *, lead(year) OVER w AS yn, lead(value) OVER w AS vn, lag(year) OVER w AS yp FROM ens WHERE year <> 1998 WINDOW w AS (PARTITION BY source_id, experiment_id, member_id ORDER BY year)),
m AS (SELECT *, unnest(range(CASE WHEN yp IS NULL THEN 1994 * 12 ELSE year * 12 END, CASE WHEN yn IS NULL THEN 2003 * 12 ELSE yn * 12 END)) AS mi FROM a)
SELECT source_id, experiment_id, member_id, mi // 12 AS year, mi % 12 + 1 AS month,
  CASE WHEN yn IS NOT NULL AND mi >= year * 12 THEN value + (vn - value) * (mi - year * 12) / ((yn - year) * 12.0) ELSE value END AS value FROM m""")
def win_12(spark, sf_dir):
    """Monthly values between annual points, one year missing, ends held."""
    keys = ["source_id", "experiment_id", "member_id"]
    return ts.annual_to_monthly(ensemble_year(spark, sf_dir).where("year <> 1998"), keys, "value", (1994, 2002))


@query("win_12_repeat_monthly", "source_id:s experiment_id:s member_id:i year:i month:i value:d", f"""
WITH {ENSEMBLE} SELECT *, unnest(range(1, 13)) AS month FROM ens""")
def win_12_repeat(spark, sf_dir):
    """Annual values repeated twelve times."""
    return ts.repeat_monthly(ensemble_year(spark, sf_dir))


@query("win_13_fill_gaps", "point_id:i year:i filled:d", f"""
WITH {ANNUAL}, b AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN year END IGNORE NULLS) OVER p AS tb, last_value(v IGNORE NULLS) OVER p AS vb,
  first_value(CASE WHEN v IS NOT NULL THEN year END IGNORE NULLS) OVER f AS ta, first_value(v IGNORE NULLS) OVER f AS va FROM ann
  WINDOW p AS (PARTITION BY point_id ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY point_id ORDER BY year ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT *, CASE WHEN v IS NOT NULL THEN v WHEN vb IS NOT NULL AND va IS NOT NULL THEN vb + (va - vb) * (year - tb) / (ta - tb) ELSE coalesce(vb, va, 0) END AS filled FROM b""")
def win_13(spark, sf_dir):
    """Missing years filled linearly, ends held."""
    return ts.fill_gaps(annual(spark, sf_dir), ["point_id"], "year", "v", "filled")


def reference_series(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem")
    mi = cal.month_index(F.year("l_shipdate"), F.month("l_shipdate"))
    return e.groupBy(mi.alias("month_idx")).agg((F.avg("l_extendedprice") / 100).alias("value")).where("month_idx BETWEEN 23963 AND 24001")


REFERENCE = """ref AS (SELECT year(l_shipdate) * 12 + month(l_shipdate) - 1 AS month_idx, avg(l_extendedprice) / 100 AS r FROM lineitem
  GROUP BY 1 HAVING month_idx BETWEEN 23963 AND 24001)"""


def splice_sql(head, tail):
    return f"""
WITH {SERIES_MONTH}, {REFERENCE}, en AS (SELECT min(month_idx) AS r0, max(month_idx) AS r1 FROM ref),
z AS (SELECT *, r0 // 12 * 12 AS s0, least(r0 // 12 * 12 + 11, r1) AS s1, least(r1 // 12 * 12 + 11, r1) AS e1 FROM en),
z2 AS (SELECT *, greatest(e1 - 11, s0) AS e0 FROM z),
m AS (SELECT source_id, ser.month_idx, value AS v, r, s0, s1, e0, e1 FROM ser LEFT JOIN ref USING (month_idx), z2),
f AS (SELECT *, avg(v) FILTER (month_idx BETWEEN s0 AND s1) OVER w AS bs, avg(r) FILTER (month_idx BETWEEN s0 AND s1) OVER w AS rs,
  avg(v) FILTER (month_idx BETWEEN e0 AND e1) OVER w AS be, avg(r) FILTER (month_idx BETWEEN e0 AND e1) OVER w AS re,
  min(month_idx) FILTER (month_idx BETWEEN s0 AND s1) OVER w AS f0, max(month_idx) FILTER (month_idx BETWEEN s0 AND s1) OVER w AS f1,
  min(month_idx) FILTER (month_idx BETWEEN e0 AND e1) OVER w AS g0, max(month_idx) FILTER (month_idx BETWEEN e0 AND e1) OVER w AS g1
  FROM m WINDOW w AS (PARTITION BY source_id)),
h AS (SELECT *, {head} AS hd, {tail} AS tl, (month_idx - f0) / (f1 - f0) AS ws, (month_idx - g0) / (g1 - g0) AS we FROM f)
SELECT source_id, month_idx, coalesce(CASE WHEN month_idx BETWEEN e0 AND e1 THEN r * (1 - we) + tl * we WHEN month_idx BETWEEN s0 AND s1 THEN hd * (1 - ws) + r * ws
  WHEN month_idx < s0 THEN hd WHEN month_idx > e1 THEN tl ELSE r END, r, tl) AS value FROM h"""


@query("win_14_splice_shift", "source_id:s month_idx:i value:d", splice_sql("v + (rs - bs)", "v + (re - be)"))
def win_14_shift(spark, sf_dir):
    """Reference spliced into model series by shifting."""
    return ts.splice(series_month(spark, sf_dir), reference_series(spark, sf_dir), ["source_id"], start_years=1, end_years=1)


@query("win_14_splice_guarded_scale", "source_id:s month_idx:i value:d", splice_sql(
    "v * least(greatest(rs / bs, -3), 3) + rs - bs * least(greatest(rs / bs, -3), 3)",
    "v * least(greatest(re / be, -3), 3) + re - be * least(greatest(re / be, -3), 3)"))
def win_14_guarded(spark, sf_dir):
    """Reference spliced in by guarded scaling."""
    return ts.splice(
        series_month(spark, sf_dir), reference_series(spark, sf_dir), ["source_id"], start_years=1, end_years=1, mode="guarded_scale"
    )


@query("win_15_anchor", "source_id:s month_idx:i anchored:d", f"""
WITH {SERIES_MONTH} SELECT *, value + (287.5 - avg(value) FILTER (year BETWEEN 1996 AND 1999) OVER (PARTITION BY source_id)) AS anchored FROM ser""")
def win_15(spark, sf_dir):
    """Series shifted to a baseline mean."""
    return ts.anchor(series_month(spark, sf_dir), ["source_id"], "value", 287.5, (1996, 1999), "anchored")


@query("win_16_first_per_month", "user_id:i year:i month:i event_id:i value:d", """
SELECT * FROM (SELECT user_id, year(ts) AS year, month(ts) AS month, event_id, value, row_number() OVER (PARTITION BY user_id, year(ts), month(ts) ORDER BY ts, event_id) AS r FROM events) WHERE r = 1""")
def win_16(spark, sf_dir):
    """First event of each user and month."""
    e = cal.month_parts(table(spark, sf_dir, "events"), "ts").select("user_id", "year", "month", "ts", "event_id", "value")
    return ts.first_per_month(e, ["user_id"], ["ts", "event_id"])


DELTA = SERIES_MONTH + """,
o AS (SELECT source_id, year, avg(value) AS o FROM ser GROUP BY 1, 2),
s AS (SELECT *, avg(o) OVER (PARTITION BY source_id ORDER BY year RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS sm FROM o),
p AS (SELECT source_id, year, avg(value * 0.9 + 20) AS p FROM ser WHERE year <> 1999 GROUP BY 1, 2),
delta AS (SELECT source_id, year, sm - p AS delta FROM s JOIN p USING (source_id, year))"""


def deltas(spark, sf_dir):
    ser = series_month(spark, sf_dir)
    predictor = ser.where("year <> 1999").withColumn("value", F.col("value") * 0.9 + 20)
    return ts.yearly_delta(ser, predictor, ["source_id"], window=5)


@query("win_17_yearly_delta", "source_id:s year:i delta:d", f"WITH {DELTA} SELECT * FROM delta")
def win_17(spark, sf_dir):
    """Smoothed output minus predictor per year."""
    return deltas(spark, sf_dir)


@query("win_18_corrected_predictor", "source_id:s month_idx:i corrected:d", f"""
WITH {DELTA}, m AS (SELECT source_id, avg(delta) AS mean FROM delta GROUP BY 1)
SELECT *, value - coalesce(delta, mean, 0) / 10 AS corrected FROM ser LEFT JOIN delta USING (source_id, year) LEFT JOIN m USING (source_id)""")
def win_18(spark, sf_dir):
    """Second-pass predictors; the year without a delta takes the mean."""
    return ts.corrected_predictor(series_month(spark, sf_dir), deltas(spark, sf_dir), ["source_id"])


@query("win_19_tail_mean", "source_id:s value:d", f"""
WITH {SERIES_MONTH} SELECT source_id, avg(value) AS value FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY month_idx DESC) AS r FROM ser) WHERE r <= 20 GROUP BY 1""")
def win_19(spark, sf_dir):
    """Mean of the last twenty months."""
    return ts.tail_mean(series_month(spark, sf_dir), ["source_id"], "month_idx", "value", 20)


@query("win_10_detrend", "point_id:i month_idx:i resid:d", f"""
WITH {CELLS}, f AS (SELECT point_id, regr_slope(tas, month_idx - 24000) AS s, regr_intercept(tas, month_idx - 24000) AS i FROM cells GROUP BY 1)
SELECT point_id, month_idx, tas - s * (month_idx - 24000) - i AS resid FROM cells JOIN f USING (point_id)""")
def win_10(spark, sf_dir):
    """Line removed from each point series."""
    return ts.detrend(cells(spark, sf_dir), ["point_id"], F.col("month_idx"), "tas", "resid")


@query("win_09_lag_correlation", "point_id:i lag:i corr:d", f"""
WITH {CELLS}, l AS (SELECT unnest(range(0, 12)) AS lag)
SELECT a.point_id, lag, corr(a.tas, b.pr) AS corr FROM cells a JOIN l ON true JOIN cells b ON a.point_id = b.point_id AND b.month_idx = a.month_idx + lag GROUP BY 1, 2""")
def win_09(spark, sf_dir):
    """Twelve lagged correlations of temperature and rain."""
    return ts.lag_correlation(cells(spark, sf_dir), ["point_id"], "month_idx", "tas", "pr", 12)


LOWPASS = ts.butterworth_sections(4, (1.0 / 30.0) / 6.0)


def recursion_sql(name: str, source: str, value: str) -> str:
    """Recursive CTE of the two sections over ``source`` (region_id, p, value), one sample a step."""
    (b, a), (c, d) = LOWPASS

    def step(z: list[str]) -> str:
        x = f"s.{value}"
        y = f"({b[0]!r}::DOUBLE * {x} + {z[0]})"
        w = f"({c[0]!r}::DOUBLE * {y} + {z[2]})"
        return (
            f"{w} AS y, {b[1]!r}::DOUBLE * {x} + {z[1]} - ({a[1]!r}::DOUBLE) * {y} AS z0, {b[2]!r}::DOUBLE * {x} - {a[2]!r}::DOUBLE * {y} AS z1, "
            f"{c[1]!r}::DOUBLE * {y} + {z[3]} - ({d[1]!r}::DOUBLE) * {w} AS z2, {c[2]!r}::DOUBLE * {y} - {d[2]!r}::DOUBLE * {w} AS z3"
        )

    steady = [f"({v!r}::DOUBLE) * s.{value}" for v in map(float, steady_state(LOWPASS))]
    return (
        f"{name} AS (SELECT region_id, p, {step(steady)} FROM {source} s WHERE p = 0 "
        f"UNION ALL SELECT s.region_id, s.p, {step([f'f.z{k}' for k in range(4)])} FROM {name} f JOIN {source} s ON s.region_id = f.region_id AND s.p = f.p + 1)"
    )


@query("win_20_lowpass_removed", "region_id:s month_idx:i value:d index:d", f"""
WITH RECURSIVE {CELLS}, {POINTS}, an AS (SELECT region_id, cells.lat, month_idx, tas - avg(tas) OVER (PARTITION BY point_id, month) AS a FROM cells JOIN (SELECT point_id, region_id FROM points) USING (point_id)),
raw AS (SELECT region_id, month_idx, sum(a * {COS}) / sum({COS}) AS v FROM an WHERE a IS NOT NULL GROUP BY 1, 2),
sm AS (SELECT region_id, month_idx, avg(v) OVER (PARTITION BY region_id ORDER BY month_idx RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS x FROM raw),
num AS (SELECT *, row_number() OVER o - 1 AS k, count(*) OVER (PARTITION BY region_id) AS n, first_value(x) OVER o AS x0, first_value(x) OVER (PARTITION BY region_id ORDER BY month_idx DESC) AS x1 FROM sm WINDOW o AS (PARTITION BY region_id ORDER BY month_idx)),
pd AS (SELECT *, least(15, n - 1) AS pad FROM num),
ext AS MATERIALIZED (SELECT region_id, k + pad AS p, x, n + 2 * pad AS total, month_idx FROM pd UNION ALL SELECT region_id, pad - k, 2 * x0 - x, n + 2 * pad, NULL FROM pd WHERE k BETWEEN 1 AND pad
  UNION ALL SELECT region_id, pad + n - 1 + (n - 1 - k), 2 * x1 - x, n + 2 * pad, NULL FROM pd WHERE k BETWEEN n - 1 - pad AND n - 2),
{recursion_sql("fwd", "ext", "x")},
turned AS MATERIALIZED (SELECT region_id, total - 1 - p AS p, y AS f FROM fwd JOIN ext USING (region_id, p)),
{recursion_sql("back", "turned", "f")}
SELECT ext.region_id, month_idx, ext.x AS value, ext.x - back.y AS index FROM ext JOIN back ON back.region_id = ext.region_id AND back.p = ext.total - 1 - ext.p WHERE month_idx IS NOT NULL""")
def win_20(spark, sf_dir):
    """Index of every region: anomalies, area mean, three-month mean, low-pass trend removed."""
    from gridseries.operators.ensemble import anomalies

    deviations = anomalies(cells(spark, sf_dir), ["point_id"], "tas", "a", "c").select("point_id", "lat", "month_idx", "a")
    regional = deviations.join(broadcast_if_small(points(spark, sf_dir).select("point_id", "region_id")), "point_id")
    smooth = ts.centred_mean(area_mean(regional, ["region_id", "month_idx"], "a"), ["region_id"], "month_idx", "value", 1, 1, "s")
    return ts.lowpass_removed(smooth.select("region_id", "month_idx", F.col("s").alias("value")), ["region_id"], "value", "index", 30.0, 4, chunk=32)


def local_lines_sql(span: int, passes: int) -> str:
    """One CTE for the windows, then fit, residual and weights of every pass over series ``ser``."""
    tricube = "CASE WHEN r >= 0.999 THEN 0 WHEN r <= 0.001 THEN 1 ELSE pow(1 - r * r * r, 3) END"
    steps = [f"""
num AS (SELECT source_id, month_idx, value, row_number() OVER (PARTITION BY source_id ORDER BY month_idx) - 1 AS i, count(*) OVER (PARTITION BY source_id) AS n FROM ser),
win AS (SELECT *, least(n, {span}) AS s, greatest(0, least(i - (least(n, {span}) - 1) // 2, n - least(n, {span}))) AS l FROM num),
pairs AS (SELECT a.source_id, a.i, b.i AS j, b.value AS y, abs(a.i - b.i)::DOUBLE AS d, max(abs(a.i - b.i)) OVER (PARTITION BY a.source_id, a.i) AS radius
  FROM win a JOIN num b ON a.source_id = b.source_id AND b.i BETWEEN a.l AND a.l + a.s - 1),
tri AS MATERIALIZED (SELECT source_id, i, j, y, {tricube} AS t FROM (SELECT *, d / CASE WHEN radius > 0 THEN radius ELSE 1 END AS r FROM pairs)),
w0 AS (SELECT source_id, i AS j, 1.0::DOUBLE AS robust FROM num)"""]
    for k in range(passes + 1):
        steps.append(f"""
m{k} AS (SELECT source_id, i, sum(t * robust) AS total, sum(t * robust * j) / sum(t * robust) AS mx, sum(t * robust * y) / sum(t * robust) AS my FROM tri JOIN w{k} USING (source_id, j) GROUP BY 1, 2),
v{k} AS (SELECT source_id, i, sum(t * robust * pow(j - mx, 2)) / any_value(total) AS var, sum(t * robust * (j - mx) * y) / any_value(total) AS cov FROM tri JOIN w{k} USING (source_id, j) JOIN m{k} USING (source_id, i) GROUP BY 1, 2),
f{k} AS MATERIALIZED (SELECT num.source_id, num.month_idx, num.i, num.value, CASE WHEN total > 0 THEN my + (i - mx) * CASE WHEN var > 1e-12 THEN cov / var ELSE 0 END ELSE value END AS fit
  FROM num JOIN m{k} USING (source_id, i) JOIN v{k} USING (source_id, i)),
u{k} AS (SELECT source_id, i, CASE WHEN scale > 0 THEN r / scale WHEN r > 0 THEN 1 ELSE 0 END AS u FROM (SELECT *, abs(value - fit) AS r, 6 * median(abs(value - fit)) OVER (PARTITION BY source_id) AS scale FROM f{k})),
w{k + 1} AS MATERIALIZED (SELECT source_id, i AS j, CASE WHEN u >= 0.999 THEN 0 WHEN u <= 0.001 THEN 1 ELSE pow(1 - u * u, 2) END AS robust FROM u{k})""")
    return ",".join(steps)


@query("win_21_loess", "source_id:s month_idx:i smooth:d", f"""
WITH {SERIES_MONTH}, {local_lines_sql(36, 3)} SELECT source_id, month_idx, fit AS smooth FROM f3""")
def win_21(spark, sf_dir):
    """Local regression of the model series with three reweightings."""
    return ts.loess(series_month(spark, sf_dir), ["source_id"], "value", "smooth", period_years=3, chunk=40)


@query("win_23_time_windows", "source_id:s start_year:i end_year:i label:s", f"""
WITH {ENSEMBLE}, s AS (SELECT source_id, greatest(min(year) FILTER (experiment_id = 'F'), min(year) FILTER (experiment_id = 'O') + 1) AS y0,
  least(max(year) FILTER (experiment_id = 'F'), max(year) FILTER (experiment_id = 'O'), 2100) AS y1 FROM ens GROUP BY 1),
m AS (SELECT *, y0 + (y1 - y0) // 2 AS mid FROM s),
w AS (SELECT source_id, y0 AS start_year, least(y1, y0 + 3) AS end_year FROM m UNION ALL SELECT source_id, greatest(y0, mid - 2), least(y1, mid + 1) FROM m
  UNION ALL SELECT source_id, greatest(y0, y1 - 3), y1 FROM m)
SELECT *, start_year || 'to' || end_year AS label FROM w""")
def win_23(spark, sf_dir):
    """Start, middle and end windows of four years on the overlap."""
    e = ensemble_year(spark, sf_dir)
    f, o = F.when(F.col("experiment_id") == "F", F.col("year")), F.when(F.col("experiment_id") == "O", F.col("year"))
    spans = e.groupBy("source_id").agg(F.min(f).alias("a0"), F.max(f).alias("a1"), (F.min(o) + 1).alias("b0"), F.max(o).alias("b1"))
    return ts.time_windows(spans, ["source_id"], years=4)


@query("win_24_common_times", "point_id:i year:i month:i pr:d", f"""
WITH {CELLS}, c AS (SELECT point_id, year, month, pr FROM cells),
f AS (SELECT year, month FROM c GROUP BY 1, 2 HAVING count(DISTINCT point_id) = (SELECT count(DISTINCT point_id) FROM c)) SELECT c.* FROM c SEMI JOIN f USING (year, month)""")
def win_24(spark, sf_dir):
    """Heat-map rows of the months that all series share."""
    return ts.common_times(cells(spark, sf_dir), "point_id", ["year", "month"], "pr")


@query("date_01_month_spine", "point_id:i year:i month:i present:b fyear:d", f"""
WITH {CELLS}, s AS (SELECT point_id, unnest(range(min(month_idx), max(month_idx) + 1)) AS month_idx FROM cells GROUP BY 1)
SELECT s.point_id, s.month_idx // 12 AS year, s.month_idx % 12 + 1 AS month, c.pr IS NOT NULL AS present, s.month_idx / 12 AS fyear
FROM s LEFT JOIN cells c ON s.point_id = c.point_id AND s.month_idx = c.month_idx""")
def date_01(spark, sf_dir):
    """Gap-free months per point with a presence flag."""
    c = cells(spark, sf_dir)
    spine = cal.month_spine(c, ["point_id"])
    return spine.join(c.select("point_id", "month_idx", "pr"), ["point_id", "month_idx"], "left").withColumns(
        {"present": F.col("pr").isNotNull(), "fyear": cal.fractional_year(F.col("year"), F.col("month"))}
    )


@query("date_02_calendar_360", "l_orderkey:i l_linenumber:i year:i month:i day:i", """
SELECT *, CAST(ceil(dayofyear(l_shipdate) / 30) AS BIGINT) AS month, (dayofyear(l_shipdate) - 1) % 30 + 1 AS day FROM (
  SELECT *, year(l_shipdate) AS year, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, year(l_shipdate), ceil(dayofyear(l_shipdate) / 30), (dayofyear(l_shipdate) - 1) % 30 ORDER BY l_shipdate) AS r
  FROM lineitem WHERE dayofyear(l_shipdate) <= 360) WHERE r = 1""")
def date_02(spark, sf_dir):
    """Dates moved to a 360-day calendar."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    return cal.to_360_day(li, "l_shipdate", ["l_orderkey", "l_linenumber"])


@query("date_04_components", "event_id:i year:i month:i day:i months_since:i", """
SELECT *, year(ts) AS year, month(ts) AS month, day(ts) AS day, year(ts) * 12 + month(ts) - 1 - 1995 * 12 AS months_since FROM events""")
def date_04(spark, sf_dir):
    """Date parts and whole months since January 1995."""
    e = cal.month_parts(table(spark, sf_dir, "events"), "ts")
    return e.withColumn("months_since", cal.months_between_idx(F.col("month_idx"), F.lit(1995 * 12)))
