"""Evapotranspiration, water balance and standardised index over grid months."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridseries.functions import pet as P
from gridseries.functions.calendar import days_in_month, midmonth_dayofyear, seconds_in_month
from gridseries.functions.glo import glo_cdf, glo_params, norm_ppf
from gridseries.operators import index as ix
from gridseries.operators.spatial import region_means, region_weights
from gridseries.plans import sqlparts as S
from gridseries.plans.registry import query
from gridseries.plans.views import CELLS, POINTS, REGION_POINT, cells, points

PT = ["point_id"]
PM = ["point_id", "month"]


def balance(spark, sf_dir):
    return cells(spark, sf_dir).withColumn("wb", F.col("pr") - F.col("pet"))


def rolled(spark, sf_dir, k=6):
    return ix.rolling_sum(balance(spark, sf_dir), PT, "wb", k, "acc")


WB = CELLS + ", wb AS (SELECT *, pr - pet AS wb FROM cells)"


def roll_sql(k=6, src="wb", value="wb", series="point_id", name="ro"):
    w = f"OVER (PARTITION BY {series} ORDER BY month_idx RANGE BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
    return f"{name} AS (SELECT *, CASE WHEN count({value}) {w} = {k} THEN sum({value}) {w} END AS acc FROM {src})"


def flagship(spark, sf_dir):
    """Driest regions: balance, 6-month sum, month-wise index, regional mean, ten lowest."""
    idx = ix.glo_index(rolled(spark, sf_dir), PM, "acc", "spei")
    weights = region_weights(points(spark, sf_dir))
    mean = region_means(idx.where("spei IS NOT NULL"), weights, ["year", "month"], "spei", "spei")
    return mean.orderBy(F.round("spei", 9), "region_id", "year", "month").limit(10)


FLAGSHIP_SQL = f"""
WITH {WB}, {roll_sql()}, {S.glo_index("ro", "point_id, month", "acc", "spei")}, {REGION_POINT}
SELECT * FROM (SELECT region_id, year, month, sum(spei * weight) / sum(weight) AS spei
FROM idx JOIN region_point USING (point_id) WHERE spei IS NOT NULL
GROUP BY 1, 2, 3) ORDER BY round(spei, 9), region_id, year, month LIMIT 10"""

query("flagship_driest_regions", "region_id:s year:i month:i spei:d", FLAGSHIP_SQL)(flagship)


@query("win_01_rolling_sum", "point_id:i year:i month:i acc:d",
       f"WITH {WB}, {roll_sql()} SELECT * FROM ro WHERE acc IS NOT NULL")
def win_01(spark, sf_dir):
    """Trailing six-month sums; months without a full window are dropped."""
    return rolled(spark, sf_dir).where("acc IS NOT NULL")


@query("win_05_zscore_monthwise", "point_id:i year:i month:i z:d", f"""
WITH {WB}, {roll_sql()}, m AS (
  SELECT *, avg(acc) FILTER (year <= 1998) OVER w AS mc, stddev_pop(acc) FILTER (year <= 1998) OVER w AS sc,
         avg(acc) OVER w AS ma, stddev_pop(acc) OVER w AS sa FROM ro WINDOW w AS (PARTITION BY point_id, month))
SELECT *, (acc - coalesce(mc, ma)) / (coalesce(sc, sa) + 1e-6) AS z FROM m WHERE acc IS NOT NULL""")
def win_05(spark, sf_dir):
    """Month-wise z-score calibrated on the years to 1998."""
    return ix.zscore_monthwise(rolled(spark, sf_dir), PT, "acc", "z", F.col("year") <= 1998).where("acc IS NOT NULL")


@query("win_06_glo_index", "point_id:i year:i month:i spei:d", f"""
WITH {WB}, {roll_sql(3)}, {S.glo_index("ro", "point_id, month", "acc", "spei", "year <= 2000")}
SELECT * FROM idx WHERE acc IS NOT NULL""")
def win_06(spark, sf_dir):
    """Three-month index with calibration years; short calibrations use all years."""
    return ix.glo_index(rolled(spark, sf_dir, 3), PM, "acc", "spei", F.col("year") <= 2000).where("acc IS NOT NULL")


@query("win_07_shared_fit", "point_id:i year:i month:i spei:d", f"""
WITH {WB}, {roll_sql()}, both_ AS (
  SELECT point_id, year, month, month_idx, acc, false AS target FROM ro
  UNION ALL SELECT point_id, year, month, month_idx, acc - 50, true FROM ro WHERE year >= 1998),
{S.glo_index("both_", "point_id", "acc", "spei", "NOT target AND year BETWEEN 1996 AND 1999")}
SELECT * FROM idx WHERE target AND acc IS NOT NULL""")
def win_07(spark, sf_dir):
    """Factual fit over 1996-1999 applied to a drier target series."""
    base = rolled(spark, sf_dir)
    target = base.where("year >= 1998").withColumn("acc", F.col("acc") - 50)
    keep = ["point_id", "year", "month", "month_idx", "acc"]
    out = ix.shared_index(base.select(*keep), target.select(*keep), PT, "acc", "spei", (1996, 1999))
    return out.where("acc IS NOT NULL")


@query("agg_22_lmoments", "point_id:i month:i n:i lam1:d lam2:d tau3:d", f"""
WITH {WB}, {roll_sql()}, r AS (SELECT point_id, month, acc, row_number() OVER (PARTITION BY point_id, month ORDER BY acc) - 1 AS i,
  count(*) OVER (PARTITION BY point_id, month) AS n FROM ro WHERE acc IS NOT NULL),
b AS (SELECT point_id, month, max(n) AS n, sum(acc / n) AS b0, sum(acc * i / (n * (n - 1))) AS b1,
  sum(acc * i * (i - 1) / (n * (n - 1) * (n - 2))) AS b2 FROM r WHERE n >= 3 GROUP BY 1, 2)
SELECT point_id, month, n, b0 AS lam1, 2 * b1 - b0 AS lam2, CASE WHEN 2 * b1 - b0 <> 0 THEN (6 * b2 - 6 * b1 + b0) / (2 * b1 - b0) END AS tau3 FROM b""")
def agg_22(spark, sf_dir):
    """L-moments of the accumulated balance per point and month."""
    return ix.pwm_table(rolled(spark, sf_dir), PM, "acc")


@query("agg_23_glo_params", "point_id:i n:i xi:d alpha:d kappa:d", f"""
WITH {WB}, r AS (SELECT point_id, wb AS acc, row_number() OVER (PARTITION BY point_id ORDER BY wb) - 1 AS i,
  count(*) OVER (PARTITION BY point_id) AS n FROM wb WHERE wb IS NOT NULL),
b AS (SELECT point_id, max(n) AS n, sum(acc / n) AS b0, sum(acc * i / (n * (n - 1))) AS b1,
  sum(acc * i * (i - 1) / (n * (n - 1) * (n - 2))) AS b2 FROM r WHERE n >= 3 GROUP BY 1)
SELECT point_id, n, {S.PARAMS} FROM ({S.FIT.format(source="SELECT *, b0 AS l1, 2 * b1 - b0 AS l2, 6 * b2 - 6 * b1 + b0 AS l3, true AS enough FROM b")})""")
def agg_23(spark, sf_dir):
    """Distribution parameters of the monthly balance per point."""
    t = ix.pwm_table(balance(spark, sf_dir), PT, "wb")
    return t.withColumns(glo_params(F.col("lam1"), F.col("lam2"), F.col("tau3")))


BASELINE_SQL = f"""r AS (SELECT *, row_number() OVER (PARTITION BY point_id, month ORDER BY wb) - 1 AS i,
  count(*) OVER (PARTITION BY point_id, month) AS n FROM wb WHERE year <= 2000),
b AS (SELECT point_id, month, max(n) AS n, avg(wb) AS mu, stddev_pop(wb) + 1e-6 AS sigma, sum(wb / n) AS b0,
  sum(wb * i / (n * (n - 1))) FILTER (n >= 3) AS b1,
  sum(wb * i * (i - 1) / (n * (n - 1) * (n - 2))) FILTER (n >= 3) AS b2 FROM r GROUP BY 1, 2),
params AS (SELECT point_id, month, n, mu, sigma, {S.PARAMS} FROM ({S.FIT.format(
    source="SELECT *, b0 AS l1, 2 * b1 - b0 AS l2, 6 * b2 - 6 * b1 + b0 AS l3, n >= 5 AND sigma > 1e-6 AS enough FROM b")}))"""


def baseline(spark, sf_dir):
    return ix.fit_baseline(balance(spark, sf_dir).where("year <= 2000"), PM, "wb", min_rows=5)


@query("agg_24_baseline_params", "point_id:i month:i n:i mu:d sigma:d xi:d alpha:d kappa:d",
       f"WITH {WB}, {BASELINE_SQL} SELECT * FROM params")
def agg_24(spark, sf_dir):
    """Baseline parameter table per point and month."""
    return baseline(spark, sf_dir)


@query("agg_24_baseline_params_region", "region_id:s month:i n:i mu:d sigma:d xi:d alpha:d kappa:d", f"""
WITH {CELLS}, {REGION_POINT}, wb AS (SELECT region_id, year, month, sum((pr - pet) * weight) / sum(weight) AS wb
  FROM cells JOIN region_point USING (point_id) GROUP BY 1, 2, 3),
{BASELINE_SQL.replace("point_id", "region_id")} SELECT * FROM params""")
def agg_24_region(spark, sf_dir):
    """Baseline parameters of regional means."""
    mean = region_means(balance(spark, sf_dir), region_weights(points(spark, sf_dir)), ["year", "month"], "wb", "wb")
    return ix.fit_baseline(mean.where("year <= 2000"), ["region_id", "month"], "wb", min_rows=5)


@query("win_07_apply_baseline", "point_id:i year:i month:i spei:d", f"""
WITH {WB}, {BASELINE_SQL}, j AS (SELECT wb.*, mu, sigma, xi, alpha, kappa FROM wb LEFT JOIN params USING (point_id, month)),
q AS (SELECT *, CASE WHEN alpha IS NOT NULL THEN least(greatest({S.glo_cdf("wb", "1e-15")}, 1e-15), 1 - 1e-15) END AS p_ FROM j)
SELECT *, CASE WHEN alpha IS NOT NULL THEN {S.ppf("p_")} ELSE (wb - mu) / sigma END AS spei FROM q""")
def win_07_apply(spark, sf_dir):
    """Stored baseline parameters applied to the whole series (tight clip)."""
    return ix.apply_baseline(balance(spark, sf_dir), baseline(spark, sf_dir), PM, "wb", "spei")


@query("math_01_thornthwaite", "point_id:i year:i month:i pet_th:d", f"WITH {CELLS}, {S.THORNTHWAITE} SELECT * FROM th")
def math_01(spark, sf_dir):
    """Thornthwaite PET."""
    return P.thornthwaite(cells(spark, sf_dir), PT)


@query("math_02_hargreaves", "point_id:i year:i month:i pet_rs:d pet_ra:d", f"""
WITH {CELLS}, d AS (SELECT *, 0.409 * sin(2 * pi() * {S.DOY_MID} / 365 - 1.39) AS de FROM cells),
o AS (SELECT *, acos(least(greatest(-tan(radians(lat)) * tan(de), -1), 1)) AS om FROM d)
SELECT *, {S.HARGREAVES} AS pet_rs,
  greatest(0.0023 * 0.408 * {S.RA_HARG} * (tas - 273.15 + 17.8) * sqrt(greatest(tasmax - tasmin, 0)) * {S.DAYS}, 0) AS pet_ra FROM o""")
def math_02(spark, sf_dir):
    """Modified Hargreaves PET with given radiation and with radiation from latitude."""
    y, m = F.col("year"), F.col("month")
    t = [F.col("tas"), F.col("tasmin"), F.col("tasmax")]
    return cells(spark, sf_dir).withColumns(
        {"pet_rs": P.hargreaves(*t, y, m, rsds=F.col("rsds")), "pet_ra": P.hargreaves(*t, y, m, lat=F.col("lat"))}
    )


@query("math_03_penman_monteith", "point_id:i year:i month:i pet_pm:d", f"WITH {CELLS}, {S.PENMAN} SELECT * FROM pm")
def math_03(spark, sf_dir):
    """FAO-56 Penman-Monteith with wind and humidity."""
    return P.with_pet(cells(spark, sf_dir), PT, "penman-monteith", "pet_pm")


@query("win_08_heat_storage", "point_id:i year:i month:i g:d", f"WITH {CELLS}, {S.PENMAN} SELECT * FROM pm")
def win_08(spark, sf_dir):
    """Ground heat flux term."""
    return P.heat_storage(cells(spark, sf_dir), PT, (F.col("tasmin") + F.col("tasmax")) / 2 - P.KELVIN, "g")


@query("math_06_pet_auto", "point_id:i year:i month:i method:s pet_auto:d", f"""
WITH {CELLS}, {S.PENMAN} SELECT *, 'penman-monteith' AS method, pet_pm AS pet_auto FROM pm""")
def math_06(spark, sf_dir):
    """Method choice by available variables."""
    c = cells(spark, sf_dir)
    return P.with_pet(c, PT, "auto", "pet_auto").withColumn("method", F.lit(P.resolve_method(c.columns, "auto")))


@query("math_04_glo_cdf", "point_id:i month:i year:i p:d", f"""
WITH {WB}, {BASELINE_SQL} SELECT *, {S.glo_cdf("wb")} AS p FROM wb JOIN params USING (point_id, month) WHERE alpha IS NOT NULL""")
def math_04(spark, sf_dir):
    """Distribution function values."""
    joined = balance(spark, sf_dir).join(baseline(spark, sf_dir), PM).where("alpha IS NOT NULL")
    return joined.withColumn("p", glo_cdf(F.col("wb"), F.col("xi"), F.col("alpha"), F.col("kappa")))


@query("math_05_norm_ppf", "l_orderkey:i l_linenumber:i p:d x:d", f"""
SELECT *, {S.ppf("p")} AS x FROM (SELECT *, ((l_orderkey * 7 + l_linenumber) % 9973 + 0.5) / 9973 AS p FROM lineitem)""")
def math_05(spark, sf_dir):
    """Normal quantile over all three branches."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    p = ((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 9973 + 0.5) / 9973
    return li.withColumn("p", p).withColumn("x", norm_ppf(F.col("p")))


@query("math_08_dryness_class", "region_id:s year:i month:i class:s", f"""
WITH {WB}, {roll_sql()}, {S.glo_index("ro", "point_id, month", "acc", "spei")}, {REGION_POINT}, a AS (
SELECT region_id, year, month, round(sum(spei * weight) / sum(weight), 6) AS v FROM idx JOIN region_point USING (point_id) WHERE spei IS NOT NULL GROUP BY 1, 2, 3)
SELECT *, CASE WHEN v >= -4 AND v < -2.33 THEN 'extremely dry' WHEN v >= -2.33 AND v < -1.65 THEN 'severely dry'
  WHEN v >= -1.65 AND v < -1.28 THEN 'moderately dry' WHEN v >= -1.28 AND v < -0.84 THEN 'mildly dry' WHEN v >= -0.84 AND v < 0 THEN 'near-normal' END AS class FROM a""")
def math_08(spark, sf_dir):
    """Dryness bands of the regional index."""
    idx = ix.glo_index(rolled(spark, sf_dir), PM, "acc", "spei")
    mean = region_means(idx.where("spei IS NOT NULL"), region_weights(points(spark, sf_dir)), ["year", "month"], "spei", "v")
    return mean.withColumn("class", P.dryness_class(F.round("v", 6)))


@query("prj_01_precipitation_mm", "point_id:i year:i month:i mm:d", f"""
WITH {CELLS}, u AS (SELECT *, ['kg m-2 s-1', 'mm/day', 'm', '', 'mm'][point_id % 5 + 1] AS units,
  CASE point_id % 5 WHEN 0 THEN pr / 2592000 WHEN 1 THEN pr / 30 WHEN 2 THEN pr / 1000 WHEN 3 THEN pr / 2592000 ELSE pr END AS flux FROM cells),
md AS (SELECT *, quantile_cont(flux, 0.5) OVER (PARTITION BY point_id) AS med FROM u)
SELECT *, CASE units WHEN 'kg m-2 s-1' THEN flux * {S.DAYS} * 86400 WHEN 'mm/day' THEN flux * {S.DAYS} WHEN 'm' THEN flux * 1000
  WHEN '' THEN CASE WHEN abs(med) < 1e-2 THEN flux * {S.DAYS} * 86400 ELSE flux END ELSE flux END AS mm FROM md""")
def prj_01(spark, sf_dir):
    """Precipitation totals from five unit conventions, one of them unlabelled."""
    p = F.col("point_id") % 5
    units = F.element_at(F.array(*[F.lit(u) for u in ("kg m-2 s-1", "mm/day", "m", "", "mm")]), (p + 1).cast("int"))
    flux = F.when(p.isin(0, 3), F.col("pr") / 2592000).when(p == 1, F.col("pr") / 30).when(p == 2, F.col("pr") / 1000).otherwise(F.col("pr"))
    src = cells(spark, sf_dir).withColumns({"units": units, "flux": flux})
    # The median runs over the months of one series.
    med = src.groupBy("point_id").agg(F.percentile("flux", 0.5).alias("med"))
    mm = P.precipitation_mm(F.col("flux"), F.col("units"), F.col("year"), F.col("month"), F.col("med"))
    return src.join(med, "point_id").withColumn("mm", mm)


@query("prj_02_humidity_pressure", "point_id:i year:i month:i rh:d kpa:d", f"""
WITH {CELLS}, f AS (SELECT *, CASE WHEN point_id % 2 = 0 THEN hurs / 100 ELSE hurs END AS h,
  CASE point_id % 3 WHEN 0 THEN 101300 + pr WHEN 1 THEN 1013 + pr / 100 ELSE 101.3 + pr / 1000 END AS p FROM cells),
g AS (SELECT *, first_value(h) OVER w AS h0, first_value(p) OVER w AS p0 FROM f WINDOW w AS (PARTITION BY point_id ORDER BY month_idx))
SELECT *, CASE WHEN h0 <= 1.2 THEN h * 100 ELSE h END AS rh, CASE WHEN p0 > 2000 THEN p / 1000 WHEN p0 > 200 THEN p / 10 ELSE p END AS kpa FROM g""")
def prj_02(spark, sf_dir):
    """Humidity to percent and pressure to kPa from the first value of a series."""
    from pyspark.sql import Window

    p = F.col("point_id")
    src = cells(spark, sf_dir).withColumns({
        "h": F.when(p % 2 == 0, F.col("hurs") / 100).otherwise(F.col("hurs")),
        "p": F.when(p % 3 == 0, 101300 + F.col("pr")).when(p % 3 == 1, 1013 + F.col("pr") / 100).otherwise(101.3 + F.col("pr") / 1000),
    })
    w = Window.partitionBy("point_id").orderBy("month_idx")
    src = src.withColumns({"h0": F.first("h").over(w), "p0": F.first("p").over(w)})
    blank = F.lit("")
    return src.withColumns({"rh": P.humidity_percent(F.col("h"), blank, F.col("h0")), "kpa": P.pressure_kpa(F.col("p"), blank, F.col("p0"))})


@query("date_03_midmonth_doy", "point_id:i year:i month:i doy:d secs:d dim:i", f"""
WITH {CELLS} SELECT *, {S.DOY_MID} AS doy, {S.DAYS} * 86400.0 AS secs, {S.DAYS} AS dim FROM cells""")
def date_03(spark, sf_dir):
    """Mid-month day of year, days and seconds of the month."""
    y, m = F.col("year"), F.col("month")
    return cells(spark, sf_dir).withColumns(
        {"doy": midmonth_dayofyear(y, m), "secs": seconds_in_month(y, m), "dim": days_in_month(y, m)}
    )
