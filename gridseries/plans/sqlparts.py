"""SQL text for the checks: the same formulas, written for DuckDB."""

from __future__ import annotations

from gridseries.functions.glo import PPF_A, PPF_B, PPF_C, PPF_D, PPF_LOW


def _horner(coeffs, x: str) -> str:
    text = repr(coeffs[0]) + "::DOUBLE"
    for c in coeffs[1:]:
        text = f"({text} * {x} + ({c!r})::DOUBLE)"
    return text


def ppf(p: str) -> str:
    def tail(q: str) -> str:
        return f"({_horner(PPF_C, q)} / {_horner([*PPF_D, 1.0], q)})"

    lo, hi = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))"
    r = f"(({p} - 0.5) * ({p} - 0.5))"
    mid = f"({_horner(PPF_A, r)} * ({p} - 0.5) / {_horner([*PPF_B, 1.0], r)})"
    return f"CASE WHEN {p} < {PPF_LOW} THEN {tail(lo)} WHEN {p} > {1 - PPF_LOW} THEN -{tail(hi)} ELSE {mid} END"


def sigmoid(z: str) -> str:
    return f"CASE WHEN {z} >= 0 THEN 1 / (1 + exp(-{z})) ELSE exp({z}) / (1 + exp({z})) END"


def glo_cdf(x: str, support: str = "0") -> str:
    y = f"(({x} - xi) / alpha)"
    return (
        f"CASE WHEN abs(kappa) < 1e-12 THEN {sigmoid(y)} "
        f"WHEN 1 - kappa * {y} > {support} THEN {sigmoid(f'(-ln(1 - kappa * {y}) / kappa)')} "
        "WHEN kappa < 0 THEN 0.0 ELSE 1.0 END"
    )


PARAMS = """
  CASE WHEN ok THEN CASE WHEN abs(-t3) < 1e-6 THEN l1 ELSE l1 - a0 * (1 / (-t3) - pi() / sin(pi() * (-t3))) END END AS xi,
  CASE WHEN ok THEN a0 END AS alpha,
  CASE WHEN ok THEN CASE WHEN abs(-t3) < 1e-6 THEN 0 ELSE -t3 END END AS kappa"""

FIT = """
  SELECT *, coalesce(l2 > 0 AND abs(t3) < 1 AND a0 > 0 AND enough, false) AS ok FROM (
  SELECT *, CASE WHEN abs(t3) < 1e-6 THEN l2 ELSE l2 * sin(pi() * (-t3)) / (pi() * (-t3)) END AS a0 FROM (
  SELECT *, CASE WHEN l2 > 0 THEN l3 / l2 END AS t3 FROM ({source})))"""


def glo_index(src: str, group: str, value: str, out: str, cal: str = "true", clip: str = "1e-6", name: str = "idx") -> str:
    """CTE chain that adds ``out`` to the rows of ``src``."""
    return f"""
{name}_a AS (SELECT *, coalesce({value} IS NOT NULL AND ({cal}), false) AS cal_ FROM {src}),
{name}_b AS (SELECT *, count(*) FILTER (cal_) OVER (PARTITION BY {group}) AS ncal FROM {name}_a),
{name}_c AS (SELECT *, CASE WHEN ncal >= 10 THEN cal_ ELSE {value} IS NOT NULL END AS fit_ FROM {name}_b),
{name}_d AS (SELECT *, row_number() OVER (PARTITION BY {group}, fit_ ORDER BY {value}) - 1 AS r_,
             count(*) FILTER (fit_) OVER (PARTITION BY {group}) AS n_ FROM {name}_c),
{name}_e AS (
  SELECT *, avg({value}) OVER (PARTITION BY {group}) AS mu_, stddev_pop({value}) OVER (PARTITION BY {group}) + 1e-6 AS sd_,
         sum({value} / n_) FILTER (fit_) OVER (PARTITION BY {group}) AS b0,
         sum({value} * r_ / (n_ * (n_ - 1))) FILTER (fit_ AND n_ >= 3) OVER (PARTITION BY {group}) AS b1,
         sum({value} * r_ * (r_ - 1) / (n_ * (n_ - 1) * (n_ - 2))) FILTER (fit_ AND n_ >= 3) OVER (PARTITION BY {group}) AS b2
  FROM {name}_d),
{name}_f AS (SELECT *, {PARAMS} FROM ({FIT.format(source=f"SELECT *, b0 AS l1, 2 * b1 - b0 AS l2, 6 * b2 - 6 * b1 + b0 AS l3, n_ >= 3 AS enough FROM {name}_e")})),
{name}_g AS (SELECT *, CASE WHEN alpha IS NOT NULL THEN least(greatest({glo_cdf(value)}, {clip}), 1 - {clip}) END AS p_ FROM {name}_f),
{name} AS (SELECT *, CASE WHEN {value} IS NULL THEN NULL WHEN alpha IS NOT NULL THEN {ppf("p_")} ELSE ({value} - mu_) / sd_ END AS {out} FROM {name}_g)"""


DAYS = "day(last_day(make_date(CAST(year AS INT), CAST(month AS INT), 1)))"
DOY_MID = f"(dayofyear(make_date(CAST(year AS INT), CAST(month AS INT), 1)) + round_even({DAYS} / 2.0 - 1, 0))"
THORNTHWAITE = """
th_a AS (SELECT *, greatest(avg(tas - 273.15) OVER (PARTITION BY point_id, month), 0) AS clim,
         row_number() OVER (PARTITION BY point_id, month ORDER BY month_idx) AS rn FROM cells),
th_b AS (SELECT *, sum(CASE WHEN rn = 1 THEN pow(clim / 5, 1.514) END) OVER (PARTITION BY point_id) AS h0 FROM th_a),
th_c AS (SELECT *, CASE WHEN h0 <= 0 THEN 1 ELSE h0 END AS h FROM th_b),
th AS (SELECT *, 16 * pow(10 * greatest(tas - 273.15, 0) / h,
         6.75e-7 * pow(h, 3) - 7.71e-5 * h * h + 1.792e-2 * h + 0.49239) AS pet_th FROM th_c)"""

HARGREAVES = f"greatest(0.0023 * 0.408 * rsds * 86400 / 1e6 * (tas - 273.15 + 17.8) * sqrt(greatest(tasmax - tasmin, 0)) * {DAYS}, 0)"
RA_HARG = (
    f"(24 * 60 / pi() * 0.0820 * (1 + 0.033 * cos(2 * pi() * {DOY_MID} / 365)) * "
    "(om * sin(radians(lat)) * sin(de) + cos(radians(lat)) * cos(de) * sin(om)))"
)

PENMAN = f"""
pm_a AS (SELECT *, tasmin - 273.15 AS tn, tasmax - 273.15 AS tx, (tasmin + tasmax) / 2 - 273.15 AS tm, {DOY_MID} AS jd,
         {DAYS} AS dm, rsds * 86400 / 1e6 AS rs, lat / 57.2957795 AS phi FROM cells),
pm_b AS (SELECT *, max(tm) OVER (PARTITION BY point_id ORDER BY month_idx RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS t0, max(tm) OVER (PARTITION BY point_id ORDER BY month_idx RANGE BETWEEN 1 FOLLOWING AND 1 FOLLOWING) AS t1, row_number() OVER w AS rn, count(*) OVER (PARTITION BY point_id) AS nn,
         0.611 * exp(17.27 * tx / (tx + 237.3)) AS ex, 0.611 * exp(17.27 * tn / (tn + 237.3)) AS en,
         4099 * 0.611 * exp(17.27 * tm / (tm + 237.3)) / pow(tm + 237.3, 2) AS slope,
         0.409 * sin(0.0172 * jd - 1.39) AS de, 1 + 0.033 * cos(0.0172 * jd) AS dr
         FROM pm_a WINDOW w AS (PARTITION BY point_id ORDER BY month_idx)),
pm_c AS (SELECT *, CASE WHEN nn < 2 THEN 0 WHEN rn = 1 THEN 0.14 * (t1 - tm) WHEN rn = nn THEN 0.14 * (tm - t0) ELSE 0.07 * (t1 - t0) END AS g,
         (ex + en) / 2 AS ea, -tan(phi) * tan(de) AS ss FROM pm_b),
pm_d AS (SELECT *, ea * hurs / 100 AS ed, CASE WHEN ss < -1 THEN pi() WHEN ss > 1 THEN 0 ELSE acos(ss) END AS om FROM pm_c),
pm_e AS (SELECT *, greatest(37.6 * dr * (om * sin(phi) * sin(de) + cos(phi) * cos(de) * sin(om)), 0) AS ra FROM pm_d),
pm_f AS (SELECT *, CASE WHEN (0.75 + 2e-5 * 840) * ra <= 0 THEN 1e-6 ELSE (0.75 + 2e-5 * 840) * ra END AS cl, 0.665e-3 * 101.3 AS gam FROM pm_e),
pm_g AS (SELECT *, CASE WHEN rs = 0 THEN 0 ELSE (1 - 0.23) * rs - (1.35 * rs / cl - 0.35) * (0.34 - 0.14 * sqrt(ed)) *
         4.9e-9 * (pow(273.15 + tx, 4) + pow(273.15 + tn, 4)) / 2 END AS rn_net FROM pm_f),
pm AS (SELECT *, greatest((0.408 * slope * (rn_net - g) + gam * (900 / (tm + 273)) * "sfcWind" * (ea - ed)) / (slope + gam * (1 + 0.34 * "sfcWind")), 0) * dm AS pet_pm FROM pm_g)"""


def hash32(text: str) -> str:
    return f"('0x' || substr(sha256({text}), 1, 8))::BIGINT"
