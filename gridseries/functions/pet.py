"""Potential evapotranspiration (mm/month) and unit conversions as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridseries.functions.calendar import days_in_month, midmonth_dayofyear, seconds_in_month

KELVIN = 273.15

# Fixed values of the FAO-56 formulation
DEFAULT_PRESSURE_KPA = 101.3
DEFAULT_WIND_M_S = 2.0
DEFAULT_ELEVATION_M = 840.0
ALBEDO = 0.23
CROPS = {"short": (900.0, 0.34), "tall": (1600.0, 0.38)}


def precipitation_mm(pr: Column, units: Column, year: Column, month: Column, median: Column | None = None) -> Column:
    """Monthly precipitation total in mm by units text.

    Blank units are taken as a flux when the median of the field is below 0.01;
    every other text is taken as millimetres already.
    """
    text = F.trim(F.lower(F.coalesce(units, F.lit(""))))
    packed = F.replace(text, F.lit(" "), F.lit(""))
    flux = packed.contains("kg") & packed.contains("m-2") & packed.contains("s-1")
    per_day = text.contains("mm/day") | packed.contains("mmd-1") | packed.contains("mmd^-1")
    metres = packed.isin("m", "meter", "metre") | text.endswith(" m")
    sec = seconds_in_month(year, month)
    small = F.lit(False) if median is None else (F.abs(median) < 1e-2)
    return (
        F.when(flux, pr * sec)
        .when(per_day, pr * days_in_month(year, month))
        .when(metres, pr * 1000.0)
        .when((packed == "") & F.coalesce(small, F.lit(False)), pr * sec)
        .otherwise(pr)
    )


def humidity_percent(rh: Column, units: Column, first: Column) -> Column:
    """Percent; unlabelled fields whose first value is at most 1.2 are fractions."""
    text = F.lower(F.coalesce(units, F.lit("")))
    labelled = text.contains("percent") | (F.trim(text) == "%")
    return F.when(~labelled & (first <= 1.2), rh * 100.0).otherwise(rh)


def pressure_kpa(p: Column, units: Column, first: Column) -> Column:
    """kPa by units text, or by the size of the first value where unlabelled."""
    text = F.lower(F.trim(F.coalesce(units, F.lit(""))))
    return (
        F.when(text.contains("kpa"), p)
        .when(text.contains("hpa") | text.contains("mbar"), p / 10.0)
        .when(text.contains("pa"), p / 1000.0)
        .when(first > 2000.0, p / 1000.0)
        .when(first > 200.0, p / 10.0)
        .otherwise(p)
    )


def thornthwaite(df: DataFrame, point: list[str], tas: str = "tas", out: str = "pet_th") -> DataFrame:
    """Thornthwaite PET from temperature (K) alone.

    The heat index uses the month climatology over the whole series given. The
    climatology is one row per (point, month), so the heat index is a second
    aggregation of at most twelve rows per point.
    """
    celsius = F.col(tas) - KELVIN
    by_month = Window.partitionBy(*point, "month")
    rank_in_month = F.row_number().over(by_month.orderBy("month_idx"))
    clim = F.greatest(F.avg(celsius).over(by_month), F.lit(0.0))
    once = F.when(F.col("_rn") == 1, F.pow(F.col("_clim") / 5.0, F.lit(1.514)))
    heat = F.sum(once).over(Window.partitionBy(*point))
    staged = df.withColumns({"_clim": clim, "_rn": rank_in_month}).withColumn("_h", heat)
    h = F.when(F.col("_h") <= 0, 1.0).otherwise(F.col("_h"))
    expo = F.lit(6.75e-7) * F.pow(h, F.lit(3.0)) - F.lit(7.71e-5) * h * h + F.lit(1.792e-2) * h + F.lit(0.49239)
    warm = F.greatest(celsius, F.lit(0.0))
    return staged.withColumn(out, 16.0 * F.pow(10.0 * warm / h, expo)).drop("_clim", "_rn", "_h")


def extraterrestrial_radiation(lat_deg: Column, day: Column) -> Column:
    """Ra in MJ m-2 day-1 (Hargreaves form, solar constant 0.0820)."""
    phi = F.radians(lat_deg)
    angle = F.lit(2.0 * math.pi) * (day / 365.0)
    dr = 1.0 + 0.033 * F.cos(angle)
    dec = 0.409 * F.sin(angle - 1.39)
    sunset = F.acos(F.least(F.greatest(-F.tan(phi) * F.tan(dec), F.lit(-1.0)), F.lit(1.0)))
    return F.lit(24.0 * 60.0 / math.pi * 0.0820) * dr * (
        sunset * F.sin(phi) * F.sin(dec) + F.cos(phi) * F.cos(dec) * F.sin(sunset)
    )


def hargreaves(
    tas: Column, tasmin: Column, tasmax: Column, year: Column, month: Column,
    rsds: Column | None = None, lat: Column | None = None, day: Column | None = None,
) -> Column:
    """Modified Hargreaves PET; radiation from rsds, else from latitude."""
    if rsds is not None:
        radiation = rsds * 86400.0 / 1e6
    elif lat is not None:
        radiation = extraterrestrial_radiation(lat, day if day is not None else midmonth_dayofyear(year, month))
    else:
        raise ValueError("hargreaves needs rsds or latitude")
    spread = F.greatest(tasmax - tasmin, F.lit(0.0))
    daily = 0.0023 * 0.408 * radiation * (tas - KELVIN + 17.8) * F.sqrt(spread)
    return F.greatest(daily * days_in_month(year, month), F.lit(0.0))


def saturation_kpa(celsius: Column) -> Column:
    return 0.611 * F.exp(17.27 * celsius / (celsius + 237.3))


def heat_storage(df: DataFrame, series: list[str], mean_c: Column, out: str = "heat") -> DataFrame:
    """Ground heat flux: centred temperature difference, one-sided at the ends; null beside a missing month."""
    w = Window.partitionBy(*series).orderBy("month_idx")
    staged = df.withColumn("_t", mean_c)
    before, after = F.max("_t").over(w.rangeBetween(-1, -1)), F.max("_t").over(w.rangeBetween(1, 1))
    first = F.row_number().over(w) == 1
    alone = F.count(F.lit(1)).over(Window.partitionBy(*series)) < 2
    last = F.row_number().over(w) == F.count(F.lit(1)).over(Window.partitionBy(*series))
    g = (
        F.when(alone, 0.0)
        .when(first, 0.14 * (after - F.col("_t")))
        .when(last, 0.14 * (F.col("_t") - before))
        .otherwise(0.07 * (after - before))
    )
    return staged.withColumn(out, g).drop("_t")


def penman_monteith(
    df: DataFrame, heat: Column, out: str, wind: Column | None = None, humidity_pct: Column | None = None,
    pressure: Column | None = None, crop: str = "short",
) -> DataFrame:
    """Add FAO-56 Penman-Monteith reference evapotranspiration.

    Needs tasmin, tasmax (K), rsds (W m-2), lat, year and month. Without humidity
    the dew point is taken from Tmin, without pressure sea level, without wind
    2 m/s. ``heat`` is the :func:`heat_storage` column. Terms used several times
    are columns of their own, so that no formula is copied.
    """
    c = F.col
    keep = df.columns
    base = df.withColumns({
        "_tn": c("tasmin") - KELVIN, "_tx": c("tasmax") - KELVIN, "_tm": (c("tasmin") + c("tasmax")) / 2.0 - KELVIN,
        "_day": midmonth_dayofyear(c("year"), c("month")), "_phi": c("lat") / 57.2957795, "_rs": c("rsds") * 86400.0 / 1e6,
        "_g": heat, "_u": wind if wind is not None else F.lit(DEFAULT_WIND_M_S),
        "_gamma": 0.665e-3 * (pressure if pressure is not None else F.lit(DEFAULT_PRESSURE_KPA)),
    })
    sun = base.withColumns({
        "_dec": 0.409 * F.sin(0.0172 * c("_day") - 1.39), "_dr": 1.0 + 0.033 * F.cos(0.0172 * c("_day")),
        "_emin": saturation_kpa(c("_tn")), "_emax": saturation_kpa(c("_tx")),
        "_slope": 4099.0 * saturation_kpa(c("_tm")) / F.pow(c("_tm") + 237.3, F.lit(2.0)),
    })
    sun = sun.withColumns({"_x": -F.tan(c("_phi")) * F.tan(c("_dec")), "_esat": (c("_emax") + c("_emin")) / 2.0})
    sunset = F.when(c("_x") < -1.0, F.lit(math.pi)).when(c("_x") > 1.0, F.lit(0.0)).otherwise(F.acos(c("_x")))
    eact = c("_esat") * (humidity_pct / 100.0) if humidity_pct is not None else c("_emin")
    sun = sun.withColumns({"_om": sunset, "_eact": eact})
    ra = 37.6 * c("_dr") * (c("_om") * F.sin("_phi") * F.sin("_dec") + F.cos("_phi") * F.cos("_dec") * F.sin("_om"))
    clear = (0.75 + 2e-5 * DEFAULT_ELEVATION_M) * F.greatest(ra, F.lit(0.0))
    sun = sun.withColumn("_clear", clear).withColumn("_clear", F.when(c("_clear") <= 0, F.lit(1e-6)).otherwise(c("_clear")))
    black = 4.9e-9 * (F.pow(KELVIN + c("_tx"), F.lit(4.0)) + F.pow(KELVIN + c("_tn"), F.lit(4.0))) / 2.0
    longwave = (1.35 * c("_rs") / c("_clear") - 0.35) * (0.34 - 0.14 * F.sqrt("_eact")) * black
    net = F.when(c("_rs") == 0, F.lit(0.0)).otherwise((1.0 - ALBEDO) * c("_rs") - longwave)
    c1, c2 = CROPS[crop]
    dry = c("_gamma") * (c1 / (c("_tm") + 273.0)) * c("_u") * (c("_esat") - c("_eact"))
    eto = (0.408 * c("_slope") * (c("_net") - c("_g")) + dry) / (c("_slope") + c("_gamma") * (1.0 + c2 * c("_u")))
    total = F.greatest(eto, F.lit(0.0)) * days_in_month(c("year"), c("month"))
    return sun.withColumn("_net", net).withColumn(out, total).select(*[k for k in keep if k != out], out)


def resolve_method(columns, requested: str | None = None) -> str:
    """Penman-Monteith over Hargreaves over Thornthwaite by available columns."""
    aliases = {"penman": "penman-monteith", "pm": "penman-monteith", "penman_monteith": "penman-monteith"}
    if requested:
        name = aliases.get(requested.lower(), requested.lower())
        if name in ("penman-monteith", "hargreaves", "thornthwaite"):
            return name
        if name != "auto":
            raise ValueError(f"unknown PET method {requested!r}")
    have = set(columns)
    if {"tasmin", "tasmax", "rsds", "sfcWind", "lat"} <= have:
        return "penman-monteith"
    return "hargreaves" if {"tas", "tasmin", "tasmax"} <= have else "thornthwaite"


def with_pet(df: DataFrame, series: list[str], requested: str | None = None, out: str = "pet") -> DataFrame:
    """Add PET to grid months by the resolved method.

    ``series`` are the columns of one gap-free monthly series (point, or member
    and point).
    """
    method = resolve_method(df.columns, requested)
    y, m = F.col("year"), F.col("month")
    if method == "thornthwaite":
        return thornthwaite(df, series, out=out)
    if method == "hargreaves":
        rs = F.col("rsds") if "rsds" in df.columns else None
        lat = F.col("lat") if rs is None else None
        return df.withColumn(out, hargreaves(F.col("tas"), F.col("tasmin"), F.col("tasmax"), y, m, rsds=rs, lat=lat))
    have = set(df.columns)
    staged = heat_storage(df, series, (F.col("tasmin") + F.col("tasmax")) / 2.0 - KELVIN, "_heat")
    added = penman_monteith(
        staged, F.col("_heat"), out, wind=F.col("sfcWind") if "sfcWind" in have else None,
        humidity_pct=F.col("hurs") if "hurs" in have else None, pressure=F.col("psl") / 1000.0 if "psl" in have else None,
    )
    return added.drop("_heat")


# Dryness bands of the index (lower limit, upper limit, label)
DRYNESS_BANDS = [
    (-4.00, -2.33, "extremely dry"),
    (-2.33, -1.65, "severely dry"),
    (-1.65, -1.28, "moderately dry"),
    (-1.28, -0.84, "mildly dry"),
    (-0.84, 0.00, "near-normal"),
]


def dryness_class(spei: Column) -> Column:
    """Label of the half-open band [lower, upper) an index value falls in, else null."""
    out = F.lit(None).cast("string")
    for lower, upper, label in reversed(DRYNESS_BANDS):
        out = F.when((spei >= lower) & (spei < upper), F.lit(label)).otherwise(out)
    return out
