"""Month arithmetic on integer keys.

``month_idx = year*12 + month - 1`` is the time axis everywhere. Dates are built
only for real days-in-month and day-of-year; ``days`` may be fixed at 30 for
sources in a 360-day calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def month_index(year: Column, month: Column) -> Column:
    return (year * 12 + month - 1).cast("int")


def year_of(idx: Column) -> Column:
    return F.floor(idx / 12).cast("int")


def month_of(idx: Column) -> Column:
    return (F.pmod(idx, F.lit(12)) + 1).cast("int")


def first_day(year: Column, month: Column) -> Column:
    return F.make_date(year, month, F.lit(1))


def days_in_month(year: Column, month: Column, calendar: str = "standard") -> Column:
    if calendar == "360_day":
        return F.lit(30)
    return F.dayofmonth(F.last_day(first_day(year, month)))


def seconds_in_month(year: Column, month: Column, calendar: str = "standard") -> Column:
    return days_in_month(year, month, calendar) * F.lit(86400.0)


def midmonth_dayofyear(year: Column, month: Column) -> Column:
    """Day of year of the first of the month plus half the month (half-even)."""
    half = F.bround(days_in_month(year, month) / 2.0 - 1.0)
    return (F.dayofyear(first_day(year, month)) + half).cast("double")


def fractional_year(year: Column, month: Column) -> Column:
    return year + (month - 1) / F.lit(12.0)


def month_start(ts: Column) -> Column:
    return F.trunc(ts.cast("date"), "MM")


def month_parts(df: DataFrame, ts: str) -> DataFrame:
    """Add year, month, day and month_idx of a timestamp column."""
    c = F.col(ts)
    return df.withColumns(
        {"year": F.year(c), "month": F.month(c), "day": F.dayofmonth(c), "month_idx": month_index(F.year(c), F.month(c))}
    )


def months_between_idx(a: Column, b: Column) -> Column:
    """Whole months from b to a."""
    return a - b


def to_360_day(df: DataFrame, ts: str, keys: list[str]) -> DataFrame:
    """Daily rows on a 360-day calendar: 30-day months by day of year.

    Day 361 and later are dropped and the first row of a repeated
    (keys, year, month, day) is kept.
    """
    doy = F.dayofyear(ts)
    out = df.where(doy <= 360).withColumns(
        {
            "year": F.year(ts),
            "month": F.ceil(doy / 30.0).cast("int"),
            "day": (F.pmod(doy - 1, F.lit(30)) + 1).cast("int"),
        }
    )
    return out.groupBy(*keys, "year", "month", "day").agg(
        *[F.min_by(c, ts).alias(c) for c in df.columns if c not in keys]
    )


def month_spine(df: DataFrame, keys: list[str], idx: str = "month_idx", lo: int | None = None, hi: int | None = None) -> DataFrame:
    """Gap-free month rows per key from its first to its last month (or lo..hi)."""
    ends = df.groupBy(*keys).agg(F.min(idx).alias("_lo"), F.max(idx).alias("_hi"))
    start = F.col("_lo") if lo is None else F.lit(lo)
    stop = F.col("_hi") if hi is None else F.lit(hi)
    spine = ends.select(*keys, F.explode(F.sequence(start, stop)).alias(idx))
    return spine.withColumns({"year": year_of(F.col(idx)), "month": month_of(F.col(idx))})
