"""One rule for missing values: NaN and infinity are null before any aggregate.

Spark's ``avg`` and ``percentile`` return NaN once a single NaN is in the group,
so every scan and every division goes through :func:`finite`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_finite(c: Column) -> Column:
    """True for numbers that are neither null, NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def finite(c: Column) -> Column:
    return F.when(is_finite(c), c)


def to_number(c: Column) -> Column:
    """Text to double; anything that is not a finite number is null."""
    return finite(c.try_cast("double"))


def clean_numbers(df: DataFrame) -> DataFrame:
    """Apply :func:`finite` to every floating column."""
    floating = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*[finite(F.col(c)).alias(c) if c in floating else F.col(c) for c in df.columns])


def ratio(num: Column, den: Column) -> Column:
    """num/den, null where the denominator is zero or null."""
    return F.when(den != 0, num / den)


def with_settled(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Like ``withColumns``, but filters on the new columns stay above them.

    Catalyst pushes a filter below a projection by copying the expressions into
    the predicate; for deeply nested formulas the copies multiply. A one-row
    generator keeps the values settled and stays inside code generation.
    """
    fields = F.struct(*[c.alias(name) for name, c in columns.items()])
    kept = [F.col(c) for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(fields)))
