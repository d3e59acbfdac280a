"""Registry of named queries.

A query declares its output as ``"name:kind"`` words (i bigint, d double, s
string, b boolean). Both the Spark result and the checking SQL are projected to
exactly those columns; doubles are rounded to six digits because sums of doubles
depend on the order of addition. The rounding limit is moved off the short
decimals (``NUDGE``) so that such noise cannot flip exact halves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

NUDGE = 3.7e-8
_SPARK = {"i": "bigint", "s": "string", "b": "boolean"}
_DUCK = {"i": "BIGINT", "s": "VARCHAR", "b": "BOOLEAN"}


def _columns(spec: str) -> list[tuple[str, str]]:
    return [tuple(word.rsplit(":", 1)) for word in spec.split()]


def _project(df: DataFrame, spec: str) -> DataFrame:
    out = []
    for name, kind in _columns(spec):
        c = F.col(name)
        out.append((F.round(c.cast("double") + NUDGE, 6) if kind == "d" else c.cast(_SPARK[kind])).alias(name))
    return df.select(*out)


def _wrap(sql: str, spec: str) -> str:
    out = []
    for name, kind in _columns(spec):
        if kind == "d":
            out.append(f"round(CAST({name} AS DOUBLE) + {NUDGE}, 6) + 0.0 AS {name}")
        else:
            out.append(f"CAST({name} AS {_DUCK[kind]}) AS {name}")
    return f"SELECT {', '.join(out)} FROM (\n{sql.strip()}\n) AS checked"


def query(name: str, columns: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return _project(fn(spark, sf_dir), columns)

        run.__name__ = name
        run.__doc__ = fn.__doc__
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = _wrap(sql, columns)
        return fn

    return register
