"""Scans of the table forms the engine reads."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridseries.functions.missing import to_number

# Accepted names of the long forcing table, first match wins
LONG_NAMES = {
    "year": ["year", "time"],
    "value": ["value", "val"],
    "variable": ["variable", "var"],
    "region": ["region", "area"],
    "scenario": ["scenario", "scenario (name)"],
    "model": ["model", "model (name)"],
    "unit": ["unit", "units"],
    "run_id": ["run_id", "run"],
}


def year_columns(columns) -> dict[int, str]:
    """Year -> column name, first occurrence wins."""
    found: dict[int, str] = {}
    for c in columns:
        m = re.fullmatch(r"\s*(\d{4})(?:\.0+)?\s*", str(c))
        if m:
            found.setdefault(int(m.group(1)), c)
    return found


def period_columns(columns, start: int, end: int) -> list[str]:
    """Columns of an inclusive year range; a missing year is an error."""
    known = year_columns(columns)
    missing = [y for y in range(start, end + 1) if y not in known]
    if missing:
        raise ValueError(f"missing years {missing[:10]} ({len(missing)} in total) of {start}-{end}")
    return [known[y] for y in range(start, end + 1)]


def wide_to_long(df: DataFrame, file_name: str = "") -> DataFrame:
    """Year columns to (year, value) rows with standard names and numeric values."""
    years = year_columns(df.columns)
    if years:
        quoted = [df[f"`{c}`"].cast("string").alias(str(y)) for y, c in years.items()]
        ids = [c for c in df.columns if c not in years.values()]
        df = df.select(*[df[f"`{c}`"] for c in ids], *quoted).unpivot([f"`{c}`" for c in ids], [f"`{y}`" for y in years], "year", "value")
    lower = {c.lower(): c for c in reversed(df.columns)}
    for std, names in LONG_NAMES.items():
        hit = next((lower[n] for n in names if n in lower), None)
        if hit and hit != std:
            df = df.withColumnRenamed(hit, std)
    stem, _, rest = file_name.rsplit("/", 1)[-1].rsplit(".", 1)[0].partition("_")
    if "model" not in df.columns:
        df = df.withColumn("model", F.lit(stem))
    if "scenario" not in df.columns:
        df = df.withColumn("scenario", F.lit(rest or stem))
    casts = {"value": to_number(F.col("value"))}
    casts |= {c: F.col(c).cast("string").try_cast("double").cast("int") for c in ("year", "run_id") if c in df.columns}
    return df.withColumns(casts)


def truth(c: Column) -> Column:
    """Boolean from text: true/1/yes/t/y in any case."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("true", "1", "1.0", "yes", "t", "y"), F.lit(False))


PREDICTION_TEXT = T.StructType([
    T.StructField(c, T.StringType()) for c in ("model", "scenario", "is_test", "variable", "obs", "pred_mean", "pred_p10", "pred_p90")
])
RANGE_COLUMNS = ["obs", "pred_mean", "pred_p10", "pred_p90"]


def read_text_csv(spark: SparkSession, path: str, schema: T.StructType, columns: list[str] | None = None) -> DataFrame:
    """CSV with every column as text; only the named columns are parsed."""
    df = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)
    return df.select(*columns) if columns else df


def _judged_predictions(raw: DataFrame, exclude: list[str], variables: list[str] | None) -> tuple[DataFrame, dict[str, Column], Column]:
    """Rows with parsed numbers, the counters as aggregates, and the condition of the rows that stay."""
    required = PREDICTION_TEXT.fieldNames()
    numbers = {f"_{c}": F.col(c).try_cast("double") for c in RANGE_COLUMNS}
    empty = F.lit(False)
    for c in required:
        empty = empty | F.col(c).isNull() | (F.trim(c) == "")
    bad = F.lit(False)
    for c in RANGE_COLUMNS:
        bad = bad | F.col(f"_{c}").isNull() | F.isnan(F.col(f"_{c}"))
    staged = raw.withColumns(numbers).withColumns({"_bad": empty | bad, "_out": F.col("scenario").isin(*exclude) if exclude else F.lit(False)})
    one = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    picked = F.lit(True) if variables is None else F.col("variable").isin(*variables)
    good = ~F.col("_bad") & ~F.col("_out")
    counters = {
        "rows_seen": F.count(F.lit(1)), "rows_dropped_malformed": one(F.col("_bad")),
        "rows_excluded_scenario": one(~F.col("_bad") & F.col("_out")), "rows_after_filter": one(good & picked),
    }
    return staged, counters, good & picked


def _clean_columns(staged: DataFrame, stays: Column) -> DataFrame:
    return staged.where(stays).select("model", "scenario", truth(F.col("is_test")).alias("is_test"), "variable", *[F.col(f"_{c}").alias(c) for c in RANGE_COLUMNS])


def clean_predictions(raw: DataFrame, exclude: list[str] = (), variables: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(clean rows, drop counters) of a prediction table read as text.

    Rows with a missing field or a number that does not parse are malformed;
    scenarios can be excluded and variables chosen. The counters are an
    aggregation of their own; ``observed_predictions`` has them from one scan.
    """
    staged, counters, stays = _judged_predictions(raw, exclude, variables)
    return _clean_columns(staged, stays), staged.agg(*[c.alias(name) for name, c in counters.items()])


def observed_predictions(raw: DataFrame, exclude: list[str] = (), variables: list[str] | None = None) -> tuple[DataFrame, Observation]:
    """Clean rows as ``clean_predictions``, and an observation that holds the counters after the rows have been written once."""
    staged, counters, stays = _judged_predictions(raw, exclude, variables)
    seen = Observation("predictions")
    return _clean_columns(staged.observe(seen, *[c.alias(name) for name, c in counters.items()]), stays), seen


# Percentile keys of a payload
PERCENTILE_KEYS = ["min", "p05", "p17", "p50", "p83", "p95", "max"]


def payload_schema() -> T.StructType:
    arr = T.ArrayType(T.DoubleType())
    years = T.ArrayType(T.IntegerType())
    return T.StructType([
        T.StructField("years", years),
        T.StructField("percentiles", T.MapType(T.StringType(), arr)),
        T.StructField("era5", T.StructType([T.StructField("years", years), T.StructField("values", arr)])),
        T.StructField("meta", T.MapType(T.StringType(), T.StringType())),
    ])


def payload_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """Nested payload to one row per year with percentiles and reference value."""
    cols = [F.col("percentiles")[k].alias(k) for k in PERCENTILE_KEYS]
    flat = df.select(*keys, "years", *cols, F.map_from_arrays("era5.years", "era5.values").alias("_ref"))
    zipped = flat.select(*keys, "_ref", F.explode(F.arrays_zip("years", *PERCENTILE_KEYS)).alias("z"))
    return zipped.select(*keys, F.col("z.years").alias("year"), *[F.col(f"z.{k}").alias(k) for k in PERCENTILE_KEYS], F.col("_ref")[F.col("z.years")].alias("reference"))


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Payload files, keyed by variable folder and scenario file name."""
    raw = spark.read.schema(payload_schema()).option("multiLine", True).json(path)
    name = F.input_file_name()
    raw = raw.withColumns({"variable": F.element_at(F.split(name, "/"), -2), "scenario": F.regexp_extract(name, r"([^/]+)\.json$", 1)})
    return payload_rows(raw, ["variable", "scenario"])


def write_payloads(payloads: DataFrame, path: str) -> None:
    """Payload structs, one a row, as JSON lines in a folder for each variable and scenario."""
    payloads.select("variable", "scenario", F.to_json("payload").alias("value")).write.partitionBy("variable", "scenario").text(path)


def read_payload_lines(spark: SparkSession, path: str) -> tuple[DataFrame, Observation]:
    """Rows of payloads written by ``write_payloads``, and the observed counts of payloads read and dropped.

    Variable and scenario are folder names, so a filter on them prunes files. A
    line that is no payload, or whose percentiles don't have a value for every
    year, is dropped.
    """
    raw = spark.read.schema(payload_schema().add("_corrupt", T.StringType())).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    sizes = [F.size(F.col("percentiles")[k]) == F.size("years") for k in PERCENTILE_KEYS]
    whole = F.coalesce(F.col("_corrupt").isNull() & reduce(lambda a, b: a & b, sizes), F.lit(False))
    seen = Observation("payloads")
    counted = raw.withColumn("_whole", whole).observe(seen, F.count(F.lit(1)).alias("payloads_seen"), F.coalesce(F.sum(F.when(~F.col("_whole"), 1).otherwise(0)), F.lit(0)).alias("payloads_dropped"))
    return payload_rows(counted.where("_whole"), ["variable", "scenario"]), seen


def metric_view(metrics: DataFrame, metrickey: str, side_tag: str = "v101") -> DataFrame:
    """Rows of one metric key; the two NN views split by version tag."""
    tag = F.lower(F.coalesce("version_tag", F.lit("")))
    key = metrickey.upper()
    if key in ("GOFNN_SC", "GOFNN_SO"):
        base = metrics.where(F.upper("metrickey").isin("GOFNN", "GOFNN_SC", "GOFNN_SO"))
        side = base.where(tag == side_tag) if key == "GOFNN_SO" else base.where(tag != side_tag)
        return side.withColumn("metrickey", F.lit(key))
    return metrics.where(F.upper("metrickey") == key)


def structure_failures(lines: DataFrame, text: str, header: str, line_no: str = "line_no") -> DataFrame:
    """Lines whose number of fields differs from the header's, quotes respected."""
    width = field_count(F.lit(header))
    return lines.where(F.trim(F.col(text)) != "").withColumns({"fields": field_count(F.col(text)), "expected": width}).where("fields <> expected").select(line_no, "fields", "expected")


def field_count(text: Column) -> Column:
    """Number of comma-separated fields; commas inside double quotes do not count."""
    bare = F.regexp_replace(F.replace(text, F.lit('""'), F.lit("")), r'"[^"]*"', "")
    return F.size(F.split(bare, ",", -1))


def to_json_text(c: Column) -> Column:
    return F.to_json(c)


def from_json_map(c: Column) -> Column:
    """Attributes stored as JSON text to a map of texts."""
    return F.from_json(c, T.MapType(T.StringType(), T.StringType()))
