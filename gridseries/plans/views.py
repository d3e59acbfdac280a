"""Views of the driver tables in the shape of the engine's data model.

Each view exists as a DataFrame builder and as a SQL CTE for the checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridseries.functions.calendar import month_index
from gridseries.functions.quantiles import broadcast_if_small


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_years(df: DataFrame, column: str, years: tuple[int, int] | None) -> DataFrame:
    """Rows whose date lies in the years, as a range that reaches the scan."""
    if years is None:
        return df
    kind = df.schema[column].dataType
    return df.where((F.col(column) >= F.lit(f"{years[0]}-01-01").cast(kind)) & (F.col(column) < F.lit(f"{years[1] + 1}-01-01").cast(kind)))


def point_lat(p):
    return (F.pmod(p * 37, F.lit(121)) - 60).cast("double")


def point_lon(p):
    return F.pmod(p * 53, F.lit(360)).cast("double")


def cells(spark: SparkSession, sf_dir: str, years: tuple[int, int] | None = None) -> DataFrame:
    """Grid months: line items of a supplier and month become one cell; of ``years`` only, if given."""
    li = in_years(table(spark, sf_dir, "lineitem"), "l_shipdate", years)
    disc = F.avg("l_discount")
    tax = F.avg("l_tax")
    tas = 273.15 + disc * 300
    out = li.groupBy(
        F.col("l_suppkey").alias("point_id"), F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month")
    ).agg(
        F.sum("l_quantity").alias("pr"),
        (F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))) / 1500).alias("pet"),
        tas.alias("tas"),
        (tas - 5 - tax * 50).alias("tasmin"),
        (tas + 5 + tax * 50).alias("tasmax"),
        (100 + F.avg("l_quantity") * 4).alias("rsds"),
        (1 + tax * 20).alias("sfcWind"),
        (30 + F.avg("l_quantity")).alias("hurs"),
    )
    p = F.col("point_id")
    return out.withColumns(
        {"month_idx": month_index(F.col("year"), F.col("month")), "lat": point_lat(p), "lon": point_lon(p)}
    )


CELLS = """cells AS (
  SELECT *, year * 12 + month - 1 AS month_idx,
         CAST((point_id * 37) % 121 - 60 AS DOUBLE) AS lat, CAST((point_id * 53) % 360 AS DOUBLE) AS lon
  FROM (
    SELECT l_suppkey AS point_id, year(l_shipdate) AS year, month(l_shipdate) AS month,
           sum(l_quantity) AS pr, sum(l_extendedprice * (1 - l_discount)) / 1500 AS pet,
           273.15 + avg(l_discount) * 300 AS tas,
           273.15 + avg(l_discount) * 300 - 5 - avg(l_tax) * 50 AS tasmin,
           273.15 + avg(l_discount) * 300 + 5 + avg(l_tax) * 50 AS tasmax,
           100 + avg(l_quantity) * 4 AS rsds, 1 + avg(l_tax) * 20 AS "sfcWind", 30 + avg(l_quantity) AS hurs
    FROM lineitem GROUP BY 1, 2, 3))"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point dimension: suppliers, with nation and region as regions."""
    s = table(spark, sf_dir, "supplier")
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    joined = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    p = F.col("s_suppkey")
    return joined.select(p.alias("point_id"), F.col("n_name").alias("region_id"), F.col("r_name").alias("continent"), point_lat(p).alias("lat"), point_lon(p).alias("lon"))


POINTS = """points AS (
  SELECT s_suppkey AS point_id, n_name AS region_id, r_name AS continent,
         CAST((s_suppkey * 37) % 121 - 60 AS DOUBLE) AS lat, CAST((s_suppkey * 53) % 360 AS DOUBLE) AS lon
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

REGION_POINT = POINTS + """,
region_point AS (
  SELECT region_id, point_id, cos(radians(lat)) / sum(cos(radians(lat))) OVER (PARTITION BY region_id) AS weight FROM points)"""


def ensemble_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annual member values: one row per (source, experiment, member, year)."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(
        F.col("o_orderpriority").alias("source_id"),
        F.col("o_orderstatus").alias("experiment_id"),
        (F.col("o_custkey") % 10).alias("member_id"),
        F.year("o_orderdate").alias("year"),
    ).agg((F.avg("o_totalprice") / 1000).alias("value"))


ENSEMBLE = """ens AS (
  SELECT o_orderpriority AS source_id, o_orderstatus AS experiment_id, o_custkey % 10 AS member_id,
         year(o_orderdate) AS year, avg(o_totalprice) / 1000 AS value
  FROM orders GROUP BY 1, 2, 3, 4)"""


def ensemble_month(spark: SparkSession, sf_dir: str, years: tuple[int, int] | None = None) -> DataFrame:
    """Monthly member values: one row per (source, experiment, member, month); of ``years`` only, if given."""
    o = in_years(table(spark, sf_dir, "orders"), "o_orderdate", years)
    out = o.groupBy(
        F.col("o_orderpriority").alias("source_id"),
        F.col("o_orderstatus").alias("experiment_id"),
        (F.col("o_custkey") % 10).alias("member_id"),
        F.year("o_orderdate").alias("year"),
        F.month("o_orderdate").alias("month"),
    ).agg((F.avg("o_totalprice") / 1000).alias("value"))
    return out.withColumn("month_idx", month_index(F.col("year"), F.col("month")))


ENSEMBLE_MONTH = """ensm AS (
  SELECT *, year * 12 + month - 1 AS month_idx FROM (
  SELECT o_orderpriority AS source_id, o_orderstatus AS experiment_id, o_custkey % 10 AS member_id,
         year(o_orderdate) AS year, month(o_orderdate) AS month, avg(o_totalprice) / 1000 AS value
  FROM orders GROUP BY 1, 2, 3, 4, 5))"""


def series_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly global series per model: orders averaged by priority and month."""
    o = table(spark, sf_dir, "orders")
    out = o.groupBy(
        F.col("o_orderpriority").alias("source_id"), F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")
    ).agg((F.avg("o_totalprice") / 1000).alias("value"))
    return out.withColumn("month_idx", month_index(F.col("year"), F.col("month")))


SERIES_MONTH = """ser AS (
  SELECT *, year * 12 + month - 1 AS month_idx FROM (
  SELECT o_orderpriority AS source_id, year(o_orderdate) AS year, month(o_orderdate) AS month,
         avg(o_totalprice) / 1000 AS value FROM orders GROUP BY 1, 2, 3))"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction table: observed, predicted mean and band per model, scenario, variable and month."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(
        F.col("l_returnflag").alias("model"),
        F.col("l_linestatus").alias("scenario"),
        F.concat(F.lit("v"), (F.col("l_suppkey") % 5).cast("string")).alias("variable"),
        month_index(F.year("l_shipdate"), F.month("l_shipdate")).alias("month_idx"),
    ).agg(
        F.avg("l_quantity").alias("obs"),
        (F.avg("l_extendedprice") / 1400).alias("pred_mean"),
        (F.avg("l_extendedprice") / 1400 - 20 * F.avg("l_tax") * 5).alias("pred_p10"),
        (F.avg("l_extendedprice") / 1400 + 20 * F.avg("l_tax") * 5).alias("pred_p90"),
    ).withColumn("is_test", F.col("scenario") == "O")


PREDICTIONS = """pred AS (
  SELECT l_returnflag AS model, l_linestatus AS scenario, 'v' || (l_suppkey % 5) AS variable,
         year(l_shipdate) * 12 + month(l_shipdate) - 1 AS month_idx,
         avg(l_quantity) AS obs, avg(l_extendedprice) / 1400 AS pred_mean,
         avg(l_extendedprice) / 1400 - 20 * avg(l_tax) * 5 AS pred_p10,
         avg(l_extendedprice) / 1400 + 20 * avg(l_tax) * 5 AS pred_p90,
         l_linestatus = 'O' AS is_test
  FROM lineitem GROUP BY 1, 2, 3, 4)"""


def metric_rows(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Metric rows from the events, or from a stream of them; keys repeat."""
    e = table(spark, sf_dir, "events") if events is None else events
    return e.select(
        F.lit("gofnc").alias("metrickey"),
        F.col("event_type").alias("metricdomain"),
        F.concat(F.lit("type"), (F.col("event_id") % 3).cast("string")).alias("metrictype"),
        F.concat(F.lit("var"), (F.col("event_id") % 2).cast("string")).alias("variable"),
        F.concat(F.lit("model-"), F.col("user_id").cast("string")).alias("source_id"),
        F.concat(F.lit("r"), (F.col("event_id") % 4).cast("string"), F.lit("i1p1f1")).alias("member_id"),
        F.when(F.col("event_id") % 5 == 0, "historical").otherwise("ssp245").alias("experiment_id"),
        F.lit("ref").alias("comp_source_id"),
        F.lit("").alias("comp_member_id"),
        F.col("value"),
        F.when(F.dayofmonth("ts") <= 15, "v100").otherwise("v101").alias("version_tag"),
        F.col("ts").alias("timestamp"),
        F.col("event_id"),
    )


METRICS = """metrics AS (
  SELECT 'gofnc' AS metrickey, event_type AS metricdomain, 'type' || (event_id % 3) AS metrictype,
         'var' || (event_id % 2) AS variable, 'model-' || user_id AS source_id,
         'r' || (event_id % 4) || 'i1p1f1' AS member_id,
         CASE WHEN event_id % 5 = 0 THEN 'historical' ELSE 'ssp245' END AS experiment_id,
         'ref' AS comp_source_id, '' AS comp_member_id, value,
         CASE WHEN day(ts) <= 15 THEN 'v100' ELSE 'v101' END AS version_tag, ts AS timestamp, event_id
  FROM events)"""


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Member files: every customer is a file whose name carries the catalogue keys."""
    c = table(spark, sf_dir, "customer")
    experiment = F.element_at(
        F.array(*[F.lit(x) for x in ("historical", "ssp245", "hist-nat", "ssp245-nat", "ssp585")]), (F.col("c_nationkey") % 5 + 1)
    )
    variables = F.when(F.col("c_custkey") % 7 == 0, "pr-tas-tasmin").otherwise("hurs-pr-psl-rsds-sfcWind-tas-tasmax-tasmin")
    return c.select(
        F.concat(
            F.lit("/archive/"), F.lower("c_mktsegment"), F.lit("/DAT_"), F.initcap("c_mktsegment"), F.lit("-"),
            (F.col("c_nationkey") % 4).cast("string"), F.lit("_"), experiment, F.lit("_r"), (F.col("c_custkey") % 12 + 1).cast("string"),
            F.lit("i1p1f"), (F.col("c_custkey") % 2 + 1).cast("string"), F.lit("_"), variables, F.lit(".nc"),
        ).alias("path"),
        F.col("c_custkey").alias("file_id"),
        F.col("c_acctbal").alias("size_mb"),
    )


MEMBERS = """members AS (
  SELECT '/archive/' || lower(c_mktsegment) || '/DAT_' || upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) || '-'
         || (c_nationkey % 4) || '_' || ['historical','ssp245','hist-nat','ssp245-nat','ssp585'][c_nationkey % 5 + 1]
         || '_r' || (c_custkey % 12 + 1) || 'i1p1f' || (c_custkey % 2 + 1) || '_'
         || CASE WHEN c_custkey % 7 = 0 THEN 'pr-tas-tasmin' ELSE 'hurs-pr-psl-rsds-sfcWind-tas-tasmax-tasmin' END || '.nc' AS path,
         c_custkey AS file_id, c_acctbal AS size_mb
  FROM customer)"""

CATALOGUE = MEMBERS + """,
cat AS (
  SELECT path, file_id, size_mb, split_part(base, '_', 2) AS source_id, split_part(base, '_', 3) AS experiment_id,
         split_part(base, '_', 4) AS member_id, replace(split_part(base, '_', 5), '.nc', '') AS variables
  FROM (SELECT *, split_part(path, '/', 4) AS base FROM members))"""


def hp_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested HEALPix map at nside 8 per brand from the part table."""
    p = table(spark, sf_dir, "part")
    return p.groupBy(F.col("p_brand").alias("map_id"), (F.col("p_partkey") % 768).alias("pix")).agg(F.avg("p_retailprice").alias("value"))


HP_MAP = """hp AS (
  SELECT p_brand AS map_id, p_partkey % 768 AS pix, avg(p_retailprice) AS value FROM part GROUP BY 1, 2)"""


def draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector draws: per label the lowest vec_id is the truth, the others are draws."""
    e = table(spark, sf_dir, "embeddings")
    first = e.groupBy("label").agg(F.min("vec_id").alias("_first"))
    return e.join(broadcast_if_small(first), "label").select(
        "label", "vec_id", F.col("embedding").cast("array<double>").alias("vec"), (F.col("vec_id") == F.col("_first")).alias("is_truth")
    )


DRAWS = """draws AS (
  SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS vec, vec_id = min(vec_id) OVER (PARTITION BY label) AS is_truth FROM embeddings)"""
