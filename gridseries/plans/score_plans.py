"""Error measures, skill tables, spectra and energy scores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from gridseries.operators import metrics as mt
from gridseries.operators import scores as sc
from gridseries.operators import spectral as spx
from gridseries.plans.registry import query
from gridseries.plans.views import (
    CELLS, DRAWS, ENSEMBLE_MONTH, METRICS, PREDICTIONS, cells, draws, ensemble_month, metric_rows, predictions, table,
)

KEYS = ["point_id", "lat", "year", "month", "month_idx"]


def pairs(spark, sf_dir):
    """Temperature of the lighter and the heavier half of the table as two models."""
    c = cells(spark, sf_dir)
    other = c.where("pr > 60").withColumn("tas", F.col("tasmax") - 6)
    return mt.align(c.where("hurs > 50"), other, KEYS, "tas")


PAIRS = CELLS + """, pairs AS (SELECT point_id, lat, year, month, month_idx, a.tas AS a, b.tasmax - 6 AS b FROM cells a JOIN cells b USING (point_id, lat, year, month, month_idx)
  WHERE a.hurs > 50 AND b.pr > 60)"""


@query("join_01_align", "point_id:i month_idx:i a:d b:d", f"WITH {PAIRS} SELECT * FROM pairs")
def join_01(spark, sf_dir):
    """Inner alignment of two fields."""
    return pairs(spark, sf_dir)


@query("agg_13_rmse_deviation", "point_id:i rmse:d dev:d", f"WITH {PAIRS} SELECT point_id, sqrt(avg((a - b) ** 2)) AS rmse, avg(a - b) AS dev FROM pairs GROUP BY 1")
def agg_13(spark, sf_dir):
    """RMSE and deviation per point."""
    return mt.rmse_and_deviation(pairs(spark, sf_dir), ["point_id"])


@query("agg_14_time_mean_rmse", "month:i rmse:d", f"""
WITH {PAIRS}, m AS (SELECT month, point_id, lat, avg(a) - avg(b) AS d FROM pairs GROUP BY 1, 2, 3)
SELECT month, sqrt(sum(d * d * cos(radians(lat))) / sum(cos(radians(lat)))) AS rmse FROM m GROUP BY 1""")
def agg_14(spark, sf_dir):
    """Area-weighted RMSE of month-mean fields."""
    return mt.time_mean_rmse(pairs(spark, sf_dir), ["month"], ["point_id"])


@query("agg_15_ensemble_mean_rmse", "source_id:s rmse:d dev:d", f"""
WITH {ENSEMBLE_MONTH}, a AS (SELECT source_id, month_idx, avg(value) AS v FROM ensm WHERE experiment_id = 'F' GROUP BY 1, 2), b AS (SELECT source_id, month_idx, avg(value) AS w FROM ensm WHERE experiment_id = 'O' GROUP BY 1, 2)
SELECT source_id, sqrt(avg((v - w) ** 2)) AS rmse, avg(v - w) AS dev FROM a JOIN b USING (source_id, month_idx) GROUP BY 1""")
def agg_15(spark, sf_dir):
    """RMSE of ensemble means."""
    m = ensemble_month(spark, sf_dir)
    return mt.ensemble_mean_rmse(m.where("experiment_id = 'F'"), m.where("experiment_id = 'O'"), ["source_id"], ["month_idx"], "value")


@query("agg_16_quantile_rmse", "point_id:i qrmse:d", f"""
WITH {PAIRS}, q AS (SELECT point_id, quantile_cont(a, [x / 100.0 for x in range(1, 100)]::DOUBLE[]) AS qa, quantile_cont(b, [x / 100.0 for x in range(1, 100)]::DOUBLE[]) AS qb FROM pairs GROUP BY 1)
SELECT point_id, sqrt(list_sum([(x[1] - x[2]) ** 2 for x in list_zip(qa, qb)]) / 99) AS qrmse FROM q""".replace("[x / 100.0 for x in range(1, 100)]::DOUBLE[]", "[" + ", ".join(f"{i / 100}" for i in range(1, 100)) + "]"))
def agg_16(spark, sf_dir):
    """Distance of quantile functions per point."""
    return mt.quantile_rmse(pairs(spark, sf_dir), ["point_id"])


@query("agg_17_paired_difference_sd", "model:s n:i sd:d", f"""
WITH {PREDICTIONS} SELECT model, count(*) AS n, stddev_samp(pred_mean - obs) AS sd FROM pred GROUP BY 1 HAVING count(*) >= 2""")
def agg_17(spark, sf_dir):
    """Spread of paired differences per model."""
    return mt.paired_difference_sd(predictions(spark, sf_dir), ["model"], "obs", "pred_mean")


@query("agg_18_count_audit", "kind:s version_tag:s item:s n:i", f"""
WITH {METRICS} SELECT 'metricdomain' AS kind, version_tag, metricdomain AS item, count(*) AS n FROM metrics GROUP BY ROLLUP (version_tag, metricdomain)
UNION ALL SELECT 'experiment_id', version_tag, experiment_id, count(*) FROM metrics GROUP BY ROLLUP (version_tag, experiment_id)""")
def agg_18(spark, sf_dir):
    """Counts by version with sub-totals and the grand total."""
    return mt.count_audit(metric_rows(spark, sf_dir))


@query("agg_19_overview", "metricdomain:s variable:s version_tag:s n:i min:d median:d max:d", f"""
WITH {METRICS} SELECT metricdomain, variable, version_tag, count(value) AS n, min(value) AS min, quantile_cont(value, 0.5) AS median, max(value) AS max FROM metrics GROUP BY 1, 2, 3""")
def agg_19(spark, sf_dir):
    """Median and range by hierarchy and version."""
    return mt.overview(metric_rows(spark, sf_dir), ["metricdomain", "variable", "version_tag"])


@query("agg_20_scan_summary", "variable:s value_min:d value_max:d models:s scenarios:s training_scenarios:s test_scenarios:s rows:i test_rows:i", f"""
WITH {PREDICTIONS} SELECT variable, min(least(obs, pred_mean, pred_p10, pred_p90)) AS value_min, max(greatest(obs, pred_mean, pred_p10, pred_p90)) AS value_max,
  string_agg(DISTINCT model, ',' ORDER BY model) AS models, string_agg(DISTINCT scenario, ',' ORDER BY scenario) AS scenarios,
  string_agg(DISTINCT scenario, ',' ORDER BY scenario) FILTER (NOT is_test) AS training_scenarios, string_agg(DISTINCT scenario, ',' ORDER BY scenario) FILTER (is_test) AS test_scenarios,
  count(*) AS rows, sum(CAST(is_test AS BIGINT)) AS test_rows FROM pred GROUP BY 1""")
def agg_20(spark, sf_dir):
    """Range and scenario sets per variable."""
    s = mt.scan_summary(predictions(spark, sf_dir), ["obs", "pred_mean", "pred_p10", "pred_p90"])
    lists = ["models", "scenarios", "training_scenarios", "test_scenarios"]
    return s.withColumns({c: F.array_join(c, ",") for c in lists})


SKILL = PREDICTIONS + """, skill AS (SELECT model, scenario, variable, bool_or(is_test) AS is_test, avg(obs) AS obs_mean, avg(pred_mean) AS pred_mean, avg(pred_p90 - pred_p10) AS interval_width_mean,
  avg(CASE WHEN obs BETWEEN pred_p10 AND pred_p90 THEN 1.0 ELSE 0.0 END) AS coverage, count(*) AS n, sqrt(avg((pred_mean - obs) ** 2)) AS rmse, avg(pred_mean - obs) AS bias,
  1 - sum((pred_mean - obs) ** 2) / (count(*) * var_pop(obs)) AS r2 FROM pred GROUP BY 1, 2, 3)"""
MSV = ["model", "scenario", "variable"]


@query("agg_52_skill_table", "model:s scenario:s variable:s is_test:b obs_mean:d pred_mean:d interval_width_mean:d coverage:d n:i rmse:d bias:d r2:d", f"WITH {SKILL} SELECT * FROM skill WHERE n >= 2")
def agg_52(spark, sf_dir):
    """Prediction skill per model, scenario and variable."""
    return mt.skill_table(predictions(spark, sf_dir), MSV).where("n >= 2")


@query("agg_53_outlier_flag", "model:s scenario:s variable:s rmse:d rmse_outlier:b", f"""
WITH {SKILL}, k AS (SELECT * REPLACE ('w' || (ascii(substr(variable, 2)) % 2) AS variable) , model || variable AS model2 FROM skill),
l AS (SELECT variable, quantile_cont(rmse, .5) + 1.5 * (quantile_cont(rmse, .75) - quantile_cont(rmse, .25)) AS lim FROM k WHERE is_test GROUP BY 1 HAVING count(rmse) >= 4)
SELECT model2 AS model, scenario, variable, rmse, coalesce(is_test AND rmse > lim, false) AS rmse_outlier FROM k LEFT JOIN l USING (variable)""")
def agg_53(spark, sf_dir):
    """Held-out rows whose error is far above the median of their class."""
    s = mt.skill_table(predictions(spark, sf_dir), MSV)
    s = s.withColumns({"model": F.concat("model", "variable"), "variable": F.concat(F.lit("w"), (F.ascii(F.substring("variable", 2, 1)) % 2).cast("string"))})
    return mt.flag_outliers(s)


@query("agg_54_annual_blocks", "model:s scenario:s variable:s year_idx:i obs:d", f"""
WITH {PREDICTIONS} SELECT model, scenario, variable, month_idx // 12 AS year_idx, avg(obs) AS obs FROM pred GROUP BY 1, 2, 3, 4 HAVING count(*) = 12""")
def agg_54(spark, sf_dir):
    """Annual means of complete years."""
    return mt.annual_blocks(predictions(spark, sf_dir), MSV, ["obs"])


@query("agg_55_forcing_response", "model:s scenario:s year_idx:i obs:d pred_mean:d forcing:d", f"""
WITH {PREDICTIONS}, f AS (SELECT o_orderstatus AS scenario, year(o_orderdate) AS year_idx, month(o_orderdate) AS m, avg(o_totalprice) / 1e5 AS forcing FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1, 2, 3),
g AS (SELECT scenario, year_idx, avg(forcing) AS forcing FROM f GROUP BY 1, 2), r AS (SELECT model, scenario, month_idx // 12 AS year_idx, avg(obs) AS obs, avg(pred_mean) AS pred_mean FROM pred GROUP BY 1, 2, 3)
SELECT * FROM r JOIN g USING (scenario, year_idx)""")
def agg_55(spark, sf_dir):
    """Annual forcing against response."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'")
    f = o.groupBy(F.col("o_orderstatus").alias("scenario"), (F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1).alias("month_idx")).agg((F.avg("o_totalprice") / 1e5).alias("forcing"))
    return mt.forcing_response(predictions(spark, sf_dir), f, ["model", "scenario"])


@query("agg_56_mean_rmse", "scenario:s variable:s mean_rmse:d n:i", f"""
WITH {PREDICTIONS}, u AS (SELECT model, scenario, variable, sqrt(avg((pred_mean - obs) ** 2)) AS r FROM pred GROUP BY 1, 2, 3) SELECT scenario, variable, avg(r) AS mean_rmse, count(*) AS n FROM u GROUP BY 1, 2""")
def agg_56(spark, sf_dir):
    """Mean RMSE per scenario and variable."""
    return mt.mean_rmse(predictions(spark, sf_dir), MSV, ["scenario", "variable"])


@query("prj_03_inverse_normalise", "model:s scenario:s variable:s month_idx:i raw:d", f"""
WITH {PREDICTIONS}, s AS (SELECT variable, stddev_samp(obs) AS pre, avg(obs) AS post FROM pred GROUP BY 1) SELECT *, (obs - post) / pre AS raw FROM pred JOIN s USING (variable)""")
def prj_03(spark, sf_dir):
    """Affine inverse transform with one scalar pair per variable."""
    p = predictions(spark, sf_dir)
    scale = p.groupBy("variable").agg(F.stddev_samp("obs").alias("pre"), F.avg("obs").alias("post"))
    return mt.inverse_normalise(p, scale, "variable", "obs", "raw")


# --- spectra -------------------------------------------------------------------------

def spec_sql(name, where, value):
    """Normalised band power per point by an explicit transform over 83 months."""
    return f"""
{name}_x AS (SELECT point_id, month_idx - 23940 AS t, {value} - avg({value}) OVER (PARTITION BY point_id) AS x FROM cells WHERE {where}),
{name}_k AS (SELECT point_id, k, sum(x * w * cos(2 * pi() * k * t / 83)) ** 2 + sum(x * w * sin(2 * pi() * k * t / 83)) ** 2 AS p
  FROM (SELECT *, 0.5 - 0.5 * cos(2 * pi() * t / 82) AS w FROM {name}_x), (SELECT unnest(range(2, 42)) AS k) GROUP BY 1, 2),
{name} AS (SELECT *, p / greatest(sum(p) OVER (PARTITION BY point_id), 1e-12) AS s FROM {name}_k)"""


@query("win_11_spectral_rmse", "point_id:i spec_rmse:d", f"""
WITH {CELLS}, {spec_sql("a", "true", "tas")}, {spec_sql("b", "pr > 60", "tasmax")}
SELECT point_id, sqrt(avg((a.s - b.s) ** 2)) AS spec_rmse FROM a JOIN b USING (point_id, k) GROUP BY 1""")
def win_11(spark, sf_dir):
    """Distance of normalised spectra per point."""
    c = cells(spark, sf_dir)
    other = c.where("pr > 60").withColumn("tas", F.col("tasmax"))
    return spx.spectral_rmse(c, other, ["point_id"], "tas", 2, 40)


@query("win_11_dominant_period", "point_id:i dominant_period:d", f"""
WITH {CELLS}, {spec_sql("a", "true", "tas")} SELECT point_id, 83.0 / arg_max(k, s) AS dominant_period FROM a GROUP BY 1""")
def win_11_dominant(spark, sf_dir):
    """Strongest period per point."""
    return spx.dominant_period(cells(spark, sf_dir), ["point_id"], "tas", 2, 40)


# --- energy scores -------------------------------------------------------------------

ES = DRAWS + """, es AS (SELECT label, n_draws, c AS cross_, coalesce(p, 0) AS spread, c - 0.5 * coalesce(p, 0) AS es FROM (
  SELECT d.label, count(*) AS n_draws, avg(list_distance(d.vec, t.vec)) AS c FROM draws d JOIN draws t ON d.label = t.label AND t.is_truth AND NOT d.is_truth GROUP BY 1)
  LEFT JOIN (SELECT a.label, avg(list_distance(a.vec, b.vec)) AS p FROM draws a JOIN draws b ON a.label = b.label AND a.vec_id < b.vec_id AND NOT a.is_truth AND NOT b.is_truth GROUP BY 1) USING (label))"""


def scored(spark, sf_dir):
    d = draws(spark, sf_dir)
    return sc.energy_score(d.where("NOT is_truth"), d.where("is_truth"), ["label"], "vec_id", "vec")


@query("agg_36_energy_score", "label:i n_draws:i cross_:d spread:d es:d", f"WITH {ES} SELECT * FROM es")
def agg_36(spark, sf_dir):
    """Energy score per label."""
    return scored(spark, sf_dir).withColumnRenamed("cross", "cross_")


@query("agg_37_score_summary", "cls:s n:i q1:d median_s:d q3:d iqr:d", f"""
WITH {ES}, r AS (SELECT quantile_cont(list_distance(a.vec, b.vec), 0.5) AS ref FROM draws a JOIN draws b ON a.is_truth AND b.is_truth AND a.label < b.label AND a.label % 3 = b.label % 3),
s AS (SELECT CASE WHEN label % 3 = 0 THEN 'train' ELSE 'test' END AS cls, es / ref AS s FROM es, r WHERE es > 0)
SELECT cls, count(*) AS n, quantile_cont(s, .25) AS q1, quantile_cont(s, .5) AS median_s, quantile_cont(s, .75) AS q3, quantile_cont(s, .75) - quantile_cont(s, .25) AS iqr FROM s GROUP BY 1""")
def agg_37(spark, sf_dir):
    """Scores relative to the inter-model distance, by scenario class."""
    d = draws(spark, sf_dir)
    truth = d.where("is_truth").select((F.col("label") % 3).alias("scenario"), F.lit("v").alias("item"), F.col("label").alias("model"), "vec")
    es = scored(spark, sf_dir).withColumns({"item": F.lit("v"), "cls": F.when(F.col("label") % 3 == 0, "train").otherwise("test")})
    return sc.score_summary(sc.normalised_scores(es, truth, ["scenario"], ["item"], "model", "vec"), ["cls"])


@query("arr_01_vector_distance", "vec_id:i dist:d", """
SELECT a.vec_id, sqrt(list_sum([(x[1]::DOUBLE - x[2]::DOUBLE) ** 2 for x in list_zip(a.embedding, b.embedding)])) AS dist FROM embeddings a JOIN embeddings b ON b.vec_id = a.label""")
def arr_01(spark, sf_dir):
    """Distance over the common length to a reference vector per label."""
    e = table(spark, sf_dir, "embeddings").withColumn("vec", F.col("embedding").cast("array<double>"))
    ref = e.select(F.col("vec_id").alias("_ref"), F.col("vec").alias("ref"))
    return e.join(ref, e.label == F.col("_ref")).select("vec_id", sc.distance(F.col("vec"), F.col("ref")).alias("dist"))


VARS = ["pr", "tas", "hurs"]


def fields(spark, sf_dir):
    """Long fields of three variables over all months."""
    c = cells(spark, sf_dir).withColumns({"run": F.lit("r1"), "t": F.col("month_idx") - 23940, "pix": F.col("point_id")})
    return c.unpivot(["run", "t", "pix", "lat"], VARS, "variable", "value")


FIELDS = CELLS + """, fld AS (SELECT 'r1' AS run, month_idx - 23940 AS t, point_id AS pix, lat, unnest(['pr', 'tas', 'hurs']) AS variable, unnest([pr, tas, hurs]) AS value FROM cells),
gm AS (SELECT variable, t, avg(value) AS value FROM fld GROUP BY 1, 2),
gw AS (SELECT gm.* FROM gm JOIN (SELECT variable, (max(t) + 1) // 12 * 12 AS n FROM gm GROUP BY 1) USING (variable) WHERE t < n)"""
COLS = "recipe:s label:s idx:i value:d"


def recipe(name, sql, fn):
    label = name.split("_", 2)[-1]

    @query(name, COLS, f"WITH {FIELDS} {sql}")
    def run(spark, sf_dir):
        return fn(fields(spark, sf_dir), ["run"])

    run.__doc__ = f"Recipe vectors: {label}."
    return run


def probs_sql(probs):
    return "[" + ", ".join(f"{p:.17g}" for p in probs) + "]"


recipe("agg_38_bias_maps", "SELECT 'BiasMaps' AS recipe, variable AS label, pix AS idx, avg(value) AS value FROM fld GROUP BY 2, 3", sc.bias_maps)
recipe("agg_38_global_timeseries", "SELECT 'GlobalTimeseries' AS recipe, variable AS label, t AS idx, value FROM gm", sc.global_timeseries)
recipe("agg_38_histograms", f"SELECT 'Histograms' AS recipe, variable AS label, unnest(range(0, 50)) AS idx, unnest(quantile_cont(value, {probs_sql(np.linspace(0.01, 0.99, 50))})) AS value FROM fld GROUP BY variable", sc.histograms)
recipe("agg_38_seasonal_cycle", "SELECT 'SeasonalCycle' AS recipe, variable AS label, t % 12 AS idx, avg(value) AS value FROM gw GROUP BY 2, 3", sc.seasonal_cycle)
recipe("agg_38_zonal_means", """, f AS (SELECT variable, pix, lat, avg(value) AS v FROM fld GROUP BY 1, 2, 3), z AS (SELECT variable, CAST(floor((lat + 90) / 7.2) AS BIGINT) AS b, avg(v) AS v FROM f GROUP BY 1, 2)
SELECT 'ZonalMeans' AS recipe, d.variable AS label, i AS idx, coalesce(z.v, 0) AS value FROM (SELECT variable, unnest(range(0, 25)) AS i FROM (SELECT DISTINCT variable FROM f)) d LEFT JOIN z ON z.variable = d.variable AND z.b = d.i""",
       lambda df, run: sc.zonal_profiles(df, run, 25))
recipe("agg_38_variability", """, a AS (SELECT variable, t, value - avg(value) OVER (PARTITION BY variable, t % 12) AS v FROM gw), f AS (SELECT variable, regr_slope(v, t) AS s, regr_intercept(v, t) AS i FROM a GROUP BY 1)
SELECT 'Variability' AS recipe, variable AS label, t AS idx, v - s * t - i AS value FROM a JOIN f USING (variable)""", sc.variability)
recipe("agg_38_joint_evolution", """, p AS (SELECT * FROM (VALUES ('pr', 'tas'), ('pr', 'hurs'), ('tas', 'hurs')) AS v(x, y))
SELECT 'JointEvolution' AS recipe, x || '_' || y AS label, l AS idx, corr(a.value, b.value) AS value FROM p JOIN gm a ON a.variable = x, (SELECT unnest(range(0, 12)) AS l) JOIN gm b ON true WHERE b.variable = y AND b.t = a.t + l GROUP BY 2, 3""",
       lambda df, run: sc.joint_evolution(df, run, VARS))
recipe("agg_38_humidity_coupling", "SELECT 'HumidityCoupling' AS recipe, 'hurs_tas' AS label, 2 * t + CASE WHEN variable = 'tas' THEN 1 ELSE 0 END AS idx, value FROM gm WHERE variable IN ('hurs', 'tas')",
       lambda df, run: sc.humidity_coupling(df, run, [("hurs", "tas")]))
recipe("agg_38_tail_quantiles", f"SELECT 'IndicatorFreq' AS recipe, variable AS label, unnest(range(0, 40)) AS idx, unnest(quantile_cont(value, {probs_sql(np.concatenate([np.linspace(0.01, 0.10, 20), np.linspace(0.90, 0.99, 20)]))})) AS value FROM gm GROUP BY variable", sc.tail_quantiles)
recipe("agg_38_teleconnections", """, i AS (SELECT t, avg(value) AS i FROM fld WHERE variable = 'tas' AND abs(lat) < 30 GROUP BY 1)
SELECT 'ENSOTeleconnections' AS recipe, variable AS label, pix AS idx, covar_pop(i, value) / ((stddev_pop(i) + 1e-10) * (stddev_pop(value) + 1e-10)) AS value FROM fld JOIN i USING (t) GROUP BY 2, 3""", sc.teleconnections)
recipe("agg_38_index_characteristics", """, g0 AS (SELECT variable, t, avg(value) AS v FROM fld WHERE abs(lat) < 30 AND variable IN ('tas', 'pr') GROUP BY 1, 2),
g AS (SELECT g0.* FROM g0 JOIN (SELECT variable, (max(t) + 1) // 12 * 12 AS n FROM g0 GROUP BY 1) USING (variable) WHERE t < n), a AS (SELECT variable, t, v - avg(v) OVER (PARTITION BY variable, t % 12) AS x FROM g),
m AS (SELECT variable, stddev_pop(x) + 1e-10 AS s, avg(x) AS mu, sum(x * x) AS s0 FROM a GROUP BY 1)
SELECT 'ENSOCharacteristics' AS recipe, variable AS label, 0 AS idx, s AS value FROM m UNION ALL SELECT 'ENSOCharacteristics', variable, 1, avg((x - mu) ** 3) / max(s) ** 3 FROM a JOIN m USING (variable) GROUP BY variable
UNION ALL SELECT 'ENSOCharacteristics', a.variable, l + 1, sum(a.x * b.x) / (max(s0) + 1e-10) FROM a JOIN m USING (variable), (SELECT unnest(range(1, 25)) AS l) JOIN a b ON true WHERE b.variable = a.variable AND b.t = a.t + l GROUP BY a.variable, l""",
       lambda df, run: sc.index_characteristics(df, run, ["tas", "pr"]))
