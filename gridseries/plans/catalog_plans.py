"""Catalogue selection, pairing, jobs and accounting."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridseries.operators import catalog as ct
from gridseries.operators import filters as flt
from gridseries.plans.registry import query
from gridseries.plans.sqlparts import hash32
from gridseries.plans.views import CATALOGUE, CELLS, ENSEMBLE, METRICS, cells, ensemble_year, members, metric_rows, table

KEY3 = ["source_id", "experiment_id", "member_id"]


def catalogue(spark, sf_dir):
    return ct.parse_names(members(spark, sf_dir))


@query("src_01_parse_names", "file_id:i source_id:s experiment_id:s member_id:s variables:s token:s", f"""
WITH {CATALOGUE} SELECT *, nullif(regexp_extract(path, '_(r[0-9]+i[0-9]+p[0-9]+f[0-9]+)_', 1), '') AS token FROM cat""")
def src_01(spark, sf_dir):
    """Keys from member file names."""
    return catalogue(spark, sf_dir).withColumn("token", ct.member_token(F.col("path")))


@query("src_02_required_variables", "file_id:i", f"""
WITH {CATALOGUE} SELECT * FROM cat WHERE len([x for x in ['pr','tas','tasmin','tasmax','rsds','sfcWind','hurs','psl'] if NOT list_contains(string_split(variables, '-'), x)]) = 0""")
def src_02(spark, sf_dir):
    """Files that hold every variable of the protocol."""
    return catalogue(spark, sf_dir).where(ct.has_variables(F.col("variables"), ct.PROTOCOL_VARIABLES))


@query("src_03_logical_parts", "page_id:i part:i part_path:s", """
SELECT page_id, unnest(range(0, 3)) AS part, unnest([url, url || '#b', url || '#c']) AS part_path FROM pages""")
def src_03(spark, sf_dir):
    """Pipe-separated path lists unfolded."""
    p = table(spark, sf_dir, "pages").select("page_id", F.concat_ws("|", "url", F.concat("url", F.lit("#b")), F.concat(F.lit(" "), "url", F.lit("#c "))).alias("paths"))
    return ct.logical_parts(p, "paths")


@query("flt_05_wildcard_row_keys", "event_id:i", f"""
WITH {METRICS}, k AS (SELECT *, concat_ws('__', metrickey, metricdomain, metrictype, variable, source_id, member_id, experiment_id, '') AS k FROM metrics)
SELECT event_id FROM k WHERE regexp_full_match(lower(k), 'gofnc__.*type1.*') AND (regexp_full_match(lower(k), '.*click.*') OR regexp_full_match(lower(k), '.*__view__.*')) AND NOT regexp_full_match(lower(k), '.*model-1[^_]*__.*')""".replace("model-1[^_]*__.*", "model-1.*"))
def flt_05(spark, sf_dir):
    """Row keys by AND / OR / NOT wildcards."""
    return flt.filter_row_keys(metric_rows(spark, sf_dir), ["GOFNC__*TYPE1*"], ["*click*", "*__view__*"], ["*model-1*"])


@query("flt_06_column_contains", "event_id:i", f"""
WITH {METRICS} SELECT event_id FROM metrics WHERE (contains(variable, 'var0') OR contains(variable, 'zzz')) AND (contains(lower(experiment_id), 'ssp') OR contains(metricdomain, 'click')) AND NOT contains(metrictype, 'type2')""")
def flt_06(spark, sf_dir):
    """Substring filters per column."""
    return flt.filter_columns(
        metric_rows(spark, sf_dir), {"variable": ["VAR0", "zzz"], "absent": ["x"]}, {"experiment_id": "SSP", "metricdomain": "click"}, {"metrictype": "type2"}
    )


@query("flt_07_scenario_patterns", "kind:s item:s", f"""
WITH {CATALOGUE} SELECT DISTINCT 'match' AS kind, experiment_id AS item FROM cat WHERE experiment_id LIKE 'ssp2%' OR experiment_id LIKE 'hist-___'
UNION ALL SELECT 'unmatched', p FROM (SELECT unnest(['ssp2%', 'hist-___', 'abrupt%']) AS p) WHERE NOT EXISTS (SELECT 1 FROM cat WHERE experiment_id LIKE p)""".replace("SELECT 'unmatched', p FROM", "SELECT 'unmatched', replace(replace(p, '%', '*'), '_', '?') FROM"))
def flt_07(spark, sf_dir):
    """Scenarios by glob, and the globs without a match."""
    c = catalogue(spark, sf_dir)
    pats = ["ssp2*", "hist-???", "abrupt*"]
    hit = flt.matching_scenarios(c, "experiment_id", pats).select(F.lit("match").alias("kind"), F.col("experiment_id").alias("item")).distinct()
    return hit.unionByName(flt.unmatched_patterns(c, "experiment_id", pats).select(F.lit("unmatched").alias("kind"), F.col("pattern").alias("item")))


@query("flt_08_natural_forcing", "file_id:i forcing:s", f"WITH {CATALOGUE} SELECT file_id, CASE WHEN experiment_id LIKE '%-nat' THEN 'natural' ELSE 'factual' END AS forcing FROM cat")
def flt_08(spark, sf_dir):
    """Forcing by scenario suffix."""
    return catalogue(spark, sf_dir).withColumn("forcing", F.when(flt.is_natural(F.col("experiment_id")), "natural").otherwise("factual"))


@query("flt_09_select_catalogue", "file_id:i", f"""
WITH {CATALOGUE}, c AS (SELECT * FROM cat WHERE source_id IN ('Building-1', 'Building-2', 'Machinery-0') AND source_id <> 'Building-2' AND regexp_full_match(member_id, 'r[0-9]+i1p1f1'))
SELECT file_id FROM c JOIN (SELECT source_id, experiment_id, min(member_id) AS member_id FROM c GROUP BY 1, 2) USING (source_id, experiment_id, member_id)""")
def flt_09(spark, sf_dir):
    """White list, black list, member pattern and first member."""
    return flt.select_catalogue(catalogue(spark, sf_dir), ["Building-1", "Building-2", "Machinery-0"], ["Building-2"], r"r\d+i1p1f1", one_member=True)


@query("flt_14_contract_filter", "event_id:i metrictype:s variable:s", f"""
WITH {METRICS} SELECT * FROM metrics WHERE CASE WHEN variable = 'var0' THEN metrictype = 'type1' ELSE metrictype IN ('type0', 'type2') END""")
def flt_14(spark, sf_dir):
    """Metric types allowed per variable, with a default list."""
    m = metric_rows(spark, sf_dir)
    rule = m.select(F.when(F.col("variable") == "var0", F.col("variable")).alias("variable"), "metrictype").distinct()
    rule = rule.where("(variable IS NOT NULL AND metrictype = 'type1') OR (variable IS NULL AND metrictype <> 'type1')")
    return flt.contract_filter(m, rule)


@query("flt_15_primary_lane", "region:s estimate:d", """
WITH s AS (SELECT o_orderkey % 40 AS k, o_orderpriority AS region, CASE WHEN o_orderkey % 3 = 0 THEN 'probability_ratio' ELSE 'probability' END AS record_type,
  CASE WHEN o_orderstatus = 'F' THEN 1950 ELSE 1991 END AS b, CASE WHEN o_custkey % 2 = 0 THEN 'adjusted' ELSE 'unadjusted' END AS t, o_totalprice FROM orders)
SELECT region, o_totalprice AS estimate FROM s WHERE record_type = 'probability_ratio' AND b = 1950 AND t = 'adjusted'""")
def flt_15(spark, sf_dir):
    """Ratio rows of the primary lane."""
    o = table(spark, sf_dir, "orders")
    s = o.select(
        F.col("o_orderpriority").alias("region"), F.when(F.col("o_orderkey") % 3 == 0, "probability_ratio").otherwise("probability").alias("record_type"),
        F.when(F.col("o_orderstatus") == "F", 1950).otherwise(1991).alias("baseline_start"), F.when(F.col("o_orderstatus") == "F", 2014).otherwise(2020).alias("baseline_end"),
        F.when(F.col("o_custkey") % 2 == 0, "adjusted").otherwise("unadjusted").alias("rsds_treatment"), F.lit("gridcell-spei-area-mean").alias("aggregation"),
        F.lit(2001).alias("window_start"), F.lit(2020).alias("window_end"), F.col("o_totalprice").alias("estimate"),
    )
    return flt.primary_lane(s, (1950, 2014), "adjusted", "gridcell-spei-area-mean", (2001, 2020))


PAIRED = CATALOGUE + """, o AS (SELECT * FROM cat WHERE file_id % 3 > 0), e AS (SELECT * FROM cat WHERE file_id % 3 < 2),
og AS (SELECT source_id, experiment_id, member_id, min(path) AS original_file, count(*) AS n_original FROM o GROUP BY 1, 2, 3),
eg AS (SELECT source_id, experiment_id, member_id, min(path) AS emulated_file, count(*) AS n_emulated FROM e GROUP BY 1, 2, 3)"""


def paired(spark, sf_dir, keep):
    c = catalogue(spark, sf_dir)
    return ct.pair_runs(c.where("file_id % 3 > 0"), c.where("file_id % 3 < 2"), keep)


@query("join_02_pair_runs", "source_id:s experiment_id:s member_id:s original_file:s emulated_file:s n_original:i n_emulated:i emulated_only:b", f"""
WITH {PAIRED} SELECT *  REPLACE (coalesce(n_original, 0) AS n_original), original_file IS NULL AS emulated_only FROM eg LEFT JOIN og USING (source_id, experiment_id, member_id)""")
def join_02(spark, sf_dir):
    """Original and emulated runs, unpaired emulated ones kept."""
    return paired(spark, sf_dir, True)


@query("join_03_first_partners", "source_id:s experiment_id:s path:s partner:s", f"""
WITH {CATALOGUE}, p AS (SELECT DISTINCT source_id, experiment_id, path FROM cat), r AS (SELECT a.source_id, a.experiment_id, a.path, b.path AS partner, row_number() OVER (PARTITION BY a.source_id, a.experiment_id, a.path ORDER BY b.path) AS k
  FROM p a JOIN p b ON a.source_id = b.source_id AND a.experiment_id = b.experiment_id AND a.path <> b.path) SELECT * FROM r WHERE k <= 3""")
def join_03(spark, sf_dir):
    """Up to three other members of the same source and scenario."""
    return ct.first_partners(catalogue(spark, sf_dir), ["source_id", "experiment_id"], "path", 3)


@query("join_03_partner_blocks", "source_id:s experiment_id:s n_pairs:i", f"""
WITH {CATALOGUE} SELECT source_id, experiment_id, count(DISTINCT path) * (count(DISTINCT path) - 1) // 2 AS n_pairs FROM cat GROUP BY 1, 2""")
def join_03_blocks(spark, sf_dir):
    """All partners as block pairs; the blocks cover every unordered pair once."""
    b = ct.partner_blocks(catalogue(spark, sf_dir), ["source_id", "experiment_id"], "path", block=4)
    na, nb = F.size("items_a").cast("bigint"), F.size("items_b").cast("bigint")
    n = F.when(F.col("block_a") == F.col("block_b"), na * (na - 1) / 2).otherwise(na * nb)
    return b.groupBy("source_id", "experiment_id").agg(F.sum(n).alias("n_pairs"))


@query("join_03_block_ids", "source_id:s experiment_id:s n_pairs:i n_items:i", f"""
WITH {CATALOGUE} SELECT source_id, experiment_id, count(DISTINCT path) * (count(DISTINCT path) - 1) // 2 AS n_pairs, count(DISTINCT path) AS n_items FROM cat GROUP BY 1, 2""")
def join_03_block_ids(spark, sf_dir):
    """All partners as pairs of block numbers, items stored once with theirs."""
    members, pairs = ct.partner_block_ids(catalogue(spark, sf_dir), ["source_id", "experiment_id"], "path", block=4)
    sizes = members.groupBy("source_id", "experiment_id", "block").agg(F.count(F.lit(1)).alias("n"))
    key = ["source_id", "experiment_id"]
    a, b = sizes.toDF(*key, "block_a", "na"), sizes.toDF(*key, "block_b", "nb")
    both = pairs.join(a, [*key, "block_a"]).join(b, [*key, "block_b"])
    n = F.when(F.col("block_a") == F.col("block_b"), F.col("na") * (F.col("na") - 1) / 2).otherwise(F.col("na") * F.col("nb"))
    own = F.when(F.col("block_a") == F.col("block_b"), F.col("na")).otherwise(0)
    return both.groupBy(*key).agg(F.sum(n).alias("n_pairs"), F.sum(own).alias("n_items"))


@query("join_03_other_models", "path:s partner_source:s partner_path:s", f"""
WITH {CATALOGUE}, one AS (SELECT experiment_id, source_id, min(path) AS partner_path FROM cat GROUP BY 1, 2),
r AS (SELECT c.file_id, c.path, o.source_id AS partner_source, partner_path, row_number() OVER (PARTITION BY c.file_id ORDER BY o.source_id) AS k FROM cat c JOIN one o ON c.experiment_id = o.experiment_id AND c.source_id <> o.source_id)
SELECT * FROM r WHERE k <= 5""")
def join_03_models(spark, sf_dir):
    """Up to five other models of the same scenario."""
    return ct.first_other_models(catalogue(spark, sf_dir), 5)


PAST = "historical"

JOBS = PAIRED + """, pr AS (SELECT * FROM eg JOIN og USING (source_id, experiment_id, member_id)),
fp AS (SELECT source_id, experiment_id, path AS a, partner AS b FROM (SELECT x.source_id, x.experiment_id, x.path, y.path AS partner, row_number() OVER (PARTITION BY x.source_id, x.experiment_id, x.path ORDER BY y.path) AS k
  FROM (SELECT DISTINCT source_id, experiment_id, path FROM o) x JOIN (SELECT DISTINCT source_id, experiment_id, path FROM o) y ON x.source_id = y.source_id AND x.experiment_id = y.experiment_id AND x.path <> y.path) WHERE k <= 1),
mz AS (SELECT experiment_id, source_id, min(path) AS pp FROM o GROUP BY 1, 2),
oz AS (SELECT * FROM (SELECT o.experiment_id, o.source_id, o.path, mz.source_id AS zs, pp, row_number() OVER (PARTITION BY o.file_id ORDER BY mz.source_id) AS k FROM o JOIN mz ON o.experiment_id = mz.experiment_id AND o.source_id <> mz.source_id) WHERE k <= 2),
cz AS (SELECT oz.* FROM oz SEMI JOIN pr ON oz.source_id = pr.source_id AND oz.experiment_id = pr.experiment_id AND oz.path = pr.original_file),
j0 AS (SELECT 'nc' AS comparison, source_id, experiment_id, original_file AS file_a, emulated_file AS file_b FROM pr
  UNION ALL SELECT 'cc', fp.source_id, fp.experiment_id, a, b FROM fp SEMI JOIN pr ON fp.source_id = pr.source_id AND fp.experiment_id = pr.experiment_id AND fp.a = pr.original_file
  UNION ALL SELECT 'cz', source_id, experiment_id, path, pp FROM cz
  UNION ALL SELECT 'zz', fp.source_id, fp.experiment_id, a, b FROM fp SEMI JOIN cz ON fp.source_id = cz.zs AND fp.experiment_id = cz.experiment_id AND fp.a = cz.pp),
nn AS (SELECT source_id, experiment_id, path AS a, partner AS b FROM (SELECT x.source_id, x.experiment_id, x.path, y.path AS partner, row_number() OVER (PARTITION BY x.source_id, x.experiment_id, x.path ORDER BY y.path) AS k
  FROM (SELECT DISTINCT source_id, experiment_id, path FROM e) x JOIN (SELECT DISTINCT source_id, experiment_id, path FROM e) y ON x.source_id = y.source_id AND x.experiment_id = y.experiment_id AND x.path <> y.path) WHERE k <= 1),
j1 AS (SELECT * FROM j0 UNION ALL SELECT 'nn', nn.source_id, nn.experiment_id, a, b FROM nn SEMI JOIN pr ON nn.source_id = pr.source_id AND nn.experiment_id = pr.experiment_id AND nn.a = pr.emulated_file
  UNION ALL SELECT 'oc', source_id, experiment_id, min_by(original_file, member_id), 'observed.nc' FROM pr WHERE experiment_id = 'PAST' GROUP BY source_id, experiment_id
  UNION ALL SELECT 'on', source_id, experiment_id, min_by(emulated_file, member_id), 'observed.nc' FROM pr WHERE experiment_id = 'PAST' GROUP BY source_id, experiment_id),
jobs AS (SELECT *, unnest(['drought', 'BiasMaps']) AS recipe FROM j1)""".replace("PAST", PAST)


def jobs(spark, sf_dir):
    c = catalogue(spark, sf_dir)
    return ct.job_matrix(
        paired(spark, sf_dir, False), c.where("file_id % 3 > 0"), ["drought", "BiasMaps"], 1, 2,
        emulated=c.where("file_id % 3 < 2"), observation="observed.nc", historical=(PAST,),
    )


@query("join_04_job_matrix", "comparison:s source_id:s experiment_id:s file_a:s file_b:s recipe:s", f"WITH {JOBS} SELECT * FROM jobs")
def join_04(spark, sf_dir):
    """Comparison jobs of seven types for two recipes."""
    return jobs(spark, sf_dir)


@query("join_05_guided_jobs", "comparison:s file_a:s file_b:s recipe:s on_reference_file:s oc_reference_file:s", f"""
WITH {JOBS}, l AS (SELECT comparison AS lead, recipe, file_a, max(file_b) AS ref FROM jobs WHERE comparison IN ('on', 'oc') GROUP BY 1, 2, 3)
SELECT comparison, j.file_a, file_b, j.recipe, n.ref AS on_reference_file, c.ref AS oc_reference_file FROM jobs j
LEFT JOIN l n ON comparison = 'nn' AND experiment_id = '{PAST}' AND n.lead = 'on' AND n.recipe = j.recipe AND n.file_a = j.file_a
LEFT JOIN l c ON comparison = 'cc' AND c.lead = 'oc' AND c.recipe = j.recipe AND c.file_a = j.file_a
WHERE NOT (comparison = 'nn' AND experiment_id = '{PAST}' AND n.ref IS NULL)""")
def join_05(spark, sf_dir):
    """Emulated pairs kept where an observed one leads them, original pairs tagged."""
    return ct.observation_guided_jobs(jobs(spark, sf_dir), (PAST,))


@query("join_07_availability", "source_id:s experiment_id:s member_id:s pr:s tas:s", f"""
WITH {CATALOGUE}, v AS (SELECT source_id, experiment_id, member_id, path, unnest(string_split(variables, '-')) AS variable FROM cat),
t AS (SELECT DISTINCT source_id, experiment_id, member_id FROM cat),
w AS (SELECT source_id, experiment_id, member_id, string_agg(path, '|' ORDER BY path) FILTER (variable = 'psl') AS pr, string_agg(path, '|' ORDER BY path) FILTER (variable = 'tas') AS tas FROM v WHERE variable IN ('psl', 'tas') GROUP BY 1, 2, 3)
SELECT * FROM t LEFT JOIN w USING (source_id, experiment_id, member_id)""")
def join_07(spark, sf_dir):
    """File lists per variable for every triplet."""
    c = catalogue(spark, sf_dir)
    v = c.select(*KEY3, "path", F.lit("Amon").alias("table_id"), F.explode(F.split("variables", "-")).alias("variable"))
    wanted = v.select("table_id", "variable").distinct().where("variable IN ('psl', 'tas')")
    out = ct.availability(v, wanted, c.select(*KEY3).distinct(), ["psl", "tas"])
    blank = lambda x: F.when(F.col(x) != "", F.col(x))
    return out.withColumns({"pr": blank("psl"), "tas": blank("tas")})


@query("join_07_availability_rows", "source_id:s experiment_id:s member_id:s variable:s path:s n_variable:i n_triplet:i", f"""
WITH {CATALOGUE}, v AS (SELECT source_id, experiment_id, member_id, path, unnest(string_split(variables, '-')) AS variable FROM cat), t AS (SELECT DISTINCT source_id, experiment_id, member_id FROM cat),
h AS (SELECT *, count(*) OVER (PARTITION BY source_id, experiment_id, member_id, variable) AS nv, count(*) OVER (PARTITION BY source_id, experiment_id, member_id) AS nt FROM v WHERE variable IN ('psl', 'tas'))
SELECT source_id, experiment_id, member_id, variable, path, coalesce(nv, 0) AS n_variable, coalesce(nt, 0) AS n_triplet FROM t LEFT JOIN h USING (source_id, experiment_id, member_id)""")
def join_07_rows(spark, sf_dir):
    """Files per variable for every triplet, one row each with counted totals."""
    c = catalogue(spark, sf_dir)
    v = c.select(*KEY3, "path", F.lit("Amon").alias("table_id"), F.explode(F.split("variables", "-")).alias("variable"))
    wanted = v.select("table_id", "variable").distinct().where("variable IN ('psl', 'tas')")
    return ct.availability_rows(v, wanted, c.select(*KEY3).distinct())


@query("join_14_common_years", "source_id:s member_id:i year:i value:d", f"""
WITH {ENSEMBLE}, s AS (SELECT * FROM ens WHERE experiment_id = 'F' AND NOT (member_id = 3 AND year = 1999)),
g AS (SELECT source_id, year FROM s GROUP BY 1, 2 HAVING count(DISTINCT member_id) = (SELECT count(DISTINCT member_id) FROM s x WHERE x.source_id = s.source_id)) SELECT s.* FROM s SEMI JOIN g USING (source_id, year)""")
def join_14(spark, sf_dir):
    """Years that every member of a source holds."""
    e = ensemble_year(spark, sf_dir).where("experiment_id = 'F' AND NOT (member_id = 3 AND year = 1999)")
    return ct.common_years(e, ["source_id"])


@query("join_15_latest_common_month", "point_id:i year:i month:i", f"""
WITH {CELLS}, b AS (SELECT point_id, year, month FROM cells WHERE year <= 2000 AND pr > 80) SELECT point_id, max(ym) // 100 AS year, max(ym) % 100 AS month FROM (
  SELECT point_id, year * 100 + month AS ym FROM cells JOIN b USING (point_id, year, month)) GROUP BY 1""")
def join_15(spark, sf_dir):
    """Latest month that two series share."""
    c = cells(spark, sf_dir)
    return ct.latest_common_month(c, c.where("year <= 2000 AND pr > 80"), "pr", ["point_id"])


@query("join_18_resolve_baseline", "file_id:i status:s baseline_path:s note:s", f"""
WITH {CATALOGUE}, b AS (SELECT lower(source_id) AS s, lower(member_id) AS m, min(path) AS bp FROM cat WHERE experiment_id = 'historical' GROUP BY 1, 2), r AS (SELECT * FROM cat WHERE experiment_id = 'ssp245'),
j AS (SELECT r.*, bp FROM r LEFT JOIN b ON lower(source_id) = s AND lower(member_id) = m)
SELECT file_id, CASE WHEN bp IS NULL THEN 'dropped' ELSE 'ok' END AS status, bp AS baseline_path,
  CASE WHEN bp IS NULL THEN 'missing exact historical baseline member for source_id=' || source_id || ', member_id=' || member_id ELSE 'historical-' || source_id || '-' || member_id END AS note FROM j""")
def join_18(spark, sf_dir):
    """Exact baselines, and the runs dropped without one."""
    c = catalogue(spark, sf_dir)
    ok, bad = ct.resolve_baselines(c.where("experiment_id = 'ssp245'"), c, "exact", "historical")
    good = ok.select("file_id", F.lit("ok").alias("status"), "baseline_path", F.col("baseline_id").alias("note"))
    return good.unionByName(bad.select("file_id", F.lit("dropped").alias("status"), F.lit(None).cast("string").alias("baseline_path"), F.col("reason").alias("note")))


@query("join_20_attach_names", "s_suppkey:i model:s", "SELECT s_suppkey, coalesce(n_name, 'model_index ' || (s_nationkey + 10)) AS model FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey + 10")
def join_20(spark, sf_dir):
    """Names by index, default label where missing."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_nationkey") + 10).alias("model_index"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("model_index"), F.col("n_name").alias("model"))
    return ct.attach_names(s, n)


@query("join_21_member_year_matrix", "source_id:s member_id:i year:i value:d", f"""
WITH {ENSEMBLE}, s AS (SELECT * FROM ens WHERE experiment_id = 'F' AND value > 190), m AS (SELECT source_id, member_id, unnest(range(1994, 2004)) AS year FROM (SELECT DISTINCT source_id, member_id FROM s))
SELECT m.*, value FROM m LEFT JOIN s USING (source_id, member_id, year)""")
def join_21(spark, sf_dir):
    """Members by years with nulls."""
    e = ensemble_year(spark, sf_dir).where("experiment_id = 'F' AND value > 190")
    return ct.member_year_matrix(e, ["source_id", "member_id"], (1994, 2003), "value")


@query("agg_45_one_member_per_source", "source_id:s member_id:s file_0:s file_1:s file_2:s", f"""
WITH {CATALOGUE}, p AS (SELECT source_id, member_id, count(DISTINCT experiment_id) AS n, max(CAST(experiment_id = 'historical' AS INT)) AS h, min(path) FILTER (experiment_id = 'historical') AS file_0,
  min(path) FILTER (experiment_id = 'hist-nat') AS file_1, min(path) FILTER (experiment_id = 'ssp245') AS file_2 FROM cat WHERE experiment_id IN ('historical', 'hist-nat', 'ssp245') GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY h DESC, n DESC, member_id) AS k FROM p) WHERE k = 1""")
def agg_45(spark, sf_dir):
    """One member per source by experiment coverage."""
    return ct.one_member_per_source(catalogue(spark, sf_dir), ["historical", "hist-nat", "ssp245"], "historical")


@query("agg_46_resolve_scenarios", "scenario:s root:s run_name:s member_count:i excluded_reason:s", f"""
WITH {CATALOGUE}, f AS (SELECT experiment_id || '-' || (file_id % 6) AS scenario, split_part(path, '/', 3) AS root, length(split_part(path, '/', 3)) % 4 AS priority, 'run' || (file_id % 2) AS run_name, path, lower(source_id || '|' || member_id) AS ident FROM cat),
p AS (SELECT scenario, root, priority, run_name, count(DISTINCT ident) AS n, min(path) AS fp FROM f GROUP BY 1, 2, 3, 4),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scenario, root ORDER BY (n = 8) DESC, priority DESC, run_name DESC, fp DESC) AS k FROM p) WHERE k = 1),
c AS (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY (n = 8) DESC, priority DESC, run_name DESC, fp DESC) AS q, bool_or(n = 8) OVER (PARTITION BY scenario) AS anyf FROM r),
l AS (SELECT scenario, string_agg(DISTINCT CAST(n AS VARCHAR), ',' ORDER BY CAST(n AS VARCHAR)) AS counts, list_sort(list(DISTINCT n)) AS ns FROM r GROUP BY 1)
SELECT scenario, CASE WHEN anyf THEN root END AS root, CASE WHEN anyf THEN run_name END AS run_name, CASE WHEN anyf THEN n END AS member_count,
  CASE WHEN NOT anyf THEN CASE WHEN len(ns) > 1 THEN 'mixed_member_counts:' ELSE 'member_count_not_8:' END || array_to_string(ns, ',') END AS excluded_reason FROM c JOIN l USING (scenario) WHERE q = 1""")
def agg_46(spark, sf_dir):
    """Source run per scenario by priority, with reasons for exclusion."""
    c = catalogue(spark, sf_dir)
    root = F.split("path", "/")[2]
    cand = c.select(
        F.concat_ws("-", "experiment_id", (F.col("file_id") % 6).cast("string")).alias("scenario"), root.alias("root"), (F.length(root) % 4).alias("priority"),
        F.concat(F.lit("run"), (F.col("file_id") % 2).cast("string")).alias("run_name"), "path", F.lower(F.concat_ws("|", "source_id", "member_id")).alias("identity"),
    )
    return ct.resolve_scenarios(cand, 8)


@query("agg_49_catalogue_window", "source_id:s start:i end_:i n_months:i", f"""
WITH {CATALOGUE}, w AS (SELECT source_id, 185001 + file_id % 12 + 100 * (file_id % 30) AS s, 201401 + file_id % 12 + 100 * (file_id % 80) AS e FROM cat)
SELECT source_id, min(s) AS start, max(e) AS end_, (max(e) // 100 * 12 + max(e) % 100) - (min(s) // 100 * 12 + min(s) % 100) + 1 AS n_months FROM w GROUP BY 1""")
def agg_49(spark, sf_dir):
    """Time span of each source from file names."""
    i = F.col("file_id")
    s, e = 185001 + i % 12 + 100 * (i % 30), 201401 + i % 12 + 100 * (i % 80)
    c = catalogue(spark, sf_dir).withColumn("path", F.concat(F.lit("x_"), s.cast("string"), F.lit("-"), e.cast("string"), F.lit(".nc")))
    return ct.catalogue_window(c, ["source_id"]).withColumnRenamed("end", "end_")


# --- accounting ----------------------------------------------------------------------

DOMAINS = {"v100": "S(c)", "v101": "S(o)"}


def runs(spark, sf_dir):
    """Expected runs under two options and completed runs, from the events."""
    e = table(spark, sf_dir, "events")
    i, u = F.col("event_id"), F.col("user_id")
    base = e.select(
        F.when(i % 2 == 0, "v100").otherwise("v101").alias("model_version"), F.lit("drought").alias("recipe"),
        F.element_at(F.array(*[F.lit(x) for x in ("CC", "nn", "cc")]), (i % 3 + 1).cast("int")).alias("comparison"),
        F.concat(F.lit("m"), (u % 20).cast("string")).alias("source_id"), F.lit("ssp245").alias("experiment_id"),
        F.concat(F.lit("r"), (u % 7).cast("string")).alias("member_id"), F.col("event_type").alias("comp_source_id"), F.lit("").alias("comp_member_id"),
        F.when(i % 5 < 3, "A").otherwise("B").alias("option"), (i % 7 < 3).alias("done"),
    )
    norm = ct.normalise_runs(base, DOMAINS)
    return norm.where("NOT done"), norm.where("done")


RUNS = """r0 AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'v100' ELSE 'v101' END AS mv, CASE WHEN event_id % 2 = 0 THEN 'S(c)' ELSE 'S(o)' END AS domain, 'drought' AS recipe,
  lower(['CC', 'nn', 'cc'][event_id % 3 + 1]) AS comparison, 'drought|' || lower(['CC', 'nn', 'cc'][event_id % 3 + 1]) || '|m' || (user_id % 20) || '|ssp245|r' || (user_id % 7) || '|' || event_type || '|' AS rk,
  CASE WHEN event_id % 5 < 3 THEN 'A' ELSE 'B' END AS option, event_id % 7 < 3 AS done FROM events),
r1 AS (SELECT *, mv || '|' || rk AS run_key, upper(comparison) || '_' || CASE WHEN domain = 'S(c)' THEN 'SC' ELSE 'SO' END AS gof_bucket, CASE WHEN comparison = 'cc' THEN rk ELSE '' END AS grp FROM r0),
ex AS (SELECT DISTINCT option, domain, gof_bucket, recipe, run_key FROM r1 WHERE NOT done), dn AS (SELECT DISTINCT domain, gof_bucket, recipe, run_key FROM r1 WHERE done),
k AS (SELECT option, domain, gof_bucket, recipe, run_key, true AS e, false AS d FROM ex UNION ALL SELECT o.option, domain, gof_bucket, recipe, run_key, false, true FROM dn, (SELECT DISTINCT option FROM ex) o),
kk AS (SELECT option, domain, gof_bucket, recipe, run_key, bool_or(e) AS e, bool_or(d) AS d FROM k GROUP BY ALL),
strict AS (SELECT option, domain, gof_bucket, recipe, count(*) FILTER (e AND d) AS i_completed_still_useful, count(*) FILTER (d AND NOT e) AS ii_existing_to_be_purged,
  count(*) FILTER (e AND NOT d) AS iii_missing, count(*) FILTER (e) AS iv_total_necessary FROM kk GROUP BY 1, 2, 3, 4)"""

GROUPS = RUNS + """,
ge AS (SELECT option, recipe, grp, list_sort(list(DISTINCT domain)) AS ex FROM r1 WHERE NOT done AND comparison = 'cc' GROUP BY 1, 2, 3), gd AS (SELECT recipe, grp, list_sort(list(DISTINCT domain)) AS dn FROM r1 WHERE done AND comparison = 'cc' GROUP BY 1, 2),
gg AS (SELECT coalesce(ge.option, x.option) AS option, coalesce(ge.recipe, x.recipe) AS recipe, coalesce(ge.grp, x.grp) AS grp, coalesce(ex, []) AS ex, coalesce(dn, []) AS dn FROM ge FULL JOIN (SELECT gd.*, o.option FROM gd, (SELECT DISTINCT option FROM ex) o) x ON ge.option = x.option AND ge.grp = x.grp),
g AS (SELECT *, CASE WHEN len(ex) > 0 THEN ex[1] ELSE dn[1] END AS owner FROM gg)"""


@query("agg_47_strict_accounting", "option:s domain:s gof_bucket:s recipe:s i_completed_still_useful:i ii_existing_to_be_purged:i iii_missing:i iv_total_necessary:i", f"WITH {RUNS} SELECT * FROM strict")
def agg_47(spark, sf_dir):
    """Strict counts per option and bucket."""
    return ct.strict_accounting(*runs(spark, sf_dir))


@query("agg_47_reuse_groups", "option:s cc_reuse_group:s expected_domains:s completed_domains:s owner_domain:s shared:b completed_any:b strict_missing:i reuse_missing:i", f"""
WITH {GROUPS} SELECT option, grp AS cc_reuse_group, array_to_string(ex, ',') AS expected_domains, array_to_string(dn, ',') AS completed_domains, owner AS owner_domain, len(ex) > 1 AS shared, len(dn) > 0 AS completed_any,
  CASE WHEN len(ex) > 0 AND len(dn) = 0 THEN len(ex) ELSE 0 END AS strict_missing, CASE WHEN len(ex) > 0 AND len(dn) = 0 THEN 1 ELSE 0 END AS reuse_missing FROM g""")
def agg_47_groups(spark, sf_dir):
    """Groups of runs that can be reused across domains."""
    return ct.reuse_groups(*runs(spark, sf_dir), "S(c)")


REUSE = GROUPS + """,
u AS (SELECT option, recipe, owner AS domain, CASE WHEN len(ex) > 0 AND len(dn) > 0 THEN 1 ELSE 0 END AS i, 0 AS ii, CASE WHEN len(ex) > 0 AND len(dn) = 0 THEN 1 ELSE 0 END AS iii, CASE WHEN len(ex) > 0 THEN 1 ELSE 0 END AS iv, 0 AS sh FROM g
  UNION ALL SELECT option, recipe, d, 0, 0, 0, 0, 1 FROM (SELECT *, unnest(ex) AS d FROM g) WHERE d <> owner
  UNION ALL SELECT option, recipe, d, 0, 1, 0, 0, 0 FROM (SELECT *, unnest(dn) AS d FROM g) WHERE len(ex) = 0 OR d <> CASE WHEN list_contains(dn, owner) THEN owner ELSE dn[1] END),
reuse AS (SELECT option, domain, 'CC_' || CASE WHEN domain = 'S(c)' THEN 'SC' ELSE 'SO' END AS gof_bucket, recipe, sum(i) AS i_completed_still_useful, sum(ii) AS ii_existing_to_be_purged, sum(iii) AS iii_missing, sum(iv) AS iv_total_necessary, sum(sh) AS cc_reuse_shadow_count FROM u GROUP BY 1, 2, 3, 4
  UNION ALL SELECT *, 0 FROM strict WHERE gof_bucket NOT LIKE 'CC%')"""


@query("agg_47_reuse_accounting", "option:s domain:s gof_bucket:s recipe:s i_completed_still_useful:i ii_existing_to_be_purged:i iii_missing:i iv_total_necessary:i cc_reuse_shadow_count:i", f"WITH {REUSE} SELECT * FROM reuse")
def agg_47_reuse(spark, sf_dir):
    """Counts when shared groups are run once."""
    e, d = runs(spark, sf_dir)
    return ct.reuse_accounting(ct.strict_accounting(e, d), ct.reuse_groups(e, d, "S(c)"))


@query("srt_09_option_ranking", "rank:i option:s strict_missing:i reuse_missing:i strict_total:i reuse_total:i reused:i saved:i", f"""
WITH {REUSE}, s AS (SELECT option, sum(iii_missing) AS strict_missing, sum(iv_total_necessary) AS strict_total FROM strict GROUP BY 1), r AS (SELECT option, sum(iii_missing) AS reuse_missing, sum(iv_total_necessary) AS reuse_total FROM reuse GROUP BY 1),
c AS (SELECT option, count(*) FILTER (len(ex) > 1 AND len(dn) > 0) AS reused FROM g GROUP BY 1)
SELECT row_number() OVER (ORDER BY reuse_missing, strict_missing, reused DESC, option) AS rank, *, strict_missing - reuse_missing AS saved FROM s JOIN r USING (option) JOIN c USING (option)""")
def srt_09(spark, sf_dir):
    """Ranking of the options."""
    e, d = runs(spark, sf_dir)
    strict, groups = ct.strict_accounting(e, d), ct.reuse_groups(e, d, "S(c)")
    return ct.option_ranking(strict, ct.reuse_accounting(strict, groups), groups)


@query("str_03_run_key", "event_id:i run_key:s label:s token:s", """
SELECT event_id, 'v1|drought|cc|m' || user_id || '|' || event_type || '|||' AS run_key, year(ts) || 'to' || (year(ts) + 19) AS label,
  regexp_replace(lower(event_type || ' / ' || user_id), '[^a-z0-9]+', '-', 'g') AS token FROM events""")
def str_03(spark, sf_dir):
    """Run keys, window labels and cleaned tokens."""
    e = table(spark, sf_dir, "events")
    user = F.col("user_id").cast("string")
    runs_ = e.withColumns({
        "model_version": F.lit("v1 "), "recipe": F.lit("drought"), "comparison": F.lit(" CC"), "source_id": F.concat(F.lit("m"), user), "experiment_id": F.col("event_type"),
        "member_id": F.lit(None).cast("string"), "comp_source_id": F.lit(""), "comp_member_id": F.lit(None).cast("string"),
    })
    first = F.year("ts")
    return runs_.select("event_id", ct.run_key().alias("run_key"), ct.window_label(first, first + 19).alias("label"), ct.clean_token(F.col("event_type"), user).alias("token"))


# --- sorts and picks -----------------------------------------------------------------


@query("srt_01_member_order", "source_id:s rank:i member_id:s", f"""
WITH {CATALOGUE}, m AS (SELECT DISTINCT source_id, member_id FROM cat) SELECT source_id, member_id, row_number() OVER (PARTITION BY source_id ORDER BY CAST(regexp_extract(member_id, 'r([0-9]+)', 1) AS INT), member_id) AS rank FROM m""")
def srt_01(spark, sf_dir):
    """Natural order of member names."""
    return ct.ordered_members(catalogue(spark, sf_dir).select("source_id", "member_id").distinct(), ["source_id"])


@query("srt_02_first_members", "source_id:s experiment_id:s member_id:s", f"""
WITH {CATALOGUE}, m AS (SELECT DISTINCT source_id, experiment_id, member_id FROM cat) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id, experiment_id ORDER BY CAST(regexp_extract(member_id, 'r([0-9]+)', 1) AS INT), member_id) AS k FROM m) WHERE k <= 3""")
def srt_02(spark, sf_dir):
    """First three members per source and scenario."""
    return ct.first_members(catalogue(spark, sf_dir).select(*KEY3).distinct(), ["source_id", "experiment_id"], 3)


@query("srt_03_oldest_run", "source_id:s path:s", f"""
WITH {CATALOGUE}, s AS (SELECT source_id, file_id, CASE WHEN file_id % 3 = 0 THEN '/x/plain_' || file_id || '.nc' ELSE '/x/EMU-' || (20240101 + file_id % 28) || '-' || (1000 + file_id % 60) || '_' || file_id || '.nc' END AS path FROM cat)
SELECT source_id, path FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY CASE WHEN file_id % 3 = 0 THEN 1 ELSE 0 END, regexp_extract(path, '([0-9]{{8}}-[0-9]{{4}})_', 1), file_id * 7 % 101, path) AS k FROM s) WHERE k = 1""")
def srt_03(spark, sf_dir):
    """Oldest run per source."""
    i = F.col("file_id")
    c = catalogue(spark, sf_dir).select("source_id", F.when(i % 3 == 0, F.concat(F.lit("/x/plain_"), i.cast("string"), F.lit(".nc"))).otherwise(
        F.concat(F.lit("/x/EMU-"), (20240101 + i % 28).cast("string"), F.lit("-"), (1000 + i % 60).cast("string"), F.lit("_"), i.cast("string"), F.lit(".nc"))).alias("path"), (i * 7 % 101).alias("modified"))
    return ct.oldest_run(c, ["source_id"])


@query("srt_04_even_stride", "source_id:s file_id:i", f"""
WITH {CATALOGUE} SELECT source_id, file_id FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY file_id) - 1 AS r, count(*) OVER (PARTITION BY source_id) AS n FROM cat) WHERE r % greatest(CAST(ceil(n / 20) AS BIGINT), 1) = 0""")
def srt_04(spark, sf_dir):
    """At most twenty evenly spaced files per source."""
    return ct.even_stride(catalogue(spark, sf_dir).select("source_id", "file_id"), ["source_id"], "file_id", 20)


@query("srt_07_temperature_variable", "brand:s name:s", """
WITH v AS (SELECT DISTINCT p_brand AS brand, ['tas', 'tas_smoothed', 'Surface Air Temperature Change', 'Surface Air Ocean Blended Temperature Change', 'pr'][p_partkey % 5 + 1] || CASE WHEN p_size > 25 THEN '' ELSE ' 2' END AS name FROM part),
s AS (SELECT *, CASE WHEN lower(name) LIKE '%temperature%' THEN 100 ELSE 0 END + CASE WHEN lower(name) LIKE '%surface air%' THEN 100 ELSE 0 END + CASE WHEN lower(name) LIKE '%tas%' THEN 80 ELSE 0 END + CASE WHEN lower(name) LIKE '%change%' THEN 30 ELSE 0 END
  + CASE WHEN lower(name) LIKE '%smooth%' THEN 10 ELSE 0 END - CASE WHEN lower(name) LIKE '%blended%' THEN 30 ELSE 0 END AS sc FROM v WHERE lower(name) LIKE '%temperature%' OR lower(name) LIKE '%tas%' OR lower(name) LIKE '%smooth%')
SELECT brand, name FROM (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY sc DESC, name) AS k FROM s) WHERE k = 1""")
def srt_07(spark, sf_dir):
    """Most likely temperature variable per model."""
    p = table(spark, sf_dir, "part")
    names = F.array(*[F.lit(x) for x in ("tas", "tas_smoothed", "Surface Air Temperature Change", "Surface Air Ocean Blended Temperature Change", "pr")])
    v = p.select(F.col("p_brand").alias("brand"), F.concat(F.element_at(names, (F.col("p_partkey") % 5 + 1).cast("int")), F.when(F.col("p_size") > 25, "").otherwise(" 2")).alias("name"))
    return ct.pick_temperature(v, ["brand"], "name", prefer_smoothed=False)


@query("srt_08_pick_level", "source_id:s experiment_id:s", f"""
WITH {CATALOGUE} SELECT source_id, coalesce(max(experiment_id) FILTER (experiment_id = 'ssp245'), min(experiment_id)) AS experiment_id FROM cat GROUP BY 1""")
def srt_08(spark, sf_dir):
    """Preferred scenario per source, else the first."""
    return ct.pick_level(catalogue(spark, sf_dir), ["source_id"], "experiment_id", "ssp245")


@query("srt_10_random_pick", "source_id:s file_id:i", f"""
WITH {CATALOGUE} SELECT source_id, file_id FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY {hash32("concat_ws('|', '42', file_id)")}, file_id) AS k FROM cat) WHERE k <= 5""")
def srt_10(spark, sf_dir):
    """Five files per source in hash order."""
    return ct.random_pick(catalogue(spark, sf_dir), ["source_id"], "file_id", 5, "42")


@query("srt_11_anchor_member", "source_id:s experiment_id:s member_id:s", f"WITH {CATALOGUE} SELECT source_id, experiment_id, min(member_id) AS member_id FROM cat GROUP BY 1, 2")
def srt_11(spark, sf_dir):
    """Anchor member per source and scenario."""
    return ct.anchor_member(catalogue(spark, sf_dir), ["source_id", "experiment_id"])


@query("srt_12_preferred_version", "user_id:i expver:i value:d", """
SELECT user_id, expver, value FROM (SELECT user_id, event_id % 4 AS expver, avg(value) AS value, row_number() OVER (PARTITION BY user_id ORDER BY list_position([1, 3, 0], event_id % 4)) AS k FROM events WHERE event_id % 4 IN (1, 3, 0) GROUP BY 1, 2) WHERE k = 1""")
def srt_12(spark, sf_dir):
    """Value of the version that comes first in a priority list."""
    e = table(spark, sf_dir, "events").groupBy("user_id", (F.col("event_id") % 4).alias("expver")).agg(F.avg("value").alias("value"))
    return ct.preferred_version(e, ["user_id"], "expver", ["1", "3", "0"])


@query("srt_13_model_per_draw", "o_orderkey:i model_index:i", f"""
WITH m AS (SELECT list_sort(list(DISTINCT n_nationkey)) AS ms FROM nation) SELECT o_orderkey, ms[{hash32("concat_ws('|', 's', o_orderkey)")} % len(ms) + 1] AS model_index FROM orders, m""")
def srt_13(spark, sf_dir):
    """Hash-drawn model index per draw."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("model_index"))
    return ct.model_per_draw(n, table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", "model_index", "s")


# --- sets ----------------------------------------------------------------------------


@query("set_01_stitch", "point_id:i month_idx:i tas:d", f"WITH {CELLS} SELECT point_id, month_idx, tas FROM cells WHERE year <= 1998 OR year >= 1999")
def set_01(spark, sf_dir):
    """Parent run followed by its child."""
    c = cells(spark, sf_dir).select("point_id", "month_idx", "year", "tas")
    return ct.stitch(c.where("year <= 1998"), c.where("year >= 1999"), ["point_id"])


@query("set_02_key_set_counts", "event_type:s i_completed_still_useful:i ii_existing_to_be_purged:i iii_missing:i iv_total_necessary:i", """
WITH u AS (SELECT event_type, user_id, bool_or(event_id % 3 > 0 AND value > 20) AS e, bool_or(event_id % 3 = 0) AS c FROM events GROUP BY 1, 2)
SELECT event_type, count(*) FILTER (e AND c) AS i_completed_still_useful, count(*) FILTER (c AND NOT e) AS ii_existing_to_be_purged, count(*) FILTER (e AND NOT c) AS iii_missing, count(*) FILTER (e) AS iv_total_necessary FROM u WHERE e OR c GROUP BY 1""")
def set_02(spark, sf_dir):
    """Counts of two key sets."""
    e = table(spark, sf_dir, "events")
    return ct.key_set_counts(e.where("event_id % 3 > 0 AND value > 20"), e.where("event_id % 3 = 0"), "user_id", ["event_type"])


@query("set_03_common_variables", "source_id:s vars:s", f"""
WITH {CATALOGUE}, v AS (SELECT source_id, file_id, unnest(string_split(variables, '-')) AS variable FROM cat), a AS (SELECT DISTINCT source_id, variable FROM v WHERE file_id % 2 = 0), b AS (SELECT DISTINCT source_id, variable FROM v WHERE file_id % 7 = 0)
SELECT source_id, string_agg(variable, ',' ORDER BY variable) AS vars FROM a JOIN b USING (source_id, variable) WHERE variable IN ('tas', 'pr') GROUP BY 1""")
def set_03(spark, sf_dir):
    """Variables two file sets share."""
    v = catalogue(spark, sf_dir).select("source_id", "file_id", F.explode(F.split("variables", "-")).alias("variable"))
    c = ct.common_variables(v.where("file_id % 2 = 0"), v.where("file_id % 7 = 0"), ["source_id"], restrict=["tas", "pr"])
    return c.withColumn("vars", F.array_join("variables", ","))


@query("set_04_inventory", "source_id:s member_id:s forcing:s paths:s", f"""
WITH {CATALOGUE}, f AS (SELECT source_id, member_id, experiment_id, min(path) AS p FROM cat GROUP BY 1, 2, 3),
u AS (SELECT h.source_id, h.member_id, 'factual' AS forcing, h.p || '|' || s.p AS paths FROM f h JOIN f s ON h.source_id = s.source_id AND h.member_id = s.member_id AND h.experiment_id = 'historical' AND s.experiment_id = 'ssp245'
  UNION ALL SELECT source_id, member_id, 'natural', p FROM f WHERE experiment_id = 'hist-nat')
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id, forcing ORDER BY CAST(regexp_extract(member_id, 'r([0-9]+)', 1) AS INT), member_id) AS k FROM u) WHERE k <= 4""")
def set_04(spark, sf_dir):
    """Factual and natural members, at most four each."""
    return ct.inventory(catalogue(spark, sf_dir), "historical", "ssp245", "hist-nat", 4).withColumn("paths", F.array_join("paths", "|"))


@query("set_05_append_missing", "source_id:s experiment_id:s path:s", f"""
WITH {CATALOGUE}, e AS (SELECT source_id, experiment_id, min(path) AS path FROM cat WHERE file_id % 9 = 0 GROUP BY 1, 2), c AS (SELECT source_id, experiment_id, min(path) AS path FROM cat GROUP BY 1, 2)
SELECT * FROM e UNION ALL SELECT c.* FROM c ANTI JOIN e USING (source_id, experiment_id)""")
def set_05(spark, sf_dir):
    """Lookup completed without touching its entries."""
    c = catalogue(spark, sf_dir)
    pick = lambda d: d.groupBy("source_id", "experiment_id").agg(F.min("path").alias("path"))
    return ct.append_missing(pick(c.where("file_id % 9 = 0")), pick(c), ["source_id", "experiment_id"])


KINDS = ["RMSE_#MAX", "RMSE_#MU", "Dev_#MU", "RMSE_#SD", "Dev_#SD", "RMSE_#DISTQ", "RMSE_#SPEC"]
EXPECTED = CATALOGUE + f""", exr AS (SELECT path, m AS metrictype FROM (SELECT path, w, s FROM cat, (SELECT unnest(['1995to1998', '1998to2001']) AS w), (SELECT unnest(['3', '6']) AS s)) q,
  (SELECT unnest({KINDS!r}) AS k UNION ALL SELECT unnest(['RMSE_#DISTQ|MED', 'RMSE_#SPEC|MED', 'RMSE_#DISTQ|WCE', 'RMSE_#SPEC|WCE'])) z,
  LATERAL (SELECT CASE WHEN k LIKE '%|%' THEN 'Reg_' || replace(split_part(k, '|', 1), '#', 'SPEI' || s) || '_' || split_part(k, '|', 2) || '_' || w ELSE 'Map_' || replace(k, '#', 'SPEI' || s) || '_' || w END AS m) l)"""


def expected(spark, sf_dir):
    c = catalogue(spark, sf_dir).select("path", F.array(F.lit("1995to1998"), F.lit("1998to2001")).alias("windows"))
    return ct.expected_records(c, [3, 6], KINDS, ["RMSE_#DISTQ", "RMSE_#SPEC"], ["MED", "WCE"])


@query("set_06_expected_records", "path:s metrictype:s", f"WITH {EXPECTED} SELECT * FROM exr")
def set_06(spark, sf_dir):
    """Expected metric rows of every job."""
    return expected(spark, sf_dir)


@query("join_06_missing_records", "path:s expected:i missing:i all_exist:b", f"""
WITH {EXPECTED}, st AS (SELECT DISTINCT md5(path || metrictype) AS k FROM exr WHERE path LIKE '/archive/building%' OR metrictype LIKE 'Map%')
SELECT path, count(*) AS expected, count(*) FILTER (k IS NULL) AS missing, count(*) FILTER (k IS NULL) = 0 AS all_exist FROM exr LEFT JOIN st ON k = md5(path || metrictype) GROUP BY 1""")
def join_06(spark, sf_dir):
    """Jobs whose records are all stored."""
    e = expected(spark, sf_dir).withColumn("row_key", F.md5(F.concat("path", "metrictype")))
    return ct.missing_records(e, e.where("path LIKE '/archive/building%' OR metrictype LIKE 'Map%'"), ["path"])


@query("set_07_missing_artifacts", "scenario:s missing:s n_missing:i", """
WITH g AS (SELECT DISTINCT c_mktsegment AS scenario FROM customer), v AS (SELECT unnest(['pr', 'tas']) AS variable), r AS (SELECT n_name AS region FROM nation),
p AS (SELECT DISTINCT c_mktsegment AS scenario, CASE WHEN c_custkey % 2 = 0 THEN 'pr' ELSE 'tas' END AS variable, n_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 4000)
SELECT scenario, string_agg(variable || '/' || region, ',' ORDER BY variable || '/' || region) AS missing, count(*) AS n_missing FROM g, v, r WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.scenario = g.scenario AND p.variable = v.variable AND p.region = r.region) GROUP BY 1""")
def set_07(spark, sf_dir):
    """Missing artifacts per scenario."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    j = c.join(n, c.c_nationkey == n.n_nationkey).where("c_acctbal > 4000")
    present = j.select(F.col("c_mktsegment").alias("scenario"), F.when(F.col("c_custkey") % 2 == 0, "pr").otherwise("tas").alias("variable"), F.col("n_name").alias("region"))
    return ct.missing_artifacts(c.select(F.col("c_mktsegment").alias("scenario")), ["pr", "tas"], n.select(F.col("n_name").alias("region")), present)
