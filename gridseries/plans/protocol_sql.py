"""Checking SQL of the composed attribution summary, built from its parts."""

from __future__ import annotations

import re

from gridseries.plans import sqlparts as S
from gridseries.plans.series_plans import edge_sql

REPLICATES = 10_000
LANE = "treatment, method, aggregation, c0, c1"


def _on(chain: str, source: str, prefix: str) -> str:
    """A PET chain over another source table, one series per sid."""
    text = chain.replace("FROM cells", f"FROM {source}").replace("PARTITION BY point_id", "PARTITION BY sid")
    return re.sub(rf"\b{prefix}", f"x{prefix}", text)


def _smooth(src: str, name: str) -> str:
    text = edge_sql(src, "point_id, month", 3, 2, 1)
    for cte in ("rk", "ft", "ex", "sm"):
        text = text.replace(f"{cte} AS (", f"{name}_{cte} AS (").replace(f"FROM {cte} ", f"FROM {name}_{cte} ").replace(f"FROM {cte})", f"FROM {name}_{cte})")
    return text.replace("FROM ft WHERE", f"FROM {name}_ft WHERE").replace("FROM rk GROUP", f"FROM {name}_rk GROUP")


GRID, REGIONAL = "gridcell-spei-area-mean", "regional-water-balance-spei"
BASELINES = "(VALUES (1995, 2000), (1996, 1999)) AS bl(c0, c1)"

SUMMARY = f"""
WITH g0 AS (SELECT CASE l_returnflag WHEN 'N' THEN 'reference' WHEN 'A' THEN 'factual' ELSE 'natural' END AS forcing, CASE WHEN l_returnflag = 'N' THEN 0 ELSE l_linenumber % 3 END AS member,
  l_suppkey % 5 AS point_id, year(l_shipdate) AS year, month(l_shipdate) AS month, avg(l_quantity) AS pr, 273.15 + avg(l_discount) * 300 AS tas, 5 + avg(l_tax) * 50 AS half,
  100 + avg(l_quantity) * 4 AS rsds, 1 + avg(l_tax) * 20 AS "sfcWind", 30 + avg(l_quantity) AS hurs FROM lineitem GROUP BY 1, 2, 3, 4, 5),
g AS (SELECT *, tas - half AS tasmin, tas + half AS tasmax, year * 12 + month - 1 AS month_idx, point_id * 5.0 + 20 AS lat FROM g0),
wt AS (SELECT point_id, cos(radians(lat)) / sum(cos(radians(lat))) OVER () AS weight FROM (SELECT DISTINCT point_id, lat FROM g WHERE forcing = 'reference')),
ra AS (SELECT point_id, month, year, avg(rsds) AS v FROM g WHERE forcing = 'reference' AND year BETWEEN 1995 AND 2000 GROUP BY 1, 2, 3),
ma AS (SELECT point_id, month, year, avg(rsds) AS v FROM g WHERE forcing = 'factual' AND year BETWEEN 1995 AND 2000 GROUP BY 1, 2, 3),
{_smooth("ra", "rr")}, {_smooth("ma", "mm")},
off AS (SELECT point_id, month, year, r.smooth - m.smooth AS o FROM (SELECT * FROM rr_sm WHERE NOT e) r JOIN (SELECT * FROM mm_sm WHERE NOT e) m USING (point_id, month, year)),
treated AS (SELECT *, forcing || member || treatment || point_id AS sid FROM (
  SELECT g.* REPLACE (g.rsds + coalesce(o, 0) AS rsds), 'adjusted' AS treatment FROM g LEFT JOIN off ON off.point_id = g.point_id AND off.month = g.month
    AND off.year = CASE WHEN forcing = 'natural' THEN 1995 ELSE least(greatest(g.year, 1995), 2000) END WHERE forcing <> 'reference'
  UNION ALL SELECT *, 'unadjusted' FROM g WHERE forcing <> 'reference' UNION ALL SELECT *, 'reference' FROM g WHERE forcing = 'reference')),
{_on(S.PENMAN, "treated", "pm_").replace("pm AS (", "xpm AS (", 1)}, {_on(S.THORNTHWAITE, "treated", "th_").replace("th AS (", "xth AS (", 1)},
bal AS (SELECT forcing, member, treatment, point_id, year, month, month_idx, 'penman-monteith' AS method, pr - pet_pm AS wb FROM xpm
  UNION ALL SELECT forcing, member, treatment, point_id, year, month, month_idx, 'hargreaves', pr - {S.HARGREAVES} FROM treated
  UNION ALL SELECT forcing, member, treatment, point_id, year, month, month_idx, 'thornthwaite', pr - pet_th FROM xth),
agg AS (SELECT bal.*, weight, '{GRID}' AS aggregation FROM bal JOIN wt USING (point_id)
  UNION ALL SELECT forcing, member, treatment, -1, year, month, month_idx, method, sum(wb * weight), 1.0, '{REGIONAL}' FROM bal JOIN wt USING (point_id) GROUP BY ALL),
acc AS (SELECT *, CASE WHEN count(wb) OVER f = 12 THEN sum(wb) OVER f END AS acc FROM agg
  WINDOW f AS (PARTITION BY forcing, member, treatment, method, aggregation, point_id ORDER BY month_idx RANGE BETWEEN 11 PRECEDING AND CURRENT ROW)),
dc AS (SELECT * FROM acc, {BASELINES} WHERE month = 12 AND acc IS NOT NULL),
rf AS (SELECT * FROM dc WHERE treatment = 'reference'),
{S.glo_index("rf", "method, aggregation, c0, c1, point_id", "acc", "z", "year BETWEEN c0 AND c1", name="ri")},
th AS (SELECT method, aggregation, c0, c1, sum(z * weight) / sum(weight) AS threshold FROM ri WHERE year = 2000 GROUP BY 1, 2, 3, 4),
ln AS (SELECT * FROM dc WHERE treatment <> 'reference' AND ((c0 = 1995 AND (treatment = 'adjusted' OR aggregation = '{GRID}')) OR (c0 = 1996 AND treatment = 'adjusted' AND aggregation = '{GRID}'))),
ft AS (SELECT *, unnest(['factual', 'natural']) AS target, false AS tf FROM ln WHERE forcing = 'factual' UNION ALL SELECT *, forcing, true FROM ln),
{S.glo_index("ft", f"{LANE}, target, point_id", "acc", "z", "NOT tf AND year BETWEEN c0 AND c1", name="mi")},
va AS (SELECT forcing, member, {LANE}, year, sum(z * weight) / sum(weight) AS value FROM mi WHERE tf AND year BETWEEN 1996 AND 2000 GROUP BY ALL),
iv AS (SELECT va.*, threshold, CASE WHEN value <= threshold THEN 1 ELSE 0 END AS ev, dense_rank() OVER (PARTITION BY forcing, va.treatment, va.method, va.aggregation, va.c0 ORDER BY member) - 1 AS mx, year - 1996 AS yx
  FROM va JOIN th USING (method, aggregation, c0, c1)),
sz AS (SELECT forcing, {LANE}, max(mx) + 1 AS m FROM iv GROUP BY ALL),
sl AS (SELECT *, concat_ws('|', '20260711', 'model-1', treatment, method, aggregation, c0, c1, forcing, rep, slot) AS kt FROM (SELECT *, unnest(range(0, m)) AS slot FROM (SELECT *, unnest(range(1, {REPLICATES + 1})) AS rep FROM sz))),
yr AS (SELECT *, (st + o) % 5 AS yx FROM (SELECT *, {S.hash32("kt")} % m AS mx, {S.hash32("kt || '|0'")} % 5 AS st, unnest([0, 1, 2, 3, 4]) AS o FROM sl)),
dr AS (SELECT forcing, {LANE}, rep, sum(ev) / max(m * 5.0) AS p FROM yr JOIN iv USING (forcing, {LANE}, mx, yx) GROUP BY ALL),
qd AS (SELECT forcing, {LANE}, quantile_cont(p, .025) AS lo, quantile_cont(p, .975) AS hi FROM dr GROUP BY ALL),
pr AS (SELECT forcing, {LANE}, max(threshold) AS threshold, count(DISTINCT member) AS members, sum(ev) AS events, count(*) AS opportunities, avg(CAST(ev AS DOUBLE)) AS estimate FROM iv GROUP BY ALL),
pw AS (SELECT pr.*, CASE WHEN estimate > 0 THEN lo ELSE 0 END AS lower, CASE WHEN estimate > 0 THEN hi ELSE 1 - pow(0.05, 1.0 / members) END AS upper, estimate = 0 AS one_sided FROM pr JOIN qd USING (forcing, {LANE})),
jd AS (SELECT {LANE}, rep, f.p AS pf, CASE WHEN n.p > 0 THEN f.p / n.p END AS r FROM (SELECT * FROM dr WHERE forcing = 'factual') f JOIN (SELECT * FROM dr WHERE forcing = 'natural') n USING ({LANE}, rep)),
jq AS (SELECT {LANE}, quantile_cont(r, .025) AS q1, quantile_cont(r, .05) AS q2, quantile_cont(r, .975) AS q3, avg(CASE WHEN r IS NULL THEN 1.0 ELSE 0.0 END) AS bad, quantile_cont(pf, .05) AS pf5 FROM jd GROUP BY ALL),
rt AS (SELECT {LANE}, q1, q2, q3, pf5, f.estimate AS p1, n.estimate AS p0, n.upper AS nu, n.estimate = 0 OR bad >= 0.025 AS os, n.estimate = 0 AND f.estimate > 0 AS ub
  FROM jq JOIN (SELECT * FROM pw WHERE forcing = 'factual') f USING ({LANE}) JOIN (SELECT * FROM pw WHERE forcing = 'natural') n USING ({LANE}))
SELECT 'probability' AS record_type, 'model-1' AS source, forcing, method, treatment, aggregation, c0 AS baseline_start, members, events, opportunities, threshold, estimate, lower, upper, one_sided FROM pw
UNION ALL SELECT 'probability_ratio', 'model-1', 'factual/natural', method, treatment, aggregation, c0, NULL, NULL, NULL, NULL, CASE WHEN ub THEN 'inf'::DOUBLE WHEN p0 > 0 THEN p1 / p0 END,
  CASE WHEN ub THEN pf5 / nu WHEN os THEN q2 ELSE q1 END, CASE WHEN os THEN 'inf'::DOUBLE ELSE q3 END, os FROM rt"""
