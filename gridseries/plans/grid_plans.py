"""Filters, area statistics, regions and regridding over grid months."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from gridseries.functions import healpix
from gridseries.operators import filters as flt
from gridseries.operators import polygons
from gridseries.operators import spatial as sp
from gridseries.plans.healpix_sql import corners_sql, nested_sql, place_sql, ring_centre_sql
from gridseries.plans.registry import query
from gridseries.plans.views import CELLS, HP_MAP, POINTS, REGION_POINT, cells, hp_map, points, table

COS = "cos(radians(lat))"


def masked(spark, sf_dir):
    """Cells with a gap where little rain fell, to exercise missing values."""
    return cells(spark, sf_dir).withColumn("v", F.when(F.col("pr") >= 100, F.col("tas")))


MASKED = CELLS + ", masked AS (SELECT *, CASE WHEN pr >= 100 THEN tas END AS v FROM cells)"


@query("agg_01_area_mean", "year:i month:i value:d full_weight:d", f"""
WITH {MASKED} SELECT year, month, sum(v * {COS}) / sum(CASE WHEN v IS NOT NULL THEN {COS} END) AS value,
  sum(coalesce(v, 0) * {COS}) / sum({COS}) AS full_weight FROM masked GROUP BY 1, 2""")
def agg_01(spark, sf_dir):
    """Area mean over cells with a value, and the variant that divides by all weights."""
    v, w = F.col("v"), sp.cos_lat(F.col("lat"))
    return masked(spark, sf_dir).groupBy("year", "month").agg(
        sp.weighted_mean(v, w).alias("value"), sp.full_weight_mean(v, w).alias("full_weight")
    )


@query("agg_02_weighted_member_year", "continent:s year:i value:d", f"""
WITH {MASKED}, {POINTS} SELECT continent, year, sum(v * cos(radians(p.lat))) / sum(CASE WHEN v IS NOT NULL THEN cos(radians(p.lat)) END) AS value
FROM masked JOIN points p USING (point_id) GROUP BY 1, 2""")
def agg_02(spark, sf_dir):
    """Renormalised mean per continent and year."""
    rp = points(spark, sf_dir).select(F.col("continent").alias("region_id"), "point_id", sp.cos_lat(F.col("lat")).alias("weight"))
    return sp.region_means(masked(spark, sf_dir), rp, ["year"], "v").withColumnRenamed("region_id", "continent")


@query("agg_03_region_means", "region_id:s year:i month:i value:d", f"""
WITH {MASKED}, {REGION_POINT} SELECT region_id, year, month, sum(v * weight) / sum(CASE WHEN v IS NOT NULL THEN weight END) AS value
FROM masked JOIN region_point USING (point_id) GROUP BY 1, 2, 3""")
def agg_03(spark, sf_dir):
    """Means of all regions at once."""
    return sp.region_means(masked(spark, sf_dir), sp.region_weights(points(spark, sf_dir)), ["year", "month"], "v")


SPECS = [("m1", "NATION_1", "monthly"), ("a1", "NATION_2", "annual"), ("s1", "NATION_3", "scalar"), ("p1", "NATION_4", "points"), ("a2", "NATION_1", "annual")]


@query("agg_04_output_specs", "spec:s kind:s region_id:s year:i month:i point_id:i value:d", f"""
WITH {MASKED}, {REGION_POINT}, specs(spec, region_id, kind) AS (VALUES {", ".join(repr(s) for s in SPECS)}),
t AS (SELECT * FROM masked JOIN region_point USING (point_id) JOIN specs USING (region_id)),
m AS (SELECT spec, kind, region_id, year, month, sum(v * weight) / sum(CASE WHEN v IS NOT NULL THEN weight END) AS value FROM t WHERE kind <> 'points' GROUP BY ALL)
SELECT spec, kind, region_id, year, month, NULL AS point_id, value FROM m WHERE kind = 'monthly'
UNION ALL SELECT spec, kind, region_id, year, NULL, NULL, avg(value) FROM m WHERE kind = 'annual' GROUP BY 1, 2, 3, 4
UNION ALL SELECT spec, kind, region_id, NULL, NULL, NULL, avg(value) FROM m WHERE kind = 'scalar' GROUP BY 1, 2, 3
UNION ALL SELECT spec, kind, region_id, year, month, point_id, v FROM t WHERE kind = 'points'""")
def agg_04(spark, sf_dir):
    """Monthly, annual, scalar and point output for a table of specs."""
    return sp.apply_output_specs(masked(spark, sf_dir), sp.region_weights(points(spark, sf_dir)), SPECS, [], "v")


@query("agg_05_climatology_anomaly", "point_id:i year:i month:i clim:d anom:d", f"""
WITH {CELLS} SELECT *, avg(tas) OVER (PARTITION BY point_id, month) AS clim, tas - avg(tas) OVER (PARTITION BY point_id, month) AS anom FROM cells""")
def agg_05(spark, sf_dir):
    """Monthly climatology and anomalies."""
    from gridseries.operators.ensemble import anomalies

    return anomalies(cells(spark, sf_dir), ["point_id"], "tas", "anom", "clim")


@query("agg_39_zonal_means", "band:i value:d", f"""
WITH {CELLS} SELECT CAST(floor((lat + 90) / 15) AS BIGINT) + 1 AS band, avg(tas) AS value FROM cells GROUP BY 1""")
def agg_39(spark, sf_dir):
    """Means of twelve latitude bands."""
    return sp.zonal_means(cells(spark, sf_dir), [], "tas", 12)


@query("agg_40_healpix_pool", "map_id:s pix:i value:d", f"""
WITH {HP_MAP} SELECT map_id, pix >> 4 AS pix, avg(value) AS value FROM hp GROUP BY 1, 2""")
def agg_40(spark, sf_dir):
    """Pooling from nside 8 to nside 2."""
    return sp.healpix_pool(hp_map(spark, sf_dir), ["map_id"], "value", 8, 2)


RING = f"""ringed AS (SELECT map_id, value, face, ix, iy FROM ({place_sql(f"({ring_centre_sql('hp', 8, 'map_id, pix, value', 'pix')})", 8, "map_id, value", "clat", "clon")})),
pooled AS (SELECT map_id, face * 4 + ((ix >> 2) & 1) + 2 * ((iy >> 2) & 1) AS nested, avg(value) AS value FROM ringed GROUP BY 1, 2),
low AS (SELECT pix, face * 4 + (ix & 1) + 2 * (iy & 1) AS nested FROM ({place_sql(f"({ring_centre_sql('(SELECT unnest(range(48)) AS pix)', 2, 'pix', 'pix')})", 2, "pix", "clat", "clon")}))"""


@query("agg_40_healpix_pool_ring", "map_id:s pix:i value:d", f"""
WITH {HP_MAP}, {RING} SELECT map_id, pix, value FROM pooled JOIN low USING (nested)""")
def agg_40_ring(spark, sf_dir):
    """Pooling of ring-ordered maps from nside 8 to nside 2, by arithmetic alone."""
    return sp.healpix_pool(hp_map(spark, sf_dir), ["map_id"], "value", 8, 2, order="ring")


@query("agg_41_coarsen", "year:i bi:d bj:d value:d", f"""
WITH {CELLS}, g AS (SELECT year, lat / 2 AS lat, lon / 2 AS lon, avg(CASE WHEN pr >= 100 THEN tas END) AS v FROM cells GROUP BY 1, 2, 3),
o AS (SELECT min(lat) AS a0, min(lon) AS o0, max(lat) AS a1, max(lon) AS o1 FROM g),
b AS (SELECT *, floor(round((lat - a0) / 0.5) / 2) AS i, floor(round((lon - o0) / 0.5) / 2) AS j,
  floor((round((a1 - a0) / 0.5) + 1) / 2) AS ni, floor((round((o1 - o0) / 0.5) + 1) / 2) AS nj FROM g, o)
SELECT year, round_even(a0 + i + 0.25, 0) AS bi, round_even(o0 + j + 0.25, 0) AS bj,
  sum(coalesce(v, 0) * {COS}) / (2 * (cos(radians(a0 + i)) + cos(radians(a0 + i + 0.5)))) AS value
FROM b WHERE i < ni AND j < nj GROUP BY year, i, j, a0, o0""")
def agg_41(spark, sf_dir):
    """Half-degree cells to one degree; missing cells count with weight."""
    g = masked(spark, sf_dir).groupBy("year", (F.col("lat") / 2).alias("lat"), (F.col("lon") / 2).alias("lon")).agg(F.avg("v").alias("v"))
    return sp.coarsen(g, ["year"], "v").select("year", F.col("lat").alias("bi"), F.col("lon").alias("bj"), F.col("v").alias("value"))


@query("agg_42_regrid", "dst:i year:i month:i value:d", f"""
WITH {CELLS}, w AS (SELECT s_suppkey AS src, s_nationkey AS dst, 0.5 + (s_suppkey % 7) / 10.0 AS w FROM supplier
  UNION ALL SELECT s_suppkey, (s_nationkey + 1) % 25, 0.5 - (s_suppkey % 7) / 20.0 FROM supplier)
SELECT dst, year, month, sum(w * tas) / sum(w) AS value FROM cells JOIN w ON point_id = src GROUP BY 1, 2, 3""")
def agg_42(spark, sf_dir):
    """Normalised sparse product with a weight table of two targets per source."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    near = s.select(k.alias("src"), F.col("s_nationkey").alias("dst"), (0.5 + (k % 7) / 10.0).alias("w"))
    far = s.select(k.alias("src"), ((F.col("s_nationkey") + 1) % 25).alias("dst"), (0.5 - (k % 7) / 20.0).alias("w"))
    return sp.regrid(cells(spark, sf_dir), near.unionByName(far), ["year", "month"], "tas", normalise=True).withColumnRenamed("tas", "value")


@query("agg_42_bilinear_weights", "dst:i src:i w:d", f"""
WITH {POINTS}, d AS (SELECT point_id AS dst, lat + 0.3 AS lat, lon + 0.45 AS lon FROM points),
f AS (SELECT dst, least(greatest((lat + 60) / 2, 0), 60.0) AS y, fmod(lon, 360) / 2 AS x FROM d),
c AS (SELECT dst, x, y, a, b FROM f, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS v(a, b))
SELECT dst, CAST(least(floor(y) + a, 60) * 180 + (floor(x) + b) % 180 AS BIGINT) AS src,
  sum((CASE WHEN a = 0 THEN 1 - (y - floor(y)) ELSE y - floor(y) END) * (CASE WHEN b = 0 THEN 1 - (x - floor(x)) ELSE x - floor(x) END)) AS w
FROM c GROUP BY 1, 2 HAVING w > 0""")
def agg_42_weights(spark, sf_dir):
    """Bilinear weights of shifted points on a cyclic two-degree grid."""
    d = points(spark, sf_dir).select(F.col("point_id").alias("dst"), (F.col("lat") + 0.3).alias("lat"), (F.col("lon") + 0.45).alias("lon"))
    return sp.bilinear_weights(d, 2.0, -60.0, 0.0, 61, 180)


@query("agg_44_cell_areas", "lat:d area_km2:d", f"""
WITH {POINTS}, a AS (SELECT DISTINCT lat FROM points), b AS (SELECT *, lag(lat) OVER (ORDER BY lat) AS p, lead(lat) OVER (ORDER BY lat) AS n FROM a),
c AS (SELECT lat, greatest(coalesce((lat + p) / 2, lat - (n - lat) / 2), -90) AS lo, least(coalesce((lat + n) / 2, lat + (lat - p) / 2), 90) AS hi FROM b)
SELECT lat, 6371000.0 * 6371000.0 * abs(sin(radians(hi)) - sin(radians(lo))) * radians(1) / 1e6 AS area_km2 FROM c""")
def agg_44(spark, sf_dir):
    """Areas of one-degree-wide cells for the latitudes in use."""
    axis = points(spark, sf_dir).select("lat").distinct()
    return sp.cell_areas(axis).withColumn("area_km2", F.col("area_m2") / 1e6)


@query("flt_01_period_months", "point_id:i year:i month:i tas:d",
       f"WITH {CELLS} SELECT * FROM cells WHERE year BETWEEN 1997 AND 1999 AND month IN (6, 7, 8)")
def flt_01(spark, sf_dir):
    """Summers of three years."""
    return cells(spark, sf_dir, (1997, 1999)).where(flt.period_months((1997, 1999), [6, 7, 8]))


@query("flt_02_baseline_years", "point_id:i month:i mu:d n:i", f"""
WITH {CELLS} SELECT point_id, month, avg(pr) FILTER (year BETWEEN 1996 AND 1998) AS mu, count(pr) FILTER (year BETWEEN 1996 AND 1998) AS n FROM cells GROUP BY 1, 2""")
def flt_02(spark, sf_dir):
    """Baseline restriction inside an aggregate."""
    v = flt.baseline_only(F.col("pr"), (1996, 1998))
    return cells(spark, sf_dir).groupBy("point_id", "month").agg(F.avg(v).alias("mu"), F.count(v).alias("n"))


@query("flt_03_finite_rows", "event_id:i value:d k:d", """
SELECT * FROM (SELECT event_id, value, TRY_CAST(CASE WHEN event_id % 11 = 0 THEN 'NaN' WHEN event_id % 13 = 0 THEN 'n/a'
  WHEN event_id % 17 = 0 THEN 'inf' ELSE regexp_extract(props, '[0-9]+') END AS DOUBLE) AS k FROM events) WHERE isfinite(k) AND isfinite(value)""")
def flt_03(spark, sf_dir):
    """Text column with NaN, infinity and non-numbers."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    text = F.when(i % 11 == 0, "NaN").when(i % 13 == 0, "n/a").when(i % 17 == 0, "Infinity").otherwise(F.regexp_extract("props", "[0-9]+", 0))
    return flt.finite_rows(e.withColumn("k", text), "value", "k")


@query("flt_04_off_diagonal", "point_id:i year:i month:i", f"""
WITH {CELLS} SELECT * FROM cells WHERE abs(pet - pr) > 0.2 * greatest(abs(pr), abs(pet), 1)""")
def flt_04(spark, sf_dir):
    """Months whose supply and demand differ by more than a fifth."""
    return cells(spark, sf_dir).where(flt.off_diagonal(F.col("pr"), F.col("pet"), 0.2))


@query("flt_10_box", "point_id:i lat:d lon:d", f"""
WITH {POINTS} SELECT * FROM points WHERE lat BETWEEN -30 AND 30 AND (lon >= 340 OR lon <= 40)""")
def flt_10(spark, sf_dir):
    """Box across the zero meridian, given in the other convention."""
    return points(spark, sf_dir).where(sp.box(F.col("lat"), F.col("lon"), -30, 30, -20, 40))


@query("flt_11_complete_years", "point_id:i year:i month:i pr:d", f"""
WITH {CELLS}, g AS (SELECT point_id, year FROM cells GROUP BY 1, 2 HAVING count(*) = 12 AND count(DISTINCT month) = 12)
SELECT cells.* FROM cells SEMI JOIN g USING (point_id, year)""")
def flt_11(spark, sf_dir):
    """Years with all twelve months."""
    return flt.complete_years(cells(spark, sf_dir), ["point_id"])


@query("flt_12_event_month", "point_id:i year:i pr:d", f"WITH {CELLS} SELECT * FROM cells WHERE month = 12")
def flt_12(spark, sf_dir):
    """December value per year, guarded against duplicates."""
    return flt.event_month(cells(spark, sf_dir), ["point_id"], "pr")


@query("flt_13_complete_window", "point_id:i year:i pr:d", f"""
WITH {CELLS} SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY point_id) AS n FROM cells WHERE month = 12 AND year BETWEEN 1995 AND 2000) WHERE n = 6""")
def flt_13(spark, sf_dir):
    """December series that cover the whole window."""
    dec = cells(spark, sf_dir).where("month = 12")
    return flt.complete_window(dec, ["point_id"], (1995, 2000), strict=False)


@query("join_08_nearest_on_grid", "template_id:i point_id:i", f"""
WITH {POINTS}, t AS (SELECT point_id AS template_id, lat + 1.2 AS tlat, lon - 0.7 AS tlon FROM points),
d AS (SELECT template_id, point_id, lat - tlat AS y, abs(lon - fmod(tlon + 360, 360)) AS x FROM points, t),
j AS (SELECT template_id, point_id, row_number() OVER (PARTITION BY template_id ORDER BY round(y ** 2 + least(x, 360 - x) ** 2, 9), point_id) AS r FROM d)
SELECT * FROM j WHERE r = 1""")
def join_08(spark, sf_dir):
    """Nearest source point of every template point."""
    p = points(spark, sf_dir)
    t = p.select(F.col("point_id").alias("template_id"), (F.col("lat") + 1.2).alias("lat"), (F.col("lon") - 0.7).alias("lon"))
    return sp.nearest_on_grid(p, t, 4.0)


@query("join_11_polygon_mask", "region_id:s point_id:i", f"""
WITH {POINTS}, e AS (SELECT 'n' || n_nationkey AS region_id, 10 + n_nationkey * 11 AS x0, -58 + n_nationkey AS y0, 60 + n_nationkey * 3 AS sz FROM nation)
SELECT e.region_id, point_id FROM points JOIN e ON lat >= y0 AND lat < y0 + sz
 AND lon < x0 + sz - (lat - y0) / 2 AND NOT lon < x0 + (lat - y0) / 2
QUALIFY count(*) OVER (PARTITION BY e.region_id) >= 3""")
def join_11(spark, sf_dir):
    """Points inside trapezoids given by their edges; small regions dropped."""
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    x0, y0, sz = 10.0 + k * 11, -58.0 + k, 60.0 + k * 3
    ring = [(x0, y0), (x0 + sz, y0), (x0 + sz / 2, y0 + sz), (x0 + sz / 2, y0 + sz), (x0, y0)]
    sides = [F.struct(a[0].alias("x1"), a[1].alias("y1"), b[0].alias("x2"), b[1].alias("y2")) for a, b in zip(ring, ring[1:], strict=False)]
    edges = n.select(F.concat(F.lit("n"), k.cast("string")).alias("region_id"), F.inline(F.array(*sides)))
    return sp.polygon_mask(points(spark, sf_dir), edges, min_cells=3)


#: Trapezoids with a hole, some of them across the seam of longitudes: offsets and sizes of the outer ring, share of the inner.
RINGS = [(0.0, 1.0), (0.3, 0.4)]


def ring_corners(x0, y0, size, inset, share, number=float):
    x, y, s = x0 + inset * size, y0 + inset * size, share * size
    ring = [(x, y), (x + s, y), (x + s * number(0.5), y + s), (x + s * number(0.25), y + s), (x, y)]
    return list(zip(ring, ring[1:], strict=False))


def _sql_edges():
    parts = []
    for inset, share in RINGS:
        x, y, s = f"(x0 + {inset} * sz)", f"(y0 + {inset} * sz)", f"({share} * sz)"
        ring = [(x, y), (f"({x} + {s})", y), (f"({x} + {s} * 0.5)", f"({y} + {s})"), (f"({x} + {s} * 0.25)", f"({y} + {s})"), (x, y)]
        parts += [f"SELECT region_id, {a[0]} AS x1, {a[1]} AS y1, {b[0]} AS x2, {b[1]} AS y2 FROM e" for a, b in zip(ring, ring[1:], strict=False)]
    return " UNION ALL ".join(parts)


@query("join_11_polygon_cover", "region_id:s point_id:i", f"""
WITH {POINTS}, e AS (SELECT 'n' || n_nationkey AS region_id, 10.3 + n_nationkey * 13 AS x0, -58.2 + n_nationkey AS y0, 60.0 + n_nationkey * 2 AS sz FROM nation),
edges AS ({_sql_edges()}), turned AS (SELECT point_id, lat, lon + t AS lon FROM points, (VALUES (0), (360), (-360)) v(t)),
hit AS (SELECT region_id, point_id, lon, count(*) AS n FROM turned JOIN edges ON lat >= least(y1, y2) AND lat < greatest(y1, y2) AND lon < x1 + (lat - y1) * (x2 - x1) / (y2 - y1) GROUP BY 1, 2, 3)
SELECT DISTINCT region_id, point_id FROM hit WHERE n % 2 = 1""")
def join_11_cover(spark, sf_dir):
    """Points inside polygons with holes, some across the seam, by a quadtree cover.

    Corners are decimals, as in the SQL, so that positions on an edge fall on the same side.
    """
    k, number = F.col("n_nationkey"), lambda x: F.lit(Decimal(str(x)))
    x0, y0, size = number(10.3) + k * 13, number(-58.2) + k, number(60.0) + k * 2
    corners = [pair for inset, share in RINGS for pair in ring_corners(x0, y0, size, number(inset), number(share), number)]
    sides = [F.struct(*[c.cast("decimal(18,6)").alias(n) for c, n in zip((*a, *b), ("x1", "y1", "x2", "y2"), strict=True)]) for a, b in corners]
    edges = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), k.cast("string")).alias("region_id"), F.inline(F.array(*sides)))
    return polygons.locate(points(spark, sf_dir), edges, cell=2.0)


@query("join_12_neighbourhood", "i:i j:i group_mean:d group_size:i", f"""
WITH {POINTS}, g AS (SELECT CAST(floor((lat + 60) / 10) AS BIGINT) AS i, CAST(floor(lon / 20) AS BIGINT) AS j, avg(lat + lon / 3) AS v FROM points GROUP BY 1, 2)
SELECT a.i, a.j, avg(b.v) AS group_mean, count(b.v) AS group_size FROM g a JOIN g b ON abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 GROUP BY 1, 2""")
def join_12(spark, sf_dir):
    """Mean of the nine cells around each cell, edges cut."""
    g = points(spark, sf_dir).groupBy(
        F.floor((F.col("lat") + 60) / 10).alias("i"), F.floor(F.col("lon") / 20).alias("j")
    ).agg(F.avg(F.col("lat") + F.col("lon") / 3).alias("v"))
    return sp.neighbourhood_mean(g, [], "v", 1)


@query("join_13_nearest_on_sphere", "point_id:i neighbour_id:i rank:i", f"""
WITH {POINTS}, u AS (SELECT DISTINCT lat, lon, min(point_id) OVER (PARTITION BY lat, lon) AS point_id FROM points),
x AS (SELECT point_id, cos(radians(lat)) * cos(radians(lon)) AS x, cos(radians(lat)) * sin(radians(lon)) AS y, sin(radians(lat)) AS z FROM u),
r AS (SELECT a.point_id, b.point_id AS neighbour_id, row_number() OVER (PARTITION BY a.point_id ORDER BY round(1 - (a.x * b.x + a.y * b.y + a.z * b.z), 12), b.point_id) AS rank FROM x a, x b)
SELECT * FROM r WHERE rank <= 4""")
def join_13(spark, sf_dir):
    """Four nearest points of each distinct position."""
    u = points(spark, sf_dir).groupBy("lat", "lon").agg(F.min("point_id").alias("point_id"))
    return sp.nearest_on_sphere(u, 4, 20.0)


@query("join_19_regional_subset", "region_id:s point_id:i year:i month:i tas:d", f"""
WITH {CELLS}, {POINTS} SELECT region_id, point_id, year, month, tas FROM cells JOIN points USING (point_id)""")
def join_19(spark, sf_dir):
    """World table cut into regions in one join."""
    return cells(spark, sf_dir).join(sp.broadcast_if_small(points(spark, sf_dir).select("region_id", "point_id")), "point_id")


@query("arr_02_lon_wrap", "point_id:i lon360:d lon180:d", f"""
WITH {POINTS} SELECT point_id, fmod(lon - 200 + 360, 360) AS lon360, CASE WHEN fmod(lon - 200 + 360, 360) >= 180 THEN fmod(lon - 200 + 360, 360) - 360 ELSE fmod(lon - 200 + 360, 360) END AS lon180 FROM points
UNION ALL SELECT point_id, lon + 360, NULL FROM points WHERE lon = (SELECT min(lon) FROM points)""")
def arr_02(spark, sf_dir):
    """Both longitude conventions, and the closing meridian."""
    p = points(spark, sf_dir)
    shifted = F.col("lon") - 200
    wrapped = p.select("point_id", sp.wrap_lon(shifted).alias("lon360"), sp.wrap_lon(shifted, "-180-180").alias("lon180"))
    edge = sp.add_cyclic(p.select("point_id", "lon")).where("lon >= 360")
    return wrapped.unionByName(edge.select("point_id", F.col("lon").alias("lon360"), F.lit(None).cast("double").alias("lon180")))


@query("arr_03_healpix_lookup", "point_id:i map_id:s pix:i value:d", f"""
WITH {POINTS}, {HP_MAP} SELECT point_id, map_id, pix, value FROM points JOIN hp ON pix = (CAST(lat AS BIGINT) + 60) * 6 + CAST(lon AS BIGINT) // 60""")
def arr_03(spark, sf_dir):
    """Map values at points through a prepared position table."""
    p = points(spark, sf_dir)
    pix = (F.col("lat") + 60) * 6 + F.floor(F.col("lon") / 60)
    lookup = p.select("lat", "lon", pix.cast("bigint").alias("pix")).distinct()
    return sp.healpix_lookup(p.select("point_id", "lat", "lon"), lookup, hp_map(spark, sf_dir), ["point_id", "map_id"], "value")


#: Positions off the borders between pixels, on which integer degrees lie.
SHIFTED = POINTS + ", moved AS (SELECT point_id, lat * 1.45 + 0.123 AS lat, lon - 180.0457 AS lon FROM points)"


def moved(spark, sf_dir):
    return points(spark, sf_dir).select("point_id", (F.col("lat") * 1.45 + 0.123).alias("lat"), (F.col("lon") - 180.0457).alias("lon"))


@query("arr_03_healpix_pixels", "point_id:i nested:i ring:i", f"""
WITH {SHIFTED}, placed AS ({place_sql("moved", 64, "point_id, lat, lon")}),
nest AS (SELECT point_id, lat, lon, {nested_sql(64)} AS nested, face, ix, iy FROM placed),
rings AS (SELECT pix, {nested_sql(64)} AS nested FROM ({place_sql(f"({ring_centre_sql(f'(SELECT unnest(range({12 * 64 * 64})) AS pix)', 64, 'pix', 'pix')})", 64, "pix", "clat", "clon")}))
SELECT point_id, nested, pix AS ring FROM nest JOIN rings USING (nested)""")
def arr_03_pixels(spark, sf_dir):
    """Pixel of every position at nside 64 in both orders, without a lookup table."""
    nested = healpix.add_pixel(moved(spark, sf_dir), 64, out="nested")
    return healpix.to_ring(nested, 64, "nested", "ring")


@query("arr_03_healpix_values", "point_id:i map_id:s pix:i value:d", f"""
WITH {SHIFTED}, {HP_MAP}, placed AS ({place_sql("moved", 8, "point_id")}), nest AS (SELECT point_id, {nested_sql(8)} AS pix FROM placed)
SELECT point_id, map_id, pix, value FROM nest JOIN hp USING (pix)""")
def arr_03_values(spark, sf_dir):
    """Nearest map value at every position."""
    return sp.healpix_values(moved(spark, sf_dir), hp_map(spark, sf_dir), 8, ["point_id", "map_id"], "value")


@query("arr_03_healpix_neighbours", "map_id:s pix:i smooth:d n:i", f"""
WITH {HP_MAP}, corners AS MATERIALIZED ({corners_sql(8)}),
near AS (SELECT DISTINCT a.pix, b.pix AS other FROM corners a JOIN corners b USING (corner))
SELECT map_id, near.pix, avg(o.value) AS smooth, count(o.value) AS n FROM hp JOIN near USING (pix) JOIN hp o USING (map_id) WHERE o.pix = near.other GROUP BY 1, 2""")
def arr_03_neighbours(spark, sf_dir):
    """Maps smoothed over the pixels that touch each pixel."""
    return sp.healpix_smooth(hp_map(spark, sf_dir), ["map_id"], "value", 8)
