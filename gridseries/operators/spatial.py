"""Area weights, regions, coarsening, pooling and regridding on point tables.

Reductions are plain ``groupBy`` sums, so a region or pixel that holds a large
share of the rows is combined map-side before the shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridseries.functions import healpix
from gridseries.functions.quantiles import broadcast_if_small
from gridseries.session import cut_lineage

EARTH_RADIUS_M = 6_371_000.0


def cos_lat(lat: Column) -> Column:
    return F.cos(F.radians(lat))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Aggregate: mean over rows that hold a value, weights renormalised."""
    present = F.when(value.isNotNull(), weight)
    den = F.sum(present)
    return F.when(den > 0, F.sum(value * weight) / den)


def full_weight_mean(value: Column, weight: Column) -> Column:
    """Aggregate: missing values count as zero, all weights divide."""
    den = F.sum(weight)
    return F.when(den > 0, F.sum(F.coalesce(value, F.lit(0.0)) * weight) / den)


def area_mean(df: DataFrame, keys: list[str], value: str, lat: str = "lat", out: str = "value", full_weight: bool = False) -> DataFrame:
    """cos(lat)-weighted mean per key."""
    mean = full_weight_mean if full_weight else weighted_mean
    return df.groupBy(*keys).agg(mean(F.col(value), cos_lat(F.col(lat))).alias(out))


def region_weights(points: DataFrame, region: str = "region_id", point: str = "point_id", lat: str = "lat") -> DataFrame:
    """cos(lat) weights normalised to one per region."""
    raw = points.select(region, point, cos_lat(F.col(lat)).alias("_w"))
    total = raw.groupBy(region).agg(F.sum("_w").alias("_total"))
    return raw.join(broadcast_if_small(total), region).select(region, point, (F.col("_w") / F.col("_total")).alias("weight"))


def region_means(df: DataFrame, region_point: DataFrame, keys: list[str], value: str, out: str = "value", point: str = "point_id") -> DataFrame:
    """Renormalised weighted mean per region and key, for all regions at once."""
    joined = df.join(broadcast_if_small(region_point), point)
    return joined.groupBy("region_id", *keys).agg(weighted_mean(F.col(value), F.col("weight")).alias(out))


def apply_output_specs(df: DataFrame, region_point: DataFrame, specs: list[tuple[str, str, str]], series: list[str], value: str) -> DataFrame:
    """Rows of (spec, kind, region, year, month, value) for (name, region, kind) specs.

    Kinds: ``monthly`` and ``annual`` mean, ``scalar`` over all months, ``points``
    raw rows. One pass per kind covers all its specs; the specs table is a plan
    constant.
    """
    spark = df.sparkSession
    table = spark.createDataFrame(specs, "spec string, region_id string, kind string")
    tagged = df.join(broadcast_if_small(region_point), "point_id").join(F.broadcast(table), "region_id")
    cols = ["spec", "kind", "region_id", *series, "year", "month", "point_id", "value"]

    def shaped(part: DataFrame, **missing) -> DataFrame:
        return part.select(*[F.lit(None).cast(missing[c]).alias(c) if c in missing else F.col(c) for c in cols])

    mean = weighted_mean(F.col(value), F.col("weight")).alias("value")
    base = ["spec", "kind", "region_id", *series]
    monthly_rows = tagged.where("kind in ('monthly', 'annual', 'scalar')").groupBy(*base, "year", "month").agg(mean)
    monthly = shaped(monthly_rows.where("kind = 'monthly'"), point_id="bigint")
    annual = shaped(
        monthly_rows.where("kind = 'annual'").groupBy(*base, "year").agg(F.avg("value").alias("value")),
        point_id="bigint", month="int",
    )
    scalar = shaped(
        monthly_rows.where("kind = 'scalar'").groupBy(*base).agg(F.avg("value").alias("value")),
        point_id="bigint", month="int", year="int",
    )
    raw = tagged.where("kind = 'points'").withColumn("value", F.col(value)).select(*cols)
    return monthly.unionByName(annual).unionByName(scalar).unionByName(raw)


def zonal_means(df: DataFrame, keys: list[str], value: str, bands: int, lat: str = "lat") -> DataFrame:
    """Mean per latitude band of equal width; empty bands are absent."""
    band = F.width_bucket(F.col(lat), F.lit(-90.0), F.lit(90.0), F.lit(bands))
    return df.withColumn("band", band).groupBy(*keys, "band").agg(F.avg(value).alias("value"))


def healpix_pool(df: DataFrame, keys: list[str], value: str, nside_hi: int, nside_lo: int, pix: str = "pix", order: str = "nested", ring_lookup: DataFrame | None = None) -> DataFrame:
    """Average pooling to a lower resolution; the result is numbered in the same order.

    A nested parent is the pixel number without its last bits, so no pooling
    matrix is needed. Ring numbers are turned into nested ones by arithmetic, or
    by a prepared (pix, nested) table, after which the parents are nested.
    """
    levels = int(round(math.log2(nside_hi / nside_lo)))
    if nside_lo * 2**levels != nside_hi:
        raise ValueError("resolutions must differ by a power of two")
    nested = F.col(pix)
    if ring_lookup is not None:
        df = df.join(broadcast_if_small(ring_lookup), pix)
        nested = F.col("nested")
    elif order == "ring":
        df = healpix.to_nested(df, nside_hi, pix, "_nested")
        nested = F.col("_nested")
    parent = F.shiftright(nested.cast("bigint"), 2 * levels)
    pooled = df.groupBy(*keys, parent.alias(pix)).agg(F.avg(value).alias(value))
    return healpix.to_ring(pooled, nside_lo, pix, pix) if ring_lookup is None and order == "ring" else pooled


def coarsen(df: DataFrame, keys: list[str], value: str, step: float = 0.5, factor: int = 2, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """cos(lat)-weighted block mean of a regular grid.

    Blocks are counted from the smallest coordinate and incomplete blocks at the
    far edges are trimmed. A missing value counts as zero: the weight of every
    cell of the block divides. Block centres are rounded half-even to integers.
    """
    origin = df.agg(F.min(lat).alias("_lat0"), F.min(lon).alias("_lon0"), F.max(lat).alias("_lat1"), F.max(lon).alias("_lon1"))
    gridded = df.join(F.broadcast(origin))  # one row

    def index(c, c0):
        return F.round((F.col(c) - F.col(c0)) / step).cast("bigint")

    staged = gridded.withColumns({
        "_bi": F.floor(index(lat, "_lat0") / factor), "_bj": F.floor(index(lon, "_lon0") / factor),
        "_ni": F.floor((index("_lat1", "_lat0") + 1) / factor), "_nj": F.floor((index("_lon1", "_lon0") + 1) / factor),
    })
    kept = staged.where((F.col("_bi") < F.col("_ni")) & (F.col("_bj") < F.col("_nj")))
    sums = kept.groupBy(*keys, "_bi", "_bj", "_lat0", "_lon0").agg(
        F.sum(F.coalesce(F.col(value), F.lit(0.0)) * cos_lat(F.col(lat))).alias("_num")
    )
    south = F.col("_lat0") + F.col("_bi") * (factor * step)
    west = F.col("_lon0") + F.col("_bj") * (factor * step)
    weight = sum((cos_lat(south + r * step) for r in range(factor)), F.lit(0.0)) * factor
    half = (factor - 1) * step / 2.0
    return sums.select(
        *keys, F.bround(south + half).alias(lat), F.bround(west + half).alias(lon),
        F.when(weight > 0, F.col("_num") / weight).alias(value),
    )


def regrid(df: DataFrame, weights: DataFrame, keys: list[str], value: str, src: str = "src", dst: str = "dst", w: str = "w", normalise: bool = False) -> DataFrame:
    """Sparse-matrix product: destination = sum over sources of w*value."""
    joined = df.withColumnRenamed("point_id", src).join(broadcast_if_small(weights), src)
    total = F.sum(F.col(w) * F.col(value))
    if normalise:
        den = F.sum(F.when(F.col(value).isNotNull(), F.col(w)))
        total = F.when(den != 0, total / den)
    return joined.groupBy(*keys, dst).agg(total.alias(value))


def bilinear_weights(dst: DataFrame, step: float, lat0: float, lon0: float, n_lat: int, n_lon: int) -> DataFrame:
    """(src, dst, w) of the four cells around each target on a regular grid.

    Source cells are numbered row by row; the grid is cyclic in longitude and
    clamped in latitude. Four rows per target, no join.
    """
    y = (F.col("lat") - lat0) / step
    x = F.pmod(F.col("lon") - lon0, F.lit(360.0)) / step
    staged = dst.withColumns({"_y": F.least(F.greatest(y, F.lit(0.0)), F.lit(float(n_lat - 1))), "_x": x})
    fy, fx = F.col("_y") - F.floor("_y"), F.col("_x") - F.floor("_x")
    corners = []
    for dy, wy in ((0, 1 - fy), (1, fy)):
        for dx, wx in ((0, 1 - fx), (1, fx)):
            row = F.least(F.floor("_y") + dy, F.lit(n_lat - 1))
            col = F.pmod(F.floor("_x") + dx, F.lit(n_lon))
            corners.append(F.struct((row * n_lon + col).cast("bigint").alias("src"), (wy * wx).alias("w")))
    out = staged.select(F.col("dst"), F.explode(F.array(*corners)).alias("c")).select("dst", "c.src", "c.w")
    return out.where("w > 0").groupBy("src", "dst").agg(F.sum("w").alias("w"))


def cell_areas(axis: DataFrame, lat: str = "lat", dlon_deg: float = 1.0, keys: list[str] | None = None) -> DataFrame:
    """Cell area per latitude row; bounds half-way to the neighbours, poles capped."""
    keys = keys or []
    w = Window.partitionBy(*keys).orderBy(lat)
    before, after = F.lag(lat).over(w), F.lead(lat).over(w)
    lower = F.coalesce((F.col(lat) + before) / 2, F.col(lat) - (after - F.col(lat)) / 2)
    upper = F.coalesce((F.col(lat) + after) / 2, F.col(lat) + (F.col(lat) - before) / 2)
    lower, upper = F.greatest(lower, F.lit(-90.0)), F.least(upper, F.lit(90.0))
    area = EARTH_RADIUS_M**2 * F.abs(F.sin(F.radians(upper)) - F.sin(F.radians(lower))) * math.radians(dlon_deg)
    return axis.withColumns({"lat_lower": lower, "lat_upper": upper, "area_m2": area})


def wrap_lon(lon: Column, convention: str = "0-360") -> Column:
    """Longitude in 0..360 or -180..180."""
    east = F.pmod(lon, F.lit(360.0))
    return east if convention == "0-360" else F.when(east >= 180.0, east - 360.0).otherwise(east)


def add_cyclic(df: DataFrame, lon: str = "lon") -> DataFrame:
    """Repeat the first meridian at +360 so that maps close."""
    first = df.agg(F.min(lon).alias("_first"))
    edge = df.join(F.broadcast(first), df[lon] == F.col("_first")).drop("_first").withColumn(lon, F.col(lon) + 360.0)
    return df.unionByName(edge)


def box(lat: Column, lon: Column, lat_min: float, lat_max: float, lon_min: float, lon_max: float) -> Column:
    """Predicate of a lat/lon box in either longitude convention, also across 0."""
    lo, hi = lon_min % 360.0, lon_max % 360.0
    east = F.pmod(lon, F.lit(360.0))
    inside = east.between(lo, hi) if lo <= hi else (east >= lo) | (east <= hi)
    return lat.between(lat_min, lat_max) & inside


#: Sources that the mean source may have in its first cell, and the least side of a cell in degrees.
CROWD, SMALLEST_CELL = 8.0, 0.01


def _grid_cell(size: float, n_lon: int):
    """Row and column of a position in cells of ``size`` degrees, ``n_lon`` of them in a row."""
    return (
        lambda c: F.floor((F.col(c) + 90.0) / size),
        lambda c: F.least(F.floor(F.col(c) / (360.0 / n_lon)), F.lit(n_lon - 1)),
    )


def first_cell(sources: DataFrame, size: float) -> float:
    """``size``, or a quarter of it as often as needed for the mean source to share its cell with few."""
    while size > SMALLEST_CELL:
        row, column = _grid_cell(size, max(1, int(360.0 // size)))
        n = F.col("n").cast("double")
        shared = sources.groupBy(row("_lat"), column("_lon")).agg(F.count(F.lit(1)).alias("n")).agg((F.sum(n * n) / F.sum(n)).alias("n")).first()["n"]
        if (shared or 0) <= CROWD:
            break
        size /= 4.0
    return size


def nearest_on_grid(df: DataFrame, template: DataFrame, step: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Source point nearest to each template point in latitude and longitude, for any grid origin.

    Both sides are hashed to cells of ``step`` degrees and each template point
    meets the nine cells around it, across the 0/360 seam as well. A nearest
    point farther than a cell may not be the nearest; such template points are
    tried again with four times the cell, so every one is answered. Ties go to
    the smaller point, so of points at one position only that one is a source.
    The first cell is ``step`` or narrower, so that a source shares it with few.
    """
    sources = df.select("point_id", F.col(lat).alias("_lat"), F.pmod(F.col(lon), F.lit(360.0)).alias("_lon")).where("_lat IS NOT NULL AND _lon IS NOT NULL")
    sources = cut_lineage(sources.groupBy("_lat", "_lon").agg(F.min("point_id").alias("point_id")))
    open_ = template.select("template_id", F.col(lat).alias("_tlat"), F.pmod(F.col(lon), F.lit(360.0)).alias("_tlon")).where("_tlat IS NOT NULL AND _tlon IS NOT NULL").distinct()
    out, size = None, first_cell(sources, float(step))
    while True:
        n_lon = max(1, int(360.0 // size))
        row, column = _grid_cell(size, n_lon)
        around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in sorted({k % n_lon for k in (-1, 0, 1)})])
        asked = open_.withColumns({"_ti": row("_tlat"), "_tj": column("_tlon")}).withColumn("_o", F.explode(around))
        asked = asked.select("template_id", "_tlat", "_tlon", (F.col("_ti") + F.col("_o.i")).alias("_i"), F.pmod(F.col("_tj") + F.col("_o.j"), F.lit(n_lon)).alias("_j"))
        east = F.abs(F.col("_lon") - F.col("_tlon"))
        d2 = F.pow(F.col("_lat") - F.col("_tlat"), F.lit(2.0)) + F.pow(F.least(east, 360.0 - east), F.lit(2.0))
        near = asked.join(sources.withColumns({"_i": row("_lat"), "_j": column("_lon")}), ["_i", "_j"]).withColumn("_d", d2)
        best = near.groupBy("template_id").agg(F.min(F.struct(F.round("_d", 9).alias("d"), "point_id")).alias("_b"))
        best = cut_lineage(best.select("template_id", F.col("_b.d").alias("_d"), F.col("_b.point_id").alias("point_id")))
        done = best.where((F.col("_d") <= size * size - 1e-9) | F.lit(size >= 360.0))  # rounded distances tie
        out = done if out is None else out.unionByName(done)
        if size >= 360.0:
            break
        open_ = cut_lineage(open_.join(done.select("template_id"), "template_id", "left_anti"))
        if open_.isEmpty():
            break
        size = min(4.0 * size, 360.0)
    return out.select("template_id", "point_id")


def neighbourhood_mean(df: DataFrame, keys: list[str], value: str, radius: int, i: str = "i", j: str = "j") -> DataFrame:
    """Mean of the (2r+1)^2 cells around each cell (1, 9 or 25 cells).

    Each row is sent to its at most 25 neighbours, then one groupBy; cells that
    do not exist are not created.
    """
    offsets = [(a, b) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1)]
    table = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in offsets])
    sent = df.withColumn("_o", F.explode(table)).select(
        *keys, (F.col(i) + F.col("_o.a")).alias(i), (F.col(j) + F.col("_o.b")).alias(j), value,
        ((F.col("_o.a") == 0) & (F.col("_o.b") == 0)).alias("_self"),
    )
    return (
        sent.groupBy(*keys, i, j)
        .agg(F.avg(value).alias("group_mean"), F.count(value).alias("group_size"), F.max("_self").alias("_self"))
        .where("_self").drop("_self")
    )


def nearest_on_sphere(points: DataFrame, k: int, cell_deg: float) -> DataFrame:
    """k nearest points of each point on the sphere, itself included.

    Points are hashed to lat/lon cells and compared with the cells around their
    own. A point with fewer than k others within ``cell_deg`` is tried again
    with twice the distance, so the answer is exact for any spacing; a good
    first guess keeps the comparisons local.
    """
    out, open_, radius = None, points, float(cell_deg)
    while True:
        near = cut_lineage(_neighbours_within(open_, points, k, radius))
        done = near.where((F.col("_n") >= k) | F.lit(radius >= 180.0))
        out = done if out is None else out.unionByName(done)
        if radius >= 180.0:
            break
        open_ = cut_lineage(open_.join(done.select("point_id").distinct(), "point_id", "left_anti"))
        if open_.isEmpty():
            break
        radius = min(2.0 * radius, 180.0)
    return out.drop("_n")


def _on_cells(points: DataFrame, cell_deg: float) -> tuple[DataFrame, int]:
    n_lon = max(int(360 // cell_deg), 1)
    return points.withColumns({
        "_x": F.cos(F.radians("lat")) * F.cos(F.radians("lon")), "_y": F.cos(F.radians("lat")) * F.sin(F.radians("lon")), "_z": F.sin(F.radians("lat")),
        "_ci": F.floor((F.col("lat") + 90.0) / cell_deg).cast("bigint"),
        "_cj": F.floor(F.pmod(F.col("lon"), F.lit(360.0)) / (360.0 / n_lon)).cast("bigint"),
    }), n_lon


def _neighbours_within(seekers: DataFrame, points: DataFrame, k: int, cell_deg: float) -> DataFrame:
    """k nearest within ``cell_deg`` of each seeker, with the number found there."""
    cells, n_lon = _on_cells(points, cell_deg)
    mine, _ = _on_cells(seekers, cell_deg)
    # A cap of cell_deg spans more meridians towards the poles, and all of them at a pole.
    every = F.lit(n_lon // 2 + 1)
    south = F.abs(F.col("lat")) + cell_deg
    span = F.ceil(cell_deg / F.greatest(F.cos(F.radians(F.least(south, F.lit(89.0)))), F.lit(1e-3)) / (360.0 / n_lon)).cast("int") + 1
    reach = F.when(south >= 89.0, every).otherwise(F.least(span, every))
    seek = (
        mine.withColumn("_di", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))))
        .withColumn("_dj", F.explode(F.sequence(-reach, reach)))
        .select(
            F.col("point_id").alias("_p"), F.col("_x").alias("_px"), F.col("_y").alias("_py"), F.col("_z").alias("_pz"),
            (F.col("_ci") + F.col("_di")).alias("_ci"), F.pmod(F.col("_cj") + F.col("_dj"), F.lit(n_lon)).cast("bigint").alias("_cj"),
        )
        .distinct()
    )
    pairs = seek.join(cells.select("point_id", "_x", "_y", "_z", "_ci", "_cj"), ["_ci", "_cj"])
    dot = F.col("_x") * F.col("_px") + F.col("_y") * F.col("_py") + F.col("_z") * F.col("_pz")
    near = pairs.withColumn("_d", F.round(1.0 - dot, 12)).where(F.col("_d") <= 1.0 - math.cos(math.radians(cell_deg)) + 1e-12)
    w = Window.partitionBy("_p")
    ranked = near.withColumns({"rank": F.row_number().over(w.orderBy("_d", "point_id")), "_n": F.count(F.lit(1)).over(w)})
    return ranked.where(F.col("rank") <= k).select(
        F.col("_p").alias("point_id"), F.col("point_id").alias("neighbour_id"), "rank", F.col("_d").alias("distance"), "_n"
    )


def polygon_mask(points: DataFrame, edges: DataFrame, min_cells: int = 1) -> DataFrame:
    """(region_id, point_id) of points inside polygons, by ray casting.

    ``edges`` holds (region_id, x1, y1, x2, y2). An edge counts when the point's
    latitude lies in its half-open span and the crossing is to the east. Edges
    are spread over the one-degree latitude bands they touch, so a point meets
    only edges of its own band. Regions with fewer than ``min_cells`` points are
    dropped.
    """
    lo, hi = F.least("y1", "y2"), F.greatest("y1", "y2")
    banded = edges.where("y1 <> y2").withColumn(
        "_band", F.explode(F.sequence(F.floor(lo).cast("int"), F.floor(hi).cast("int")))
    )
    tested = points.select("point_id", "lat", "lon").withColumn("_band", F.floor("lat").cast("int")).join(broadcast_if_small(banded), "_band").where(
        (F.col("lat") >= lo) & (F.col("lat") < hi)
    )
    cross = F.col("x1") + (F.col("lat") - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    inside = (
        tested.where(F.col("lon") < cross)
        .groupBy("region_id", "point_id")
        .agg((F.count(F.lit(1)) % 2).alias("_odd"))
        .where("_odd = 1").drop("_odd")
    )
    if min_cells <= 1:
        return inside
    big = inside.groupBy("region_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_cells)
    return inside.join(broadcast_if_small(big.select("region_id")), "region_id", "left_semi")


def healpix_lookup(grid: DataFrame, lookup: DataFrame, hp_map: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Map value at each (lat, lon) through a prepared (lat, lon) -> pix table."""
    return grid.join(broadcast_if_small(lookup), ["lat", "lon"]).join(hp_map, "pix").select(*keys, "lat", "lon", "pix", value)


def healpix_values(points: DataFrame, hp_map: DataFrame, nside: int, keys: list[str], value: str, order: str = "nested", lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Map value of the pixel that holds each position, without a prepared table; positions off the map have no row."""
    return healpix.add_pixel(points, nside, lat, lon, "pix", order).join(hp_map, "pix").select(*keys, lat, lon, "pix", value)


def healpix_smooth(hp_map: DataFrame, keys: list[str], value: str, nside: int, pix: str = "pix", order: str = "nested") -> DataFrame:
    """Mean of each pixel of a map and those of its at most eight neighbours that the map holds.

    Every pixel sends its value to its neighbours; pixels that the map lacks are
    not created.
    """
    around = healpix.add_neighbours(hp_map, nside, pix, "_around", order)
    sent = around.select(*keys, F.col(pix).alias("_from"), value, F.explode(F.array_compact(F.concat(F.array(F.col(pix).cast("bigint")), "_around"))).alias(pix))
    means = sent.groupBy(*keys, pix).agg(F.avg(value).alias("smooth"), F.count(value).alias("n"), F.max(F.col("_from") == F.col(pix)).alias("_own"))
    return means.where("_own").drop("_own")
