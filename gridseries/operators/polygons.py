"""Points in polygons by a cover of cells.

Every polygon is covered by cells of a quadtree in longitude and latitude: cells
that no edge touches lie inside or outside as a whole, so a point in an inside
cell meets no edge; cells that edges touch are split down to the finest size, and
only points in these are tested, against the edges of their own polygon in their
own row of cells. Holes are rings of the same polygon; longitudes may run beyond
the date line, since points are looked up a turn to either side as well.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridseries.session import cut_lineage

#: Side of the finest cells in degrees, and levels of cells, each twice as wide as the next.
CELL, LEVELS = 1.0, 5


def _floor(c: Column, size: float) -> Column:
    return F.floor(c / size).cast("bigint")


def edge_rows(edges: DataFrame, cell: float = CELL) -> DataFrame:
    """Edges (region_id, x1, y1, x2, y2) once for each row of finest cells that they touch, as ``row``."""
    return edges.withColumn("row", F.explode(F.sequence(_floor(F.least("y1", "y2"), cell), _floor(F.greatest("y1", "y2"), cell))))


def border_cells(rows: DataFrame, cell: float = CELL) -> DataFrame:
    """Finest cells (region_id, i, j) that an edge touches; i counts rows, j columns."""
    lo, hi = F.least("y1", "y2"), F.greatest("y1", "y2")
    level = F.col("y1") == F.col("y2")
    slope = (F.col("x2") - F.col("x1")) / F.when(level, 1.0).otherwise(F.col("y2") - F.col("y1"))
    at = lambda y: F.col("x1") + (y - F.col("y1")) * slope
    bottom, top = F.greatest(lo, F.col("row") * cell), F.least(hi, (F.col("row") + 1) * cell)
    ends = [F.when(level, F.col("x1")).otherwise(at(bottom)), F.when(level, F.col("x2")).otherwise(at(top))]
    # A little wider than the edge, for the rounding of its crossing points.
    columns = F.sequence(_floor(F.least(*ends) - 1e-9, cell), _floor(F.greatest(*ends) + 1e-9, cell))
    return rows.select("region_id", F.col("row").alias("i"), F.explode(columns).alias("j")).distinct()


def _odd_crossings(tests: DataFrame, rows: DataFrame, keys: list[str], lat: str, lon: str) -> DataFrame:
    """keys of the ``tests`` (region_id, row, lat, lon) with an odd number of their region's edges to the east."""
    lo, hi = F.least("y1", "y2"), F.greatest("y1", "y2")
    met = tests.join(rows, ["region_id", "row"]).where((F.col(lat) >= lo) & (F.col(lat) < hi))
    cross = F.col("x1") + (F.col(lat) - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    return met.where(F.col(lon) < cross).groupBy(*keys).agg((F.count(F.lit(1)) % 2).alias("_odd")).where("_odd = 1").drop("_odd")


def cover(edges: DataFrame, cell: float = CELL, levels: int = LEVELS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(inside cells, border cells, edges by row) of polygons given by edges.

    Inside cells are (region_id, level, i, j) with sides of cell * 2^level;
    border cells (region_id, i, j) have the finest side.
    """
    rows = cut_lineage(edge_rows(edges, cell))
    border = cut_lineage(border_cells(rows, cell))
    known = {k: border.select("region_id", F.shiftright("i", k).alias("i"), F.shiftright("j", k).alias("j")).distinct() for k in range(levels)}
    sides = F.greatest("x1", "x2"), F.least("x1", "x2"), F.greatest("y1", "y2"), F.least("y1", "y2")
    widest = cell * 2 ** (levels - 1)
    boxes = edges.groupBy("region_id").agg(*[f(c).alias(n) for f, c, n in zip((F.max, F.min, F.max, F.min), sides, ("x_hi", "x_lo", "y_hi", "y_lo"), strict=True)])
    whole = boxes.withColumn("i", F.explode(F.sequence(_floor(F.col("y_lo"), widest), _floor(F.col("y_hi"), widest))))
    whole = whole.withColumn("j", F.explode(F.sequence(_floor(F.col("x_lo"), widest), _floor(F.col("x_hi"), widest)))).select("region_id", "i", "j")
    quarters = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])
    open_cells = []
    for k in reversed(range(levels)):
        if k < levels - 1:
            whole = known[k + 1].withColumn("_q", F.explode(quarters)).select("region_id", (2 * F.col("i") + F.col("_q.a")).alias("i"), (2 * F.col("j") + F.col("_q.b")).alias("j"))
        open_cells.append(whole.join(known[k], ["region_id", "i", "j"], "left_anti").withColumn("level", F.lit(k)))
    cells = reduce(DataFrame.unionByName, open_cells)
    size = cell * F.pow(F.lit(2.0), F.col("level"))
    centres = cells.withColumns({"lat": (F.col("i") + 0.5) * size, "lon": (F.col("j") + 0.5) * size}).withColumn("row", _floor(F.col("lat"), cell))
    inside = _odd_crossings(centres, rows, ["region_id", "level", "i", "j"], "lat", "lon")
    return cut_lineage(inside), border, rows


def locate(points: DataFrame, edges: DataFrame, cell: float = CELL, levels: int = LEVELS) -> DataFrame:
    """(region_id, point_id, tested) of points (point_id, lat, lon) inside polygons; ``tested`` where edges were met.

    Points on a western or southern edge count as inside, on an eastern or
    northern one as outside. Points without a position are in no polygon. Edges
    may be decimals, whose differences are exact, or doubles.
    """
    inside, border, rows = cover(edges, cell, levels)
    turns = F.array(F.lit(0.0), F.lit(360.0), F.lit(-360.0))
    copies = points.where("lat IS NOT NULL AND lon IS NOT NULL").select("point_id", F.col("lat").cast("double").alias("lat"), F.explode(F.transform(turns, lambda t: F.col("lon").cast("double") + t)).alias("lon"))
    placed = copies.withColumns({"row": _floor(F.col("lat"), cell), "_j": _floor(F.col("lon"), cell)})
    at_level = placed.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    at_level = at_level.select("point_id", "level", F.expr("shiftright(row, level)").alias("i"), F.expr("shiftright(_j, level)").alias("j"))
    sure = at_level.join(inside, ["level", "i", "j"]).select("region_id", "point_id", F.lit(False).alias("tested"))
    near = placed.join(border, (F.col("row") == F.col("i")) & (F.col("_j") == F.col("j"))).select("region_id", "point_id", "row", "lat", "lon")
    found = _odd_crossings(near, rows, ["region_id", "point_id", "lon"], "lat", "lon").select("region_id", "point_id", F.lit(True).alias("tested"))
    return sure.unionByName(found).groupBy("region_id", "point_id").agg(F.min("tested").alias("tested"))
