import math
import random

import pytest

from gridseries.operators import polygons


def star(rng, x, y, radius, corners):
    ring = [(x + radius * rng.uniform(0.4, 1) * math.cos(2 * math.pi * k / corners), y + radius * rng.uniform(0.4, 1) * math.sin(2 * math.pi * k / corners)) for k in range(corners)]
    return [(*a, *b) for a, b in zip(ring, ring[1:] + ring[:1], strict=True)]


def brute(points, edges):
    out = set()
    for p, lat, lon in points:
        for turn in (0, 360, -360):
            for region in {e[0] for e in edges}:
                n = sum(1 for r, x1, y1, x2, y2 in edges if r == region and min(y1, y2) <= lat < max(y1, y2) and lon + turn < x1 + (lat - y1) * (x2 - x1) / (y2 - y1))
                if n % 2:
                    out.add((region, p))
    return out


@pytest.mark.parametrize("cell, levels", [(1.0, 5), (3.0, 1), (0.7, 3)])
def test_points_in_stars_with_holes(spark, cell, levels):
    rng = random.Random(4)
    edges = []
    for k, (x, y, radius) in enumerate([(30, 10, 25), (178, -20, 30), (-175, 50, 20), (90, 70, 15), (120, 0, 0.4)]):
        edges += [(f"r{k}", *e) for e in star(rng, x, y, radius, 17)] + [(f"r{k}", *e) for e in star(rng, x, y, radius * 0.3, 9)]
    edges += [("box", 0.0, 0.0, 8.0, 0.0), ("box", 8.0, 0.0, 8.0, 8.0), ("box", 8.0, 8.0, 0.0, 8.0), ("box", 0.0, 8.0, 0.0, 0.0)]
    points = [(k, rng.uniform(-89, 89), rng.uniform(-180, 360)) for k in range(1500)] + [(2000 + k, float(a), float(b)) for k, (a, b) in enumerate([(0, 0), (8, 8), (4, 8), (4, 0), (0, 4), (8, 4), (7, 7)])]
    df = spark.createDataFrame([*points, (5000, None, 1.0), (5001, 1.0, None)], "point_id int, lat double, lon double")
    found = polygons.locate(df, spark.createDataFrame(edges, "region_id string, x1 double, y1 double, x2 double, y2 double"), cell, levels).collect()
    assert {(r["region_id"], r["point_id"]) for r in found} == brute(points, edges)
    assert len(found) == len({(r["region_id"], r["point_id"]) for r in found})
    if levels > 1:
        assert sum(r["tested"] for r in found) < 0.5 * len(found)


def test_inside_cells_meet_no_edge(spark):
    """A dense cluster in the middle of a polygon is located without an edge test."""
    edges = spark.createDataFrame([("r", *e) for e in star(random.Random(1), 50, 20, 30, 200)], "region_id string, x1 double, y1 double, x2 double, y2 double")
    cluster = spark.range(20_000).selectExpr("id AS point_id", "20 + (id % 100) / 200.0 AS lat", "50 + id / 40000.0 AS lon")
    found = polygons.locate(cluster, edges)
    assert found.where("tested").count() == 0 and found.count() == 20_000
    inside, border, _ = polygons.cover(edges)
    assert inside.groupBy("level").count().count() > 2 and border.count() < 2000
    none = spark.createDataFrame([], "region_id string, x1 double, y1 double, x2 double, y2 double")
    assert polygons.locate(cluster, none).count() == 0
