"""HEALPix arithmetic against geometry, not against another implementation."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridseries.functions import healpix as hp


def pixels(spark, nside):
    return spark.range(12 * nside * nside).withColumnRenamed("id", "pix")


def vectors(pdf):
    lat, lon = np.radians(pdf["lat"].to_numpy()), np.radians(pdf["lon"].to_numpy())
    return np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], axis=1)


@pytest.mark.parametrize("nside", [1, 2, 4, 8, 32])
def test_orders_and_centres_round_trip(spark, nside):
    df = hp.to_ring(pixels(spark, nside), nside)
    df = hp.to_nested(df, nside, "ring", "back")
    df = hp.add_centre(df, nside)
    df = hp.add_pixel(df, nside, out="found")
    df = hp.add_pixel(df, nside, out="found_ring", order="ring")
    out = df.toPandas().sort_values("pix")
    assert (out["back"] == out["pix"]).all() and (out["found"] == out["pix"]).all() and (out["found_ring"] == out["ring"]).all()
    assert sorted(out["ring"]) == list(range(12 * nside * nside))
    # Ring numbers go from north to south and eastwards along a parallel.
    by_ring = out.sort_values("ring")
    assert (np.diff(np.round(by_ring["lat"], 9)) <= 0).all()
    for _, parallel in by_ring.groupby(np.round(by_ring["lat"], 9)):
        assert (np.diff(parallel["lon"]) > 0).all()


def test_pixels_have_equal_areas(spark):
    nside, side = 4, 720
    grid = spark.range(side * side).select((F.degrees(F.asin((F.floor(F.col("id") / side) + 0.5) * 2.0 / side - 1.0))).alias("lat"), ((F.col("id") % side + 0.5) * 360.0 / side - 180.0).alias("lon"))
    counts = hp.add_pixel(grid, nside).groupBy("pix").count().toPandas()["count"].to_numpy()
    assert len(counts) == 12 * nside * nside
    assert abs(counts / (side * side / (12 * nside * nside)) - 1).max() < 0.02


@pytest.mark.parametrize("nside", [2, 4, 8])
def test_centre_of_the_pixel_is_the_nearest(spark, nside):
    """Random positions lie within the reach of their pixel's centre."""
    rng = np.random.default_rng(nside)
    z, lon = rng.uniform(-1, 1, 3000), rng.uniform(-360, 720, 3000)
    df = spark.createDataFrame([(float(math.degrees(math.asin(a))), float(b)) for a, b in zip(z, lon, strict=True)], "lat double, lon double")
    found = hp.add_centre(hp.add_pixel(df, nside), nside, lat="clat", lon="clon").toPandas()
    near = vectors(found[["clat", "clon"]].rename(columns={"clat": "lat", "clon": "lon"}))
    apart = np.degrees(np.arccos(np.clip((vectors(found) * near).sum(axis=1), -1, 1)))
    assert apart.max() < 1.35 * hp.resolution_degrees(nside)


@pytest.mark.parametrize("nside", [1, 2, 4, 8])
@pytest.mark.parametrize("order", ["nested", "ring"])
def test_neighbours_touch(spark, nside, order):
    """Neighbours are mutual, and are pixels whose corners or edges touch."""
    df = hp.add_neighbours(hp.add_centre(pixels(spark, nside), nside, order=order), nside, order=order).toPandas().sort_values("pix").reset_index(drop=True)
    around = [[int(q) for q in row if q is not None and q == q] for row in df["neighbours"]]
    for p, near in enumerate(around):
        assert p not in near and all(p in around[q] for q in near)
    missing = sum(8 - len(near) for near in around)
    assert missing == 24  # eight places where three faces meet, each seen by three pixels
    if nside > 1:
        assert all(len(set(near)) == len(near) for near in around)
        # Every pixel whose outline comes as close as a corner does is a neighbour.
        v = vectors(df)
        apart = np.degrees(np.arccos(np.clip(v @ v.T, -1, 1)))
        for p, near in enumerate(around):
            assert apart[p, near].max() < 2.7 * hp.resolution_degrees(nside)
            closest = [q for q in np.argsort(apart[p])[1:4]]
            assert set(closest) <= set(near)


def test_edges_and_invalid_positions(spark):
    df = spark.createDataFrame([(90.0, 0.0), (-90.0, 123.0), (0.0, 360.0), (0.0, 0.0), (0.0, -360.0), (91.0, 0.0), (None, 1.0), (float("nan"), 1.0), (1.0, float("inf")), (41.81, 359.9999999)], "lat double, lon double")
    got = [r["pix"] for r in hp.add_pixel(df, 4, order="ring").collect()]
    assert got[0] in range(4) and got[1] in range(188, 192) and got[2] == got[3] == got[4]
    assert got[5:9] == [None] * 4 and got[9] is not None
    odd = spark.createDataFrame([(-1,), (192,), (None,)], "pix bigint")
    assert [r["ring"] for r in hp.to_ring(odd, 4).collect()] == [None] * 3
    assert [r["neighbours"] for r in hp.add_neighbours(odd, 4).collect()] == [None] * 3
    with pytest.raises(ValueError):
        hp.add_pixel(df, 6)


def test_large_nside_is_exact(spark):
    nside = 2**20
    df = spark.range(0, 12 * nside * nside, 12 * nside * nside // 1000 + 7).withColumnRenamed("id", "pix")
    out = hp.to_nested(hp.to_ring(df, nside), nside, "ring", "back").toPandas()
    assert (out["back"] == out["pix"]).all()
