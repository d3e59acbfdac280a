"""HEALPix arithmetic on columns: pixels of positions, ring and nested order, centres, neighbours.

A pixel is a place (ix, iy) on one of twelve square faces: four around the north
pole (0-3), four on the equator (4-7), four around the south pole (8-11); ix grows
to the north-east, iy to the north-west. Nested numbers interleave the bits of the
two; ring numbers count along parallels from the north. All functions take and
return DataFrames and add columns by closed formulas, without lookup tables, so
they stay in generated code. ``nside`` is a power of two. Null in, null out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (ix, iy) steps to the eight neighbours: south-west, west, north-west, north, north-east, east, south-east, south.
STEPS = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]


def order_of(nside: int) -> int:
    order = int(nside).bit_length() - 1
    if nside < 1 or 2**order != nside or order > 29:
        raise ValueError("nside must be a power of two up to 2^29")
    return order


def _long(c: Column) -> Column:
    return c.cast("bigint")


def _div(a: Column, b) -> Column:
    """Integer quotient, rounded down, of longs beyond the range of exact doubles as well."""
    b = b if isinstance(b, Column) else F.lit(b).cast("bigint")
    return F.call_function("div", a - F.pmod(a, b), b)


def _half(c: Column) -> Column:
    return F.shiftright(c, 1)


def _row(face: Column) -> Column:
    """0 for northern, 1 for equatorial, 2 for southern faces."""
    return F.shiftright(face, 2)


def _column(face: Column) -> Column:
    return face.bitwiseAND(3)


def _face_at(row: int, column: Column) -> Column:
    return row * 4 + F.pmod(column, F.lit(4))


def _belt_face(ne: Column, nw: Column) -> Column:
    """Face of a place in the equatorial belt from the numbers of the diagonal strips it lies in."""
    return F.when(ne == nw, F.pmod(ne, F.lit(4)) + 4).when(ne < nw, F.pmod(ne, F.lit(4))).otherwise(F.pmod(nw, F.lit(4)) + 8)


def with_place(df: DataFrame, nside: int, lat: str, lon: str) -> DataFrame:
    """Add _face, _ix, _iy of a position in degrees; a latitude beyond a pole, NaN or infinity gives nulls."""
    order_of(nside)
    valid = F.abs(lat) <= 90.0
    valid &= F.abs(lon) < float("inf")
    z = F.when(valid & ~F.isnan(lat) & ~F.isnan(lon), F.sin(F.radians(F.col(lat).cast("double"))))
    quarter = F.pmod(F.col(lon).cast("double"), F.lit(360.0)) / 90.0
    df = df.withColumns({"_z": z, "_t": F.when(quarter >= 4.0, 0.0).otherwise(quarter)})
    # In the belt: numbers of the strips of pixels along the two diagonals. In a cap: distances from the two edges.
    cap = F.abs("_z") > 2.0 / 3.0
    corner = F.least(F.floor("_t"), F.lit(3))
    edge = nside * F.sqrt(3.0 * (1.0 - F.abs("_z")))
    inside = F.col("_t") - corner
    df = df.withColumns({
        "_cap": cap, "_corner": _long(corner),
        "_p": _long(F.floor(F.when(cap, inside * edge).otherwise(nside * (0.5 + F.col("_t") - 0.75 * F.col("_z"))))),
        "_m": _long(F.floor(F.when(cap, (1.0 - inside) * edge).otherwise(nside * (0.5 + F.col("_t") + 0.75 * F.col("_z"))))),
    })
    last = nside - 1
    p, m = (F.least(F.col(c), F.lit(last)) for c in ("_p", "_m"))
    north = F.col("_z") >= 0
    face = F.when(F.col("_cap"), F.col("_corner") + F.when(north, 0).otherwise(8)).otherwise(_belt_face(_div(F.col("_p"), nside), _div(F.col("_m"), nside)))
    ix = F.when(F.col("_cap"), F.when(north, last - m).otherwise(p)).otherwise(F.pmod(F.col("_m"), F.lit(nside)))
    iy = F.when(F.col("_cap"), F.when(north, last - p).otherwise(m)).otherwise(last - F.pmod(F.col("_p"), F.lit(nside)))
    known = F.col("_z").isNotNull()
    placed = df.withColumns({"_face": F.when(known, _long(face)), "_ix": F.when(known, _long(ix)), "_iy": F.when(known, _long(iy))})
    return placed.drop("_z", "_t", "_cap", "_corner", "_p", "_m")


def nested(face: Column, ix: Column, iy: Column, nside: int) -> Column:
    """Nested number of a place given by plain columns: the bits of ix on even, of iy on odd places."""
    bits = face * nside * nside
    for k in range(order_of(nside)):
        one = F.lit(1 << k).cast("bigint")
        bits = bits + F.shiftleft(ix.bitwiseAND(one), k) + F.shiftleft(iy.bitwiseAND(one), k + 1)
    return bits


def ring(face: Column, ix: Column, iy: Column, nside: int) -> Column:
    """Ring number of a place given by plain columns."""
    n = F.lit(nside).cast("bigint")
    parallel = (_row(face) + 2) * n - ix - iy - 1
    width = F.least(parallel, n, 4 * n - parallel)
    shift = F.when((parallel >= n) & (parallel <= 3 * n), (parallel - n).bitwiseAND(1)).otherwise(0)
    # Eighths of the circle from the first meridian to the face's middle: 1, 3, 5, 7 for polar, 0, 2, 4, 6 for belt faces.
    middle = 2 * _column(face) + F.when(_row(face) == 1, 0).otherwise(1)
    along = _half(middle * width + ix - iy + 1 + shift)
    # Only a belt face on the first meridian reaches beyond the ends of the circle.
    along = F.when(along < 1, along + 4 * n).when(along > 4 * n, along - 4 * n).otherwise(along)
    before = F.when(parallel < n, 2 * parallel * (parallel - 1)).when(
        parallel > 3 * n, 12 * n * n - 2 * width * (width + 1)
    ).otherwise(2 * n * (n - 1) + (parallel - n) * 4 * n)
    return before + along - 1


def _place_of_nested(df: DataFrame, nside: int, pix: str) -> DataFrame:
    size = nside * nside
    df = df.withColumns({"_face": _div(_long(F.col(pix)), size), "_in": F.pmod(_long(F.col(pix)), F.lit(size).cast("bigint"))})

    def gathered(offset: int) -> Column:
        out = F.lit(0).cast("bigint")
        for k in range(order_of(nside)):
            out = out + F.shiftleft(F.shiftright("_in", 2 * k + offset).bitwiseAND(1), k)
        return out

    return df.withColumns({"_ix": gathered(0), "_iy": gathered(1)}).drop("_in")


def _root(c: Column) -> Column:
    """Integer square root of longs; the rounding of the double is put right."""
    r = _long(F.floor(F.sqrt(c.cast("double"))))
    return r - F.when(r * r > c, 1).otherwise(0) + F.when((r + 1) * (r + 1) <= c, 1).otherwise(0)


def _place_of_ring(df: DataFrame, nside: int, pix: str) -> DataFrame:
    n = F.lit(nside).cast("bigint")
    total, cap = 12 * nside * nside, 2 * nside * (nside - 1)
    p = _long(F.col(pix))
    north, south = p < cap, p >= total - cap
    # Rank in the cap counted from its pole; the caps mirror each other.
    rank = F.when(south, total - 1 - p).otherwise(p)
    df = df.withColumns({"_p": p, "_north": north, "_south": south, "_width": F.when(north | south, _half(_root(2 * rank + 1) + 1)).otherwise(n)})
    w = F.col("_width")
    first = 2 * w * (w - 1)
    in_belt = F.col("_p") - cap
    df = df.withColumns({
        "_parallel": F.when(F.col("_north"), w).when(F.col("_south"), 4 * n - w).otherwise(_div(in_belt, 4 * nside) + n),
        "_along": F.when(F.col("_north"), F.col("_p") - first + 1).when(F.col("_south"), 4 * w - (total - 1 - F.col("_p") - first)).otherwise(F.pmod(in_belt, 4 * n) + 1),
    })
    along, parallel = F.col("_along"), F.col("_parallel")
    down, up = parallel - n + 1, 3 * n + 1 - parallel  # rows below the belt's top and above its bottom
    belt = _belt_face(_div(along - _half(up) + n - 1, nside), _div(along - _half(down) + n - 1, nside))
    quarter = _div(along - 1, w)
    df = df.withColumns({"_face": _long(F.when(F.col("_north"), quarter).when(F.col("_south"), quarter + 8).otherwise(belt))})
    face = F.col("_face")
    middle = 2 * _column(face) + F.when(_row(face) == 1, 0).otherwise(1)
    shift = F.when(F.col("_north") | F.col("_south"), 0).otherwise((parallel - n).bitwiseAND(1))
    across = 2 * along - middle * w - shift - 1
    df = df.withColumns({"_x": F.when(across >= 2 * n, across - 8 * n).otherwise(across), "_y": parallel - (_row(face) + 2) * n + 1})
    x, y = F.col("_x"), F.col("_y")
    return df.withColumns({"_ix": _half(x - y), "_iy": _half(-x - y)}).drop("_p", "_north", "_south", "_width", "_parallel", "_along", "_x", "_y")


def place_of(df: DataFrame, nside: int, pix: str, order: str = "nested") -> DataFrame:
    """Add _face, _ix, _iy of a pixel number; a number outside 0 .. 12 nside^2 - 1 gives nulls."""
    order_of(nside)
    inside = F.when(_long(F.col(pix)).between(0, 12 * nside * nside - 1), _long(F.col(pix)))
    df = df.withColumn("_pix", inside)
    return {"nested": _place_of_nested, "ring": _place_of_ring}[order](df, nside, "_pix").drop("_pix")


def _numbered(df: DataFrame, nside: int, out: str, order: str) -> DataFrame:
    number = {"nested": nested, "ring": ring}[order]
    return df.withColumn(out, number(F.col("_face"), F.col("_ix"), F.col("_iy"), nside)).drop("_face", "_ix", "_iy")


def add_pixel(df: DataFrame, nside: int, lat: str = "lat", lon: str = "lon", out: str = "pix", order: str = "nested") -> DataFrame:
    """Add the number of the pixel that holds each position."""
    return _numbered(with_place(df, nside, lat, lon), nside, out, order)


def to_ring(df: DataFrame, nside: int, pix: str = "pix", out: str = "ring") -> DataFrame:
    return _numbered(place_of(df, nside, pix), nside, out, "ring")


def to_nested(df: DataFrame, nside: int, pix: str = "pix", out: str = "nested") -> DataFrame:
    return _numbered(place_of(df, nside, pix, "ring"), nside, out, "nested")


def add_centre(df: DataFrame, nside: int, pix: str = "pix", lat: str = "lat", lon: str = "lon", order: str = "nested") -> DataFrame:
    """Add latitude and longitude (0 to 360) of pixel centres, in degrees."""
    n = F.lit(nside).cast("bigint")
    df = place_of(df, nside, pix, order)
    df = df.withColumn("_parallel", (_row(F.col("_face")) + 2) * n - F.col("_ix") - F.col("_iy") - 1)
    df = df.withColumn("_width", F.least("_parallel", n, 4 * n - F.col("_parallel")))
    w, parallel, face = F.col("_width"), F.col("_parallel"), F.col("_face")
    off_pole = w * w / (3.0 * nside * nside)
    z = F.when(parallel < n, 1.0 - off_pole).when(parallel > 3 * n, off_pole - 1.0).otherwise((2 * n - parallel) * 2.0 / (3.0 * nside))
    eighths = (2 * _column(face) + F.when(_row(face) == 1, 0).otherwise(1)) * w + F.col("_ix") - F.col("_iy")
    return df.withColumns({lat: F.degrees(F.asin(z)), lon: F.pmod(eighths, 8 * w) * 45.0 / w}).drop("_face", "_ix", "_iy", "_parallel", "_width")


def _across(face: Column, dx: int, dy: int) -> Column:
    """Face beyond an edge (one of dx, dy is 0) or a corner; null where only three faces meet."""
    row, c = _row(face), _column(face)
    #: By row of the face: row and column step of the face beyond.
    beyond = {
        (1, 0): [(0, 1), (0, 0), (1, 1)], (0, 1): [(0, 3), (0, 3), (1, 0)], (-1, 0): [(1, 0), (2, 3), (2, 3)], (0, -1): [(1, 1), (2, 0), (2, 1)],
        (1, 1): [(0, 2), None, (0, 0)], (-1, -1): [(2, 0), None, (2, 2)], (1, -1): [None, (1, 1), None], (-1, 1): [None, (1, 3), None],
    }[dx, dy]
    out = F.lit(None).cast("bigint")
    for r, to in enumerate(beyond):
        if to is not None:
            out = F.when(row == r, _long(_face_at(to[0], c + to[1]))).otherwise(out)
    return out


def add_neighbours(df: DataFrame, nside: int, pix: str = "pix", out: str = "neighbours", order: str = "nested") -> DataFrame:
    """Add the eight pixels around each, from the south-west clockwise; null where a corner has no pixel."""
    last = nside - 1
    df = place_of(df, nside, pix, order)
    number = {"nested": nested, "ring": ring}[order]
    face, ix, iy = F.col("_face"), F.col("_ix"), F.col("_iy")
    # First the neighbours' places as columns, so that their bits are taken from plain columns.
    places = {}
    for k, (dx, dy) in enumerate(STEPS):
        x, y = ix + dx, iy + dy
        out_x = F.lit(False) if dx == 0 else (x < 0) | (x > last)
        out_y = F.lit(False) if dy == 0 else (y < 0) | (y > last)
        to, tx, ty = face, x, y
        row = _row(face)
        if dx:
            # Polar faces meet their neighbours around the pole with the axes swapped.
            swapped = (row == 0) if dx > 0 else (row == 2)
            to = F.when(out_x & ~out_y, _across(face, dx, 0)).otherwise(to)
            tx = F.when(out_x & ~out_y, F.when(swapped, y).otherwise(F.pmod(x, F.lit(nside)))).otherwise(tx)
            ty = F.when(out_x & ~out_y & swapped, F.lit(last if dx > 0 else 0)).otherwise(ty)
        if dy:
            swapped = (row == 0) if dy > 0 else (row == 2)
            to = F.when(out_y & ~out_x, _across(face, 0, dy)).otherwise(to)
            tx = F.when(out_y & ~out_x & swapped, F.lit(last if dy > 0 else 0)).otherwise(tx)
            ty = F.when(out_y & ~out_x, F.when(swapped, x).otherwise(F.pmod(y, F.lit(nside)))).otherwise(ty)
        if dx and dy:
            both = out_x & out_y
            pole = (row == 0) & F.lit(dx == dy == 1) | (row == 2) & F.lit(dx == dy == -1)
            to = F.when(both, _across(face, dx, dy)).otherwise(to)
            tx = F.when(both, F.when(pole, ix).otherwise(F.pmod(x, F.lit(nside)))).otherwise(tx)
            ty = F.when(both, F.when(pole, iy).otherwise(F.pmod(y, F.lit(nside)))).otherwise(ty)
        places |= {f"_f{k}": _long(to), f"_x{k}": _long(tx), f"_y{k}": _long(ty)}
    df = df.withColumns(places)
    around = F.array(*[number(F.col(f"_f{k}"), F.col(f"_x{k}"), F.col(f"_y{k}"), nside) for k in range(8)])
    return df.withColumn(out, F.when(face.isNotNull(), around)).drop("_face", "_ix", "_iy", *places)


def resolution_degrees(nside: int) -> float:
    """Side of a square of a pixel's area."""
    return math.degrees(math.sqrt(math.pi / 3.0) / nside)
