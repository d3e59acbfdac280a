"""SQL of HEALPix positions, from geometry: the checks do not share formulas with the operators where they can avoid it."""

from __future__ import annotations


def place_sql(source: str, nside: int, columns: str, lat: str = "lat", lon: str = "lon") -> str:
    """SELECT of ``columns`` with face, ix, iy of the positions in ``source``."""
    n = nside
    return f"""SELECT {columns},
  CASE WHEN cap THEN c + CASE WHEN z >= 0 THEN 0 ELSE 8 END WHEN p // {n} = m // {n} THEN (p // {n}) % 4 + 4 WHEN p < m THEN (p // {n}) % 4 ELSE (m // {n}) % 4 + 8 END AS face,
  CASE WHEN NOT cap THEN m % {n} WHEN z >= 0 THEN {n - 1} - m ELSE p END AS ix,
  CASE WHEN NOT cap THEN {n - 1} - p % {n} WHEN z >= 0 THEN {n - 1} - p ELSE m END AS iy
FROM (SELECT *, CAST(CASE WHEN cap THEN least({n - 1}, floor((t - c) * s)) ELSE floor({n} * (0.5 + t - 0.75 * z)) END AS BIGINT) AS p,
    CAST(CASE WHEN cap THEN least({n - 1}, floor((1 - t + c) * s)) ELSE floor({n} * (0.5 + t + 0.75 * z)) END AS BIGINT) AS m
  FROM (SELECT *, CAST(least(3, floor(t)) AS BIGINT) AS c, {n} * sqrt(3 * (1 - abs(z))) AS s, abs(z) > 2.0 / 3 AS cap
    FROM (SELECT *, sin(radians({lat})) AS z, (({lon} % 360) + 360) % 360 / 90 AS t FROM {source})))"""


def nested_sql(nside: int) -> str:
    """Nested number of columns face, ix, iy."""
    bits = ", ".join(f"((ix >> {k}) & 1) << {2 * k}, ((iy >> {k}) & 1) << {2 * k + 1}" for k in range(nside.bit_length() - 1))
    return f"face * {nside * nside} + list_sum([{bits}])"


def ring_centre_sql(source: str, nside: int, columns: str, pix: str) -> str:
    """SELECT of ``columns`` with latitude and longitude of the centres of ring numbers, ring by ring."""
    n, cap, total = nside, 2 * nside * (nside - 1), 12 * nside * nside
    north = f"CAST(floor((1 + sqrt(1 + 2 * {pix}) + 1e-9) / 2) AS BIGINT)"
    south = f"CAST(floor((1 + sqrt(2 * ({total} - {pix}) - 1) + 1e-9) / 2) AS BIGINT)"
    return f"""SELECT {columns}, degrees(asin(z)) AS clat, degrees(phi) AS clon FROM (SELECT *,
  CASE WHEN {pix} < {cap} THEN 1 - i * i / (3.0 * {n * n}) WHEN {pix} < {total - cap} THEN (2 * {n} - i) * 2.0 / (3 * {n}) ELSE i * i / (3.0 * {n * n}) - 1 END AS z,
  CASE WHEN {pix} < {cap} THEN ({pix} + 1 - 2 * i * (i - 1) - 0.5) * pi() / (2 * i)
    WHEN {pix} < {total - cap} THEN (({pix} - {cap}) % {4 * n} + 1 - CASE WHEN (i + {n}) % 2 = 1 THEN 1 ELSE 0.5 END) * pi() / {2 * n}
    ELSE (4 * i + 1 - ({total} - {pix} - 2 * i * (i - 1)) - 0.5) * pi() / (2 * i) END AS phi
  FROM (SELECT *, CASE WHEN {pix} < {cap} THEN {north} WHEN {pix} < {total - cap} THEN ({pix} - {cap}) // {4 * n} + {n} ELSE {south} END AS i FROM {source}))"""


def corners_sql(nside: int) -> str:
    """pix, corner of all pixels in nested order: the places of their four corners on the sphere, rounded."""
    n = nside
    bits = lambda at: " + ".join(f"(((q >> {2 * k + at}) & 1) << {k})" for k in range(n.bit_length() - 1))
    return f"""SELECT pix, round(sqrt(1 - z * z) * cos(phi), 6) + 0.0 || ' ' || round(sqrt(1 - z * z) * sin(phi), 6) + 0.0 || ' ' || round(z, 6) + 0.0 AS corner
FROM (SELECT pix, CASE WHEN r < {n} THEN 1 - w * w / (3.0 * {n * n}) WHEN r > {3 * n} THEN w * w / (3.0 * {n * n}) - 1 ELSE (2 * {n} - r) * 2.0 / (3 * {n}) END AS z,
    CASE WHEN w = 0 THEN 0 ELSE (e * w + x - y) * pi() / (4 * w) END AS phi
  FROM (SELECT *, (f // 4 + 2) * {n} - x - y AS r, 2 * (f % 4) + CASE WHEN f // 4 = 1 THEN 0 ELSE 1 END AS e, least((f // 4 + 2) * {n} - x - y, {n}, {4 * n} - (f // 4 + 2) * {n} + x + y) AS w
    FROM (SELECT pix, f, ix + dx AS x, iy + dy AS y FROM (SELECT pix, pix // {n * n} AS f, {bits(0)} AS ix, {bits(1)} AS iy
        FROM (SELECT unnest(range({12 * n * n})) AS pix, unnest(range({12 * n * n})) % {n * n} AS q)), (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) v(dx, dy))))"""
