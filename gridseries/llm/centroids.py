"""Exact integer k-means whose distances are filtered in a PCA rotation.

Vectors are rotated once onto the principal axes of the whole table; each keeps
its leading coordinates and the norm of the rest. For a centroid rotated the same
way, the squared distance of the leading coordinates plus the squared difference
of the residual norms is at most the squared distance, so centroids beyond the
best verified distance are skipped and the others are compared in integers. The
rotation only decides what is skipped, so its rounding cannot change a result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridseries.llm.common import stage

#: Components are floor(SCALE * x); LEADING rotated coordinates are stored.
SCALE, LEADING = 1024, 12
#: Below this size of components, squared distances and the sums of a batch are exact in 64-bit integers.
SMALL = 2**26
#: Sums travel as limbs of this base, so that they are exact whatever the components are.
LIMB = 10**18
MOST_LONG = 2**63 - 1


def scaled(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of finite doubles: int64, or Python integers where these would not be exact."""
    with np.errstate(over="ignore"):
        y = np.floor(x * SCALE)
    if not y.size or np.abs(y).max() < SMALL:
        return y.astype(np.int64)
    return np.vectorize(lambda v, raw: int(v) if np.isfinite(v) else int(raw) * SCALE, otypes=[object])(y, x)


def limbs(value: int) -> list[int]:
    """Limbs of an integer, lowest first; each has the sign of the value."""
    sign, rest, out = (-1 if value < 0 else 1), abs(value), []
    while True:
        rest, low = divmod(rest, LIMB)
        out.append(sign * low)
        if not rest:
            return out


def matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls as a matrix."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


@dataclass
class Rotation:
    """Mean and leading principal axes of the scaled vectors."""

    mean: np.ndarray
    axes: np.ndarray

    def apply(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leading coordinates and residual norms of the rows of ``y``."""
        centred = y - self.mean
        lead = centred @ self.axes
        rest = np.maximum((centred * centred).sum(axis=1) - (lead * lead).sum(axis=1), 0.0)
        return lead, np.sqrt(rest)


def _float(y: np.ndarray) -> np.ndarray:
    """Doubles for the filter; integers beyond 1e100 are cut, and never filtered by."""
    return (np.clip(y, -(10**100), 10**100) if y.dtype == object else y).astype(np.float64)


def principal_axes(vectors: DataFrame, width: int, leading: int = LEADING) -> Rotation:
    """Rotation onto the leading principal axes of the column ``x`` of all rows.

    A task passes on one row per entry of its moment matrix; the driver gets
    (width + 1) squared numbers.
    """

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 1, width + 1))
        for batch in batches:
            y = np.hstack([_float(scaled(matrix(batch.column(0)))), np.ones((batch.num_rows, 1))]) if batch.num_rows else np.zeros((0, width + 1))
            total += y.T @ y
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], names=["i", "j", "v"])

    sums = np.zeros((width + 1, width + 1))
    for r in vectors.select("x").mapInArrow(moments, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        sums[r["i"], r["j"]] = r["v"]
    n = max(1.0, sums[-1, -1])
    mean = sums[-1, :-1] / n
    covariance = sums[:-1, :-1] / n - np.outer(mean, mean)
    covariance = covariance if np.isfinite(covariance).all() else np.eye(width)
    _, axes = np.linalg.eigh((covariance + covariance.T) / 2)
    return Rotation(mean, np.ascontiguousarray(axes[:, ::-1][:, :leading]))


class Assigner:
    """Nearest centroid of rows, with squared distance; ties go to the smaller number."""

    def __init__(self, centroids: list[list[int]], rotation: Rotation):
        self.big = any(abs(v) >= SMALL for c in centroids for v in c)
        self.centroids = np.array(centroids, object if self.big else np.int64)
        self.rotated = rotation.apply(_float(self.centroids))
        self.verified = 0

    def nearest(self, y: np.ndarray, lead: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        exact = y.dtype == object or self.big
        y = y.astype(object) if exact else y
        centre_lead, centre_rest = self.rotated
        bounds = ((lead[:, None, :] - centre_lead[None]) ** 2).sum(axis=2) + (rest[:, None] - centre_rest[None]) ** 2
        # Rounding: relative to the sizes that were subtracted, far above the error of sums of this many doubles.
        sizes = (lead * lead).sum(axis=1)[:, None] + rest[:, None] ** 2 + ((centre_lead**2).sum(axis=1) + centre_rest**2)[None]
        bounds = bounds - 1e-6 * sizes - 1.0
        first = bounds.argmin(axis=1)
        cluster, best = first.copy(), self.distances(y, first)
        for k in range(len(self.centroids)):
            rows = np.flatnonzero(first != k) if exact else np.flatnonzero((first != k) & ~(bounds[:, k] > best))
            if len(rows):
                d = self.distances(y[rows], np.full(len(rows), k))
                better = (d < best[rows]) | ((d == best[rows]) & (k < cluster[rows]))
                cluster[rows[better]], best[rows[better]] = k, d[better]
        return cluster, best

    def distances(self, y: np.ndarray, k: np.ndarray) -> np.ndarray:
        self.verified += len(k)
        apart = y - self.centroids[k]
        return (apart * apart).sum(axis=1)


def kept_vectors(embeddings: DataFrame, width: int) -> DataFrame:
    """vec_id, x: rows whose embedding has ``width`` components, none null, NaN or infinite; as doubles."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    return embeddings.where((F.size("embedding") == width) & finite).select(F.col("vec_id").cast("bigint").alias("vec_id"), x.alias("x"))


def rotated(vectors: DataFrame, rotation: Rotation) -> DataFrame:
    """vec_id, x with the leading coordinates and the residual norm."""

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                lead, rest = rotation.apply(_float(scaled(matrix(batch.column("x")))))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("x"), pa.array(list(lead), pa.list_(pa.float64())), pa.array(rest)], names=["vec_id", "x", "lead", "rest"])

    return vectors.mapInArrow(turn, "vec_id bigint, x array<double>, lead array<double>, rest double")


def first_centroids(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """Vectors of the ``k`` smallest SHA-256 of ``seed:vec_id``, a null id as an empty text; equal ids by their components."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = vectors.select(key.alias("h"), "x").orderBy("h", "x").limit(k).collect()
    return [[int(v) for v in scaled(np.array([r["x"]], np.float64))[0]] for r in rows]


def moved(table: DataFrame, centroids: list[list[int]], rotation: Rotation) -> list[list[int]]:
    """Centroids after one round: the floor of the mean of their vectors; empty ones stay.

    Tasks sum their vectors by centroid, Spark sums the tasks; the driver gets a
    number per centroid and component.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assigner = Assigner(centroids, rotation) if centroids else None
        totals, counts = [[0] * len(c) for c in centroids], [0] * len(centroids)
        for batch in batches:
            if not batch.num_rows:
                continue
            y = scaled(matrix(batch.column("x")))
            cluster, _ = assigner.nearest(y, matrix(batch.column("lead")), batch.column("rest").to_numpy())
            for k in np.unique(cluster):
                own = y[cluster == k]
                counts[k] += len(own)
                totals[k] = [a + int(b) for a, b in zip(totals[k], own.sum(axis=0), strict=True)]
        rows = [(k, j, at, v) for k, n in enumerate(counts) if n for j, total in enumerate([*totals[k], n]) for at, v in enumerate(limbs(total))]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["k", "j", "at", "v"])

    found: dict[tuple[int, int], int] = {}
    for r in table.mapInArrow(sums, "k int, j int, at int, v bigint").groupBy("k", "j", "at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect():
        found[r["k"], r["j"]] = found.get((r["k"], r["j"]), 0) + int(r["v"]) * LIMB ** r["at"]
    return [[found[k, j] // found[k, len(c)] for j in range(len(c))] if (k, len(c)) in found else c for k, c in enumerate(centroids)]


def centroid_hash(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def cluster_vectors(embeddings: DataFrame, k: int = 8, rounds: int = 10, width: int = 64, seed: int = 3) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256: one row per kept row of ``embeddings``.

    Needs vec_id and embedding; other columns are ignored. Kept are embeddings of
    ``width`` components without null, NaN or infinity; a null embedding, another
    length and a null component drop the row. Components become floor(1024 * x).
    ``rounds`` times every vector joins its nearest centroid (ties: the smaller
    number) and centroids with vectors move to the floor of their mean; then the
    vectors are assigned once more. Rows repeated with their id count each, equal
    vectors under one first hash give equal centroids, of which the smaller number
    takes all. Fewer rows than ``k`` give fewer centroids; an empty table gives an
    empty result. Assignments and means are exact for any finite component; a
    distance or inertia beyond a long is given as the largest long.
    """
    spark = embeddings.sparkSession
    vectors = kept_vectors(embeddings, width)
    rotation = principal_axes(vectors, width)
    table = stage(rotated(vectors, rotation), "rotated-vectors")
    centroids = first_centroids(table, k, seed)
    for _ in range(rounds if centroids else 0):
        centroids = moved(table, centroids, rotation)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assigner = Assigner(centroids, rotation) if centroids else None
        for batch in batches:
            if batch.num_rows:
                cluster, best = assigner.nearest(scaled(matrix(batch.column("x"))), matrix(batch.column("lead")), batch.column("rest").to_numpy())
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster, pa.int32()), pa.array([min(int(d), MOST_LONG) for d in best], pa.int64())], names=["vec_id", "cluster", "distance"])

    assigned = stage(table.mapInArrow(assign, "vec_id bigint, cluster int, distance bigint"), "assigned-vectors")
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()  # k rows at most
    total = min(sum(int(r["d"]) for r in sums), MOST_LONG)
    of_cluster = spark.createDataFrame(
        [(r["cluster"], min(int(r["d"]), MOST_LONG), centroid_hash(centroids[r["cluster"]])) for r in sums], "cluster int, cluster_inertia bigint, centroid_sha256 string"
    )
    joined = assigned.join(F.broadcast(of_cluster), "cluster").withColumn("inertia", F.lit(total).cast("bigint"))
    return joined.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
