"""Clustering by exact integer centroids with a filter of rotated coordinates.

The vectors are turned to the principal axes of all of them. A row stores its leading rotated coordinates and the norm of
the rest. For a centroid turned the same way, the squared distance of the leading coordinates plus the squared difference
of the two norms never exceeds the squared distance, because the rest of both vectors differ by their norms at least. The
centroid with the least bound is verified first in integers; only those whose bound does not exceed that distance follow.

Each round reads the stored rows once and adds up integer sums in the tasks; what reaches the driver has one row per
centroid, whatever the number of vectors. The rotation only decides how much is verified, never the result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom.llm.memory import tidy
from ticketloom.sources.sinks import stored

DIMENSIONS, CLUSTERS, ROUNDS, SCALE, LEADING = 64, 16, 3, 64, 16
#: Scaled components beyond this make squared distances that no 64-bit integer holds.
MOST = 1 << 26
#: Rounding of the bounds, relative to the squared norms; some 10,000 times the errors of double precision.
_SLACK = 1e-10


def _matrix(column: pa.Array, width: int, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, width)


def _usable(vector, dimensions: int, scale: int):
    """Exactly ``dimensions`` components, none NULL, NaN, infinite or beyond MOST."""
    far = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) > MOST / scale))
    return F.coalesce((F.size(vector) == dimensions) & ~far, F.lit(False))


def _axes(rows: DataFrame, dimensions: int) -> np.ndarray:
    """Principal axes of all vectors as columns, the widest first."""

    def run(batches):
        total = np.zeros((dimensions + 1, dimensions + 1))
        for batch in batches:
            x = _matrix(batch.column(0), dimensions, np.float64)
            x = np.hstack([x, np.ones((len(x), 1))])
            total += x.T @ x
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(total.size), pa.int32()), pa.array(total.reshape(-1))], ["place", "value"]
        )

    sums = rows.select("vector").mapInArrow(tidy(run), "place int, value double").groupBy("place").agg(F.sum("value"))
    total = np.zeros((dimensions + 1) ** 2)
    for place, value in sums.collect():
        total[place] = value
    total = total.reshape(dimensions + 1, dimensions + 1)
    n = max(total[-1, -1], 1.0)
    mean = total[-1, :-1] / n
    _, axes = np.linalg.eigh(total[:-1, :-1] / n - np.outer(mean, mean))
    return np.ascontiguousarray(axes[:, ::-1])


def _turned(x: np.ndarray, axes: np.ndarray, leading: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading rotated coordinates and the norm of the others."""
    y = x.astype(np.float64) @ axes
    return y[:, :leading], np.linalg.norm(y[:, leading:], axis=1)


class Centroids:
    """Integer centroids and their rotated coordinates."""

    def __init__(self, whole: np.ndarray, axes: np.ndarray, leading: int):
        self.whole = whole
        self.lead, self.rest = _turned(whole, axes, leading)
        self.square = (whole.astype(np.float64) ** 2).sum(axis=1)

    def nearest(self, x: np.ndarray, lead: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(nearest centroid, exact squared distance) of each row, ties to the smaller number, and how many distances were
        verified."""
        square = (lead**2).sum(axis=1) + rest**2
        bound = ((lead**2).sum(axis=1)[:, None] + (self.lead**2).sum(axis=1) - 2 * lead @ self.lead.T) + (rest[:, None] - self.rest) ** 2
        bound -= _SLACK * (square[:, None] + self.square + 1)
        rows = np.arange(len(x))
        first = bound.argmin(axis=1)
        exact = np.full(bound.shape, np.iinfo(np.int64).max)
        exact[rows, first] = self._distance(x, rows, first)
        alive = bound <= exact[rows, first][:, None]
        alive[rows, first] = False
        left, right = np.nonzero(alive)
        exact[left, right] = self._distance(x, left, right)
        cluster = exact.argmin(axis=1)
        return cluster, exact[rows, cluster], len(rows) + len(left)

    def _distance(self, x: np.ndarray, rows: np.ndarray, centroid: np.ndarray) -> np.ndarray:
        gap = x[rows] - self.whole[centroid]
        return np.einsum("ij,ij->i", gap, gap)


def _assigned(batches, centroids: Centroids, dimensions: int, leading: int):
    """(batch, vectors, clusters, distances) of all batches with rows."""
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch.column("vector"), dimensions, np.int64)
            lead = _matrix(batch.column("lead"), leading, np.float64)
            cluster, distance, _ = centroids.nearest(x, lead, batch.column("rest").to_numpy())
            yield batch, x, cluster, distance


def _moved(rows: DataFrame, centroids: Centroids, dimensions: int, leading: int) -> np.ndarray:
    """The centroids after a round: the floor of the mean of their vectors, those without vectors as they were."""
    k = len(centroids.whole)

    def run(batches):
        sums, counts = np.zeros((k, dimensions), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for _, x, cluster, _ in _assigned(batches, centroids, dimensions, leading):
            counts += np.bincount(cluster, minlength=k)
            for c in np.unique(cluster):
                sums[c] += x[cluster == c].sum(axis=0)
        some = np.flatnonzero(counts)
        if len(some):
            yield pa.RecordBatch.from_arrays(
                [pa.array(some, pa.int32()), pa.array(counts[some]), pa.array(sums[some].tolist(), pa.list_(pa.int64()))],
                ["cluster", "n", "total"],
            )

    parts = rows.select("vector", "lead", "rest").mapInArrow(tidy(run), "cluster int, n long, total array<long>")
    totals = [F.sum(F.col("total")[i]).alias(f"s{i}") for i in range(dimensions)]
    out = centroids.whole.copy()
    for cluster, n, *total in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *totals).collect():
        out[cluster] = [t // n for t in total]
    return out


def centroid_clusters(
    df: DataFrame, key: str, vector: str, dimensions: int = DIMENSIONS, clusters: int = CLUSTERS, rounds: int = ROUNDS,
    scale: int = SCALE, leading: int = LEADING, seed: int = 1,
) -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector.

    A vector is kept when it has exactly ``dimensions`` components, none of them NULL, NaN or infinite; its components
    become floor(``scale`` * x). A vector with a scaled component beyond 2^26 is left out as well, because its distances
    fit no long. The first centroids are the kept vectors with the smallest sha256 of "``seed``:key" in that order; rows
    without a key start no centroid but are clustered. Of rows with equal keys the least vector comes first. Each round
    moves every centroid that has vectors to the floor of their mean; ties go to the smaller centroid. With fewer keys
    than ``clusters`` there are as many centroids as keys; without any the result is empty. ``distance`` is squared;
    inertias are NULL where a sum fits no long. Other columns are not read.
    """
    if not 0 < leading < dimensions:
        raise ValueError("some coordinates lead and some are left")
    spark = df.sparkSession
    x = F.col("_vector")
    kept = df.select(F.col(key).alias("_key"), F.col(vector).cast("array<double>").alias("_vector"))
    kept = kept.where(_usable(x, dimensions, scale))
    whole = F.transform(x, lambda v: F.floor(v * F.lit(float(scale))).cast("int"))
    rows = kept.select("_key", whole.alias("vector"))
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("_key").cast("string")), 256)
    first = rows.where("_key IS NOT NULL").orderBy(named, "vector").limit(clusters).collect()
    axes = _axes(rows, dimensions)

    def turn(batches):
        for batch in batches:
            if batch.num_rows:
                lead, rest = _turned(_matrix(batch.column(1), dimensions, np.float64), axes, leading)
                flat = pa.array(lead.reshape(-1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(lead) + 1) * leading, pa.int32()), flat)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), lists, pa.array(rest)], ["_key", "vector", "lead", "rest"]
                )

    kind = df.schema[key].dataType.simpleString()
    turned = rows.mapInArrow(tidy(turn), f"_key {kind}, vector array<int>, lead array<double>, rest double")
    turned = stored(turned, "turned-vectors")
    centroids = Centroids(np.array([r["vector"] for r in first], dtype=np.int64).reshape(-1, dimensions), axes, leading)
    if not first:
        turned = turned.where("false")
    else:
        for _ in range(rounds):
            centroids = Centroids(_moved(turned, centroids, dimensions, leading), axes, leading)

    def assign(batches):
        for batch, _, cluster, distance in _assigned(batches, centroids, dimensions, leading):
            yield pa.RecordBatch.from_arrays(
                [batch.column("_key"), pa.array(cluster, pa.int32()), pa.array(distance)], ["_key", "cluster", "distance"]
            )

    found = stored(turned.mapInArrow(tidy(assign), f"_key {kind}, cluster int, distance long"), "assigned-vectors")
    inertia = found.groupBy("cluster").agg(F.try_sum("distance").alias("cluster_inertia"))
    total = found.agg(F.try_sum("distance"))
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.whole.tolist()]
    final = spark.createDataFrame(list(enumerate(names)), "cluster int, centroid_sha256 string")
    # One row per centroid on both sides.
    summary = final.join(inertia, "cluster").withColumn("inertia", total.scalar())
    return found.join(F.broadcast(summary), "cluster").select(
        F.col("_key").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
