"""Centroid clustering by equal-average equal-variance search (operator 11).

Vectors become integers, floor(256 * x). Lloyd rounds assign every vector to its
nearest centroid by exact squared distance and move the centroids to the exact
floors of their vectors' means. The search keeps the centroids sorted by the sum
of their components. For vectors of d components with sums S and deviations V
(lengths of their parts across the main diagonal),

    |x - c|^2 >= (S_x - S_c)^2 / d + (V_x - V_c)^2,

so a vector's centroids are scanned outward from its own sum: where the first
term alone exceeds the best distance, all further ones do and the scan ends;
where both together do, the centroid is passed over; only the others are
measured, in integers. Bounds are floating point with a margin, so they never
pass over a centroid that is nearer or as near.

Vectors are quantised and stored once. A round is one pass over them: tasks hold
the centroids (CENTROIDS at most) and sum their vectors by centroid, Spark adds
the sums up, and the driver sees one row per centroid and component.

Defined results: vectors that are null, of another length, or hold null or
non-finite components take no part; repeated rows take part and return once each;
a null vec_id hashes as the empty text; first centroids whose hashes tie go by
their components; with fewer vectors than centroids each vector starts one; equal
centroids leave the later ones empty, and these stay; components saturate at
2 ** 62 in size and distances and inertias at 2 ** 63 - 1; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage

DIMENSIONS = 64
CENTROIDS = 40
ROUNDS = 5
SALT = 2
LARGEST = 2**63 - 1
_LIMB = 31


class Search:
    """Nearest centroids by integer distance, ties to the smaller number."""

    def __init__(self, centroids: np.ndarray):
        self.d = centroids.shape[1]
        sums = _sums(centroids)
        self.number = np.lexsort([np.arange(len(sums)), sums])
        self.centroids = centroids[self.number]
        self.sums = sums[self.number].astype(np.float64)
        self.deviations = _deviations(self.centroids)
        self.narrow = _is_narrow(centroids)
        self.measured = 0

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid and the squared distance (saturated) of each row."""
        if self.narrow and _is_narrow(x):
            return self._scan(x.astype(np.int64), self.centroids.astype(np.int64), np.int64)
        cluster, distance = self._scan(x.astype(object), self.centroids.astype(object), object)
        return cluster, np.minimum(distance, LARGEST).astype(np.int64)

    def _scan(self, x: np.ndarray, centroids: np.ndarray, kind) -> tuple[np.ndarray, np.ndarray]:
        n, k = len(x), len(centroids)
        own, deviation = _sums(x).astype(np.float64), _deviations(x)
        best, cluster = np.full(n, np.inf), np.full(n, k)
        exact = np.zeros(n, kind)
        right = np.searchsorted(self.sums, own)
        left = right - 1
        below, above = np.concatenate([self.sums, [-np.inf]]), np.concatenate([self.sums, [np.inf]])
        open_ = np.arange(n)
        while len(open_):
            s = own[open_]
            down, up = s - below[left[open_]], above[right[open_]] - s
            at = np.where(down <= up, left[open_], right[open_])
            apart = np.square(np.minimum(down, up)) / self.d
            goes_on = apart * (1 - 1e-9) <= best[open_]
            goes_on &= (left[open_] >= 0) | (right[open_] < k)
            open_, at, apart, is_left = open_[goes_on], at[goes_on], apart[goes_on], (down <= up)[goes_on]
            left[open_[is_left]] -= 1
            right[open_[~is_left]] += 1
            v, w = deviation[open_], self.deviations[at]
            may = (apart + np.square(v - w)) * (1 - 1e-9) - 1e-9 * np.square(v + w) <= best[open_]
            rows, at = open_[may], at[may]
            self.measured += len(rows)
            distance = np.square(x[rows] - centroids[at]).sum(1)
            number = self.number[at]
            first = cluster[rows] == k
            better = first | (distance < exact[rows]) | ((distance == exact[rows]) & (number < cluster[rows]))
            rows = rows[better]
            exact[rows], cluster[rows] = distance[better], number[better]
            # Rounded up, so that no bound is held against less than the distance.
            best[rows] = np.nextafter(distance[better].astype(np.float64), np.inf)
        return cluster, exact


def _is_narrow(x: np.ndarray) -> bool:
    """Whether squared distances between such vectors stay within 62 bits."""
    return not x.size or 4 * x.shape[1] * int(np.abs(x).max()) ** 2 < 2**62


def _sums(x: np.ndarray) -> np.ndarray:
    return (x if _is_narrow(x) else x.astype(object)).sum(1)


def _deviations(x: np.ndarray) -> np.ndarray:
    y = x.astype(np.float64)
    return np.sqrt(np.square(y - y.mean(1, keepdims=True)).sum(1))


def quantised(vectors: DataFrame, vector: str, dims: int) -> DataFrame:
    """vec_id and the integer vector q of every vector that takes part."""
    v = F.col(vector)
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(v, lambda x: F.floor(F.greatest(F.lit(-(2.0**62)), F.least(F.lit(2.0**62), 256 * x.cast("double")))).cast("long"))
    return vectors.where(v.isNotNull() & (F.size(v) == dims) & ~odd).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("q"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def _update(stored: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(centroids)
        n, low, high = np.zeros(k, np.int64), np.zeros((k, dims), np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), dims)
            cluster, _ = search.nearest(x)
            n += np.bincount(cluster, minlength=k)
            np.add.at(low, cluster, x & ((1 << _LIMB) - 1))
            np.add.at(high, cluster, x >> _LIMB)
        used = np.repeat(n > 0, dims)
        columns = [np.repeat(np.arange(k), dims), np.tile(np.arange(dims), k), np.repeat(n, dims), low.ravel(), high.ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(c[used], pa.int64()) for c in columns], ["cluster", "j", "n", "low", "high"])

    sums = stored.select("q").mapInArrow(run, "cluster long, j long, n long, low long, high long")
    out = centroids.copy()
    for r in sums.groupBy("cluster", "j").agg(F.sum("n").alias("n"), F.sum("low").alias("low"), F.sum("high").alias("high")).collect():
        out[r.cluster, r.j] = ((r.high << _LIMB) + r.low) // r.n
    return out


def first_centroids(stored: DataFrame, k: int, dims: int, salt: int = SALT) -> np.ndarray:
    """The k vectors whose ids hash lowest, in that order."""
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = stored.orderBy(digest, "q").limit(k).select("q").collect()
    return np.array([r.q for r in rows], np.int64).reshape(len(rows), dims)


def clusters(vectors: DataFrame, *, vector: str = "embedding", dims: int = DIMENSIONS, k: int = CENTROIDS, rounds: int = ROUNDS, salt: int = SALT) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector that takes part."""
    spark = vectors.sparkSession
    stored = storage.materialize(quantised(vectors, vector, dims), "vectors")
    centroids = first_centroids(stored, k, dims, salt)
    for _ in range(rounds if len(centroids) else 0):
        centroids = _update(stored, centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(centroids)
        for batch in batches:
            cluster, distance = search.nearest(_matrix(batch.column(1), dims))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "cluster", "distance"])

    assigned = storage.materialize(stored.mapInArrow(run, "vec_id long, cluster int, distance long"), "assigned")
    storage.release(stored)
    inertia = {r[0]: int(r[1]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}
    total = min(sum(inertia.values()), LARGEST)
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    # One row per centroid, k at most.
    table = spark.createDataFrame([(c, min(x, LARGEST), total, digests[c]) for c, x in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
