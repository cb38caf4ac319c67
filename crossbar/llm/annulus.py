"""Operator 11: centroid clustering (Lloyd's rounds over integers) by annulus search.

Centroids are sorted by norm. For a vector x, the centroid whose norm is nearest to that of x gives an upper bound u
on the distance to the nearest one; since | |c| - |x| | <= d(c, x), only centroids with a norm in [|x| - u, |x| + u]
can be as near. Two binary searches find them; each of them is compared exactly, in 64-bit integers, those on the
boundary included, and ties go to the smaller number.

A round is one scan: a task adds up the vectors of each centroid, so at most ``clusters`` rows a task are shuffled and
``clusters`` rows reach the driver, whatever the number of vectors. Nothing depends on which vector stands in which
task, so a lost task is simply run again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

#: A larger component would leave no room for 64 squared differences in 64 bits.
LARGEST = 1 << 27
#: Vectors compared at once, and centroids at most: all of them are held by every task.
BLOCK, MOST_CLUSTERS = 4096, 1 << 16
#: Share that norms and bounds may be off by rounding.
SLACK = 1e-9


class Annulus:
    """Integer centroids, searched by norm."""

    def __init__(self, centroids: np.ndarray):
        norms = np.sqrt((centroids.astype(np.float64) ** 2).sum(axis=1))
        self.order = np.argsort(norms, kind="stable")
        self.norms, self.sorted = norms[self.order], centroids[self.order]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number and squared distance of the nearest centroid of each row; how many comparisons it took."""
        number, least, compared = np.empty(len(x), np.int64), np.empty(len(x), np.int64), 0
        for a in range(0, len(x), BLOCK):
            number[a : a + BLOCK], least[a : a + BLOCK], n = self._block(x[a : a + BLOCK])
            compared += n
        return number, least, compared

    def _block(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        norm = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
        right = np.clip(np.searchsorted(self.norms, norm), 0, len(self.norms) - 1)
        left = np.maximum(right - 1, 0)
        first = np.where(np.abs(self.norms[left] - norm) <= np.abs(self.norms[right] - norm), left, right)
        best, number = _squares(x - self.sorted[first]), self.order[first]
        # rounding may only widen the annulus
        u = np.sqrt(best.astype(np.float64)) * (1 + SLACK) + SLACK * (norm + 1)
        low = np.searchsorted(self.norms * (1 + SLACK), norm - u, "left")
        high = np.searchsorted(self.norms * (1 - SLACK), norm + u, "right")
        for j in range(int(low.min()), int(high.max())):
            rows = np.flatnonzero((low <= j) & (j < high) & (first != j))
            if len(rows):
                d, c = _squares(x[rows] - self.sorted[j]), self.order[j]
                better = (d < best[rows]) | ((d == best[rows]) & (c < number[rows]))
                best[rows[better]], number[rows[better]] = d[better], c
        return number, best, int((high - low).sum())


def _squares(differences: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", differences, differences)


def whole_numbers(column: pa.Array, size: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column that take part, and their components as floor(scale * x)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(lengths == size)
    values = column.take(pa.array(rows)).flatten().cast(pa.float64(), safe=False).fill_null(np.nan)
    with np.errstate(invalid="ignore", over="ignore"):
        x = np.floor(scale * values.to_numpy(zero_copy_only=False).reshape(len(rows), size))
        sound = (np.abs(x) <= LARGEST).all(axis=1)  # not so for NaN
    return rows[sound], x[sound].astype(np.int64)


def _sums(centroids: np.ndarray, size: int, scale: float):
    """One row a centroid and task: its number, how many vectors, their distances, their componentwise sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, k = Annulus(centroids), len(centroids)
        counts, far, sums = np.zeros(k, np.int64), np.zeros(k, object), np.zeros((k, size), np.int64)
        for batch in batches:
            _, x = whole_numbers(batch.column("embedding"), size, scale)
            if not len(x):
                continue
            number, distance, _ = search.nearest(x)
            np.add.at(sums, number, x)
            counts += np.bincount(number, minlength=k)
            for c in np.unique(number):  # Python integers: they don't overflow
                far[c] += int(distance[number == c].sum(dtype=object))
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(held, pa.int32()), pa.array(counts[held]), pa.array([str(far[c]) for c in held], pa.string()), pa.array(list(sums[held]), pa.list_(pa.int64()))],
            names=["cluster", "n", "far", "sums"],
        )

    return run


def _assigned(centroids: np.ndarray, size: int, scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Annulus(centroids)
        for batch in batches:
            rows, x = whole_numbers(batch.column("embedding"), size, scale)
            number, distance, _ = search.nearest(x)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(rows)), pa.array(number, pa.int32()), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return run


def _first(size: int, scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = whole_numbers(batch.column("embedding"), size, scale)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(rows)), pa.array(list(x), pa.list_(pa.int64()))], names=["vec_id", "x"])

    return run


def _scan(rows: DataFrame, centroids: np.ndarray, size: int, scale: float) -> dict[int, tuple[int, int, list[int]]]:
    """Number of vectors, summed distance and summed components of each centroid that has any."""
    parts = rows.select("embedding").mapInArrow(_sums(centroids, size, scale), "cluster int, n bigint, far string, sums array<bigint>")
    total = [F.sum(F.get("sums", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(size)]
    got = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum(F.col("far").cast("decimal(38,0)")).alias("far"), *total)
    return {r["cluster"]: (r["n"], int(r["far"]), [int(r[f"s{i}"]) for i in range(size)]) for r in got.collect()}  # at most one row a centroid


def cluster_vectors(vectors: DataFrame, clusters: int = 40, rounds: int = 5, size: int = 64, scale: float = 256.0, seed: int = 2) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that takes part.

    Centroids start as the vectors with the smallest sha256 of ``<seed>:<vec_id>``; an empty one stays where it is.

    Defined cases: null vectors, those of another length, with null or non-finite components, or with a component
    beyond 2^27 once scaled (its distances don't fit 64 bits) take no part; rows of one vec_id are vectors of their
    own, as starting points ordered by their components; a null vec_id is never a starting point unless there are
    too few others; with fewer vectors than ``clusters`` each is a centroid; equal centroids keep their numbers and
    the smaller one takes the vectors; an empty table gives no rows; an inertia beyond a long is null; other columns
    are never read.
    """
    if not 0 < clusters <= MOST_CLUSTERS:
        raise ValueError(f"between 1 and {MOST_CLUSTERS} clusters")
    prepare(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding")
    first = rows.mapInArrow(_first(size, scale), "vec_id bigint, x array<bigint>")
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    start = first.orderBy(key.asc_nulls_last(), "x").limit(clusters).collect()
    centroids = np.array([r["x"] for r in start], np.int64).reshape(len(start), size)
    if not start:
        centroids = np.zeros((1, size), np.int64)  # nothing will be assigned to it
    for _ in range(rounds if start else 0):
        for c, (n, _, sums) in _scan(rows, centroids, size, scale).items():
            centroids[c] = [s // n for s in sums]
    last = _scan(rows, centroids, size, scale) if start else {}
    total = sum(far for _, far, _ in last.values())
    long = lambda v: v if v < 1 << 63 else None
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    table = vectors.sparkSession.createDataFrame(
        [(c, long(last[c][1]) if c in last else 0, long(total), digests[c]) for c in range(len(centroids))],
        "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string",
    )
    found = rows.mapInArrow(_assigned(centroids, size, scale), "vec_id bigint, cluster int, distance bigint")
    return found.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
