"""Centroid clustering of integer vectors with Elkan's bounds.

Every vector carries its centroid, an upper bound of its distance to it and a lower bound of its
distance to each centroid. After a round, bounds move by how far the centroids moved. A centroid is
left out for a vector where the lower bound, or half its distance from the vector's own centroid,
is above the upper bound: then it is farther away for certain. All else is computed exactly, in
integers. Bounds are 32-bit floats, rounded up or down by more than their error, and only strictly
larger bounds leave a centroid out, so ties are found and go to the smaller number.

Bounds stay with their vectors from round to round on the executors (in memory or on their disks);
a lost executor's part is made again from the checkpointed integers by steps that need no exchange.
The driver holds the centroids and their sums, a number of rows that doesn't grow.

Defined results: vectors that are null, of another length, or hold null or non-finite components
give no row; a null id counts as an empty one where initial centroids are chosen; rows that share
an id are each clustered by their own vector, and of equal hashes the smaller vector comes first;
with fewer vectors than clusters each is an initial centroid; repeated rows make equal centroids,
and the smaller number has the vectors; an empty table gives no rows; other columns are ignored.
Components beyond a 64-bit integer count as the largest one, as do distances.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.checkpoints import cut
from ..plans.shipping import ship
from .common import pick

CLUSTERS, ROUNDS, COMPONENTS, SCALE, SEED = 8, 10, 64, 1024, 3
_LONG = (1 << 63) - 1
#: Components up to here have squared distances that fit 64 bits, for up to 64 components.
_NARROW = 1 << 27
_STATE = "vec_id long, v array<long>, cluster int, upper float, lower array<float>, evaluated int"


def _up(x: np.ndarray) -> np.ndarray:
    """32-bit floats that are certainly not below ``x``."""
    return np.nextafter((x * (1 + 1e-12)).astype(np.float32), np.float32(np.inf))


def _down(x: np.ndarray) -> np.ndarray:
    """32-bit floats that are certainly not above ``x``, nor below zero."""
    return np.maximum(np.nextafter((x * (1 - 1e-12)).astype(np.float32), np.float32(-np.inf)), np.float32(0))


def _narrow(rows: np.ndarray, centroids: list[list[int]]) -> bool:
    """Whether squared distances of these fit 64 bits."""
    return rows.shape[1] <= 64 and max(abs(x) for c in centroids for x in c) <= _NARROW and (not rows.size or max(int(rows.max()), -int(rows.min())) <= _NARROW)


def squared(rows: np.ndarray, centroid: list[int]) -> np.ndarray:
    """Exact squared distances; Python's integers where 64 bits may not do."""
    apart = rows - np.array(centroid, dtype=np.int64) if _narrow(rows, [centroid]) else rows.astype(object) - np.array(centroid, dtype=object)
    return (apart * apart).sum(1)


def _roots(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64))


def _between(a: list[int], b: list[int]) -> float:
    return float(np.sqrt(np.float64(sum((x - y) ** 2 for x, y in zip(a, b, strict=True)))))


class Bounds:
    """What a round needs of the centroids: themselves, how far each moved, and half their distances from each other."""

    def __init__(self, centroids: list[list[int]], before: list[list[int]] | None = None):
        self.centroids = centroids
        self.moved = None if before is None else _up(np.array([_between(a, b) for a, b in zip(centroids, before, strict=True)]))
        self.half = _down(np.array([[_between(a, b) / 2 for b in centroids] for a in centroids]))

    def first(self, rows: np.ndarray) -> tuple[np.ndarray, ...]:
        """(cluster, upper, lower, evaluated) of vectors without bounds."""
        squares = np.stack([squared(rows, c) for c in self.centroids], 1)
        cluster = squares.argmin(1)  # the first of equal ones
        roots = _roots(squares)
        return cluster, _up(roots[np.arange(len(rows)), cluster]), _down(roots), np.full(len(rows), len(self.centroids))

    def next(self, rows: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, evaluated: np.ndarray) -> tuple[np.ndarray, ...]:
        """The same for vectors with bounds from the round before."""
        upper = _up(upper.astype(np.float64) + self.moved[cluster])
        lower = _down(lower.astype(np.float64) - self.moved)
        own = np.zeros(lower.shape, dtype=bool)
        own[np.arange(len(rows)), cluster] = True
        open_ = lambda: (upper[:, None] >= lower) & (upper[:, None] >= self.half[cluster]) & ~own
        at = np.flatnonzero(open_().any(1))
        best, place = np.zeros(len(rows), dtype=np.int64 if _narrow(rows, self.centroids) else object), cluster.copy()
        for j in range(len(self.centroids)):
            mine = at[cluster[at] == j]
            best[mine] = squared(rows[mine], self.centroids[j])
        evaluated[at] += 1
        tight = _roots(best[at])
        upper[at], lower[at, cluster[at]] = _up(tight), _down(tight)
        still = open_()
        for j in range(len(self.centroids)):
            asked = np.flatnonzero(still[:, j])
            found = squared(rows[asked], self.centroids[j])
            evaluated[asked] += 1
            lower[asked, j] = _down(_roots(found))
            nearer = ((found < best[asked]) | ((found == best[asked]) & (j < place[asked]))).astype(bool)
            took = asked[nearer]
            best[took], place[took] = found[nearer], j
            upper[took] = _up(_roots(best[took]))
        return place, upper, lower, evaluated


def _matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, width)


def _lists(matrix: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, matrix.size + 1, matrix.shape[1], dtype=np.int32), pa.array(matrix.ravel(), kind))


def _round(bounds: Bounds, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = _matrix(b.column(1), width, np.int64)
            if b.num_columns == 2:
                state = bounds.first(rows)
            else:
                lower = _matrix(b.column(4), len(bounds.centroids), np.float32)
                state = bounds.next(rows, *(b.column(i).to_numpy().copy() for i in (2, 3)), lower, b.column(5).to_numpy().copy())
            cluster, upper, lower, evaluated = state
            made = [b.column(0), b.column(1), pa.array(cluster, pa.int32()), pa.array(upper, pa.float32()), _lists(lower, pa.float32()), pa.array(evaluated, pa.int32())]
            yield pa.RecordBatch.from_arrays(made, ["vec_id", "v", "cluster", "upper", "lower", "evaluated"])

    return run


def _distances(centroids: list[list[int]], width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, cluster = _matrix(b.column(1), width, np.int64), b.column(2).to_numpy()
            distance = np.zeros(len(rows), dtype=np.int64)
            for j, c in enumerate(centroids):
                mine = np.flatnonzero(cluster == j)
                distance[mine] = np.minimum(squared(rows[mine], c), _LONG).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(distance), b.column(5)], ["vec_id", "cluster", "distance", "evaluated"])

    return run


def integer_vectors(embeddings: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): floor(scale * x) of the vectors with that many finite components."""
    rows = pick(embeddings, "vec_id", "embedding")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    kept = rows.filter((F.size("embedding") == components) & ~F.exists("embedding", bad))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def initial_centroids(vectors: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> list[list[int]]:
    """The vectors with the smallest hashes of ``seed:vec_id``, in the order of their hashes."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [list(r["v"]) for r in vectors.orderBy(h, "v").limit(clusters).collect()]


def cluster(embeddings: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, components: int = COMPONENTS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """One row per vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256, evaluated.

    ``evaluated`` counts the distances computed for a vector in all assignments; without bounds it
    would be ``clusters * (rounds + 1)``.
    """
    spark = embeddings.sparkSession
    ship(spark)
    vectors = cut(integer_vectors(embeddings, components, scale))
    centroids = initial_centroids(vectors, clusters, seed)
    if not centroids:
        return vectors.selectExpr("vec_id", "0 AS cluster", "0L AS distance", "0L AS cluster_inertia", "0L AS inertia", "'' AS centroid_sha256", "0 AS evaluated")
    largest = vectors.agg(F.max(F.greatest(F.array_max("v"), -F.array_min("v").cast("decimal(20,0)"))).alias("m"), F.count("*").alias("n")).first()
    kind = "long" if int(largest["m"]) * largest["n"] < _LONG else "decimal(38,0)"
    sums = [F.sum(F.col("v")[i].cast(kind)).alias(f"s{i}") for i in range(components)]
    state, bounds = vectors, Bounds(centroids)
    for turn in range(rounds + 1):
        before = state
        state = before.mapInArrow(_round(bounds, components), _STATE)
        if turn == rounds:
            break
        state = state.persist(StorageLevel.MEMORY_AND_DISK)
        moved = [list(c) for c in bounds.centroids]
        for r in state.groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect():
            moved[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(components)]
        bounds = Bounds(moved, bounds.centroids)
        if before is not vectors:
            before.unpersist()
    last = bounds.centroids
    found = cut(state.mapInArrow(_distances(last, components), "vec_id long, cluster int, distance long, evaluated int"))
    if rounds:
        before.unpersist()
    total = F.least(F.sum(F.col("distance").cast("decimal(38,0)")), F.lit(_LONG).cast("decimal(38,0)")).cast("long")
    by = {r["cluster"]: r["total"] for r in found.groupBy("cluster").agg(total.alias("total")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in last]
    row = lambda values, kind: F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("cluster") + 1)
    return found.select(
        "vec_id", "cluster", "distance", row([by.get(j, 0) for j in range(len(last))], "long").alias("cluster_inertia"),
        F.lit(min(sum(by.values()), _LONG)).cast("long").alias("inertia"), row(digest, "string").alias("centroid_sha256"), "evaluated",
    )
