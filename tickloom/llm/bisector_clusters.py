"""Centroid clustering in which a tournament of bisector tests finds each vector's centroid."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.vectors import integer_vectors, matrix, slices
from tickloom.settings import materialize

_SUMS = pa.schema([("cluster", pa.int32()), ("place", pa.int32()), ("n", pa.int64()), ("total", pa.int64())])
_ASSIGNED = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])


@dataclass(frozen=True)
class ClusterSettings:
    """``k`` centroids (a task holds k * k normals), ``rounds`` of moving them, vectors of ``dim``
    components; the start is drawn by the hash of ``seed`` and the id.
    """

    k: int = 40
    rounds: int = 5
    dim: int = 64
    seed: int = 2


class Bisectors:
    """The planes halfway between every two centroids, in whole numbers.

    For centroids a < b a vector x is nearer to b exactly if 2 (b - a) . x > b.b - a.a. A
    value of zero is a tie, which the smaller number wins.
    """

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.normals = 2 * (centroids[None, :] - centroids[:, None])
        squares = (centroids * centroids).sum(axis=1)
        self.thresholds = squares[None, :] - squares[:, None]

    def nearest(self, vectors: np.ndarray) -> np.ndarray:
        """Number of the nearest centroid, after k - 1 sign tests per vector.

        Centroids enter by their number, so the winner so far always has the smaller one.
        """
        winner = np.zeros(len(vectors), np.int64)
        for rival in range(1, len(self.centroids)):
            side = np.einsum("ij,ij->i", vectors, self.normals[winner, rival])
            winner[side > self.thresholds[winner, rival]] = rival
        return winner

    def distances(self, vectors: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        apart = vectors - self.centroids[numbers]
        return np.einsum("ij,ij->i", apart, apart)


def _sums(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Count and componentwise sum of a task's vectors by nearest centroid."""
    bisectors = Bisectors(centroids)
    counts, totals = np.zeros(len(centroids), np.int64), np.zeros_like(centroids)
    for batch in slices(batches):
        vectors = matrix(batch.column("vector"))
        nearest = bisectors.nearest(vectors)
        counts += np.bincount(nearest, minlength=len(centroids))
        for number in np.unique(nearest):
            totals[number] += vectors[nearest == number].sum(axis=0)
    used = np.flatnonzero(counts)
    dim = centroids.shape[1]
    columns = [
        np.repeat(used, dim).astype(np.int32),
        np.tile(np.arange(dim, dtype=np.int32), len(used)),
        np.repeat(counts[used], dim),
        totals[used].ravel(),
    ]
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=_SUMS)


def _assign(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    bisectors = Bisectors(centroids)
    for batch in slices(batches):
        vectors = matrix(batch.column("vector"))
        nearest = bisectors.nearest(vectors)
        distance = bisectors.distances(vectors, nearest)
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), pa.array(nearest.astype(np.int32)), pa.array(distance)], schema=_ASSIGNED
        )


def start_centroids(kept: DataFrame, settings: ClusterSettings) -> np.ndarray:
    """The k vectors with the smallest SHA-256 of ``seed:vec_id``; at most k rows reach the driver.

    Rows of one id are ordered by their vectors; null ids start no cluster.
    """
    draw = F.sha2(F.concat(F.lit(f"{settings.seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = kept.filter("vec_id IS NOT NULL").orderBy(draw, "vector").limit(settings.k).select("vector").collect()
    return np.array([row.vector for row in first], np.int64).reshape(len(first), settings.dim)


def moved_centroids(kept: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Every centroid at the floor of its vectors' mean; those without vectors stay.

    Tasks add up their own vectors, so k * dim rows a task are shuffled and k * dim are collected.
    """
    sums = kept.mapInArrow(partial(_sums, centroids=centroids), "cluster int, place int, n long, total long")
    moved = centroids.copy()
    for row in sums.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
        moved[row.cluster, row.place] = row.total // row.n
    return moved


def cluster_vectors(
    vectors: DataFrame,
    settings: ClusterSettings = ClusterSettings(),
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``vec_id``, ``cluster``, squared ``distance``, ``cluster_inertia``, ``inertia`` and
    ``centroid_sha256`` of every vector of ``dim`` finite components.

    Components are floor(256 * x); all arithmetic is in whole numbers. Vectors that are null, of
    another length or with null or non-finite components are left out. Repeated rows and null
    ids count like any other row, but null ids start no cluster. With fewer than k vectors there
    are as many centroids as vectors; without any the result is empty. Equal centroids: the
    smaller number gets the vectors. Other columns are dropped, whatever their names.
    """
    kept = materialize(integer_vectors(vectors, id_col, vector_col, settings.dim), "integer-vectors")
    centroids = start_centroids(kept, settings)
    schema = "vec_id long, cluster int, distance long"
    if not len(centroids):
        nothing = kept.limit(0).select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        return nothing.select(
            "*", F.col("distance").alias("cluster_inertia"), F.col("distance").alias("inertia"), F.lit("").alias("centroid_sha256")
        )
    for _ in range(settings.rounds):
        centroids = moved_centroids(kept, centroids)
    assigned = materialize(kept.mapInArrow(partial(_assign, centroids=centroids), schema), "clusters")
    inertia = {r.cluster: r.total for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    # One row per centroid, k at the most.
    facts = kept.sparkSession.createDataFrame(
        [(number, total, sum(inertia.values()), digests[number]) for number, total in inertia.items()],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    return assigned.join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
