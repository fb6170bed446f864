"""Clustering by bisector tests against plain distances in Python."""

import hashlib

import numpy as np
import pytest

from tickloom.llm.bisector_clusters import Bisectors, ClusterSettings, cluster_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, vector string, cluster string, distance int, n int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "y", 1, 2) for i, v in rows], SCHEMA)


def brute(rows, settings):
    kept = [
        (i, [int(np.floor(256 * float(np.float32(x)))) for x in v])
        for i, v in rows
        if v is not None and len(v) == settings.dim and all(x is not None and np.isfinite(x) for x in v)
    ]

    def key(row):
        return hashlib.sha256(f"{settings.seed}:{row[0]}".encode()).hexdigest(), row[1]

    centroids = [v for _, v in sorted((r for r in kept if r[0] is not None), key=key)[: settings.k]]

    def nearest(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(settings.rounds):
        members = {}
        for _, v in kept:
            members.setdefault(nearest(v)[1], []).append(v)
        centroids = [
            [sum(column) // len(members[n]) for column in zip(*members[n])] if n in members else c
            for n, c in enumerate(centroids)
        ]
    found = [(i, *nearest(v)) for i, v in kept]
    total = sum(d for _, d, _ in found)
    sums = {n: sum(d for _, d, m in found if m == n) for _, _, n in found}
    return sorted(
        ((i, n, d, sums[n], total, hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest()) for i, d, n in found),
        key=repr,
    )


def result(df):
    names = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted(map(tuple, df.select(*names).collect()), key=repr)


@pytest.mark.parametrize("seed,k,dim,spread", [(1, 7, 5, 1.0), (2, 3, 2, 0.01), (3, 40, 4, 1000.0), (4, 1, 3, 1.0)])
def test_equals_all_distances(spark, seed, k, dim, spread):
    random = np.random.default_rng(seed)
    rows = [(int(i), [float(x) for x in random.normal(0, spread, dim)]) for i in random.permutation(300)]
    settings = ClusterSettings(k=k, rounds=3, dim=dim)
    assert result(cluster_vectors(frame(spark, rows).repartition(5), settings)) == brute(rows, settings)


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(1, None), (2, []), (3, [1.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, -inf])]
    # Ties, equal centroids, repeated rows, null ids, an id with two vectors.
    good = [(8, [0.0, 0.0]), (9, [0.0, 0.0]), (9, [0.0, 0.0]), (10, [0.5, 0.5]), (11, [1.0, 1.0]), (12, [-0.001, 0.0])]
    good += [(None, [0.25, 0.25]), (13, [0.5, 0.0]), (13, [0.0, 0.5]), (14, [300000.0, -300000.0])]
    for k in (3, 40):
        settings = ClusterSettings(k=k, rounds=2, dim=2)
        assert result(cluster_vectors(frame(spark, odd + good), settings)) == brute(odd + good, settings)
    empty = cluster_vectors(frame(spark, odd), ClusterSettings(dim=2))
    assert empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert empty.count() == 0 and cluster_vectors(frame(spark, odd).limit(0)).count() == 0


def test_components_beyond_exact_distances_are_an_error(spark):
    with pytest.raises(Exception, match="no exact distance"):
        cluster_vectors(frame(spark, [(1, [600000.0, 0.0])]), ClusterSettings(dim=2)).collect()


def test_tournament_prefers_the_smaller_number_on_ties():
    centroids = np.array([[4, 0], [0, 4], [4, 0], [-4, 0], [0, 0]], np.int64)
    bisectors = Bisectors(centroids)
    vectors = np.array([[4, 0], [2, 2], [0, 0], [-2, 0], [3, 3], [2, 0]], np.int64)
    assert bisectors.nearest(vectors).tolist() == [0, 0, 4, 3, 0, 0]
    assert bisectors.distances(vectors, bisectors.nearest(vectors)).tolist() == [0, 8, 0, 4, 10, 4]
