"""Cap filters against all pairs, and connected components against plain union-find."""

import itertools
import math
import random

import numpy as np
import pytest

from tickloom.llm.cap_filters import CapSettings, ProductCode, list_decode, near_duplicates, rotate
from tickloom.llm.common import components
from tickloom.llm.queries import op8_cap_filters

SCHEMA = "vec_id long, embedding array<float>, label string, n_links string, rep string"


def roots(ids, links):
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {i: find(i) for i in ids}


def brute(rows, least=0.9):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    counts, links = {i: 0 for i, _ in rows if i is not None}, []
    for (i, x), (j, y) in itertools.combinations(good, 2):
        if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= least:
            counts[i] += 1
            counts[j] += 1
            links.append((i, j))
    found = roots(counts, links)
    return sorted((i, counts[i], found[i], found[i] == i) for i in counts)


def result(df):
    return sorted(map(tuple, df.select("vec_id", "n_links", "component_id", "kept").collect()))


def test_query_equals_all_pairs(spark):
    path = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{path}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    assert result(op8_cap_filters(spark, path)) == brute(rows)
    assert result(near_duplicates(table, settings=CapSettings(tile=100))) == brute(rows)


def test_groups_larger_than_a_tile(spark):
    random_ = np.random.default_rng(5)
    centre = random_.normal(size=12)
    rows = [(i, (centre + random_.normal(size=12) * 0.12).tolist(), "l", "n", "r") for i in range(90)]
    rows += [(100 + i, random_.normal(size=12).tolist(), None, None, None) for i in range(60)]
    rows += [(200 + i, rows[3][1], "", "", "") for i in range(30)]
    df = spark.createDataFrame(rows, SCHEMA)
    kept = {r.vec_id: list(r.embedding) for r in df.collect()}
    got = result(near_duplicates(df, settings=CapSettings(tile=16, list_size=60)))
    assert got == brute(list(kept.items()))


def test_recall_at_the_threshold():
    random_ = np.random.default_rng(8)
    x = random_.normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = random_.normal(size=(2000, 64))
    z -= (z * x).sum(axis=1, keepdims=True) * x
    y = 0.9 * x + math.sqrt(1 - 0.81) * z / np.linalg.norm(z, axis=1, keepdims=True)
    for vectors in (5_000, 50_000, 5_000_000):
        code = ProductCode.fitting(64, vectors, CapSettings())
        sets = []
        for side in (x, y):
            rows, filters = list_decode(side, code)
            sets.append([set(filters[rows == i].tolist()) for i in range(2000)])
        found = sum(bool(a & b) for a, b in zip(*sets)) / 2000
        assert found > 0.93, (vectors, found)


def test_list_decoding_leaves_no_filter_out():
    random_ = np.random.default_rng(2)
    x = random_.normal(size=(50, 10))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    code = ProductCode(10, 3, 5, 0.2, 1)
    signs, words = code.tools()
    turned = rotate(x, signs)
    assert np.allclose(np.linalg.norm(turned, axis=1), 1)
    turned = np.pad(turned, ((0, 0), (0, 3 * words.shape[2] - turned.shape[1]))).reshape(50, 3, -1)
    want = set()
    for i in range(50):
        for f in itertools.product(range(5), repeat=3):
            if sum(turned[i, b] @ words[b, w] for b, w in enumerate(f)) >= 0.2:
                want.add((i, f[0] * 25 + f[1] * 5 + f[2]))
    assert set(zip(*map(list, list_decode(x, code)))) == want


def test_edge_cases(spark):
    a, b = [1.0, 0.0, 0.5], [1.0, 0.01, 0.5]
    rows = [(1, a), (2, a), (3, b), (4, None), (5, []), (6, [0.0] * 3), (7, [1.0, None, 0.5]), (8, [float("nan"), 1.0, 0.0])]
    rows += [(9, [float("inf"), 0.0, 0.0]), (None, a), (10, [2.0, 0.0, 1.0]), (11, [1.0, 0.0]), (12, [3e38, 0.0, 1.5e38]), (13, [-1.0, 0.0, -0.5])]
    df = spark.createDataFrame([(*r, "l", "n", "r") for r in rows], SCHEMA)
    got = near_duplicates(df)
    assert result(got.filter("vec_id is not null")) == brute(rows)
    assert got.filter("vec_id is null").select("n_links", "component_id", "kept").collect() == [(0, None, True)]
    twice = spark.createDataFrame([(1, a, "", "", ""), (1, [0.0, 1.0, 0.0], "", "", ""), (1, a, "", "", ""), (0, [0.0, 1.0, 0.01], "", "", "")], SCHEMA)
    assert result(near_duplicates(twice)) == [(0, 1, 0, True), (1, 1, 0, False), (1, 1, 0, False), (1, 1, 0, False)]
    assert near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_components_are_those_of_union_find(spark, seed):
    random_ = random.Random(seed)
    links = [(random_.randint(0, 60), random_.randint(0, 60)) for _ in range(40)] + [(i + 100, i + 101) for i in range(30)] + [(7, 7)]
    random_.shuffle(links)
    want = roots({i for pair in links for i in pair}, links)
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.id: r.component for r in got} == {i: c for i, c in want.items() if i != c} and len(got) == len({r.id for r in got})
