"""Product codes by ball k-means against plain distances in Python."""

import hashlib

import numpy as np
import pytest

from tickloom.llm.ball_codes import Balls, CodeSettings, encode_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, vector string, codes string, error string, code int, _label int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", 1, 2) for r in rows], SCHEMA)


def brute(rows, settings):
    kept = [
        (i, [int(np.floor(256 * float(np.float32(x)))) for x in v], label)
        for i, v, label in rows
        if v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    known = sorted((r[:2] for r in kept if r[0] is not None))
    dim = len(known[0][1]) if known else 0
    if dim == 0 or dim % settings.parts:
        dim = -1
    width = dim // settings.parts

    def cut(v):
        return [tuple(v[p * width : (p + 1) * width]) for p in range(settings.parts)]

    start = [cut(v) for _, v in known if len(v) == dim][: settings.entries]
    books = [list(book) for book in zip(*start)]

    def nearest(part, book):
        return min((sum((x - y) ** 2 for x, y in zip(part, entry)), n) for n, entry in enumerate(book))

    whole = [r for r in kept if len(r[1]) == dim]
    for _ in range(settings.rounds if start else 0):
        members = [{} for _ in books]
        for _, v, _ in whole:
            for p, part in enumerate(cut(v)):
                members[p].setdefault(nearest(part, books[p])[1], []).append(part)
        books = [
            [tuple(sum(c) // len(m[n]) for c in zip(*m[n])) if n in m else entry for n, entry in enumerate(book)]
            for book, m in zip(books, members)
        ]
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest() if start else None
    found = []
    for i, v, label in kept:
        if len(v) == dim:
            best = [nearest(part, book) for part, book in zip(cut(v), books)]
            found.append((i, "".join(f"{n:02x}" for _, n in best), sum(d for d, _ in best), label))
        else:
            found.append((i, None, None, label))
    sums = {}
    for _, _, error, label in found:
        sums[label] = error if sums.get(label) is None else sums[label] + (error or 0)
    return sorted(((i, c, e, sums[label], digest) for i, c, e, label in found), key=repr)


def result(df):
    names = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted(map(tuple, df.select(*names).collect()), key=repr)


@pytest.mark.parametrize("seed,parts,entries,dim,spread", [(1, 4, 16, 8, 1.0), (2, 2, 64, 6, 0.02), (3, 16, 5, 16, 500.0), (4, 3, 1, 3, 1.0)])
def test_equals_all_distances(spark, seed, parts, entries, dim, spread):
    random = np.random.default_rng(seed)
    rows = [(int(i), [float(x) for x in random.normal(0, spread, dim)], int(i % 3) or None) for i in random.permutation(250)]
    settings = CodeSettings(parts, entries, rounds=2)
    assert result(encode_vectors(frame(spark, rows).repartition(5), settings)) == brute(rows, settings)


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    settings = CodeSettings(parts=2, entries=4, rounds=2)
    odd = [(1, None, 1), (2, [1.0, None], 1), (3, [nan, 1.0], None), (4, [inf, 1.0], 1)]
    good = [(5, [0.0, 0.0], 1), (6, [0.0, 0.0], 1), (6, [0.0, 0.0], 1), (7, [0.5, 0.5], None), (None, [9.0, 9.0], None)]
    good += [(8, [1.0, 0.5], 2), (9, [0.25, 0.75], 2), (9, [0.75, 0.25], 2), (11, [3.0, 3.0], 2), (12, [0.375, 7.0], 5)]
    short = [(20, [1.0], 1), (21, [], 7), (22, [1.0, 2.0, 3.0], None)]
    for rows in (odd + good, odd + good + short, odd, short, [(0, [], 1), *good], [(0, [1.0, 2.0, 3.0], 1), *good]):
        assert result(encode_vectors(frame(spark, rows), settings)) == brute(rows, settings)
    assert encode_vectors(frame(spark, odd).limit(0)).count() == 0


def test_reassigning_from_any_codes_finds_the_nearest_entry():
    random = np.random.default_rng(7)
    for spread in (3, 50):
        book, parts = random.integers(-spread, spread, (20, 3)), random.integers(-spread, spread, (500, 3))
        distance = ((parts[:, None] - book[None]) ** 2).sum(axis=2)
        codes, error = Balls(book).reassign(parts, random.integers(0, 20, 500))
        assert (codes == distance.argmin(axis=1)).all() and (error == distance.min(axis=1)).all()
        again, same = Balls(book).reassign(parts, codes)
        assert (again == codes).all() and (same == error).all()
