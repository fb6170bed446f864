"""The Jaccard join against all pairs."""

import itertools
import random
import re
from collections import defaultdict
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import ngram_join
from tickloom.llm.ngram_join import JoinSettings, join_documents, keep_first_of_groups
from tickloom.llm.queries import op4_ngram_join

SCHEMA = "doc_id long, text string, n string, key string, rep string, is_gone string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, width):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]
    width = min(width, len(words))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set()


def brute(rows, width, percent):
    """(doc_id, text) rows; candidates share any token, so no link is missed."""
    sets = [shingles(text, width) for _, text in rows]
    lists = defaultdict(list)
    for i, s in enumerate(sets):
        for token in s:
            lists[token].append(i)
    parent = {i: i for i, _ in rows if i is not None}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    pairs = {p for members in lists.values() for p in itertools.combinations(members, 2)}
    for i, j in pairs:
        both = len(sets[i] & sets[j])
        if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both) and None not in (rows[i][0], rows[j][0]):
            a, b = sorted((find(rows[i][0]), find(rows[j][0])))
            parent[b] = a
    return sorted(((i, len(s), None if i is None else find(i)) for (i, _), s in zip(rows, sets)), key=repr)


def result(df):
    return sorted(map(tuple, df.select("doc_id", "n_shingles", "component_id").collect()), key=repr)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_all_pairs(spark, sf):
    path = f"/root/testdata/{sf}"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    assert result(op4_ngram_join(spark, path)) == brute(rows, 3, 90)


def near_copies(seed):
    random_ = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for group in range(6):
        base = [random_.choice(words) for _ in range(random_.randint(20, 120))]
        for k in range(random_.choice([1, 3, 40])):
            copy = list(base)
            for _ in range(random_.randint(0, 3)):
                copy[random_.randrange(len(copy))] = random_.choice(words)
            rows.append((len(rows) * 7 % 1000, " ".join(copy)))
            base = copy if group % 2 else base
    return rows


@pytest.mark.parametrize("seed,width,percent", [(1, 3, 90), (2, 5, 80), (3, 1, 60), (4, 3, 100)])
def test_groups_and_chains_of_near_copies(spark, seed, width, percent):
    rows = near_copies(seed)
    df = spark.createDataFrame([(*r, "n", "k", "r", "g") for r in rows], SCHEMA)
    assert result(join_documents(df, JoinSettings(width, percent))) == brute(rows, width, percent)


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \t"), (4, "One two"), (5, "one TWO"), (6, "É é"), (7, "é é"), (None, "one two"), (8, "a b c " * 20_000), (9, "a b c " * 20_001)]
    rows += [(10, "same row here"), (10, "same row here"), (11, "x y z"), (11, "one two"), (12, "one")]
    df = spark.createDataFrame([(*r, "n", "k", "r", "g") for r in rows], SCHEMA)
    want = brute(rows, 3, 90)
    assert result(join_documents(df)) == want
    left = keep_first_of_groups(df)
    assert left.columns == df.columns
    assert sorted((r.doc_id for r in left.collect()), key=repr) == sorted((i for i, _, c in want if i == c or i is None), key=repr)
    assert join_documents(df.limit(0)).count() == 0
    assert join_documents(df.filter("doc_id in (1, 2)")).count() == 2


def test_sizes_are_compared_before_sets_move(spark):
    short, long = " ".join(f"w{i}" for i in range(20)), " ".join(f"w{i}" for i in range(200))
    rows = [(1, short), (2, long), (3, long + " x")]
    docs, settings = spark.createDataFrame(rows, "doc_id long, text string"), ngram_join.JoinSettings()
    counts = ngram_join.cell_counts(docs, 3, "text")
    sketch = docs.mapInArrow(partial(ngram_join._sketch, counts=counts * 0, settings=settings), ngram_join._SKETCH_DDL)
    whole = sketch.withColumn("first", F.array(F.lit(7).cast("long")))
    join = ngram_join._Join(docs, whole, settings)
    assert join.star_pairs().count() == 0
    assert {(r.a, r.b) for r in join.cross_pairs(spark.createDataFrame([], "id long, component long")).collect()} == {(2, 3)}


def test_parity_bits_never_differ_more_than_sets():
    random_ = np.random.default_rng(5)
    pool = random_.integers(0, 1 << 63, 3000).astype(np.uint64)
    for size_a, size_b in [(0, 0), (0, 3), (1, 1), (1, 40), (30, 33), (60, 70), (500, 520), (511, 513), (3000, 100)]:
        a, b = (np.unique(random_.choice(pool, n, replace=False)) for n in (size_a, size_b))
        differing = ngram_join.differing_bits(ngram_join.parity_bits(a), ngram_join.parity_bits(b))
        assert differing <= len(np.setxor1d(a, b))
        assert ngram_join.differing_bits(ngram_join.parity_bits(a), ngram_join.parity_bits(a)) == 0
    apart = ngram_join.differing_bits(ngram_join.parity_bits(pool[:1000]), ngram_join.parity_bits(pool[150:1150]))
    assert 200 <= apart <= 300


def test_sets_of_pairs_that_cannot_link_do_not_move(spark):
    words = [f"w{i}" for i in range(400)]
    half = [w if i % 160 < 110 else f"x{i}" for i, w in enumerate(words)]
    near = words[:200] + ["new"] + words[201:]
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate((words, half, near))], "doc_id long, text string")
    settings = JoinSettings()
    counts = ngram_join.cell_counts(docs, 3, "text")
    sketch = docs.mapInArrow(partial(ngram_join._sketch, counts=counts * 0, settings=settings), ngram_join._SKETCH_DDL)
    met = spark.createDataFrame([(0, 1), (0, 2)], "a long, b long")
    whole = sketch.withColumn("others", F.array(*[F.array(F.lit(7))] * settings.filters))
    assert {tuple(r) for r in ngram_join._Join(docs, whole, settings)._filtered(met).collect()} == {(0, 2)}
