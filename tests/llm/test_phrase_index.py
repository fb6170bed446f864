"""The positional index against a scan of every text."""

import hashlib
import random
import re

import numpy as np
import pytest

from tickloom.llm.phrase_index import IndexSettings, build_index, contamination, pack, proximity_matches, unpack, word_array, words_of

DOCS = "doc_id long, text string, block string, term string, phrases int, n_hit int"
ITEMS = "item_id long, text string, doc_id string, words string, phrase_id int"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
NO_ITEMS = hashlib.sha256(b"").hexdigest()


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, width):
    windows = []
    for item, text in items:
        found = words(text)
        size = min(width, len(found))
        windows += [(item, tuple(found[i : i + size])) for i in range(len(found) - size + 1) if size]
    rows = []
    for doc_id, text in docs:
        text = words(text)
        hit, met = set(), set()
        for item, run in windows:
            for i in range(len(text) - len(run) + 1):
                if tuple(text[i : i + len(run)]) == run:
                    hit.update(range(i, i + len(run)))
                    met |= {item} - {None}
        digest = hashlib.sha256(",".join(sorted(map(str, met))).encode()).hexdigest()
        rows.append((doc_id, len(text), len(hit), len(met), digest, bool(hit)))
    return sorted(rows, key=repr)


def brute_near(docs, items, terms, span):
    lists = [words(t) for _, t in docs]
    totals = {}
    for text in lists:
        for w in text:
            totals[w] = totals.get(w, 0) + 1
    rows = []
    for item in {i for i, _ in items}:
        known = {w for i, t in items if i == item for w in words(t) if w in totals}
        rare = set(sorted(known, key=lambda w: (totals[w], w.encode()))[:terms])
        for (doc_id, _), text in zip(docs, lists):
            for end in range(len(text)) if rare else ():
                begins = [b for b in range(max(0, end - span + 1), end + 1) if rare <= set(text[b : end + 1])]
                # Shortest with this end, and not longer than one with an earlier end.
                if begins and not rare <= set(text[begins[-1] : end]):
                    rows.append((str(item), doc_id, begins[-1], end - begins[-1] + 1))
    return sorted(rows, key=repr)


def frames(spark, docs, items):
    return (
        spark.createDataFrame([(*r, "x", "y", 1, 2) for r in docs], DOCS),
        spark.createDataFrame([(*r, "x", "y", 1) for r in items], ITEMS),
    )


def result(df):
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    return sorted(map(tuple, df.select(*names).collect()), key=repr)


def corpus(seed, vocabulary=12):
    draw = random.Random(seed)
    names = [f"w{i}" for i in range(vocabulary)]
    items = [(i, " ".join(draw.choices(names, k=draw.choice([1, 2, 3, 5, 9])))) for i in range(25)]
    items += [(100 + i, text) for i, (_, text) in enumerate(items[:5])]
    docs = []
    for i in range(60):
        text = draw.choices(names + [f"r{draw.randrange(500)}" for _ in range(8)], k=draw.choice([0, 3, 30, 90]))
        for _ in range(draw.choice([0, 0, 1, 2])):
            at = draw.randrange(len(text) + 1)
            text[at:at] = draw.choice(items)[1].upper().split()
        docs.append((i, draw.choice([" ", ", ", "\n"]).join(text)))
    return docs, items


@pytest.mark.parametrize("seed,width,block_bytes,shards", [(1, 4, 1 << 22, 32), (2, 3, 400, 4), (3, 10, 150, 1), (4, 1, 250, 7)])
def test_equals_a_scan(spark, seed, width, block_bytes, shards):
    docs, items = corpus(seed)
    got = contamination(*(f.repartition(3) for f in frames(spark, docs, items)), width, IndexSettings(block_bytes, shards))
    assert result(got) == brute(docs, items, width)


def test_edge_cases(spark):
    docs = [(1, None), (2, ""), (3, " .,-"), (4, "One two"), (5, "one-TWO three"), (6, "été à Été"), (None, "one two"), (7, "x" * 100_000)]
    docs += [(8, "one two " * 30_000), (9, "one"), (9, "one"), (9, "two"), (10, "two one"), (11, "\x00one\x7ftwo\x80"), (12, "日本 one two 語")]
    items = [(1, "one two"), (1, "one two"), (2, "ONE, two!"), (3, None), (4, "--"), (None, "two one"), (5, "été à"), (6, "missing one"), (10, "one")]
    for width in (1, 2, 10):
        assert result(contamination(*frames(spark, docs, items), width, IndexSettings(200, 3))) == brute(docs, items, width)
    given, asked = frames(spark, docs, items)
    assert contamination(given.limit(0), asked).count() == 0
    assert all(r[2:] == (0, 0, NO_ITEMS, False) for r in result(contamination(given, asked.limit(0))))


def test_hot_passages_and_items(spark):
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    docs = [(i, f"the the {passage} the {'the ' * (i % 7)} {passage if i % 2 else ''}") for i in range(300)]
    items = [(i, passage if i % 3 else f"{passage} the") for i in range(90)] + [(500, "the the the")]
    got = contamination(*frames(spark, docs, items), 10, IndexSettings(800, 4))
    assert result(got) == brute(docs, items, 10)


@pytest.mark.parametrize("seed,terms,span", [(1, 3, 8), (2, 2, 4), (5, 5, 30)])
def test_proximity_equals_a_scan(spark, seed, terms, span):
    docs, items = corpus(seed, 40)
    items += [(200, "unknown w1"), (201, "unknown"), (202, None)]
    given, asked = frames(spark, docs, items)
    settings = IndexSettings(600, 5)
    got = proximity_matches(build_index(given, settings), asked, terms, span, settings)
    want = brute_near(docs, items, terms, span)
    assert want and sorted(map(tuple, got.collect()), key=repr) == want


def test_packed_numbers_come_back():
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**31, 2**40, 5], np.int64)
    packed, ends = pack(values)
    assert unpack(packed.tobytes()).tolist() == values.tolist() and ends[-1] == len(packed)
    assert unpack(pack(values[:0])[0].tobytes()).tolist() == []


def test_words_are_those_of_the_pattern():
    for point in [*range(0x180), 0x2028, 0x3000, 0xFFFD, 0x1F600]:
        text = f"aB{chr(point)}9z"
        assert [w.decode() for w in words_of(text.encode())] == words(text)
        found, sizes = word_array([text.encode(), None, b"", text.encode()])
        assert [w.decode() for w in found.to_pylist()] == [f"{w} " for w in words(text) * 2]
        assert sizes.tolist() == [len(words(text)), 0, 0, len(words(text))]
