"""Kneser-Ney perplexities against a plain Python model."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tickloom.llm.kneser_ney import ALPHABET, ModelSettings, _probabilities, gram_keys, keep_fluent, runs, score_documents
from tickloom.llm.queries import op1_kneser_ney

SCHEMA = "doc_id long, text string, lang string, kept string, row_hash string, block string"
LABELS = "doc_id long, quality int, lang string, text string"


def grams(text, order):
    padded = "\0" * (order - 1) + text
    return [padded[i : i + order] for i in range(len(text))]


class Plain:
    def __init__(self, texts, order):
        self.levels = {order: Counter(g for t in texts for g in grams(t, order))}
        for k in range(order - 1, 0, -1):
            self.levels[k] = Counter(g[1:] for g in self.levels[k + 1])
        self.rates = {k: self.discounts(c) for k, c in self.levels.items()}
        self.contexts = {k: defaultdict(list) for k in self.levels}
        for k, counts in self.levels.items():
            for g, n in counts.items():
                self.contexts[k][g[:-1]].append(n)

    @staticmethod
    def discounts(counts):
        n = Counter(counts.values())
        y = n[1] / max(1, n[1] + 2 * n[2])
        out = [0.0]
        for k in (1, 2, 3):
            value = k - (k + 1) * y * n[k + 1] / n[k] if n[k] and n[k + 1] else k / 2
            out.append(max(0.0, min(value, k)))
        return out

    def p(self, gram):
        k = len(gram)
        if k == 0:
            return 1 / ALPHABET
        lower, context = self.p(gram[1:]), self.contexts[k].get(gram[:-1])
        if not context:
            return lower
        cut = lambda n: self.rates[k][min(n, 3)]
        n = self.levels[k][gram]
        own = n - cut(n) if n else 0
        return (own + sum(map(cut, context)) * lower) / sum(context)

    def perplexity(self, text, order):
        return math.exp(-sum(math.log(self.p(g)) for g in grams(text, order)) / len(text))


def fixture(spark):
    words = "the cat sat on a mat and then it ran off with all of them".split()
    rows = [(i, " ".join(words[(i * 7 + j * j) % len(words)] for j in range(5 + i % 9)), "en", "k", "r", "b") for i in range(300)]
    rows += [(5000 + i, "der hund " * (i % 5) + "lief é weg", "de", None, None, None) for i in range(40)]
    rows += [(9000, "zq#x" * 30, "en", "", "", ""), (9001, None, "en", "", "", ""), (9002, "", None, "", "", "")]
    rows += [(9003, "no model here", "xx", "", "", ""), (None, "the cat", "en", "", "", ""), (None, "qqqq zzzz", "en", "", "", "")]
    rows += [(9004, "the cat sat", "en", "", "", "")] * 2 + [(-7, "it ran off 日本 \0", "en", "", "", "")]
    labels = [(i, int(i % 3 > 0), "l", "t") for i in range(300)] + [(5000 + i, 1, "l", "t") for i in range(40)]
    labels += [(None, 1, "", ""), (9000, None, "", ""), (77777777, 1, "", "")]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS), rows, labels


@pytest.mark.parametrize("order,block", [(4, 64), (2, 4096)])
def test_perplexity_is_that_of_the_plain_model(spark, order, block):
    docs, labels, rows, marks = fixture(spark)
    settings = ModelSettings(order=order, block_docs=block)
    fold = {r.doc_id: r.f for r in docs.selectExpr("doc_id", "pmod(xxhash64(doc_id), 100) f").collect()}
    good = {i for i, q, *_ in marks if q == 1 and i is not None}
    models = {}
    for lang in ("en", "de"):
        models[lang] = Plain([t for i, t, g, *_ in rows if g == lang and t and i in good and fold[i] >= 10], order)
    got = score_documents(docs, labels, settings).collect()
    assert len(got) == len(rows)
    want = Counter()
    for i, text, lang, *_ in rows:
        ppl = round(models[lang].perplexity(text, order), 6) if text and lang in models else None
        want[i, len(text or ""), ppl] += 1
    assert Counter((r.doc_id, r.n_chars, r.perplexity and round(r.perplexity, 6)) for r in got) == want
    for lang in models:
        held = sorted(r.perplexity for r in got if r.lang == lang and r.doc_id in good and fold[r.doc_id] < 10)
        limit = held[max(0, math.ceil(0.99 * len(held)) - 1)] * 1.15
        assert all(math.isclose(r.threshold, limit) for r in got if r.lang == lang)
    for r in got:
        fine = r.perplexity is None or r.threshold is None or r.perplexity <= r.threshold
        assert r.kept == (fine and r.n_chars > 0)


def test_rejected_documents_go(spark):
    docs, labels, rows, _ = fixture(spark)
    left = keep_fluent(docs, labels, ModelSettings(slack=3.0))
    assert left.columns == docs.columns
    ids = Counter(r.doc_id for r in left.collect())
    assert ids[9004] == 2 and ids[9003] == 1 and ids[None] == 1
    assert not {9000, 9001, 9002} & set(ids) and ids[1] == 1
    assert keep_fluent(docs.limit(0), labels).count() == 0
    assert score_documents(docs, labels.limit(0)).filter("perplexity is null").count() == len(rows)


def test_query_keeps_labelled_good_documents(spark):
    path = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{path}/labels.parquet")
    rows = op1_kneser_ney(spark, path).join(labels, "doc_id").collect()
    kept = [r.kept for r in rows if r.quality == 1]
    assert sum(kept) > 0.97 * len(kept)
    assert sum(r.kept for r in rows if r.quality == 0) < 0.7 * sum(r.quality == 0 for r in rows)


def test_long_texts_are_cut_without_a_trace():
    texts = ["abc" * 50, "", "x", "é日" * 20, "qq\0"]
    whole, lengths = gram_keys(texts, 4)
    found, n = [], np.zeros(len(texts), int)
    for which, keys, chars in runs(texts, 4, 7):
        found.append(keys)
        np.add.at(n, which, chars)
    assert len(found) > 20 and (np.concatenate(found) == whole).all() and (n == lengths).all()


def test_blocks_of_few_bytes_give_the_same_scores(spark):
    docs, labels, _, _ = fixture(spark)
    docs = docs.unionByName(spark.createDataFrame([(9500, "the cat ran off " * 40_000, "en", "", "", "")], SCHEMA))
    scores = [
        sorted(score_documents(docs, labels, ModelSettings(block_bytes=size)).collect(), key=repr) for size in (1, 32 << 20)
    ]
    assert len(scores[0]) == docs.count()
    assert [(r.doc_id, r.n_chars, r.kept) for r in scores[0]] == [(r.doc_id, r.n_chars, r.kept) for r in scores[1]]
    assert all(math.isclose(a.perplexity or 1, b.perplexity or 1, rel_tol=1e-9) for a, b in zip(*scores))


def test_no_plan_holds_all_orders(spark):
    plain = Plain(["abcabd", "abe"], 4)
    counts = {g: n for g, n in plain.levels[4].items()} | {"\0abx": 0}
    key = lambda gram: int("".join(f"{0 if c == chr(0) else ord(c) + 1:03x}" for c in gram), 16)
    rows = spark.createDataFrame([("en", key(g), n) for g, n in counts.items()], "lang string, gram long, n long")
    known = _probabilities(rows, 4)
    got = {r.gram: r.p for r in known.collect()}
    assert got == pytest.approx({key(g): plain.p(g) for g in counts})
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Aggregate") <= 4
    assert not re.search(r"hashpartitioning\(lang#\d+, \d+\)", plan)
