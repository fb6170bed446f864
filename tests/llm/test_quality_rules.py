"""Quality rules against plain Python."""

import re
from collections import Counter, defaultdict

import pytest

from tickloom.llm.quality_rules import RuleLimits, apply_quality, measure_quality
from tickloom.llm.queries import op7_quality_rules

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    words = WORD.findall(text or "")
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def brute(rows, limits):
    """(doc_id, host, text) rows to verdicts."""
    norm = lambda line: re.sub("[A-Z]+", lambda m: m[0].lower(), " ".join(WORD.findall(line)))
    texts, seen = defaultdict(set), defaultdict(set)
    for _, host, text in rows:
        texts[host].add(text or "")
        for line in (text or "").split("\n"):
            if WORD.search(line):
                seen[host, norm(line)].add(text)
    out = []
    for doc_id, host, text in rows:
        n, *rest = counts(text)
        failed = n < limits.base_min_words or 100 * rest[-1] > limits.base_repeat_pct * n
        common = 0
        for line in (text or "").split("\n"):
            docs = len(seen[host, norm(line)])
            if docs >= limits.line_min_docs and 100 * docs > limits.line_share_pct * len(texts[host]):
                common += len(WORD.findall(line))
        out.append((doc_id, n, *rest, failed, not failed and 100 * common <= limits.depleted_pct * n, common))
    return sorted(out, key=repr)


def result(df):
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "common_words"]
    return sorted(map(tuple, df.select(columns).collect()), key=repr)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_brute_force(spark, sf):
    path = f"/root/testdata/{sf}"
    rows = [(r.doc_id, r.source, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    assert result(op7_quality_rules(spark, path)) == brute(rows, RuleLimits())


SCHEMA = "doc_id long, text string, source string, kept string, row_hash string, host string"


def test_edge_cases(spark):
    menu = "Home  Shop\tCart é"
    rows = [(i, f"{menu}\nown line {i} \x0b x", "a", "k", "r", "h") for i in range(12)]
    rows += [(20 + i, f"{menu}\nshort{i}", None, None, None, None) for i in range(12)]
    rows += [(50, None, "a", "", "", ""), (51, "", "a", "", "", ""), (None, menu, None, "", "", ""), (None, menu, None, "", "", "")]
    rows += [(60, "w " * 50_000, "b", "", "", ""), (61, "a b c a b c", "b", "", "", "")]
    rows += [(70 + i, "copied text of one host\nmany times", "c", "", "", "") for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    limits = RuleLimits(base_min_words=2)
    want = brute([(r[0], r[2], r[1]) for r in rows], limits)
    assert result(measure_quality(df, limits)) == want
    kept = {(r[0], r[-2]) for r in want}
    assert (70, True) in kept and (20, False) in kept and (60, False) in kept and (0, False) not in kept
    assert measure_quality(df.limit(0)).count() == 0
    left = apply_quality(df, limits)
    assert left.columns == df.columns
    got = {r.doc_id: r for r in left.collect()}
    assert got[0].text == "own line 0 \x0b x" and (got[0].kept, got[0].row_hash, got[0].host) == ("k", "r", "h")
    assert 20 not in got and 50 not in got and got[70].text.startswith("copied")
    assert left.count() == sum(r[-2] for r in want)


def test_a_line_in_many_texts_is_common_on_a_large_host(spark):
    rows = [(i, f"own line number {i}" + "\nshared by a few of many" * (i < 15), "big", "k", "r", "h") for i in range(400)]
    got = {r.doc_id: r.common_words for r in measure_quality(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: 6 * (i < 15) for i in range(400)}


def test_rows_of_one_id_are_told_apart(spark):
    line = "this one line stands in all of the texts"
    rows = [(i, f"h{i % 2}", f"{line}\n" + " ".join(f"w{i}x{j}" for j in range(60))) for i in range(30)]
    rows += [(0, "h0", "too short"), (40, "h0", "short too"), (None, "h0", "no id"), (None, "h1", rows[1][2]), (41, "h2", " ".join(f"v{j}" for j in range(70)))]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = apply_quality(docs)
    assert "getbit" in got._jdf.queryExecution().optimizedPlan().toString()  # texts of other rows don't move
    want = [(i, h, t.removeprefix(f"{line}\n")) for i, h, t in rows if len(t.split()) >= 50]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
