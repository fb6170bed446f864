"""Line de-duplication against all pairs."""

import random
import re
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tickloom.llm.line_dedup import _candidates, _classes, _described, _hub_pairs, _lines, dedup_lines
from tickloom.llm.queries import op6_line_dedup
from tickloom.settings import materialize, scratch_path

SCHEMA = "doc_id long, text string, n_lines string, place string, row_hash string"


def tokens(line, min_words=5):
    words = [w for w in re.split("[ \t\x0b\x0c\r]+", line.lower()) if w]
    return frozenset(zip(words, words[1:])) if len(words) >= min_words else None


def brute(rows, percent=80):
    """(doc_id, text), in order, to (doc_id, lines, removed, text)."""
    lists, seen, out = defaultdict(set), [], []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        lines, kept = [] if text is None else text.split("\n"), []
        for line in lines:
            s = tokens(line)
            if s is None:
                kept.append(line)
                continue
            near = {i for t in s for i in lists[t]}
            matched = any(100 * len(s & seen[i]) >= percent * len(s | seen[i]) for i in near)
            if not matched:
                kept.append(line)
            for t in s:
                lists[t].add(len(seen))
            seen.append(s)
        out.append((doc_id, len(lines), len(lines) - len(kept), None if text is None else "\n".join(kept)))
    return sorted(out, key=repr)


def result(df):
    return sorted(map(tuple, df.select("doc_id", "n_lines", "n_removed", "text").collect()), key=repr)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_all_pairs(spark, sf):
    path = f"/root/testdata/{sf}"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    assert result(op6_line_dedup(spark, path)) == brute(rows)


@pytest.mark.parametrize("percent", [50, 80, 100])
def test_near_lines(spark, percent):
    random_ = random.Random(percent)
    words = [f"w{i}" for i in range(60)]
    bases = [[random_.choice(words) for _ in range(random_.randint(3, 40))] for _ in range(12)]
    rows = []
    for i in range(40):
        lines = []
        for _ in range(random_.randint(1, 5)):
            line = list(random_.choice(bases))
            for _ in range(random_.randint(0, 3)):
                line[random_.randrange(len(line))] = random_.choice(words)
            lines.append(" ".join(line))
        rows.append((i * 3 % 41, "\n".join(lines)))
    df = spark.createDataFrame([(*r, "n", "p", "r") for r in rows], SCHEMA)
    assert result(dedup_lines(df, percent)) == brute(rows, percent)


def test_edge_cases(spark):
    line = "one two three four five six"
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, f"{line}\nshort\n{line.upper()}  "), (5, f"short\n{line}"), (None, f"first of all comes this line\n{line}")]
    rows += [(6, "a b c d e " * 30_000), (7, "a b c d e " * 30_000), (8, "\n".join(f"line {i} of a very long document" for i in range(3000)))]
    df = spark.createDataFrame([(*r, "n", "p", "r") for r in rows], SCHEMA)
    got = dedup_lines(df)
    assert result(got) == brute(rows)
    assert set(got.columns) == {"doc_id", "text", "place", "row_hash", "n_lines", "n_removed"}
    assert {(r.place, r.row_hash) for r in got.collect()} == {("p", "r")}
    twice = spark.createDataFrame([(1, f"{line}\nx", "", "", "")] * 2 + [(1, f"{line} seven\ny", "", "", "")], SCHEMA)
    assert sorted(r.n_removed for r in dedup_lines(twice).collect()) in ([0, 0, 1], [0, 1, 1])
    assert dedup_lines(df.limit(0)).count() == 0
    assert result(dedup_lines(df.filter("doc_id < 4"))) == brute(rows[:3])


def test_no_python_in_the_plan(spark):
    plan = op6_line_dedup(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_lines_are_split_once(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("row", F.xxhash64("text"))
    lines = _lines(docs, 5).filter(F.size("tokens") > 3)
    assert lines._jdf.queryExecution().optimizedPlan().toString().count("zip_with(") == 1
    classes = materialize(_classes(_described(lines, 80)))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        made = _candidates(classes, 80)
        made.collect()
        assert "ReusedExchange" in made._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_candidates_share_several_tokens(spark):
    base = [f"w{i}" for i in range(40)]
    near = base[:10] + ["other"] + base[11:]
    far = [f"x{i}" for i in range(20)] + base[:2] + [f"y{i}" for i in range(18)]
    docs = spark.createDataFrame([(i, i, " ".join(words)) for i, words in enumerate((base, near, far))], "doc_id long, row long, text string")
    head = F.xxhash64(F.lit("w0"), F.lit("w1"))
    order = lambda tokens: F.concat(F.filter(tokens, lambda t: t == head), F.filter(tokens, lambda t: t != head))
    classes = materialize(_classes(_described(_lines(docs, 5, order), 80)))
    ids = {r.place.doc_id: r.id for r in classes.collect()}
    assert {frozenset(r) for r in _candidates(classes, 80).collect()} == {frozenset((ids[0], ids[1]))}


def test_changed_texts_are_split_once(spark):
    line = "one two three four five six"
    docs = spark.createDataFrame([(1, f"{line}\na"), (2, f"{line}\nb")], "doc_id long, text string")
    plan = dedup_lines(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 2  # of documents that lose lines, and of all others


def test_tables_of_the_search_go_with_it(spark):
    shared = Path(scratch_path(spark, "probe").removeprefix("file:")).parent
    before = set(shared.iterdir()) if shared.exists() else set()
    line = "one two three four five six"
    docs = spark.createDataFrame([(1, f"{line}\na"), (2, f"{line}\nb")], "doc_id long, text string")
    got = dedup_lines(docs)
    assert sorted({p.name.rsplit("-", 1)[0] for p in set(shared.iterdir()) - before}) == ["bitmaps", "gone-lines"]
    assert sorted(r.text for r in got.collect()) == ["b", f"{line}\na"]


def test_near_copies_meet_in_hubs(spark):
    random_ = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(80):
        words = list(base)
        for _ in range(2):
            words[random_.randrange(60)] = f"x{i}"
        rows.append((i, i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, row long, text string")
    classes = materialize(_classes(_described(_lines(docs, 5), 80)))
    assert 79 <= _hub_pairs(classes).count() <= 4 * 80
    settled = classes.withColumn("done", F.col("place.doc_id") > 2)
    assert _candidates(settled, 80).count() <= 3 < 1000 < _candidates(classes, 80).count()
