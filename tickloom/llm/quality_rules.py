"""Quality rules: counts within a document and line frequency across the documents of a host."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import id_bitmaps, unused, with_membership
from tickloom.settings import materialize

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class RuleLimits:
    """``base_*``: the document alone. A line is common on a host if it stands in at least
    ``line_min_docs`` different texts, however many the host has, and in more than
    ``line_share_pct`` percent of them (0: the count alone decides). A document is depleted if more than ``depleted_pct`` percent of its words are in such lines.
    """

    base_min_words: int = 50
    base_repeat_pct: int = 50
    line_min_docs: int = 10
    line_share_pct: int = 0
    depleted_pct: int = 60


_STATS = pa.schema(
    [
        ("doc_id", pa.int64()), ("host", pa.string()), ("row_hash", pa.int64()), ("text_hash", pa.binary()),
        ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()),
        ("n_repeat_words", pa.int64()), ("lines", pa.list_(pa.struct([("hash", pa.int64()), ("words", pa.int64())]))),
    ]
)
_STATS_DDL = (
    "doc_id long, host string, row_hash long, text_hash binary, n_words long, word_chars long, n_symbols long, "
    "n_dup_lines long, n_repeat_words long, lines array<struct<hash: long, words: long>>"
)
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window found twice or more in the list."""
    n = len(words)
    if n < 4:
        return 0
    last = dict(zip(words, range(n)))
    ids = np.fromiter(map(last.__getitem__, words), np.int64, n)
    pairs = ids[:-2] * n + ids[1:-1]
    if n > 2_000_000:  # three of them would not fit 64 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, inverse, counts = np.unique(pairs * n + ids[2:], return_inverse=True, return_counts=True)
    windows = counts[inverse] > 1
    covered = np.zeros(n, bool)
    for step in range(3):
        covered[step : n - 2 + step] |= windows
    return int(covered.sum())


def line_key(words: list[bytes]) -> int:
    """Hash of a normalised line: its words, A-Z in lower case, one blank between them."""
    return xxhash.xxh64_intdigest(b" ".join(words).lower()) - (1 << 63)


def _statistics(text: str) -> tuple:
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    earlier, duplicates, lines = set(), 0, {}
    for line in data.split(b"\n"):
        if inside := line.split():
            duplicates += line in earlier
            earlier.add(line)
            key = line_key(inside)
            lines[key] = lines.get(key, 0) + len(inside)
    word_chars = len(text) - sum(map(text.count, BLANKS))
    return len(words), word_chars, sum(map(text.count, SYMBOLS)), duplicates, repeated_words(words), lines


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            rows = batch.slice(at, 1000)
            texts = [text or "" for text in rows.column(3).to_pylist()]
            stats = list(map(_statistics, texts))
            hashes = [xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")) for t in texts]
            columns = [*zip(*(s[:5] for s in stats))]
            lines = [[{"hash": k, "words": v} for k, v in s[5].items()] for s in stats]
            arrays = [rows.column(0), rows.column(1), rows.column(2), pa.array(hashes, pa.binary())]
            arrays += [pa.array(c, pa.int64()) for c in columns] + [pa.array(lines, _STATS.field("lines").type)]
            yield pa.RecordBatch.from_arrays(arrays, schema=_STATS)


def row_hash(id_col: str, host_col: str, text_col: str) -> Column:
    """Hash of the columns a decision rests on; rows that share it share the decision."""
    names = (id_col, host_col, text_col)
    return F.xxhash64(*(F.col(c) for c in names), *(F.col(c).isNull() for c in names))


def _measured(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("h"), F.col(host_col).cast("string")), F.lit("-")).alias("host"),
        row_hash(id_col, host_col, text_col).alias("row_hash"),
        F.col(text_col).alias("text"),
    )
    return rows.mapInArrow(_measure, _STATS_DDL)


def _common_lines(stats: DataFrame, limits: RuleLimits) -> DataFrame:
    """(host, hash) of the lines above the limits; texts that are equal count once."""
    texts = stats.groupBy("host", "text_hash").agg(F.min("row_hash").alias("row_hash"))
    counted = stats.join(texts.select("host", "row_hash"), ["host", "row_hash"], "left_semi")
    counted = counted.dropDuplicates(["host", "row_hash"])
    lines = counted.select("host", F.explode("lines.hash").alias("hash"))
    often = lines.groupBy("host", "hash").agg(F.count("*").alias("n")).filter(F.col("n") >= limits.line_min_docs)
    hosts = texts.groupBy("host").agg(F.count("*").alias("texts"))
    above = F.col("n") * 100 > F.col("texts") * limits.line_share_pct
    return often.join(hosts, "host").filter(above).select("host", "hash")


def measure_quality(
    docs: DataFrame,
    limits: RuleLimits = RuleLimits(),
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
) -> DataFrame:
    """One row per document: its counts, ``base_failed``, ``common_words``, ``kept``.

    ``common_words`` are the words in lines that are common on the document's host, of which
    ``common_lines`` holds the hashes. Copies of one text count once towards a line's frequency,
    so a much copied document isn't taken for boilerplate. ``row_hash`` identifies the row.

    A null text is empty; a null host is a host of its own; null ids and repeated rows are kept,
    the latter with equal verdicts. Other columns are dropped. An empty table gives no rows.
    """
    stats = materialize(_measured(docs, id_col, text_col, host_col), "quality")
    common = materialize(_common_lines(stats, limits), "common-lines")
    lines = stats.select("host", "row_hash", F.inline("lines")).join(common, ["host", "hash"])
    found = lines.groupBy("host", "row_hash", "hash").agg(F.max("words").alias("words"))
    found = found.groupBy("row_hash").agg(
        F.sum("words").alias("common_words"), F.collect_list("hash").alias("common_lines")
    )
    base = (F.col("n_words") < limits.base_min_words) | (
        100 * F.col("n_repeat_words") > limits.base_repeat_pct * F.col("n_words")
    )
    depleted = 100 * F.col("common_words") > limits.depleted_pct * F.col("n_words")
    return (
        stats.drop("lines", "text_hash")
        .join(found, "row_hash", "left")
        .withColumn("common_words", F.coalesce("common_words", F.lit(0)))
        .withColumn("base_failed", base)
        .withColumn("kept", ~base & ~depleted)
        .select("doc_id", *COUNTS, "base_failed", "common_words", "common_lines", "kept", "row_hash")
    )


def _without_lines(texts: pa.Array, drop: pa.Array) -> pa.Array:
    out = []
    for text, hashes in zip(texts.to_pylist(), drop.to_pylist()):
        if text is not None and hashes:
            common = set(hashes)
            lines = text.split("\n")
            words = (line.encode("utf-8", "surrogatepass").split() for line in lines)
            text = "\n".join(line for line, w in zip(lines, words) if not w or line_key(w) not in common)
        out.append(text)
    return pa.array(out, texts.type)


def _drop_lines(batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[pa.RecordBatch]:
    for part in (batch.slice(at, 1000) for batch in batches for at in range(0, batch.num_rows, 1000)):
        columns = part.columns
        columns[text_at] = _without_lines(columns[text_at], columns[-1])
        yield pa.RecordBatch.from_arrays(columns[:-1], names=part.schema.names[:-1])


def apply_quality(
    docs: DataFrame,
    limits: RuleLimits = RuleLimits(),
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
) -> DataFrame:
    """``docs`` without the rejected ones, and without the lines that are common on their host.

    All columns stay; the cases of :func:`measure_quality` hold. Texts move only where lines go, or
    where rows that share an id, or have none, must be told apart.
    """
    row, kept, lines = (unused(docs, name) for name in ("row_hash", "kept", "common_lines"))
    measured = measure_quality(docs, limits, id_col, text_col, host_col)
    verdicts = materialize(measured.select("doc_id", "row_hash", "kept", "common_lines"), "verdicts")
    acted = verdicts.filter(~F.col("kept") | F.col("common_lines").isNotNull())
    ids = {"acted_id": id_bitmaps(acted, "doc_id"), "kept_id": id_bitmaps(verdicts.filter("kept"), "doc_id")}
    acted = acted.select(F.col("row_hash").alias(row), F.col("kept").alias(kept), F.col("common_lines").alias(lines))
    acted = materialize(acted.dropDuplicates([row]), "acted")
    flagged, flags = docs, []
    for name, bitmaps in ids.items():
        flags.append(unused(flagged, name))
        flagged = with_membership(flagged, id_col, bitmaps, flags[-1])
    is_acted, is_kept = map(F.col, flags)
    moved = flagged.filter(F.col(id_col).isNull() | (is_acted & is_kept)).select(*docs.columns)
    joined = moved.withColumn(row, row_hash(id_col, host_col, text_col)).join(acted, row, "left")
    left = joined.filter(F.coalesce(kept, F.lit(True)))
    drop = partial(_drop_lines, text_at=docs.columns.index(text_col))
    changed = left.select(*docs.columns, lines).mapInArrow(drop, docs.schema)
    return changed.unionByName(flagged.filter(F.col(id_col).isNotNull() & ~is_acted).select(*docs.columns))
