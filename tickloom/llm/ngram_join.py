"""Near-duplicate documents by an exact Jaccard join with several global token orders."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import components, id_bitmaps, unused, with_membership
from tickloom.llm.text import WordHashes, ascii_words, mix, shingle_set
from tickloom.settings import materialize

RARITY_BITS = 18


@dataclass(frozen=True)
class JoinSettings:
    """Documents link when ``100 * intersection >= percent * union`` of their sets of runs of
    ``width`` words. ``filters`` is the number of token orders beside the first one.
    """

    width: int = 3
    percent: int = 90
    filters: int = 2

    def prefix(self, size: int) -> int:
        """Tokens of which one must be shared: all but what may be missing from the set."""
        return size - -(-self.percent * size // 100) + 1

    def sizes_fit(self, a: Column, b: Column) -> Column:
        return (100 * a >= self.percent * b) & (100 * b >= self.percent * a)

    def places_fit(self, n_a: Column, at_a: Column, n_b: Column, at_b: Column) -> Column:
        """Whether a first shared token at these places leaves enough tokens to share."""
        left = F.least(n_a - at_a, n_b - at_b).cast("long")
        return (100 + self.percent) * left >= self.percent * (n_a + n_b).cast("long")


class _Sets:
    """Shingle sets of texts; remembers word hashes."""

    def __init__(self, width: int):
        self._hashes, self._width = WordHashes(), width

    def of(self, text: str | None) -> np.ndarray:
        return shingle_set(self._hashes.of(ascii_words(text)), self._width)


def rarity_cells(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - RARITY_BITS)).astype(np.int64)


def _count_cells(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    sets, counts = _Sets(width), np.zeros(1 << RARITY_BITS, np.int64)
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            tokens = [sets.of(text) for text in batch.column(0).slice(at, 200).to_pylist()]
            counts += np.bincount(rarity_cells(np.concatenate(tokens)), minlength=len(counts))
    cells = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(counts[cells])], names=["cell", "n"])


def cell_counts(docs: DataFrame, width: int, text_col: str) -> np.ndarray:
    """How often tokens fall into each of 2**18 cells: a fixed-size guide to their rarity."""
    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(partial(_count_cells, width=width), "cell long, n long")
    counts = np.zeros(1 << RARITY_BITS, np.int64)
    for row in rows.groupBy("cell").agg(F.sum("n").alias("n")).toArrow().to_batches():
        counts[row.column(0).to_numpy()] = row.column(1).to_numpy()
    return counts


def prefixes(tokens: np.ndarray, counts: np.ndarray, settings: JoinSettings) -> list[np.ndarray]:
    """The set's first tokens under every order.

    The first order goes by the counts of the tokens' cells. The others only put tokens of far
    more frequent cells last and otherwise shuffle, each in its own way; one order's accidents
    are not another's.
    """
    size = settings.prefix(len(tokens))
    seen = counts[rarity_cells(tokens)]
    coarse = np.floor(np.log2(np.maximum(seen / max(counts.mean(), 1e-9), 1))).astype(np.int64)
    orders = [np.lexsort((tokens, seen))]
    orders += [np.lexsort((mix(tokens, k + 1), coarse)) for k in range(settings.filters)]
    return [tokens[order[:size]] for order in orders]


def parity_bits(tokens: np.ndarray) -> bytes:
    """One bit per bucket of tokens, two to four buckets a token: whether it holds an odd number."""
    size = max(64, 1 << (2 * len(tokens) - 1).bit_length()) if len(tokens) else 64
    counts = np.bincount((tokens & np.uint64(size - 1)).astype(np.int64), minlength=size)
    return np.packbits(counts.astype(np.uint8) & 1).tobytes()


def differing_bits(x: bytes, y: bytes) -> int:
    """Buckets whose parity differs, at most as many as tokens that only one of the sets has.

    The halves of a larger bitmap, combined, are the bitmap of half as many buckets.
    """
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(a) != len(b):
        a, b = (a, b) if len(a) > len(b) else (b, a)
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


_SKETCH = pa.schema(
    [
        ("doc_id", pa.int64()), ("n", pa.int32()), ("key", pa.binary()), ("first", pa.list_(pa.int64())), ("others", pa.list_(pa.list_(pa.int32()))),
        ("parity", pa.binary()),
    ]
)
_SKETCH_DDL = "doc_id long, n int, key binary, first array<long>, others array<array<int>>, parity binary"


def _sketch(batches: Iterator[pa.RecordBatch], counts: np.ndarray, settings: JoinSettings) -> Iterator[pa.RecordBatch]:
    sets = _Sets(settings.width)
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            sizes, keys, first, others, parity = [], [], [], [], []
            for text in part.column(1).to_pylist():
                tokens = sets.of(text)
                heads = prefixes(tokens, counts, settings) if len(tokens) else [tokens] * (settings.filters + 1)
                sizes.append(len(tokens))
                keys.append(xxhash.xxh3_128_digest(tokens.tobytes()))
                first.append(heads[0].view(np.int64))
                others.append([h.astype(np.uint32).view(np.int32) for h in heads[1:]])
                parity.append(parity_bits(tokens))
            arrays = [part.column(0)] + [pa.array(c, f.type) for c, f in zip((sizes, keys, first, others, parity), list(_SKETCH)[1:])]
            yield pa.RecordBatch.from_arrays(arrays, schema=_SKETCH)


def _set_rows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    sets = _Sets(width)
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            packed = [sets.of(text).tobytes() for text in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(packed, pa.binary())], names=["id", "tokens"])


def _parity_fits(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) whose bits differ no more than the sets may."""
    for batch in batches:
        fits = []
        for n_a, n_b, x, y in zip(*(c.to_pylist() for c in batch.columns[2:])):
            shared = -(-percent * (n_a + n_b) // (100 + percent))
            fits.append(differing_bits(x, y) <= n_a + n_b - 2 * shared)
        chosen = batch.filter(pa.array(fits, pa.bool_()))
        yield pa.RecordBatch.from_arrays(chosen.columns[:2], names=["a", "b"])


def _verify(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        linked = []
        for x, y in zip(batch.column(2), batch.column(3)):
            a, b = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            both = len(np.intersect1d(a, b, assume_unique=True))
            linked.append(100 * both >= percent * (len(a) + len(b) - both))
        chosen = batch.filter(pa.array(linked, pa.bool_()))
        yield pa.RecordBatch.from_arrays(chosen.columns[:2], names=["a", "b"])


class _Join:
    """The tables the rounds of one join share."""

    def __init__(self, docs: DataFrame, sketch: DataFrame, settings: JoinSettings):
        self._docs, self._settings = docs, settings
        self.classes = materialize(
            sketch.filter("n > 0 and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("rep")), "classes"
        )
        chosen = sketch.join(self.classes, "key").filter("doc_id = rep")
        self._sketch = sketch
        self.rows = chosen.select("rep", "n", F.posexplode("first").alias("at", "token"))
        hub = (F.min("rep").alias("hub"), F.min_by("n", "rep").alias("hub_n"), F.max("rep").alias("last"))
        shared = self.rows.groupBy("token").agg(*hub).filter("hub < last").drop("last")
        self.meeting = materialize(self.rows.join(shared, "token"), "meeting")

    def _filtered(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) that share prefix tokens under the other orders too, and fit in size and parity bits.

        The bits of a large set take a 16th of its room or less, and leave few pairs whose sets must move.
        """
        tables = [
            self._sketch.select(F.col("doc_id").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in ("n", "others", "parity"))) for c in "ab"
        ]
        joined = pairs.join(tables[0], "a").join(tables[1], "b").filter(self._settings.sizes_fit(F.col("n_a"), F.col("n_b")))
        for k in range(self._settings.filters):
            joined = joined.filter(F.arrays_overlap(F.col("others_a")[k], F.col("others_b")[k]))
        rows = joined.select("a", "b", "n_a", "n_b", "parity_a", "parity_b")
        return rows.mapInArrow(partial(_parity_fits, percent=self._settings.percent), "a long, b long").distinct()

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs that link, from the whole sets of those that pass the filters."""
        passed = materialize(self._filtered(pairs), "candidates")
        ids = passed.select(F.explode(F.array("a", "b")).alias("id"))
        member = unused(self._docs, "is_member")
        asked = with_membership(self._docs, "doc_id", id_bitmaps(ids, "id"), member).filter(F.col(member))
        sets = asked.select("doc_id", "text").mapInArrow(partial(_set_rows, width=self._settings.width), "id long, tokens binary")
        sets = materialize(sets, "sets")
        left, right = (sets.select(F.col("id").alias(c), F.col("tokens").alias(f"tokens_{c}")) for c in "ab")
        joined = passed.join(left, "a").join(right, "b").select("a", "b", "tokens_a", "tokens_b")
        return materialize(joined.mapInArrow(partial(_verify, percent=self._settings.percent), "a long, b long"), "links")

    def star_pairs(self) -> DataFrame:
        """Every document with the smallest id under each of its tokens, if the two fit in size."""
        fit = self.meeting.filter("rep != hub").filter(self._settings.sizes_fit(F.col("n"), F.col("hub_n")))
        return fit.select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()

    def cross_pairs(self, labels: DataFrame) -> DataFrame:
        """All pairs under a token whose ends are not known to be connected yet.

        Under a token, the documents outside its largest component meet all others that fit in
        size, and in place: a pair that links does so under its first shared token.
        """
        known = labels.withColumnRenamed("id", "rep")
        rows = self.meeting.join(known, "rep", "left").select("token", "rep", "n", "at", F.coalesce("component", "rep").alias("comp"))
        rows = materialize(rows, "components-met")
        sizes = rows.groupBy("token", "comp").agg(F.count("*").alias("size"))
        main = sizes.groupBy("token").agg(F.max_by("comp", "size").alias("main"), F.count("*").alias("comps")).filter("comps > 1")
        split = rows.join(main.select("token", "main"), "token")
        outer = split.filter("comp != main").select("token", F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("at").alias("at_a"), F.col("comp").alias("comp_a"))
        inner = split.select("token", F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("at").alias("at_b"), F.col("comp").alias("comp_b"), "main")
        once = (F.col("comp_b") == F.col("main")) | (F.col("a") < F.col("b"))
        fits = self._settings.sizes_fit(F.col("n_a"), F.col("n_b"))
        fits &= self._settings.places_fit(F.col("n_a"), F.col("at_a"), F.col("n_b"), F.col("at_b"))
        met = outer.alias("o").join(inner.alias("i"), (F.col("o.token") == F.col("i.token")) & (F.col("comp_a") != F.col("comp_b")) & once & fits)
        return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def join_documents(
    docs: DataFrame, settings: JoinSettings = JoinSettings(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles``, ``component_id``.

    Tokens are runs of words ``[^\\x20\\x09-\\x0D]+``, A-Z in lower case; a shorter text is one
    token. Equal sets are one class. Under the first order, classes meet in their prefix tokens;
    they are candidates if they share prefix tokens under all other orders as well and the parity
    bits of their sets differ no more than linked ones can, and their whole sets decide. A first round compares each class only with the smallest id under each
    token, which connects groups of near copies without all their pairs. The second round takes
    every pair under a token that the first has not connected; no link is lost between them.

    A text without words, or null, has no tokens and links with nothing, like a null id, whose
    component is null. An id links by any of its rows. Other columns are dropped. An empty table
    gives no rows.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    counts = cell_counts(docs, settings.width, text_col)
    sketch = materialize(texts.mapInArrow(partial(_sketch, counts=counts, settings=settings), _SKETCH_DDL), "sketch")
    join = _Join(texts, sketch, settings)
    near = join.links(join.star_pairs())
    far = join.links(join.cross_pairs(components(near)))
    named = sketch.select("doc_id", "n", "key").join(join.classes, "key", "left")
    same_id = named.filter("rep is not null").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b"))
    several = named.join(same_id.filter("a != b").select("doc_id"), "doc_id").filter("rep is not null")
    tied = several.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    labels = components(near.unionByName(far).unionByName(tied)).withColumnRenamed("id", "rep")
    found = named.withColumn("rep", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id"))).join(labels, "rep", "left")
    return found.select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id")
    )


def keep_first_of_groups(
    docs: DataFrame, settings: JoinSettings = JoinSettings(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with one document, that of the smallest id, of each group of linked ones.

    All columns stay. Of rows that share an id, all stay or go together; rows with a null id stay.
    """
    found = join_documents(docs, settings, id_col, text_col)
    gone = found.filter("doc_id != component_id").select("doc_id")
    name = unused(docs, "is_gone")
    flagged = with_membership(docs, id_col, id_bitmaps(gone, "doc_id"), name)
    return flagged.filter(~F.col(name)).select(*docs.columns)
