"""Product codes of vectors, with codebooks learned by ball k-means."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tickloom.llm.vectors import integer_vectors, matrix, slices
from tickloom.settings import materialize

_SUMS = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("place", pa.int32()), ("n", pa.int64()), ("total", pa.int64())])
_SUMS_DDL = "part int, entry int, place int, n long, total long"


@dataclass(frozen=True)
class CodeSettings:
    """``parts`` equal parts of a vector, ``entries`` (256 at the most) a codebook, ``rounds`` of learning."""

    parts: int = 16
    entries: int = 64
    rounds: int = 2


class Balls:
    """A codebook with the other entries of each entry in order of their distance from it."""

    def __init__(self, book: np.ndarray):
        self.book = book
        apart = book[:, None] - book[None, :]
        gaps = np.einsum("ijk,ijk->ij", apart, apart)
        np.fill_diagonal(gaps, -1)  # the entry itself comes first and is cut off
        self.order = np.argsort(gaps, axis=1, kind="stable")[:, 1:]
        self.rings = np.take_along_axis(gaps, self.order, axis=1)

    def reassign(self, parts: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry (ties: the lower) and squared distance of every part, from any codes.

        An entry's ball reaches to its farthest part. Another entry can be as near to a part
        only if it lies within twice the part's distance of the part's own entry: so the ball's
        radius bounds its neighbours, parts nearer than half-way to the first neighbour stay
        without a comparison, and the ring a part lies in says how many neighbours it meets.
        """
        apart = parts - self.book[codes]
        error = np.einsum("ij,ij->i", apart, apart)
        best = codes.copy()
        if len(self.book) == 1:
            return best, error
        radius = np.zeros(len(self.book), np.int64)
        np.maximum.at(radius, codes, error)
        neighbours = (self.rings <= 4 * radius[:, None]).sum(axis=1)
        outside = np.flatnonzero(4 * error >= self.rings[codes, 0])
        if not len(outside):
            return best, error
        own, reach = codes[outside], 4 * error[outside]
        met = (self.rings[own, : neighbours[own].max()] <= reach[:, None]).sum(axis=1)
        rows = np.repeat(np.arange(len(outside)), met)
        first = np.cumsum(met) - met
        rivals = self.order[own[rows], np.arange(len(rows)) - first[rows]]
        apart = parts[outside[rows]] - self.book[rivals]
        distance = np.einsum("ij,ij->i", apart, apart)
        # The first rival of least (distance, number), then against the own entry.
        nearest = np.minimum.reduceat(distance, first)
        number = np.minimum.reduceat(np.where(distance == nearest[rows], rivals, len(self.book)), first)
        better = (nearest < error[outside]) | ((nearest == error[outside]) & (number < own))
        best[outside[better]], error[outside[better]] = number[better], nearest[better]
        return best, error


def _codes(batch: pa.RecordBatch, parts: int) -> np.ndarray:
    flat = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8)
    return flat.reshape(batch.num_rows, parts).astype(np.int64)


def _recode(batches: Iterator[pa.RecordBatch], books: np.ndarray, first: bool) -> Iterator[pa.RecordBatch]:
    """Rows with new ``codes`` and ``error``; at ``first`` every part starts in entry 0."""
    balls = [Balls(book) for book in books]
    for batch in slices(batches):
        vectors = matrix(batch.column("vector")).reshape(batch.num_rows, len(books), -1)
        old = np.zeros(vectors.shape[:2], np.int64) if first else _codes(batch, len(books))
        found = [ball.reassign(vectors[:, p], old[:, p]) for p, ball in enumerate(balls)]
        codes = np.stack([c for c, _ in found], axis=1).astype(np.uint8)
        error = np.sum([e for _, e in found], axis=0)
        kept = [batch.column(n) for n in batch.schema.names if n not in ("codes", "error")]
        names = [n for n in batch.schema.names if n not in ("codes", "error")]
        packed = pa.array([row.tobytes() for row in codes], pa.binary())
        yield pa.RecordBatch.from_arrays([*kept, packed, pa.array(error)], names=[*names, "codes", "error"])


def _sums(batches: Iterator[pa.RecordBatch], parts: int, entries: int, width: int) -> Iterator[pa.RecordBatch]:
    """Count and componentwise sum of a task's parts by position and entry."""
    counts, totals = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, width), np.int64)
    shift = np.arange(parts) * entries
    for batch in slices(batches):
        cells = (_codes(batch, parts) + shift).ravel()
        counts += np.bincount(cells, minlength=len(counts))
        np.add.at(totals, cells, matrix(batch.column("vector")).reshape(-1, width))
    used = np.flatnonzero(counts)
    columns = [
        np.repeat(used // entries, width).astype(np.int32),
        np.repeat(used % entries, width).astype(np.int32),
        np.tile(np.arange(width, dtype=np.int32), len(used)),
        np.repeat(counts[used], width),
        totals[used].ravel(),
    ]
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=_SUMS)


def encode_vectors(
    vectors: DataFrame,
    settings: CodeSettings = CodeSettings(),
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """``vec_id``, ``code``, ``error``, ``label_error`` and ``codebooks_sha256`` of every finite vector.

    Components are floor(256 * x); all arithmetic is in whole numbers. Codebooks start as the parts
    of the vectors of the smallest ids (rows of one id in the order of their vectors); null ids
    start nothing but are encoded. Rows whose vector is null or holds a null or non-finite
    component are dropped, repeated rows are kept. Vectors of another length than the
    smallest id's, or of a length ``parts`` doesn't divide, get a null code and error, which add
    nothing to ``label_error``. With fewer vectors than entries the codebooks are smaller;
    without any usable vector all codes are null. Null labels form one group. Other columns are
    dropped, whatever their names.
    """
    kept = materialize(integer_vectors(vectors, id_col, vector_col, None, {"label": label_col}), "integer-vectors")
    known = kept.filter("vec_id IS NOT NULL").orderBy("vec_id", "vector")
    smallest = known.limit(1).select(F.size("vector").alias("dim")).first()
    dim = smallest.dim if smallest and smallest.dim and smallest.dim % settings.parts == 0 else -1
    fits = F.size("vector") == dim
    chosen = kept.filter(fits)
    start = known.filter(fits).limit(settings.entries).select("vector").collect()
    none = F.lit(None)
    odd = kept.filter(~fits).select("vec_id", "label", none.cast("string").alias("code"), none.cast("long").alias("error"))
    digest, coded = None, odd
    if start:
        books = np.array([r.vector for r in start], np.int64).reshape(len(start), settings.parts, -1).transpose(1, 0, 2)
        schema = StructType(
            [*chosen.schema.fields, *StructType.fromDDL("codes binary").fields, StructField("error", LongType())]
        )
        state = chosen
        for step in range(settings.rounds + 1):
            state = materialize(state.mapInArrow(partial(_recode, books=books, first=step == 0), schema), "codes")
            if step < settings.rounds:
                books = moved_books(state, books)
        digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
        coded = state.select("vec_id", "label", F.lower(F.hex("codes")).alias("code"), "error").unionByName(odd)
    by_label = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest).cast("string").alias("codebooks_sha256")
    )


def moved_books(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """Every entry at the floor of its parts' mean; unused entries stay.

    Tasks add up their own parts; as many rows as the codebooks have components are collected.
    """
    parts, entries, width = books.shape
    sums = state.select("vector", "codes").mapInArrow(partial(_sums, parts=parts, entries=entries, width=width), _SUMS_DDL)
    moved = books.copy()
    totals = sums.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    for row in totals.collect():
        moved[row.part, row.entry, row.place] = row.total // row.n
    return moved
