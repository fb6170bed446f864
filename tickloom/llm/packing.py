"""Sum-of-squares online packing of tokenized documents into fixed windows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.text import batches_of, chunk_encoder

PIECE_SCHEMA = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
)
_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
        ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
    ]
)


@dataclass
class Piece:
    doc_id: int | None
    start: int
    ids: np.ndarray
    doc_tokens: int


@dataclass
class Window:
    level: int = 0
    pieces: list[Piece] = field(default_factory=list)

    def add(self, piece: Piece) -> None:
        self.pieces.append(piece)
        self.level += len(piece.ids)


class SumOfSquaresPacker:
    """Places documents one by one; full windows are returned, the others stay open.

    ``counts[h]`` is the number of open windows filled to level ``h``. A remainder shorter than
    a window goes where the sum of the squared counts grows least; equal choices go to the
    fuller window. Beyond ``max_open`` windows, and at the end, the emptiest windows are cut
    up to fill the fullest, so one window at the most is left partly filled.
    """

    def __init__(self, size: int, max_open: int = 4096):
        self.size, self._max_open, self._open = size, max_open, 0
        self.counts = np.zeros(size + 1, np.int64)
        self._by_level: list[list[Window]] = [[] for _ in range(size + 1)]

    def place(self, doc_id: int | None, ids: np.ndarray) -> list[Window]:
        total, closed = len(ids), []
        whole = total - total % self.size
        for start in range(0, whole, self.size):
            closed.append(self._single(Piece(doc_id, start, ids[start : start + self.size], total)))
        if whole < total:
            closed += self._place_rest(Piece(doc_id, whole, ids[whole:], total))
        return closed

    def _single(self, piece: Piece) -> Window:
        window = Window()
        window.add(piece)
        return window

    def _best_level(self, length: int) -> int:
        counts = self.counts
        levels = np.arange(self.size - length + 1)
        growth = 2 * counts[levels + length] + 1 - 2 * counts[levels] + 1
        growth[-1] = 1 - 2 * counts[levels[-1]]  # a full window is no longer counted
        growth[0] = 2 * counts[length] + 1  # a new window takes none away
        growth[1:][counts[levels[1:]] == 0] = np.iinfo(np.int64).max
        return int(levels[len(growth) - 1 - np.argmin(growth[::-1])])

    def _place_rest(self, piece: Piece) -> list[Window]:
        level = self._best_level(len(piece.ids))
        window = self._take(level) if level else Window()
        window.add(piece)
        if window.level == self.size:
            return [window]
        self._put(window)
        return self.drain(keep_last=True) if self._open > self._max_open else []

    def _take(self, level: int) -> Window:
        self.counts[level] -= 1
        self._open -= 1
        return self._by_level[level].pop()

    def _put(self, window: Window) -> None:
        self.counts[window.level] += 1
        self._open += 1
        self._by_level[window.level].append(window)

    def drain(self, keep_last: bool = False) -> list[Window]:
        """Close all open windows, filling the fullest from the emptiest."""
        queue = [w for level in reversed(self._by_level) for w in level]
        self.__init__(self.size, self._max_open)
        closed, first, last = [], 0, len(queue) - 1
        while first < last:
            full, donor = queue[first], queue[last]
            piece = donor.pieces.pop()
            space = self.size - full.level
            if len(piece.ids) > space:
                rest = Piece(piece.doc_id, piece.start + space, piece.ids[space:], piece.doc_tokens)
                donor.pieces.append(rest)
                piece.ids = piece.ids[:space]
            donor.level -= len(piece.ids)
            full.add(piece)
            if full.level == self.size:
                closed.append(full)
                first += 1
            if not donor.pieces:
                last -= 1
        if first == last:
            if keep_last:
                self._put(queue[first])
            else:
                closed.append(queue[first])
        return closed


def _pack_partition(
    batches: Iterator[pa.RecordBatch], tokenizer: str, size: int, end_id: int, max_open: int
) -> Iterator[pa.RecordBatch]:
    encoder, packer = chunk_encoder(tokenizer), SumOfSquaresPacker(size, max_open)
    end, first, closed = encoder.pack([end_id]), TaskContext.get().partitionId() << 36, 0

    def rows(windows: list[Window]) -> pa.RecordBatch:
        nonlocal closed
        columns: list[list] = [[] for _ in _ARROW]
        for window in windows:
            offset = 0
            for p in window.pieces:
                row = (p.doc_id, p.start, len(p.ids), p.ids.astype("<u4").tobytes(), p.doc_tokens, first + closed, offset)
                for column, value in zip(columns, row):
                    column.append(value)
                offset += len(p.ids)
            closed += 1
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)

    for batch in batches:
        doc_ids = batch.column(0).to_pylist()
        for at, texts in batches_of(batch.column(1).to_pylist()):
            windows: list[Window] = []
            for doc_id, packed in zip(doc_ids[at:], encoder.encode(texts)):
                windows += packer.place(doc_id, np.frombuffer(packed + end, encoder.dtype))
            yield rows(windows)
    yield rows(packer.drain())


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    size: int = 1024,
    end_id: int = 0,
    max_open: int = 4096,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces of documents laid out in windows of ``size`` tokens, one row per piece.

    Each document is its token ids and ``end_id``. Whole windows are cut off a long document;
    the rest is placed by :class:`SumOfSquaresPacker`. Every partition packs its own documents,
    in one pass and without a shuffle, and leaves one partly filled window at the most. ``ids``
    are little-endian unsigned 32-bit integers; ``sequence_id`` is unique over the result.

    A null or empty text is its ``end_id`` alone. A null id is kept. Repeated rows are packed
    each. Other columns are dropped. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pack = partial(_pack_partition, tokenizer=tokenizer, size=size, end_id=end_id, max_open=max_open)
    return rows.mapInArrow(pack, PIECE_SCHEMA)
