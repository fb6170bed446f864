"""Token ids in Arrow stream files of equal-length sequences, with random access."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import file_system
from tickloom.llm.text import batches_of, chunk_encoder
from tickloom.settings import materialize

SHARD_SCHEMA = "shard int, n_docs long, n_tokens long, first_doc long, path string"
TOKEN_SCHEMA = "doc_id long, start long, n_tokens long, ids binary"
_SHARD = pa.schema(
    [("shard", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("first_doc", pa.int64()), ("path", pa.string())]
)
_TOKENS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
_INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def sequence_schema(dtype: np.dtype, length: int) -> pa.Schema:
    """``ids`` and ``mask`` (true for a token, false for padding) of one sequence per row."""
    values = pa.from_numpy_dtype(dtype.newbyteorder("="))
    return pa.schema([("ids", pa.list_(values, length)), ("mask", pa.list_(pa.bool_(), length))])


class SequenceWriter:
    """Stream file of record batches of ``batch`` sequences each; only the last one is shorter."""

    def __init__(self, sink, dtype: np.dtype, length: int, batch: int):
        self._dtype, self._length, self._room = dtype, length, length * batch
        self._schema = sequence_schema(dtype, length)
        self._stream = pa.ipc.new_stream(sink, self._schema)
        self._parts: list[bytes] = []
        self._held = 0

    def add(self, ids: bytes) -> None:
        self._parts.append(ids)
        self._held += len(ids) // self._dtype.itemsize
        if self._held >= self._room:
            values = np.frombuffer(b"".join(self._parts), self._dtype)
            whole = len(values) - len(values) % self._room
            for at in range(0, whole, self._room):
                self._write(values[at : at + self._room])
            self._parts, self._held = [values[whole:].tobytes()], len(values) - whole

    def _write(self, values: np.ndarray) -> None:
        rows = -(-len(values) // self._length)
        ids = np.zeros(rows * self._length, self._dtype)
        ids[: len(values)] = values
        mask = np.arange(rows * self._length) < len(values)
        columns = [
            pa.FixedSizeListArray.from_arrays(pa.array(part), self._length)
            for part in (ids, mask)
        ]
        self._stream.write_batch(pa.RecordBatch.from_arrays(columns, schema=self._schema))

    def close(self) -> None:
        if self._held:
            self._write(np.frombuffer(b"".join(self._parts), self._dtype))
        self._stream.close()


class SequenceReader:
    """Random access to the sequences of a file; nothing is copied from a memory-mapped one.

    All full batches take the same number of bytes, so batch ``k`` begins ``k`` batch lengths
    behind the schema and no index is needed.
    """

    def __init__(self, source: pa.NativeFile):
        self._source = source
        self._size = source.size()
        source.seek(0)
        self._schema = pa.ipc.read_schema(pa.ipc.read_message(source))
        self._first = source.tell()
        self._stride, self._rows = 0, 0
        if (batch := self._read(self._first)) is not None:
            self._stride, self._rows = source.tell() - self._first, batch.num_rows

    def _read(self, at: int) -> pa.RecordBatch | None:
        if at >= self._size:
            return None
        self._source.seek(at)
        try:
            return pa.ipc.read_record_batch(pa.ipc.read_message(self._source), self._schema)
        except EOFError:
            return None

    def batch(self, k: int) -> pa.RecordBatch | None:
        return self._read(self._first + k * self._stride) if self._rows else None

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of sequence ``i``."""
        found = self.batch(i // self._rows) if self._rows and i >= 0 else None
        row = i % self._rows if self._rows else 0
        if found is None or row >= found.num_rows:
            raise IndexError(i)
        ids, mask = (found.column(c)[row].values for c in (0, 1))
        return ids.to_numpy(), mask.to_numpy(zero_copy_only=False)

    def tokens(self, start: int, stop: int) -> np.ndarray:
        """Ids at the token positions ``start`` to ``stop`` of the whole file."""
        width = self._schema.field("ids").type.list_size
        room, parts = width * max(self._rows, 1), []
        while start < stop:
            found = self.batch(start // room)
            values = found.column(0).flatten().to_numpy()
            first = start % room
            part = values[first : first + stop - start]
            parts.append(part)
            start += len(part)
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def _write_shard(
    batches: Iterator[pa.RecordBatch], folder: str, tokenizer: str, end_id: int, length: int, batch: int
) -> Iterator[pa.RecordBatch]:
    """Write one partition; the files get their names once they are whole, so retries are safe."""
    context = TaskContext.get()
    encoder = chunk_encoder(tokenizer)
    end, width = encoder.pack([end_id]), encoder.dtype.itemsize
    files, base = file_system(folder)
    files.create_dir(base, recursive=True)
    name = f"{base}/shard-{context.partitionId():06d}"
    attempt = f"{base}/.attempt-{context.taskAttemptId()}"
    docs, tokens, first = 0, 0, None
    with files.open_output_stream(f"{attempt}.ids") as data, files.open_output_stream(f"{attempt}.docs") as index:
        writer = SequenceWriter(data, encoder.dtype, length, batch)
        with pa.ipc.new_stream(index, _INDEX) as listed:
            for rows in batches:
                ids = rows.column(0).to_pylist()
                starts, lengths = [], []
                for _, texts in batches_of(rows.column(1).to_pylist()):
                    for packed in encoder.encode(texts):
                        writer.add(packed + end)
                        starts.append(tokens)
                        lengths.append(len(packed) // width + 1)
                        tokens += lengths[-1]
                first = ids[0] if not docs and ids else first
                docs += len(ids)
                listed.write_batch(pa.record_batch([pa.array(c, pa.int64()) for c in (ids, starts, lengths)], schema=_INDEX))
        writer.close()
    if docs:
        for kind in ("ids", "docs"):
            files.move(f"{attempt}.{kind}", f"{name}.{kind}.arrows")
        yield pa.record_batch([pa.array([v], f.type) for v, f in zip((context.partitionId(), docs, tokens, first, f"{folder}/shard-{context.partitionId():06d}"), _SHARD)], schema=_SHARD)
    else:
        for kind in ("ids", "docs"):
            files.delete_file(f"{attempt}.{kind}")


def write_token_files(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    end_id: int = 2,
    length: int = 1024,
    batch: int = 256,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Write all documents in ascending id order to ``folder``; return the list of shards.

    A shard is a range of ids: ``<path>.ids.arrows`` holds its token stream cut into sequences
    of ``length`` (the last one padded, see ``mask``), ``<path>.docs.arrows`` each document's
    place in it. ``folder`` is a path or URI that all executors reach. Writing happens here.

    A null or empty text is its ``end_id`` alone. Null ids come first. Repeated rows are written
    each. Other columns are dropped. An empty table writes no shard.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    order = [F.col("doc_id"), F.xxhash64("text"), F.length("text")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    write = partial(_write_shard, folder=folder, tokenizer=tokenizer, end_id=end_id, length=length, batch=batch)
    return materialize(ranged.mapInArrow(write, SHARD_SCHEMA), "shards")


def _read_shards(batches: Iterator[pa.RecordBatch], buffer_tokens: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        for path, base in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
            files, name = file_system(path)
            local = isinstance(files, pafs.LocalFileSystem)
            opened = (lambda p: pa.memory_map(p)) if local else files.open_input_file
            with opened(f"{name}.ids.arrows") as data, opened(f"{name}.docs.arrows") as index:
                reader = SequenceReader(data)
                for listed in pa.ipc.open_stream(index):
                    yield from _documents(reader, listed, base, buffer_tokens)


def _documents(reader: SequenceReader, listed: pa.RecordBatch, base: int, most: int) -> Iterator[pa.RecordBatch]:
    ids, starts, lengths = (c.to_numpy(zero_copy_only=False) for c in listed.columns)
    at = 0
    while at < len(starts):
        upto = max(at + 1, int(np.searchsorted(starts, starts[at] + most)))
        stop = int(starts[upto - 1] + lengths[upto - 1])
        values = reader.tokens(int(starts[at]), stop).astype("<u4")
        bounds = ((np.append(starts[at:upto], stop) - starts[at]) * 4).astype(np.int64)
        packed = pa.Array.from_buffers(
            pa.large_binary(), upto - at, [None, pa.py_buffer(bounds), pa.py_buffer(values)]
        ).cast(pa.binary())
        part = listed.slice(at, upto - at)
        yield pa.RecordBatch.from_arrays(
            [part.column(0), pa.array(starts[at:upto] + base), part.column(2), packed], schema=_TOKENS
        )
        at = upto


def read_token_files(spark: SparkSession, shards: DataFrame) -> DataFrame:
    """Documents read back from the files: id, tokens of all documents before it, its ids.

    ``ids`` are little-endian unsigned 32-bit integers. The driver lists the shards, of which
    there is one per partition written, as it lists the files of any other source.
    """
    listed, base = [], 0
    for row in shards.select("shard", "n_tokens", "path").orderBy("shard").collect():
        listed.append((row["path"], base))
        base += row["n_tokens"]
    frame = spark.createDataFrame(listed, "path string, base long")
    spread = frame.repartition(max(len(listed), 1), "path") if listed else frame
    return spread.mapInArrow(_read_shards, TOKEN_SCHEMA)
