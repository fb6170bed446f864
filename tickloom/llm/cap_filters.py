"""Near-duplicate vectors by spherical-cap filters from structured random product codes."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import components
from tickloom.settings import materialize


@dataclass(frozen=True)
class CapSettings:
    """Of 10,000 vectors each lies in about ``list_size`` filters, and in more by the sixth root
    of larger numbers; a filter holds about ``bucket`` vectors of a table without clusters. From
    the two and the number of vectors follow how many filters there are, and their threshold from
    random vectors. Blocks have ``code`` directions at the most. A fuller filter is compared in tiles of
    ``tile`` vectors, all with all, so its size limits nothing.
    """

    list_size: float = 28.0
    bucket: int = 256
    code: int = 8192
    tile: int = 2048
    seed: int = 11


@dataclass(frozen=True)
class ProductCode:
    """Directions of one dimension: every choice of one codeword per block is a filter."""

    dims: int
    blocks: int
    size: int
    threshold: float
    seed: int

    @staticmethod
    def fitting(dims: int, vectors: int, settings: CapSettings) -> ProductCode:
        """Code for so many vectors: caps of the share ``bucket / vectors`` of the sphere.

        Up to a tile of vectors need one filter, the sphere; so do those of few dimensions, in
        which random codes cover the sphere unevenly.
        """
        if vectors <= settings.tile or dims < 16:
            return ProductCode(dims, 1, 1, -2.0, settings.seed)
        wanted = settings.list_size * max(1.0, vectors / 10_000) ** (1 / 6)
        share = min(0.02, settings.bucket / max(1, vectors))
        filters = wanted / share
        blocks = max(2, math.ceil(math.log(filters) / math.log(settings.code)))
        size = math.ceil(filters ** (1 / blocks))
        high = NormalDist().inv_cdf(1 - min(0.5, wanted / size**blocks)) / math.sqrt(dims)
        probe = np.random.default_rng(settings.seed).normal(size=(200, dims))
        probe /= np.linalg.norm(probe, axis=1, keepdims=True)

        def code(threshold: float) -> ProductCode:
            return ProductCode(dims, blocks, size, threshold, settings.seed)

        def listed(threshold: float) -> float:
            return len(list_decode(probe, code(threshold))[0]) / len(probe)

        low = high
        while listed(low) < wanted:
            high, low = low, low * 0.95
        for _ in range(6):
            middle = (low + high) / 2
            low, high = (low, middle) if listed(middle) < wanted else (middle, high)
        return code(low)

    def tools(self) -> tuple[list[np.ndarray], np.ndarray]:
        """Signs of the rotation's three steps, and the codewords per block."""
        random = np.random.default_rng([self.seed, self.dims, self.blocks, self.size])
        width = 1 << max(self.blocks.bit_length(), (self.dims - 1).bit_length())
        signs = [random.choice([-1.0, 1.0], width) for _ in range(3)]
        words = random.normal(size=(self.blocks, self.size, -(-width // self.blocks)))
        return signs, words / np.linalg.norm(words, axis=2, keepdims=True) / math.sqrt(self.blocks)


def rotate(units: np.ndarray, signs: list[np.ndarray]) -> np.ndarray:
    """Pseudo-random rotation: three times random signs and a Walsh-Hadamard transform."""
    width = len(signs[0])
    x = np.zeros((len(units), width))
    x[:, : units.shape[1]] = units
    for sign in signs:
        x *= sign
        step = 1
        while step < width:
            pairs = x.reshape(len(x), -1, 2, step)
            x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(x), width)
            step *= 2
        x /= math.sqrt(width)
    return x


def list_decode(units: np.ndarray, code: ProductCode) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) of all filters whose direction a vector exceeds the threshold in.

    Blocks are extended one by one; what can't reach the threshold even with the best codewords
    of the blocks to come is left out.
    """
    signs, words = code.tools()
    x = rotate(units, signs)
    short = code.blocks * words.shape[2] - x.shape[1]
    x = np.pad(x, ((0, 0), (0, short))).reshape(len(x), code.blocks, -1)
    scores = np.einsum("nbd,bcd->nbc", x, words)
    rest = np.flip(np.cumsum(np.flip(scores.max(axis=2), 1), 1), 1)
    rest = np.pad(rest, ((0, 0), (0, 1)))
    rows, filters, sums = np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x))
    for block in range(code.blocks):
        total = sums[:, None] + scores[rows, block]
        entry, word = np.nonzero(total + rest[rows, block + 1][:, None] >= code.threshold)
        sums, filters, rows = total[entry, word], filters[entry] * code.size + word, rows[entry]
    return rows, filters


def pack_vector(values: np.ndarray) -> bytes:
    """Components in 32 bits where that loses nothing, else in 64."""
    single = values.astype(np.float32)
    return (single if (single == values).all() else values).tobytes()


def units_of(packed: list[bytes], dims: int) -> np.ndarray:
    """Double-precision unit vectors of packed components."""
    raw = np.empty((len(packed), dims))
    for row, data in zip(raw, packed):
        row[:] = np.frombuffer(data, np.float32 if len(data) == 4 * dims else np.float64)
    raw /= np.abs(raw).max(axis=1, keepdims=True)
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


_VECTORS = pa.schema([("vec_id", pa.int64()), ("dims", pa.int32()), ("key", pa.binary()), ("packed", pa.binary())])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Valid vectors as packed doubles with a 128-bit key; the others with nulls."""
    for batch in batches:
        packed: list[bytes | None] = []
        dims: list[int | None] = []
        for value in batch.column(1):
            array = value.values
            good = array is not None and len(array) and not array.null_count
            data = array.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0 if good else None
            with np.errstate(over="ignore"):
                packed.append(pack_vector(data) if good and np.isfinite(data).all() and data.any() else None)
            dims.append(None if packed[-1] is None else len(data))
        keys = [None if p is None else xxhash.xxh3_128_digest(p) for p in packed]
        columns = [pa.array(dims, pa.int32()), pa.array(keys, pa.binary()), pa.array(packed, pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], schema=_VECTORS)


_CAPS = pa.schema(
    [("dims", pa.int32()), ("filter", pa.int64()), ("key", pa.binary()), ("rep", pa.int64()), ("copies", pa.int64()), ("packed", pa.binary()), ("filters", pa.list_(pa.int64()))]
)
_CAPS_DDL = "dims int, filter long, key binary, rep long, copies long, packed binary, filters array<long>"


def _decode(batches: Iterator[pa.RecordBatch], codes: dict[int, ProductCode]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            all_dims = part.column(0).to_numpy()
            for dims in np.unique(all_dims):
                same = part.filter(pa.array(all_dims == dims))
                rows, filters = list_decode(units_of(same.column(4).to_pylist(), int(dims)), codes[int(dims)])
                order = np.lexsort((filters, rows))
                rows, filters = rows[order], filters[order]
                counts = np.bincount(rows, minlength=same.num_rows)
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]), pa.int32()), pa.array(filters))
                taken = [c.take(pa.array(rows)) for c in (*same.columns, lists)]
                yield pa.RecordBatch.from_arrays([taken[0], pa.array(filters), *taken[1:]], schema=_CAPS)


_LINKED = pa.schema([("key", pa.binary()), ("rep", pa.int64()), ("links", pa.int64()), ("low", pa.int64())])
_LINKED_DDL = "key binary, rep long, links long, low long"


def _compare(group: pa.Table, least: float) -> pa.Table:
    """Links within a tile, or between two: per vector how many, and the smallest id reached.

    A pair counts only in the smallest filter that both lie in, so every pair counts once.
    """
    group = group.sort_by([("tile", "ascending"), ("rep", "ascending")])
    this, first = group["filter"][0].as_py(), group["first"][0].as_py()
    own = np.flatnonzero(group["tile"].to_numpy() == first)
    other = np.flatnonzero(group["tile"].to_numpy() != first)
    within = group["first"][0].as_py() == group["second"][0].as_py()
    units = units_of(group["packed"].to_pylist(), group["dims"][0].as_py())
    left, right = (own, own) if within else (own, other)
    near = units[left] @ units[right].T >= least
    if within:
        np.fill_diagonal(near, False)
    if not near.any():
        return _LINKED.empty_table()
    copies, reps = group["copies"].to_numpy(), group["rep"].to_numpy()
    lists = group["filters"].combine_chunks()
    at = np.repeat(np.arange(len(units)), np.diff(lists.offsets.to_numpy()))
    smaller = lists.flatten().to_numpy()
    at, smaller = at[smaller < this], smaller[smaller < this]
    names, column = np.unique(smaller, return_inverse=True)
    earlier = np.zeros((len(units), len(names)), np.float32)
    earlier[at, column] = 1
    links, low = np.zeros(len(units), np.int64), reps.copy()
    counted = near & ~(earlier[left] @ earlier[right].T > 0)
    links[left] += counted @ copies[right]
    if not within:
        links[right] += counted.T @ copies[left]
    while True:
        before = low.copy()
        top = np.iinfo(np.int64).max
        for a, b, m in ((left, right, near), (right, left, near.T)):
            for begin in range(0, len(a), 256):
                rows = a[begin : begin + 256]
                reached = np.where(m[begin : begin + 256], low[b][None, :], top).min(axis=1, initial=top)
                low[rows] = np.minimum(low[rows], reached)
        if (low == before).all():
            break
    linked = np.zeros(len(units), bool)
    linked[left] |= near.any(axis=1)
    linked[right] |= near.any(axis=0)
    chosen = pa.array(np.flatnonzero(linked))
    columns = [group["key"].combine_chunks(), group["rep"].combine_chunks(), pa.array(links), pa.array(low)]
    return pa.Table.from_arrays([c.take(chosen) for c in columns], schema=_LINKED)


def near_duplicates(
    vectors: DataFrame,
    least: float = 0.9,
    settings: CapSettings = CapSettings(),
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """One row per vector: ``vec_id``, ``n_links``, ``component_id``, ``kept``.

    Two vectors link when they share a filter and their cosine, in double precision, is
    ``least`` or more. ``n_links`` counts the other vectors linked directly, equal ones
    included; ``component_id`` is the smallest id reachable; ``kept`` marks the vector of that
    id. Equal vectors are one class until the end. Vectors of different lengths never link.

    A vector that is null, empty, zero, or has null or non-finite components links with nothing;
    so does one with a null id, whose component is null and which is kept. Rows that share an id
    share their component. Other columns are dropped. An empty table gives no rows.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    packed = materialize(rows.mapInArrow(_pack, "vec_id long, dims int, key binary, packed binary"), "vectors")
    known = packed.filter(F.col("key").isNotNull() & F.col("vec_id").isNotNull())
    classes = materialize(
        known.groupBy("dims", "key").agg(
            F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("packed").alias("packed")
        ),
        "classes",
    )
    counts = classes.groupBy("dims").count().collect()
    codes = {r["dims"]: ProductCode.fitting(r["dims"], r["count"], settings) for r in counts}
    caps = classes.select("dims", "key", "rep", "copies", "packed").mapInArrow(partial(_decode, codes=codes), _CAPS_DDL)
    sizes = caps.groupBy("dims", "filter").agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    tiled = sizes.select("dims", "filter", F.ceil(F.col("n") / settings.tile).cast("int").alias("tiles"))
    tile = F.pmod(F.xxhash64("key"), F.col("tiles").cast("long")).cast("int")
    met = caps.join(tiled, ["dims", "filter"]).withColumn("tile", tile)
    met = met.withColumn("partner", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        *caps.columns, "tile", F.least("tile", "partner").alias("first"), F.greatest("tile", "partner").alias("second")
    )

    def compare(group: pa.Table) -> pa.Table:
        return _compare(group, least)

    groups = met.groupBy("dims", "filter", "first", "second")
    linked = materialize(groups.applyInArrow(compare, _LINKED_DDL), "linked")
    links = linked.groupBy("key").agg(F.sum("links").alias("links"))
    same = known.join(classes.select("key", "rep", "copies"), "key").select("vec_id", "rep", "copies", "key")
    reached = components(
        linked.select(F.col("rep").alias("a"), F.col("low").alias("b")).distinct().unionByName(_shared_ids(same))
    )
    joined = same.join(links, "key", "left").join(reached.withColumnRenamed("id", "rep"), "rep", "left")
    found = joined.select(
        "vec_id",
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("component", "rep").alias("component_id"),
    )
    lone = packed.filter(F.col("key").isNull() | F.col("vec_id").isNull())
    alone = lone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _shared_ids(same: DataFrame) -> DataFrame:
    """Links between the classes that one id lies in, which takes repeated ids."""
    spread = same.groupBy("vec_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b"))
    several = spread.filter("a != b").select("vec_id")
    return same.join(several, "vec_id").select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))
