"""Vectors as whole numbers, shared by the operators that must be exact."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE = 256
# Components below this keep a squared distance of 64 of them inside a long.
LIMIT = 1 << 27


def integer_vectors(
    vectors: DataFrame, id_col: str, vector_col: str, dim: int | None = None, others: Mapping[str, str] | None = None
) -> DataFrame:
    """``vec_id``, ``vector`` of integers floor(256 * x), and ``others`` (new name to old).

    Rows whose vector is null, holds a null or non-finite component, or hasn't ``dim`` components
    (if given) are dropped; null ids and repeated rows stay. A component of 2^19 or more is an
    error, as distances would leave the range of a long.
    """
    given = F.col(vector_col).cast("array<double>")
    finite = F.forall(given, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    usable = given.isNotNull() & finite & (F.lit(True) if dim is None else F.size(given) == dim)
    too_large = F.raise_error(F.lit("a vector component of 2^19 or more has no exact distance")).cast("int")
    whole = F.transform(
        given, lambda x: F.when(F.abs(x) < LIMIT / SCALE, F.floor(x * SCALE).cast("int")).otherwise(too_large)
    )
    return vectors.filter(usable).select(
        F.col(id_col).cast("long").alias("vec_id"), whole.alias("vector"), *(F.col(old).alias(new) for new, old in (others or {}).items())
    )


def matrix(column: pa.Array) -> np.ndarray:
    """A batch's vectors, all of one length, as rows of longs."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """The batches in runs of at most ``rows`` rows, so that work tables stay small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
