"""Vectors in Arrow batches as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def whole(column: pa.Array, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places and matrix (doubles) of the vectors of ``dim`` finite entries; a null vector or entry, NaN or infinity leaves a vector out."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.asarray(pc.fill_null(pc.list_value_length(column), -1))
    at = np.flatnonzero(size == dim) if dim is not None else np.flatnonzero(size >= 0)
    flat = column.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null entry becomes NaN
    held = flat.reshape(len(at), dim or 0)
    good = np.isfinite(held).all(axis=1)
    return at[good], held[good]


def usual_size(rows: DataFrame, vector: str) -> int:
    """The most frequent length of the vectors without null or non-finite entries (of equally frequent ones the largest); 0 without any.

    Vectors of another length have no inner product with these and take no part.
    """
    finite = F.forall(vector, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    sizes = rows.where(F.col(vector).isNotNull() & finite).groupBy(F.size(vector).alias("size")).agg(F.count(F.lit(1)).alias("n"))
    found = sizes.where("size > 0").orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
    return found[0]["size"] if found else 0
