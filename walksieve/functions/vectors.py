"""Vector expressions and Arrow helpers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Dot product of two array columns, in double."""
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y),
                       F.lit(0.0), lambda acc, x: acc + x)


def norm(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))


def l2_normalise(vector: Column) -> Column:
    """Unit vector as floats; a zero vector fails the job."""
    length = norm(vector)
    checked = F.when(length > 0, length).otherwise(
        F.raise_error(F.lit("zero-norm vector: the model returned garbage")).cast("double"))
    return F.transform(as_double(vector), lambda x: x / checked).cast("array<float>")


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column of equal-length vectors as an (N, D) double matrix."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(flat, pa.ChunkedArray):
        flat = pa.concat_arrays(flat.chunks) if flat.num_chunks else pa.array([], column.type)
    n = len(flat)
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(n, -1) if n else np.empty((0, 0))


def numbers(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy()
