"""Line columns inside Arrow batches: ``ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>`` to and from NumPy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

LINE_TYPE = "array<struct<x: double, y: double>>"
POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])


def to_numpy(lines: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All x, all y, and the vertex count per row (0 for NULL)."""
    offsets = lines.offsets.to_numpy()
    valid = lines.is_valid().to_numpy(zero_copy_only=False)
    if not valid.all():
        # rows behind a NULL may still own values; keep those of valid rows only
        lines = lines.fill_null(pa.scalar([], lines.type))
        offsets = lines.offsets.to_numpy()
    points = lines.values.slice(offsets[0], offsets[-1] - offsets[0])
    x = points.field("x").to_numpy(zero_copy_only=False)
    y = points.field("y").to_numpy(zero_copy_only=False)
    return x, y, np.diff(offsets)


def from_numpy(x: np.ndarray, y: np.ndarray, counts: np.ndarray, valid: np.ndarray) -> pa.Array:
    """Line column from the vertices of the valid rows."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    points = pa.StructArray.from_arrays([pa.array(x, pa.float64()), pa.array(y, pa.float64())], fields=list(POINT))
    return pa.ListArray.from_arrays(pa.array(offsets), points, mask=pa.array(~valid))


def starts_of(counts: np.ndarray) -> np.ndarray:
    """First flat position of every row."""
    return np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64) if len(counts) else np.zeros(0, np.int64)


def coordinate_text(lat: Column, lon: Column) -> Column:
    """``lat,lon`` with fifteen decimals of the exact binary value (the JVM formatter pads the shortest form)."""

    @arrow_udf("string")
    def text(a: pa.Array, b: pa.Array) -> pa.Array:
        known = pc.and_(a.is_valid(), b.is_valid())
        p, q = (c.filter(known).to_numpy(zero_copy_only=False) for c in (a, b))
        # one format for the whole batch
        parts = ("%.15f,%.15f\n" * len(p) % tuple(np.column_stack([p, q]).ravel().tolist())).split("\n")[:-1]
        out = np.full(len(a), None, object)
        out[known.to_numpy(zero_copy_only=False)] = parts
        return pa.array(out, pa.string())

    return text(lat, lon)
