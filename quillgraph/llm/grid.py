"""Vectors of Arrow batches as rows of whole numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def lengths(vectors: pa.Array) -> np.ndarray:
    """The length of each vector, -1 for null."""
    return pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def whole_rows(vectors: pa.Array, length: int, scale: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, x): x holds floor(scale * component) of the vectors of this length whose components are all known, finite and, so scaled,
    within `most`; places tells where they stand."""
    at = np.flatnonzero(lengths(vectors) == length)
    if not len(at) or not length:
        return np.zeros(0, dtype=np.int64), np.zeros((0, length), dtype=np.int64)
    values = pc.list_flatten(vectors.take(pa.array(at))).cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, length)
    with np.errstate(invalid="ignore", over="ignore"):
        x = np.floor(values * scale)
        fine = (np.abs(x) <= most).all(axis=1)
    return at[fine], x[fine].astype(np.int64)
