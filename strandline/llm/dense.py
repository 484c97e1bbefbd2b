"""Vectors of Arrow list columns as numpy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def lengths(lists: pa.Array) -> np.ndarray:
    """Number of entries of each vector, -1 for null."""
    return pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False)


def matrix(lists: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that hold a vector of this length without null or non-finite entries, and those vectors as doubles."""
    rows = np.flatnonzero(lengths(lists) == length)
    x = lists.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(rows), length)
    fine = np.isfinite(x).all(axis=1)
    return rows[fine], x[fine]


def wide(values) -> pa.Array:
    """Whole numbers of any size below 10**38, for sums that a long can't hold."""
    from decimal import Decimal

    return pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))
