"""Arrow list columns as dense matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def dense(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Dimension -> (row numbers, matrix of doubles) of the rows that are not null, not empty and finite throughout."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(sizes) - sizes
    found = {}
    for dim in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == dim)
        matrix = flat[starts[rows][:, None] + np.arange(dim)]
        good = np.isfinite(matrix).all(axis=1)
        if good.any():
            found[int(dim)] = rows[good], matrix[good]
    return found
