"""Vectors of a list column as whole numbers, many rows at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Widths in bytes that a packed component may have.
WIDTHS = (1, 2, 4, 8)


class Scaled:
    """floor(scale * x) of every component, x as double: `values` end to end, row i from `first[i]` to `first[i + 1]`.

    `whole` marks rows that are no null and hold none, nothing infinite and no NaN; of other rows the values mean nothing.
    """

    def __init__(self, column: pa.Array, scale: int):
        flat = pc.cast(column.flatten(), pa.float64())
        x = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False)
        self.first = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
        with np.errstate(all="ignore"):
            self.values = np.floor(x * scale)
        bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
        self.whole = column.is_valid().to_numpy(zero_copy_only=False) & (bad[self.first[1:]] == bad[self.first[:-1]])
        self.size = np.diff(self.first)

    def rows(self, at: np.ndarray, size: int) -> np.ndarray:
        """Rows `at`, all of `size` components, as a matrix of doubles."""
        return self.values[self.first[at][:, None] + np.arange(size)]


def packed(matrix: np.ndarray) -> list[bytes]:
    """Each row of a matrix of whole numbers as bytes, under the least width that holds it: equal rows, equal bytes."""
    out: list[bytes] = [b""] * len(matrix)
    if not matrix.size:
        return out
    most = np.maximum(matrix.max(axis=1), -1 - matrix.min(axis=1))
    need = np.searchsorted([127, 32767, 2**31 - 1], most, "left")
    for k, width in enumerate(WIDTHS):
        at = np.flatnonzero(need == k)
        data, step = np.ascontiguousarray(matrix[at].astype(f"<i{width}")).tobytes(), width * matrix.shape[1]
        for i, row in enumerate(at.tolist()):
            out[row] = data[i * step : (i + 1) * step]
    return out


def unpacked(rows: list[bytes], size: int) -> np.ndarray:
    """What packed() made of rows of `size` components, as whole numbers."""
    out = np.zeros((len(rows), size), np.int64)
    if not size:
        return out
    widths = np.fromiter(map(len, rows), np.int64, len(rows)) // size
    for width in WIDTHS:
        at = np.flatnonzero(widths == width)
        if len(at):
            out[at] = np.frombuffer(b"".join(rows[i] for i in at.tolist()), f"<i{width}").reshape(len(at), size)
    return out
