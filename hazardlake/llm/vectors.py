"""Vectors of Arrow list columns as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def finite_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(places, lengths, values)``: places of the rows whose vector and all of its entries are set and finite, the
    lengths of those vectors, and their entries one behind the other as doubles.  An empty vector is left out."""
    lengths = np.diff(column.offsets.to_numpy(zero_copy_only=False)).astype(np.int64)
    lengths[column.is_null().to_numpy(zero_copy_only=False)] = 0
    # a null list may still own entries, so entries are taken by the offsets of the rows that count
    entries = column.values.to_numpy(zero_copy_only=False).astype(np.float64)  # null entries become NaN
    starts = column.offsets.to_numpy(zero_copy_only=False)[:-1].astype(np.int64)
    places = np.flatnonzero(lengths > 0)
    first = np.cumsum(lengths[places]) - lengths[places]
    values = entries[np.repeat(starts[places] - first, lengths[places]) + np.arange(lengths[places].sum())]
    fine = np.logical_and.reduceat(np.isfinite(values), first) if len(places) else np.zeros(0, bool)
    return places[fine], lengths[places[fine]], values[np.repeat(fine, lengths[places])]


def matrix(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and rows (as one matrix) of the finite vectors of the given length."""
    places, lengths, values = finite_rows(column)
    own = lengths == size
    return places[own], values[np.repeat(own, lengths)].reshape(-1, size)


def whole_numbers(values: np.ndarray, scale: int) -> np.ndarray:
    """``floor(scale * value)`` as long numbers; entries beyond 2 ** 52 are refused, since doubles skip numbers there."""
    scaled = np.floor(values * scale)
    if scaled.size and np.abs(scaled).max() >= 2.0 ** 52:
        raise ValueError(f"an entry of a vector is too large to be scaled by {scale} exactly")
    return scaled.astype(np.int64)
