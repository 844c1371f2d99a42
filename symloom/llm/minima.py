"""Positions that are the least of a window, for texts of any length."""

from __future__ import annotations

import numpy as np

BLOCK = 1 << 16


def window_minima(values: np.ndarray, size: int) -> np.ndarray:
    """The positions, in order, of the least value of some ``size`` consecutive ones; of equal ones the
    last. Windows are looked at block by block, so memory follows the values, not their windows."""
    if len(values) < size:
        return np.array([], dtype=np.int64)
    views = np.lib.stride_tricks.sliding_window_view(values, size)
    found = [np.unique(np.arange(at, min(at + BLOCK, len(views))) + size - 1 - views[at : at + BLOCK, ::-1].argmin(axis=1)) for at in range(0, len(views), BLOCK)]
    return np.unique(np.concatenate(found))
