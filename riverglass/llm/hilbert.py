"""Hilbert curve positions of points on an integer grid, for whole arrays of points at once."""

from __future__ import annotations

import numpy as np


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of each row of ``cells`` (n x m, values below 2**bits); m * bits is at most 63.

    The transpose form of the curve: from the high bit down, exchange or invert the lower bits of the axes, then Gray-encode.
    """
    x = cells.astype(np.int64).copy()
    n, m = x.shape
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        p = q - 1
        for i in range(m):
            on = (x[:, i] & q) != 0
            t = np.where(on, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] = np.where(on, x[:, 0] ^ p, x[:, 0] ^ t)
            x[:, i] ^= t
        q >>= 1
    for i in range(1, m):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(n, np.int64)
    q = top
    while q > 1:
        t = np.where((x[:, m - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t[:, None]
    key = np.zeros(n, np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(m):
            key = (key << 1) | ((x[:, i] >> b) & 1)
    return key
