"""Sorted hash arrays: lookups of 64-bit hashes by whole NumPy arrays."""

from __future__ import annotations

import numpy as np


class SortedHash:
    """Distinct uniform 64-bit keys in order, with a directory by their leading bits."""

    def __init__(self, keys: np.ndarray):
        """keys: sorted, distinct."""
        self.n = len(keys)
        bits = max(1, int(self.n).bit_length())
        self.shift = np.uint64(64 - bits)
        self.begin = np.empty(1 << bits, np.int32)
        for at in range(0, 1 << bits, 1 << 16):  # in parts, for the driver's memory
            end = min(1 << bits, at + (1 << 16))
            self.begin[at:end] = np.searchsorted(keys, np.arange(at, end, dtype=np.uint64) << self.shift)
        self.keys = np.append(keys, np.uint64(2**64 - 1))

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each h among the keys, or -1."""
        at = self.begin[h >> self.shift].astype(np.int64)
        key = self.keys[at]
        out = np.where((key == h) & (at < self.n), at, -1)
        todo = np.flatnonzero(key < h)
        while todo.size:
            place = at[todo] = at[todo] + 1
            key = self.keys[np.minimum(place, self.n)]
            out[todo[(key == h[todo]) & (place < self.n)]] = place[(key == h[todo]) & (place < self.n)]
            todo = todo[(key < h[todo]) & (place < self.n)]
        return out
