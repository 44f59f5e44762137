"""Where hashes are kept."""

from __future__ import annotations

import numpy as np


class HashIndex:
    """Places of 64-bit hashes in the order of their insertion, by open addressing on arrays."""

    def __init__(self) -> None:
        self.n, self.keys, self.places = 0, np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash (none of them 0), -1 if it isn't there."""
        mask = len(self.keys) - 1
        at, out, todo = (h & np.uint64(mask)).astype(np.int64), np.full(len(h), -1, np.int32), np.arange(len(h))
        while len(todo):
            key = self.keys[at[todo]]
            hit = key == h[todo]
            out[todo[hit]] = self.places[at[todo[hit]]]
            todo = todo[~hit & (key != 0)]
            at[todo] = (at[todo] + 1) & mask
        return out

    def _put(self, h: np.ndarray, places: np.ndarray) -> None:
        mask = len(self.keys) - 1
        at = (h & np.uint64(mask)).astype(np.int64)
        while len(h):
            free = self.keys[at] == 0
            self.keys[at[free]] = h[free]
            mine = self.keys[at] == h
            self.places[at[mine]] = places[mine]
            h, places, at = h[~mine], places[~mine], (at[~mine] + 1) & mask

    def add(self, h: np.ndarray) -> None:
        """h: distinct, not there yet, none of them 0."""
        while 2 * (self.n + len(h)) > len(self.keys):
            old, places = self.keys, self.places
            self.keys, self.places = np.zeros(2 * len(old), np.uint64), np.zeros(2 * len(old), np.int32)
            self._put(old[old != 0], places[old != 0])
        self._put(h, np.arange(self.n, self.n + len(h), dtype=np.int32))
        self.n += len(h)
