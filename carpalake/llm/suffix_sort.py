"""Sorting of short byte strings in groups by hash-compared mergesort.

Prefix polynomial hashes make the equality of two prefixes one comparison, and a binary search over
their lengths gives the common extension of two strings, so a comparison takes a logarithmic
number of steps. All groups are sorted at once, bottom up; a string's place in a merge is found by
binary search in the other run. The order is verified on the bytes at the end.
"""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
#: A random odd 64-bit value per byte value.
SPREAD = np.random.default_rng(12345).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def prefix_hashes(rows: np.ndarray) -> np.ndarray:
    """rows: strings of bytes, padded. Column t has the hashes of the first t bytes."""
    powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(max(0, rows.shape[1] - 1), BASE)]))[: rows.shape[1]]
    out = np.zeros((rows.shape[0], rows.shape[1] + 1), np.uint64)
    np.cumsum(SPREAD[rows] * powers, axis=1, out=out[:, 1:])
    return out


def common(hashes: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The length of the common start of strings a and b."""
    low, high = np.zeros(len(a), np.int64), np.minimum(sizes[a], sizes[b])
    while (open_ := low < high).any():
        mid = (low + high + 1) >> 1
        same = hashes[a, mid] == hashes[b, mid]
        low = np.where(open_ & same, mid, low)
        high = np.where(open_ & ~same, mid - 1, high)
    return low


def compare(rows: np.ndarray, hashes: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """-1, 0 or 1 as string a is less than, equal to or greater than b."""
    at, most = common(hashes, sizes, a, b), rows.shape[1] - 1
    ended = (at == sizes[a]) | (at == sizes[b])
    bytes_ = np.sign(rows[a, np.minimum(at, most)].astype(np.int64) - rows[b, np.minimum(at, most)])
    return np.where(ended, np.sign(sizes[a] - sizes[b]), bytes_)


def true_common(rows: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    differ = rows[a] != rows[b]
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return np.minimum(first, np.minimum(sizes[a], sizes[b]))


def sort_groups(rows: np.ndarray, sizes: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the strings by group (sorted already) and bytes, and the common start of each with the one before it in its group (-1 for the first)."""
    n = len(rows)
    order, hashes = np.arange(n), prefix_hashes(rows)
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if n else np.empty(0, np.int64)
    start = np.repeat(first, np.diff(np.append(first, n)))
    stop = np.repeat(np.append(first[1:], n), np.diff(np.append(first, n)))
    width = 1
    while n and width < (stop - start).max():
        at = np.flatnonzero(stop - start > width)
        run = (at - start[at]) // width
        other = start[at] + (run ^ 1) * width
        keep = other < stop[at]
        at, run, other = at[keep], run[keep], other[keep]
        low, high = other.copy(), np.minimum(other + width, stop[at])
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) >> 1
            c = compare(rows, hashes, sizes, order[mid], order[at[open_]])
            less = np.where(run[open_] & 1, c <= 0, c < 0)  # equal strings keep their order
            low[open_[less]], high[open_[~less]] = mid[less] + 1, mid[~less]
        base = start[at] + (run >> 1) * 2 * width
        new = order.copy()
        new[base + (at - start[at]) % width + low - other] = order[at]
        order = new
        width *= 2
    inside = np.flatnonzero(np.arange(n) > start)
    a, b = order[inside - 1], order[inside]
    lcp = np.full(n, -1)
    lcp[inside] = true_common(rows, sizes, a, b)
    most = max(0, rows.shape[1] - 1)
    at = np.minimum(lcp[inside], most)
    ended = (lcp[inside] == sizes[a]) | (lcp[inside] == sizes[b])
    wrong = np.where(ended, sizes[a] > sizes[b], rows[a, at] > rows[b, at]) if n and rows.shape[1] else np.zeros(len(a), bool)
    if wrong.any():  # a hash collision: sort by the bytes themselves
        order = np.lexsort([sizes, *rows.T[::-1], group])
        lcp[inside] = true_common(rows, sizes, order[inside - 1], order[inside])
    return order, lcp
