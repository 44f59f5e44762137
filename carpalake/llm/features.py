"""Hashed word features."""

from __future__ import annotations

from zlib import crc32

import numpy as np

STEP = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(text: str | bytes | None) -> np.ndarray:
    """A hash for each word of the text, A-Z in lower case."""
    words = (text.encode() if isinstance(text, str) else text or b"").lower().split()
    return np.fromiter(map(crc32, words), np.uint64, len(words))


def mix(h: np.ndarray, slots: int) -> np.ndarray:
    return ((h * STEP) >> np.uint64(33)).astype(np.int64) % slots


def ngram_slots(text: str | bytes | None, slots: int) -> np.ndarray:
    """The slot of each word and of each pair of neighbours."""
    h = word_hashes(text)
    return np.concatenate([mix(h, slots), mix(h[:-1] * np.uint64(0x85EBCA6B) + h[1:] + np.uint64(1), slots)])
