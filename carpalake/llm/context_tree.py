"""Context-tree weighting over bytes, on tables of counted byte strings.

Each byte is eight binary decisions. A decision is taken at a node: the bits of the byte so far, and
the last d bytes for every depth d from 0 to DEPTH. A node has the Krichevsky-Trofimov
estimate of its counts; the weighted probability of a node is half its own estimate, half the
product of its children's (one byte more of context). Predictions mix the depths by those weights.

A string of DEPTH bytes of context and the byte that follows is one long: the latest byte of
context highest, the byte itself lowest. So strings with a common recent context are neighbours,
and a subtree can be worked out by itself.
"""

from __future__ import annotations

import numpy as np

DEPTH = 5
END = 255  # never occurs in UTF-8; follows each text
HALF = np.log(0.5)


def strings(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A key for each byte of each text and for its end, and how many each text has. Each text follows DEPTH zero bytes."""
    pad, end = bytes(DEPTH), bytes([END])
    x = np.frombuffer(b"".join([y for t in texts for y in (pad, t, end)]), np.uint8).astype(np.int64)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    inside = np.ones(len(x), bool)
    starts = np.cumsum(sizes + DEPTH) - sizes - DEPTH
    for d in range(DEPTH):
        inside[starts + d] = False
    key = x.copy()
    for d in range(1, DEPTH + 1):
        key[d:] |= x[:-d] << (8 * (DEPTH + 1 - d))
    return key[inside], sizes


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[at], np.diff(np.append(at, len(keys)))


def log_gamma(x: np.ndarray) -> np.ndarray:
    shift = np.ones_like(x)
    for i in range(8):
        shift *= x + i
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(shift)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """The log probability that the estimator gives to so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - np.log(np.pi)


def grouped(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sums of values by key, keys sorted."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[at], *[np.add.reduceat(v[order], at) if len(at) else v for v in values]


class Nodes:
    """The nodes of one depth: keys are a context and the 1 to 8 bits that start with a 1 (the decision's place)."""

    def __init__(self, context_and_byte: np.ndarray, counts: np.ndarray):
        keys, zeros, ones = [], [], []
        for k in range(8):
            place = (context_and_byte >> 8 << 8) | 1 << k | (context_and_byte & 255) >> (8 - k)
            bit = (context_and_byte >> (7 - k)) & 1
            key, zero, one = grouped(place, counts * (1 - bit), counts * bit)
            keys.append(key)
            zeros.append(zero)
            ones.append(one)
        order = np.argsort(np.concatenate(keys), kind="stable")
        self.keys = np.concatenate(keys)[order]
        self.zeros, self.ones = np.concatenate(zeros)[order].astype(np.float64), np.concatenate(ones)[order].astype(np.float64)
        self.own = log_kt(self.zeros, self.ones)
        self.weighted = self.own

    def below(self, parents: np.ndarray, weighted: np.ndarray) -> None:
        """Mix in the product over the nodes' children, given by parent key; every node has some."""
        keys, total = grouped(parents, weighted)
        product = np.zeros(len(self.keys))
        product[np.searchsorted(self.keys, keys)] = total
        self.weighted = HALF + np.logaddexp(self.own, product)

    def up(self) -> np.ndarray:
        """The keys of the parents: without the oldest byte of context."""
        return self.keys >> 16 << 8 | self.keys & 255

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        return at, (self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool))


def shorten(keys: np.ndarray, d: int) -> np.ndarray:
    """Strings with the d latest bytes of context only."""
    return keys >> (8 * (DEPTH - d + 1)) << 8 | keys & 255


def levels(keys: np.ndarray, counts: np.ndarray, least: int) -> dict[int, Nodes]:
    """Nodes of the depths from DEPTH up to `least`, weighted. keys: all counted strings of the contexts."""
    out: dict[int, Nodes] = {}
    for d in range(DEPTH, least - 1, -1):
        out[d] = Nodes(*grouped(shorten(keys, d), counts))
        if d < DEPTH:
            out[d].below(out[d + 1].up(), out[d + 1].weighted)
    return out


def log_probabilities(keys: np.ndarray, tree: dict[int, Nodes]) -> np.ndarray:
    """The natural log probability of each string's byte after its context. A node that was never seen adds nothing to its parent's estimate."""
    out = np.zeros(len(keys))
    for k in range(8):
        bit = (keys >> (7 - k)) & 1
        p, known = np.full(len(keys), 0.5), np.zeros(len(keys), bool)
        for d in range(DEPTH, -1, -1):
            short = shorten(keys, d)
            at, there = tree[d].find((short >> 8 << 8) | 1 << k | (short & 255) >> (8 - k))
            if not len(tree[d].keys):
                continue
            zeros, ones = tree[d].zeros[at], tree[d].ones[at]
            kt = (np.where(bit, ones, zeros) + 0.5) / (zeros + ones + 1)
            share = np.exp(HALF + tree[d].own[at] - tree[d].weighted[at]) if d < DEPTH else 1.0
            p = np.where(there, np.where(known, share * kt + (1 - share) * p, kt), p)
            known |= there
        out += np.log(p)
    return out
