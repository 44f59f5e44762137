"""Stretches of words that repeat with a period three times or more, found by internal pattern matching.

A run is a stretch with smallest period q and length of at least `times` * q (and `least`) that no neighbour extends.
In each text, for each power of two l, blocks of l words start at each multiple of l. A run with l <= q < 2 l
holds a whole such block that occurs again q words later, so the block's occurrences in the window of starts l to 2 l
words later are candidates (periods under the least l are the distance to the block's next occurrence, for it holds a whole period).

- Blocks of 2 ** k words are equal if they have one rank; ranks come from prefix doubling, which ends in a suffix array.
  All occurrences of a block are one interval of it.
- The first occurrence from a place on is a range successor in that interval: a wavelet tree over the suffix array
  counts the smaller places, and selects the next one.
- Occurrences in one window are at most two, or a progression whose difference is the block's own period. Then the run's
  period is told by where that smaller period ends: the stretch around the block and the one around the occurrence end q apart, on
  the left or on the right, or there is no run. So each block gives two candidates at most.
- A candidate is extended to both sides by comparing ranks of ever shorter blocks, which is exact.

All blocks of many texts are dealt with at once in arrays. A text's words are ranked within the text, so equal texts
don't slow each other. Texts of which no block of least length occurs twice are done after three doublings.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

WORD = re.compile(rb"[^\x20\x09-\x0d]+")
BATCH = 200_000  # words that are dealt with at once; a longer text is dealt with alone


def doubled(words: np.ndarray, text: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """The suffix array of words (each text's part sorted for itself); and for each k, until all differ, the rank of the block of 2 ** k words at each place and where that rank's interval ends.

    text: the number of each word's text, increasing; end: where that text ends. A rank is the start of its interval. Blocks over an end differ from all others.
    """
    n, places = len(words), np.arange(len(words))
    key = text * (np.int64(words.max()) + 1) + words if n else words
    order = np.argsort(key, kind="stable")
    ranks, stops = [], []

    def grouped(fresh: np.ndarray, at: np.ndarray, rank: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """at: places in the order that begin (fresh) or go on a rank. Which of them have a rank of several."""
        first = np.flatnonzero(fresh)
        size = np.diff(np.append(first, len(at)))
        rank[order[at]] = np.repeat(at[first], size)
        stop[at[first]] = at[first] + size
        return np.repeat(size > 1, size)

    rank, stop = np.empty(n, np.int64), np.zeros(n, np.int64)
    fresh = np.ones(n, bool)
    fresh[1:] = key[order[1:]] != key[order[:-1]]
    active = places[grouped(fresh, places, rank, stop)]
    width = 1
    while True:
        ranks.append(rank.astype(np.int32))
        stops.append(stop.astype(np.int32))
        if not len(active):
            return order, ranks, stops
        here = order[active]
        after = here + width
        second = np.where(after < end[here], rank[np.minimum(after, n - 1)], -1)
        key = rank[here] * np.int64(n + 1) + second + 1
        by_key = np.argsort(key, kind="stable")
        order[active] = here[by_key]
        key = key[by_key]
        fresh = np.ones(len(active), bool)
        fresh[1:] = key[1:] != key[:-1]
        rank, stop = rank.copy(), stop.copy()
        active = active[grouped(fresh, active, rank, stop)]
        width *= 2


class WaveletTree:
    """A wavelet tree over a permutation, its levels as bit rows with counts; queries are arrays."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values)).bit_length())
        self.ones, self.zeros = [], []
        for b in reversed(range(self.bits)):
            bit = (values >> b) & 1
            ones = np.zeros(len(values) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(values) - int(ones[-1]))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def smaller(self, low: np.ndarray, high: np.ndarray, than: np.ndarray) -> np.ndarray:
        """How many of the values from low to high are smaller than a value."""
        out = np.zeros(len(low), np.int64)
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            one = (than >> (self.bits - 1 - level)) & 1 == 1
            l1, h1 = ones[low], ones[high]
            l0, h0 = low - l1, high - h1
            out += np.where(one, h0 - l0, 0)
            low, high = np.where(one, zeros + l1, l0), np.where(one, zeros + h1, h0)
        return out

    def select(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The value that k of the values from low to high are smaller than."""
        out = np.zeros(len(low), np.int64)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            l1, h1 = ones[low], ones[high]
            l0, h0 = low - l1, high - h1
            one = k >= h0 - l0
            k = np.where(one, k - (h0 - l0), k)
            low, high = np.where(one, zeros + l1, l0), np.where(one, zeros + h1, h0)
            out = out << 1 | one
        return out


class Extension:
    """How far two places go on alike, by ranks of blocks of ever smaller powers of two."""

    def __init__(self, ranks: list[np.ndarray], start: np.ndarray, end: np.ndarray):
        self.ranks, self.start, self.end = ranks, start, end

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of words from a and from b on; a < b."""
        out, end, n = np.zeros(len(a), np.int64), self.end[b], len(self.end)
        for k in reversed(range(len(self.ranks))):
            r, x, y = self.ranks[k], a + out, b + out
            same = (y + (1 << k) <= end) & (r[np.minimum(x, n - 1)] == r[np.minimum(y, n - 1)])
            out += same << k
        return out

    def back(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of words before a and before b; a < b."""
        out, start = np.zeros(len(a), np.int64), self.start[a]
        for k in reversed(range(len(self.ranks))):
            r, x, y = self.ranks[k], a - out - (1 << k), b - out - (1 << k)
            same = (x >= start) & (r[np.maximum(x, 0)] == r[np.maximum(y, 0)])
            out += same << k
        return out


def find_runs(words: np.ndarray, text: np.ndarray, start: np.ndarray, end: np.ndarray, least: int = 24, times: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and smallest period of each run of some texts that lie one after the other, by text, start and period.

    text, start, end: of each word, its text's number and bounds.
    """
    base = max(0, ((least + 2) // 3).bit_length() - 1)  # blocks of 2 ** base words: with any period below, a run holds one and its next occurrence
    none = np.empty(0, np.int64)
    if times < 3 or least < 3:
        raise ValueError("runs repeat three times at least and have three words at least")
    order, ranks, stops = doubled(words, text, end)
    if len(ranks) <= base:
        return none, none, none
    wide = (stops[base][ranks[base]] - ranks[base]) > 1
    if not wide.any():
        return none, none, none
    tree, extension = WaveletTree(order), Extension(ranks, start, end)
    at, periods = [], []

    for k in range(base, len(ranks)):
        size, low = 1 << k, ranks[k].astype(np.int64)
        high = stops[k][low].astype(np.int64)
        block = np.flatnonzero((high - low > 1) & ((np.arange(len(low)) - start) % size == 0))
        if not len(block):
            continue
        low, high = low[block], high[block]
        from_, until = block + size, np.minimum(block + 2 * size, end[block])
        before = tree.smaller(low, high, from_)
        if k == base:  # smaller periods: the next occurrence
            first = tree.smaller(low, high, block + 1)
            near = np.flatnonzero(first < before)
            at.append(block[near])
            periods.append(tree.select(low[near], high[near], first[near]) - block[near])
        found = tree.smaller(low, high, until) - before
        one = np.flatnonzero((found > 0) & (from_ < end[block]))
        block, low, high, before, found = (v[one] for v in (block, low, high, before, found))
        first = tree.select(low, high, before)
        several = np.flatnonzero(found > 1)
        second = tree.select(low[several], high[several], before[several] + 1)
        at += [block[found <= 2], block[several[found[several] == 2]]]
        periods += [(first - block)[found <= 2], (second - block[several])[found[several] == 2]]
        row = several[found[several] > 2]  # a progression
        b, p, step = block[row], first[row], second[found[several] > 2] - first[row]
        left = (b - extension.back(b, b + step), p - extension.back(p, p + step))
        right = (b + extension.ahead(b, b + step), p + extension.ahead(p, p + step))
        other = left[0] != left[1]
        for ends in (left, right):
            q = (ends[1] - ends[0])[other]
            fit = (q >= size) & (q < 2 * size)
            at.append(b[other][fit])
            periods.append(q[fit])

    a, q = np.concatenate([none, *at]), np.concatenate([none, *periods])
    ok = a + q < end[a]
    a, q = a[ok], q[ok]
    first = a - extension.back(a, a + q)
    length = a + q + extension.ahead(a, a + q) - first
    ok = length >= np.maximum(least, times * q)
    first, length, q = first[ok], length[ok], q[ok]
    by = np.lexsort([q, length, first])  # of periods of one stretch, the smallest
    first, length, q = first[by], length[by], q[by]
    fresh = np.ones(len(first), bool)
    fresh[1:] = (first[1:] != first[:-1]) | (length[1:] != length[:-1])
    first, length, q = first[fresh], length[fresh], q[fresh]
    by = np.lexsort([q, first])
    return first[by], length[by], q[by]


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
OUT = "id long, n_words long, runs array<struct<start: long, length: long, period: long>>, strongest int, collapsed string"


def strongest(lengths: list[int], periods: list[int]) -> int | None:
    """The place from 1 on of the run with the greatest exact length / period; of equal ones, the first."""
    best = None
    for i, (n, q) in enumerate(zip(lengths, periods, strict=True)):
        if best is None or n * periods[best] > lengths[best] * q:
            best = i
    return None if best is None else best + 1


def _collapse(batches: Iterator[pa.RecordBatch], least: int, times: int) -> Iterator[pa.RecordBatch]:
    """batches: id, text. Rows of OUT."""
    names = [c.split()[0] for c in ("id", "n_words", "runs", "strongest", "collapsed")]

    def done(ids: list, split: list[list[bytes]]) -> pa.RecordBatch:
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        ends = np.cumsum(sizes)
        numbers: dict[bytes, int] = {}
        words = np.fromiter((numbers.setdefault(w, len(numbers)) for s in split for w in s), np.int64, int(ends[-1]))
        text = np.repeat(np.arange(len(split)), sizes)
        start, end = np.repeat(ends - sizes, sizes), np.repeat(ends, sizes)
        first, length, period = find_runs(words, text, start, end, least, times)
        change = np.zeros(len(words) + 1, np.int64)
        np.add.at(change, first + period, 1)
        np.add.at(change, first + length, -1)
        gone = np.cumsum(change)[:-1] > 0
        of = text[first] if len(first) else first
        bounds = np.searchsorted(of, np.arange(len(split) + 1))
        first = first - (ends - sizes)[of] if len(first) else first
        best, kept = [], []
        for i, (s, e) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            best.append(strongest(length[s:e].tolist(), period[s:e].tolist()))
            mine = split[i] if s == e else [split[i][j] for j in np.flatnonzero(~gone[ends[i] - sizes[i] : ends[i]]).tolist()]
            kept.append(b" ".join(mine))
        runs = pa.StructArray.from_arrays([pa.array(v) for v in (first, length, period)], fields=list(RUN))
        columns = [pa.array(ids, pa.int64()), pa.array(sizes), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), runs), pa.array(best, pa.int32()), pa.array(kept, pa.binary()).cast(pa.string())]
        return pa.record_batch(columns, names)

    ids, split, n = [], [], 0
    for batch in batches:
        for i in range(batch.num_rows):
            found = WORD.findall((batch.column(1)[i].as_py() or "").encode())
            if split and n + len(found) > BATCH:
                yield done(ids, split)
                ids, split, n = [], [], 0
            ids.append(batch.column(0)[i].as_py())
            split.append(found)
            n += len(found)
            if len(ids) >= 5000:
                yield done(ids, split)
                ids, split, n = [], [], 0
    if split:
        yield done(ids, split)


def collapse_runs(docs: DataFrame, least: int = 24, times: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n_words, runs (start, length, period; by start, then period), strongest (the place in runs, from 1 on, of the one with the greatest length / period; null without runs), collapsed.

    Words are what lies between ASCII whitespace. A run has at least `least` words (3 or more) and `times` (3 or more) periods. collapsed
    are the words, joined by a space, without those that a run holds after its first period.
    Cases: a null text has no words; null ids and repeated rows are rows like others; an empty table gives no rows; other columns are
    not read. Texts are dealt with where they are, without a shuffle; a task holds about 200,000 words at once, or its
    longest text, with some 150 bytes a word.
    """
    found = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(lambda b: tidy(_collapse(b, least, times)), OUT)
    return found.withColumnRenamed("id", id_col)
