"""Benchmark decontamination: rare word n-gram seeds, then Smith-Waterman alignment.

The test items are the stated query set. They are taken in blocks of bounded size, and each
block is held by every task while it scans all documents, so no text is shuffled. One scan
counts how often the corpus has each n-gram of the items. An item may be matched with up to e
edited words, so e + 1 disjoint n-grams of it are chosen as seeds, together the rarest in the
corpus: e edits leave one of them whole, and no passage within e edits is missed. The second scan
joins the documents' n-grams to the seeds by hash and aligns the words around each hit to the
item, the words themselves, not their hashes.

Words are runs of letters and digits. In scripts that are written without spaces each letter is a word.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

#: The Unicode blocks of scripts written without spaces (Thai, Lao, Myanmar, Khmer, kana, Han and its extensions).
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
WORD = re.compile(rf"[^\W_{UNSPACED}]+|[^\W_]")
#: Scores of a word that is equal, of one that differs or is missing, and of an extra one: each edit costs 5 against a whole match, a word cut off at an end 4.
MATCH, OTHER, EXTRA = 4, -1, -5
FILTER = 1 << 22


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def lowered(words: list[str]) -> list[bytes]:
    """The words in lower case. They are found before, as lower case may have more characters than the text."""
    return "\n".join(words).lower().encode().split(b"\n") if words else []


def hashes_of(words: list[str]) -> np.ndarray:
    return np.fromiter(map(crc32, lowered(words)), np.uint64, len(words))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of n words."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i]
    return out ^ (out >> np.uint64(29))


def align(item: np.ndarray, words: np.ndarray) -> tuple[int, int]:
    """The best local alignment's score, and the place in words after its end."""
    row, slope, best, end = np.zeros(len(words) + 1, np.int64), -EXTRA * np.arange(len(words) + 1), 0, 0
    for w in item:
        new = np.maximum(row + OTHER, 0)
        new[1:] = np.maximum(new[1:], row[:-1] + np.where(words == w, MATCH, OTHER))
        row = np.maximum.accumulate(new + slope) - slope
        if (top := int(row.max())) > best:
            best, end = top, int(row.argmax())
    return best, end


@dataclass
class Index:
    """n-grams of the items of a block, by n: a filter, sorted hashes, and the item and place that each is from."""

    items: list[tuple[object, str]]
    sizes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    lengths: np.ndarray
    spelled: dict[int, tuple[np.ndarray, dict[bytes, int]]] = field(default_factory=dict)

    @classmethod
    def build(cls, items: list[tuple[object, str]], hashes: list[np.ndarray], sizes: list[int], places: list[np.ndarray] | None = None) -> Index:
        """sizes: for each item, its n. places: those of its n-grams to take; else all."""
        by_n: dict[int, list] = defaultdict(list)
        for i, (h, n) in enumerate(zip(hashes, sizes, strict=True)):
            g = grams(h, n)
            at = np.arange(len(g), dtype=np.int32) if places is None else places[i]
            by_n[n].append((g[at], np.full(len(at), i, np.int32), at))
        out = {}
        for n, rows in by_n.items():
            g, item, place = map(np.concatenate, zip(*rows, strict=True))
            order = np.argsort(g, kind="stable")
            bloom = np.zeros(FILTER, bool)
            bloom[(g % np.uint64(FILTER)).astype(np.int64)] = True
            out[n] = (bloom, g[order], item[order], place[order])
        return cls(items, out, np.array([len(h) for h in hashes]))

    def hits(self, h: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """n, places in h, rows of the index."""
        for n, (bloom, keys, _, _) in self.sizes.items():
            g = grams(h, n)
            at = np.flatnonzero(bloom[(g % np.uint64(FILTER)).astype(np.int64)])
            low, high = np.searchsorted(keys, g[at], "left"), np.searchsorted(keys, g[at], "right")
            times = high - low
            if times.any():
                rows = np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                yield n, np.repeat(at, times), rows

    def words(self, i: int) -> tuple[np.ndarray, dict[bytes, int]]:
        """Item i as numbers of its words, and the numbers."""
        if i not in self.spelled:
            words = lowered(words_of(self.items[i][1]))
            numbers = {w: k for k, w in enumerate(dict.fromkeys(words))}
            self.spelled[i] = np.array([numbers[w] for w in words]), numbers
        return self.spelled[i]


def edits(length: int, similarity: float) -> int:
    """The most disjoint n-grams of an item that can be broken in a match: each takes an edit, which costs MATCH at least."""
    return int(length * (1 - similarity) + 1e-9)


def size_of(length: int, similarity: float, gram: int) -> int:
    return min(gram, length // (edits(length, similarity) + 1))


def rarest(costs: np.ndarray, n: int, k: int) -> list[int]:
    """The places of k disjoint n-grams with the least sum of costs."""
    m = len(costs)
    best = [np.zeros(m + n + 1)]
    for _ in range(k):  # best[j][p]: the least cost of j n-grams from place p on
        now = np.full(m + n + 1, np.inf)
        take = costs + best[-1][n : n + m]
        now[:m] = np.minimum.accumulate(take[::-1])[::-1]
        best.append(now)
    out, p = [], 0
    for j in range(k, 0, -1):
        take = costs[p:] + best[j - 1][p + n : m + n]
        p += int(np.argmin(take))
        out.append(p)
        p += n
    return out


def _count(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    found = {n: np.zeros(len(x[1]), np.int64) for n, x in index.sizes.items()}
    for batch in batches:
        for text in batch.column(0):
            for n, _, rows in index.hits(hashes_of(words_of(text.as_py()))):
                found[n] += np.bincount(rows, minlength=len(found[n]))
    for n, counts in found.items():
        at = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(np.full(len(at), n)), pa.array(at), pa.array(counts[at])], ["n", "at", "times"])


def leaks(text: str | None, index: Index, similarity: float) -> list[tuple[object, float, int, int]]:
    """(item id, similarity, start, end) of each item that the text leaks; start and end in characters."""
    words = words_of(text)
    windows: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for n, at, rows in index.hits(hashes_of(words)):
        _, _, item, place = index.sizes[n]
        size = index.lengths[item[rows]]
        start = at - place[rows]
        for i, a, b in zip(item[rows].tolist(), np.maximum(0, start - size).tolist(), np.minimum(len(words), start + 2 * size).tolist(), strict=True):
            windows[i].append((a, b))
    out, lower = [], lowered(words) if windows else []
    for i, spans in windows.items():
        item, numbers = index.words(i)
        best, end = 0, 0
        merged: list[list[int]] = []
        for a, b in sorted(set(spans)):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        own = lambda a, b, numbers=numbers: np.array([numbers.get(w, -1) for w in lower[a:b]], np.int64)
        for a, b in merged:
            for c in range(a, b, 4096):  # pieces overlap by what an alignment can span
                score, stop = align(item, own(c, min(b, c + 4096 + 3 * len(item))))
                if score > best:
                    best, end = score, c + stop
        if best >= MATCH * similarity * len(item) - 1e-9:
            _, reach = align(item[::-1], own(max(0, end - 3 * len(item)), end)[::-1])
            spans_at = [m.span() for m in WORD.finditer(text or "")]
            out.append((index.items[i][0], best / (MATCH * len(item)), spans_at[end - reach][0], spans_at[end - 1][1]))
    return out


def _blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[object, str]]]:
    """Items in blocks of about block_bytes, each collected by itself."""
    rows = items.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).distinct()
    total = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = -(-total // block_bytes)
    for k in range(n):
        part = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)
        got = part.sort("id", "text").toArrow()
        yield list(zip(got.column("id").to_pylist(), got.column("text").to_pylist(), strict=True))


def _indexes(docs: DataFrame, items: DataFrame, similarity: float, gram: int, item_id: str, text_col: str, block_bytes: int) -> Iterator[Index]:
    texts = docs.select(F.col(text_col).alias("text"))
    for block in _blocks(items, item_id, "text", block_bytes):
        hashes = [hashes_of(words_of(text)) for _, text in block]
        block, hashes = [x for x, h in zip(block, hashes, strict=True) if len(h)], [h for h in hashes if len(h)]
        if not block:
            continue
        sizes = [size_of(len(h), similarity, gram) for h in hashes]
        every = Index.build(block, hashes, sizes)
        counted = texts.mapInArrow(lambda b, every=every: tidy(_count(b, every)), "n long, at long, times long").groupBy("n", "at").agg(F.sum("times").alias("times"))
        found = counted.toArrow()  # three numbers for each n-gram of the block at most
        n_of, at, times = (found.column(i).to_numpy() for i in range(3))
        widths = np.array([len(h) - n + 1 for h, n in zip(hashes, sizes, strict=True)])
        starts = np.cumsum(widths) - widths
        costs = np.zeros(widths.sum())
        for n, (_, _, item, place) in every.sizes.items():
            own = n_of == n
            costs[starts[item[at[own]]] + place[at[own]]] = times[own]
        del every, found
        chosen = [np.array(rarest(costs[s : s + w], n, edits(len(h), similarity) + 1), np.int32) for s, w, n, h in zip(starts, widths, sizes, hashes, strict=True)]
        yield Index.build(block, hashes, sizes, chosen)


def find_leaks(docs: DataFrame, items: DataFrame, similarity: float = 0.8, gram: int = 5, id_col: str = "doc_id", item_id: str = "item_id", text_col: str = "text", block_bytes: int = 16_000_000) -> DataFrame:
    """One row per document and item that it leaks: id_col, item_id, similarity, start, end (characters of the text).

    similarity is the alignment's score over that of the whole item (4 for an equal word, -1 for one that
    differs or is missing, -5 for an extra one); words count in lower case. With e
    edits among L words, it is 1 - 1.25 e / L; with e words cut off at the ends, 1 - e / L.
    Cases: items of fewer than `gram` words are sought whole; items without words never match; null texts have no words; null ids and repeated rows of docs are
    rows like others; repeated items count once; empty tables give no rows; other columns are not read.
    """
    out = None
    ids = f"id {dict(docs.dtypes)[id_col]}, item {dict(items.dtypes)[item_id]}, similarity double, start long, end long"
    names = ["id", "item", "similarity", "start", "end"]
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    item_type = pa.int64() if dict(items.dtypes)[item_id] == "bigint" else None
    for index in _indexes(docs, items, similarity, gram, item_id, text_col, block_bytes):

        def search(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, rows = [], []
                for i, text in enumerate(batch.column(1)):
                    for r in leaks(text.as_py(), index, similarity):
                        at.append(i)
                        rows.append(r)
                cols = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
                yield pa.record_batch([batch.column(0).take(pa.array(at, pa.int64())), pa.array(cols[0], item_type), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], names)

        found = source.mapInArrow(lambda b, search=search: tidy(search(b)), ids)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = docs.sparkSession.createDataFrame([], ids)
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_id), "similarity", "start", "end")


def drop_leaking(docs: DataFrame, items: DataFrame, similarity: float = 0.8, gram: int = 5, item_id: str = "item_id", text_col: str = "text", block_bytes: int = 16_000_000) -> DataFrame:
    """The rows of docs that leak no item (as find_leaks finds them), with all their columns, without a shuffle.

    Cases: null texts and texts without words leak nothing; null ids and repeated rows are rows like others; without items
    all rows stay; an empty table gives no rows; other columns, whatever their names, go through as they are.
    """
    at = docs.columns.index(text_col)
    for index in _indexes(docs, items, similarity, gram, item_id, text_col, block_bytes):

        def keep(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(0, batch.num_rows, 1000):
                    part = batch.slice(i, 1000)
                    yield part.filter(pa.array([not leaks(t.as_py(), index, similarity) for t in part.column(at)], pa.bool_()))

        docs = docs.mapInArrow(lambda b, keep=keep: tidy(keep(b)), docs.schema)
    return docs
