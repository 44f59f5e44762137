"""Removal of every byte covered by a string of LENGTH bytes that also starts earlier in the corpus.

Suffixes are compared only where they can match. Every stretch of LENGTH bytes holds K-byte
strings; the one with the least hash is its anchor, and equal stretches have equal anchors at equal
places. So only anchors (about one in 35 bytes) are shuffled, each with a hash of all that can
matter around it (its context: LENGTH - K bytes to either side).

- Anchors with equal context hashes: all but the first claim to repeat it, with their whole contexts.
- Anchors that are equal in contexts that aren't: the first of each context sends its bytes. The
  groups' right and left contexts are sorted as suffixes (suffix_sort); for each division of
  LENGTH - K bytes into left and right, neighbours with common extensions that long are one
  class, and all but its first are covered by that stretch. This is settled on the bytes.

Groups over `most` and anchors that a sample shows to be hot are divided by whole stretches instead:
each stretch claims to repeat the first one of its hash. Map tasks combine equal rows before any shuffle.

A claim is a hash's word, so nothing goes on it alone. Claims of a document that continue each other are
joined, the bytes that they point to are fetched, and a document compares them with its own before it
removes anything. If one claim fails, two strings have collided; the whole job is then done
again with other random hashes, until all claims hold.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, cut, parallelism, tidy
from .suffix_sort import sort_groups

PIECE = 1 << 19  # bytes that are hashed at once; places fit 20 bits
FLUSH = 250_000  # anchors that a map task combines at once
PART = 1 << 15  # bytes that a claim has at most when it is verified
WHOLE, STRETCH, COVER = 0, 1, 2  # kinds of rows: an anchor, a stretch by itself, a claimed interval
PRIME = np.int64((1 << 31) - 1)


def fold(v: np.ndarray) -> np.ndarray:
    """v modulo PRIME, but for a few multiples of it."""
    return (v & PRIME) + (v >> 31)


class Rolling:
    """Two polynomial hashes modulo the prime 2 ** 31 - 1, with random bases and byte values, side by side."""

    def __init__(self, n: int, seed: int = 0, bits: int = 62):
        rng = np.random.default_rng([77, seed])
        self.keep = np.uint64((1 << bits) - 1)
        self.spread, self.up, self.down = [], [], []
        for _ in range(2):
            base = int(rng.integers(1 << 20, PRIME - 1))
            self.spread.append(rng.integers(1, PRIME, 256))
            self.up.append(self._powers(base, n))
            self.down.append(self._powers(pow(base, -1, int(PRIME)), n))

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.ones(1, np.int64)
        while len(out) <= n:
            out = np.concatenate([out, out * np.int64(pow(base, len(out), int(PRIME))) % PRIME])
        return out[: n + 1]

    def prefixes(self, x: np.ndarray) -> list[np.ndarray]:
        out = []
        for spread, up in zip(self.spread, self.up, strict=True):
            sums = np.zeros(len(x) + 1, np.int64)
            np.cumsum(fold(spread[x] * up[: len(x)]), out=sums[1:])
            out.append(sums)
        return out

    def of(self, prefixes: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The hashes of the strings from a to b."""
        one, two = (fold(fold(fold(p[b] - p[a]) * down[a])) for p, down in zip(prefixes, self.down, strict=True))
        one[one >= PRIME] -= PRIME
        two[two >= PRIME] -= PRIME
        return self.mixed((one << 31 | two).view(np.uint64))

    def mixed(self, h: np.ndarray) -> np.ndarray:
        return scramble(h) & self.keep


def scramble(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


_rolling: dict[tuple[int, int], Rolling] = {}


def rolling(seed: int, bits: int) -> Rolling:
    if (seed, bits) not in _rolling:
        _rolling.clear()
        _rolling[seed, bits] = Rolling(PIECE + 1, seed, bits)
    return _rolling[seed, bits]


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours, by running minima from both ends of blocks of w."""
    n = len(v) - w + 1
    padded = np.concatenate([v, np.full(-len(v) % w, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def anchors(r: Rolling, x: np.ndarray, ends: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """x: bytes of several texts, at most PIECE; ends: for each byte, where its text ends. Places of stretches, of their anchors, and the prefix hashes."""
    p = r.prefixes(x)
    if len(x) < length:
        return np.empty(0, np.int64), np.empty(0, np.int64), p
    i = np.arange(len(x) - k + 1)
    h = r.of(p, i, i + k) >> np.uint64(20) << np.uint64(20) | i.astype(np.uint64)
    least = sliding_min(h, length - k + 1)
    stretch = np.flatnonzero(np.arange(len(least)) + length <= ends[: len(least)])
    return stretch, (least[stretch] & np.uint64(PIECE - 1)).astype(np.int64), p


def _pieces(texts: Iterator[tuple[int, bytes]], length: int) -> Iterator[tuple[list[tuple[int, int, int]], list[bytes]]]:
    """Texts together up to PIECE bytes, each with its key, place in the whole text and the whole's size; longer ones in parts that overlap by a stretch and the context around it."""
    heads: list[tuple[int, int, int]] = []
    parts: list[bytes] = []
    n = 0
    for doc, text in texts:
        if len(text) < length:
            continue
        for at in range(0, max(1, len(text) - 3 * length), PIECE - 3 * length):
            part = text[at : at + PIECE]
            if n + len(part) > PIECE:
                yield heads, parts
                heads, parts, n = [], [], 0
            heads.append((doc, at, len(text)))
            parts.append(part)
            n += len(part)
    if parts:
        yield heads, parts


ROWS = "h long, c long, doc long, place long, kind byte, src long, at long"
ROW_SCHEMA = pa.schema([("h", pa.int64()), ("c", pa.int64()), ("doc", pa.int64()), ("place", pa.int64()), ("kind", pa.int8()), ("src", pa.int64()), ("at", pa.int64())])


def _batch(h: np.ndarray, c: np.ndarray, doc: np.ndarray, place: np.ndarray, kind: np.ndarray | int, src: np.ndarray | None = None, at: np.ndarray | None = None) -> pa.RecordBatch:
    kind, zero = kind if isinstance(kind, np.ndarray) else np.full(len(doc), kind), np.zeros(len(doc), np.int64)
    return pa.record_batch([pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), pa.array(doc), pa.array(place), pa.array(kind.astype(np.int8)), pa.array(zero if src is None else src), pa.array(zero if at is None else at)], schema=ROW_SCHEMA)


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it."""
    out = np.ones(len(keys[0]), bool)
    out[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return out


def _interval(place: np.ndarray, kind: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """What a row covers: place is start * 256 for a stretch, and otherwise that of an anchor * 256 + the bytes of context after it."""
    at, after = place >> 8, place & 255
    side = length - k
    return np.where(kind == STRETCH, at, np.maximum(0, at - side)), np.where(kind == STRETCH, at + length, at + k + after)


def _claimed(doc: np.ndarray, place: np.ndarray, kind: np.ndarray, head_doc: np.ndarray, head_place: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """doc, start, end, src, at: what rows claim to repeat of the heads of their groups."""
    start, end = _interval(place, kind, length, k)
    ok = end - start >= length
    return tuple(v[ok] for v in (doc, start, end, head_doc, start - (place >> 8) + (head_place >> 8)))


def joined(doc: np.ndarray, start: np.ndarray, end: np.ndarray, src: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Claims with those joined that touch and point to one source at one distance."""
    if not len(doc):
        return doc, start, end, src, at
    order = np.lexsort([start, start - at, src, doc])
    doc, start, end, src, at = (v[order] for v in (doc, start, end, src, at))
    fresh = _runs(doc, src, start - at)
    reach = np.maximum.accumulate(np.cumsum(fresh) << 38 | end)
    fresh[1:] |= start[1:] > (reach[:-1] & ((1 << 38) - 1))
    first = np.flatnonzero(fresh)
    return doc[first], start[first], np.maximum.reduceat(end, first), src[first], at[first]


def _combine(rows: list[np.ndarray], length: int, k: int) -> Iterator[pa.RecordBatch]:
    """Equal rows met in one task before the shuffle: the first stays, the others become claims on it."""
    h, c, doc, place, kind = rows
    order = np.lexsort([place, doc, c, h])
    h, c, doc, place, kind = (a[order] for a in (h, c, doc, place, kind))
    first = _runs(h, c)
    head = np.flatnonzero(first)[np.cumsum(first) - 1]
    again = (doc == doc[head]) & (place == place[head])
    rest = ~again
    own, start, end, src, at = joined(*_claimed(doc[rest], place[rest], kind[rest], doc[head[rest]], place[head[rest]], length, k))
    yield _batch(scramble(own.view(np.uint64)), end, own, start, COVER, src, at)
    yield _batch(h[first], c[first], doc[first], place[first], kind[first])


def _stretch_rows(r: Rolling, p: list[np.ndarray], anchor_hash: np.ndarray, stretch: np.ndarray, offset: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The two keys of stretches: their hash, and their anchor's with its place in them."""
    return r.of(p, stretch, stretch + length), r.mixed(anchor_hash + np.uint64(0x94D049BB133111EB) * offset.astype(np.uint64))


def _find(batches: Iterator[pa.RecordBatch], length: int, k: int, hot: np.ndarray, only_hashes: bool, hashing: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """batches: doc, text. Rows of ROWS, combined; or just the anchors' hashes."""
    side, held, n, r = length - k, [], 0, rolling(*hashing)
    texts = ((doc, text) for batch in batches for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
    for heads, parts in _pieces(texts, length):
        x = np.frombuffer(b"".join(parts), np.uint8)
        lengths = np.array([len(t) for t in parts])
        part_end = np.cumsum(lengths)
        part_start = part_end - lengths
        stretch, at, p = anchors(r, x, np.repeat(part_end, lengths), length, k)
        own = np.searchsorted(part_end, np.unique(at), "right")
        at_all, at = at, np.unique(at)
        h = r.of(p, at, at + k)
        if only_hashes:
            yield pa.record_batch([pa.array(h.view(np.int64))], ["h"])
            continue
        doc, shift, size = (np.array(v, np.int64) for v in zip(*heads, strict=True))
        pos = at - part_start[own] + shift[own]
        a = at - np.minimum(side, pos)
        b = at + k + np.minimum(side, size[own] - pos - k)
        whole = (a >= part_start[own]) & (b <= part_end[own])  # else the overlapping part has it whole
        is_hot = np.isin(h, hot) if len(hot) else np.zeros(len(h), bool)
        take = whole & ~is_hot
        rest = b - at - k
        c = r.mixed(r.of(p, a[take], b[take]) + np.uint64(0x94D049BB133111EB) * ((at - a)[take] * 256 + rest[take]).astype(np.uint64))
        held.append([h[take], c, doc[own[take]], pos[take] * 256 + rest[take], np.full(take.sum(), WHOLE)])
        if is_hot.any():
            of = np.searchsorted(at, at_all)
            s = is_hot[of]
            st, an = stretch[s], of[s]
            one, two = _stretch_rows(r, p, h[an], st, at[an] - st, length)
            o = own[an]
            held.append([one, two, doc[o], (st - part_start[o] + shift[o]) * 256, np.full(len(st), STRETCH)])
        n += len(held[-1][0]) + int(take.sum())
        if n >= FLUSH:
            yield from _combine([np.concatenate(v) for v in zip(*held, strict=True)], length, k)
            held, n = [], 0
    if held:
        yield from _combine([np.concatenate(v) for v in zip(*held, strict=True)], length, k)


FOUND = "doc long, start long, end long, h long, src long, at long"
FOUND_SCHEMA = pa.schema([("doc", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("h", pa.int64()), ("src", pa.int64()), ("at", pa.int64())])


def _claims_of(doc: np.ndarray, start: np.ndarray, end: np.ndarray, src: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(doc), pa.array(start), pa.array(end), pa.nulls(len(doc), pa.int64()), pa.array(src), pa.array(at)], schema=FOUND_SCHEMA)


def _firsts(doc: np.ndarray, place: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
    zero = pa.array(np.zeros(len(doc), np.int64))
    return pa.record_batch([pa.array(doc), pa.array(place), zero, pa.array(h), zero, zero], schema=FOUND_SCHEMA)


def _meet(batches: Iterator[pa.RecordBatch], length: int, k: int) -> Iterator[pa.RecordBatch]:
    """batches: ROWS by h, c, doc, place. Claims; and (doc, place, 0, h) of first anchors of contexts, where an anchor has several."""
    head: tuple | None = None  # h, c, doc, place, kind of the first row of the group that goes on
    pending: tuple | None = None  # doc, place, h of the first context of an h, until a second one comes
    for batch in batches:
        h, c, doc, place, kind, src, at = (batch.column(i).to_numpy() for i in range(7))
        cover = kind == COVER
        if cover.any():
            yield _claims_of(doc[cover], place[cover], c[cover], src[cover], at[cover])
        h, c, doc, place, kind = (a[~cover] for a in (h, c, doc, place, kind))
        if not len(h):
            continue
        if head is not None:
            h, c, doc, place, kind = (np.concatenate([[v], a]) for v, a in zip(head, (h, c, doc, place, kind), strict=True))
        new_h, new_c = _runs(h), _runs(h, c)
        heads = np.flatnonzero(new_c)
        of = heads[np.cumsum(new_c) - 1]
        rest = (doc != doc[of]) | (place != place[of])
        yield _claims_of(*_claimed(doc[rest], place[rest], kind[rest], doc[of[rest]], place[of[rest]], length, k))
        # contexts whose h has another one
        follows = ~new_h[heads]  # not the first context of their h
        need = follows.copy()
        need[:-1] |= follows[1:]  # and the one before it
        need &= kind[heads] == WHOLE
        if head is not None:  # heads[0] is the one that went on
            if pending is not None and len(heads) > 1 and follows[1]:
                yield _firsts(*(np.array([v]) for v in pending))
                pending = None
            need[0] = False  # it has been sent, or just now, or nothing calls for it
        yield _firsts(doc[heads][need], place[heads][need], h[heads][need])
        if head is None or len(heads) > 1:
            pending = None if need[-1] or kind[heads[-1]] != WHOLE else (doc[heads[-1]], place[heads[-1]], h[heads[-1]])
        head = tuple(a[heads[-1]] for a in (h, c, doc, place, kind))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    z = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        for i in range(0, batch.num_rows, 1000):
            part = batch.slice(i, 1000)
            yield pa.record_batch([part.column(0), part.column(1), pa.array([z.compress(t) for t in part.column(2).to_pylist()], pa.binary())], ["doc", "id", "packed"])


CONTEXTS = "h long, doc long, pos long, before binary, after binary"


def _documents(batches: Iterator[pa.RecordBatch], columns: tuple[int, ...]) -> Iterator[tuple[int, list, tuple]]:
    """batches: doc first, then packed, then others, by doc. Of each doc: its rows with text, and its other rows as arrays of `columns`."""
    z, now, texts, rows = zstandard.ZstdDecompressor(), None, [], []
    for batch in batches:
        doc = batch.column(0).to_numpy()
        edges = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])).tolist() if len(doc) else []
        values = [batch.column(i).to_numpy(zero_copy_only=False) for i in columns]
        packed = batch.column(1)
        is_text = np.asarray(packed.is_valid())
        for a, b in zip(edges, [*edges[1:], len(doc)], strict=True):
            if now is not None and doc[a] != now:
                yield now, texts, tuple(np.concatenate(v) for v in zip(*rows, strict=True)) if rows else ()
                texts, rows = [], []
            now = doc[a]
            if is_text[a:b].any():
                texts += [(batch.column(2)[i].as_py(), z.decompress(packed[i].as_py())) for i in range(a, b) if is_text[i]]
            if not is_text[a:b].all():
                rows.append([v[a:b][~is_text[a:b]] for v in values])
    if now is not None:
        yield now, texts, tuple(np.concatenate(v) for v in zip(*rows, strict=True)) if rows else ()


def _contexts(batches: Iterator[pa.RecordBatch], length: int, k: int) -> Iterator[pa.RecordBatch]:
    side, out = length - k, []

    def flush() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [()] * 5
        return pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["h", "doc", "pos", "before", "after"])

    for doc, texts, rows in _documents(batches, (3, 5)):
        if not rows or not texts:
            continue
        for text in dict.fromkeys(t for _, t in texts):
            for place, h in zip(rows[0].tolist(), rows[1].tolist(), strict=True):
                pos = place >> 8
                out.append((h, doc, pos, text[max(0, pos - side) : pos][::-1], text[pos : pos + k + side]))
        if len(out) > 20_000:
            yield flush()
            out = []
    yield flush()


def resolve(group: np.ndarray, doc: np.ndarray, pos: np.ndarray, before: list[bytes], after: list[bytes], length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The covered interval of each anchor that has one: its index, start and end. group: sorted; before: backwards; after: from the anchor's first byte on."""
    side, n = length - k, len(group)
    la, ra = np.array([len(b) for b in before], np.int64), np.array([len(b) for b in after], np.int64)
    matrix = lambda rows, width: np.frombuffer(b"".join(r.ljust(width, b"\0") for r in rows), np.uint8).reshape(n, width)
    sorted_ = [sort_groups(matrix(rows, width), sizes, group) for rows, sizes, width in ((before, la, side), (after, ra, length))]
    age = np.lexsort([pos, doc])
    most, least = np.full(n, -1), np.full(n, length)
    for left in range(side + 1):
        classes = []
        for (order, lcp), need in zip(sorted_, (left, length - left), strict=True):
            own = np.empty(n, np.int64)
            own[order] = np.cumsum(lcp < need)
            classes.append(own)
        fit = age[(la[age] >= left) & (ra[age] >= length - left)]
        key = classes[0][fit] * np.int64(n + 1) + classes[1][fit]
        order = np.argsort(key, kind="stable")
        again = fit[order[1:]][key[order[1:]] == key[order[:-1]]] if len(fit) else fit
        most[again], least[again] = np.maximum(most[again], left), np.minimum(least[again], left)
    at = np.flatnonzero(most >= 0)
    return at, pos[at] - most[at], pos[at] - least[at] + length


def _resolve(batches: Iterator[pa.RecordBatch], length: int, k: int, most: int, hashing: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """batches: CONTEXTS by h. Covered intervals as ROWS of kind COVER (start in place, end in c), and STRETCH rows of groups over `most`."""
    side, held, over = length - k, [[] for _ in range(5)], None

    def stretches(rows: list[list]) -> Iterator[pa.RecordBatch]:
        r = rolling(*hashing)
        for i in range(0, len(rows[0]), 2000):
            h, doc, pos, before, after = (v[i : i + 2000] for v in rows)
            parts = [b[::-1] + a for b, a in zip(before, after, strict=True)]
            p = r.prefixes(np.frombuffer(b"".join(parts), np.uint8))
            sizes, la = np.array([len(t) for t in parts]), np.array([len(b) for b in before])
            starts = np.cumsum(sizes) - sizes
            own, left = (v.ravel() for v in np.meshgrid(np.arange(len(parts)), np.arange(side + 1), indexing="ij"))
            ok = (left <= la[own]) & (length - left <= sizes[own] - la[own])
            own, left = own[ok], left[ok]
            one, two = _stretch_rows(r, p, np.array(h, np.int64).view(np.uint64)[own], starts[own] + la[own] - left, left, length)
            yield _batch(one, two, np.array(doc, np.int64)[own], (np.array(pos, np.int64)[own] - left) * 256, STRETCH)

    def settle(rows: list[list]) -> Iterator[pa.RecordBatch]:
        if rows[0]:
            doc = np.array(rows[1])
            at, start, end = resolve(np.array(rows[0]), doc, np.array(rows[2]), rows[3], rows[4], length, k)
            yield _batch(scramble(doc[at].view(np.uint64)), end, doc[at], start, COVER)

    for batch in batches:
        new = [batch.column(i).to_pylist() for i in range(5)]
        if over is not None:
            stop = next((i for i, h in enumerate(new[0]) if h != over), len(new[0]))
            yield from stretches([r[:stop] for r in new])
            new, over = [r[stop:] for r in new], over if stop == len(new[0]) else None
        for r, more in zip(held, new, strict=True):
            r += more
        if len(held[0]) >= 20_000:
            last = held[0][-1]
            cut_at = int(np.searchsorted(np.array(held[0]), last))  # sorted by h as signed numbers
            yield from settle([r[:cut_at] for r in held])
            held = [r[cut_at:] for r in held]
            if len(held[0]) > most:
                yield from stretches(held)
                held, over = [[] for _ in range(5)], last
    yield from settle(held)


CLAIMS = "doc long, start long, n long, src long, at long"


def _settle_claims(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """batches: doc, start, end, src, at by doc. As few bytes of claims as cover the same, each of `length` at least, in parts of PART at most."""

    def done(rows: list[np.ndarray]) -> pa.RecordBatch:
        doc, start, end, src, at = joined(*rows)
        order = np.lexsort([-end, start, doc])
        doc, start, end, src, at = (v[order] for v in (doc, start, end, src, at))
        same = ~_runs(doc)
        reach = np.maximum.accumulate(np.cumsum(~same) << 38 | end) & ((1 << 38) - 1) if len(doc) else end
        covered = np.zeros(len(doc), np.int64)
        covered[1:] = np.where(same[1:], reach[:-1], 0)  # up to here by claims before
        fresh = np.maximum(start, np.minimum(covered, end - length))
        keep = end > covered
        doc, start, end, src, at, fresh = (v[keep] for v in (doc, start, end, src, at, fresh))
        at, size = at + fresh - start, end - fresh
        parts = -(-size // PART)
        of = np.repeat(np.arange(len(doc)), parts)
        skip = PART * (np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts))
        cols = (doc[of], fresh[of] + skip, np.minimum(PART, size[of] - skip), src[of], at[of] + skip)
        return pa.record_batch([pa.array(c) for c in cols], ["doc", "start", "n", "src", "at"])

    held = [np.empty(0, np.int64)] * 5
    for batch in batches:
        held = [np.concatenate([h, batch.column(i).to_numpy()]) for i, h in enumerate(held)]
        if len(held[0]) and held[0][0] != held[0][-1]:
            stop = int(np.flatnonzero(held[0] != held[0][-1])[-1]) + 1
            yield done([h[:stop] for h in held])
            held = [h[stop:] for h in held]
    yield done(held)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes at each requested place. Rows that share an id give theirs each."""
    names, out, size = ["src", "at", "n", "data"], [], 0

    def flush() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [()] * 4
        return pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names)

    for doc, texts, rows in _documents(batches, (3, 4)):
        for text in dict.fromkeys(t for _, t in texts) if rows else ():
            for at, n in zip(rows[0].tolist(), rows[1].tolist(), strict=True):
                if at + n <= len(text):
                    out.append((doc, at, n, text[at : at + n]))
                    size += n + 100
                    if size > 4_000_000:
                        yield flush()
                        out, size = [], 0
    yield flush()


OUT = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, failed long"


def _remove(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    """batches: doc, packed, id, start, end, data by doc. A row with data is a claim; its bytes are compared with the text's first."""
    out = []

    def flush() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [()] * 7
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int64())
        return pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [c.split()[0] for c in OUT.split(", ")])

    for _, texts, rows in _documents(batches, (3, 4, 5)):
        spans: list[list[int]] = []
        failed: set[tuple[int, int]] = set()
        if rows:
            start, end, data = (v.tolist() for v in rows)
            holds = [d is None or any(t[a:b] == d for _, t in texts) for a, b, d in zip(start, end, data, strict=True)]
            good = {(a, b) for a, b, ok in zip(start, end, holds, strict=True) if ok}
            failed = {(a, b) for a, b, ok in zip(start, end, holds, strict=True) if not ok} - good
            for a, b in sorted(good):
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], b)
                else:
                    spans.append([a, b])
        for doc_id, text in texts:
            own = [(a, min(b, len(text))) for a, b in spans if a < len(text)]
            kept = b"".join(text[a:b] for a, b in zip([0, *[b for _, b in own]], [*[a for a, _ in own], len(text)], strict=True))
            out.append((doc_id, len(text), len(text) - len(kept), len(own), hashlib.sha256(kept).hexdigest(), kept if with_text else None, len(failed)))
        if len(out) >= 500:
            yield flush()
            out = []
    yield flush()


def remove_repeats(
    docs: DataFrame, length: int = 100, k: int = 32, most: int = 50_000, with_text: bool = False, sample: int = 64, hot_least: int = 16, hot_parts: int = 20_000, bits: Sequence[int] = (62,), attempts: int = 8, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of docs: id_col, n_bytes, n_removed, n_spans, kept_sha256; with_text adds the bytes kept.

    Bytes go that are covered by a string of `length` bytes which also starts earlier: in a document of a smaller
    id, or before in the same one. Cases: a null text is empty; null ids come before all others, in the order of a hash
    of their text; rows that share an id but not a text are documents of their own, in the order of a hash of their text; rows that
    repeat id and text share one verdict; an empty table gives no rows; other columns are not read.
    Anchors are hot that one in `hot_parts` of a sample (one document in `sample`) is, and hot_least at least; which ones
    are changes the work, not the result. bits: of the hashes in each attempt (the last one goes for all that follow). After
    `attempts` with a collision it is an error.
    """
    base = _documents_of(docs, id_col, text_col)
    for attempt in range(attempts):
        hashing = (attempt, bits[min(attempt, len(bits) - 1)])
        out = _attempt(base, length, k, most, with_text, sample, hot_least, hot_parts, hashing)
        failed = out.rows.filter("failed > 0").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).first()
        if not failed.n:
            return out.rows.select(F.col("id").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text)
        out.scratch.clear()
    raise ValueError(f"equal hashes of unequal strings in each of {attempts} attempts, last in {failed.n} documents, of which {failed.id} is the first")


def _documents_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, id, text (bytes): doc orders documents as ids do, and tells rows apart that share an id but not a text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    again = rows.filter("id IS NOT NULL").groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id")
    again = cut(again)
    key = lambda n: F.coalesce(n, F.xxhash64("text").bitwiseOR(F.lit(-(1 << 63)).cast("long")))
    as_bytes = F.col("text").cast("binary").alias("text")
    if again.isEmpty():
        return rows.select(key(F.col("id")).alias("doc"), "id", as_bytes)
    tags = rows.join(again, "id", "left_semi").select("id", F.xxhash64("text").alias("tag")).distinct()
    places = cut(tags.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("tag")) - 1))  # narrow rows of ids that repeat
    bits = int(places.agg(F.max("place")).first()[0]).bit_length()
    least, most = rows.agg(F.min("id"), F.max("id")).first()
    if max(-least, most) >> (62 - bits):
        raise ValueError(f"ids of up to {max(-least, most)} leave no room to tell apart rows that share one")
    placed = rows.withColumn("tag", F.xxhash64("text")).join(places, ["id", "tag"], "left")
    return placed.select(key(F.shiftleft("id", bits) + F.coalesce("place", F.lit(0))).alias("doc"), "id", as_bytes)


class Attempt(NamedTuple):
    rows: DataFrame
    scratch: Scratch


def _attempt(base: DataFrame, length: int, k: int, most: int, with_text: bool, sample: int, hot_least: int, hot_parts: int, hashing: tuple[int, int]) -> Attempt:
    """Rows of OUT; failed counts a document's claims that didn't hold. base: doc, id, text."""
    spark = base.sparkSession
    scratch, result = Scratch(spark, "substrings"), Scratch(spark, "removed")
    parts = parallelism(spark)

    counts = base.filter(F.pmod(F.xxhash64("doc"), F.lit(sample)) == 0).select("doc", "text").mapInArrow(lambda b: tidy(_find(b, length, k, np.empty(0, np.uint64), True, hashing)), "h long").groupBy("h").count()
    counts = cut(counts)
    often = max(hot_least, (counts.agg(F.sum("count")).first()[0] or 0) // hot_parts)  # at most hot_parts hashes
    hot = np.array([r.h for r in counts.filter(F.col("count") >= often).collect()], np.int64).view(np.uint64)

    def meet(rows: DataFrame) -> DataFrame:
        return rows.repartition(parts, "h").sortWithinPartitions("h", "c", "doc", "place").mapInArrow(lambda b: tidy(_meet(b, length, k)), FOUND)

    found = scratch.keep(meet(base.select("doc", "text").mapInArrow(lambda b: tidy(_find(b, length, k, hot, False, hashing)), ROWS)), "anchors")
    packed = base.mapInArrow(lambda b: tidy(_pack(b)), "doc long, id long, packed binary")

    def by_doc(rows: DataFrame) -> DataFrame:
        """rows: doc and others, beside the texts: doc, packed, id, then the others."""
        others = [(c, t) for c, t in rows.dtypes if c != "doc"]
        texts = packed.select("doc", "packed", "id", *[(F.lit(None) if t == "binary" else F.lit(0)).cast(t).alias(c) for c, t in others])
        own = rows.select("doc", F.lit(None).cast("binary").alias("packed"), F.lit(None).cast("long").alias("id"), *[c for c, _ in others])
        return texts.unionByName(own).repartition(parts, "doc").sortWithinPartitions("doc")

    contexts = by_doc(found.filter("h IS NOT NULL").select("doc", "start", "end", "h")).mapInArrow(lambda b: tidy(_contexts(b, length, k)), CONTEXTS)
    resolved = scratch.keep(contexts.repartition(parts, "h").sortWithinPartitions("h").mapInArrow(lambda b: tidy(_resolve(b, length, k, most, hashing)), ROWS), "resolved")
    claims = found.filter("h IS NULL")
    if not resolved.filter(F.col("kind") == STRETCH).isEmpty():
        claims = claims.unionByName(meet(resolved.filter(F.col("kind") == STRETCH)).filter("h IS NULL"))
    claims = claims.select("doc", "start", "end", "src", "at").repartition(parts, "doc").sortWithinPartitions("doc").mapInArrow(lambda b: tidy(_settle_claims(b, length)), CLAIMS)
    claims = scratch.keep(claims, "claims")
    wanted = claims.select(F.col("src").alias("doc"), "at", "n").distinct()
    slices = by_doc(wanted).mapInArrow(lambda b: tidy(_slices(b)), "src long, at long, n long, data binary")
    fetched = claims.join(slices, ["src", "at", "n"]).select("doc", "start", (F.col("start") + F.col("n")).alias("end"), "data")
    sorted_out = resolved.filter(F.col("kind") == COVER).select("doc", F.col("place").alias("start"), F.col("c").alias("end"), F.lit(None).cast("binary").alias("data"))
    out = result.keep(by_doc(fetched.unionByName(sorted_out)).mapInArrow(lambda b: tidy(_remove(b, with_text)), OUT), "rows")
    scratch.clear()
    return Attempt(out, result)
