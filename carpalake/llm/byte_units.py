"""Token ids of a byte-level tokenizer by units of text, most of which have been seen before.

A tokenizer that cuts texts by the usual byte-level pattern never lets a token cross into a space that a word follows.
So a text is a row of units, each encoded once: a word with the space before it, or with the newline before it where that
newline stands alone. Texts with other runs of whitespace are cut by the pattern's own rule for them.

Units are found by a 64-bit hash and compared byte by byte on every hit. Whether texts may be cut is read from
the tokenizer's own description, not tried out; one that normalizes or cuts in another way encodes whole texts.
"""

from __future__ import annotations

import json
import re

import numpy as np
from xxhash import xxh64_intdigest

from .hash_index import HashIndex

CACHE_UNITS = 2_000_000
#: The characters with the Unicode property White_Space.
SPACES = "\t\n\v\f\r \x85\xa0                　"
UNIT = re.compile(f" ?[^{SPACES}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]")
RARE_ASCII, RARE = b"\t\v\f\r", [c.encode() for c in SPACES if ord(c) > 127]
RAW, MARK = b"\r", "\n\n"  # before a unit that is encoded as it is; between units that are encoded in one call
_caches: dict[str, UnitCache] = {}


def by_units(description: dict) -> bool:
    """Whether a tokenizer with this description (its JSON) encodes the units of a text one by one."""
    cut = description.get("pre_tokenizer") or {}
    plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
    return bool(plain) and not any(description.get(k) for k in ("normalizer", "truncation", "padding")) and description["model"].get("type") == "BPE" and not description["model"].get("dropout")


def is_regular(x: bytes) -> bool:
    """Whether all whitespace of a text is single spaces and newlines between words."""
    return bool(x) and not (
        b"  " in x or b" \n" in x or b"\n" in x and (b"\n\n" in x or b"\n " in x) or x[0] in b" \n" or x[-1] in b" \n"
        or len(x.translate(None, RARE_ASCII)) < len(x) or not x.isascii() and any(c in x for c in RARE)
    )


class UnitCache:
    """Token ids of texts. Holds at most `most` units and those of one call; then it starts anew."""

    def __init__(self, path: str, most: int = CACHE_UNITS):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        description = json.loads(self.tokenizer.to_str())
        self.special = [t["content"] for t in description["added_tokens"]]  # they are found before a text is cut
        mark = self.encode([MARK])[0]
        self.whole, self.mark = not by_units(description) or len(mark) != 1, mark[0] if mark else -1
        self.clear()

    def clear(self) -> None:
        self.index = HashIndex()
        self.ids_used = self.bytes_used = 0
        self.ids, self.id_ends = np.empty(1 << 16, "<u4"), np.zeros(1 << 16, np.int64)
        self.bytes, self.byte_ends = np.empty(1 << 16, np.uint8), np.zeros(1 << 16, np.int64)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def units(self, text: str) -> list[bytes] | None:
        """The keys of a text's units; None for one with a special token in it."""
        x = text.encode()
        if any(s in text for s in self.special):
            return None
        if is_regular(x):
            return (RAW + x).replace(b"\n", b" \n").split(b" ")
        return [RAW + u.encode() for u in UNIT.findall(text)]

    @staticmethod
    def _text(key: bytes) -> str:
        return (key[1:] if key[:1] == RAW else key if key[:1] == b"\n" else b" " + key).decode()

    def _encoded(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of units, and how many each has."""
        parts: list[np.ndarray] = []
        sizes = np.zeros(len(keys), np.int64)
        for i in range(0, len(keys), 2000):
            some = keys[i : i + 2000]
            if any(k[:1] == RAW for k in some):
                found = self.encode([self._text(k) for k in some])
                ids, n = np.array([x for f in found for x in f], "<u4"), np.array([len(f) for f in found])
            else:
                ids = np.array(self.encode([MARK.join(map(self._text, some))])[0], "<u4")
                ends = np.append(np.flatnonzero(ids == self.mark), len(ids))
                ids, n = ids[ids != self.mark], np.diff(ends, prepend=-1) - 1
            parts.append(ids)
            sizes[i : i + len(some)] = n
        return np.concatenate(parts) if parts else np.empty(0, "<u4"), sizes

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        while n > len(a):
            a = np.concatenate([a, np.empty_like(a)])
        return a

    def _learn(self, hashes: np.ndarray, keys: list[bytes]) -> None:
        """Adds units, whose hashes are distinct and new."""
        raw = [k[:1] == RAW for k in keys]
        order = np.argsort(raw, kind="stable")  # those that are encoded by themselves last
        hashes, keys = hashes[order], [keys[i] for i in order.tolist()]
        ids, sizes = self._encoded(keys)
        data, lengths = np.frombuffer(b"".join(keys), np.uint8), np.fromiter(map(len, keys), np.int64, len(keys))
        n = self.index.n
        self.ids, self.bytes = self._room(self.ids, self.ids_used + len(ids)), self._room(self.bytes, self.bytes_used + len(data))
        self.id_ends, self.byte_ends = self._room(self.id_ends, n + len(keys) + 1), self._room(self.byte_ends, n + len(keys) + 1)
        self.ids[self.ids_used : self.ids_used + len(ids)] = ids
        self.bytes[self.bytes_used : self.bytes_used + len(data)] = data
        self.id_ends[n + 1 : n + 1 + len(keys)] = self.ids_used + np.cumsum(sizes)
        self.byte_ends[n + 1 : n + 1 + len(keys)] = self.bytes_used + np.cumsum(lengths)
        self.ids_used, self.bytes_used = self.ids_used + len(ids), self.bytes_used + len(data)
        self.index.add(hashes)

    def _same(self, at: np.ndarray, keys: list[bytes]) -> np.ndarray:
        """Whether the unit at each place is the key, by its bytes."""
        data, lengths = np.frombuffer(b"".join(keys), np.uint8), np.fromiter(map(len, keys), np.int64, len(keys))
        start = np.cumsum(lengths) - lengths
        same = self.byte_ends[at + 1] - self.byte_ends[at] == lengths
        shift = np.repeat(np.where(same, self.byte_ends[at], 0) - start, lengths)
        differ = self.bytes[np.minimum(shift + np.arange(len(data)), len(self.bytes) - 1)] != data
        return same & ~np.logical_or.reduceat(differ, start)

    def of(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if self.whole:
            return [np.array(x, "<u4") for x in self.encode(texts)]
        if self.index.n > self.most:
            self.clear()
        split = [self.units(t) for t in texts]
        keys = [k for s in split if s for k in s]
        found: list[np.ndarray] = []
        if keys:
            h = np.fromiter(map(xxh64_intdigest, keys), np.uint64, len(keys)) | np.uint64(1)
            at = self.index.find(h)
            if len(missed := np.flatnonzero(at < 0)):
                new, first = np.unique(h[missed], return_index=True)
                self._learn(new, [keys[i] for i in missed[first].tolist()])
                at[missed] = self.index.find(h[missed])
            pool, starts, sizes = self.ids, self.id_ends[at], self.id_ends[at + 1] - self.id_ends[at]
            if len(wrong := np.flatnonzero(~self._same(at, keys))):  # another unit has this hash
                ids, n = self._encoded([keys[i] for i in wrong.tolist()])
                pool = np.concatenate([pool[: self.ids_used], ids])
                starts[wrong], sizes[wrong] = self.ids_used + np.cumsum(n) - n, n
            done = np.cumsum(sizes)
            ids = pool[np.repeat(starts - done + sizes, sizes) + np.arange(done[-1])]
            ends = np.concatenate([[0], done])[np.cumsum([len(s or ()) for s in split])]
            found = np.split(ids, ends[:-1])
        else:
            found = [np.empty(0, "<u4")] * len(texts)
        return [np.array(self.encode([t])[0], "<u4") if s is None else f for t, s, f in zip(texts, split, found, strict=True)]


def unit_cache(path: str) -> UnitCache:
    """The cache of this Python worker."""
    if path not in _caches:
        _caches[path] = UnitCache(path)
    return _caches[path]
