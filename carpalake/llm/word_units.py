"""Token ids of a word-level tokenizer by words, most of which have been seen before.

A tokenizer that takes whitespace out before it looks for tokens never lets a token cross a space, so each word of a text
is encoded once. Words are found by a 64-bit hash and compared byte by byte on every hit. Whether texts may be cut is read from the
tokenizer's own description; one that normalizes or cuts in another way encodes whole texts.
"""

from __future__ import annotations

import json

import numpy as np

from .byte_units import UnitCache

CACHE_WORDS = 500_000  # some 40 MB; more would save encoding rare words again, but two workers share an executor's memory
#: Patterns of tokens that match no whitespace and look at nothing around a match.
TOKENS = {r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}
MARK = "\x01"  # a token of its own, put between words that are encoded in one call
_caches: dict[str, WordCache] = {}


def _parts(step: dict | None, inner: str) -> list[dict]:
    return [] if not step else step[inner] if step["type"] == "Sequence" else [step]


def lowers(description: dict) -> bool:
    """Whether texts are lower-cased before they are cut."""
    return any(n["type"] == "Lowercase" for n in _parts(description.get("normalizer"), "normalizers"))


def by_words(description: dict) -> bool:
    """Whether a tokenizer with this description (its JSON) encodes the words of a text one by one."""
    if description.get("truncation") or description.get("padding") or description["model"].get("type") != "BPE" or description["model"].get("dropout"):
        return False
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or not t["content"] or set(t["content"]) & set(" \t\n\v\f\r") for t in description["added_tokens"]):
        return False
    for n in _parts(description.get("normalizer"), "normalizers"):
        spaces = n["type"] == "Replace" and n["pattern"] == {"Regex": r"\s+"} and n["content"] == " "
        if not spaces and n["type"] not in ("NFC", "Lowercase"):  # neither of which looks across a space
            return False
    cut = _parts(description.get("pre_tokenizer"), "pretokenizers")
    if not cut or cut[0]["type"] != "Split" or cut[0]["pattern"].get("Regex") not in TOKENS or (cut[0]["behavior"], cut[0]["invert"]) != ("Removed", True):
        return False
    return all(c["type"] == "ByteLevel" and not c["add_prefix_space"] and not c.get("use_regex", True) for c in cut[1:])


class WordCache(UnitCache):
    """Token ids of texts. Holds at most `most` words and those of one call; then it starts anew."""

    def __init__(self, path: str, most: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        description = json.loads(self.tokenizer.to_str())
        self.lower, self.added = lowers(description), [t["content"].lower().encode() for t in description["added_tokens"]]
        mark = self.encode([MARK])[0]
        self.whole, self.mark = not by_words(description) or len(mark) != 1, mark[0] if mark else -1
        self.clear()

    def units(self, text: str) -> list[bytes]:
        """The words of a text, lower-cased where that changes no id: composing a letter goes before lower-casing, and added tokens are found before both."""
        x = text.encode()
        if self.lower and x.isascii():
            low = x.lower()
            if not any(a in low for a in self.added):
                x = low
        return x.split()

    def _encoded(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        parts: list[np.ndarray] = []
        sizes = np.zeros(len(keys), np.int64)
        for i in range(0, len(keys), 2000):
            some = [k.decode() for k in keys[i : i + 2000]]
            if any(MARK in w for w in some):
                found = self.encode(some)
                ids, n = np.array([x for f in found for x in f], "<u4"), np.array([len(f) for f in found])
            else:
                ids = np.array(self.encode([f" {MARK} ".join(some)])[0], "<u4")
                ends = np.append(np.flatnonzero(ids == self.mark), len(ids))
                ids, n = ids[ids != self.mark], np.diff(ends, prepend=-1) - 1
            parts.append(ids)
            sizes[i : i + len(some)] = n
        return np.concatenate(parts) if parts else np.empty(0, "<u4"), sizes


def word_cache(path: str) -> WordCache:
    """The cache of this Python worker."""
    if path not in _caches:
        _caches[path] = WordCache(path)
    return _caches[path]
