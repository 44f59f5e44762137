"""Ids by words against ids of whole texts."""

import copy
import json
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from carpalake.llm import byte_units
from carpalake.llm.queries import word_tokenizer
from carpalake.llm.word_units import WordCache, by_words, lowers

TEXTS = [
    "", " ", "\n\n\t", "The CAT  sat\n\non the\tMat. ", " Don't\r\nX  y\x0bz\x0cw", "É é É 中文 ÜBER\xa01 000 x\x85y",
    "H̱ T̈ W̊ Y̊ J̌ ẖ", "İ İ ΟΔΟΣ Σ ς", "a <|ENDOFTEXT|> B<|endoftext|>C <|startoftext|>", "one \x01 mark\x01 \x01\x01 x",
    "word ́accent ́", "123 4a5 ½ x² don'T WE'LL 's", "\x00 nul ​ zero ﻿", "x" * 5000 + " Y" * 3000,
]


@pytest.fixture(scope="module")
def description():
    with open(word_tokenizer()) as f:
        return json.load(f)


def same(cache, texts):
    t = Tokenizer.from_file(word_tokenizer())
    for text, ids in zip(texts, cache.of(texts), strict=True):
        assert ids.tolist() == t.encode(text, add_special_tokens=False).ids, repr(text[:50])


def test_words_give_the_ids_of_whole_texts():
    cache = WordCache(word_tokenizer())
    assert not cache.whole and cache.lower and cache.of([]) == []
    for _ in range(2):
        same(cache, TEXTS)
    for text in TEXTS:
        same(WordCache(word_tokenizer()), [text])
    r = random.Random(1)
    alphabet = "aAbB ßéÉ̱́̌HJTW  \n\t'sdl.,!?<|>09中İΣ"
    same(cache, ["".join(r.choice(alphabet) for _ in range(r.randrange(60))) for _ in range(3000)])
    edges = ["a", "Z", "7", "'s", "'", ".", "é", "É", "́", "\x00", "中", "Σ", "İ", "İ1", "½", "_", "\ufeff", "<|", "|>"]
    same(WordCache(word_tokenizer()), [f"{a}{m}{b} {c}" for a in edges for b in edges for m in ("", "x", "Σ") for c in (a, b)])  # new words side by side, with all kinds of edges
    cache = WordCache(word_tokenizer(), most=50)  # starts anew with nearly every call
    for i in range(0, 200, 20):
        same(cache, [f"w{j} Word {j * 7919}" for j in range(i, i + 40)])


@pytest.mark.parametrize("bits", [0, 3])
def test_words_whose_hashes_collide_are_told_apart(monkeypatch, bits):
    of = byte_units.xxh64_intdigest
    monkeypatch.setattr(byte_units, "xxh64_intdigest", lambda x: of(x) & ((1 << bits) - 1))
    cache = WordCache(word_tokenizer())
    for _ in range(2):
        same(cache, TEXTS)


def test_only_what_the_description_allows_is_cut(description):
    small = {k: v for k, v in description.items() if k != "model"} | {"model": {k: v for k, v in description["model"].items() if k not in ("vocab", "merges")}}
    assert by_words(small) and lowers(small)

    def changed(f):
        d = copy.deepcopy(small)
        f(d)
        return d

    for f in (
        lambda d: d["pre_tokenizer"]["pretokenizers"][0]["pattern"].update(Regex=r"\s?\w+"),
        lambda d: d["pre_tokenizer"]["pretokenizers"][0].update(behavior="Isolated"),
        lambda d: d["pre_tokenizer"]["pretokenizers"][1].update(add_prefix_space=True),
        lambda d: d["pre_tokenizer"]["pretokenizers"][1].update(use_regex=True),
        lambda d: d["pre_tokenizer"]["pretokenizers"].pop(0),
        lambda d: d.update(pre_tokenizer=None),
        lambda d: d["normalizer"]["normalizers"].append({"type": "Strip", "strip_left": True, "strip_right": True}),
        lambda d: d["normalizer"]["normalizers"][1].update(content="_"),
        lambda d: d["added_tokens"][0].update(lstrip=True),
        lambda d: d["added_tokens"][0].update(content="two words"),
        lambda d: d["model"].update(dropout=0.1),
        lambda d: d["model"].update(type="Unigram"),
        lambda d: d.update(truncation={"max_length": 5}),
    ):
        assert not by_words(changed(f))
    assert not lowers(changed(lambda d: d["normalizer"]["normalizers"].pop()))


def test_the_old_rule_is_not_kept():
    """H with a line below has no composed form, h has one: lower-casing first would change the ids."""
    cache = WordCache(word_tokenizer())
    a, b = cache.of(["H̱", "ẖ"])
    assert not np.array_equal(a, b)
