import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from carpalake.llm.best_fit import CapacityTree, pack_best_fit, plan
from carpalake.llm.byte_units import SPACES, UnitCache, by_units, is_regular
from carpalake.llm.queries import byte_tokenizer, word_tokenizer


def plain_best_fit(lengths, size):
    """Remaining room of each sequence after one piece at a time, and the pieces in it."""
    rooms, held = [], []
    for n in sorted(lengths, reverse=True):
        fit = [i for i, r in enumerate(rooms) if r >= n]
        if fit:
            i = min(fit, key=lambda i: rooms[i])
        else:
            i = len(rooms)
            rooms.append(size)
            held.append([])
        rooms[i] -= n
        held[i].append(n)
    return held


def unrolled(steps):
    held = {}
    for length, _, n, first, each, at in steps:
        for k in range(n):
            held.setdefault(first + k // each, []).append((at + k % each * length, length))
    return held


def test_plan_is_best_fit_decreasing():
    rng = random.Random(5)
    for _ in range(300):
        size = rng.choice([1, 7, 16, 100])
        lengths = [rng.randint(1, size) if rng.random() < 0.7 else rng.randint(1, 1 + size // 8) for _ in range(rng.randrange(200))]
        counts = {n: lengths.count(n) for n in lengths}
        got = unrolled(plan(counts, size))
        assert sorted(got) == list(range(len(got)))
        for pieces in got.values():  # without gaps, and not over the end
            at = 0
            for offset, n in sorted(pieces):
                assert offset == at
                at += n
            assert at <= size
        # which of two equally full sequences takes a piece is open, so what they hold may differ, but not how full they get
        assert sorted(sum(n for _, n in p) for p in got.values()) == sorted(map(sum, plain_best_fit(lengths, size)))


def test_steps_are_few_however_many_the_pieces():
    rng = random.Random(1)
    steps = plan({n: rng.randrange(1, 10**9) for n in range(1, 1025)}, 1024)
    assert len(steps) < 20 * 1024
    assert sum(s[2] for s in steps) > 10**11


def test_capacity_tree():
    rng = random.Random(2)
    tree, plain = CapacityTree(100), []
    for i in range(2000):
        if rng.random() < 0.5 or not plain:
            room = rng.randint(0, 100)
            tree.add(room, i, 3)
            plain.append(room)
        need = rng.randint(0, 100)
        want = min((r for r in plain if r >= need), default=None)
        assert tree.tightest(need) == want
        if want is not None and rng.random() < 0.8:
            assert tree.take(want)[1] == 3
            plain.remove(want)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(byte_tokenizer())


def texts():
    rng = random.Random(3)
    words = ["the", "Don't", "it's", "naïve", "中文字", "3.14", "x_Y", "(a)", "...", "'", "é", "🙂🙂", "\x00", "\x1c", "a" * 300, "foo-bar", "I'll", "<|endoftext|>", "<|end"]
    out = ["", " ", "\n", "a", " a", "a ", "a\n", "\n\na", "a\n\n\nb", "a \n b", "a\tb", "a  b", "a\r\nb", "<|endoftext|>", "x <|endoftext|> y", "a\xa0b", "a　 b", "a \x85b"]
    for _ in range(400):
        spaces = [" "] * 12 + ["\n"] * 3 + rng.choice([[], list(SPACES), ["  ", "\n\n", " \n"]])
        out.append("".join(rng.choice(words) + rng.choice(spaces) for _ in range(rng.randrange(30)))[: rng.choice([-1, None])])
    return out


def test_units_give_the_ids_of_whole_texts(tokenizer):
    cache = UnitCache(byte_tokenizer(), most=50)
    assert not cache.whole and cache.mark == tokenizer.encode("\n\n").ids[0]
    data = texts()
    for i in range(0, len(data), 37):
        some = data[i : i + 37]
        for text, ids in zip(some, cache.of(some)):
            assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
    assert any(map(is_regular, (t.encode() for t in data)))


def test_units_whose_hashes_collide_are_told_apart(tokenizer, monkeypatch):
    monkeypatch.setattr("carpalake.llm.byte_units.xxh64_intdigest", lambda key: len(key) % 3 * 2)
    cache = UnitCache(byte_tokenizer())
    for text, ids in zip(texts(), cache.of(texts())):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_other_tokenizers_encode_whole_texts():
    cache = UnitCache(word_tokenizer())
    assert cache.whole
    plain = Tokenizer.from_file(word_tokenizer())
    assert [x.tolist() for x in cache.of(["The Cat", ""])] == [plain.encode(t, add_special_tokens=False).ids for t in ("The Cat", "")]
    assert not by_units({"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}, "model": {"type": "BPE"}})


def check(rows, data, tokenizer, size):
    ids = {}
    for i, text in data:
        ids.setdefault(i, []).append(np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4"))
    sequences, pieces = {}, {}
    for r in rows:
        assert any(zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in ids[r.doc_id])
        assert 0 < r.length <= size and (r.length == size or r.piece == 0)
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    want = {i: sorted((s, min(size, len(x) - s) if k else (len(x) - 1) % size + 1) for x in xs for k, s in enumerate([0, *range((len(x) - 1) % size + 1, len(x), size)])) for i, xs in ids.items()}
    assert {i: sorted(p) for i, p in pieces.items()} == want
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= size
    assert len(sequences) == len(plain_best_fit([n for p in pieces.values() for _, n in p], size))
    assert sorted(sequences) == list(range(len(sequences)))


@pytest.mark.parametrize("size,parts", [(64, 1), (64, 5), (1024, 3)])
def test_pack(spark, tokenizer, size, parts):
    data = list(enumerate(texts())) + [(1000, None), (None, "null id"), (7, "again"), (7, "again"), (2000, "long text " * 3000)] + [(3000 + i, "") for i in range(100)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in data], "doc_id long, text string, length string, part int").repartition(parts)
    out = pack_best_fit(docs, byte_tokenizer(), size, with_ids=True)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids"]
    rows = out.collect()
    check(rows, data, tokenizer, size)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in rows)


def test_empty_table(spark):
    assert pack_best_fit(spark.createDataFrame([], "doc_id long, text string"), byte_tokenizer()).count() == 0
