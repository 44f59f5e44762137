import hashlib
import random

import numpy as np
import pytest

from carpalake.llm.substring_dedup import remove_repeats, sliding_min
from carpalake.llm.suffix_sort import sort_groups

SCHEMA = "doc_id long, text string, h long, start string"


def test_sort_groups():
    rng = np.random.default_rng(3)
    for n, letters in ((1, 2), (40, 2), (300, 3), (500, 1)):
        rows, sizes = rng.integers(0, letters, (n, 12)).astype(np.uint8), rng.integers(0, 13, n)
        rows[np.arange(12) >= sizes[:, None]] = 0
        group = np.sort(rng.integers(0, 5, n))
        order, lcp = sort_groups(rows, sizes, group)
        keyed = [(group[i], bytes(rows[i, : sizes[i]])) for i in order]
        assert sorted(order.tolist()) == list(range(n)) and keyed == sorted(keyed)
        for (g, a), (f, b), common in zip(keyed, keyed[1:], lcp[1:]):
            assert common == (next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) if g == f else -1)


def test_sliding_min():
    v = np.random.default_rng(0).integers(0, 99, 50).astype(np.uint64)
    for w in (1, 3, 7, 50):
        assert sliding_min(v, w).tolist() == [v[i : i + w].min() for i in range(51 - w)]


def plain(rows, length):
    first, out = {}, []
    docs = sorted({r[0]: (r[1] or "").encode() for r in rows}.items())
    for doc, text in docs:
        gone = np.zeros(len(text), bool)
        for s in range(len(text) - length + 1):
            piece = text[s : s + length]
            if piece in first:
                gone[s : s + length] = True
            else:
                first[piece] = (doc, s)
        kept = bytes(np.frombuffer(text, np.uint8)[~gone])
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((doc, len(text), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    words = ["the", "cat", "über", "sat", "on", "mat", "dog", "ran", "and", "so"]
    shared = [" ".join(rng.choices(words, k=rng.randrange(5, 40))) for _ in range(8)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(0, 6)):
            parts.append(rng.choice(shared) if rng.random() < 0.5 else " ".join(rng.choices(words, k=rng.randrange(1, 60))))
            if rng.random() < 0.3:
                s = parts[-1]
                at = rng.randrange(len(s) + 1)
                parts[-1] = s[:at] + rng.choice("xyz") + s[at + 1 :]
        rows.append((i * 7 % n, "\n".join(parts), i, "x"))
    rows += [(n, None, 1, "x"), (n + 1, "", 1, None), (n + 2, "ab" * 400, 1, "x"), (n + 3, "a" * 500, 1, "x"), (n + 4, rows[5][1], 1, "x"), (n + 5, "q" + "ab" * 90, 1, "x")]
    return rows


@pytest.mark.parametrize("length,k,most,hot", [(100, 32, 50_000, False), (40, 12, 50_000, False), (40, 12, 3, False), (40, 12, 50_000, True)])
def test_against_brute_force(spark, length, k, most, hot):
    rows = corpus()
    every = {"sample": 1, "hot_least": 0, "hot_parts": 10**9} if hot else {}  # each anchor takes the path of hot ones
    got = remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(4), length, k, most, **every).collect()
    assert sorted(map(tuple, got)) == plain(rows, length)


@pytest.mark.parametrize("hot", [False, True])
def test_collisions_change_nothing(spark, hot):
    """With 5 or 9 bits of hash, unequal strings meet everywhere; no byte goes on a hash alone."""
    rows = corpus(4, 25)
    every = {"sample": 1, "hot_least": 0, "hot_parts": 10**9} if hot else {}
    got = remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(3), 40, 12, bits=(5, 9, 62), **every).collect()
    assert sorted(map(tuple, got)) == plain(rows, 40)


def test_letters_that_cancel_in_a_power_of_two(spark):
    """Thue-Morse blocks: such strings collide in polynomials modulo 2 ** 64 whatever the base is."""
    word = "0"
    while len(word) < 4096:
        word += word.translate(str.maketrans("01", "10"))
    one, two = word.translate(str.maketrans("01", "dN")), word.translate(str.maketrans("01", "Nd"))
    rows = [(1, "x" * 50 + one, 1, ""), (2, "y" * 50 + two, 1, "")]
    got = remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got)) == plain(rows, 100)
    rows = [(1, PAIR[0], 1, ""), (2, PAIR[1], 1, "")]
    assert [r.n_removed for r in remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()] == [0, 0]


PAIR = (
    "dNNdNddNNddNdNNdNddNdNNddNNdNddNS44S4SS44SS4S44S4SS4S44SS44S4SS4....ThWJLXz28qBlN3Ycuyw1GBbrsr5DkTuPcqqcqccqqccqcqqcqccqcqqccqqcqccqc22c2cc22cc2c22c2cc2c22cc22c2cc2....",
    "NddNdNNddNNdNddNdNNdNddNNddNdNNd4SS4S44SS44S4SS4S44S4SS44SS4S44S....ThWJLXz28qBlN3Ycuyw1GBbrsr5DkTuPqccqcqqccqqcqccqcqqcqccqqccqcqqc2cc2c22cc22c2cc2c22c2cc22cc2c22c....",
)


def test_long_texts_cross_pieces(spark):
    rng = random.Random(9)
    long = "".join(rng.choice("abcdefgh") for _ in range(2_300_000))
    rows = [(1, long, 1, ""), (2, "zz" + long[1_048_000:1_049_300] + "yy", 1, ""), (3, long[500_000:1_700_000], 1, "")]
    got = {r.doc_id: r for r in remove_repeats(spark.createDataFrame(rows, SCHEMA), with_text=True).collect()}
    assert (got[1].n_removed, got[2].n_removed, got[2].n_spans, bytes(got[2].kept)) == (0, 1300, 1, b"zzyy")
    assert (got[3].n_removed, got[3].n_spans) == (1_200_000, 1)


def test_null_ids_repeated_rows_and_empty(spark):
    text = "some words that go on for long enough to be a repeat of their own, as they do here and there, all over again"
    rows = [(None, text, 1, ""), (5, text, 1, ""), (5, text, 1, ""), (6, "x" + text, 1, "")]
    got = sorted(((r.doc_id or 0), r.n_removed) for r in remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(0, 0), (5, len(text)), (5, len(text)), (6, len(text))]
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
