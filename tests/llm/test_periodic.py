import hashlib
import os
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from carpalake.llm.periodic import Extension, WaveletTree, collapse_runs, doubled, find_runs
from carpalake.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def plain_runs(words, least=24, times=3):
    """Every period by itself: stretches in which words that far apart are equal, of which the smallest period counts."""
    found = {}
    x = np.array([hash(w) for w in words], np.int64)
    for q in range(1, len(words) // times + 1):
        same = np.concatenate([[False], x[:-q] == x[q:], [False]]).astype(int)
        for s, e in zip(np.flatnonzero(np.diff(same) == 1).tolist(), np.flatnonzero(np.diff(same) == -1).tolist()):
            if e - s + q >= max(least, times * q):
                found.setdefault((s, e - s + q), q)
    return sorted((s, n, q) for (s, n), q in found.items())


def plain_collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def cases():
    rng = random.Random(9)
    out = [[], ["a"] * 23, ["a"] * 24, ["a"] * 500, list("ab") * 40, list("abc") * 8, list("abcdefgh") * 3, list("abcdefghi") * 2]
    for _ in range(300):
        letters = "abcdefgh"[: rng.randint(1, 8)]
        text = [rng.choice(letters) for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(4)):
            unit = [rng.choice(letters) for _ in range(rng.choice([1, 2, 3, 5, 8, 9, 15, 16, 17, 31, 40]))]
            if rng.random() < 0.5:  # a period inside the period
                inner = unit[: rng.randint(1, 3)]
                unit = (inner * 30)[: len(unit)] + [rng.choice(letters)]
            text += (unit * 9)[: rng.randint(len(unit), 6 * len(unit) + 3)] + [rng.choice(letters) for _ in range(rng.randrange(5))]
        out.append(text)
    return out


def laid_out(texts):
    names = {}
    words = np.array([names.setdefault(w, len(names)) for t in texts for w in t], np.int64)
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    return words, np.repeat(np.arange(len(texts)), sizes), np.repeat(ends - sizes, sizes), np.repeat(ends, sizes)


@pytest.mark.parametrize("least,times", [(24, 3), (3, 3), (7, 3), (24, 5)])
def test_runs_against_every_period(least, times):
    texts = cases()
    words, text, start, end = laid_out(texts)
    first, length, period = find_runs(words, text, start, end, least, times)
    got = {}
    for s, n, q in zip(first.tolist(), length.tolist(), period.tolist()):
        got.setdefault(int(text[s]), []).append((s - int(start[s]), n, q))
    want = {i: r for i, t in enumerate(texts) if (r := plain_runs(t, least, times))}
    assert got == want and sum(map(len, want.values())) > 100


def test_suffix_array_and_ranks():
    texts = [t for t in cases() if len(t) < 90][:40]
    words, text, start, end = laid_out(texts)
    order, ranks, stops = doubled(words, text, end)
    suffix = lambda i, n=None: words[i : end[i] if n is None else min(end[i], i + n)].tolist()
    assert order.tolist() == sorted(range(len(words)), key=lambda i: (text[i], suffix(i)))
    for k, (rank, stop) in enumerate(zip(ranks, stops)):
        whole = np.flatnonzero(np.arange(len(words)) + (1 << k) <= end)
        groups = {}
        for i in whole.tolist():
            groups.setdefault((int(text[i]), tuple(suffix(i, 1 << k))), []).append(i)
        for g in groups.values():
            low = rank[g[0]]
            assert set(rank[g]) == {low} and sorted(order[low : stop[low]].tolist()) == g


def test_wavelet_tree_and_extensions():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 64, 1000):
        values = rng.permutation(n)
        tree = WaveletTree(values)
        low = rng.integers(0, n, 200)
        high = rng.integers(low, n) + 1
        than = rng.integers(0, n + 1, 200)
        want = [int((values[a:b] < v).sum()) for a, b, v in zip(low, high, than)]
        assert tree.smaller(low, high, than).tolist() == want
        k = np.array([rng.integers(0, b - a) for a, b in zip(low, high)])
        assert tree.select(low, high, k).tolist() == [sorted(values[a:b])[j] for a, b, j in zip(low, high, k)]
    words, text, start, end = laid_out([list("abab" * 9), list("aaabaaab"), ["x"]])
    extension = Extension(doubled(words, text, end)[1], start, end)
    a, b = (np.array(v) for v in zip(*[(i, j) for i in range(len(words)) for j in range(i + 1, end[i])]))
    for x, y, m, n in zip(a, b, extension.ahead(a, b), extension.back(a, b)):
        ahead = 0
        while y + ahead < end[y] and words[x + ahead] == words[y + ahead]:
            ahead += 1
        back = 0
        while x - back - 1 >= start[x] and words[x - back - 1] == words[y - back - 1]:
            back += 1
        assert (m, n) == (ahead, back)


def test_collapse(spark):
    data = [(i, "\n".join(t), "x", 1) for i, t in enumerate(cases()[:60])] + [(None, "z " * 30, "x", 1), (7, None, "x", 1), (7, None, "x", 1), (500, " \t\v\n ", "x", 1), (501, "é\xa0ü " * 40, "x", 1), (502, "long text of words " * 20_000, "x", 1)]
    docs = spark.createDataFrame(data, "doc_id long, text string, runs string, n_words int").repartition(3)
    out = collapse_runs(docs)
    assert out.columns == ["doc_id", "n_words", "runs", "strongest", "collapsed"]
    want = []
    for i, text, *_ in data:
        words = re.findall("[^\x20\x09-\x0d]+", text or "")
        runs = plain_runs(words) if i != 502 else [(0, 80_000, 4)]
        want.append((str(i), len(words), runs, " ".join(plain_collapsed(words, runs))))
    rows = out.collect()
    assert sorted((str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in rows) == sorted(want)
    for r in rows:
        best = max(r.runs, key=lambda x: (Fraction(x.length, x.period), -x.start, -x.period), default=None)
        assert (r.strongest and r.runs[r.strongest - 1]) == best
    assert collapse_runs(docs.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_op12(spark):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op12_periodic_runs"](spark, DATA).collect()}
    assert len(got) == len(docs)
    planted = 0
    for i, text in docs:
        words = re.findall("[^\x20\x09-\x0d]+", text or "")
        n, h = len(words), zlib.crc32(str(i).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (k - a) % p] for k in range(a, n)]
            planted += 1
        runs = plain_runs(words)
        best = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=None)
        row = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        assert got[i] == (len(runs), *row, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(plain_collapsed(words, runs))))
    assert planted > 5
