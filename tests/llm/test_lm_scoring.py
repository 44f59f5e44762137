import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from carpalake.llm import context_tree as tree
from carpalake.llm.lm_scoring import Lookup, score_documents

SCHEMA = "doc_id long, text string, n_tokens string, score int"


class PlainNode:
    def __init__(self):
        self.n, self.kids = [0, 0], {}

    def kt(self):
        out, seen = 0.0, [0, 0]
        for bit in (0, 1):
            for _ in range(self.n[bit]):
                out += math.log((seen[bit] + 0.5) / (sum(seen) + 1))
                seen[bit] += 1
        return out

    def weighted(self, depth):
        if depth == tree.DEPTH:
            return self.kt()
        return math.log(0.5) + np.logaddexp(self.kt(), sum(k.weighted(depth + 1) for k in self.kids.values()))


def decisions(byte):
    v = 1
    for k in range(7, -1, -1):
        yield v, byte >> k & 1
        v = v << 1 | byte >> k & 1


def paths(text):
    data = bytes(tree.DEPTH) + text + bytes([tree.END])
    for i in range(tree.DEPTH, len(data)):
        yield data[i], [data[i - d] for d in range(1, tree.DEPTH + 1)]


def plain_model(texts):
    roots = {}
    for text in texts:
        for byte, context in paths(text):
            for v, bit in decisions(byte):
                node = roots.setdefault(v, PlainNode())
                node.n[bit] += 1
                for c in context:
                    node = node.kids.setdefault(c, PlainNode())
                    node.n[bit] += 1
    return roots


def plain_score(roots, text):
    def predict(node, context, bit, depth):
        own = (node.n[bit] + 0.5) / (sum(node.n) + 1)
        if depth == tree.DEPTH or context[depth] not in node.kids:
            return own
        share = math.exp(math.log(0.5) + node.kt() - node.weighted(depth))
        return share * own + (1 - share) * predict(node.kids[context[depth]], context, bit, depth + 1)

    return sum(math.log10(predict(roots[v], context, bit, 0) if v in roots else 0.5) for byte, context in paths(text) for v, bit in decisions(byte))


def rows():
    rng = random.Random(2)
    out = [(i, " ".join(rng.choice(["The", "cat", "sat", "on", "Ümat", "dog"]) for _ in range(rng.randrange(1, 9))), "x", 1) for i in range(40)]
    return out + [(100, None, "x", 1), (101, "", "x", 1), (102, "\n\t ", None, None), (None, "no id", "x", 1), (103, "zebra", "x", 1), (103, "zebra", "x", 1)]


@pytest.mark.parametrize("block_bytes,piece", [(32_000_000, 300_000), (150, 20)])
def test_against_plain_models(spark, block_bytes, piece):
    data = [(i, (t or "").encode().lower()) for i, t, *_ in rows()]
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in data}
    assert 3 < sum(held.values()) < 30
    learned = [t for i, t in data if not held[i]]
    roots, c = plain_model(learned), Counter(w for t in learned for w in (*t.split(), b""))
    n, v = sum(c.values()), len(c)
    want = sorted((-1 if i is None else i, held[i], len(t.split()) + 1, sum(c[w] > 0 for w in (*t.split(), b"")), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in (*t.split(), b"")), 5), round(plain_score(roots, t), 5)) for i, t in data)
    got = score_documents(spark.createDataFrame(rows(), SCHEMA).repartition(3), block_bytes=block_bytes, piece=piece).collect()
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 5)) for r in got)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[5:] == pytest.approx(w[5:], abs=2e-5)


def test_predictions_sum_to_one():
    keys, _ = tree.strings([b"abracadabra", b"abra"])
    t = tree.levels(*tree.counted(keys), 0)
    for context in (keys[4], keys[9], int.from_bytes(b"qzqzq\0", "big")):
        every = (int(context) >> 8 << 8) | np.arange(256)
        assert np.exp(tree.log_probabilities(every, t)).sum() == pytest.approx(1)


def test_log_gamma_and_lookup():
    for x in (0.5, 1, 1.5, 7, 1000.5, 1e7):
        assert tree.log_gamma(np.array([x]))[0] == pytest.approx(math.lgamma(x), rel=1e-9, abs=1e-9)
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 48, 5000))
    assert (Lookup(keys, keys * 0.5)[keys[::-1].copy()] == keys[::-1] * 0.5).all()


def test_empty(spark):
    assert score_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_lookup():
    from carpalake.llm.lm_scoring import Lookup

    rng = np.random.default_rng(2)
    for n in (1, 999, 1000, 50_000, 65_536):
        keys = rng.choice(1 << 48, n, replace=False) if n < 1000 else np.unique(rng.integers(0, 1 << 48, n))
        values = rng.random(len(keys))
        at = rng.integers(0, len(keys), 3 * n)
        assert (Lookup(keys, values)[keys[at]] == values[at]).all()
    assert len(Lookup(keys, values)[keys[:0]]) == 0
