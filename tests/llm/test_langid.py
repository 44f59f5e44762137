import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from carpalake.llm import langid
from carpalake.llm.langid import Network, held_out, identify

SCHEMA = "doc_id long, text string, lang string, lang_pred string, score int"


def test_gradients_against_differences():
    rng = np.random.default_rng(1)
    net = Network.fresh(["a", "b", "c"], 3, 2)
    for d in (net.ahead, net.back):
        d.gates_in, d.candidate_in, d.gates, d.candidate = (p.astype(np.float64) * 0.5 for p in d.parts())
    windows, sizes, y = rng.integers(97, 102, (5, 9)).astype(np.uint8), np.array([9, 9, 4, 7, 9]), np.array([0, 1, 2, 1, 0])
    mask = np.arange(9) < sizes[:, None]
    grads = net.step(windows, mask, y)

    def loss():
        p = net.positions(windows)
        return -np.mean([np.log(p[t, i, y[i]]) for i in range(5) for t in range(sizes[i])])

    eps = 3e-3
    for part, grad in zip(net.parts(), grads, strict=True):
        for at in [np.unravel_index(k, part.shape) for k in np.argsort(-np.abs(grad).ravel())[:4]]:
            part[at] += eps
            up = loss()
            part[at] -= 2 * eps
            down = loss()
            part[at] += eps
            assert (up - down) / (2 * eps) == pytest.approx(grad[at], rel=0.08, abs=2e-3)


def plain_states(d, data):
    n, h, out = d.candidate.shape[0], np.zeros(d.candidate.shape[0]), []
    for byte in data:
        g = np.clip(0.25 * (d.gates_in[byte] + h @ d.gates) + 0.5, 0, 1)
        c = np.clip(d.candidate_in[byte] + g[n:] * (h @ d.candidate), -1, 1)
        h = h + g[:n] * (c - h)
        out.append(h)
    return np.array(out)


def test_pooling_covers_every_byte():
    net = Network.fresh(["a", "b"], 4, 3)
    texts = [b"", b"short", bytes(range(256)) * 3, b"x" * langid.WINDOW, b"y" * (langid.WINDOW + 1), bytes(range(200, 256)) * 4]
    got = net.pooled(texts)
    step = langid.WINDOW - 2 * langid.MARGIN
    for text, p in zip(texts, got, strict=True):
        total, done = np.zeros(2), 0
        for i in range(0, len(text), step):
            piece = text[i : i + langid.WINDOW].ljust(langid.WINDOW, b"\0")
            s = np.column_stack([plain_states(net.ahead, piece), plain_states(net.back, piece[::-1])[::-1], np.ones(langid.WINDOW)]) @ net.head
            e = np.exp(s - s.max(axis=1, keepdims=True))
            end = len(text) if i + langid.WINDOW >= len(text) else i + langid.WINDOW - langid.MARGIN
            total += (e / e.sum(axis=1, keepdims=True))[done - i : end - i].sum(axis=0)  # what the windows before haven't labelled
            done = end
            if done == len(text):
                break
        assert done == len(text) and p == pytest.approx(total / max(1, len(text)), abs=1e-4)


def test_held_out_accuracy(spark):
    rng = random.Random(3)
    syllables = {"xx": ["ka", "lo", "mi"], "yy": ["sch", "ung", "er"], "zz": ["éa", "où", "re"]}
    rows = []
    for i in range(240):
        lang = rng.choice(list(syllables))
        rows.append((i, " ".join("".join(rng.choices(syllables[lang], k=rng.randrange(1, 4))) for _ in range(rng.randrange(3, 90))), lang, "x", 1))
    rows += [(None, None, None, None, None), (1000, "", "xx", "x", 1), (1001, "123 $$", "xx", "x", 1), (1002, "ka lo mi " * 20_000, None, "x", 1), (1002, "ka lo mi " * 20_000, None, "x", 1)]
    got = identify(spark.createDataFrame(rows, SCHEMA).repartition(3), held_out()).collect()
    assert len(got) == len(rows)
    lang = {r[0]: r[2] for r in rows}
    test = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 1000]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert len(test) > 30 and np.mean([r.lang_pred == lang[r.doc_id] for r in test]) > 0.95
    assert {(r.lang_pred, r.score) for r in got if r.doc_id in (None, 1000, 1001)} == {("und", 0.0)}
    assert {r.lang_pred for r in got if r.doc_id == 1002} == {"xx"} and all(0 <= r.score <= 1 for r in got)


def test_nothing_to_learn_and_empty(spark):
    assert [r.lang_pred for r in identify(spark.createDataFrame([(1, "abc", None, "", 1)], SCHEMA), F.lit(False)).collect()] == ["und"]
    assert identify(spark.createDataFrame([], SCHEMA), held_out()).count() == 0


def test_any_condition_and_rare_languages(spark):
    """held may use any column; a language with few documents is learned beside a frequent one."""
    rows = [(i, "ka lo mi ka mi lo " * 8, "xx", "web" if i % 3 else "book", 1) for i in range(600)] + [(1000 + i, "sch ung er ung sch " * 8, "yy", "book", 1) for i in range(3)] + [(2000, "sch ung er ung sch " * 5, None, "web", 1)]
    got = identify(spark.createDataFrame(rows, SCHEMA).repartition(4), F.col("lang_pred") == "web", most=40).collect()
    assert sum(r.held_out for r in got) == 401
    assert {r.lang_pred for r in got if r.doc_id < 1000} == {"xx"} and {r.lang_pred for r in got if r.doc_id >= 1000} == {"yy"}
