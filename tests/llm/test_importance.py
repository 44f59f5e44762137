import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
from xxhash import xxh64_intdigest

from carpalake.llm.features import ngram_slots
from carpalake.llm.importance import kth_largest, resample

SCHEMA = "doc_id long, text string, noise string, id int"


def test_kth_largest(spark):
    values = [5, -3, 2**62, -(2**63), 0, 5, 7]
    df = spark.createDataFrame([(v,) for v in values], "x long")
    for k in range(1, 8):
        assert kth_largest(df, "x", k) == sorted(values, reverse=True)[k - 1]
    assert kth_largest(df, "x", 0) is None


def test_against_plain_models(spark):
    rows = [(i, ("good words here now " if i % 2 else "bad stuff over there ") * (1 + i % 5), "n", 1) for i in range(60)]
    rows += [(None, None, None, None), (100, "", None, None), (100, "", None, None), (101, "word " * 30_000, "n", 2)]
    docs, good = spark.createDataFrame(rows, SCHEMA).repartition(3), spark.createDataFrame([(i,) for i in range(1, 40, 2)] + [(1,), (None,)], "doc_id long")
    got = resample(docs, good, share=0.25, slots=512).collect()
    assert len(got) == len(rows)
    raw, target = np.ones(512), np.ones(512)
    for r in rows:
        n = np.bincount(ngram_slots(r[1], 512), minlength=512)
        raw += n
        if r[0] in range(1, 40, 2):
            target += n
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    want = {(r[0], round(float(ratio[ngram_slots(r[1], 512)].sum()), 6)) for r in rows}
    assert {(r.doc_id, round(r.log_weight, 6)) for r in got} == want
    keys = sorted((r.gumbel_key for r in got), reverse=True)
    assert {r.gumbel_key for r in got if r.selected} == set(keys[: len(rows) // 4])
    mean = lambda odd: np.mean([r.log_weight / (1 + r.doc_id % 5) for r in got if r.doc_id is not None and r.doc_id < 60 and r.doc_id % 2 == odd])
    assert mean(1) > mean(0)
    assert all(r.log_weight == 0 for r in got if r.doc_id in (None, 100))


WRAP = (1 << 64) - 1


def plain_slots(text, slots):
    """The slots of words and pairs of neighbours, on plain integers."""
    words = [zlib.crc32("".join(c.lower() if "A" <= c <= "Z" else c for c in w).encode()) for w in re.findall(r"[^\x20\x09-\x0d]+", text or "")]
    pairs = [(a * 0x85EBCA6B + b + 1) & WRAP for a, b in zip(words, words[1:])]
    return [((h * 0x9E3779B97F4A7C15 & WRAP) >> 33) % slots for h in words + pairs]


def plain_noise(seed, doc_id, text):
    """Spark's xxhash64 of an int, a long (null: skipped) and a string; each is the seed of the next."""
    h = xxh64_intdigest(struct.pack("<i", seed), 42)
    h = h if doc_id is None else xxh64_intdigest(struct.pack("<q", doc_id), h)
    u = ((xxh64_intdigest((text or "").encode(), h) >> 11) + 0.5) / 2**53
    return -math.log(-math.log(u))


def test_weights_and_keys_from_plain_integers(spark):
    rng = random.Random(5)
    words = ["Alpha", "beta", "GAMMA", "delta", "Épsilon", "zeta\tx", "eta"]
    rows = [(i if i % 9 else None, " ".join(rng.choices(words, k=rng.randrange(30))), "n", 1) for i in range(80)]
    good = set(range(1, 40, 3))
    got = resample(spark.createDataFrame(rows, SCHEMA).repartition(3), spark.createDataFrame([(i,) for i in good], "doc_id long"), share=0.3, slots=97, seed=11).collect()
    raw, target = Counter(), Counter()
    for i, text, *_ in rows:
        raw.update(plain_slots(text, 97))
        target.update(plain_slots(text, 97) if i in good else [])
    log_p = lambda c, s: math.log((c[s] + 1) / (c.total() + 97))
    weight = lambda t: sum(log_p(target, s) - log_p(raw, s) for s in plain_slots(t, 97))
    want = sorted((weight(t), weight(t) + plain_noise(11, i, t)) for i, t, *_ in rows)
    found = sorted((r.log_weight, r.gumbel_key) for r in got)
    assert np.allclose(np.array(found), np.array(want), rtol=0, atol=1e-6)
    assert sum(r.selected for r in got) == 24
    assert min(r.gumbel_key for r in got if r.selected) > max(r.gumbel_key for r in got if not r.selected)


def test_empty_table(spark):
    assert resample(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id long")).count() == 0
