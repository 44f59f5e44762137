"""The registered queries on the smallest tables: against their SQL, or a plain version."""

import math
import os
import zlib
from collections import Counter

import numpy as np
import pytest
from test_simhash import classes, plain_fingerprint

from carpalake.llm.queries import ORACLES, QUERIES, word_tokenizer

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.sql("SELECT doc_id, text FROM documents").fetchall())


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", list(ORACLES))
def test_against_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DATA), duck.sql(ORACLES[name])
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=str) == sorted((tuple(dict(zip(want.columns, r))[c] for c in columns) for r in want.fetchall()), key=str)


def test_op1(spark, duck, texts):
    """Every document that holds a whole item is found; what is found holds most of the item's words in order."""
    from carpalake.llm.decontamination import lowered
    from carpalake.llm.decontamination import words_of as found

    words_of = lambda t: [w.decode() for w in lowered(found(t))]
    items = dict(duck.sql("SELECT item_id, text FROM benchmark").fetchall())
    padded = {i: f" {' '.join(words_of(t))} " for i, t in texts.items()}
    whole = {(i, j) for i, t in padded.items() for j, item in items.items() if f" {' '.join(words_of(item))} " in t}
    got = {(r.doc_id, r.item_id): r for r in QUERIES["op1_decontamination"](spark, DATA).collect()}
    assert whole and whole <= set(got)
    for (i, j), r in got.items():
        have, want = Counter(words_of(texts[i][r.start : r.end])), Counter(words_of(items[j]))
        assert (have & want).total() >= 0.8 * want.total()


def test_op3(spark, texts):
    fps = {i: plain_fingerprint(t) for i, t in texts.items()}
    cls, first = classes(set(fps.values())), {}
    for i, f in sorted(fps.items()):
        first.setdefault(cls[f], i)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op3_simhash"](spark, DATA).collect()}
    assert got == {i: (f"{f:016x}", first[cls[f]]) for i, f in fps.items()}


def test_op4(spark, texts):
    got = QUERIES["op4_quality"](spark, DATA).collect()
    assert {r.doc_id for r in got} == set(texts) and sum(r.selected for r in got) == len(texts) // 2
    assert min(r.gumbel_key for r in got if r.selected) > max(r.gumbel_key for r in got if not r.selected)


def test_op6(spark, texts):
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in texts}
    tokens = {i: [*t.encode().lower().split(), b""] for i, t in texts.items()}
    c = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    got = QUERIES["op6_lm_score"](spark, DATA).collect()
    assert len(got) == len(texts)
    for r in got:
        ws = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws))
    out = [r for r in got if r.held_out]
    bits = -sum(r.score for r in out) / math.log10(2) / sum(len(texts[r.doc_id].encode()) for r in out)
    assert 1 < bits < 4


def test_op8(spark, duck, texts):
    toxic = dict(duck.sql("SELECT doc_id, max(toxic) FROM labels GROUP BY 1").fetchall())
    got = {r.doc_id: r.toxic for r in QUERIES["op8_toxicity"](spark, DATA).collect()}
    assert set(got) == set(texts) and np.mean([got[i] == bool(t) for i, t in toxic.items()]) > 0.85


def test_op9(spark, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(word_tokenizer())
    ids = {i: np.array([*t.encode(x, add_special_tokens=False).ids, 2], "<u4") for i, x in texts.items()}
    pieces, sequences = {}, {}
    for r in QUERIES["op9_packing"](spark, DATA).collect():
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        pieces.setdefault(r.doc_id, []).extend(range(r.start, r.start + r.length))
        sequences.setdefault(r.sequence_id, []).extend(range(r.offset, r.offset + r.length))
    assert {i: sorted(p) for i, p in pieces.items()} == {i: [*range(len(x))] for i, x in ids.items()}
    sizes = [len(s) for s in sequences.values()]
    assert all(sorted(s) == list(range(len(s))) for s in sequences.values()) and max(sizes) <= 4096
    assert sum(4096 - s for s in sizes if s & (s - 1)) < 0.05 * sum(sizes)


def test_op10(spark, duck, texts):
    lang = dict(duck.sql("SELECT doc_id, lang FROM documents").fetchall())
    got = QUERIES["op10_language"](spark, DATA).collect()
    out = [r for r in got if r.held_out]
    assert {r.doc_id for r in got} == set(texts) and np.mean([r.lang_pred == lang[r.doc_id] for r in out]) > 0.9
