import random

import numpy as np
import pyarrow as pa
import pytest

from carpalake.llm.simhash import drop_near
from carpalake.llm.similar import _shared, bitmap, least_difference, similar_groups, wide_bitmap

SCHEMA = "doc_id long, text string, id int"


def plain_set(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def plain_components(data):
    least = {i: i for i, _, _ in data}

    def top(i):
        while least[i] != i:
            i = least[i]
        return i

    sets = [(i, plain_set(t)) for i, t, _ in data]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if 5 * len(a & b) >= 4 * len(a | b):
                x, y = sorted((top(i), top(j)))
                least[y] = x
    return {i: top(i) for i in least}


def rows():
    rng = random.Random(7)
    words = [f"w{i}" for i in range(300)] + ["Ünï", "É"]
    common = " ".join(rng.choice(words) for _ in range(30))
    out = [(0, None, 1), (1, "", 1), (2, " \n\t ", 1), (3, "One", 1), (4, "one two three four five", 1), (5, "ONE  two\nthree four five", 1), (6, "one two three four five six", 1)]
    for i in range(10, 70):
        text = [rng.choice(words) for _ in range(rng.choice([9, 45, 150, 400]))]
        out.append((i, " ".join(text) + " " + common * (i % 2), 1))
        for k in (100, 200):
            for _ in range(rng.randrange(1, 4 + len(text) // 60)):
                text[rng.randrange(len(text))] = f"changed{rng.random()}"
            out.append((i + k, "\n".join(text) + " " + common * (i % 2), 1))
    base = [rng.choice(words) for _ in range(120)]
    for i in range(300, 420):  # a large group, linked in part
        text = list(base)
        for _ in range(rng.randrange(5)):
            text[rng.randrange(120)] = f"other{rng.random()}"
        out.append((i, " ".join(text), 1))
    return out


@pytest.mark.parametrize("sample", [20_000, 20])
def test_groups_against_brute_force(spark, sample, monkeypatch):
    monkeypatch.setattr("carpalake.llm.similar.SAMPLE", sample)
    data = rows()
    want = plain_components(data)
    assert 1 < sum(want[i] != i for i in want) < len(want) - 1
    docs = spark.createDataFrame(data, SCHEMA).repartition(3)
    assert {r.doc_id: r.component_id for r in similar_groups(docs).collect()} == want
    kept = drop_near(docs, similarity=0.8)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_shared_keys_across_batches():
    rng = random.Random(3)
    for _ in range(200):
        rows = sorted((rng.randrange(6), rng.randrange(4)) for _ in range(rng.randrange(25)))
        cuts = sorted(rng.randrange(len(rows) + 1) for _ in range(3))
        parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
        batches = [pa.record_batch([pa.array([r[i] for r in part], pa.int64()) for i in (0, 1)], ["key", "node"]) for part in parts]
        got = [tuple(r.values()) for b in _shared(iter(batches)) for r in b.to_pylist()]
        nodes = {}
        for k, n in rows:
            nodes.setdefault(k, set()).add(n)
        assert got == sorted((k, n) for k, v in nodes.items() if len(v) > 1 for n in v)


def test_bitmaps_never_rule_a_link_out():
    rng = np.random.default_rng(1)
    for n in (1, 5, 40, 300, 5000):
        a = np.unique(rng.integers(0, 1 << 62, n))
        b = np.unique(np.concatenate([a[: max(1, len(a) * 8 // 9)], rng.integers(0, 1 << 62, len(a) // 9)]))
        differ = int(np.bitwise_count(bitmap(a).view(np.uint64) ^ bitmap(b).view(np.uint64)).sum())
        assert differ <= len(np.setxor1d(a, b)) and len(bitmap(a)) == 8
        for c in (b, a[::2], a[: len(a) // 3]):  # also of bitmaps of other sizes
            assert least_difference(wide_bitmap(a), wide_bitmap(c)) <= len(np.setxor1d(a, c))
        assert least_difference(wide_bitmap(a), wide_bitmap(a)) == 0
    assert least_difference(wide_bitmap(a), wide_bitmap(rng.integers(0, 1 << 62, 5000))) > 5000


def test_many_nodes_are_joined_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr("carpalake.llm.similar.SENT", 0)
    data = rows()
    assert {r.doc_id: r.component_id for r in similar_groups(spark.createDataFrame(data, SCHEMA)).collect()} == plain_components(data)


def test_null_ids_repeated_rows_and_empty_table(spark):
    got = similar_groups(spark.createDataFrame([(None, "a b c d", 1), (None, None, 1), (4, "", 1), (5, "x y", 1), (5, "x y", 1)], SCHEMA)).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got) == [("4", "4", True), ("5", "5", True), ("5", "5", True), ("None", "4", False), ("None", "None", True)]
    assert similar_groups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_the_stage_drops_what_three_bits_do_not_link(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(1)
    data = []
    for i in range(40):
        text = [f"v{rng.randrange(500)}" for _ in range(100)]
        data.append((i, " ".join(text), 1))
        text[rng.randrange(10, 90)] = "edited"
        data.append((i + 100, " ".join(text), 1))
    docs = spark.createDataFrame(data, SCHEMA)
    assert drop_near(docs).count() > 40
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == list(range(40))


def test_pairs_are_told_where_they_first_meet(spark, monkeypatch):
    """Long texts that share many shingles, too long for the small bitmaps to tell them apart, aren't paired anew at each of them."""
    from carpalake.llm import similar

    rng = random.Random(5)
    blocks = [[f"b{i}w{rng.randrange(900)}" for _ in range(100)] for i in range(40)]
    data = [(i, " ".join(w for b in rng.sample(blocks, 30) for w in b), 1) for i in range(14)]
    for i in range(3):  # links among them
        words = data[i][1].split()
        for _ in range(40):
            words[rng.randrange(len(words))] = f"changed{rng.random()}"
        data.append((100 + i, " ".join(words), 1))
    told, meeting = [], similar._meeting

    def counted(*args):
        told.append(meeting(*args))
        return told[-1]

    monkeypatch.setattr(similar, "_meeting", counted)
    monkeypatch.setattr(similar, "STARS", 0)
    want = plain_components(data)
    assert sum(want[i] != i for i in want) == 3
    assert {r.doc_id: r.component_id for r in similar_groups(spark.createDataFrame(data, SCHEMA)).collect()} == want
    (pairs,) = [[tuple(r) for r in p.collect()] for p in told]
    assert len(set(pairs)) > 50 and len(pairs) <= 2 * len(set(pairs))
