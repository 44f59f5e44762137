"""Rows that share an id, columns without an order, and sets that share common shingles without being similar."""

import random
import string

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_similar import plain_components
from test_substring_dedup import SCHEMA, corpus, plain

from carpalake.llm.exact_dedup import drop_exact
from carpalake.llm.similar import _meeting, bitmap, similar_groups
from carpalake.llm.substring_dedup import remove_repeats


def letters(rng, n):
    return "".join(rng.choice(string.ascii_letters) for _ in range(n))


def in_order(spark, rows):
    """The rows with ids of their own, as documents are ordered: by id, then by a hash of the text."""
    tags = {r.text: r.tag for r in spark.createDataFrame(rows, SCHEMA).select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tag")).collect()}
    order = sorted({(r[0], r[1] or "") for r in rows}, key=lambda x: (x[0], tags[x[1] if x[1] in tags else None]))
    return order, [(k, text, 1, "") for k, (_, text) in enumerate(order)]


def test_two_texts_of_one_id_that_cover_a_third(spark):
    rng = random.Random(1)
    s = letters(rng, 3000)
    rows = [(0, s, 1, ""), (1, s[:2000] + letters(rng, 1000), 1, ""), (1, letters(rng, 1000) + s[1000:], 1, "")]
    got = remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(0, 0), (1, 2000), (1, 2000)]


def test_many_texts_of_one_id_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(rng.choice([7, 7, 7, 1, 2, -3, i]), text, 1, "") for i, text, *_ in corpus(3, 50)]
    order, alone = in_order(spark, rows)
    want = sorted((order[k][0], *rest) for k, *rest in plain(alone, 40))
    got = remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(4), 40, 12)
    assert sorted(set(map(tuple, got.collect()))) == sorted(set(want))


def test_attempts_end(spark):
    """With two bits of hash, unequal strings always meet."""
    with pytest.raises(ValueError, match="in each of 2 attempts, last in .* documents, of which .* is the first"):
        remove_repeats(spark.createDataFrame(corpus(4, 25), SCHEMA), 40, 12, bits=(2,), attempts=2)


def test_ids_without_room_for_repeats(spark):
    rows = [(2**62, "a", 1, ""), (2**62, "b", 1, "")]
    with pytest.raises(ValueError, match="no room"):
        remove_repeats(spark.createDataFrame(rows, SCHEMA))


def test_exact_dedup_keeps_columns_without_an_order(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (2, "a"), (3, None), (4, "b"), (None, "b")], "doc_id long, text string")
    docs = docs.withColumn("m", F.create_map(F.lit("k"), F.col("doc_id"))).withColumn("order", F.array(F.create_map(F.lit("k"), F.rand(1)))).withColumn("a.b", F.struct(F.col("m").alias("x")))
    kept = drop_exact(docs)
    assert kept.dtypes == docs.dtypes
    rows = kept.collect()
    assert sorted((r.doc_id, r.text, r.m) for r in rows) == [(2, "a", {"k": 2}), (3, None, {"k": 3}), (4, "b", {"k": 4})]
    of = {(r.doc_id, str(r.order)) for r in docs.collect()}
    assert all((r.doc_id, str(r.order)) in of for r in rows)


def boilerplate(n, own, common, seed=1):
    rng = random.Random(seed)
    shared = [f"common{i}" for i in range(common)]
    return [(i, " ".join([f"w{rng.randrange(10**9)}" for _ in range(own)] + shared), 1) for i in range(n)]


@pytest.mark.parametrize("own,block", [(8, 2000), (6, 7), (3, 5), (12, 3)])
def test_boilerplate_against_brute_force(spark, own, block):
    data = boilerplate(120, own, 40) + [(i + 500, t + " and more", 1) for i, t, _ in boilerplate(40, own, 40)]
    docs = spark.createDataFrame(data, "doc_id long, text string, id int").repartition(3)
    assert {r.doc_id: r.component_id for r in similar_groups(docs, block=block).collect()} == plain_components(data)


@pytest.mark.parametrize("similarity,block", [(0.8, 2000), (0.8, 4), (0.5, 3), (0.95, 10), (1.0, 5)])
def test_meeting_loses_no_pair(spark, similarity, block):
    """Sets of numbers; their order is that of the numbers, and a shingle's place is its rank in the set."""
    rng = np.random.default_rng(5)
    pool = np.unique(rng.integers(1, 1 << 60, 400))
    sets = []
    for _ in range(60):
        base = rng.choice(pool, rng.integers(1, 60), replace=False)
        sets += [base, *(np.unique(np.where(rng.random(len(base)) < rng.choice([0, 0.05, 0.2]), rng.choice(pool, len(base)), base)) for _ in range(3))]
    sets = [np.sort(s) for s in {tuple(np.unique(s)) for s in sets}]
    rows = []
    for node, s in enumerate(sets):
        first = len(s) - int(np.ceil(similarity * len(s) - 1e-9)) + 1
        rows += [(int(key), node, place, node, len(s), bitmap(s).tolist()) for place, key in enumerate(s[:first])]
    frame = spark.createDataFrame(rows, "key long, node long, place long, least long, n int, marks array<long>")
    got = {tuple(sorted(r)) for r in _meeting(frame, similarity, block).collect()}
    want = {(i, j) for j, b in enumerate(sets) for i, a in enumerate(sets[:j]) if (c := len(np.intersect1d(a, b))) >= similarity * (len(a) + len(b) - c) - 1e-9}
    assert want <= got and (similarity == 1.0 or len(want) > 3)
