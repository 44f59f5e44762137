"""Batches of epochs: each row once, full batches, another order each epoch for the train split only."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from carpalake.operators import evaluate, loader


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 100, 997, 5000])
def test_permuted_is_a_bijection_and_epochs_differ(spark, n):
    df = spark.range(n).select("id", *[loader.permuted(F.col("id"), F.lit(n).cast("long"), 42, F.lit(e)).alias(f"e{e}") for e in (1, 2)])
    rows = df.orderBy("id").collect()
    for e in ("e1", "e2"):
        assert sorted(r[e] for r in rows) == list(range(n))
    if n >= 100:
        assert [r.e1 for r in rows] != [r.e2 for r in rows]
        for e in ("e1", "e2"):  # no trace of the order before
            assert abs(np.corrcoef([r.id for r in rows], [r[e] for r in rows])[0, 1]) < 0.25
            assert np.mean([abs(a[e] - b[e]) == 1 for a, b in zip(rows, rows[1:])]) < 0.1


def data(spark):
    rows = [(i, "train" if i % 5 > 1 else "val" if i % 5 else "test", float(i)) for i in range(1000)] + [(None, "train", 1.0), (7, "train", 2.0), (7, "train", 2.0)]
    return spark.createDataFrame(rows, "id long, split string, x double").withColumn("place", F.lit("own"))


def test_batches(spark):
    out = loader.batches(data(spark).repartition(7), [1, 2, 3])
    assert out.columns == ["id", "split", "x", "place", "epoch", "batch", "slot"]
    rows = out.collect()
    order = {}
    for r in rows:
        order.setdefault((r.split, r.epoch), {})[r.batch, r.slot] = r.id
    sizes = {r.split: r.n for r in data(spark).groupBy("split").agg(F.count("x").alias("n")).collect()}
    assert len(rows) == 3 * 1003
    for (split, _), places in order.items():
        assert sorted(places) == [(k // 16, k % 16) for k in range(sizes[split])]  # batches of 16 but the last
    in_order = {k: [v[p] for p in sorted(v)] for k, v in order.items()}
    assert in_order["val", 1] == in_order["val", 2] and in_order["test", 1] == in_order["test", 3]
    assert len({str(in_order["train", e]) for e in (1, 2, 3)}) == 3
    key = lambda ids: sorted(ids, key=str)
    assert key(in_order["train", 1]) == key(in_order["train", 2])
    again = {(r.epoch, r.batch, r.slot): r.id for r in loader.batches(data(spark).repartition(2), [2]).filter("split = 'train' AND id <> 7").collect()}
    assert all(order["train", 2][b, s] == i for (_, b, s), i in again.items())
    other = loader.batches(data(spark), [1], seed=43).filter("split = 'train'").collect()
    assert {(r.batch, r.slot): r.id for r in other} != order["train", 1]


def test_no_global_sort_and_one_pass(spark):
    plan = loader.batches(data(spark), [1])._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan


def test_empty_table_and_loss(spark):
    assert loader.batches(data(spark).limit(0), [1]).count() == 0
    rows = loader.batches(data(spark).filter("id < 40"), [1]).filter("split = 'train'").collect()
    means = {}
    for r in rows:
        means.setdefault(r.batch, []).append(r.x)
    want = np.mean([np.mean(v) for v in means.values()])
    assert len(means) == 2
    got = evaluate.batch_loss(loader.batches(data(spark).filter("id < 40"), [1]).filter("split = 'train'"), F.col("batch"), F.col("x")).first().loss
    assert abs(got - want) < 1e-9
