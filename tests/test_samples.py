"""Counter-based normal numbers: the same at any partitioning, and normal."""

import numpy as np
from pyspark.sql import functions as F

from carpalake.operators import samples


def test_the_same_at_any_partitioning(spark):
    ids = spark.range(50).withColumnRenamed("id", "sample_id")
    one = {r.sample_id: r["values"] for r in samples.normals(ids.coalesce(1), 20, 7).collect()}
    many = {r.sample_id: r["values"] for r in samples.normals(ids.repartition(9).orderBy(F.desc("sample_id")), 20, 7).collect()}
    assert one == many
    part = samples.normals(ids.filter("sample_id = 31"), 5, 7).first()["values"]
    assert part == one[31][:5]
    assert one != {r.sample_id: r["values"] for r in samples.normals(ids, 20, 8).collect()}


def test_moments_and_independence(spark):
    x = np.array([r["values"] for r in samples.normals(spark.range(400).withColumnRenamed("id", "sample_id"), 100, 42).collect()])
    assert abs(x.mean()) < 0.02 and abs(x.std() - 1) < 0.02
    assert abs((x**3).mean()) < 0.06 and abs((x**4).mean() - 3) < 0.15
    assert len(np.unique(x)) > 39_990
    for a, b in ((x[:, 1:], x[:, :-1]), (x[1:], x[:-1]), (x[:, ::2], x[:, 1::2])):
        assert abs(np.corrcoef(a.ravel(), b.ravel())[0, 1]) < 0.03
    assert abs(np.mean(x < 0) - 0.5) < 0.01 and abs(np.mean(np.abs(x) < 1.959964) - 0.95) < 0.005


def test_parity_samples(spark):
    rows = samples.parity_samples(spark, 3, 8).collect()
    assert [len(r.image) for r in rows] == [192] * 3 and [len(r.meta) for r in rows] == [1] * 3 and {r.sample_id for r in rows} == {0, 1, 2}
    assert len({tuple(r.image) for r in rows}) == 3
