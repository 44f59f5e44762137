"""Merged states against the statistics of all values at once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from carpalake.operators import moments


@pytest.mark.parametrize("parts,seed", [(1, 1), (3, 2), (40, 3)])
def test_any_parts_in_any_order(spark, parts, seed):
    rng = np.random.default_rng(seed)
    values = rng.normal(1e6, 3.0, 500) + rng.integers(0, 3, 500) * 1e4  # means that lie far apart
    rows = [(int(k), float(v)) for k, v in zip(rng.integers(0, parts, 500), values)]
    states = moments.state(spark.createDataFrame(rows, "part int, x double"), F.col("x"), "part")
    for order in (states, states.orderBy(F.desc("part")), states.repartition(5)):
        r = moments.merged(order).select("n", "mean", moments.deviation(F.col("n"), F.col("m2")).alias("std")).first()
        assert r.n == 500 and r["mean"] == pytest.approx(values.mean(), rel=1e-12) and r.std == pytest.approx(values.std(ddof=1), rel=1e-9)


def test_a_new_day_is_merged_to_the_old_state(spark):
    rows = [(i % 4, float(i * i % 97), i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "day int, x double, male int")
    old = moments.merged(moments.state(df.filter("day < 3"), F.col("x"), "day", "male"), "male")
    new = moments.state(df.filter("day = 3"), F.col("x"), "male")
    both = {r.male: r for r in moments.merged(old.unionByName(new), "male").collect()}
    for r in moments.state(df, F.col("x"), "male").collect():
        assert both[r.male].n == r.n and both[r.male]["mean"] == pytest.approx(r["mean"], rel=1e-12) and both[r.male].m2 == pytest.approx(r.m2, rel=1e-9)


def test_empty_parts_nulls_and_single_values(spark):
    df = spark.createDataFrame([(1, None), (2, float("nan")), (3, 5.0)], "part int, x double")
    r = moments.merged(moments.state(df, F.col("x"), "part")).first()
    assert (r.n, r["mean"], r.m2) == (1, 5.0, 0.0)
    none = moments.merged(moments.state(df.filter("part < 3"), F.col("x"), "part"))
    assert [tuple(r) for r in none.collect()] == [(0, None, None)]
    assert spark.createDataFrame([(1, 0.0), (2, 8.0)], "n long, m2 double").select(moments.deviation(F.col("n"), F.col("m2")).alias("s")).collect()[1].s == 8**0.5
