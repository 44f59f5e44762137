"""Counts, means and deviations as small states that merge, so that new rows don't ask for a look at the old ones.

A state is a row (n, mean, m2) for each part of the data: a day, a file, a site. m2 is the sum of squared distances from the part's own
mean. States merge exactly: n adds up, the mean is that of the means by n, and m2 is the sum of the parts' and of n times the
squared distance of each part's mean from the whole one. Nothing is lost if a part is as far from the others as it likes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATE = "n BIGINT, mean DOUBLE, m2 DOUBLE"


def state(df: DataFrame, value: Column, *by: str) -> DataFrame:
    """by, n, mean, m2 of the values of each part, in one aggregate. Null and NaN values don't count."""
    v = F.when(~F.isnan(value), value).cast("double")
    return df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(v)).alias("m2"))


def merged(states: DataFrame, *by: str) -> DataFrame:
    """by, n, mean, m2 of all states of each value of `by`. A state without values changes nothing; of no values, n is 0 and the others null."""
    some = states.filter("n > 0")
    whole = states.groupBy(*by).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    mean = some.groupBy(*by).agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"))
    at = some.withColumnRenamed("mean", "own")
    if by:
        apart = at.join(mean, [*by])
        m2 = apart.groupBy(*by).agg(F.sum(F.col("m2") + F.col("n") * (F.col("own") - F.col("mean")) ** 2).alias("m2"))
        return whole.join(mean, [*by], "left").join(m2, [*by], "left").select(*by, "n", "mean", "m2")
    m2 = at.crossJoin(F.broadcast(mean)).agg(F.sum(F.col("m2") + F.col("n") * (F.col("own") - F.col("mean")) ** 2).alias("m2"))  # one row
    return whole.crossJoin(F.broadcast(mean)).crossJoin(F.broadcast(m2)).select("n", "mean", "m2")  # one row each


def deviation(n: Column, m2: Column) -> Column:
    """The sample standard deviation; null of fewer than two values."""
    return F.when(n > 1, F.sqrt(m2 / (n - 1)))


def stats(age: DataFrame, proxy: DataFrame) -> DataFrame:
    """The training statistics (as cohort.fit_stats) from a merged state of the ages and one of their proxies."""
    sides = [s.select(F.col("mean").alias(f"{name}_mean"), deviation(F.col("n"), F.col("m2")).alias(f"{name}_std")) for s, name in ((age, "boneage"), (proxy, "idade_cron"))]
    return sides[0].crossJoin(F.broadcast(sides[1]))  # one row each
