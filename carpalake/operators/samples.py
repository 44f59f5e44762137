"""Random samples without a random generator: each number is a function of a seed, the sample and the place in it.

A counter is mixed to a number under a prime, twice, by arithmetic that any SQL engine can repeat; two such numbers give a standard normal one
by the Box-Muller transform. So a sample is the same whatever the partitioning, order or engine, and any part of it can be made by itself.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the mixing: a prime, and factors under it.
PRIME, FACTORS = (1 << 31) - 1, (48_271, 69_621, 16_807, 39_373)


def mixed(seed: int, sample: Column, place: Column, stream: int) -> Column:
    """A number from 0 to PRIME - 1."""
    p = F.lit(PRIME).cast("long")
    x = F.pmod(F.pmod(sample.cast("long"), p) * FACTORS[0] + F.lit((seed * 7919 + stream * 104_729) % PRIME), p)
    x = F.pmod(x * x + F.pmod(place.cast("long"), p) * FACTORS[1] + F.lit(stream + 1), p)
    x = F.pmod(x * FACTORS[2] + x.bitwiseXOR(F.lit(0x2545F491).cast("long")), p)
    return F.pmod(x * x + x * FACTORS[3] + F.lit(12_345), p)


def uniform(seed: int, sample: Column, place: Column, stream: int = 0) -> Column:
    """A number over 0 and under 1."""
    return (mixed(seed, sample, place, stream).cast("double") + 0.5) / float(PRIME)


def normal(seed: int, sample: Column, place: Column) -> Column:
    """A standard normal number."""
    radius = F.sqrt(F.lit(-2.0) * F.log(uniform(seed, sample, place, 0)))
    return radius * F.cos(F.lit(2 * math.pi) * uniform(seed, sample, place, 1))


def normals(samples: DataFrame, length: int, seed: int, id_col: str = "sample_id") -> DataFrame:
    """samples with values: `length` standard normal numbers for each, by its id."""
    at = F.sequence(F.lit(0), F.lit(length - 1))
    return samples.withColumn("values", F.transform(at, lambda i: normal(seed, F.col(id_col), i)))


def parity_samples(spark: SparkSession, n: int = 10, size: int = 512, seed: int = 42) -> DataFrame:
    """Inputs on which two scorers can be compared: sample_id, image (3 * size * size normal numbers, channel by channel) and meta (one)."""
    ids = spark.range(n).withColumnRenamed("id", "sample_id").repartition(min(n, max(1, spark.sparkContext.defaultParallelism)))
    image = normals(ids, 3 * size * size, seed).withColumn("image", F.col("values").cast("array<float>"))
    return image.select("sample_id", "image", F.array(normal(seed + 1, F.col("sample_id"), F.lit(0)).cast("float")).alias("meta"))
