"""A study view with exactly representable ages, derived from the orders table, and synthetic images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.months import clip_months


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, boneage, male, ic, raw, pred."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    base = table(spark, sf_dir, "orders").select(
        k.alias("id"),
        ((k * 37 + c * 11) % 229).cast("double").alias("boneage"),
        (c % 2).cast("int").alias("male"),
        F.nullif((k * 53 + c * 7) % 240, F.lit(0)).cast("double").alias("ic"),
        (((k * 17 + c * 29) % 401 - 200) / F.lit(8.0)).alias("off"),
    )
    return base.withColumn("raw", F.col("boneage") + F.col("off")).drop("off").withColumn("pred", clip_months(F.col("raw")))


STUDY_SQL = """
    study AS (SELECT *, least(228.0::DOUBLE, greatest(0.0::DOUBLE, raw)) AS pred FROM (
        SELECT o_orderkey AS id, ((o_orderkey * 37 + o_custkey * 11) % 229)::DOUBLE AS boneage, (o_custkey % 2)::INTEGER AS male,
               nullif((o_orderkey * 53 + o_custkey * 7) % 240, 0)::DOUBLE AS ic,
               ((o_orderkey * 37 + o_custkey * 11) % 229)::DOUBLE + ((o_orderkey * 17 + o_custkey * 29) % 401 - 200)::DOUBLE / 8 AS raw
        FROM orders))"""


def _marked(id_: Column, x: Column, y: Column) -> Column:
    """Whether a pixel of a synthetic image belongs to its mark: a wide one for ids that end in 9, else a box."""
    x0, y0 = 4 + id_ % 23, 3 + id_ % 19
    wide = (id_ % 10 == 9) & x.between(2, 61) & y.between(2, 61)
    return wide | (id_ % 10 != 9) & x.between(x0, x0 + 6 + id_ % 31) & y.between(y0, y0 + 8 + id_ % 37)


def synthetic_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, x, y, v: a gray image of 64 by 64 for each row of embeddings. The pixels of an id are generated, not joined."""
    ids = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))
    at = ids.withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(63)))).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(63))))
    return at.withColumn("v", F.when(_marked(F.col("id"), F.col("x"), F.col("y")), 120).when(F.col("id") % 2 == 0, 0).otherwise(255))


PIXELS_SQL = """
    axis AS (SELECT unnest(range(64))::INTEGER AS p),
    pixels AS (SELECT vec_id AS id, x.p AS x, y.p AS y, CASE
            WHEN vec_id % 10 = 9 AND x.p BETWEEN 2 AND 61 AND y.p BETWEEN 2 AND 61 THEN 120
            WHEN vec_id % 10 <> 9 AND x.p BETWEEN 4 + vec_id % 23 AND 10 + vec_id % 23 + vec_id % 31
                 AND y.p BETWEEN 3 + vec_id % 19 AND 11 + vec_id % 19 + vec_id % 37 THEN 120
            WHEN vec_id % 2 = 0 THEN 0 ELSE 255 END AS v
        FROM embeddings, axis x, axis y)"""


def synthetic_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pixels as binary images, one channel, made row by row without a shuffle: lines of pixels are repeated, not made one by one."""
    id_ = F.col("id")
    edge = F.when(id_ % 2 == 0, "00").otherwise("FF")

    def extent(start: Column, length: Column) -> tuple[Column, Column]:
        """Where the mark begins on an axis, and for how many places; none for a null id."""
        first = F.when(id_ % 10 == 9, 2).otherwise(F.greatest(F.lit(0), start))
        last = F.when(id_ % 10 == 9, 61).otherwise(F.least(F.lit(63), start + length))
        return first.cast("int"), F.when(id_.isNull(), 0).otherwise(F.greatest(F.lit(0), last - first + 1)).cast("int")

    def row(mark: Column, other: Column, first: Column, n: Column) -> Column:
        return F.concat(F.repeat(other, first), F.repeat(mark, n), F.repeat(other, 64 - first - n))

    x, y = extent(4 + id_ % 23, 6 + id_ % 31), extent(3 + id_ % 19, 8 + id_ % 37)
    data = F.unhex(row(row(F.lit("78"), edge, *x), F.repeat(edge, F.lit(64)), *y))
    ids = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))  # few rows, much work each
    return ids.select("id", F.lit(64).alias("height"), F.lit(64).alias("width"), F.lit(1).alias("channels"), data.alias("data"))
