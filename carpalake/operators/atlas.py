"""A reference table of skeletal maturation by age band, and its range lookup.

The bands' edges are fixed; what a band says comes from the caller's table. Without one, each band has
a few numbered placeholders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import ATLAS

#: The lower edges of the bands in months. The last band ends at 999.
EDGES = (0, 12, 24, 36, 54, 72, 96, 120, 144, 168, 192, 216)
LAST = 999


def rows() -> list[tuple[int, float, float, str, list[str], list[str], str]]:
    """The bands with placeholder texts: one to three for the wrist, two or three for the growth plates."""
    out = []
    for i, (lo, hi) in enumerate(zip(EDGES, (*EDGES[1:], LAST), strict=True)):
        wrist = [f"wrist note {j + 1} of band {i + 1}" for j in range(1 + i % 3)]
        plates = [f"growth plate note {j + 1} of band {i + 1}" for j in range(3 - i % 2)]
        out.append((i, float(lo), float(hi), f"months {lo} to {hi}", wrist, plates, f"band {i + 1}"))
    return out


def atlas(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rows(), ATLAS)


def band(age: Column) -> Column:
    """The band whose half-open range holds the age; ages outside all of them, and NaN, get the last one."""
    out = F.when(age.isNull() | F.isnan(age) | (age < EDGES[0]) | (age >= LAST), len(EDGES) - 1)
    for i, edge in enumerate(EDGES[1:]):
        out = out.when(age < edge, i)
    return out.otherwise(len(EDGES) - 1)


def lookup(df: DataFrame, age: str, texts: DataFrame | None = None) -> DataFrame:
    """df with the atlas columns of its ages: a band code in the projection and a hash join to the twelve bands.

    texts: columns as in ATLAS, one row for each band 0 to 11; rows of other bands are not read. Evaluation fails on an age whose
    band texts don't have, and if a band has several rows that differ. Each row of df gives one row.
    """
    spark = df.sparkSession
    if texts is None:
        named = atlas(spark)
    else:
        of_bands = texts.filter(F.col("band").between(0, len(EDGES) - 1)).distinct().groupBy("band").agg(*[F.first(c).alias(c) for c in texts.columns if c != "band"], F.count(F.lit(1)).alias("rows"))  # twelve rows at most
        named = of_bands.filter(F.when(F.col("rows") == 1, True).otherwise(F.raise_error(F.concat(F.lit("several rows for band "), F.col("band").cast("string"))).cast("boolean"))).drop("rows")
    named = named.withColumn("there", F.lit(True)).alias("named")
    placed = df.select(F.struct("*").alias("row"), band(F.col(age)).alias("band")).alias("placed")
    both = placed.join(F.broadcast(named), F.col("placed.band") == F.col("named.band"), "left")
    found = F.when(F.col("there"), F.col("placed.band")).otherwise(F.raise_error(F.concat(F.lit("no row for band "), F.col("placed.band").cast("string"))).cast("int"))
    return both.select(found.alias("band"), "row.*", *[F.col(f"named.{c}") for c in named.columns if c not in ("band", "there")])
