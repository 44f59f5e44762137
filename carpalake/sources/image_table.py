"""Images as a table that is bucketed and sorted by id, so that rows come to their images and not images to the rows.

A join with it deals only the other side out to its buckets: no image is shuffled. Reads of a few ids open only their buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.months import absolute_error


class MissingImages(ValueError):
    """Rows without an image: how many, and the first of their ids."""

    def __init__(self, count: int, ids: list[int | None]):
        self.count, self.ids = count, ids
        super().__init__(f"{count} rows have no image, first of them ids {', '.join(map(str, ids))}")


def write_images(images: DataFrame, name: str, buckets: int, path: str | None = None) -> DataFrame:
    """Writes images (id and others) as the table `name`, in so many buckets by id, sorted in each; null ids, which no row can ask for, are left out."""
    writer = images.filter("id IS NOT NULL").repartition(buckets, "id").write.mode("overwrite").bucketBy(buckets, "id").sortBy("id")
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return images.sparkSession.table(name)


def check_images(rows: DataFrame, images: DataFrame, shown: int = 5) -> None:
    """Fails with MissingImages if a row has no image of its id; a null id has none. Reads ids only."""
    known = images.select("id").distinct()
    lost = rows.select("id").join(known, "id", "left_anti")
    counted = lost.agg(F.count(F.lit(1)).alias("n")).first().n
    if counted:
        raise MissingImages(counted, [r.id for r in lost.orderBy(F.col("id").asc_nulls_last()).limit(shown).collect()])


def with_their_images(rows: DataFrame, images: DataFrame) -> DataFrame:
    """rows with the columns of their images; fails with MissingImages before any image is read if one is missing."""
    check_images(rows, images)
    return rows.hint("shuffle_merge").join(images, "id")


def only(images: DataFrame, ids: list[int]) -> DataFrame:
    """The images of a few ids: the filter reaches the scan, which opens only their buckets."""
    return images.filter(F.col("id").isin(ids)) if ids else images.limit(0)


def worst_with_images(predictions: DataFrame, images: DataFrame, n: int = 5, error: Column | None = None) -> DataFrame:
    """The n rows of the greatest errors (ties: smallest id), with rank and their images. predictions: id, target, pred and others.

    The n are found on predictions alone, a few from each partition; only then are images read, of these ids only. A
    missing image is an error. Rows without an error (null or NaN) are never among the worst.
    """
    spark: SparkSession = predictions.sparkSession
    err = absolute_error(F.col("pred"), F.col("target")) if error is None else error
    ranked = predictions.withColumn("err", err).filter("err IS NOT NULL AND NOT isnan(err)").orderBy(F.desc("err"), "id").limit(n)
    top = ranked.collect()  # n rows
    named = spark.createDataFrame([(*r, k) for k, r in enumerate(top, 1)], StructType([*ranked.schema.fields, StructField("rank", IntegerType())]))
    few = only(images, [r.id for r in top])
    check_images(named, few, n)
    return few.join(F.broadcast(named), "id").select(*named.columns, *[c for c in images.columns if c != "id"])
