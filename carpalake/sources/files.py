"""Readers and writers of the engine's files."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cohort import one_row
from ..schemas import COHORT_CSV, STATS


def read_cohort(spark: SparkSession, path: str) -> DataFrame:
    """A cohort CSV with a header of any case and order. All columns are read as text, so that True and 1 both survive; clean() casts them."""
    df = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    df = df.toDF(*[c.strip().lower() for c in df.columns])
    return df.withColumns({"id": F.col("id").cast("bigint"), "boneage": F.col("boneage").cast("double")}) if {"id", "boneage"} <= {*df.columns} else df


def read_images(spark: SparkSession, path: str, by_name: bool = True, pattern: str = "*", keep_invalid: bool = False) -> DataFrame:
    """id (the file name's number, where by_name), origin, height, width, channels, data in RGB order.

    Files that are no images are dropped; keep_invalid keeps them with null data.

    Spark's reader gives three channels as BGR and four as BGRA; the kernels turn them, transform() only reads them.
    """
    df = spark.read.format("image").option("dropInvalid", not keep_invalid).option("pathGlobFilter", pattern).load(path).select("image.*")
    id_ = F.regexp_extract("origin", r"(\d+)\.(?:png|jpe?g)$", 1)
    df = df.withColumn("id", F.when(id_ != "", id_.cast("bigint"))) if by_name else df.withColumn("id", F.xxhash64("origin"))
    return df.select("id", "origin", "height", "width", F.col("nChannels").alias("channels"), F.when(F.col("height") > 0, F.col("data")).alias("data"))


def bgr_to_rgb(images: DataFrame) -> DataFrame:
    from ..operators.images import decode

    @F.pandas_udf("binary")
    def turn(h: pd.Series, w: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([x if n == 1 or x is None else decode(a, b, n, x)[:, :, 2::-1].tobytes() for a, b, n, x in zip(h, w, c, d, strict=True)])

    return images.withColumn("data", turn("height", "width", "channels", "data")).withColumn("channels", F.when(F.col("channels") == 4, 3).otherwise(F.col("channels")))


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{png,jpg,jpeg}").load(path).select("path", "length", "content")


def decode_uploads(spark: SparkSession, path: str) -> DataFrame:
    """Uploads as image rows (id from the path's hash, height, width, channels, data in RGB order); files that are no images are dropped."""
    return bgr_to_rgb(read_images(spark, path, by_name=False, pattern="*.{png,jpg,jpeg}")).select("id", "origin", "height", "width", "channels", "data")


def preferred(pasted: Column, uploaded: Column) -> Column:
    """A pasted image goes before an uploaded one."""
    return F.coalesce(pasted, uploaded)


def missing_images(cohort: DataFrame, images: DataFrame) -> DataFrame:
    """Rows of the cohort without an image of their id."""
    return cohort.join(images.select("id"), "id", "left_anti")


def with_images(cohort: DataFrame, images: DataFrame, how: str = "inner") -> DataFrame:
    """Rows of the cohort with the image of their id; how: inner leaves those without one out, left keeps them with nulls."""
    return cohort.join(images, "id", how)


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).schema(STATS).json(path)


def write_stats(stats: DataFrame, path: str) -> None:
    """The one row of stats as an indented JSON file, through the session's file system."""
    spark = stats.sparkSession
    jvm, text = spark.sparkContext._jvm, json.dumps(stats.first().asDict(), indent=2)
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(text.encode()))
    out.close()


def stage_file(spark: SparkSession, source: str, target: str, least: int = 100_000) -> str:
    """A copy of source at target, in chunks through the session's file systems (http and https are read, too); a file that is too short is deleted again."""
    fs, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    a, b = fs.Path(source), fs.Path(target)
    there = b.getFileSystem(conf)
    fs.FileUtil.copy(a.getFileSystem(conf), a, there, b, False, True, conf)
    if (found := there.getFileStatus(b).getLen()) < least:
        there.delete(b, False)
        raise ValueError(f"{source} has {found} bytes, fewer than {least}")
    return target


def write_best(best: DataFrame, stats: DataFrame, path: str) -> None:
    """The rows of the best epochs, each with the statistics it was trained under, replacing what the path had (BestEpochs commits versions instead). best mustn't read from path."""
    best.crossJoin(F.broadcast(one_row(stats))).write.mode("overwrite").partitionBy("run_id").parquet(path)


__all__ = ["COHORT_CSV", "bgr_to_rgb", "decode_uploads", "missing_images", "preferred", "read_cohort", "read_images", "read_stats", "read_uploads", "stage_file", "with_images", "write_best", "write_stats"]
