"""Queries of mergeable statistics: the study arrives in parts, of which each keeps its own state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import moments
from . import queries
from .registry import register
from .study import STUDY_SQL, study

PARTS = 31  # days


@register(f"WITH {STUDY_SQL} SELECT male, count(*) AS n, round(avg(boneage), 9) AS mean, round(stddev_samp(boneage), 9) AS std FROM study GROUP BY male")
def merged_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By sex, from the states of its parts."""
    parts = study(spark, sf_dir).withColumn("day", F.col("id") % PARTS)
    whole = moments.merged(moments.state(parts, F.col("boneage"), "day", "male"), "male")
    return whole.select("male", "n", F.round("mean", 9).alias("mean"), F.round(moments.deviation(F.col("n"), F.col("m2")), 9).alias("std"))


@register(queries.ORACLES["train_stats"])
def train_stats_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training statistics from the states of the train split's parts."""
    train = queries.parted(spark, sf_dir).filter("split = 'train'").withColumn("day", F.col("id") % PARTS)
    whole = moments.merged(moments.state(train, F.col("boneage"), "day"))
    s = moments.stats(whole, whole)
    return s.select(*[F.round(c, 9).alias(c) for c in s.columns])
