"""The engine's whole flows, from files to results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.months import clip_months, denormalize
from ..operators import cohort, evaluate, score, split
from ..sources import files


def prepare_cohort(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A raw cohort cleaned, guarded, binned and split; and the statistics of its train split."""
    df = cohort.guard(cohort.clean(cohort.require(cohort.normalize_names(raw), ("id", "boneage", "male"))))
    df = df.withColumn("stratum", cohort.stratum_key(F.col("male"), F.col("boneage")))
    done = split.split(df, "stratum")
    return done, cohort.fit_stats(done)


def describe(df: DataFrame) -> dict[str, DataFrame]:
    """The reports on a cohort before training."""
    return {"summary": cohort.summary(df), "sex": cohort.value_counts(df), "nulls": cohort.null_counts(df), "offenders": cohort.offenders(df)}


def validate(part: DataFrame, images: DataFrame, stats: DataFrame, factory: Callable[[], score.Scorer], size: int = score.images.SIZE) -> tuple[DataFrame, DataFrame]:
    """A row for each row of a split: id, male, target, pred and error; and the error report, whose evaluation fails if a row has no prediction.

    A row without an image, or whose image or scoring fails, has an error and no pred.
    """
    requests = files.with_images(part.select("id", "male", F.col("boneage").alias("target")), images, how="left")
    done = score.score(requests, factory, crop=False, size=size, carry=("id", "male", "target")).crossJoin(F.broadcast(cohort.one_row(stats)))
    predicted = done.select("id", "male", "target", clip_months(denormalize(F.col("z"), F.col("boneage_mean"), F.col("boneage_std"))).alias("pred"), "error")
    lost = F.raise_error(F.concat(F.lit("no prediction for id "), F.coalesce(F.col("id").cast("string"), F.lit("null")), F.lit(": "), F.coalesce("error", F.lit("its score is null")))).cast("double")
    return predicted, evaluate.mae_report(predicted.withColumn("pred", F.coalesce("pred", lost)))


def scorer_parity(images: DataFrame, stats: DataFrame, a: Callable[[], score.Scorer], b: Callable[[], score.Scorer], size: int = score.images.SIZE) -> DataFrame:
    """How far two scorers are apart in months on the same images. images: id, male and an image."""

    def months(factory: Callable[[], score.Scorer]) -> DataFrame:
        done = score.score(images, factory, crop=False, size=size).crossJoin(F.broadcast(cohort.one_row(stats)))
        return done.select(F.col("id").alias("sample_id"), clip_months(denormalize(F.col("z"), F.col("boneage_mean"), F.col("boneage_std"))).alias("months"))

    return evaluate.parity(months(a), months(b))


def load_and_prepare(spark: SparkSession, csv: str, stats_path: str) -> DataFrame:
    """Read, prepare, and keep the statistics as a file."""
    done, stats = prepare_cohort(files.read_cohort(spark, csv))
    files.write_stats(stats, stats_path)
    return done
