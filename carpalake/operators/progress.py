"""Best-so-far and early stopping over epochs, as windows per run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def early_stop(metrics: DataFrame, patience: int = 7) -> DataFrame:
    """The epochs that run, each with improved, best so far (with its epoch) and the epochs waited since.

    An improvement is strict. A null or NaN error is none, and is never a best; a run without any other has no best.
    """
    run = Window.partitionBy("run_id").orderBy("epoch")
    before, until = run.rowsBetween(Window.unboundedPreceding, -1), run.rowsBetween(Window.unboundedPreceding, 0)
    error = F.when(~F.isnan("val_mae"), F.col("val_mae"))
    best = F.min(error).over(before)
    improved = error.isNotNull() & (best.isNull() | (error < best))
    marked = metrics.withColumn("improved", improved).withColumn("row", F.row_number().over(run))
    marked = marked.withColumn("waited", F.col("row") - F.coalesce(F.max(F.when(F.col("improved"), F.col("row"))).over(until), F.lit(0)))
    marked = marked.withColumn("best_mae", F.min(error).over(until)).withColumn("best_epoch", F.max(F.when(F.col("improved"), F.col("epoch"))).over(until))
    stops = F.max((F.col("waited") >= patience).cast("int")).over(before)
    return marked.withColumn("stopped", F.coalesce(stops, F.lit(0))).filter("stopped = 0").drop("stopped", "row")


def best_epoch(metrics: DataFrame, patience: int = 7) -> DataFrame:
    ran = early_stop(metrics, patience)
    return ran.groupBy("run_id").agg(F.max("epoch").alias("last_epoch"), F.min("best_mae").alias("best_mae"), F.max("best_epoch").alias("best_epoch"))


def best_rows(metrics: DataFrame, patience: int = 7) -> DataFrame:
    """The whole row of metrics of each run's best epoch among those that ran; of equal errors, the first. A run without a best has none."""
    best = best_epoch(metrics, patience).select("run_id", F.col("best_epoch").alias("epoch"))
    return metrics.join(best, ["run_id", "epoch"])
