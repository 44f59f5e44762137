"""Errors of predictions: overall, by group, worst cases, parity of two scorers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.months import absolute_error

#: Left-closed evaluation bands; 228 itself is in none.
BAND_EDGES = (0, 60, 120, 180, 228)


def eval_band(target: Column) -> Column:
    out = F.when(target < BAND_EDGES[0], None)
    for lo, hi in zip(BAND_EDGES, BAND_EDGES[1:], strict=False):
        out = out.when(target < hi, f"{lo}-{hi}")
    return out


def align(predictions: DataFrame, targets: DataFrame, id_col: str = "id") -> DataFrame:
    """Predictions beside targets, by id and never by position."""
    return targets.join(predictions, id_col)


def mae_report(df: DataFrame) -> DataFrame:
    """grouping (all, male or band), its value, mae and n, in one pass. df: pred, target, male. Empty groups have no row."""
    marked = df.select(absolute_error(F.col("pred"), F.col("target")).alias("err"), F.col("male"), eval_band(F.col("target")).alias("band"))
    sets = marked.groupingSets([[], ["male"], ["band"]], "male", "band").agg(F.grouping_id().alias("g"), F.avg("err").alias("mae"), F.count("err").alias("n"))
    named = sets.select(
        F.when(F.col("g") == 3, "all").when(F.col("g") == 1, "male").otherwise("band").alias("grouping"),
        F.when(F.col("g") == 1, F.col("male").cast("string")).when(F.col("g") == 2, F.col("band")).alias("value"),
        "mae",
        "n",
    )
    return named.filter((F.col("grouping") == "all") | F.col("value").isNotNull())


def batch_loss(df: DataFrame, batch: Column, loss: Column, *by: str) -> DataFrame:
    """The mean over batches of their mean losses (a short batch counts as much as a full one); by: columns whose values have batches of their own."""
    return df.groupBy(*by, batch.alias("batch")).agg(F.avg(loss).alias("l")).groupBy(*by).agg(F.round(F.avg("l"), 9).alias("loss"))


def worst(df: DataFrame, n: int = 5) -> DataFrame:
    err = absolute_error(F.col("pred"), F.col("target"))
    return df.select("id", "target", "pred", "male", err.alias("err")).orderBy(F.desc("err"), "id").limit(n)


def parity(a: DataFrame, b: DataFrame, tolerance: float = 0.5, id_col: str = "sample_id", value: str = "months") -> DataFrame:
    """max_diff, n and ok of two scorers' results for the same samples."""
    both = a.select(id_col, F.col(value).alias("__a")).join(b.select(id_col, F.col(value).alias("__b")), id_col)
    worst_ = F.max(F.abs(F.col("__a") - F.col("__b")))
    return both.agg(worst_.alias("max_diff"), F.count(F.lit(1)).alias("n"), (worst_ <= tolerance).alias("ok"))


def check_parity(a: DataFrame, b: DataFrame, tolerance: float = 0.5, **names: str) -> float:
    r = parity(a, b, tolerance, **names).first()
    if not r.ok:
        raise ValueError(f"scorers differ by {r.max_diff} months; the limit is {tolerance}")
    return r.max_diff
