"""Stratified, reproducible train, validation and test splits without a global sort.

Rows are dealt in turn to the folds in the order (stratum, hash, id). A row's place in that order
is the number of rows before its bucket, a range of hashes within a stratum, plus its rank in the
bucket. Only buckets are ranked by a window, so no task holds a whole stratum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: An arithmetic hash that any SQL engine can repeat.
PRIME, FACTOR = 1_000_003, 2_654_435_761
BUCKET = 1000


def order_hash(id_: Column) -> Column:
    return F.pmod(F.pmod(id_, F.lit(PRIME)) * FACTOR, F.lit(PRIME))


def ranked(df: DataFrame, stratum: str, id_col: str) -> tuple[DataFrame, Column]:
    """row, the columns of df, whatever their names; and each row's place from 0 on. Null ids and strata are placed like others."""
    placed = df.select(F.struct("*").alias("row"), F.col(stratum).alias("stratum"), F.col(id_col).alias("id"), order_hash(F.col(id_col)).alias("__hash")).withColumn("__bucket", F.floor(F.col("__hash") / BUCKET))
    sizes = placed.groupBy("stratum", "__bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("stratum", "__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("stratum", "__bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")).alias("offsets")  # at most 1002 rows a stratum
    inside = Window.partitionBy("stratum", "__bucket").orderBy("__hash", "id")
    counted = placed.withColumn("__rank", F.row_number().over(inside) - 1).alias("ranked")
    same = [F.col(f"ranked.{c}").eqNullSafe(F.col(f"offsets.{c}")) for c in ("stratum", "__bucket")]
    return counted.join(offsets, same[0] & same[1]).select("row", "before", "__rank"), F.col("before") + F.col("__rank")


def folds(df: DataFrame, stratum: str, k: int = 5, id_col: str = "id") -> DataFrame:
    """df with the column fold, 0 to k - 1; counts per stratum differ by at most one between folds."""
    rows, place = ranked(df, stratum, id_col)
    return rows.select("row.*", (place % k).cast("int").alias("fold"))


def split(df: DataFrame, stratum: str, k: int = 5, id_col: str = "id") -> DataFrame:
    """df with the column split: fold 0 is test; fold 0 of the rest, dealt anew, is val; the rest is train.

    The rest keeps its order, and of the places up to p, p div k + 1 are in fold 0. So one ranking gives both deals.
    """
    rows, p = ranked(df, stratum, id_col)
    again = (p - F.floor(p / k) - 1) % k
    return rows.select("row.*", F.when(p % k == 0, "test").when(again == 0, "val").otherwise("train").alias("split"))
