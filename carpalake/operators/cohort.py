"""Cleaning, guarding and describing a cohort table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import MONTHS_MAX, MONTHS_MIN

#: Upper edges of the right-closed stratification bins (0, 60], (60, 120], (120, 180], (180, 229].
BIN_EDGES = (0, 60, 120, 180, 229)


def normalize_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().lower() for c in df.columns])


def require(df: DataFrame, columns: tuple[str, ...] = ("boneage", "male")) -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def clean(df: DataFrame) -> DataFrame:
    """male as 0 or 1 (an error where it is null), boneage as double, rows without boneage dropped, and its copy as age proxy."""
    df = require(normalize_names(df))
    male = F.col("male") if dict(df.dtypes)["male"] == "boolean" else F.col("male").cast("string").cast("boolean")
    male = F.when(male.isNull(), F.raise_error(F.lit("male is null"))).otherwise(male.cast("int"))
    age = F.col("boneage").cast("double")
    return df.withColumns({"male": male, "boneage": F.when(~F.isnan(age), age)}).na.drop(subset=["boneage"]).withColumn("boneage_ic", F.col("boneage"))


def out_of_range(age: Column) -> Column:
    return ~F.isnan(age) & ((age < MONTHS_MIN) | (age > MONTHS_MAX))


def offenders(df: DataFrame, n: int = 5, age: str = "boneage") -> DataFrame:
    """The first n rows by id whose age is out of range, each with the number of all of them."""
    bad = df.filter(out_of_range(F.col(age)))
    count = bad.agg(F.count(F.lit(1)).alias("n_bad"))
    return bad.orderBy("id").limit(n).select("id", age).crossJoin(F.broadcast(count))  # one row


def guard(df: DataFrame, age: str = "boneage") -> DataFrame:
    """df, whose evaluation fails on a row out of range."""
    bad = out_of_range(F.col(age))
    return df.withColumn(age, F.when(bad, F.raise_error(F.concat(F.lit("age out of range: "), F.col(age).cast("string")))).otherwise(F.col(age)))


def stratum_bin(age: Column) -> Column:
    """0 to 3 by right-closed bins; null outside."""
    out = F.when(age <= BIN_EDGES[0], None)
    for i, edge in enumerate(BIN_EDGES[1:]):
        out = out.when(age <= edge, i)
    return out


def stratum_key(male: Column, age: Column) -> Column:
    return F.concat_ws("_", male.cast("string"), F.coalesce(stratum_bin(age).cast("string"), F.lit("nan")))


def image_path(folder: str, id_: Column) -> Column:
    return F.concat(F.lit(folder.rstrip("/") + "/"), id_.cast("bigint").cast("string"), F.lit(".png"))


def summary(df: DataFrame, age: str = "boneage") -> DataFrame:
    x = F.col(age)
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.min(x).alias("min_age"), F.max(x).alias("max_age"), F.avg(x).alias("mean_age"), F.round(F.stddev_samp(x), 6).alias("std_age"))


def value_counts(df: DataFrame, column: str = "male") -> DataFrame:
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def null_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in columns or df.columns])


def fit_stats(df: DataFrame, age: str = "boneage", proxy: str = "boneage_ic") -> DataFrame:
    """Mean and sample standard deviation of the rows of the train split; one row."""
    train = df.filter("split = 'train'")
    return train.agg(*[f(F.col(c)).alias(f"{name}_{stat}") for c, name in ((age, "boneage"), (proxy, "idade_cron")) for f, stat in ((F.avg, "mean"), (F.stddev_samp, "std"))])


def one_row(stats: DataFrame) -> DataFrame:
    """stats, whose evaluation fails unless it has exactly one row."""
    whole = stats.agg(*[F.first(c).alias(c) for c in stats.columns], F.count(F.lit(1)).alias("__rows"))
    return whole.filter(F.assert_true(F.col("__rows") == 1, F.lit("statistics must have one row")).isNull()).drop("__rows")
