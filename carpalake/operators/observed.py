"""The description of a cohort as a by-product of writing it.

Counts, ranges and nulls are metrics that Spark observes while rows pass by on their way to the sink, so the cohort is read once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .cohort import out_of_range


def described(df: DataFrame, age: str = "boneage", nulls: list[str] | None = None) -> tuple[DataFrame, Observation]:
    """df, and what is known of it after the first action on it: n_rows, min_age, max_age, mean_age, std_age (sample), n_bad (ages out of range), n_male, n_female, and null_<column> for each column.

    An age that is NaN counts as a number, as in the summary. Only a whole pass fills the metrics: take df to a sink, without a limit.
    """
    seen, x = Observation(), F.col(age)
    metrics = [F.count(F.lit(1)).alias("n_rows"), F.min(x).alias("min_age"), F.max(x).alias("max_age"), F.avg(x).alias("mean_age"), F.stddev_samp(x).alias("std_age"), F.count_if(out_of_range(x)).alias("n_bad")]
    metrics += [F.count_if(F.col("male") == code).alias(name) for code, name in ((1, "n_male"), (0, "n_female"))]
    metrics += [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in nulls or df.columns]
    return df.observe(seen, *metrics), seen


def write_described(df: DataFrame, path: str, age: str = "boneage") -> dict[str, object]:
    """Writes df as Parquet and gives its description, in one pass."""
    observed, seen = described(df, age)
    observed.write.mode("overwrite").parquet(path)
    return seen.get
