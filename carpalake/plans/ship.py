"""Sends this package to the Python workers, for sessions whose executors can't import it by themselves."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parents[1]


def ship(spark: SparkSession) -> None:
    """Once per Spark context: the package as a zip file, through Spark's own file server."""
    sc = spark.sparkContext
    if getattr(sc, "carpalake_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="carpalake-")) / f"{PACKAGE.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for path in sorted(PACKAGE.rglob("*.py")):
            z.write(path, path.relative_to(PACKAGE.parent))
    sc.addPyFile(str(target))
    sc.carpalake_shipped = True


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run
