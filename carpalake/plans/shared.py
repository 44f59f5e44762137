"""State that several jobs read, kept where all executors see it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder: the cluster's spark.checkpoint.dir. Only a session in one process gets a temporary folder where it names none."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc._jsc.sc().isLocal():
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="carpalake-"))
    return sc._jsc.sc().getCheckpointDir().get()


class Rounds:
    """Tables in the shared folder, for loops whose rounds read what the round before left.

    Written and read again, so that a lost executor costs no earlier round, and sizes are those of files (a plan's own estimates grow with each join of each round).
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.made = spark, f"{shared_folder(spark)}/rounds-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.made += 1
        path = f"{self.folder}/{self.made}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self, n: int | None = None) -> None:
        """Removes the n-th table, or all."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder if n is None else f"{self.folder}/{n}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def kept(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder; what led to it isn't computed again if an executor is lost."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
