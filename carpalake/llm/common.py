"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_checkpoints(spark: SparkSession) -> str:
    """The session's checkpoint folder: the cluster's spark.checkpoint.dir. Only a session in one process gets a temporary folder where it names none."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc._jsc.sc().isLocal():
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="carpalake-"))
    return sc._jsc.sc().getCheckpointDir().get()


class Scratch:
    """Tables written into the shared checkpoint folder, to be cleared when nothing reads them any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, f"{shared_checkpoints(spark)}/{name}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def clear(self, name: str = "") -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}".rstrip("/"))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared checkpoint folder, so that lost executors cost no recomputation of what led to it."""
    shared_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def sized(df: DataFrame, rows: int, each: int = 100_000) -> DataFrame:
    """df, of about so many rows, in as many partitions as they need and no more than it has."""
    return df.coalesce(max(1, -(-rows // each)))


def only_kept(docs: DataFrame, groups: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs whose id and hash of the text are those of a kept row of groups (id_col, tag, kept)."""
    kept = groups.filter("kept").select(F.col(id_col).alias("id"), "tag").distinct().alias("kept")
    same = F.col(f"docs.`{id_col}`").eqNullSafe(F.col("kept.id")) & (F.xxhash64(F.coalesce(F.col(f"docs.`{text_col}`"), F.lit(""))) == F.col("kept.tag"))
    return docs.alias("docs").join(kept, same, "left_semi")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def release() -> None:
    """Hand the memory that Arrow and the C library have kept back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """batches, and release() at their end, for the worker may idle or do other work next."""
    yield from batches
    release()
