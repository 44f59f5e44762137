"""Best epochs as a sequence of commits.

A commit adds one folder with the rows of the runs that have improved, and then a numbered file that names all folders of the
new version. That file appears by a rename that fails if another writer has taken the number, so a version is there as a whole or not at all: what a
killed writer leaves is a folder that no version names. The best row of a run is the least of (val_mae, epoch), whatever the order and
number of its appearances, so a batch that is sent again improves nothing and commits nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.cohort import one_row

ATTEMPTS = 20  # of one commit against other writers
WIDTH = 10  # digits of a version's name


class BestEpochs:
    def __init__(self, spark: SparkSession, path: str, fold: int = 20):
        """path: of the folder, on a file system that all executors share. fold: number of folders from which on a commit puts all into one."""
        self.spark, self.path, self.most = spark, path.rstrip("/"), fold
        self.hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self.files = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str) -> Any:
        return self.hadoop.Path(f"{self.path}/{name}".rstrip("/"))

    def _names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return sorted(s.getPath().getName() for s in self.files.listStatus(at)) if self.files.exists(at) else []

    def version(self) -> int:
        """The newest version's number; 0 if there is none."""
        return max((int(n) for n in self._names("versions") if n.isdigit()), default=0)

    def folders(self, version: int | None = None) -> list[str]:
        """The folders of a version, the newest by default."""
        version = self.version() if version is None else version
        if not version:
            return []
        found = self.files.open(self._path(f"versions/{version:0{WIDTH}d}"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(found, "UTF-8"))
        finally:
            found.close()

    def read(self, version: int | None = None) -> DataFrame:
        """The best row of each run in a version, the newest by default. An error if nothing was committed."""
        folders = self.folders(version)
        if not folders:
            raise ValueError(f"{self.path} has no best epochs yet")
        return _best(self.spark.read.option("mergeSchema", True).parquet(*[f"{self.path}/rows/{f}" for f in folders]))

    def commit(self, metrics: DataFrame, stats: DataFrame) -> int | None:
        """The new version's number, or None if no run has improved.

        metrics: run_id, epoch, val_mae and what else a run's best row is to keep, of epochs that ran (progress.early_stop tells which).
        stats: the statistics that these were trained under, of one row. A null or NaN error is never a best; a null run is a run of its own.
        Columns of stats go before those of metrics that have their names.
        """
        clash = [c for c in metrics.columns if c.lower() in {s.lower() for s in stats.columns}]
        best = _best(metrics.drop(*clash)).crossJoin(F.broadcast(one_row(stats)))
        for _ in range(ATTEMPTS):
            version = self.version()
            folders, name = self.folders(version), uuid.uuid4().hex
            improved, seen = best, Observation()
            if folders:
                old = self.read(version).select(F.col("run_id").alias("__run"), F.struct("val_mae", "epoch").alias("__old"))
                both = best.join(old, F.col("run_id").eqNullSafe(F.col("__run")), "left")
                improved = both.filter(F.col("__old").isNull() | (F.struct("val_mae", "epoch") < F.col("__old"))).drop("__run", "__old")
            improved.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{self.path}/rows/{name}")
            if not seen.get["n"]:
                self.files.delete(self._path(f"rows/{name}"), True)
                return None
            folders, made = [*folders, name], [name]
            if len(folders) >= self.most:
                whole = uuid.uuid4().hex
                parts = self.spark.read.option("mergeSchema", True).parquet(*[f"{self.path}/rows/{f}" for f in folders])
                _best(parts).write.parquet(f"{self.path}/rows/{whole}")
                folders, made = [whole], [name, whole]
            if self._publish(version + 1, folders):
                return version + 1
            for lost in made:
                self.files.delete(self._path(f"rows/{lost}"), True)
        raise RuntimeError(f"{self.path}: other writers went before in {ATTEMPTS} attempts")

    def _publish(self, version: int, folders: list[str]) -> bool:
        """Whether the version's file is this one; False if another writer has made it."""
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        rename = getattr(self.hadoop, "Options$Rename")
        options = gateway.new_array(rename, 1)
        options[0] = rename.NONE
        made, target = self._path(f"new/{uuid.uuid4().hex}"), self._path(f"versions/{version:0{WIDTH}d}")
        out = self.files.create(made, False)
        out.write(bytearray(json.dumps(folders).encode()))
        out.close()
        self.files.mkdirs(target.getParent())
        context = self.hadoop.FileContext.getFileContext(self.files.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(self.files.makeQualified(made), self.files.makeQualified(target), options)
        except Py4JJavaError as e:
            self.files.delete(made, False)
            if jvm.java.lang.Class.forName("org.apache.hadoop.fs.FileAlreadyExistsException").isInstance(e.java_exception):
                return False
            raise
        return True

    def sink(self, stats: DataFrame) -> Callable[[DataFrame, int], None]:
        """For foreachBatch on a stream of metrics. A batch that is sent again commits nothing."""

        def keep(batch: DataFrame, _: int) -> None:
            BestEpochs(batch.sparkSession, self.path, self.most).commit(batch, stats)

        return keep

    def sweep(self) -> int:
        """Removes all folders that the newest version doesn't name, and the older versions; gives the number of folders. Only while nobody writes or reads older versions."""
        version = self.version()
        named, gone = set(self.folders(version)), 0
        for name in self._names("versions"):
            if not name.isdigit() or int(name) < version:
                self.files.delete(self._path(f"versions/{name}"), False)
        for name in self._names("rows"):
            if name not in named:
                self.files.delete(self._path(f"rows/{name}"), True)
                gone += 1
        self.files.delete(self._path("new"), True)
        return gone


def _best(rows: DataFrame) -> DataFrame:
    """Of each run, the row with the least error; of equal ones the first epoch, then any one of the rows that repeat it."""
    known = rows.filter(F.col("val_mae").isNotNull() & ~F.isnan("val_mae"))
    least = known.groupBy("run_id").agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), F.struct("val_mae", "epoch")).alias("best"))
    return least.select("best.*")
