"""A model that travels with the job and is loaded once in each worker process.

Spark's file server hands a model's file to each executor, under a name that has the digest of its bytes, so that no path must be
there beforehand and two models of one name don't meet. A worker process keeps its scorer by that digest and takes it for all tasks it
runs; another model, or a changed one, is another digest.
"""

from __future__ import annotations

import hashlib
import shutil
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark import SparkFiles
from pyspark.sql import SparkSession

from .score import OnnxScorer, Scorer, checked_model

_loaded: dict[str, Scorer] = {}  # of this process
HELD = 4  # scorers that a process keeps


def digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


class ShippedModel:
    """A factory of scorers for predict(), analyze(), score() and by_content(): the process's own, made from the shipped file when first asked for."""

    def __init__(self, spark: SparkSession, path: str, load: Callable[[str], Scorer] = OnnxScorer, least: int = 100_000):
        """path: of the model file, on the driver. load: makes a scorer from a file; workers must be able to unpickle it."""
        self.key, self.load = digest(checked_model(path, least)), load
        self.name = f"{self.key}{Path(path).suffix}"
        if self.name not in getattr(spark.sparkContext, "carpalake_models", set()):
            target = Path(tempfile.mkdtemp(prefix="carpalake-model-")) / self.name  # Spark takes it from here to its own server
            shutil.copyfile(path, target)
            spark.sparkContext.addFile(str(target))
            spark.sparkContext.carpalake_models = getattr(spark.sparkContext, "carpalake_models", set()) | {self.name}

    def __call__(self) -> Scorer:
        if self.key not in _loaded:
            while len(_loaded) >= HELD:
                _loaded.pop(next(iter(_loaded)))
            _loaded[self.key] = self.load(SparkFiles.get(self.name))
        return _loaded[self.key]
