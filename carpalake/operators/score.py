"""Scoring of images with a pluggable model, and the analysis of its results.

A scorer is made once per Python worker batch stream from a factory, so a model loads once and
serves many batches; only image preparation and scoring leave the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.months import age_months, age_years, clip_months, denormalize, status_float, status_integer
from . import images
from .cohort import one_row

META_WIDTH = 1
BOX = ("x0", "y0", "x1", "y1")


class Scorer(Protocol):
    meta_width: int

    def __call__(self, image: np.ndarray, meta: np.ndarray) -> np.ndarray:
        """image: (n, 3, size, size), which is filled anew after the call; meta: (n, meta_width). n normalized ages."""


class MeanPixelScorer:
    """A stand-in for tests: a fixed function of the mean pixel and the sex."""

    meta_width = META_WIDTH

    def __call__(self, image: np.ndarray, meta: np.ndarray) -> np.ndarray:
        return image.mean(axis=(1, 2, 3)) + 0.25 * meta[:, 0]


class OnnxScorer:
    """A model file with the inputs image and meta, on one thread per worker."""

    def __init__(self, path: str):
        import onnxruntime

        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = 1
        self.session = onnxruntime.InferenceSession(path, options, providers=["CPUExecutionProvider"])
        self.meta_width = {i.name: i.shape for i in self.session.get_inputs()}["meta"][1]

    def __call__(self, image: np.ndarray, meta: np.ndarray) -> np.ndarray:
        return self.session.run(None, {"image": image, "meta": meta})[0].ravel()


def checked_model(path: str, least: int = 100_000) -> str:
    """The path of a model file that is large enough to be one."""
    import os

    if (found := os.path.getsize(path)) < least:
        raise ValueError(f"{path} has {found} bytes; a model has {least} at least")
    return path


Box = tuple[int, int, int, int]


def _scored(scorer: Scorer, rows: list[tuple], crop: bool, room: np.ndarray) -> tuple[list[float | None], list[str | None], list[Box | None]]:
    """z, error and the box used of rows (male, height, width, channels, data). Whatever fails on a row becomes that row's error. room: for so many images."""
    metas, good, z, errors, boxes = [], [], [None] * len(rows), [None] * len(rows), [None] * len(rows)
    for j, (male, *picture) in enumerate(rows):
        try:
            if picture[-1] is None:
                raise ValueError("no image, or none that can be decoded")
            img = images.to_rgb(images.decode(*picture))
            boxes[j] = images.crop_box(img) if crop else (0, 0, img.shape[1], img.shape[0])
            x0, y0, x1, y1 = boxes[j]
            images.tensor(img[y0:y1, x0:x1], room.shape[-1], room[len(good)])
            metas.append(images.meta(male))
            good.append(j)
        except Exception as e:  # noqa: BLE001
            errors[j] = str(e)[:200] or type(e).__name__
    if good:
        try:
            for j, v in zip(good, scorer(room[: len(good)], np.stack(metas)), strict=True):
                z[j] = float(v)
        except Exception as e:  # noqa: BLE001
            if len(rows) == 1:
                errors[0] = str(e)[:200] or type(e).__name__
            else:  # find the rows that the scorer can't take
                for j in good:
                    (z[j],), (errors[j],), _ = _scored(scorer, [rows[j]], crop, room)
    return z, errors, boxes


def score(requests: DataFrame, factory: Callable[[], Scorer], crop: bool, size: int = images.SIZE, batch: int = 16, carry: tuple[str, ...] = ("id",)) -> DataFrame:
    """The columns in carry as they are, z, error, and the box of the image that was scored (x0, y0, x1, y1); one row per row of requests, whatever its id.

    requests: id, male, height, width, channels, data.
    """
    kinds = dict(requests.dtypes)
    inputs = [F.col(c).alias(f"c{i}") for i, c in enumerate(carry)] + [F.col(c) for c in ("male", "height", "width", "channels", "data")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = factory()
        if scorer.meta_width != META_WIDTH:
            raise ValueError(f"the scorer takes {scorer.meta_width} values beside an image; there is {META_WIDTH}")
        n, room = len(carry), np.empty((batch, 3, size, size), np.float32)
        for whole in batches:
            for i in range(0, whole.num_rows, batch):
                part = whole.slice(i, batch)
                z, errors, boxes = _scored(scorer, list(zip(*(c.to_pylist() for c in part.columns[n:]), strict=True)), crop, room)
                edges = [pa.array([b and b[e] for b in boxes], pa.int32()) for e in range(4)]
                yield pa.record_batch([*part.columns[:n], pa.array(z, pa.float64()), pa.array(errors, pa.string()), *edges], [*part.schema.names[:n], "z", "error", *BOX])

    out = requests.select(*inputs).mapInArrow(run, ", ".join([f"c{i} {kinds[c]}" for i, c in enumerate(carry)] + ["z double", "error string"] + [f"{c} int" for c in BOX]))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], "z", "error", *BOX)


def by_content(factory: Callable[[], Scorer], crop: bool = True, size: int = images.SIZE) -> Callable[[DataFrame], DataFrame]:
    """The scorer of images that sessions take: digest, male and an image to digest, male, z and error."""
    return lambda named: score(named, factory, crop, size, carry=("digest", "male")).select("digest", "male", "z", "error")


def predict(requests: DataFrame, stats: DataFrame, factory: Callable[[], Scorer], size: int = images.SIZE) -> DataFrame:
    """The batch form: no crop, float status. requests also has ic_months; stats has one row."""
    done = score(requests, factory, crop=False, size=size, carry=("id", "ic_months")).crossJoin(F.broadcast(one_row(stats)))
    x = clip_months(denormalize(F.col("z"), F.col("boneage_mean"), F.col("boneage_std")))
    x, ic = F.col("bone_age_meses"), done.withColumn("bone_age_meses", x)
    return ic.select(
        "id", "bone_age_meses", age_years(x).alias("bone_age_anos"), age_months(x).alias("bone_age_meses_r"), (x - F.col("ic_months")).alias("delta_meses"), status_float(x, F.col("ic_months")).alias("status"), "error"
    )


def analyze(requests: DataFrame, stats: DataFrame, factory: Callable[[], Scorer], size: int = images.SIZE) -> DataFrame:
    """The interactive form: cropped (with the box used, for a preview), integer status, an age that may be unknown."""
    done = score(requests, factory, crop=True, size=size, carry=("id", "male", "ic_months")).crossJoin(F.broadcast(one_row(stats)))
    done = done.withColumn("months_total", clip_months(denormalize(F.col("z"), F.col("boneage_mean"), F.col("boneage_std"))))
    x = F.col("months_total")
    return done.select("id", "male", age_years(x).alias("years"), age_months(x).alias("months"), "months_total", status_integer(x, F.col("ic_months")).alias("status"), "error", *BOX)
