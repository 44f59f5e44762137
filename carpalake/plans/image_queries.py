"""Queries of the bucketed image table: the images of the study, and those of its worst cases."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import image_table
from .registry import register
from .shared import shared_folder
from .study import PIXELS_SQL, STUDY_SQL, study, synthetic_images, table

#: The study's rows that have an image among the synthetic ones, and the digest of each image's pixels.
IMAGED_SQL = f"""WITH {STUDY_SQL}, {PIXELS_SQL}, imaged AS (SELECT * FROM study WHERE id IN (SELECT vec_id FROM embeddings)),
    digests AS (SELECT id, sha256(unhex(string_agg(lpad(hex(v), 2, '0'), '' ORDER BY y, x))) AS sha256 FROM pixels GROUP BY id)"""


def image_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The synthetic images as a bucketed table of its own in the shared folder."""
    name = f"images_{uuid.uuid4().hex}"
    return image_table.write_images(synthetic_images(spark, sf_dir), name, int(spark.conf.get("spark.sql.shuffle.partitions")), f"{shared_folder(spark)}/{name}")


def imaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = study(spark, sf_dir).select("id", F.col("boneage").alias("target"), "pred", "male")
    return s.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id")), "id", "left_semi")


@register(f"{IMAGED_SQL} SELECT id, boneage AS target, male, 64 AS height, 64 AS width, sha256 FROM imaged JOIN digests USING (id)")
def image_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with their images; the images aren't shuffled."""
    joined = image_table.with_their_images(imaged(spark, sf_dir), image_bank(spark, sf_dir))
    return joined.select("id", "target", "male", "height", "width", F.sha2("data", 256).alias("sha256"))


@register(f"""{IMAGED_SQL}, top AS (SELECT id, boneage AS target, pred, male, abs(pred - boneage) AS err FROM imaged ORDER BY err DESC, id LIMIT 5)
    SELECT id, target, pred, male, err, row_number() OVER (ORDER BY err DESC, id)::INTEGER AS rank, sha256 FROM top JOIN digests USING (id)""")
def worst_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five worst cases with their images."""
    out = image_table.worst_with_images(imaged(spark, sf_dir), image_bank(spark, sf_dir))
    return out.select("id", "target", "pred", "male", "err", "rank", F.sha2("data", 256).alias("sha256"))
