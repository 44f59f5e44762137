"""Queries of counter-based samples: a few numbers for each row of the study."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import samples
from .registry import register
from .study import STUDY_SQL, study

SEED, EACH = 42, 4


def _uniform_sql(stream: int) -> str:
    p = samples.PRIME
    return f"""(SELECT (((d * d + d * {samples.FACTORS[3]} + 12345) % {p})::DOUBLE + 0.5::DOUBLE) / {p}.0::DOUBLE FROM (SELECT (c * {samples.FACTORS[2]} + xor(c, {0x2545F491}::BIGINT)) % {p} AS d
        FROM (SELECT (b * b + i * {samples.FACTORS[1]} + {stream + 1}) % {p} AS c FROM (SELECT ((id % {p}) * {samples.FACTORS[0]} + {(SEED * 7919 + stream * 104_729) % p}) % {p} AS b))))"""


@register(f"""WITH {STUDY_SQL}, cells AS (SELECT id, unnest(range({EACH}))::BIGINT AS i FROM study), u AS (SELECT id, i, {_uniform_sql(0)} AS u0, {_uniform_sql(1)} AS u1 FROM cells)
    SELECT id, i::INTEGER AS place, round(sqrt(-2 * ln(u0)) * cos(2 * pi() * u1), 6) AS value FROM u""")
def counter_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four numbers for each row, rounded as engines differ in the last digit of a logarithm."""
    made = samples.normals(study(spark, sf_dir).select("id"), EACH, SEED, "id")
    return made.select("id", F.posexplode("values").alias("place", "v")).select("id", "place", F.round("v", 6).alias("value"))
