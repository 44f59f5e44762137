"""Queries of the session state: the events are pages drawn, the embeddings are images of 8 by 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sessions
from .registry import register
from .study import table

LOST = 59  # an image that is given but not there


def small_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, height, width, channels, data, digest: a gray image for each row of embeddings."""
    pixel = lambda e: F.lpad(F.hex(F.pmod(F.floor(e.cast("double") * 1000), F.lit(256))), 2, "0")
    data = F.unhex(F.array_join(F.transform("embedding", pixel), ""))
    made = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("channels"), data.alias("data"))
    return made.withColumn("digest", sessions.digest(*[F.col(c) for c in ("height", "width", "channels", "data")]))


def session_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as pages drawn: every third one gives one of sixty images."""
    i = F.col("event_id")
    number = F.when(i % 3 == 0, F.floor(i / 3) % 60)
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), "ts", "event_id", number.alias("image_id"), (i % 2).cast("int").alias("male"), (i % 97 == 0).alias("is_clear"))
    named = e.join(small_images(spark, sf_dir).filter(F.col("image_id") != LOST).select("image_id", "digest"), "image_id", "left")
    return named.withColumn("digest", F.when(F.col("image_id") == LOST, F.sha2(F.lit("lost"), 256)).otherwise(F.col("digest"))).drop("image_id")


def pixel_mean(images: DataFrame) -> DataFrame:
    """A stand-in scorer of built-in functions: the mean pixel, and something for the sex."""
    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.length("data")), lambda i: F.conv(F.hex(F.substring("data", i, F.lit(1))), 16, 10).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)
    z = total.cast("double") / F.length("data") / 255 + F.col("male") * 0.25
    return images.select("digest", "male", z.alias("z"), F.lit(None).cast("string").alias("error"))


def known_after(spark: SparkSession, sf_dir: str, log: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is scored for the earlier half of a log, then for the rest, and both. The images of the second pass are only those the first hasn't seen."""
    images = small_images(spark, sf_dir)
    none = spark.createDataFrame([], sessions.KNOWN)
    before = sessions.score_unknown(sessions.unknown(log.filter("event_id % 4 < 2"), none), images, pixel_mean)
    now = sessions.score_unknown(sessions.unknown(log, before), images, pixel_mean)
    return before, now, before.unionByName(now)


BYTES_SQL = "list_transform(embedding, lambda e: (floor(e::DOUBLE * 1000)::BIGINT % 256 + 256) % 256)"
LOG_SQL = f"""
    images AS (SELECT vec_id AS image_id, {BYTES_SQL} AS px FROM embeddings WHERE vec_id < 60),
    named AS (SELECT image_id, list_sum(px) AS total, CASE WHEN image_id = {LOST} THEN sha256('lost')
              ELSE sha256('8x8x1'::BLOB || unhex('00' || list_aggregate(list_transform(px, lambda p: lpad(hex(p), 2, '0')), 'string_agg', ''))) END AS digest FROM images),
    log AS (SELECT user_id AS session_id, ts, event_id, digest, (event_id % 2)::INTEGER AS male, event_id % 97 = 0 AS is_clear,
              CASE WHEN image_id <> {LOST} THEN total::DOUBLE / 64 / 255 + (event_id % 2) * 0.25::DOUBLE END AS z,
              CASE WHEN image_id = {LOST} THEN 'no image has this digest' END AS error
            FROM events LEFT JOIN named ON image_id = CASE WHEN event_id % 3 = 0 THEN (event_id // 3) % 60 END)"""


@register(f"""WITH {LOG_SQL}, a AS (SELECT *, max(CASE WHEN digest IS NOT NULL THEN row_number END) OVER (PARTITION BY session_id ORDER BY row_number) AS given FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) AS row_number FROM log))
    SELECT a.session_id, a.event_id, b.digest AS image, b.male AS scored_male, b.z, b.error, a.digest IS NOT NULL AS fresh FROM a LEFT JOIN a b ON b.session_id = a.session_id AND b.row_number = a.given""")
def session_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each page drawn shows; each image is scored once with each sex."""
    log = session_log(spark, sf_dir)
    return sessions.shown(sessions.answered(log, known_after(spark, sf_dir, log)[2])).select("session_id", "event_id", "image", "scored_male", "z", "error", "fresh")


@register(f"WITH {LOG_SQL} SELECT count(digest) AS n_given, count(DISTINCT (digest, male)) FILTER (digest IS NOT NULL) AS n_scored, count(DISTINCT (digest, male)) FILTER (digest IS NOT NULL AND event_id % 4 < 2) AS n_scored_before FROM log")
def session_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many images were given, and how many times one was scored."""
    log = session_log(spark, sf_dir)
    before, _, known = known_after(spark, sf_dir, log)
    counts = [log.agg(F.count("digest").alias("n_given")), known.agg(F.count(F.lit(1)).alias("n_scored")), before.agg(F.count(F.lit(1)).alias("n_scored_before"))]
    return counts[0].crossJoin(F.broadcast(counts[1])).crossJoin(F.broadcast(counts[2]))  # one row each


@register(f"""WITH {LOG_SQL}, e AS (SELECT * FROM (SELECT *, coalesce(bool_or(is_clear) OVER (PARTITION BY session_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), false) AS gone FROM log) WHERE NOT gone AND z IS NOT NULL),
    f AS (SELECT * FROM e QUALIFY lag(z) OVER (PARTITION BY session_id ORDER BY ts, event_id) IS NULL OR lag(z) OVER (PARTITION BY session_id ORDER BY ts, event_id) <> z)
    SELECT session_id, event_id, z AS months_total, male AS scored_male, digest AS image, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, event_id DESC)::INTEGER AS rn FROM f QUALIFY rn <= 20""")
def session_results_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = session_log(spark, sf_dir)
    out = sessions.session_history(sessions.answered(log, known_after(spark, sf_dir, log)[2]))
    return out.select("session_id", "event_id", "months_total", "scored_male", "image", "rn")
