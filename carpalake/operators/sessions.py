"""The state of analysis sessions: the image at hand and its result, which is computed once.

A session's log has a row for each time its page is drawn: the image that was given then (by its digest; null: none), the
sex chosen, and whether the history is cleared. A given image drops the result at hand and is analyzed with the sex of that row. Rows
after it show that result, or its error, until the next image, whatever sex is chosen meanwhile.

Scores are kept by content: unknown() says what is asked for and isn't known yet, once for all sessions, and score_unknown()
scores just that. An image that comes again, in any session, is looked up.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import history

ORDER = ("ts", "event_id")
KNOWN = "digest STRING, male INT, z DOUBLE, error STRING"


def digest(height: Column, width: Column, channels: Column, data: Column) -> Column:
    """The name of an image by its content: its shape and its pixels."""
    shape = F.concat_ws("x", height.cast("string"), width.cast("string"), channels.cast("string"))
    return F.sha2(F.concat(F.encode(shape, "utf-8"), F.unhex(F.lit("00")), data), 256)


def _same_key(a: str, b: str) -> Column:
    return (F.col(f"{a}.digest") == F.col(f"{b}.digest")) & F.col(f"{a}.male").eqNullSafe(F.col(f"{b}.male"))


def unknown(log: DataFrame, known: DataFrame) -> DataFrame:
    """digest, male: what a log asks for and known hasn't; each once."""
    asked = log.filter("digest IS NOT NULL").select("digest", F.col("male").cast("int").alias("male")).distinct()
    return asked.alias("a").join(known.alias("k"), _same_key("a", "k"), "left_anti")


def score_unknown(wanted: DataFrame, images: DataFrame, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows for known: what is wanted, scored once each. A digest without an image is an error of its row.

    images: image_id, digest and the image; of several images of one digest one is read, chosen on the narrow columns.
    score: takes digest, male and the image's columns, gives digest, male, z and error.
    """
    first = images.groupBy("digest").agg(F.min("image_id").alias("image_id"))
    named = wanted.join(first, "digest", "left")
    held = images.join(named.filter("image_id IS NOT NULL"), ["digest", "image_id"]).drop("image_id")
    lost = named.filter("image_id IS NULL").select("digest", "male", F.lit(None).cast("double").alias("z"), F.lit("no image has this digest").alias("error"))
    return score(held).select("digest", "male", "z", "error").unionByName(lost)


def answered(log: DataFrame, known: DataFrame) -> DataFrame:
    """log with z and error of the rows that give an image; fails on one that isn't known."""
    k = known.select("digest", "male", "z", "error", F.lit(True).alias("there")).alias("k")
    both = log.alias("l").join(k, _same_key("l", "k"), "left")
    missing = F.col("l.digest").isNotNull() & F.col("k.there").isNull()
    checked = F.when(missing, F.raise_error(F.concat(F.lit("not scored yet: "), F.col("l.digest")))).otherwise(F.col("k.error"))
    return both.select("l.*", F.col("k.z").alias("z"), checked.alias("error"))


def shown(answers: DataFrame) -> DataFrame:
    """What each row of a log shows: its columns, with image, scored_male, z and error of the image at hand, and fresh, whether it was analyzed in this row. answers: from answered()."""
    until = Window.partitionBy("session_id").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    given = F.struct(F.col("digest").alias("image"), F.col("male").alias("scored_male"), "z", "error")
    at_hand = answers.withColumn("at_hand", F.last(F.when(F.col("digest").isNotNull(), given), ignorenulls=True).over(until))
    own = [F.col(c) for c in answers.columns if c not in ("z", "error")]
    return at_hand.select(*own, "at_hand.*", F.col("digest").isNotNull().alias("fresh"))


def session_history(answers: DataFrame, cap: int = history.CAP, months: Column | None = None) -> DataFrame:
    """The history that each session's log leaves, newest first: an entry for each analysis that didn't fail, without consecutive repeats, since the last clearing.

    answers also has is_clear: the history is emptied at that row, before what the row analyzes is entered. months: what is entered (z, if not given).
    """
    entries = answers.withColumn("entered", F.col("digest").isNotNull() & F.col("z").isNotNull()).filter("entered OR is_clear")
    later = Window.partitionBy("session_id").orderBy(*[F.desc(c) for c in ORDER]).rowsBetween(Window.unboundedPreceding, -1)
    cleared = F.coalesce(F.max(F.col("is_clear").cast("int")).over(later), F.lit(0))
    live = entries.withColumn("cleared", cleared).filter("entered AND cleared = 0")
    return history.history(live.select("session_id", *ORDER, (F.col("z") if months is None else months).alias("months_total"), F.col("male").alias("scored_male"), F.col("digest").alias("image")), cap)
