"""The result history of a session: consecutive repeats skipped, newest first, capped."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CAP, SHOWN = 20, 8


def since_clear(log: DataFrame) -> DataFrame:
    """The entries after a session's last clear event."""
    later = Window.partitionBy("session_id").orderBy(F.desc("ts"), F.desc("event_id")).rowsBetween(Window.unboundedPreceding, 0)  # newest first: a running maximum
    return log.withColumn("__clear", F.max(F.col("is_clear").cast("int")).over(later)).filter("__clear = 0").drop("__clear")


def history(log: DataFrame, cap: int = CAP) -> DataFrame:
    """The newest `cap` entries of each session with place rn from 1. log: session_id, ts, event_id, months_total.

    An entry whose months_total equals that of the one before it is skipped, whatever else it holds.
    """
    session = Window.partitionBy("session_id")
    old = F.lag("months_total").over(session.orderBy("ts", "event_id"))
    fresh = log.withColumn("__old", old).filter(F.col("__old").isNull() | (F.col("__old") != F.col("months_total"))).drop("__old")
    return fresh.withColumn("rn", F.row_number().over(session.orderBy(F.desc("ts"), F.desc("event_id")))).filter(F.col("rn") <= cap)
