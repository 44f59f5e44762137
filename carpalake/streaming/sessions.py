"""Sessions over a stream: scores are kept in a table and worked out once, keyed state holds the image at hand of each session."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import sessions

LOG = "session_id long, ts timestamp, event_id long, digest string, male int, is_clear boolean"
ANSWERS = LOG + ", z double, error string"


def _scores(spark: SparkSession, path: str) -> DataFrame:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
    kept = sessions.KNOWN + ", batch LONG"
    return spark.read.schema(kept).parquet(path) if there else spark.createDataFrame([], kept)


def known_scores(spark: SparkSession, path: str) -> DataFrame:
    """The table of scores in a folder that answers() writes; empty before its first batch."""
    return _scores(spark, path).drop("batch")


def answers(log: DataFrame, images: DataFrame, score: Callable[[DataFrame], DataFrame], scores: str, out: str) -> DataStreamWriter:
    """Scores what each batch of a streaming log asks for and `scores` hasn't, keeps it there, and writes the log with its answers (ANSWERS) to `out`.

    Both are Parquet folders with a part for each batch, which a batch that is run again replaces. images and score: as in sessions.score_unknown().
    """

    def batch(df: DataFrame, number: int) -> None:
        spark, mine = df.sparkSession, f"batch={number}"
        earlier = _scores(spark, scores).filter(F.col("batch") != number)  # of other batches, if this one is run again
        fresh = sessions.score_unknown(sessions.unknown(df, earlier), images, score)
        fresh.write.mode("overwrite").parquet(f"{scores}/{mine}")
        sessions.answered(df, known_scores(spark, scores)).write.mode("overwrite").parquet(f"{out}/{mine}")

    return log.writeStream.foreachBatch(batch)


SHOWN = "session_id long, ts timestamp, event_id long, digest string, male int, is_clear boolean, image string, scored_male int, z double, error string, fresh boolean"
STATE = "image string, scored_male int, z double, error string"


def _none(v: object) -> object:
    return None if v is None or v != v or v is pd.NaT else v


def _draw(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    at_hand = state.get if state.exists else (None, None, None, None)
    rows = []
    for r in pd.concat(list(frames)).sort_values(["ts", "event_id"]).itertuples():
        given = _none(r.digest) is not None
        if given:  # a new image drops the result
            at_hand = (r.digest, None if _none(r.male) is None else int(r.male), _none(r.z), _none(r.error))
        rows.append((key[0], r.ts, r.event_id, _none(r.digest), _none(r.male), r.is_clear, *at_hand, given))
    state.update(at_hand)
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in SHOWN.split(", ")])
    yield out.astype({"male": "Int32", "scored_male": "Int32"})


def shown(answers: DataFrame) -> DataFrame:
    """What each row of a stream of ANSWERS shows (SHOWN), as sessions.shown() has it; state per session is its image's digest and its result.

    Rows of a trigger are taken in the order of ts; rows that come in a later trigger follow those of earlier ones.
    """
    return answers.groupBy("session_id").applyInPandasWithState(_draw, SHOWN, STATE, "append", GroupStateTimeout.NoTimeout)
