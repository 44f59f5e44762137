"""Sessions: one score an image and sex, state by session, and the same from a stream."""

import datetime as dt
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from carpalake.operators import score, sessions
from carpalake.streaming import sessions as stream

LOG = stream.LOG


def scorer(folder):
    """A scorer that notes each image it scores in a folder; workers get it by value."""

    class Counted:
        meta_width = 1

        def __call__(self, image, meta):
            import uuid
            from pathlib import Path

            for _ in image:
                (Path(folder) / uuid.uuid4().hex).touch()
            return image.mean(axis=(1, 2, 3)) + 0.25 * meta[:, 0]

    return Counted


def images(spark, n=6):
    rng = np.random.default_rng(1)
    rows = [(i, 8, 8, 1, bytearray(rng.integers(40, 240, 64).astype(np.uint8).tobytes())) for i in range(n)]
    rows += [(n + i, *rows[i][1:]) for i in range(n)]  # all twice
    rows += [(100, 8, 8, 1, bytearray(b"short")), (101, 4, 16, 1, rows[0][4])]
    df = spark.createDataFrame(rows, "image_id long, height int, width int, channels int, data binary")
    return df.withColumn("digest", sessions.digest(F.col("height"), F.col("width"), F.col("channels"), F.col("data"))).cache()


def log_rows(spark, seed=2, n=200, sexes=(0, 1)):
    names = {r.image_id: r.digest for r in images(spark).collect()}
    assert len(set(names.values())) == 8 and names[0] == names[6] != names[101]
    rng = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    choices = [None] * 12 + [names[i] for i in (0, 1, 2, 3, 6, 7, 100)] + ["not there"]
    return [(rng.randrange(4), start + dt.timedelta(seconds=i // 2), i, rng.choice(choices), rng.choice(sexes), rng.random() < 0.05) for i in range(n)]


def plain(rows, z_of):
    """Row by row, as a page would do it."""
    at_hand, histories, out = {}, {}, {}
    for s, ts, i, digest, male, clear in sorted(rows, key=lambda r: (r[1], r[2])):
        if clear:
            histories[s] = []
        if digest is not None:
            at_hand[s] = (digest, male, *z_of(digest, male))
            z = at_hand[s][2]
            old = histories.setdefault(s, [])
            if z is not None and (not old or old[0][1] != z):
                histories[s] = [(i, z), *old][:20]
        out[i] = (*at_hand.get(s, (None,) * 4), digest is not None)
    return out, {(s, k): e for s, h in histories.items() for k, e in enumerate(h, 1)}


def scores(spark, log, tmp):
    known = spark.createDataFrame([], sessions.KNOWN)
    return sessions.score_unknown(sessions.unknown(log, known), images(spark), score.by_content(scorer(str(tmp)), crop=False, size=8)).persist()


def test_an_image_is_scored_once(spark, tmp_path):
    rows = log_rows(spark)
    log = spark.createDataFrame(rows, LOG).repartition(3)
    (tmp_path / "a").mkdir()
    known = scores(spark, log, tmp_path / "a")
    got = {(r.digest, r.male): (r.z, r.error) for r in known.collect()}
    asked = {(r[3], r[4]) for r in rows if r[3]}
    assert set(got) == asked
    good = [k for k, (z, e) in got.items() if z is not None]
    assert len(list((tmp_path / "a").iterdir())) == len(good) < sum(r[3] is not None for r in rows)
    assert {e for z, e in got.values() if z is None and e} >= {"no image has this digest"}
    assert all((z is None) != (e is None) for z, e in got.values())
    # what is known isn't scored again
    (tmp_path / "b").mkdir()
    assert sessions.score_unknown(sessions.unknown(log, known), images(spark), score.by_content(scorer(str(tmp_path / "b")), crop=False, size=8)).count() == 0
    part = known.filter("male = 1")
    more = sessions.score_unknown(sessions.unknown(log, part), images(spark), score.by_content(scorer(str(tmp_path / "b")), crop=False, size=8)).collect()
    assert {(r.digest, r.male) for r in more} == {k for k in asked if k[1] != 1}


def test_shown_and_history_row_by_row(spark, tmp_path):
    rows = log_rows(spark, sexes=(0, 1, None))  # without a sex, scoring fails
    log = spark.createDataFrame(rows, LOG).repartition(3)
    known = scores(spark, log, tmp_path)
    z_of = {(r.digest, r.male): (r.z, r.error) for r in known.collect()}
    want, want_history = plain(rows, lambda *k: z_of[k])
    answers = sessions.answered(log, known)
    got = {r.event_id: (r.image, r.scored_male, r.z, r.error, r.fresh) for r in sessions.shown(answers).collect()}
    assert got == want
    assert {(r.session_id, r.rn): (r.event_id, r.months_total) for r in sessions.session_history(answers).collect()} == want_history
    assert sessions.shown(answers).columns == ["session_id", "ts", "event_id", "digest", "male", "is_clear", "image", "scored_male", "z", "error", "fresh"]
    with pytest.raises(Exception, match="not scored yet"):
        sessions.answered(log, known.filter("male = 1")).collect()


def test_stream_equals_batch(spark, tmp_path):
    rows = log_rows(spark, seed=5, n=120)
    for part in range(3):  # a file a trigger, in the order of time
        spark.createDataFrame(rows[part * 40 : part * 40 + 40], LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        time.sleep(1.1)  # files are taken by their times
    (tmp_path / "scored").mkdir()
    source = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    by = score.by_content(scorer(str(tmp_path / "scored")), crop=False, size=8)
    for _ in range(2):  # the second run starts from the checkpoint and finds nothing new
        stream.answers(source, images(spark), by, str(tmp_path / "scores"), str(tmp_path / "answers")).option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start().awaitTermination()
    known = stream.known_scores(spark, str(tmp_path / "scores"))
    log = spark.createDataFrame(rows, LOG)
    assert known.count() == known.select("digest", "male").distinct().count() == sessions.unknown(log, spark.createDataFrame([], sessions.KNOWN)).count()
    assert len(list((tmp_path / "scored").iterdir())) == known.filter("z IS NOT NULL").count()
    given = spark.readStream.schema(stream.ANSWERS + ", batch int").parquet(str(tmp_path / "answers")).drop("batch")
    stream.shown(given).writeStream.format("memory").queryName("shown").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination()
    key = lambda df: sorted((r.event_id, r.image, r.scored_male, r.z, r.error, r.fresh) for r in df.collect())
    assert key(spark.table("shown")) == key(sessions.shown(sessions.answered(log, known)))
    assert spark.table("shown").count() == len(rows)


def test_a_batch_that_runs_again_adds_nothing(spark, tmp_path):
    log = spark.createDataFrame(log_rows(spark, n=40), LOG)
    known = stream.known_scores(spark, str(tmp_path / "none"))
    assert known.count() == 0 and known.columns == ["digest", "male", "z", "error"]
    by = score.by_content(scorer(str(tmp_path)), crop=False, size=8)
    captured = {}

    class Writer:
        def foreachBatch(self, f):  # noqa: N802
            captured["f"] = f

    class Log:
        writeStream = Writer()  # noqa: N815

    stream.answers(Log(), images(spark), by, str(tmp_path / "s"), str(tmp_path / "a"))
    for number in (0, 0, 1):
        captured["f"](log, number)
    known = stream.known_scores(spark, str(tmp_path / "s"))
    assert known.count() == sessions.unknown(log, spark.createDataFrame([], sessions.KNOWN)).count()
    assert spark.read.parquet(str(tmp_path / "a")).count() == 80
