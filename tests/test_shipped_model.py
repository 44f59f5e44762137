"""A shipped model: loaded once in a process, whatever the number of tasks, and told apart by its bytes."""

from functools import partial
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from carpalake.operators import score, shipped


def loader(folder):
    """Makes a scorer whose age is the file's length; each load leaves a note with the process."""

    def load(path):
        import os
        import uuid
        from pathlib import Path

        (Path(folder) / f"{os.getpid()}-{uuid.uuid4().hex}").touch()
        data = Path(path).read_bytes()

        class Sized:
            meta_width = 1

            def __call__(self, image, meta):
                return meta[:, 0] * 0 + float(len(data))

        return Sized()

    return load


def requests(spark, n, parts):
    return spark.range(n).repartition(parts).select("id", F.lit(1).alias("male"), F.lit(2).alias("height"), F.lit(2).alias("width"), F.lit(1).alias("channels"), F.unhex(F.lit("40506070")).alias("data"))


def test_one_load_a_process_over_many_tasks(spark, tmp_path):
    notes = tmp_path / "notes"
    notes.mkdir()
    (tmp_path / "m.onnx").write_bytes(b"x" * 70)
    model = shipped.ShippedModel(spark, str(tmp_path / "m.onnx"), loader(str(notes)), least=10)
    (tmp_path / "m.onnx").unlink()  # the workers don't read it from there
    for _ in range(2):
        rows = score.score(requests(spark, 60, 20), model, crop=False, size=8).collect()
        assert len(rows) == 60 and {r.z for r in rows} == {70.0}
    made = [p.name.split("-")[0] for p in notes.iterdir()]
    assert 1 <= len(made) == len(set(made)) <= 20 < 40  # forty tasks
    assert len(made) <= spark.sparkContext.defaultParallelism + 1


def test_models_are_told_apart_by_their_bytes(spark, tmp_path):
    notes = tmp_path / "notes"
    notes.mkdir()
    models = []
    for k in (30, 40, 50, 60, 70, 80):
        path = tmp_path / "same-name.bin"
        path.write_bytes(b"y" * k)
        models.append(shipped.ShippedModel(spark, str(path), loader(str(notes)), least=10))
    for k, model in zip((30, 40, 50, 60, 70, 80), models):
        assert {r.z for r in score.score(requests(spark, 4, 2), model, crop=False, size=8).collect()} == {float(k)}
    assert len({m.key for m in models}) == 6


def test_a_process_keeps_a_few(monkeypatch, tmp_path):
    monkeypatch.setattr(shipped, "_loaded", {})
    monkeypatch.setattr(shipped.SparkFiles, "get", staticmethod(str))
    for k in range(7):
        model = shipped.ShippedModel.__new__(shipped.ShippedModel)
        model.key, model.name, model.load = str(k), str(k), partial(lambda path: path)
        assert model() == str(k) and model() is model()
    assert len(shipped._loaded) == shipped.HELD


def test_a_file_that_is_too_short(spark, tmp_path):
    (tmp_path / "m").write_bytes(b"1")
    with pytest.raises(ValueError, match="has 1 bytes"):
        shipped.ShippedModel(spark, str(tmp_path / "m"))
    assert Path(tmp_path / "m").exists()
