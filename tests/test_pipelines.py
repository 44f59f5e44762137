import numpy as np
from pyspark.sql import functions as F

from carpalake.functions import months as m
from carpalake.operators import score
from carpalake.plans import pipelines
from carpalake.sources import files


def test_from_csv_to_report(spark, tmp_path):
    class Shifted(score.MeanPixelScorer):  # pickled by value, as workers don't have this module
        def __call__(self, image, meta):
            return score.MeanPixelScorer.__call__(self, image, meta) + 0.01

    lines = ["id,BoneAge,male"] + [f"{i},{(i * 37) % 229},{'True' if i % 2 else 'False'}" for i in range(60)] + ["99,,True"]
    (tmp_path / "c.csv").write_text("\n".join(lines))
    done = pipelines.load_and_prepare(spark, str(tmp_path / "c.csv"), str(tmp_path / "stats.json"))
    assert done.count() == 60 and {r.split for r in done.select("split").distinct().collect()} == {"train", "val", "test"}
    stats = files.read_stats(spark, str(tmp_path / "stats.json"))
    train = [r.boneage for r in done.filter("split = 'train'").collect()]
    assert abs(stats.first().boneage_mean - np.mean(train)) < 1e-9 and abs(stats.first().boneage_std - np.std(train, ddof=1)) < 1e-9
    img = np.random.default_rng(0).integers(0, 256, (20, 20, 3)).astype(np.uint8).tobytes()
    images = done.select("id", F.lit(20).alias("height"), F.lit(20).alias("width"), F.lit(3).alias("channels"), F.lit(img).alias("data"))
    aligned, report = pipelines.validate(done.filter("split = 'test'"), images, stats, score.MeanPixelScorer, size=16)
    n = done.filter("split = 'test'").count()
    assert aligned.count() == n and [r.n for r in report.filter("grouping = 'all'").collect()] == [n]
    parity = pipelines.scorer_parity(images.join(done.select("id", "male"), "id"), stats, score.MeanPixelScorer, Shifted, size=16).first()
    assert 0 < parity.max_diff <= 0.01 * stats.first().boneage_std + 1e-6 and parity.n == 60
    assert {*pipelines.describe(done)} == {"summary", "sex", "nulls", "offenders"}


def test_form_and_preference(spark):
    got = spark.createDataFrame([(20, 11, None, "u"), (21, 0, "p", "u"), (0, 12, None, None)], "y int, m int, p string, u string").select(m.valid_form(F.col("y"), F.col("m")), files.preferred(F.col("p"), F.col("u"))).collect()
    assert [tuple(r) for r in got] == [(True, "u"), (False, "p"), (False, None)]
