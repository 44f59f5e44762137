"""The image queries without SQL read every row of embeddings, held against each image made and worked on by itself."""

import hashlib

import numpy as np
import pytest

from carpalake.operators import images, score
from carpalake.plans import queries

IDS = [0, 9, 198, 199, 200, 205, 209, 731]


def plain_image(i):
    img = np.full((64, 64, 1), 0 if i % 2 == 0 else 255, np.uint8)
    if i % 10 == 9:
        img[2:62, 2:62] = 120
    else:
        img[3 + i % 19 : 12 + i % 19 + i % 37, 4 + i % 23 : 11 + i % 23 + i % 31] = 120
    return img


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("images"))
    spark.createDataFrame([(i, [0.0]) for i in IDS], "vec_id long, embedding array<float>").repartition(2).write.parquet(f"{path}/embeddings.parquet")
    return path


KERNELS = {"autocrop": images.autocrop, "contrast_equalize": images.equalize_contrast, "resize_bilinear": lambda x: images.resize(x, 48, 80)}


@pytest.mark.parametrize("name", list(KERNELS))
def test_kernels(spark, folder, name):
    got = {r.id: (r.height, r.width, r.sha256) for r in queries.QUERIES[name](spark, folder).collect()}
    made = {i: np.ascontiguousarray(KERNELS[name](images.to_rgb(plain_image(i))), np.uint8) for i in IDS}
    assert got == {i: (*x.shape[:2], hashlib.sha256(x.tobytes()).hexdigest()) for i, x in made.items()}


def test_augmentation_draws_for_each_image(spark, folder):
    got = {r.id: r.sha256 for r in queries.augment_seeded(spark, folder).collect()}
    made = {i: images.augment(images.to_rgb(plain_image(i)), images.draw_seed(42, i)) for i in IDS}
    assert got == {i: hashlib.sha256(np.ascontiguousarray(x).tobytes()).hexdigest() for i, x in made.items()}
    same = [np.random.default_rng(images.draw_seed(42, i)).random() for i in IDS]
    assert len(set(same)) == len(IDS)


def test_crop_boxes(spark, folder):
    got = {r.id: (r.x0, r.y0, r.x1, r.y1) for r in queries.crop_boxes(spark, folder).collect()}
    assert got == {i: tuple(images.crop_box(images.to_rgb(plain_image(i)))) for i in IDS}


@pytest.mark.parametrize("name", ["score_pipeline", "analysis_pipeline"])
def test_scores_cover_all_images(spark, folder, name):
    assert sorted(r.id for r in queries.QUERIES[name](spark, folder).collect()) == IDS


@pytest.mark.parametrize(("name", "flow"), [("score_pipeline", score.predict), ("analysis_pipeline", score.analyze)])
def test_flows_run_at_the_full_size(spark, folder, name, flow):
    got = sorted(queries.QUERIES[name](spark, folder).collect())
    want = flow(queries.requests(spark, folder), queries.fixed_stats(spark), score.MeanPixelScorer, size=512).collect()
    other = flow(queries.requests(spark, folder), queries.fixed_stats(spark), score.MeanPixelScorer, size=64).collect()
    assert got == sorted(want) != sorted(other)


def test_synthetic_images_are_made_by_lines(spark, tmp_path):
    """No step for each pixel; ids below zero and null ids as the pixels have them."""
    from carpalake.plans.study import synthetic_images, synthetic_pixels

    ids = [*range(-60, 0, 7), *range(0, 300, 37), 9, -9, 2**63 - 1, None]
    spark.createDataFrame([(i,) for i in ids], "vec_id long").write.parquet(f"{tmp_path}/embeddings.parquet")
    made = synthetic_images(spark, str(tmp_path))
    assert "transform(" not in made._jdf.queryExecution().toString()
    got = {r.id: np.frombuffer(r.data, np.uint8).reshape(64, 64) for r in made.collect()}
    assert len(got) == len(set(ids)) and {x.shape for x in got.values()} == {(64, 64)}
    want = {i: np.zeros((64, 64), np.uint8) for i in got}
    for r in synthetic_pixels(spark, str(tmp_path)).collect():
        want[r.id][r.y, r.x] = r.v
    assert all((got[i] == want[i]).all() for i in got)


def test_legacy_box_shuffles_no_pixel(spark, tmp_path):
    """Sizes in the pixels' rows: no join, aggregates before the only shuffle; rows as with sizes apart, also for null and repeated ids."""
    from pyspark.sql import functions as F

    from carpalake.plans.study import synthetic_pixels

    spark.createDataFrame([(i,) for i in [*IDS, 9, 731, None, -7]], "vec_id long").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.QUERIES["legacy_crop_box"](spark, str(tmp_path))
    plan = got._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "Join" not in plan and plan.count("Exchange") == 1
    p = synthetic_pixels(spark, str(tmp_path))
    apart = images.legacy_box(p, p.groupBy("id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w")))
    assert sorted(got.collect()) == sorted(apart.collect()) and got.count() == len({*IDS, -7})
