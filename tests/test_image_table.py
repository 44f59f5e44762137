"""The bucketed image table: plans without shuffled images, missing images, worst cases."""

import pytest
from pyspark.sql import functions as F

from carpalake.sources import image_table


@pytest.fixture(scope="module")
def bank(spark, tmp_path_factory):
    images = spark.range(200).withColumns({"height": F.lit(1), "data": F.encode(F.col("id").cast("string"), "utf-8")})
    images = images.unionByName(spark.createDataFrame([(None, 1, bytearray(b"x"))], "id long, height int, data binary"))
    return image_table.write_images(images, "bank_of_test", 8, str(tmp_path_factory.mktemp("bank") / "t"))


def rows(spark, ids):
    return spark.createDataFrame([(i, float((i or 0) * 37 % 101), 50.0, 1) for i in ids], "id long, pred double, target double, male int")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_join_shuffles_rows_but_no_image(spark, bank):
    out = image_table.with_their_images(rows(spark, [*range(0, 200, 3), 6, 6]), bank)
    assert sorted((r.id, bytes(r.data)) for r in out.collect()) == sorted((i, str(i).encode()) for i in [*range(0, 200, 3), 6, 6])
    text = plan(out).split("== Initial Plan ==")[0]
    assert "SortMergeJoin" in text and text.count("Exchange hashpartitioning") == 1  # the rows' own
    scan = next(line for line in text.splitlines() if "FileScan" in line)
    assert "data" in scan and "Bucketed: true" in scan  # the planner says false where an exchange stands above


def test_missing_images_are_an_error_with_their_ids(spark, bank):
    with pytest.raises(image_table.MissingImages, match="4 rows have no image, first of them ids 500, 700, 700, None") as e:
        image_table.with_their_images(rows(spark, [1, 700, 500, 700, None]), bank)
    assert e.value.count == 4 and e.value.ids == [500, 700, 700, None]
    assert image_table.with_their_images(rows(spark, [1]).limit(0), bank).count() == 0


def test_worst_cases_read_only_their_images(spark, bank):
    ids = [*range(200)]
    out = image_table.worst_with_images(rows(spark, ids), bank, 4)
    want = sorted(ids, key=lambda i: (-abs(i * 37 % 101 - 50.0), i))[:4]
    got = sorted(out.collect(), key=lambda r: r["rank"])
    assert [(r.id, bytes(r.data)) for r in got] == [(i, str(i).encode()) for i in want]
    assert out.columns == ["id", "pred", "target", "male", "err", "rank", "height", "data"]
    assert "Exchange hashpartitioning" not in plan(out)
    few = image_table.only(bank, want)
    assert "PushedFilters: [In(id" in plan(few) and few.count() == 4
    few.collect()
    scan = few._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert 4 <= scan.metrics().apply("numOutputRows").value() < 200  # of four buckets at most


def test_worst_cases_of_few_rows_null_errors_and_lost_images(spark, bank):
    df = rows(spark, [3, 4]).unionByName(spark.createDataFrame([(5, None, 1.0, 1), (6, float("nan"), 1.0, 1)], "id long, pred double, target double, male int"))
    assert {r.id for r in image_table.worst_with_images(df, bank).collect()} == {3, 4}
    assert image_table.worst_with_images(df.limit(0), bank).count() == 0
    with pytest.raises(image_table.MissingImages, match="ids 999"):
        image_table.worst_with_images(rows(spark, [999, 1]), bank)
