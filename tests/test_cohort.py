import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from carpalake.operators import atlas, cohort, evaluate, split
from carpalake.schemas import ATLAS
from carpalake.sources import files


def test_clean_from_csv(spark, tmp_path):
    (tmp_path / "train.csv").write_text(" ID ,BoneAge,Male\n1,12.5,True\n2,,False\n3,100,0\n4,7,1\n")
    got = cohort.clean(files.read_cohort(spark, str(tmp_path / "train.csv"))).collect()
    assert [(r.id, r.boneage, r.male, r.boneage_ic) for r in got] == [(1, 12.5, 1, 12.5), (3, 100.0, 0, 100.0), (4, 7.0, 1, 7.0)]


def test_clean_fails_on_null_male_and_missing_columns(spark):
    with pytest.raises(Exception, match="male is null"):
        cohort.clean(spark.createDataFrame([(1, 5.0, None)], "id long, boneage double, male string")).collect()
    with pytest.raises(ValueError, match="boneage"):
        cohort.clean(spark.createDataFrame([(1, "x")], "id long, male string"))


def test_guard(spark):
    df = spark.createDataFrame([(1, -0.1), (2, 0.0), (3, 228.0), (4, 228.1), (5, float("nan")), (6, None)], "id long, boneage double")
    assert [(r.id, r.n_bad) for r in cohort.offenders(df).collect()] == [(1, 2), (4, 2)]
    with pytest.raises(Exception, match="out of range"):
        cohort.guard(df).collect()
    assert cohort.guard(df.filter("id IN (2, 3)")).count() == 2


def test_bins_are_right_closed_and_bands_left_closed(spark):
    edges = [(0.0, None), (0.125, 0), (60.0, 0), (60.125, 1), (120.0, 1), (180.0, 2), (229.0, 3), (229.125, None)]
    df = spark.createDataFrame(edges, "x double, want int")
    assert all(r.got == r.want for r in df.withColumn("got", cohort.stratum_bin(F.col("x"))).collect())
    bands = [(0.0, "0-60"), (59.875, "0-60"), (60.0, "60-120"), (180.0, "180-228"), (227.875, "180-228"), (228.0, None)]
    df = spark.createDataFrame(bands, "x double, want string")
    assert all(r.got == r.want for r in df.withColumn("got", evaluate.eval_band(F.col("x"))).collect())
    assert spark.range(1).select(cohort.stratum_key(F.lit(1), F.lit(0.0))).first()[0] == "1_nan"


def test_atlas_edges(spark):
    xs = [*[(float(e), i) for i, e in enumerate(atlas.EDGES)], (998.9, 11), (999.0, 11), (-1.0, 11), (float("nan"), 11), (11.9, 0)]
    got = atlas.lookup(spark.createDataFrame(xs, "x double, want int"), "x").collect()
    assert len(got) == len(xs) and all(r.band == r.want for r in got)


def test_atlas_texts_come_from_the_callers_table(spark):
    own = spark.createDataFrame([(i, 0.0, 0.0, f"t{i}", [f"c{i}"], [], "r") for i in [*range(12), 3, 99]], ATLAS)
    got = atlas.lookup(spark.createDataFrame([(5.0,), (40.0,), (None,)], "x double"), "x", own).collect()
    assert sorted((r.band, r.title, tuple(r.carpus)) for r in got) == [(0, "t0", ("c0",)), (3, "t3", ("c3",)), (11, "t11", ("c11",))]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 10**12), st.sampled_from(["a", "b", "c"])), unique_by=lambda r: r[0], max_size=80))
def test_split_is_a_balanced_disjoint_cover(spark, rows):
    got = split.split(spark.createDataFrame(rows, "id long, stratum string"), "stratum").collect()
    assert sorted((r.id, r.stratum) for r in got) == sorted(rows)
    for s in "abc":
        n, test = sum(r[1] == s for r in rows), sum(r.stratum == s and r.split == "test" for r in got)
        assert abs(test - n / 5) < 1
    again = split.split(spark.createDataFrame(rows[::-1], "id long, stratum string").repartition(3), "stratum").collect()
    assert {(r.id, r.split) for r in got} == {(r.id, r.split) for r in again}


def test_split_deals_twice_from_one_ranking(spark):
    df = spark.range(2000).withColumn("stratum", (F.col("id") % 7).cast("string"))
    order = sorted(((r.stratum, r.id * 0 + (r.id % split.PRIME) * split.FACTOR % split.PRIME, r.id) for r in df.collect()))
    rest = [x[2] for i, x in enumerate(order) if i % 5]
    want = {x[2]: "test" for i, x in enumerate(order) if i % 5 == 0} | {x: "train" if i % 5 else "val" for i, x in enumerate(rest)}
    assert {r.id: r.split for r in split.split(df, "stratum").collect()} == want


def test_split_ranks_no_whole_stratum(spark):
    plan = split.folds(spark.range(1000).withColumn("stratum", F.lit("one")), "stratum")._jdf.queryExecution().toString()
    assert "__bucket" in plan


def test_mae_weights_and_parity(spark):
    rows = [(1, 10.0, 12.0, 0), (2, 70.0, 71.0, 1), (3, 228.0, 220.0, 1), (4, 30.0, 30.0, 1)]
    df = spark.createDataFrame(rows, "id long, target double, pred double, male int")
    got = {(r.grouping, r.value): (r.mae, r.n) for r in evaluate.mae_report(df).collect()}
    assert got == {("all", None): (2.75, 4), ("male", "0"): (2.0, 1), ("male", "1"): (3.0, 3), ("band", "0-60"): (1.0, 2), ("band", "60-120"): (1.0, 1)}
    assert [r.id for r in evaluate.worst(df, 2).collect()] == [3, 1]
    a = df.select(F.col("id").alias("sample_id"), F.col("pred").alias("months"))
    assert evaluate.check_parity(a, a) == 0
    with pytest.raises(ValueError, match="differ"):
        evaluate.check_parity(a, a.withColumn("months", F.col("months") + 1))


def test_stats_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 1.0, "train"), (3.0, 3.0, "train"), (99.0, 9.0, "test")], "boneage double, boneage_ic double, split string")
    stats = cohort.fit_stats(df)
    files.write_stats(stats, str(tmp_path / "stats.json"))
    assert '\n  "boneage_mean": 2.0' in (tmp_path / "stats.json").read_text()
    assert files.read_stats(spark, str(tmp_path / "stats.json")).collect() == stats.collect()


def test_images_by_name(spark, tmp_path):
    import struct
    import zlib

    def png(path, w, h, pixels, kind):
        raw = b"".join(b"\0" + pixels[y * w * kind : (y + 1) * w * kind] for y in range(h))
        chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
        path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2}[kind], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))

    png(tmp_path / "7.png", 2, 1, bytes([10, 200]), 1)
    png(tmp_path / "8.png", 2, 1, bytes([1, 2, 3, 4, 5, 6]), 3)
    got = {r.id: r for r in files.bgr_to_rgb(files.read_images(spark, str(tmp_path))).collect()}
    assert bytes(got[7].data) == bytes([10, 200]) and bytes(got[8].data) == bytes([1, 2, 3, 4, 5, 6])
    cohort_ = spark.createDataFrame([(7, 1.0), (9, 2.0)], "id long, boneage double")
    images = files.read_images(spark, str(tmp_path))
    assert [r.id for r in files.missing_images(cohort_, images).collect()] == [9]
    assert [r.id for r in files.with_images(cohort_, images).collect()] == [7]
    assert files.read_uploads(spark, str(tmp_path)).count() == 2
    (tmp_path / "notes.txt").write_text("no image")
    (tmp_path / "broken.png").write_bytes(b"no image")
    got = {r.origin.rpartition("/")[2]: (r.height, r.width, r.channels, bytes(r.data)) for r in files.decode_uploads(spark, str(tmp_path)).collect()}
    assert got == {"7.png": (1, 2, 1, bytes([10, 200])), "8.png": (1, 2, 3, bytes([1, 2, 3, 4, 5, 6]))}


def test_staged_files(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"x" * 5000)
    target = files.stage_file(spark, str(tmp_path / "a.bin"), str(tmp_path / "b.bin"), 5000)
    assert (tmp_path / "b.bin").read_bytes() == b"x" * 5000 and target.endswith("b.bin")
    with pytest.raises(ValueError, match="fewer than"):
        files.stage_file(spark, str(tmp_path / "a.bin"), str(tmp_path / "c.bin"), 5001)
    assert not (tmp_path / "c.bin").exists()


def test_statistics_have_one_row(spark):
    stats = spark.createDataFrame([(1.0, None), (2.0, 5.0)], "a double, b double")
    assert [tuple(r) for r in cohort.one_row(stats.limit(1)).collect()] == [(1.0, None)]
    for bad in (stats, stats.limit(0)):
        with pytest.raises(Exception, match="one row"):
            cohort.one_row(bad).collect()
