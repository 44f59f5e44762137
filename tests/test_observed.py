"""A cohort is described while it is written, in one pass, with the values of the separate reports."""

import pytest
from pyspark.sql import functions as F

from carpalake.operators import cohort, observed

ROWS = [(1, 100.0, 1), (2, 228.0, 0), (3, 0.0, 1), (4, None, 1), (5, 300.0, 0), (None, -1.0, None)]


def test_one_pass_has_the_values_of_the_reports(spark, tmp_path):
    reads = spark.sparkContext.accumulator(0)
    source = str(tmp_path / "in")
    spark.createDataFrame(ROWS, "id long, boneage double, male int").repartition(3).write.parquet(source)
    df = spark.read.parquet(source)

    def note(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    got = observed.write_described(df.mapInArrow(note, df.schema), str(tmp_path / "out"))
    assert reads.value == len(ROWS)  # each row came once
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(ROWS)
    want = cohort.summary(df).first()
    assert (got["n_rows"], got["min_age"], got["max_age"], got["mean_age"]) == (want.n_rows, want.min_age, want.max_age, want.mean_age)
    assert got["std_age"] == pytest.approx(want.std_age, abs=1e-6)
    sexes = {r.male: r.n for r in cohort.value_counts(df).collect()}
    assert (got["n_male"], got["n_female"]) == (sexes[1], sexes[0])
    nulls = cohort.null_counts(df).first().asDict()
    assert {k: v for k, v in got.items() if k.startswith("null_")} == nulls
    assert got["n_bad"] == cohort.offenders(df).first().n_bad == 2


def test_an_empty_cohort(spark, tmp_path):
    df = spark.createDataFrame([], "id long, boneage double, male int")
    got = observed.write_described(df, str(tmp_path / "out"))
    assert got["n_rows"] == 0 and got["mean_age"] is None and got["null_id"] == 0


def test_the_metrics_see_what_the_sink_gets(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "id long, boneage double, male int")
    out, seen = observed.described(df.filter("male = 1"), nulls=["boneage"])
    out.select(F.col("id")).write.parquet(str(tmp_path / "out"))
    assert seen.get["n_rows"] == 3 and seen.get["null_boneage"] == 1 and "null_id" not in seen.get
