import math

from pyspark.sql import functions as F

from carpalake.functions import months as m
from carpalake.functions import render as r


def values(spark, rows, schema, *columns):
    return [tuple(x) for x in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_clip(spark):
    got = [x[0] for x in values(spark, [(-5.0,), (300.0,), (float("nan"),), (None,), (100.5,)], "x double", m.clip_months(F.col("x")))]
    assert got[:2] == [0.0, 228.0] and math.isnan(got[2]) and got[3] is None and got[4] == 100.5


def test_decompose(spark):
    x = F.col("x")
    got = values(spark, [(11.5,), (10.5,), (2.5,), (11.4,), (228.0,), (float("nan"),), (None,)], "x double", m.age_years(x), m.age_months(x))
    assert got == [(1, 0), (0, 10), (0, 2), (0, 11), (19, 0), (None, None), (None, None)]


def test_status_rules_differ_near_the_edge(spark):
    x, ic = F.col("x"), F.col("ic")
    rows = [(108.375, 96.0), (108.0, 96.0), (96.0, 108.0), (108.125, 96.0), (80.0, None), (60.0, 96.0)]
    got = values(spark, rows, "x double, ic double", m.status_float(x, ic), m.status_integer(x, ic))
    assert got == [("advanced", "compatible"), ("compatible",) * 2, ("compatible",) * 2, ("advanced", "compatible"), (None, None), ("delayed",) * 2]


def test_form_age_sex_and_default(spark):
    rows = [(0, 0, "male"), (0, 1, "female"), (1, 0, "other")]
    got = values(spark, rows, "y int, m int, s string", m.age_from_form(F.col("y"), F.col("m")), m.sex_code(F.col("s")), m.age_or_default(m.age_from_form(F.col("y"), F.col("m")).cast("double")))
    assert got == [(None, 1, 120.0), (1, 0, 1.0), (12, 0, 12.0)]


def test_formatting_rounds_half_even_like_python(spark):
    xs = [i / 8 for i in range(0, 1824, 7)]
    got = values(spark, [(x,) for x in xs], "x double", r.fixed(F.col("x"), 1), r.fixed(F.col("x"), 2))
    assert got == [(f"{x:.1f}", f"{x:.2f}") for x in xs]


def test_axis_and_ticks(spark):
    got = [x[0] for x in values(spark, [(-1.0,), (0.0,), (108.0,), (216.0,), (228.0,)], "x double", r.axis_x(F.col("x")))]
    assert got == [38.0, 38.0, 300.0, 562.0, 562.0]
    assert spark.range(1).select(r.ticks()).first()[0].count("<text") == 10


def test_rendered_text(spark):
    row = [(100.0, 60.0, 1), (100.0, None, 0)]
    x, ic = F.col("x"), F.col("ic")
    got = values(spark, row, "x double, ic double, male int", r.report(x, F.col("male"), ic), r.panel(x, ic), r.timeline(x, ic))
    assert "male subject" in got[0][0] and "8 years and 4 months" in got[0][0] and "+40 months" in got[0][0]
    assert "female" in got[1][0] and "chronological" not in got[1][0]
    assert "advanced" in got[0][1] and "<b" not in got[1][1]
    assert "class='gap'" in got[0][2] and "class='gap'" not in got[1][2]


def test_paths_and_percent(spark):
    got = values(spark, [("a.onnx", 3, 7), ("plain", 1, 0)], "p string, a int, b int", r.stats_path(F.col("p")), r.percent(F.col("a"), F.col("b")))
    assert got == [("a_stats.json", 42), ("plain", None)]
