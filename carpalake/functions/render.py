"""Text, SVG and HTML of results, as string Columns.

Numbers go through format_number with a pattern, which rounds half to even like most formatters;
format_string('%.1f') rounds the decimal text half up.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import AXIS_MONTHS
from .months import age_months, age_years, integer_delta, sex_label, status_integer

LEFT, RIGHT, MIDDLE = 38, 562, 56


def fixed(x: Column, digits: int) -> Column:
    return F.call_function("format_number", x, F.lit("0." + "0" * digits))


def two(x: Column) -> Column:
    return F.lpad(x.cast("string"), 2, "0")


def signed(x: Column, digits: int = 1) -> Column:
    return F.concat(F.when(x >= 0, "+").otherwise("-"), fixed(F.abs(x), digits))


def axis_x(m: Column) -> Column:
    """The place of an age on the timeline, which ends at 216 months."""
    return F.lit(LEFT) + F.greatest(F.lit(0.0), F.least(F.lit(1.0), m / AXIS_MONTHS)) * (RIGHT - LEFT)


def report(x: Column, male: Column, ic: Column) -> Column:
    d, status = integer_delta(x, ic), status_integer(x, ic)
    months = F.concat(F.when(status == "advanced", "+").otherwise("-"), F.abs(d).cast("int").cast("string"), F.lit(" months"))
    verdict = F.when(status.isNull(), "").when(status == "compatible", " It agrees with the chronological age.").otherwise(F.concat(F.lit(" It is "), status, F.lit(" against the chronological age ("), months, F.lit(").")))
    return F.concat(
        F.lit("Left hand and wrist radiograph, "), sex_label(male), F.lit(" subject. The estimated skeletal age is "),
        age_years(x).cast("string"), F.lit(" years and "), age_months(x).cast("string"), F.lit(" months."), verdict,
        F.lit(" Decision support only; read together with clinical findings."),
    )


def ticks() -> Column:
    """Marks at the even years from 0 to 18. They are the same for every row, so they are built once, as a literal."""
    marks = [(LEFT + 12.0 * y / AXIS_MONTHS * (RIGHT - LEFT), y) for y in range(0, 19, 2)]
    return F.lit("".join(f"<path d='M{x:.1f} 52v8'/><text x='{x:.1f}' y='74'>{y}</text>" for x, y in marks))


def timeline(x: Column, ic: Column) -> Column:
    """An SVG with the skeletal age, and where known the chronological age and the gap between them."""
    a, b = axis_x(x), axis_x(ic)
    low, high = F.least(a, b), F.greatest(a, b)
    gap = F.concat(F.lit("<rect class='gap' x='"), fixed(low, 1), F.lit("' y='50' width='"), fixed(high - low, 1), F.lit("' height='12'/><path class='ic' d='M"), fixed(b, 1), F.lit(" 47v18'/>"))
    return F.concat(
        F.lit(f"<svg viewBox='0 0 600 78'><path class='axis' d='M{LEFT} {MIDDLE}H{RIGHT}'/>"), ticks(), F.when(ic.isNull(), "").otherwise(gap), F.lit("<path class='io' d='M"), fixed(a, 1), F.lit(" 43v26'/></svg>")
    )


def panel(x: Column, ic: Column) -> Column:
    badge = F.when(ic.isNull(), "").otherwise(F.concat(F.lit("<b class='"), status_integer(x, ic), F.lit("'>"), status_integer(x, ic), F.lit("</b>")))
    return F.concat(F.lit("<div>"), age_years(x).cast("string"), F.lit("y "), two(age_months(x)), F.lit("m ("), fixed(x, 2), F.lit(" months)"), badge, F.lit("</div>"))


def history_card(years: Column, months: Column, total: Column, male: Column, ts: Column) -> Column:
    return F.concat(years.cast("string"), F.lit("y "), two(months), F.lit("m | "), fixed(total, 1), F.lit(" | "), clock(ts), F.lit(" | "), F.when(male == 1, "M").otherwise("F"))


def result_line(x: Column, ic: Column, status: Column) -> Column:
    return F.concat(age_years(x).cast("string"), F.lit("y "), two(age_months(x)), F.lit("m ("), fixed(x, 1), F.lit(" months); "), signed(x - ic), F.lit(" months, "), status)


def items(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda p: F.concat(F.lit("<li>"), p, F.lit("</li>"))), "")


def clock(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm")


def stats_path(model_path: Column) -> Column:
    """The statistics file beside a model file; a path without .onnx is left as it is."""
    return F.replace(model_path, F.lit(".onnx"), F.lit("_stats.json"))


def percent(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.floor(done / total * 100).cast("int"))


def mae_line(name: Column, mae: Column, n: Column) -> Column:
    return F.concat(F.rpad(name, 10, " "), fixed(mae, 2), F.lit(" months (n="), n.cast("string"), F.lit(")"))


def epoch_line(epoch: Column, loss: Column, mae: Column) -> Column:
    return F.concat(F.lit("epoch "), F.lpad(epoch.cast("string"), 3, "0"), F.lit(": loss "), fixed(loss, 4), F.lit(", error "), fixed(mae, 2), F.lit(" months"))
