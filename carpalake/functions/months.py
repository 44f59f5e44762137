"""Scalar functions on ages in months, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import MONTHS_MAX, MONTHS_MIN, WINDOW_MONTHS

ADVANCED, COMPATIBLE, DELAYED = "advanced", "compatible", "delayed"


def z_score(x: Column, mean: Column, std: Column) -> Column:
    return (x - mean) / std


def denormalize(z: Column, mean: Column, std: Column) -> Column:
    return z * std + mean


def clip_months(x: Column) -> Column:
    """x within the valid range; NaN stays NaN and null stays null (least and greatest alone lose both)."""
    return F.when(x.isNull() | F.isnan(x), x).otherwise(F.least(F.lit(MONTHS_MAX), F.greatest(F.lit(MONTHS_MIN), x)))


def _whole_months(x: Column) -> Column:
    return F.bround(x % 12, 0)


def age_years(x: Column) -> Column:
    """Whole years, one more where the months round up to 12; null for NaN."""
    return F.when(~F.isnan(x), (F.floor(x / 12) + F.when(_whole_months(x) == 12, 1).otherwise(0)).cast("int"))


def age_months(x: Column) -> Column:
    """Months beyond the whole years, rounded half to even."""
    return F.when(~F.isnan(x), F.when(_whole_months(x) == 12, 0).otherwise(_whole_months(x)).cast("int"))


def total_months(years: Column, months: Column) -> Column:
    return years * 12 + months


def age_from_form(years: Column, months: Column) -> Column:
    """An entered age in months; 0 years and 0 months mean unknown."""
    return F.nullif(total_months(years, months), F.lit(0))


def valid_form(years: Column, months: Column) -> Column:
    """Whether an entered age is within what the form takes."""
    return years.between(0, 20) & months.between(0, 11)


def age_or_default(ic: Column) -> Column:
    return F.coalesce(ic, F.lit(120.0))


def status_float(x: Column, ic: Column) -> Column:
    """From the unrounded difference; null without an age to compare with."""
    d = x - ic
    return F.when(d.isNull(), None).when(F.abs(d) <= WINDOW_MONTHS, COMPATIBLE).when(d > 0, ADVANCED).otherwise(DELAYED)


def integer_delta(x: Column, ic: Column) -> Column:
    return total_months(age_years(x), age_months(x)) - ic


def status_integer(x: Column, ic: Column) -> Column:
    """From the difference of whole months; null without an age to compare with."""
    d = integer_delta(x, ic)
    return F.when(d.isNull(), None).when(F.abs(d) <= WINDOW_MONTHS, COMPATIBLE).when(d > WINDOW_MONTHS, ADVANCED).otherwise(DELAYED)


def sex_code(label: Column, male_label: str = "male") -> Column:
    return F.when(label == male_label, 1).otherwise(0)


def sex_label(male: Column) -> Column:
    return F.when(male == 1, "male").otherwise("female")


def absolute_error(pred: Column, target: Column) -> Column:
    return F.abs(pred - target)
