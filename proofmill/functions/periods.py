"""Fiscal periods from free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from proofmill.functions.text import filled, ustrip

#: The forms of a fiscal year, in order, and the group that names it.
YEAR_FORMS = [(r"(?i)FY\s?(\d{2,4})[-–/](\d{2,4})", 2), (r"(?i)FY\s?(\d{2,4})", 1), (r"(\d{4})-(\d{2,4})", 2)]
MONTH = r"(?i)\bmonth\b|\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\b"


def quarter(raw: Column) -> Column:
    return F.concat(F.lit("Q"), filled(F.regexp_extract(raw, r"(?i)Q([1-4])", 1)))


def fy_label(raw: Column) -> Column:
    year = F.coalesce(*(filled(F.regexp_extract(raw, form, group)) for form, group in YEAR_FORMS))
    return F.concat(F.lit("FY"), F.when(F.length(year) == 4, F.right(year, F.lit(2))).otherwise(year))


def period_type(raw: Column) -> Column:
    return (
        F.when(quarter(raw).isNotNull(), "quarter")
        .when(fy_label(raw).isNotNull() | F.regexp_like(raw, F.lit(r"(?i)\bfull.?year\b")), "FY")
        .when(F.regexp_like(raw, F.lit(MONTH)), "month")
    )


def normalize_period(raw: Column) -> Column:
    """raw, period_type, fy_label and quarter of a period's text."""
    raw = ustrip(F.coalesce(raw, F.lit("")))
    return F.struct(raw.alias("raw"), period_type(raw).alias("period_type"), fy_label(raw).alias("fy_label"), quarter(raw).alias("quarter"))


def comparable(a: Column, b: Column) -> Column:
    """Whether two normalised periods may be the same; a quarter and none are not."""
    labels_differ = a["fy_label"].isNotNull() & b["fy_label"].isNotNull() & (a["fy_label"] != b["fy_label"])
    return ~labels_differ & a["quarter"].eqNullSafe(b["quarter"])
