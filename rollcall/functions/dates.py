"""Dates written by many hands."""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import as_column

# The shape of the text decides which one format is tried, so a row
# pays for one parse, not five.
DATE_SHAPES = [
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{2}$", "M/d/yy"),
    (r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", "d-MMM-yyyy"),
    (r"^\d{1,2}-[A-Za-z]{3}-\d{2}$", "d-MMM-yy"),
    (r"^\d{8}$", "yyyyMMdd"),
]
# Two-digit years from here on belong to the previous century.
CENTURY_PIVOT = datetime.date(2069, 1, 1)


def parse_date(text, fmt: str) -> Column:
    """One format; NULL where the text does not follow it or names no real day."""
    return F.try_to_timestamp(as_column(text), F.lit(fmt)).cast("date")


def _two_digit_year(day: Column) -> Column:
    return F.when(day >= F.lit(CENTURY_PIVOT), F.add_months(day, -1200)).otherwise(day)


def parse_date_any(text, shapes=None) -> Column:
    """The first format whose shape fits; NULL where none does."""
    text = as_column(text)
    out = None
    for shape, fmt in shapes or DATE_SHAPES:
        day = parse_date(text, fmt)
        if "yy" in fmt and "yyyy" not in fmt:
            day = _two_digit_year(day)
        out = F.when(text.rlike(shape), day) if out is None else out.when(text.rlike(shape), day)
    return out


def safe_date(text) -> Column:
    """ISO text to date, NULL on failure."""
    return as_column(text).try_cast("date")


def clamp_date(day, low: str, high: str) -> Column:
    """The date where it lies in the window, else NULL; the row stays."""
    day = as_column(day)
    return F.when(day.between(F.lit(low).cast("date"), F.lit(high).cast("date")), day)


def age_days(stamp, now) -> Column:
    """Whole days from a moment to the clock that is passed in."""
    return F.timestamp_diff("DAY", as_column(stamp), now)
