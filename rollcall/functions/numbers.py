"""Numeric helpers whose edge cases are fixed here, once, for every report."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(value) -> Column:
    """A column from a column or a column name."""
    return value if isinstance(value, Column) else F.col(value)


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, where ``use`` mentions it in several branches."""
    return F.element_at(F.transform(F.array(value), use), 1)


def round_half_up(value, digits: int = 0) -> Column:
    """Round the binary double half away from zero: 1.005 to two digits is 1.0, not 1.01."""
    value = as_column(value).cast("double")
    scale = float(10**digits)
    size = F.floor(F.abs(value) * scale + 0.5) / scale
    return F.when((value < 0) & (size > 0), -size).otherwise(size)


def round_half_even(value, digits: int = 0) -> Column:
    """Round the binary double half to even, the way numeric Python libraries do."""
    scale = float(10**digits)
    return F.rint(as_column(value) * scale) / scale


def percent(part, whole, digits: int) -> Column:
    """100 * part / whole, rounded; NULL where the whole is zero or NULL."""
    return round_half_up(F.try_divide(F.lit(100.0) * as_column(part), as_column(whole)), digits)


def rate(flag, where=None) -> Column:
    """Aggregate: mean of a boolean as 0/1, over the rows that pass ``where``."""
    number = as_column(flag).cast("int")
    return F.avg(number if where is None else F.when(where, number))


def count_distinct_where(value, where=None) -> Column:
    """Aggregate: number of distinct non-NULL values among the rows that pass ``where``."""
    value = as_column(value)
    return F.count_distinct(value if where is None else F.when(where, value))


# A text like "12d" is a Java double literal but not a number anybody typed.
_JAVA_SUFFIX = r"[0-9.][dDfF]\s*$"
_DIGIT_GAP = r"(?<=[0-9])_(?=[0-9])"


def safe_double(text) -> Column:
    """Text to double, NULL where it is not a number."""
    text = as_column(text)
    plain = F.when(text.contains("_"), F.regexp_replace(text, _DIGIT_GAP, "")).otherwise(text)
    return F.when(~text.rlike(_JAVA_SUFFIX), plain.try_cast("double"))


def safe_int(text) -> Column:
    """Text to integer, rounding a decimal text half away from zero; NULL where it is not a number."""
    return round_half_up(safe_double(text)).try_cast("int")


def suppress(value, n, min_n: int) -> Column:
    """The value only where it rests on at least ``min_n`` observations."""
    return F.when(as_column(n) >= min_n, as_column(value))


def band(value, bands) -> Column:
    """Label of the first band whose upper edge lies above the value; a ``None`` edge is open."""
    value = as_column(value)
    out = None
    for edge, label in bands:
        if edge is None:
            out = F.lit(label) if out is None else out.otherwise(label)
            break
        out = F.when(value < edge, label) if out is None else out.when(value < edge, label)
    return out


def equal_bins(pct, bins: int = 20) -> Column:
    """Bin number of a percent in equal bins; 100 falls into the last one."""
    width = 100.0 / bins
    return F.least(F.lit(bins - 1), F.floor(as_column(pct) / width).cast("int"))
