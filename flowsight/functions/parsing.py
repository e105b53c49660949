"""Tolerant conversions: bad input becomes null or a default, never an error, ANSI mode or not."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def to_float(value: Column | str, default: float = 0.0) -> Column:
    return F.coalesce(as_column(value).try_cast("double"), F.lit(float(default)))


def to_int(value: Column | str, default: int = 0) -> Column:
    """Fraction cut off, as in ``int(float(x))``."""
    return F.coalesce(as_column(value).try_cast("double").try_cast("bigint"), F.lit(default).cast("bigint"))


def safe_int(value: Column | str) -> Column:
    """``to_int`` for text that may carry thousands separators and blanks."""
    text = F.trim(F.replace(as_column(value).cast("string"), F.lit(","), F.lit("")))
    return to_int(text)


def number_or_zero(value: Column | str) -> Column:
    """Null, NaN and non-numeric text all count as 0."""
    number = as_column(value).try_cast("double")
    return F.coalesce(F.nanvl(number, F.lit(0.0)), F.lit(0.0))


def first_non_blank(*values: Column | str, default: str = "") -> Column:
    """First value that is neither null nor blank, untrimmed."""
    texts = [as_column(v).cast("string") for v in values]
    return F.coalesce(*[F.when(F.trim(t) != "", t) for t in texts], F.lit(default))


def is_blank(value: Column | str) -> Column:
    text = as_column(value).cast("string")
    return text.isNull() | (F.trim(text) == "")


def event_time(value: Column | str) -> Column:
    """ISO text -> instant. Text without a zone is UTC, whatever the session time zone is."""
    text = F.trim(as_column(value))
    zoned = text.rlike(r"(?i)(z|[+-]\d{2}:?\d{2})$")
    return F.when(zoned, text).otherwise(F.concat(text, F.lit("Z"))).try_cast("timestamp")


def clock_label(epoch_seconds: Column) -> Column:
    """``HH:MM`` in UTC of an epoch second."""
    minute = F.pmod(F.floor(epoch_seconds / 60), F.lit(1440))
    two = lambda c: F.lpad(c.cast("bigint").cast("string"), 2, "0")
    return F.concat(two(F.floor(minute / 60)), F.lit(":"), two(F.pmod(minute, F.lit(60))))
