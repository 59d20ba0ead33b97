"""Row predicates used by quality rules.

All are built-in Column expressions (codegen'd, no Python per row; E4 -
the per-value Python lambdas of a pandas implementation become these).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import (BooleanType, DataType, DateType, NumericType, StringType,
                               TimestampNTZType, TimestampType)

# E-mail patterns (loose service form and strict engine form)
# and the strict ISO date shape.
EMAIL_LOOSE = r"^[^@]+@[^@]+\.[^@]+$"
EMAIL_STRICT = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"
INT_TEXT = r"^\s*[+-]?\d+\s*$"


def is_numeric(dt: DataType) -> bool:
    return isinstance(dt, NumericType) and not isinstance(dt, BooleanType)


def is_temporal(dt: DataType) -> bool:
    return isinstance(dt, (DateType, TimestampType, TimestampNTZType))


def match_start(c: Column, pattern: str) -> Column:
    """Python ``re.match`` semantics — anchored at the start only."""
    return c.rlike("^(?:" + pattern + ")")


def email_loose(c: Column) -> Column:
    """F2 (service)."""
    return c.rlike(EMAIL_LOOSE)


def email_strict(c: Column) -> Column:
    """F2 (engine)."""
    return c.rlike(EMAIL_STRICT)


def castable(c: Column, dt: DataType, logical: str) -> Column:
    """value converts to ``int``/``float``/``date``/``email``.

    Strings are tested with ``try_*`` (never fails the job under ANSI);
    int-ness of text is a regex because ``try_cast('1.0' as int)`` differs
    between engines and Python ``int('1.0')`` raises.
    """
    if logical == "int":
        if isinstance(dt, StringType):
            return c.rlike(INT_TEXT)
        return F.lit(is_numeric(dt) or isinstance(dt, BooleanType))
    if logical == "float":
        if isinstance(dt, StringType):
            return c.try_cast("double").isNotNull()
        return F.lit(is_numeric(dt) or isinstance(dt, BooleanType))
    if logical == "date":
        if isinstance(dt, StringType):
            return F.try_to_timestamp(c).isNotNull()
        return F.lit(is_temporal(dt) or is_numeric(dt))
    if logical == "email":
        if isinstance(dt, StringType):
            return email_loose(c)
        return F.lit(False)
    raise ValueError(f"unknown data_type: {logical}")


def iso_date(c: Column) -> Column:
    """strict ``YYYY-MM-DD`` that is also a real calendar date."""
    return c.rlike(ISO_DATE) & F.try_to_date(c, "yyyy-MM-dd").isNotNull()


def as_timestamp(c: Column, dt: DataType) -> Column:
    """coercing datetime parse; unparsable -> NULL."""
    if isinstance(dt, (TimestampType, TimestampNTZType)):
        return c.cast("timestamp")
    if isinstance(dt, DateType):
        return c.cast("timestamp")
    if isinstance(dt, StringType):
        return F.try_to_timestamp(c)
    return F.lit(None).cast("timestamp")


def in_range(c: Column, lo=None, hi=None) -> Column:
    """F8: inclusive open-ended range; NULL values pass."""
    cond = F.lit(True)
    if lo is not None:
        cond = cond & F.coalesce(c >= F.lit(lo), F.lit(True))
    if hi is not None:
        cond = cond & F.coalesce(c <= F.lit(hi), F.lit(True))
    return cond


def allowed(c: Column, values) -> Column:
    """F9."""
    return c.isin(list(values))


def ratio(num: Column, den: Column, empty=0.0) -> Column:
    """guarded division, ``empty`` when the denominator is 0."""
    return F.when(den > 0, num.cast("double") / den).otherwise(F.lit(float(empty)))


def pct2(x: Column) -> Column:
    """ratio as a percentage rounded to two places."""
    return F.round(x * 100, 2)


def not_older_than(ts: Column, as_of, max_age_hours: float) -> Column:
    """``ts >= as_of - max_age_hours``; NULL (unparsable) is not timely."""
    cutoff = F.lit(as_of).cast("timestamp") - F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), F.lit(float(max_age_hours) * 3600.0))
    return F.coalesce(ts >= cutoff, F.lit(False))
