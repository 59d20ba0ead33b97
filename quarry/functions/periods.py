"""Period arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Reset periods -> (date_trunc unit, length).
PERIODS = {"hourly": ("HOUR", "1 HOUR"), "daily": ("DAY", "1 DAY"),
           "weekly": ("WEEK", "7 DAYS"), "monthly": ("MONTH", "1 MONTH")}


def period_start(ts: Column, period: str) -> Column:
    """start of the hourly/daily/weekly (Monday)/monthly period; any
    other name is monthly."""
    unit, _ = PERIODS.get(period, PERIODS["monthly"])
    return F.date_trunc(unit, ts.cast("timestamp"))


def period_end(start: Column, period: str) -> Column:
    _, length = PERIODS.get(period, PERIODS["monthly"])
    if period == "monthly" or period not in PERIODS:
        return F.add_months(start, 1).cast("timestamp")
    return start + F.expr(f"INTERVAL {length}")


def period_start_col(ts: Column, period: Column) -> Column:
    """F11 with the period name in a column (one quota row per period)."""
    t = ts.cast("timestamp")
    return (F.when(period == "hourly", F.date_trunc("HOUR", t))
            .when(period == "daily", F.date_trunc("DAY", t))
            .when(period == "weekly", F.date_trunc("WEEK", t))
            .otherwise(F.date_trunc("MONTH", t)))


def period_end_col(start: Column, period: Column) -> Column:
    return (F.when(period == "hourly", start + F.expr("INTERVAL 1 HOUR"))
            .when(period == "daily", start + F.expr("INTERVAL 1 DAY"))
            .when(period == "weekly", start + F.expr("INTERVAL 7 DAYS"))
            .otherwise(F.add_months(start, 1).cast("timestamp")))


def bytes_to_gb(c: Column) -> Column:
    """F22."""
    return c / F.lit(1024 ** 3)


def duration_seconds(start: Column, end: Column) -> Column:
    """F25."""
    return F.unix_seconds(end.cast("timestamp")) - F.unix_seconds(start.cast("timestamp"))


def duration_ms(start: Column, end: Column) -> Column:
    return F.unix_millis(end.cast("timestamp")) - F.unix_millis(start.cast("timestamp"))
