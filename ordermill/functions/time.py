"""Time features with the reference's semantics (see SURVEY 1.4 T4-T8)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ordermill.functions.exact import div_floor

MICROS_PER_DAY = 86_400_000_000


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def micros_between(start, end) -> Column:
    """Exact microseconds from ``start`` to ``end`` (TIMESTAMP_NTZ), independent of the
    session time zone: the NTZ difference is a day-time interval, read as seconds.
    (``timestamp_diff`` on NTZ values goes through the session zone and loses or gains an
    hour around a daylight-saving change.)"""
    seconds = (_c(end) - _c(start)).cast("interval second").cast("decimal(20,6)")
    return (seconds * 1_000_000).cast("bigint")


def floor_days(start, end) -> Column:
    """Whole 24-hour periods from ``start`` to ``end``, floored (-1 hour gives -1)."""
    return div_floor(micros_between(start, end), F.lit(MICROS_PER_DAY)).cast("bigint")


def hours_between(start, end) -> Column:
    """Elapsed seconds / 3600 as DOUBLE (negative when ``end`` is earlier)."""
    return micros_between(start, end).cast("double") / 1e6 / 3600.0


def is_late(delivered, estimated) -> Column:
    """``delivered > estimated``; a missing date compares as False (never null)."""
    return F.coalesce(_c(delivered) > _c(estimated), F.lit(False))


def month_label(ts) -> Column:
    return F.date_format(_c(ts), "yyyy-MM")


def weekday_name(ts) -> Column:
    """Full English weekday name ("Monday"), not the three-letter ``dayname``."""
    return F.date_format(_c(ts), "EEEE")


def week_start(ts) -> Column:
    """Monday 00:00 of the ISO week containing ``ts`` (weeks run Monday-Sunday).

    Computed on the calendar date (``dayofweek``: 1 = Sunday ... 7 = Saturday), so it
    does not depend on the session time zone (``date_trunc`` on NTZ values does)."""
    t = _c(ts)
    return F.date_sub(F.to_date(t), (F.dayofweek(t) + 5) % 7).cast("timestamp_ntz")
