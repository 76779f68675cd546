"""Viewer-local days and calendar arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import _c


def to_local(ts, offset_minutes: int = 0) -> Column:
    """UTC timestamp in the viewer's clock; the offset is minutes behind UTC (UTC+3 is -180)."""
    return _c(ts) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(-int(offset_minutes)))


def local_day(ts, offset_minutes: int = 0) -> Column:
    return F.to_date(to_local(ts, offset_minutes))


def weekday(day) -> Column:
    return F.date_format(_c(day), "EEEE")


def days_between(later, earlier) -> Column:
    """Whole days that have passed (floor), as a difference of instants."""
    seconds = F.unix_timestamp(_c(later)) - F.unix_timestamp(_c(earlier))
    return F.floor(seconds / 86400).cast("long")


def days_left(until, at) -> Column:
    """Days until an instant, rounded up, never below 0."""
    seconds = F.unix_timestamp(_c(until)) - F.unix_timestamp(_c(at))
    return F.greatest(F.lit(0), F.ceil(seconds / 86400)).cast("long")


def month_start(ts) -> Column:
    return F.date_trunc("month", _c(ts))


def year_start(ts) -> Column:
    return F.date_trunc("year", _c(ts))


def last_year(ts) -> Column:
    """Same instant one year earlier."""
    return _c(ts) - F.make_ym_interval(F.lit(1))


def add_months(ts, months: int) -> Column:
    return _c(ts) + F.make_ym_interval(F.lit(0), F.lit(months))
