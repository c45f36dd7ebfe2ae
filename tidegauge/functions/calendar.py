"""Day, month and time-zone helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOCAL_TZ = "America/Chicago"


def local_day(ts: Column, tz: str = LOCAL_TZ) -> Column:
    """Calendar day of an instant in the creator's own time zone."""
    return F.to_date(F.from_utc_timestamp(ts, tz))


def local_month(ts: Column, tz: str = LOCAL_TZ) -> Column:
    return F.date_format(F.from_utc_timestamp(ts, tz), "yyyy-MM")


def month_of(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def month_start(month: Column) -> Column:
    return F.to_date(F.concat(month, F.lit("-01")))


def shift_month(month: Column, delta: int) -> Column:
    return month_of(F.add_months(month_start(month), delta))


def days_in_month(month: Column) -> Column:
    return F.dayofmonth(F.last_day(month_start(month)))


def final_week_start(month: Column) -> Column:
    """First day of the last seven days of the month before."""
    return F.date_sub(month_start(month), 7)


def same_point(at: Column, months_back: int, tz: str = LOCAL_TZ) -> Column:
    """The same local day of the month (clamped) at the same UTC clock time, months earlier."""
    month = shift_month(local_month(at, tz), -months_back)
    dom = F.least(F.dayofmonth(local_day(at, tz)), days_in_month(month))
    day = F.date_add(month_start(month), dom - 1)
    clock = F.hour(at) * 3600 + F.minute(at) * 60
    return F.timestamp_seconds(F.unix_seconds(day.cast("timestamp")) + clock)
