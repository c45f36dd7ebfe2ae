"""View de-inflation and revenue bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegauge.functions.numbers import days_between

# Counting-change onset, launch share by age in days, factors, revenue per 1,000 views.
ONSET = "2026-08-27 00:00:00"
LAUNCH_SHARE = [(0.0, 0.0), (0.5, 0.416), (1.0, 0.718), (2.0, 0.917), (3.0, 0.96), (7.0, 0.995), (14.0, 0.999), (21.0, 1.0)]
FACTOR_LOW, FACTOR_MID, FACTOR_HIGH = 1.94, 2.07, 2.24
RPM_LONG = [(480, 0.85, 1.28), (180, 0.50, 1.00), (0, 0.30, 0.60)]
RPM_SHORT = (0.02, 0.07)


def exposure(published_at: Column, *, onset: str = ONSET) -> Column:
    """Share of a video's lifetime views that fell after the counting change."""
    days = days_between(published_at, F.lit(onset).cast("timestamp"))
    out = F.when(days <= 0, 1.0).when(days >= LAUNCH_SHARE[-1][0], 0.0)
    for (d0, a0), (d1, a1) in zip(LAUNCH_SHARE, LAUNCH_SHARE[1:]):
        out = out.when(days <= d1, 1 - (F.lit(a0) + F.lit(a1 - a0) * ((days - d0) / (d1 - d0))))
    return out.otherwise(0.0)


def engaged_views(views: Column, published_at: Column, factor: float, *, onset: str = ONSET) -> Column:
    """Views restated in pre-change terms; factors of 1 or less change nothing."""
    n = F.coalesce(views, F.lit(0)).cast("double")
    if factor <= 1:
        return n
    return n / (1 + (F.lit(factor) - 1) * exposure(published_at, onset=onset))


def rpm(duration: Column, end: str) -> Column:
    """Low or high revenue per 1,000 long-form views by length; an unknown length counts as 600 s."""
    d = F.when(duration > 0, duration).otherwise(600)
    pick = 1 if end == "low" else 2
    first, second, rest = RPM_LONG
    return F.when(d >= first[0], first[pick]).when(d >= second[0], second[pick]).otherwise(rest[pick])
