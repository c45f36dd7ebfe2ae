"""Rounding, parsing and unit helpers that keep the published figures' conventions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    """Nearest integer, halves towards plus infinity (-2.5 -> -2)."""
    return F.floor(x + 0.5).cast("bigint")


def half_even(x: Column) -> Column:
    """Nearest integer, halves to the even neighbour."""
    return F.bround(x, 0).cast("bigint")


def days_between(start: Column, end: Column) -> Column:
    """Fractional days between two timestamps, to the microsecond."""
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(86400000000.0)


def iso_duration_seconds(text: Column, *, anchored: bool = False) -> Column:
    """PT#H#M#S to whole seconds; anything without the pattern is 0."""
    pattern = r"PT(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?"
    if anchored:
        pattern = f"^{pattern}$"

    def part(i: int) -> Column:
        return F.coalesce(F.regexp_extract(text, pattern, i).try_cast("bigint"), F.lit(0))

    return F.coalesce(part(1) * 3600 + part(2) * 60 + part(3), F.lit(0)).cast("bigint")


def nullable_count(text: Column) -> Column:
    """Leading integer of a counter field; hidden or junk values stay unknown."""
    return F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast("bigint")


def money(text: Column) -> Column:
    """'$1,234.50' to a decimal amount, junk to null."""
    return F.trim(F.regexp_replace(text, "[$,]", "")).try_cast("decimal(12,2)")


def exact_count(text: Column) -> Column:
    """A number only if the field is nothing but digits; lower bounds are unknown."""
    field = F.trim(text)
    return F.when(field.rlike(r"^\d+$"), field.try_cast("bigint"))


def is_short(duration: Column, published_at: Column, *, cutoff_sec: int = 180,
             since: str = "2021-03-18", live: Column | None = None) -> Column:
    """Short-format test by length and by the date the format came into being."""
    short = (duration > 0) & (duration <= cutoff_sec) & (published_at >= F.lit(since).cast("timestamp"))
    return F.coalesce(short if live is None else ~live & short, F.lit(False))
