"""Epoch seconds, calendar steps and formats. The stored clock is local time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from footfall.functions.text import as_column

STEPS = ("hour", "day", "week", "month", "year")


def as_timestamp(dt) -> Column:
    return F.timestamp_seconds(as_column(dt))


def day_of(dt) -> Column:
    return F.to_date(as_timestamp(dt))


def minute_of(dt) -> Column:
    dt = as_column(dt)
    return dt - F.pmod(dt, F.lit(60))


def step_start(dt, step: str, first_weekday: int = 1) -> Column:
    """Epoch second at which the step of `dt` begins (weekday 0 is Sunday)."""
    if step == "week":
        day = day_of(dt)
        back = F.pmod(F.dayofweek(day) - 1 - first_weekday, F.lit(7))
        return F.unix_timestamp(F.date_sub(day, back).cast("timestamp"))
    return F.unix_timestamp(F.date_trunc(step, as_timestamp(dt)))


def clock(seconds) -> Column:
    """Seconds as `H:i:s`, or `i:s` below one hour."""
    stamp = as_timestamp(seconds)
    return F.when(as_column(seconds) >= 3600, F.date_format(stamp, "HH:mm:ss")).otherwise(F.date_format(stamp, "mm:ss"))


def shift_zone(dt, source: str, target: str) -> Column:
    """Epoch text moved from one zone to another."""
    return F.convert_timezone(F.lit(source), F.lit(target), as_timestamp(dt).cast("timestamp_ntz"))
