"""Named date ranges and range arguments."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.schema import DAY

DEFAULT_DAYS = -28


def presets(spark: SparkSession, as_of: int, first_weekday: int = 1) -> DataFrame:
    """The twelve named ranges around `as_of`, as (name, start, end) epoch seconds."""
    today = F.to_date(F.timestamp_seconds(F.lit(as_of)))

    def week(day: Column) -> Column:
        return F.date_sub(day, F.pmod(F.dayofweek(day) - 1 - first_weekday, F.lit(7)))

    def month(day: Column) -> Column:
        return F.to_date(F.date_trunc("month", day))

    this_week, last_week = week(today), week(F.date_sub(today, 7))
    last_month = F.add_months(month(today), -1)
    year = F.to_date(F.date_trunc("year", today))
    ranges = {
        "today": (today, today),
        "yesterday": (F.date_sub(today, 1), F.date_sub(today, 1)),
        "this_week": (this_week, F.date_add(this_week, 6)),
        "last_week": (last_week, F.date_add(last_week, 6)),
        "this_month": (month(today), F.last_day(today)),
        "last_month": (last_month, F.last_day(last_month)),
        "last_7_days": (F.date_sub(today, 6), today),
        "last_28_days": (F.date_sub(today, 27), today),
        "last_30_days": (F.date_sub(today, 29), today),
        "last_90_days": (F.date_sub(today, 89), today),
        "last_6_months": (F.add_months(today, -6), today),
        "this_year": (year, F.date_sub(F.add_months(year, 12), 1)),
    }

    def second(day: Column) -> Column:
        return F.unix_timestamp(day.cast("timestamp"))

    rows = [
        F.struct(F.lit(n).alias("name"), second(a).alias("start"), (second(b) + DAY - 1).alias("end"))
        for n, (a, b) in ranges.items()
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))


def range_of(dates: dict[str, tuple[str, str]], as_of: int) -> tuple[int, int]:
    """Start and end second out of the date words of a filter text.

    A negative interval counts back from the end of the named (or present)
    day, a positive one forward; a bare day means that day; a future end is
    cut to `as_of`.
    """
    now = datetime.fromtimestamp(as_of, timezone.utc)
    if "strtotime" in dates:
        now = datetime.fromisoformat(dates["strtotime"][1]).replace(tzinfo=timezone.utc)

    def word(name: str, default: int | None) -> int | None:
        return int(dates[name][1]) if name in dates else default

    day = now.replace(
        year=word("year", now.year), month=word("month", now.month), day=word("day", now.day),
        hour=word("hour", 0), minute=word("minute", 0), second=0, microsecond=0,
    )
    span = timedelta(hours=word("interval_hours", 0), minutes=word("interval_minutes", 0))
    days = word("interval", None)
    if days is None:
        days = -1 if ("day" in dates or span) else DEFAULT_DAYS
    if span:
        first, last = sorted((day, day + span))
    elif days < 0:
        last = day.replace(hour=0, minute=0) + timedelta(days=1, seconds=-1)
        first = last + timedelta(days=days, seconds=1)
    else:
        first, last = day, day + timedelta(days=days, seconds=-1)
    return int(first.timestamp()), min(int(last.timestamp()), as_of)
