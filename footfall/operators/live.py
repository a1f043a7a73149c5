"""What is going on now: numbers for the minutes before `as_of`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.functions.text import blank_to_null
from footfall.functions.times import minute_of
from footfall.operators.aggregates import top
from footfall.operators.filters import first_day, since
from footfall.schema import ONLINE_SECONDS, RECENTLY_ACTIVE_SECONDS

MINUTES = 30


def last_activity() -> Column:
    """When a page view was last alive: dt_out when set and later, else dt."""
    out, dt = F.col("dt_out"), F.col("dt")
    return F.when((out > 0) & (out >= dt), out).otherwise(dt)


def alive_since(df: DataFrame, moment: int, end: int | None = None) -> DataFrame:
    """Rows that came at `moment` or later or were still alive then, however long ago they came (and came up to `end`).

    A stored table names the first day that still has such a row by its two time columns, where the files' own minima
    and maxima skip what ended earlier; days before it aren't read for anything else.
    """
    rows = df.where((F.col("dt") >= moment) | (F.col("dt_out") >= moment))
    rows = rows if end is None else rows.where(F.col("dt") <= end)
    if "dt_date" not in df.columns:
        return rows
    oldest = rows.agg(F.min("dt_date")).first()[0]
    days = F.col("dt_date") >= (first_day(moment) if oldest is None else F.lit(oldest))
    return rows.where(days if end is None else days & (F.col("dt_date") <= first_day(end)))


def window_of(as_of: int, minutes: int = MINUTES) -> tuple[int, int]:
    """First and last minute start of the live window."""
    last = as_of - as_of % 60
    return last - (minutes - 1) * 60, last


def live_visits(df: DataFrame, as_of: int) -> DataFrame:
    """Visits touching the window with their first and last minute."""
    first, last = window_of(as_of)
    rows = alive_since(df, first, last + 59).where("visit_id > 0")
    visits = rows.groupBy("visit_id").agg(F.min("dt").alias("began"), F.max(last_activity()).alias("ended"))
    return visits.select(
        "visit_id", minute_of("began").alias("first_minute"), minute_of("ended").alias("last_minute")
    ).where(F.col("last_minute") >= first)


def online_count(df: DataFrame, as_of: int) -> DataFrame:
    """How many visits were active in the last thirty minutes."""
    first, _ = window_of(as_of)
    rows = alive_since(df, first).where("visit_id > 0")
    per = rows.groupBy("visit_id").agg(F.max(last_activity()).alias("ended"))
    return per.agg(F.count_if(minute_of("ended") + 59 >= first).alias("online"))


def minute_grid(spark: SparkSession, as_of: int) -> DataFrame:
    first, last = window_of(as_of)
    minutes = F.sequence(F.lit(first).cast("bigint"), F.lit(last).cast("bigint"), F.lit(60).cast("bigint"))
    return spark.range(1).select(F.explode(minutes).alias("minute"))


def users_per_minute(df: DataFrame, as_of: int) -> DataFrame:
    """Visits alive in each of the thirty minutes.

    Every visit is spread over the minutes it spans inside the window (at most
    thirty rows), so the grid is met by an equality join.
    """
    first, last = window_of(as_of)
    low = F.greatest(F.col("first_minute"), F.lit(first).cast("bigint"))
    high = F.least(F.col("last_minute"), F.lit(last).cast("bigint"))
    alive = live_visits(df, as_of).where(low <= high)
    alive = alive.select(F.explode(F.sequence(low, high, F.lit(60).cast("bigint"))).alias("minute"))
    counts = alive.groupBy("minute").agg(F.count("*").alias("cnt"))
    return _filled(df.sparkSession, counts, as_of)


def values_per_minute(df: DataFrame, column: str, as_of: int) -> DataFrame:
    """Distinct pages or countries in each of the thirty minutes."""
    first, last = window_of(as_of)
    rows = since(df, first, last + 59)
    counts = rows.groupBy(minute_of("dt").alias("minute")).agg(F.count_distinct(blank_to_null(column)).alias("cnt"))
    return _filled(df.sparkSession, counts, as_of)


def _filled(spark: SparkSession, counts: DataFrame, as_of: int) -> DataFrame:
    first, _ = window_of(as_of)
    series = minute_grid(spark, as_of).join(counts, "minute", "left")
    series = series.select(
        "minute",
        F.coalesce("cnt", F.lit(0).cast("bigint")).alias("cnt"),
        F.call_function("div", F.col("minute") - first, F.lit(60)).alias("idx"),
    )
    best = F.max(F.struct(F.col("cnt"), (-F.col("idx")).alias("at")))
    # Thirty rows at most: gathered into one array and unfolded again.
    folded = series.agg(
        F.array_sort(F.collect_list(F.struct("minute", "cnt"))).alias("points"),
        F.greatest(F.max("cnt"), F.lit(1)).alias("max_value"),
        (-best["at"]).alias("peak_index"),
    )
    return folded.select(F.inline("points"), "max_value", "peak_index")


def live_counts(df: DataFrame, as_of: int) -> DataFrame:
    """Distinct pages and countries of the last thirty minutes."""
    rows = since(df, as_of - ONLINE_SECONDS)
    return rows.agg(
        F.count_distinct(blank_to_null("resource")).alias("pages_count"),
        F.count_distinct(blank_to_null("country")).alias("countries_count"),
    )


def recently_active(as_of: int) -> Column:
    since = as_of - RECENTLY_ACTIVE_SECONDS
    return (F.col("dt_out") > since) | (F.col("dt") > since)


def online_now(df: DataFrame, column: str, as_of: int, limit: int = 200) -> DataFrame:
    """Addresses or user names active in the last five minutes, latest first."""
    where = recently_active(as_of)
    if column == "username":
        where = where & (F.col(column) != "") & F.col(column).isNotNull()
    return top(alive_since(df, as_of - RECENTLY_ACTIVE_SECONDS), [column], where, recent=True, limit=limit, share=False)
