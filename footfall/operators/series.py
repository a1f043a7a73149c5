"""Time series: steps, current and previous period, zero-filled grids."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.functions.times import step_start
from footfall.schema import DAY
from footfall.sources.tables import day_range

# Aggregate functions a chart may use.
MEASURES = ("COUNT", "SUM", "AVG", "MAX", "MIN")


def measure(function: str, column: str, distinct: bool = False) -> Column:
    """COUNT, SUM, AVG, MAX or MIN over `*`, a column or its distinct values, as a whole number."""
    name = function.upper()
    if name not in MEASURES:
        raise ValueError(f"measure {function} is not one of {', '.join(MEASURES)}")
    if column == "*":
        return F.count("*")
    plain = {"COUNT": F.count, "SUM": F.sum, "AVG": F.avg, "MAX": F.max, "MIN": F.min}
    different = {"COUNT": F.count_distinct, "SUM": F.sum_distinct}
    if distinct and name == "AVG":
        out = F.call_function("div", F.sum_distinct(F.col(column)), F.count_distinct(column))
    else:
        out = (different if distinct else plain).get(name, plain[name])(F.col(column))
    return out.cast("bigint")


def previous_range(start: int, end: int) -> tuple[int, int]:
    """The comparison period: same length, its start moved back to midnight."""
    length = end - start
    first = start - length
    return first - first % DAY, end - length


def both_periods(df: DataFrame, start: int, end: int) -> DataFrame:
    """Rows of the current and the previous range, labelled; current wins an overlap."""
    before, until = previous_range(start, end)
    now, then = F.col("dt").between(start, end), F.col("dt").between(before, until)
    rows = df.where(now | then)
    if "dt_date" in df.columns:
        rows = rows.where(day_range(start, end) | day_range(before, until))
    return rows.withColumn("period", F.when(now, F.lit("current")).otherwise(F.lit("previous")))


def chart_rows(
    df: DataFrame, start: int, end: int, step: str, v1: Column, v2: Column,
    where: Column | None = None, first_weekday: int = 1,
) -> DataFrame:
    """Two measures per step and period, one scan for both periods."""
    rows = both_periods(df if where is None else df.where(where), start, end)
    grouped = rows.groupBy(step_start("dt", step, first_weekday).alias("bucket"), "period")
    return grouped.agg(F.min("dt").alias("sort_dt"), v1.alias("v1"), v2.alias("v2"))


def chart_totals(
    df: DataFrame, start: int, end: int, v1: Column, v2: Column, where: Column | None = None
) -> DataFrame:
    """The same measures per period without steps."""
    rows = both_periods(df if where is None else df.where(where), start, end)
    return rows.groupBy("period").agg(v1.alias("v1"), v2.alias("v2"))


def _utc(seconds: int) -> datetime:
    return datetime.fromtimestamp(seconds, timezone.utc)


def _aligned(start: int, step: str, first_weekday: int) -> datetime:
    moment = _utc(start)
    if step == "hour":
        return moment.replace(minute=0, second=0)
    day = moment.replace(hour=0, minute=0, second=0)
    if step == "week":
        return day - timedelta(days=(day.isoweekday() % 7 - first_weekday) % 7)
    if step == "month":
        return day.replace(day=1)
    return day.replace(month=1, day=1) if step == "year" else day


def step_ordinal(dt: Column, start: int, step: str, first_weekday: int = 1) -> Column:
    """How many steps after the step of `start` a time lies."""
    base = _aligned(start, step, first_weekday)
    seconds = {"hour": 3600, "day": DAY, "week": 7 * DAY}
    if step in seconds:
        begin = step_start(dt, step, first_weekday)
        return F.call_function("div", begin - int(base.timestamp()), F.lit(seconds[step])).cast("int")
    stamp = F.timestamp_seconds(dt)
    years = F.year(stamp) - base.year
    return years if step == "year" else years * 12 + F.month(stamp) - base.month


def grid(spark: SparkSession, start: int, end: int, step: str, first_weekday: int = 1) -> DataFrame:
    """One row per step of a range: ordinal, start second, and label.

    The first step is labelled with the start of the range (a partial week).
    """
    base = _aligned(start, step, first_weekday)
    unit = {"hour": "INTERVAL 1 HOUR", "day": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAY",
            "month": "INTERVAL 1 MONTH", "year": "INTERVAL 1 YEAR"}[step]
    steps = spark.range(1).select(
        F.posexplode(
            F.sequence(
                F.timestamp_seconds(F.lit(int(base.timestamp()))), F.timestamp_seconds(F.lit(end)), F.expr(unit)
            )
        ).alias("ordinal", "begins")
    )
    shape = {"hour": "yyyy/MM/dd HH:00:00", "month": "MMMM yyyy", "year": "yyyy"}.get(step, "yyyy/MM/dd")
    shown = F.greatest(F.col("begins"), F.timestamp_seconds(F.lit(start))) if step == "week" else F.col("begins")
    return steps.select("ordinal", F.unix_timestamp("begins").alias("bucket"), F.date_format(shown, shape).alias("label"))


def chart(
    df: DataFrame, start: int, end: int, step: str, v1: Column, v2: Column,
    where: Column | None = None, first_weekday: int = 1,
) -> DataFrame:
    """The finished series: every step, both periods side by side, zeros filled in.

    Rows are aggregated first; only one row per step meets the grid. Steps of
    the previous period are matched by their ordinal; those beyond the grid
    are left out.
    """
    before, _ = previous_range(start, end)
    rows = chart_rows(df, start, end, step, v1, v2, where, first_weekday)
    current = F.col("period") == "current"
    ordinal = F.when(current, step_ordinal(F.col("bucket"), start, step, first_weekday)).otherwise(
        step_ordinal(F.col("bucket"), before, step, first_weekday)
    )
    wide = rows.groupBy(ordinal.alias("ordinal")).agg(
        *[
            F.sum(F.when(F.col("period") == p, F.col(v))).alias(n)
            for v in ("v1", "v2")
            for p, n in (("current", v), ("previous", f"{v}_prev"))
        ]
    )
    frame = grid(df.sparkSession, start, end, step, first_weekday)
    filled = [F.coalesce(n, F.lit(0)).alias(n) for n in ("v1", "v2", "v1_prev", "v2_prev")]
    return frame.join(wide, "ordinal", "left").select("ordinal", "bucket", "label", *filled)


def default_step(start: int, end: int) -> str:
    """Step width that suits a span."""
    days = (end - start) / DAY
    for limit, step in ((547.5, "year"), (90, "month"), (7, "week"), (2, "day")):
        if days > limit:
            return step
    return "hour"
