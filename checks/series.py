"""Charts: steps, measures, totals, zero filling."""

from __future__ import annotations


from checks.base import END, START, check, pv, sql
from footfall.operators import series

# A range that starts inside a week, a day and an hour.
ODD_START, ODD_END = 1704846896, 1705838400 + 4000


def bucket_sql(step: str, dt: str, first_weekday: int = 1) -> str:
    stamp = f"make_timestamp(CAST({dt} AS BIGINT) * 1000000)"
    if step == "week":
        day = f"CAST({stamp} AS DATE)"
        return f"CAST(epoch(CAST({day} - CAST((dayofweek({day}) - {first_weekday} + 7) % 7 AS INTEGER) AS TIMESTAMP)) AS BIGINT)"
    return f"CAST(epoch(CAST(date_trunc('{step}', {stamp}) AS TIMESTAMP)) AS BIGINT)"


def previous(start: int, end: int) -> tuple[int, int]:
    return (start - (end - start)) // 86400 * 86400, end - (end - start)


_UNIT = {"hour": "INTERVAL 1 HOUR", "day": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAY",
         "month": "INTERVAL 1 MONTH", "year": "INTERVAL 1 YEAR"}
_LABEL = {"hour": "%Y/%m/%d %H:00:00", "month": "%B %Y", "year": "%Y"}


def chart_sql(step: str, v1: str, v2: str, start: int = START, end: int = END, where: str = "true",
              first_weekday: int = 1) -> str:
    """Checking SQL of a finished series: grid per period, numbered, then joined by number."""
    before, until = previous(start, end)
    base, prev_base = (bucket_sql(step, str(s), first_weekday) for s in (start, before))
    shown = f"greatest(g.b, make_timestamp(CAST({start} AS BIGINT) * 1000000))" if step == "week" else "g.b"
    label = f"strftime({shown}, '{_LABEL.get(step, '%Y/%m/%d')}')"

    def steps(first: str, last: int) -> str:
        return (
            f"SELECT row_number() OVER (ORDER BY b) - 1 AS ordinal, CAST(epoch(b) AS BIGINT) AS bucket, b FROM (SELECT unnest("
            f"generate_series(make_timestamp(CAST({first} AS BIGINT) * 1000000), make_timestamp(CAST({last} AS BIGINT) * 1000000), {_UNIT[step]})) AS b) AS s"
        )

    ctes = f"""both_periods AS (
  SELECT *, CASE WHEN dt BETWEEN {start} AND {end} THEN 'current' ELSE 'previous' END AS period
  FROM pageviews WHERE (dt BETWEEN {start} AND {end} OR dt BETWEEN {before} AND {until}) AND ({where})),
grouped AS (SELECT period, {bucket_sql(step, 'dt', first_weekday)} AS bucket, {v1} AS v1, {v2} AS v2 FROM both_periods GROUP BY 1, 2),
grid AS ({steps(base, end)}),
prev_grid AS ({steps(prev_base, end)})"""
    return sql(
        f"""SELECT g.ordinal, g.bucket, {label} AS label, coalesce(now.v1, 0) AS v1, coalesce(now.v2, 0) AS v2,
       coalesce(old.v1, 0) AS v1_prev, coalesce(old.v2, 0) AS v2_prev
FROM grid g JOIN prev_grid pg ON pg.ordinal = g.ordinal
LEFT JOIN grouped now ON now.period = 'current' AND now.bucket = g.bucket
LEFT JOIN grouped old ON old.period = 'previous' AND old.bucket = pg.bucket""",
        ctes,
    )


def _chart(step, v1, v2, columns, start=START, end=END, first_weekday=1):
    def query(spark, sf_dir):
        rows = pv(spark, sf_dir, columns)
        return series.chart(rows, start, end, step, series.measure(*v1), series.measure(*v2), first_weekday=first_weekday)

    return query


_HITS, _IPS = ("COUNT", "id"), ("COUNT", "ip", True)
_SQL = ("count(id)", "count(DISTINCT ip)")

check("bucket_hour", chart_sql("hour", *_SQL, START, START + 3 * 86400 - 1))(
    _chart("hour", _HITS, _IPS, "id ip dt", START, START + 3 * 86400 - 1)
)
check("bucket_day", chart_sql("day", *_SQL))(_chart("day", _HITS, _IPS, "id ip dt"))
check("bucket_week", chart_sql("week", *_SQL, ODD_START, ODD_END, first_weekday=6))(
    _chart("week", _HITS, _IPS, "id ip dt", ODD_START, ODD_END, 6)
)
check("bucket_month", chart_sql("month", *_SQL, 1698796800, END))(_chart("month", _HITS, _IPS, "id ip dt", 1698796800, END))
check("bucket_year", chart_sql("year", *_SQL, 1640995200, END))(_chart("year", _HITS, _IPS, "id ip dt", 1640995200, END))
check("bucket_zero_fill", chart_sql("hour", *_SQL, ODD_START, ODD_END))(
    _chart("hour", _HITS, _IPS, "id ip dt", ODD_START, ODD_END)
)


def _periods_sql(select: str, group: str) -> str:
    before, until = previous(START, END)
    return sql(
        f"""SELECT {select} FROM (SELECT *, CASE WHEN dt BETWEEN {START} AND {END} THEN 'current' ELSE 'previous' END AS period
  FROM pageviews WHERE dt BETWEEN {START} AND {END} OR dt BETWEEN {before} AND {until}) AS b GROUP BY {group}"""
    )


@check(
    "chart_series",
    _periods_sql(
        f"{bucket_sql('day', 'dt')} AS bucket, period, min(dt) AS sort_dt, "
        "count(DISTINCT visit_id) AS v1, count(DISTINCT ip) AS v2",
        "1, 2",
    ),
)
def chart_series(spark, sf_dir):
    v1, v2 = series.measure("COUNT", "visit_id", True), series.measure("COUNT", "ip", True)
    return series.chart_rows(pv(spark, sf_dir, "visit_id ip dt"), START, END, "day", v1, v2)


@check("chart_totals", _periods_sql("period, count(DISTINCT visit_id) AS v1, count(DISTINCT ip) AS v2", "1"))
def chart_totals(spark, sf_dir):
    v1, v2 = series.measure("COUNT", "visit_id", True), series.measure("COUNT", "ip", True)
    return series.chart_totals(pv(spark, sf_dir, "visit_id ip dt"), START, END, v1, v2)


@check(
    "chart_measures",
    sql(
        f"""SELECT {bucket_sql('day', 'dt')} AS bucket, count(*) AS all_rows, count(username) AS named,
  count(DISTINCT username) AS names, CAST(sum(server_latency) AS BIGINT) AS total, CAST(trunc(avg(server_latency)) AS BIGINT) AS mean,
  max(server_latency) AS most, min(server_latency) AS least, CAST(sum(DISTINCT screen_width) AS BIGINT) AS widths,
  CAST(sum(DISTINCT screen_width) AS BIGINT) // count(DISTINCT screen_width) AS mean_width
FROM pageviews GROUP BY 1"""
    ),
)
def chart_measures(spark, sf_dir):
    from footfall.functions.times import step_start

    m = series.measure
    rows = pv(spark, sf_dir, "dt username server_latency screen_width")
    return rows.groupBy(step_start("dt", "day").alias("bucket")).agg(
        m("COUNT", "*").alias("all_rows"),
        m("COUNT", "username").alias("named"),
        m("COUNT", "username", True).alias("names"),
        m("SUM", "server_latency").alias("total"),
        m("AVG", "server_latency").alias("mean"),
        m("MAX", "server_latency").alias("most"),
        m("MIN", "server_latency").alias("least"),
        m("SUM", "screen_width", True).alias("widths"),
        m("AVG", "screen_width", True).alias("mean_width"),
    )
