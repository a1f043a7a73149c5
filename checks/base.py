"""Registry of queries with their checking SQL, and the inputs they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from footfall.operators.filters import in_time_range
from footfall.sources import testdata

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# 2024-01-08 00:00:00 .. 2024-01-21 23:59:59
START, END = 1704672000, 1705881599
# 2024-01-01 00:00:00, the first day of the data
FIRST = 1704067200
# 2024-01-15 12:34:56, a moment inside the data
MIDDAY = 1705322096
SITE = "example.com"


def _columns(expressions: dict[str, str]) -> str:
    return ",\n    ".join(f"{text} AS {name}" for name, text in expressions.items())


_TABLES = f"""c AS MATERIALIZED (SELECT count(*) AS n_pages FROM pages),
e AS MATERIALIZED (
  SELECT event_id, user_id, event_type, value, epoch_us(ts) // 1000000 AS dt, dayofyear(ts) AS doy,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
         event_id % n_pages AS page_key, (event_id * 7 + 3) % n_pages AS from_key, user_id % 25 AS nation_key
  FROM events CROSS JOIN c),
pageviews AS (
  SELECT {_columns(testdata.PAGEVIEW_SQL)}
  FROM e
  JOIN (SELECT page_id, url FROM pages) p ON p.page_id = e.page_key
  JOIN (SELECT page_id, url FROM pages) r ON r.page_id = e.from_key
  JOIN nation n ON n.n_nationkey = e.nation_key),
site_events AS (
  SELECT {_columns(testdata.EVENT_SQL)}
  FROM e WHERE e.event_type IN ('click', 'signup', 'purchase')),
ranged AS (SELECT * FROM pageviews WHERE dt BETWEEN {START} AND {END})"""


def sql(body: str, ctes: str = "", recursive: bool = False) -> str:
    """Checking SQL over `pageviews`, `site_events` and `ranged` (the report range)."""
    more = f",\n{ctes}" if ctes else ""
    return f"WITH {'RECURSIVE ' if recursive else ''}{_TABLES}{more}\n{body}"


def check(name: str, oracle: str | None = None):
    """Register a query, with its checking SQL where there is one."""

    def register(function):
        QUERIES[name] = function
        if oracle:
            ORACLE[name] = oracle
        return function

    return register


def pv(spark: SparkSession, sf_dir: str, columns: str) -> DataFrame:
    return testdata.pageviews(spark, sf_dir, columns)


def ranged(spark: SparkSession, sf_dir: str, columns: str) -> DataFrame:
    """Page views of the report range; the range also reaches the scan."""
    names = columns.split()
    names += [] if "dt" in names else ["dt"]
    return in_time_range(testdata.pageviews(spark, sf_dir, " ".join(names), START, END), START, END)


def events(spark: SparkSession, sf_dir: str, columns: str = "") -> DataFrame:
    return testdata.site_events(spark, sf_dir, columns)


def last_moment(spark: SparkSession, sf_dir: str) -> int:
    """`as_of` of the live queries: the newest time in the data."""
    return testdata.last_moment(spark.sparkContext.applicationId, sf_dir)


LAST_MOMENT_SQL = "(SELECT max(dt) FROM pageviews)"


def percent_sql(part: str, whole: str, scale: int = 100) -> str:
    """`scale * part / whole` with two decimals, half up, in whole numbers."""
    return (
        f"CASE WHEN {whole} > 0 THEN (({part}) * {200 * scale} + {whole}) // (2 * {whole}) / CAST(100 AS DOUBLE) "
        f"ELSE CAST(0 AS DOUBLE) END"
    )

