"""Page views and site events derived from the shared test tables.

One expression per column serves Spark and the checking SQL alike, so both
sides read the same definition. Only the joins a query's columns need are made.
"""

from __future__ import annotations

from datetime import datetime, timezone
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.schema import EVENT, EVENT_COLUMNS, PAGEVIEW, PAGEVIEW_COLUMNS

# User agents dealt out by e.k; golden answers are in checks/agents.py.
AGENTS = [
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/130.0.0.0 Safari/537.36",
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64; rv:121.0) Gecko/20100101 Firefox/121.0",
    "Mozilla/5.0 (iPhone; CPU iPhone OS 17_0 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/17.0 Mobile/15E148 Safari/604.1",
    "Mozilla/5.0 (Linux; Android 14; Pixel 8) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/130.0.0.0 Mobile Safari/537.36",
    "Mozilla/5.0 (compatible; Googlebot/2.1; +http://www.google.com/bot.html)",
    "Mozilla/5.0 (compatible; bingbot/2.0; +http://www.bing.com/bingbot.htm)",
    "Googlebot-Image/1.0",
    "Mozilla/5.0 (Windows NT 6.1; WOW64; Trident/7.0; rv:11.0) like Gecko",
    "Mozilla/5.0 (X11; Ubuntu; Linux x86_64; rv:109.0) Gecko/20100101 Firefox/115.0",
    "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/128.0.0.0 Safari/537.36 OPR/114.0.0.0",
    "curl/8.0",
    "WordPress/6.4",
    "",
]


def _agent_case() -> str:
    arms = " ".join(f"WHEN {i} THEN '{a}'" for i, a in enumerate(AGENTS))
    return f"CASE e.k % {len(AGENTS)} {arms} END"


# Column expressions that mean the same to Spark and to the checking engine.
PAGEVIEW_SQL = {
    "id": "e.event_id + 1",
    "ip": "concat('10.', e.user_id % 8, '.', e.user_id % 250, '.', e.k % 4 + 1)",
    "other_ip": "CASE WHEN e.k % 20 = 1 THEN concat('192.168.0.', e.user_id % 200) END",
    "username": "CASE WHEN e.user_id % 3 = 0 THEN concat('user', e.user_id) END",
    "email": "CASE WHEN e.user_id % 3 = 0 THEN concat('user', e.user_id, '@example.com') END",
    "country": "CASE WHEN e.user_id % 25 <> 0 THEN lower(n.n_name) END",
    "location": "CASE WHEN e.user_id % 25 > 5 THEN concat(e.user_id % 90, ',', e.user_id % 180) END",
    "city": "CASE WHEN e.user_id % 25 > 5 THEN concat('city', e.user_id % 40) END",
    "referer": "CASE WHEN e.k % 5 = 0 THEN NULL ELSE r.url END",
    "resource": "CASE WHEN e.k = 99 THEN NULL ELSE regexp_extract(p.url, '^[a-z]+://[^/]+(/[^#]*)', 1) END",
    "searchterms": "CASE WHEN e.event_type = 'view' AND e.k % 10 < 3 THEN concat('term ', e.k % 10) WHEN e.k % 50 = 7 THEN '' END",
    "notes": "CASE WHEN e.user_id % 3 = 0 THEN concat('[user:', e.user_id, ']') WHEN e.k % 7 = 0 THEN '[new:yes][pre:yes]' END",
    "visit_id": "CASE WHEN e.event_type = 'error' THEN 0 ELSE e.user_id * 1000 + e.doy END",
    "server_latency": "CAST(floor(e.value * 10) AS BIGINT)",
    "page_performance": "e.k * 20",
    "browser": "CASE e.k % 5 WHEN 0 THEN 'Chrome' WHEN 1 THEN 'Firefox' WHEN 2 THEN 'Safari' WHEN 3 THEN 'Edge' ELSE 'Googlebot' END",
    "browser_version": "concat('', 100 + e.k % 3)",
    "browser_type": "CASE e.k % 5 WHEN 4 THEN 1 WHEN 2 THEN 2 ELSE 0 END",
    "platform": "CASE e.k % 5 WHEN 0 THEN 'win10' WHEN 1 THEN 'win11' WHEN 2 THEN 'ios' WHEN 3 THEN 'macosx' ELSE 'linux' END",
    "language": "CASE e.user_id % 5 WHEN 0 THEN 'en-us' WHEN 1 THEN 'en-gb' WHEN 2 THEN 'fr-fr' WHEN 3 THEN 'de-de' ELSE 'es-es' END",
    "fingerprint": "concat('fp', e.user_id % 97)",
    "user_agent": _agent_case(),
    "resolution": "concat(1000 + 10 * (e.k % 9), 'x', 700 + 10 * (e.k % 9))",
    "screen_width": "CASE WHEN e.k % 9 = 0 THEN 0 ELSE 1280 + 320 * (e.k % 3) END",
    "screen_height": "CASE WHEN e.k % 9 = 0 THEN 0 ELSE 720 + 180 * (e.k % 3) END",
    "content_type": "CASE e.event_type WHEN 'view' THEN 'post' WHEN 'click' THEN 'page' WHEN 'signup' THEN 'category' WHEN 'purchase' THEN 'download' ELSE '404' END",
    "category": "CASE WHEN e.event_type = 'signup' THEN concat(e.k % 7, ',', e.k % 11) END",
    "author": "CASE WHEN e.event_type IN ('view', 'click') THEN concat('author', e.k % 6) END",
    "content_id": "e.event_id % 50",
    "outbound_resource": "CASE WHEN e.k % 6 = 0 THEN concat(r.url, ';;;', p.url) WHEN e.k % 6 = 1 THEN r.url END",
    "tz_offset": "-60 * (e.user_id % 5)",
    "dt_out": "CASE WHEN e.k % 4 = 0 THEN 0 ELSE e.dt + e.k * 7 END",
    "dt": "e.dt",
}

EVENT_SQL = {
    "event_id": "e.event_id + 1",
    "type": "0",
    "event_description": "NULL",
    "notes": "CASE WHEN e.event_type = 'click' THEN 'type:click' WHEN e.k % 2 = 0 THEN concat('type:', e.event_type) ELSE concat('goal ', e.k % 8) END",
    "position": "CASE WHEN e.k % 10 = 0 THEN concat('', e.k * 1013) ELSE concat(e.k * 11, ',', e.k * 7) END",
    "id": "e.event_id + 1",
    "dt": "e.dt",
}

_PAGE = {"resource", "outbound_resource"}
_REFERRING_PAGE = {"referer", "outbound_resource"}
_LINKED = _PAGE | _REFERRING_PAGE
_NATION = {"country"}


def _epoch_literal(seconds: int) -> str:
    moment = datetime.fromtimestamp(seconds, timezone.utc)
    return f"TIMESTAMP_NTZ '{moment:%Y-%m-%d %H:%M:%S}'"


def base_events(
    spark: SparkSession, sf_dir: str, start: int | None = None, end: int | None = None
) -> DataFrame:
    """`events` with dt, doy and k; a range becomes a predicate on the scanned column."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    if start is not None:
        events = events.where(f"ts >= {_epoch_literal(start)}")
    if end is not None:
        events = events.where(f"ts < {_epoch_literal(end + 1)}")
    return events.selectExpr(
        "event_id",
        "user_id",
        "event_type",
        "value",
        "unix_timestamp(CAST(ts AS TIMESTAMP)) AS dt",
        "dayofyear(ts) AS doy",
        "CAST(get_json_object(props, '$.k') AS BIGINT) AS k",
    )


@lru_cache(maxsize=64)
def last_moment(application: str, sf_dir: str) -> int:
    """The newest time in the data, the clock of the live queries; asked once per session."""
    return base_events(SparkSession.active(), sf_dir).agg(F.max("dt")).first()[0]


@lru_cache(maxsize=64)
def page_count(application: str, sf_dir: str) -> int:
    """Rows of `pages` (a count from the file footers), asked once per session."""
    return SparkSession.active().read.parquet(f"{sf_dir}/pages.parquet").count()


def pageviews(
    spark: SparkSession, sf_dir: str, columns: str = "", start: int | None = None, end: int | None = None
) -> DataFrame:
    """Page views with the named columns (all 33 when none are named)."""
    wanted = columns.split() or PAGEVIEW_COLUMNS
    rows = base_events(spark, sf_dir, start, end).alias("e")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    n_pages = page_count(spark.sparkContext.applicationId, sf_dir) if _LINKED & set(wanted) else 1
    if _PAGE & set(wanted):
        rows = rows.join(pages.alias("p"), F.col("e.event_id") % n_pages == F.col("p.page_id"))
    if _REFERRING_PAGE & set(wanted):
        rows = rows.join(pages.alias("r"), (F.col("e.event_id") * 7 + 3) % n_pages == F.col("r.page_id"))
    if _NATION & set(wanted):
        nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name").alias("n")
        rows = rows.join(nation, F.col("e.user_id") % 25 == F.col("n.n_nationkey"))
    return rows.select(*[F.expr(PAGEVIEW_SQL[c]).cast(PAGEVIEW[c].dataType).alias(c) for c in wanted])


def site_events(
    spark: SparkSession, sf_dir: str, columns: str = "", start: int | None = None, end: int | None = None
) -> DataFrame:
    """Clicks and custom events with the named columns (all when none are named)."""
    wanted = columns.split() or EVENT_COLUMNS
    rows = base_events(spark, sf_dir, start, end).alias("e")
    rows = rows.where("e.event_type IN ('click', 'signup', 'purchase')")
    return rows.select(*[F.expr(EVENT_SQL[c]).cast(EVENT[c].dataType).alias(c) for c in wanted])
