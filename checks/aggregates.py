"""Counts, top lists, summaries, live numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import (
    END, FIRST, LAST_MOMENT_SQL, MIDDAY, SITE, START, check, last_moment, percent_sql, pv, ranged, sql,
)
from footfall.functions.times import day_of
from footfall.functions.urls import referrer_domain
from footfall.operators import aggregates, distinct, live, lifecycle, summaries

DOMAIN_SQL = (
    "replace(array_to_string(string_split(split_part(list_extract(string_split(referer, '://'), -1), '/', 1), '.')"
    "[greatest(len(string_split(split_part(list_extract(string_split(referer, '://'), -1), '/', 1), '.')) - 4, 1):], '.'), 'www.', '')"
)


def top_sql(keys: dict[str, str], where: str = "", having: str = "", recent: bool = False, share: bool = True,
            table: str = "ranged", limit: str = "LIMIT 200") -> str:
    """Checking SQL of a top list."""
    cols = ", ".join(f"{e} AS {n}" for n, e in keys.items())
    group = ", ".join(str(i + 1) for i in range(len(keys)))
    names = ", ".join(keys)
    ties = ", ".join(f"{n} ASC NULLS FIRST" for n in keys)
    order = "dt DESC NULLS LAST" if recent else "counthits DESC"
    pct = f", {percent_sql('counthits', f'(SELECT count(*) FROM {table})')} AS pct" if share else ""
    return (
        f"SELECT {names}, counthits{', dt' if recent else ''}{pct} FROM (SELECT {cols}, count(*) AS counthits, "
        f"max(pvs.dt) AS dt FROM {table} AS pvs {'WHERE ' + where if where else ''} GROUP BY {group} "
        f"{'HAVING ' + having if having else ''}) AS grouped ORDER BY {order}, {ties} {limit}"
    )


@check(
    "count_records",
    sql(
        f"""SELECT count(id) AS rows_in_range, count(DISTINCT ip) AS ips,
       count(DISTINCT CASE WHEN visit_id > 0 AND browser_type <> 1 THEN visit_id END) AS human_visits FROM ranged"""
    ),
)
def count_records(spark, sf_dir):
    rows = ranged(spark, sf_dir, "id ip visit_id browser_type")
    human = F.expr("visit_id > 0 AND browser_type <> 1")
    return aggregates.count_records(rows).select(
        F.col("counthits").alias("rows_in_range"),
        aggregates.count_records(rows, "ip").scalar().alias("ips"),
        aggregates.count_records(rows, "visit_id", human).scalar().alias("human_visits"),
    )


@check(
    "count_records_having",
    sql(
        "SELECT count(*) AS counthits FROM (SELECT visit_id FROM ranged WHERE browser_type <> 1 AND visit_id <> 0 "
        "GROUP BY visit_id HAVING count(id) = 1) AS g"
    ),
)
def count_records_having(spark, sf_dir):
    rows = ranged(spark, sf_dir, "id visit_id browser_type")
    return aggregates.count_groups(rows, "visit_id", F.count("id") == 1, F.expr("browser_type <> 1"))


@check("top_n", sql(top_sql({"resource": "resource"})))
def top_n(spark, sf_dir):
    return aggregates.top(ranged(spark, sf_dir, "resource"), ["resource"])


@check("top_n_multi", sql(top_sql({"browser": "browser", "browser_version": "browser_version"}, "browser_type <> 1")))
def top_n_multi(spark, sf_dir):
    rows = ranged(spark, sf_dir, "browser browser_version browser_type")
    return aggregates.top(rows, ["browser", "browser_version"], F.expr("browser_type <> 1"))


@check("top_n_expr", sql(top_sql({"referer": DOMAIN_SQL}, f"referer NOT LIKE '%{SITE}%'")))
def top_n_expr(spark, sf_dir):
    rows = ranged(spark, sf_dir, "referer")
    return aggregates.top(rows, {"referer": referrer_domain("referer")}, ~F.col("referer").like(f"%{SITE}%"))


@check("top_n_recent", sql(top_sql({"country": "country"}, recent=True)))
def top_n_recent(spark, sf_dir):
    return aggregates.top(ranged(spark, sf_dir, "country"), ["country"], recent=True)


@check(
    "top_n_having",
    sql(top_sql({"resource": "rtrim(resource, '/')", "language": "language"}, "content_type <> '404'", "count(visit_id) = 1")),
)
def top_n_having(spark, sf_dir):
    from footfall.functions.urls import trim_slash

    rows = ranged(spark, sf_dir, "resource language content_type visit_id")
    keys = {"resource": trim_slash("resource"), "language": F.col("language")}
    return aggregates.top(rows, keys, F.expr("content_type <> '404'"), F.count("visit_id") == 1)


@check(
    "percent_of_total",
    sql(f"SELECT platform, count(*) AS counthits, {percent_sql('count(*)', '(SELECT count(*) FROM ranged)')} AS pct FROM ranged GROUP BY platform"),
)
def percent_of_total(spark, sf_dir):
    return aggregates.top(ranged(spark, sf_dir, "platform"), ["platform"], limit=None)


@check(
    "group_concat",
    sql(
        """SELECT resource, count(*) AS counthits, string_agg(DISTINCT username, ';;;' ORDER BY username) AS column_group
FROM ranged WHERE resource IS NOT NULL GROUP BY resource ORDER BY counthits DESC, resource ASC LIMIT 200"""
    ),
)
def group_concat(spark, sf_dir):
    return aggregates.companions(ranged(spark, sf_dir, "resource username"), "resource", "username")


@check(
    "bouncing_pages",
    sql(
        """SELECT count(*) AS counthits FROM (SELECT resource FROM ranged
WHERE resource IS NOT NULL AND visit_id > 0 AND content_type <> '404' GROUP BY resource HAVING count(visit_id) = 1) AS g"""
    ),
)
def bouncing_pages(spark, sf_dir):
    return aggregates.bouncing_pages(ranged(spark, sf_dir, "resource visit_id content_type"))


@check(
    "exit_pages_count",
    sql(
        """SELECT count(DISTINCT resource) AS counthits FROM (SELECT arg_max(resource, id) AS resource
FROM ranged WHERE visit_id > 0 AND resource IS NOT NULL GROUP BY visit_id) AS g"""
    ),
)
def exit_pages_count(spark, sf_dir):
    return aggregates.exit_pages_count(ranged(spark, sf_dir, "id resource visit_id"))


@check(
    "pages_per_visit",
    sql(
        f"""SELECT {percent_sql('CAST(sum(hits) AS BIGINT)', 'count(*)', 1)} AS avghits, max(hits) AS maxhits
FROM (SELECT count(ip) AS hits FROM ranged WHERE visit_id > 0 GROUP BY visit_id) AS g"""
    ),
)
def pages_per_visit(spark, sf_dir):
    return aggregates.pages_per_visit(ranged(spark, sf_dir, "ip visit_id"))


@check("oldest_row", sql("SELECT min(dt) AS dt FROM pageviews"))
def oldest_row(spark, sf_dir):
    return aggregates.oldest_row(pv(spark, sf_dir, "dt"))


def edge_sql(last: bool) -> str:
    pick, edge = ("arg_max", "max") if last else ("arg_min", "min")
    return sql(
        f"""SELECT resource, count(*) AS counthits, {edge}(edge_id) AS sample_id
FROM (SELECT v.visit_id, v.edge_id, p.resource FROM (SELECT visit_id, {edge}(id) AS edge_id FROM ranged
      WHERE visit_id <> 0 GROUP BY visit_id) AS v JOIN ranged p ON p.id = v.edge_id) AS edges
GROUP BY resource ORDER BY counthits DESC, resource ASC NULLS FIRST LIMIT 200"""
    )


@check("edge_pages_entry", edge_sql(False))
def edge_pages_entry(spark, sf_dir):
    return aggregates.edge_pages(ranged(spark, sf_dir, "id resource visit_id"), last=False)


@check("edge_pages_exit", edge_sql(True))
def edge_pages_exit(spark, sf_dir):
    return aggregates.edge_pages(ranged(spark, sf_dir, "id resource visit_id"), last=True)


def _rows_sql(entries: list[tuple[int, str, str]], source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {p} AS position, '{m}' AS metric, CAST(({v}) AS DOUBLE) AS value FROM {source}" for p, m, v in entries
    )


_OVERVIEW = f"""moment AS (SELECT {LAST_MOMENT_SQL} AS t, {LAST_MOMENT_SQL} // 86400 * 86400 AS midnight),
figures AS (
  SELECT count(*) FILTER (dt BETWEEN {START} AND {END}) AS pageviews,
         count(*) FILTER (dt BETWEEN {START} AND {END} AND searchterms IS NOT NULL) AS searches,
         count(DISTINCT CASE WHEN dt BETWEEN {START} AND {END} THEN ip END) AS ips,
         count(*) FILTER (dt > t - 1800) AS half_hour,
         count(*) FILTER (dt > midnight) AS today,
         count(*) FILTER (dt BETWEEN midnight - 86400 AND midnight - 1) AS yesterday
  FROM pageviews CROSS JOIN moment)"""
_OVERVIEW_ROWS = [
    (1, "Pageviews", "pageviews"),
    (2, "Days in Range", "14"),
    (3, "Average Daily Pageviews", "(pageviews * 2 + 14) // 28"),
    (4, "From Any SERP", "searches"),
    (5, "Unique IPs", "ips"),
    (6, "Last 30 minutes", "half_hour"),
    (7, "Today", "today"),
    (8, "Yesterday", "yesterday"),
]
OVERVIEW_SQL = sql(_rows_sql(_OVERVIEW_ROWS, "figures"), _OVERVIEW)


@check("overview_summary", OVERVIEW_SQL)
def overview_summary(spark, sf_dir):
    return summaries.overview(pv(spark, sf_dir, "dt searchterms ip"), START, END, last_moment(spark, sf_dir))


_OUTSIDE = f"referer IS NOT NULL AND referer NOT LIKE '%{SITE}%'"
_TRAFFIC = f"""figures AS (
  SELECT count(*) AS pageviews,
         count(DISTINCT CASE WHEN {_OUTSIDE} THEN referer END) AS referers,
         count(*) FILTER (resource IS NULL) AS direct,
         count(*) FILTER (searchterms IS NOT NULL AND {_OUTSIDE}) AS serp,
         count(DISTINCT resource) AS pages,
         count(*) FILTER (visit_id > 0 AND browser_type <> 1) AS human
  FROM ranged),
bounce AS (SELECT count(*) AS n FROM (SELECT resource FROM ranged WHERE resource IS NOT NULL AND visit_id > 0
  AND content_type <> '404' GROUP BY resource HAVING count(visit_id) = 1) AS g),
fresh AS (SELECT count(*) AS n FROM (SELECT ip FROM ranged WHERE visit_id > 0 AND ip IS NOT NULL
  GROUP BY ip HAVING count(visit_id) = 1) AS g),
latest AS (SELECT count(*) AS n FROM pageviews WHERE searchterms IS NOT NULL AND {_OUTSIDE} AND dt > {LAST_MOMENT_SQL} - 300),
numbers AS (SELECT figures.*, bounce.n AS bounce, fresh.n AS fresh, latest.n AS latest
  FROM figures CROSS JOIN bounce CROSS JOIN fresh CROSS JOIN latest)"""
_TRAFFIC_ROWS = [
    (1, "Pageviews", "pageviews"),
    (2, "Unique Referrers", "referers"),
    (3, "resource_null", "direct"),
    (4, "From External SERP", "serp"),
    (5, "Unique Landing Pages", "pages"),
    (6, "Bounce Pages", "bounce"),
    (7, "New Visitors Rate", f"least({percent_sql('fresh', 'human')}, 100)"),
    (8, "Currently from search engines", "latest"),
]
TRAFFIC_SQL = sql(_rows_sql(_TRAFFIC_ROWS, "numbers"), _TRAFFIC)
TRAFFIC_COLUMNS = "dt referer searchterms resource visit_id browser_type content_type ip"


@check("traffic_summary", TRAFFIC_SQL)
def traffic_summary(spark, sf_dir):
    return summaries.traffic(pv(spark, sf_dir, TRAFFIC_COLUMNS), START, END, last_moment(spark, sf_dir), SITE)


_VISITORS = """figures AS (
  SELECT count(DISTINCT CASE WHEN browser_type <> 1 THEN visit_id END) AS all_visits,
         count(DISTINCT CASE WHEN visit_id > 0 AND browser_type <> 1 THEN visit_id END) AS visits,
         count(DISTINCT CASE WHEN visit_id > 0 AND browser_type <> 1 THEN ip END) AS ips,
         count(DISTINCT username) AS known,
         count(*) FILTER (browser_type = 1) AS bots
  FROM ranged),
single AS (SELECT count(*) AS single FROM (SELECT visit_id FROM ranged WHERE browser_type <> 1 AND visit_id <> 0
  GROUP BY visit_id HAVING count(id) = 1) AS g),
per AS (SELECT CAST(sum(hits) AS BIGINT) AS hits, count(*) AS n, max(hits) AS longest
  FROM (SELECT count(ip) AS hits FROM ranged WHERE visit_id > 0 GROUP BY visit_id) AS g),
numbers AS (SELECT * FROM figures CROSS JOIN single CROSS JOIN per)"""
_VISITORS_ROWS = [
    (1, "Visits", "visits"),
    (2, "Unique IPs", "ips"),
    (3, "Bounce rate", f"least({percent_sql('single', 'all_visits')}, 100)"),
    (4, "Known visitors", "known"),
    (5, "Single-page Visits", "single"),
    (6, "Bots", "bots"),
    (7, "Pageviews per visit", percent_sql("hits", "n", 1)),
    (8, "Longest visit", "longest"),
]
VISITORS_SQL = sql(_rows_sql(_VISITORS_ROWS, "numbers"), _VISITORS)


@check("visitors_summary", VISITORS_SQL)
def visitors_summary(spark, sf_dir):
    return summaries.visitors(ranged(spark, sf_dir, "visit_id browser_type ip username"))


_DURATION = """per AS (SELECT greatest(max(dt), max(dt_out)) - min(dt) AS s FROM ranged
  WHERE visit_id > 0 AND browser_type <> 1 GROUP BY visit_id),
classes(position, metric, low, high, weight) AS (VALUES
  (1, '0 - 30 seconds', -1, 30, 30), (2, '31 - 60 seconds', 30, 60, 60), (3, '1 - 3 minutes', 60, 180, 180),
  (4, '3 - 5 minutes', 180, 300, 300), (5, '5 - 7 minutes', 300, 420, 420), (6, '7 - 10 minutes', 420, 600, 600),
  (7, 'More than 10 minutes', 600, 99999999999, 900)),
counted AS (SELECT position, metric, weight, count(s) AS n FROM classes LEFT JOIN per ON s > low AND s <= high GROUP BY ALL),
total AS (SELECT count(*) AS t FROM per)"""
DURATION_SQL = sql(
    f"""SELECT position, metric, n AS counthits, {percent_sql('n', 't')} AS pct, CAST(NULL AS BIGINT) AS average_seconds
FROM counted CROSS JOIN total
UNION ALL
SELECT 8, 'Average Visit Duration', NULL, NULL, CAST(sum(n * weight) AS BIGINT) // max(t) FROM counted CROSS JOIN total""",
    _DURATION,
)


@check("visit_duration_buckets", DURATION_SQL)
def visit_duration_buckets(spark, sf_dir):
    return summaries.visit_durations(ranged(spark, sf_dir, "visit_id browser_type dt dt_out"))


def content_tables(spark, sf_dir):
    """Stand-ins: documents as content items of four types, conversation turns as comments."""
    kind = F.element_at(
        F.array(*[F.lit(t) for t in ("post", "page", "attachment", "revision")]), (F.col("doc_id") % 4 + 1).cast("int")
    )
    items = spark.read.parquet(f"{sf_dir}/documents.parquet").select(kind.alias("type"))
    comments = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id")
    return items, comments


_CONTENT = """figures AS (
  SELECT count(*) FILTER (doc_id % 4 <> 3) AS items, count(*) FILTER (doc_id % 4 = 0) AS posts,
         count(*) FILTER (doc_id % 4 = 1) AS pages, count(*) FILTER (doc_id % 4 = 2) AS attachments,
         count(*) FILTER (doc_id % 4 = 3) AS revisions FROM documents),
said AS (SELECT count(*) AS comments FROM conversations),
waiting AS (SELECT CAST(sum(server_latency) AS BIGINT) AS total, count(*) AS n FROM pageviews WHERE server_latency <> 0),
numbers AS (SELECT * FROM figures CROSS JOIN said CROSS JOIN waiting)"""
_CONTENT_ROWS = [
    (1, "Content Items", "items"),
    (2, "Posts", "posts"),
    (3, "Pages", "pages"),
    (4, "Attachments", "attachments"),
    (5, "Revisions", "revisions"),
    (6, "Comments", "comments"),
    (7, "Avg Comments per Post", "(comments * 2 + posts) // (2 * posts)"),
    (8, "Avg Server Latency", "(total * 2 + n) // (2 * n)"),
]
CONTENT_SQL = sql(_rows_sql(_CONTENT_ROWS, "numbers"), _CONTENT)


@check("content_summary", CONTENT_SQL)
def content_summary(spark, sf_dir):
    items, comments = content_tables(spark, sf_dir)
    return summaries.content(items, comments, pv(spark, sf_dir, "server_latency"))


@check(
    "conditional_day_stats",
    sql(
        f"""SELECT count(DISTINCT CASE WHEN dt >= m AND visit_id > 0 THEN visit_id END) AS sessions_today,
  count(DISTINCT CASE WHEN dt BETWEEN m - 86400 AND m - 1 AND visit_id > 0 THEN visit_id END) AS sessions_yesterday,
  count(*) FILTER (dt >= m) AS views_today,
  count(*) FILTER (dt BETWEEN m - 86400 AND m - 1) AS views_yesterday,
  count(*) FILTER (dt >= m AND {_OUTSIDE}) AS referrals_today,
  count(*) FILTER (dt BETWEEN m - 86400 AND m - 1 AND {_OUTSIDE}) AS referrals_yesterday
FROM pageviews CROSS JOIN (SELECT {LAST_MOMENT_SQL} // 86400 * 86400 AS m) AS moment WHERE dt >= m - 86400"""
    ),
)
def conditional_day_stats(spark, sf_dir):
    rows = pv(spark, sf_dir, "dt visit_id referer")
    return summaries.today_against_yesterday(rows, last_moment(spark, sf_dir), SITE)


_LAST_ACTIVITY = "CASE WHEN dt_out > 0 AND dt_out >= dt THEN dt_out ELSE dt END"
_WINDOW = f"""moment AS (SELECT {LAST_MOMENT_SQL} // 60 * 60 AS last, {LAST_MOMENT_SQL} // 60 * 60 - 29 * 60 AS first, {LAST_MOMENT_SQL} AS now)"""


@check(
    "online_count",
    sql(
        f"""SELECT count(*) AS online FROM (SELECT visit_id, max({_LAST_ACTIVITY}) AS ended, any_value(first) AS first
FROM pageviews CROSS JOIN moment WHERE visit_id > 0 AND (dt >= first OR dt_out >= first) GROUP BY visit_id) AS g
WHERE ended // 60 * 60 + 59 >= first""",
        _WINDOW,
    ),
)
def online_count(spark, sf_dir):
    return live.online_count(pv(spark, sf_dir, "visit_id dt dt_out"), last_moment(spark, sf_dir))


ONLINE_IP_SQL = sql(
    f"""SELECT ip, count(*) AS counthits, max(dt) AS dt FROM pageviews
WHERE dt_out > {LAST_MOMENT_SQL} - 300 OR dt > {LAST_MOMENT_SQL} - 300
GROUP BY ip ORDER BY dt DESC, ip ASC LIMIT 200"""
)
ONLINE_USER_SQL = sql(
    f"""SELECT username, count(*) AS counthits, max(dt) AS dt FROM pageviews
WHERE (dt_out > {LAST_MOMENT_SQL} - 300 OR dt > {LAST_MOMENT_SQL} - 300) AND username <> '' AND username IS NOT NULL
GROUP BY username ORDER BY dt DESC, username ASC LIMIT 200"""
)


@check("online_by_ip", ONLINE_IP_SQL)
def online_by_ip(spark, sf_dir):
    return live.online_now(pv(spark, sf_dir, "ip dt dt_out"), "ip", last_moment(spark, sf_dir))


@check("online_users", ONLINE_USER_SQL)
def online_users(spark, sf_dir):
    return live.online_now(pv(spark, sf_dir, "username dt dt_out"), "username", last_moment(spark, sf_dir))


@check(
    "live_counts",
    sql(
        f"""SELECT count(DISTINCT nullif(resource, '')) AS pages_count, count(DISTINCT nullif(country, '')) AS countries_count
FROM pageviews WHERE dt >= {LAST_MOMENT_SQL} - 1800"""
    ),
)
def live_counts(spark, sf_dir):
    return live.live_counts(pv(spark, sf_dir, "dt resource country"), last_moment(spark, sf_dir))


_GRID = "grid AS (SELECT unnest(generate_series(first, last, 60)) AS minute FROM moment)"
_SERIES_TAIL = """SELECT minute, cnt, greatest((SELECT max(cnt) FROM series), 1) AS max_value,
  (SELECT (arg_min(minute, minute) - (SELECT first FROM moment)) // 60 FROM series WHERE cnt = (SELECT max(cnt) FROM series)) AS peak_index
FROM series"""


@check(
    "live_minute_series",
    sql(
        _SERIES_TAIL,
        f"""{_WINDOW}, {_GRID},
series AS (SELECT grid.minute, count(DISTINCT nullif(resource, '')) AS cnt
  FROM grid LEFT JOIN pageviews ON dt // 60 * 60 = grid.minute GROUP BY grid.minute)""",
    ),
)
def live_minute_series(spark, sf_dir):
    return live.values_per_minute(pv(spark, sf_dir, "dt resource"), "resource", last_moment(spark, sf_dir))


LIVE_USERS_SQL = sql(
    _SERIES_TAIL,
    f"""{_WINDOW}, {_GRID},
visits AS (SELECT visit_id, min(dt) // 60 * 60 AS a, max({_LAST_ACTIVITY}) // 60 * 60 AS b
  FROM pageviews CROSS JOIN moment
  WHERE visit_id > 0 AND dt <= last + 59 AND (dt >= first OR dt_out >= first) GROUP BY visit_id),
series AS (SELECT minute, count(DISTINCT visit_id) AS cnt FROM grid LEFT JOIN visits ON a <= minute + 59 AND b >= minute
  GROUP BY minute)""",
)


@check("live_users_minutes", LIVE_USERS_SQL)
def live_users_minutes(spark, sf_dir):
    return live.users_per_minute(pv(spark, sf_dir, "visit_id dt dt_out"), last_moment(spark, sf_dir))


@check("world_map", sql(top_sql({"country": "country"}, "country IS NOT NULL", limit="")))
def world_map(spark, sf_dir):
    return aggregates.world_map(ranged(spark, sf_dir, "country"))


@check(
    "world_map_hits",
    sql(
        """SELECT id, city, CAST(split_part(location, ',', 1) AS DOUBLE) AS lat, CAST(split_part(location, ',', 2) AS DOUBLE) AS lon, dt
FROM ranged WHERE city IS NOT NULL AND location IS NOT NULL AND location <> '' ORDER BY dt DESC, id DESC LIMIT 50"""
    ),
)
def world_map_hits(spark, sf_dir):
    return aggregates.located_hits(ranged(spark, sf_dir, "id city location dt"))


@check(
    "filter_options",
    sql(
        """SELECT value FROM (SELECT lower(value) AS folded, min(value) AS value FROM (
  SELECT unnest(regexp_extract_all(notes, '\\[([^\\]]+)\\]', 1)) AS value FROM ranged WHERE notes <> '') AS tags
  GROUP BY 1) AS g ORDER BY value LIMIT 500"""
    ),
)
def filter_options(spark, sf_dir):
    return aggregates.filter_options(ranged(spark, sf_dir, "notes"), "notes")


def outbound_sql(recent: bool) -> str:
    order = "dt DESC, outbound_resource" if recent else "counthits DESC, dt DESC, outbound_resource"
    return sql(
        f"""SELECT outbound_resource, count(*) AS counthits, max(dt) AS dt FROM (
  SELECT unnest(string_split(outbound_resource, ';;;')) AS outbound_resource, CASE WHEN dt_out > 0 THEN dt_out ELSE dt END AS dt
  FROM ranged WHERE outbound_resource IS NOT NULL AND outbound_resource <> '') AS links
WHERE outbound_resource <> '' GROUP BY outbound_resource ORDER BY {order} LIMIT 200"""
    )


@check("outbound_top", outbound_sql(False))
def outbound_top(spark, sf_dir):
    return aggregates.outbound(ranged(spark, sf_dir, "outbound_resource dt dt_out"))


@check("outbound_recent", outbound_sql(True))
def outbound_recent(spark, sf_dir):
    return aggregates.outbound(ranged(spark, sf_dir, "outbound_resource dt dt_out"), recent=True)


@check(
    "rollup_merge",
    sql(
        """SELECT browser, platform, count(*) AS counthits, min(dt) AS first_dt, max(dt) AS last_dt
FROM pageviews GROUP BY browser, platform"""
    ),
)
def rollup_merge(spark, sf_dir):
    daily = lifecycle.daily_rollup(pv(spark, sf_dir, "dt browser platform ip"), ["browser", "platform"])
    merged = lifecycle.merge_rollups(daily, ["browser", "platform"])
    return merged.select("browser", "platform", "counthits", "first_dt", "last_dt")


@check(
    "rollup_sketch",
    sql("SELECT browser, count(*) AS counthits, count(DISTINCT ip) AS ips, true AS close FROM pageviews GROUP BY browser"),
)
def rollup_sketch(spark, sf_dir):
    """Merged sketches beside the exact numbers: the estimate lies within 5 %."""
    rows = pv(spark, sf_dir, "dt browser ip")
    merged = lifecycle.merge_rollups(lifecycle.daily_rollup(rows, ["browser"]), ["browser"])
    exact = rows.groupBy(F.col("browser").alias("name")).agg(F.count_distinct("ip").alias("ips"))
    both = merged.join(exact, F.col("browser").eqNullSafe(F.col("name")))
    close = F.abs(F.col("ips_estimate") - F.col("ips")) <= 0.05 * F.col("ips")
    return both.select("browser", "counthits", "ips", close.alias("close"))


def _seen(column: str) -> str:
    return f"SELECT DISTINCT dt // 86400 AS day, CAST({column} AS VARCHAR) AS value FROM pageviews WHERE {column} IS NOT NULL"


def _rolling_sql(kind: str, column: str) -> str:
    return f"""SELECT '{kind}' AS kind, make_date(1970, 1, 1) + CAST(d.day AS INTEGER) AS dt_date, count(DISTINCT s.value) AS distinct_values
FROM (SELECT DISTINCT day FROM ({_seen(column)})) AS d JOIN ({_seen(column)}) AS s ON s.day BETWEEN d.day - 6 AND d.day GROUP BY 1, 2"""


@check("rollup_exact", sql(f"{_rolling_sql('address', 'ip')}\nUNION ALL\n{_rolling_sql('visit', 'visit_id')}"))
def rollup_exact(spark, sf_dir):
    """Distinct addresses and visits of each week up to a day, from bitmaps per day; numbers are given in two batches."""
    rows = pv(spark, sf_dir, "dt ip visit_id")
    kinds = F.explode(F.create_map(F.lit("address"), "ip", F.lit("visit"), F.col("visit_id").cast("string"))).alias("kind", "value")
    rows = rows.select("dt", day_of("dt").alias("dt_date"), kinds)
    first = distinct.number_values(rows.where(F.col("dt") < MIDDAY))
    dictionary = first.unionByName(distinct.number_values(rows, first))
    sets = distinct.daily_sets(rows, dictionary, ["kind"])
    return distinct.rolling_distinct(sets, 7, ["kind"]).withColumnRenamed("distinct", "distinct_values")


@check(
    "visitor_flow",
    sql(
        f"""SELECT country, count(*) FILTER (WHERE b AND NOT a) AS new, count(*) FILTER (WHERE a AND b) AS returning,
  count(*) FILTER (WHERE a AND NOT b) AS lost, CAST(0 AS DOUBLE) AS error
FROM (SELECT country, ip, bool_or(dt BETWEEN {FIRST} AND {FIRST + 7 * 86400 - 1}) AS a, bool_or(dt BETWEEN {START} AND {END}) AS b
  FROM pageviews WHERE dt BETWEEN {FIRST} AND {END} AND ip IS NOT NULL GROUP BY country, ip) AS g GROUP BY country"""
    ),
)
def visitor_flow(spark, sf_dir):
    """New, returning and lost addresses of the report range against the week before, from a sketch per day."""
    rows = pv(spark, sf_dir, "dt country ip").select(day_of("dt").alias("dt_date"), "country", F.col("ip").alias("value"))
    return distinct.visitor_flow(distinct.daily_sketches(rows, ["country"]), ("2024-01-01", "2024-01-07"), ("2024-01-08", "2024-01-21"), ["country"])
