"""Every report of the catalogue, and the public query functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import aggregates as agg
from checks.base import END, ORACLE, START, check, last_moment, percent_sql, sql
from checks.series import chart_sql
from footfall.functions.urls import strip_query
from footfall.plans.api import ask
from footfall.plans.reports import EXPRESSIONS, REPORTS, Report, Request, run_report
from footfall.schema import PAGEVIEW_COLUMNS
from footfall.sources import testdata

_KEY_SQL = {
    "domain": agg.DOMAIN_SQL,
    "language_family": "substring(language, 1, 2)",
    "os_family": "concat('p-', substring(platform, 1, 3))",
    "path": "rtrim(resource, '/')",
}
_MEASURE_SQL = {False: "{}({})", True: "{}(DISTINCT {})"}


# Which rows a report takes, written once more out of the catalogue's description.
_SEARCHED = "searchterms IS NOT NULL AND searchterms NOT IN ('', '_')"
_WITHIN_SITE = "position('search' IN content_type) > 0 AND searchterms IS NOT NULL AND length(searchterms) > 0"
_ROWS = {
    "slim_p1_06": _SEARCHED,
    "slim_p1_10": "referer IS NOT NULL AND position('example.com' IN referer) = 0",
    "slim_p1_12": _SEARCHED,
    "slim_p1_19_01": _SEARCHED,
    "slim_p2_01": "NOT (visit_id <= 0 OR browser_type = 1)",
    "slim_p2_07": "screen_width * screen_height <> 0",
    "slim_p2_20": "position('user:' IN notes) > 0",
    "slim_p2_21": "position('user:' IN notes) > 0",
    "slim_p2_24": "browser_type IN (1)",
    "slim_p2_25": "browser_type IN (0, 2, 3)",
    "slim_p3_01": "referer IS NOT NULL AND position('example.com' IN referer) = 0",
    "slim_p4_02": "content_type IN ('post')",
    "slim_p4_04": "regexp_matches(resource, '/feed|[?&]feed=>') OR position('feed' IN content_type) > 0",
    "slim_p4_05": "starts_with(resource, '[404]') OR position('404' IN content_type) > 0",
    "slim_p4_06": _WITHIN_SITE,
    "slim_p4_07": "position('category' IN content_type) > 0",
    "slim_p4_09": "content_type IN ('download')",
    "slim_p4_11": "content_type IN ('post')",
    "slim_p4_13": _WITHIN_SITE,
    "slim_p4_15": "content_type IN ('category')",
    "slim_p4_152": "content_type IN ('tag')",
    "slim_p4_16": "position('404' IN content_type) > 0",
    "slim_p4_19": "position('tag' IN content_type) > 0",
    "slim_p4_20": "content_type IN ('download')",
    "slim_p4_23": "content_type NOT IN ('404')",
}
_GROUPS = {"slim_p4_23": "count(CASE WHEN visit_id IS NOT NULL THEN 1 END) = 1"}

# Reports of content that the mapping lacks see some rows as feeds, searches, tags and pages seen once.
RARE = {
    "content_type": "CASE id % 11 WHEN 0 THEN 'feed' WHEN 1 THEN 'search:blog' WHEN 2 THEN 'tag' ELSE content_type END",
    "resource": "CASE WHEN id % 97 = 0 THEN resource || '/only-' || id || '/' ELSE resource END",
    "category": "CASE WHEN id % 11 = 2 THEN concat('', id % 9) ELSE category END",
}
_RARE = ("slim_p4_04", "slim_p4_06", "slim_p4_13", "slim_p4_152", "slim_p4_19", "slim_p4_23")


def _measure(spec: tuple) -> str:
    return _MEASURE_SQL[len(spec) > 2].format(spec[0].lower(), spec[1])


def report_sql(name: str, report: Report) -> str:
    """Checking SQL of a report: columns out of its parameters, conditions written apart."""
    where, having = _ROWS.get(name, ""), _GROUPS.get(name, "")
    if bool(where) != bool(report.where) or bool(having) != bool(report.having):
        raise ValueError(f"{name} needs its condition written in the checks")
    text = _plain_sql(report, where, having)
    if name in _RARE:
        changed = ", ".join(f"{e} AS {c}" for c, e in RARE.items())
        text = text.replace("ranged AS (SELECT * FROM pageviews", f"ranged AS (SELECT * REPLACE ({changed}) FROM pageviews")
    return text


def _plain_sql(report: Report, where: str, having: str) -> str:
    if report.operator == "top":
        if report.expression:
            keys = {report.columns: _KEY_SQL[report.expression]}
        else:
            keys = {c.strip(): c.strip() for c in report.columns.split(",")}
        return sql(agg.top_sql(keys, where, having, report.recent))
    if report.operator == "chart":
        return chart_sql("week", _measure(report.data1), _measure(report.data2), where=where or "true")
    if report.operator == "recent_rows":
        if report.columns == "*":
            columns = ", ".join(c for c in PAGEVIEW_COLUMNS if c not in ("other_ip", "email", "location", "searchterms"))
        else:
            more = f", {report.more_columns}" if report.more_columns else ""
            columns = f"{report.columns}{more}, dt, ip"
        tested = f"WHERE {where}" if where else ""
        return sql(f"SELECT {columns} FROM ranged {tested} ORDER BY dt DESC, id DESC LIMIT 200")
    if report.operator in ("entry_pages", "exit_pages"):
        return agg.edge_sql(report.operator == "exit_pages")
    if report.operator == "outbound":
        return agg.outbound_sql(report.recent)
    if report.operator == "top_events":
        return sql(
            f"""SELECT notes, count(*) AS counthits FROM site_events WHERE notes NOT LIKE '_ype:click%'
  AND dt BETWEEN {START} AND {END} GROUP BY notes ORDER BY counthits DESC, notes LIMIT 200"""
        )
    if report.operator == "recent_events":
        return sql(
            """SELECT s.id, s.event_id, s.type, s.event_description, s.notes, s.position, s.dt, p.ip, p.resource
FROM site_events s JOIN ranged p ON p.id = s.id WHERE s.notes NOT LIKE '_ype:click%'
ORDER BY s.dt DESC, s.event_id DESC LIMIT 200"""
        )
    named = {
        "overview": agg.OVERVIEW_SQL,
        "traffic": agg.TRAFFIC_SQL,
        "visitors": agg.VISITORS_SQL,
        "visit_durations": agg.DURATION_SQL,
        "content": agg.CONTENT_SQL,
        "live": agg.LIVE_USERS_SQL,
        "companions": ORACLE["group_concat"],
        "world_map": ORACLE["world_map"],
    }
    if report.operator == "online":
        return agg.ONLINE_IP_SQL if report.columns == "ip" else agg.ONLINE_USER_SQL
    return named[report.operator]


# Columns an operator reads besides those its parameters name.
_READS = {
    "overview": "dt searchterms ip",
    "traffic": agg.TRAFFIC_COLUMNS,
    "visitors": "visit_id browser_type ip username",
    "visit_durations": "visit_id browser_type dt_out",
    "content": "server_latency",
    "online": "dt_out",
    "outbound": "dt_out",
    "exit_pages": "id resource",
    "entry_pages": "id resource",
    "live": "visit_id dt_out",
    "world_map": "country",
    "recent_rows": "id ip",
    "recent_events": "id ip resource",
}
_EVERYWHERE = {"overview", "traffic", "online", "live", "chart", "content"}


def columns_of(report: Report) -> str:
    """The table columns a report needs."""
    if report.columns == "*":
        return " ".join(PAGEVIEW_COLUMNS)
    text = " ".join([report.columns, report.where, report.having, report.more_columns, _READS.get(report.operator, "")])
    text += " ".join(str(d[1]) for d in (report.data1, report.data2) if d)
    needed = {"dt"} | {c for c in PAGEVIEW_COLUMNS if c in text.replace(",", " ").replace("(", " ").replace(")", " ").split()}
    needed |= {"resource"} if report.expression in ("path", "resource") else set()
    return " ".join(c for c in PAGEVIEW_COLUMNS if c in needed)


def run(spark, sf_dir, report: Report, rare: bool = False, filters: str = ""):
    """A report over the test data; a dated report's range also reaches the scan."""
    live = report.operator in ("overview", "traffic", "online", "live")
    as_of = last_moment(spark, sf_dir) if live else END
    request = Request(START, END, as_of, filters=filters, step="week")
    scan = () if report.operator in _EVERYWHERE else (START, END)
    columns = columns_of(report)
    pageviews = testdata.pageviews(spark, sf_dir, f"{columns} id" if rare and "id" not in columns.split() else columns, *scan)
    if rare:
        pageviews = pageviews.withColumns({c: F.expr(e) for c, e in RARE.items() if c in columns.split()})
    events = testdata.site_events(spark, sf_dir) if "events" in report.operator else None
    if report.operator == "content":
        request.tables = dict(zip(("items", "comments"), agg.content_tables(spark, sf_dir)))
    return run_report(report, pageviews, request, events)


def _register(name: str, report: Report) -> None:
    @check(f"report_{name}", report_sql(name, report))
    def query(spark, sf_dir):
        return run(spark, sf_dir, report, name in _RARE)


for _name, _report in REPORTS.items():
    _register(_name, _report)


_OWN_RANGE = f"browser = 'Chrome' AND dt BETWEEN {END - 7 * 86400 + 1} AND {END}"


@check(
    "ext_reports",
    sql(
        f"""SELECT upper(author) AS author, count(*) AS counthits,
  {percent_sql("count(*)", f"(SELECT count(*) FROM pageviews WHERE {_OWN_RANGE})")} AS pct
FROM pageviews WHERE {_OWN_RANGE} AND content_type = 'post' GROUP BY 1 HAVING count(*) > 5
ORDER BY counthits ASC, 1 DESC LIMIT 3"""
    ),
)
def ext_reports(spark, sf_dir):
    """A report of the user's own, given as parameters, with an order, a filter text and date words."""
    EXPRESSIONS.setdefault("upper_author", lambda: F.upper("author"))
    own = Report("My authors", "top", "author", "content_type = 'post'", "count(*) > 5", expression="upper_author", order="counthits ASC, author DESC")
    request = Request(START, END, END, filters="browser equals Chrome&&&interval equals -7&&&limit_results equals 3")
    return run_report(own, testdata.pageviews(spark, sf_dir, "author content_type browser dt"), request)


@check(
    "ext_api_functions",
    sql(
        """SELECT 'count' AS fn, CAST(count(DISTINCT ip) AS VARCHAR) AS answer, CAST(NULL AS BIGINT) AS counthits
FROM week WHERE browser = 'Firefox'
UNION ALL SELECT 'count-all', CAST(count(DISTINCT ip) AS VARCHAR), NULL FROM pageviews WHERE browser = 'Firefox'
UNION ALL SELECT 'recent', answer, NULL FROM (SELECT country AS answer FROM week WHERE browser = 'Firefox' ORDER BY dt DESC, id DESC LIMIT 200)
UNION ALL SELECT 'top', answer, counthits FROM (SELECT country AS answer, count(*) AS counthits FROM week WHERE browser = 'Firefox'
  GROUP BY country ORDER BY counthits DESC, country ASC NULLS FIRST LIMIT 200)
UNION ALL SELECT 'top-all', answer, counthits FROM (SELECT split_part(resource, '?', 1) AS answer, count(*) AS counthits
  FROM pageviews WHERE browser = 'Firefox' GROUP BY 1 ORDER BY counthits DESC, answer ASC NULLS FIRST LIMIT 200)""",
        f"week AS (SELECT * FROM pageviews WHERE dt BETWEEN {END - 7 * 86400 + 1} AND {END})",
    ),
)
def ext_api_functions(spark, sf_dir):
    rows = testdata.pageviews(spark, sf_dir, "id ip country resource browser dt")
    spec = "browser equals Firefox&&&interval equals -7"

    def answers(function, dimension, table=rows):
        out = ask(table, function, dimension, START, END, spec)
        if function.startswith("count"):
            return out.select(F.lit(function).alias("fn"), F.col("counthits").cast("string").alias("answer"),
                              F.lit(None).cast("bigint").alias("counthits"))
        hits = F.col("counthits") if "counthits" in out.columns else F.lit(None).cast("bigint")
        return out.select(F.lit(function).alias("fn"), F.col(dimension).alias("answer"), hits.alias("counthits"))

    bare = rows.withColumn("resource", strip_query("resource"))
    out = answers("count", "ip")
    for more in (answers("count-all", "ip"), answers("recent", "country"), answers("top", "country"),
                 answers("top-all", "resource", bare)):
        out = out.unionByName(more)
    return out
