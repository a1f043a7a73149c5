"""The report catalogue: every report is an operator with parameters."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.functions.text import language_family, os_family
from footfall.functions.urls import referrer_domain, trim_slash
from footfall.operators import aggregates, live, ranking, series, summaries
from footfall.operators.filters import all_of, in_time_range, read_filters
from footfall.operators.joins import events_with_pageview, top_events
from footfall.plans.ranges import range_of

SITE = "example.com"


@dataclass(frozen=True)
class Report:
    """Parameters of one report; `where` is a condition in SQL text."""

    title: str
    operator: str
    columns: str = ""
    where: str = ""
    having: str = ""
    more_columns: str = ""
    expression: str = ""
    data1: tuple = ()
    data2: tuple = ()
    recent: bool = False
    use_dates: bool = True
    order: str = ""


# Computed keys by name.
EXPRESSIONS = {
    "domain": lambda: referrer_domain("referer"),
    "language_family": lambda: language_family("language"),
    "os_family": lambda: os_family("platform"),
    "path": lambda: trim_slash("resource"),
}

_SEARCHED = "searchterms <> '_' AND searchterms <> '' AND searchterms IS NOT NULL"
_INTERNAL_SEARCH = "content_type LIKE '%search%' AND searchterms <> '' AND searchterms IS NOT NULL"
_HUMAN_VISIT = "visit_id > 0 AND browser_type <> 1"
_OUTSIDE = f"referer IS NOT NULL AND referer NOT LIKE '%{SITE}%'"

# Report names, titles and parameters.
REPORTS = {
    "slim_p7_02": Report("Access Log", "recent_rows", "*"),
    "slim_p1_01": Report("Pageviews", "chart", data1=("COUNT", "ip"), data2=("COUNT", "ip", True)),
    "slim_p1_03": Report("At a Glance", "overview"),
    "slim_p1_04": Report("Currently Online", "online", "ip", use_dates=False),
    "slim_p1_06": Report("Recent Search Terms", "recent_rows", "searchterms", _SEARCHED, more_columns="referer, resource"),
    "slim_p1_08": Report("Top Web Pages", "top", "resource"),
    "slim_p1_10": Report("Top Referring Domains", "top", "referer", f"referer NOT LIKE '%{SITE}%'", expression="domain"),
    "slim_p1_11": Report("Top Known Visitors", "top", "username"),
    "slim_p1_12": Report("Top Search Terms", "top", "searchterms", _SEARCHED),
    "slim_p1_13": Report("Top Countries", "top", "country"),
    "slim_p1_17": Report("Top Language Families", "top", "language", expression="language_family"),
    "slim_p1_18": Report("Users Currently Online", "online", "username", use_dates=False),
    "slim_p1_19_01": Report("Search Terms", "chart", where=_SEARCHED, data1=("COUNT", "searchterms"), data2=("COUNT", "searchterms", True)),
    "slim_p2_01": Report("Human Visits", "chart", where=_HUMAN_VISIT, data1=("COUNT", "visit_id", True), data2=("COUNT", "ip", True)),
    "slim_p2_02": Report("Audience Overview", "visitors"),
    "slim_p2_03": Report("Top Languages", "top", "language"),
    "slim_p2_04": Report("Top User Agents", "top", "browser, browser_version"),
    "slim_p2_05": Report("Top Service Providers", "top", "ip"),
    "slim_p2_06": Report("Top Operating Systems", "top", "platform"),
    "slim_p2_07": Report("Top Screen Resolutions", "top", "screen_width, screen_height", "screen_width <> 0 AND screen_height <> 0"),
    "slim_p2_08": Report("Top Viewport Sizes", "top", "resolution"),
    "slim_p2_12": Report("Visit Duration", "visit_durations"),
    "slim_p2_13": Report("Recent Countries", "top", "country", recent=True),
    "slim_p2_14": Report("Recent Viewport Sizes", "top", "resolution", recent=True),
    "slim_p2_15": Report("Recent Operating Systems", "top", "platform", recent=True),
    "slim_p2_16": Report("Recent Browsers", "top", "browser, browser_version", recent=True),
    "slim_p2_17": Report("Recent Languages", "top", "language", recent=True),
    "slim_p2_18": Report("Top Browser Families", "top", "browser"),
    "slim_p2_19": Report("Top OS Families", "top", "platform", expression="os_family"),
    "slim_p2_20": Report("Recent Users", "top", "username", "notes LIKE '%user:%'", recent=True),
    "slim_p2_21": Report("Top Users", "top", "username", "notes LIKE '%user:%'"),
    "slim_p2_22_01": Report("Users", "chart", data1=("COUNT", "username"), data2=("COUNT", "username", True)),
    "slim_p2_23": Report("Top Cities", "top", "city"),
    "slim_p2_24": Report("Top Bots", "top", "browser, browser_version", "browser_type = 1"),
    "slim_p2_25": Report("Top Human Browsers", "top", "browser, browser_version", "browser_type <> 1"),
    "slim_p3_01": Report("Traffic Sources", "chart", where=_OUTSIDE, data1=("COUNT", "referer", True), data2=("COUNT", "ip", True)),
    "slim_p3_02": Report("Traffic Summary", "traffic"),
    "slim_p4_01": Report("Recent Outbound Links", "outbound", "outbound_resource", recent=True),
    "slim_p4_02": Report("Recent Posts", "top", "resource", "content_type = 'post'", expression="path", recent=True),
    "slim_p4_04": Report("Recent Feeds", "recent_rows", "resource", "resource LIKE '%/feed%' OR resource LIKE '%?feed=>%' OR resource LIKE '%&feed=>%' OR content_type LIKE '%feed%'"),
    "slim_p4_05": Report("Recent Pages Not Found", "top", "resource", "resource LIKE '[404]%' OR content_type LIKE '%404%'", recent=True),
    "slim_p4_06": Report("Recent Internal Searches", "recent_rows", "searchterms", _INTERNAL_SEARCH),
    "slim_p4_07": Report("Top Categories", "top", "category", "content_type LIKE '%category%'"),
    "slim_p4_09": Report("Top Downloads", "top", "resource", "content_type = 'download'"),
    "slim_p4_10": Report("Recent Custom Events", "recent_events", "notes"),
    "slim_p4_11": Report("Top Posts", "top", "resource", "content_type = 'post'", expression="path"),
    "slim_p4_12": Report("Top Custom Events", "top_events", "notes"),
    "slim_p4_13": Report("Top Internal Searches", "top", "searchterms", _INTERNAL_SEARCH),
    "slim_p4_15": Report("Recent Categories", "top", "resource", "content_type = 'category'", expression="path", recent=True),
    "slim_p4_152": Report("Recent Tags", "top", "resource", "content_type = 'tag'", expression="path", recent=True),
    "slim_p4_16": Report("Top Pages Not Found", "top", "resource", "content_type LIKE '%404%'"),
    "slim_p4_18": Report("Top Authors", "top", "author"),
    "slim_p4_19": Report("Top Tags", "top", "category", "content_type LIKE '%tag%'"),
    "slim_p4_20": Report("Recent Downloads", "top", "resource", "content_type = 'download'", recent=True),
    "slim_p4_21": Report("Top Outbound Links", "outbound", "outbound_resource"),
    "slim_p4_22": Report("Your Website", "content"),
    "slim_p4_23": Report("Top Bounce Pages", "top", "resource", "content_type <> '404'", "COUNT(visit_id) = 1", expression="path"),
    "slim_p4_24": Report("Top Exit Pages", "exit_pages", "visit_id"),
    "slim_p4_25": Report("Top Entry Pages", "entry_pages", "visit_id"),
    "slim_p4_26_01": Report("Pages with Outbound Links", "chart", data1=("COUNT", "outbound_resource"), data2=("COUNT", "outbound_resource", True)),
    "slim_p4_27": Report("Users by Page", "companions", "username", expression="resource"),
    "slim_p6_01": Report("Audience Location", "world_map"),
    "slim_live_analytics": Report("Live Analytics", "live", use_dates=False),
}


@dataclass
class Request:
    """What a report is asked for."""

    start: int
    end: int
    as_of: int
    filters: str = ""
    site: str = SITE
    step: str | None = None
    first_weekday: int = 1
    metric: str = "users"
    limit: int | None = None
    offset: int = 0
    tables: dict[str, DataFrame] = field(default_factory=dict)


def run_report(name: str | Report, pageviews: DataFrame, request: Request, events: DataFrame | None = None) -> DataFrame:
    """The rows of a report, built in or given as parameters."""
    report = REPORTS[name] if isinstance(name, str) else name
    asked = read_filters(request.filters)
    if asked.dates:  # date words of the filter text take the place of the range
        start, end = range_of(asked.dates, request.as_of)
        request = replace(request, start=start, end=end)
    table = pageviews.where(all_of(asked.predicates()))
    rows = in_time_range(table, request.start, request.end) if report.use_dates else table
    limit = request.limit or asked.limit
    offset = request.offset or asked.offset
    where = F.expr(f"({report.where})") if report.where else None
    return _BUILDERS[report.operator](report, table, rows, where, limit, offset, request, events)


def _keys(report: Report) -> dict[str, Column]:
    if report.expression:
        return {report.columns: EXPRESSIONS[report.expression]()}
    return {c.strip(): F.col(c.strip()) for c in report.columns.split(",")}


def _top(report, table, rows, where, limit, offset, request, events):
    having = F.expr(report.having) if report.having else None
    keys = _keys(report)
    if not report.order:
        return aggregates.top(rows, keys, where, having, recent=report.recent, limit=limit, offset=offset)
    groups = aggregates.top(rows, keys, where, having, recent=report.recent, limit=None)
    return groups.orderBy(*ranking.with_tiebreak(report.order, list(keys))).offset(offset).limit(limit)


def _recent(report, table, rows, where, limit, offset, request, events):
    return ranking.recent_rows(rows, report.columns, where, report.more_columns, limit=limit, offset=offset)


def _chart(report, table, rows, where, limit, offset, request, events):
    step = request.step or series.default_step(request.start, request.end)
    v1, v2 = series.measure(*report.data1), series.measure(*report.data2)
    return series.chart(table, request.start, request.end, step, v1, v2, where, request.first_weekday)


def _live(report, table, rows, where, limit, offset, request, events):
    if request.metric == "users":
        return live.users_per_minute(table, request.as_of)
    return live.values_per_minute(table, {"pages": "resource"}.get(request.metric, "country"), request.as_of)


def _top_events(report, table, rows, where, limit, offset, request, events):
    if request.filters:
        return top_events(events, rows, limit)
    return top_events(in_time_range(events, request.start, request.end), None, limit)


_BUILDERS = {
    "top": _top,
    "recent_rows": _recent,
    "chart": _chart,
    "live": _live,
    "top_events": _top_events,
    "overview": lambda r, t, rows, w, n, o, q, e: summaries.overview(t, q.start, q.end, q.as_of),
    "traffic": lambda r, t, rows, w, n, o, q, e: summaries.traffic(t, q.start, q.end, q.as_of, q.site),
    "visitors": lambda r, t, rows, w, n, o, q, e: summaries.visitors(rows),
    "visit_durations": lambda r, t, rows, w, n, o, q, e: summaries.visit_durations(rows),
    "content": lambda r, t, rows, w, n, o, q, e: summaries.content(q.tables["items"], q.tables["comments"], t),
    "online": lambda r, t, rows, w, n, o, q, e: live.online_now(t, r.columns, q.as_of, n),
    "outbound": lambda r, t, rows, w, n, o, q, e: aggregates.outbound(rows, r.recent, n),
    "recent_events": lambda r, t, rows, w, n, o, q, e: events_with_pageview(e, rows, n),
    "exit_pages": lambda r, t, rows, w, n, o, q, e: aggregates.edge_pages(rows, True, n),
    "entry_pages": lambda r, t, rows, w, n, o, q, e: aggregates.edge_pages(rows, False, n),
    "companions": lambda r, t, rows, w, n, o, q, e: aggregates.companions(rows, r.expression, r.columns, n),
    "world_map": lambda r, t, rows, w, n, o, q, e: aggregates.world_map(rows),
}
