"""Joins, lookups, visits, repeats, rate limit."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import FIRST, check, events, pv, ranged, sql
from footfall.functions.urls import search_words_by_engine
from footfall.functions.addresses import number_key
from footfall.operators import joins, patterns, ranking, visits
from footfall.sources import testdata


@check(
    "join_builder",
    sql(
        """SELECT s.event_id, s.notes, p.browser, p.country FROM site_events s LEFT JOIN pageviews p
ON s.id = p.id AND p.browser_type <> 1 AND s.dt = p.dt"""
    ),
)
def join_builder(spark, sf_dir):
    left, right = events(spark, sf_dir, "event_id id notes dt"), pv(spark, sf_dir, "id browser country browser_type dt")
    also = [right["browser_type"] != 1, left["dt"] == right["dt"]]
    return joins.join_on(left, right, ("id", "id"), also=also, how="left").select("event_id", "notes", "browser", "country")


@check(
    "events_with_pageview",
    sql(
        """SELECT s.id, s.event_id, s.type, s.event_description, s.notes, s.position, s.dt, p.ip, p.resource
FROM site_events s JOIN ranged p ON p.id = s.id WHERE s.notes NOT LIKE '_ype:click%'"""
    ),
)
def events_with_pageview(spark, sf_dir):
    return joins.events_with_pageview(events(spark, sf_dir), ranged(spark, sf_dir, "id ip resource"))


@check(
    "top_events",
    sql(
        """SELECT s.notes, count(*) AS counthits FROM site_events s JOIN ranged p ON p.id = s.id
WHERE s.notes NOT LIKE '_ype:click%' AND p.browser = 'Chrome' GROUP BY s.notes ORDER BY counthits DESC, s.notes LIMIT 200"""
    ),
)
def top_events(spark, sf_dir):
    rows = ranged(spark, sf_dir, "id browser").where("browser = 'Chrome'")
    return joins.top_events(events(spark, sf_dir, "id notes dt"), rows)


@check(
    "subject_events",
    sql(
        """SELECT event_id, id, notes, dt FROM site_events WHERE id IN (SELECT id FROM pageviews WHERE email = 'user3@example.com')
ORDER BY dt DESC, event_id DESC LIMIT 500"""
    ),
)
def subject_events(spark, sf_dir):
    rows = joins.subject_events(events(spark, sf_dir, "event_id id notes dt"), pv(spark, sf_dir, "id email"), "user3@example.com")
    return ranking.page(rows, ranking.sort_keys("dt, event_id"), 500).select("event_id", "id", "notes", "dt")


# Sixty times denser than the data, so that visits hold several hits.
DENSE = f"({FIRST} + (dt - {FIRST}) // 60)"


def dense(df):
    return df.withColumn("dt", F.call_function("div", F.col("dt") - FIRST, F.lit(60)) + FIRST)


def hits(spark, sf_dir):
    """Hits of visitors (user_id) on the denser clock."""
    rows = testdata.base_events(spark, sf_dir).select((F.col("event_id") + 1).alias("id"), "user_id", "dt")
    return dense(rows)


_HITS = f"""hits AS (SELECT event_id + 1 AS id, user_id, {DENSE} AS dt FROM e)"""


# Some hits come without a fingerprint, some without a browser.
_LACKING = {
    "fingerprint": "CASE WHEN id % 5 = 0 THEN NULL ELSE fingerprint END",
    "browser": "CASE WHEN id % 7 = 0 THEN NULL ELSE browser END",
}
_LACKING_SQL = "SELECT * REPLACE ({}) FROM pageviews".format(", ".join(f"{e} AS {c}" for c, e in _LACKING.items()))


@check(
    "dedupe_lookback",
    sql(
        "SELECT id FROM walk WHERE kept",
        f"""sparse AS ({_LACKING_SQL}),
firsts AS (SELECT author, content_type, fingerprint, {DENSE} AS dt, min(id) AS id FROM sparse GROUP BY 1, 2, 3, 4),
ordered AS (SELECT *, row_number() OVER (PARTITION BY author, content_type ORDER BY dt, id) AS n FROM firsts),
walk AS (
  SELECT author, content_type, n, id, true AS kept, dt AS newest,
    CASE WHEN fingerprint IS NULL THEN MAP {{}} ELSE MAP {{fingerprint: dt}} END AS last FROM ordered WHERE n = 1
  UNION ALL
  SELECT author, content_type, n, id, fresh, CASE WHEN fresh THEN dt ELSE newest END,
    CASE WHEN fresh AND fingerprint IS NOT NULL THEN map_concat(last, MAP {{fingerprint: dt}}) ELSE last END
  FROM (SELECT o.*, w.newest, w.last,
      coalesce(o.dt - CASE WHEN o.fingerprint IS NULL THEN w.newest ELSE w.last[o.fingerprint] END > 1800, true) AS fresh
    FROM walk w JOIN ordered o ON o.n = w.n + 1 AND o.content_type = w.content_type AND o.author IS NOT DISTINCT FROM w.author) AS step)""",
        recursive=True,
    ),
)
def dedupe_lookback(spark, sf_dir):
    """The keys are coarser than a visit and its page, so that repeats occur in the data; the fingerprint may be unknown."""
    rows = dense(pv(spark, sf_dir, "id author fingerprint content_type dt"))
    rows = rows.withColumn("fingerprint", F.expr(_LACKING["fingerprint"]))
    return visits.drop_repeats(rows, ["author", "content_type"], optional="fingerprint").select("id")


@check(
    "asof_visit_lookup",
    sql(
        """SELECT a.id, (SELECT b.visit_id FROM sparse b WHERE b.ip = a.ip AND (a.fingerprint IS NULL OR b.fingerprint = a.fingerprint)
   AND (a.browser IS NULL OR b.browser = a.browser) AND b.dt BETWEEN a.dt - 1800 AND a.dt AND b.browser_type <> 1
   ORDER BY b.dt DESC, b.id DESC LIMIT 1) AS visit_found
FROM sparse a""",
        f"sparse AS ({_LACKING_SQL})",
    ),
)
def asof_visit_lookup(spark, sf_dir):
    rows = pv(spark, sf_dir, "id ip fingerprint browser visit_id browser_type dt")
    rows = rows.withColumns({c: F.expr(e) for c, e in _LACKING.items()})
    keys = ["ip", "fingerprint", "browser"]
    found = joins.latest_visit(rows, rows.where("browser_type <> 1"), keys, optional=("fingerprint", "browser"))
    named = found.select(*[F.col(c).alias(f"of_{c}") for c in (*keys, "dt")], "visit_found")
    same = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in (*keys, "dt")]
    return rows.join(named, same, "left").select("id", "visit_found")


@check(
    "new_visitor_anti",
    sql(
        """SELECT id, (row_number() OVER (PARTITION BY fingerprint ORDER BY dt, id) = 1) AS is_new FROM pageviews"""
    ),
)
def new_visitor_anti(spark, sf_dir):
    return joins.flag_new_visitors(pv(spark, sf_dir, "id fingerprint dt")).select("id", "is_new")


def spam_list(spark, sf_dir):
    rows = testdata.base_events(spark, sf_dir).alias("e").where("e.user_id % 50 = 7")
    return rows.select(
        F.expr(testdata.PAGEVIEW_SQL["ip"]).alias("ip"), F.expr("concat('user', e.user_id)").alias("username")
    ).distinct()


SPAM_SQL = f"spam AS (SELECT DISTINCT {testdata.PAGEVIEW_SQL['ip']} AS ip, concat('user', e.user_id) AS username FROM e WHERE e.user_id % 50 = 7)"


@check("spam_comment_lookup", sql("SELECT id, ip IN (SELECT ip FROM spam) AS spam FROM pageviews", SPAM_SQL))
def spam_comment_lookup(spark, sf_dir):
    return joins.mark_spam(pv(spark, sf_dir, "id ip"), spam_list(spark, sf_dir)).select("id", "spam")


_ARTICLE_PATH = "regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1)"


@check(
    "post_prefix_join",
    sql(
        """SELECT a.article_id, a.path, CAST(coalesce(sum(h.n), 0) AS BIGINT) AS counthits
FROM articles a LEFT JOIN (SELECT resource, count(DISTINCT ip) AS n FROM ranged WHERE resource IS NOT NULL GROUP BY resource) h
  ON starts_with(h.resource, a.path) GROUP BY a.article_id, a.path""",
        f"articles AS (SELECT page_id AS article_id, {_ARTICLE_PATH} AS path FROM pages)",
    ),
)
def post_prefix_join(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    articles = pages.selectExpr("page_id AS article_id", f"{_ARTICLE_PATH} AS path")
    return joins.hits_per_article(ranged(spark, sf_dir, "resource ip"), articles, "ip")


# low, high, country, city, subdivision, latitude, longitude: ranges over 10.0.0.0/8
GEO = [
    ("10.0.0.0", "10.0.255.255", "IT", "Rome", "Lazio", "41.9", "12.5"),
    ("10.1.0.0", "10.1.99.255", "FR", "Paris", "", "48.9", "2.4"),
    ("10.1.100.0", "10.2.127.255", "DE", "Berlin", "BE", "52.5", "13.4"),
    ("10.3.0.0", "10.5.255.255", "GB", "London", "England", "51.5", "-0.1"),
    ("10.6.0.0", "10.6.255.255", "XX", "", "", "", ""),
]


def _number(address: str) -> int:
    a, b, c, d = (int(x) for x in address.split("."))
    return ((a * 256 + b) * 256 + c) * 256 + d


GEO_VALUES = ", ".join(
    f"({_number(low)}, {_number(high)}, '{cc}', '{city}', '{sub}', '{lat}', '{lon}')" for low, high, cc, city, sub, lat, lon in GEO
)


def geo_ranges(spark):
    names = "low, high, country_code, city, subdivision, latitude, longitude"
    return spark.sql(f"SELECT * FROM VALUES {GEO_VALUES} AS geo({names})").withColumns(
        {c: F.col(c).cast("bigint") for c in ("low", "high")}
    )


IP_NUMBER = (
    "(CAST(split_part(ip, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(ip, '.', 2) AS BIGINT) * 65536 "
    "+ CAST(split_part(ip, '.', 3) AS BIGINT) * 256 + CAST(split_part(ip, '.', 4) AS BIGINT))"
)


# Every seventh hit comes from an IPv6 address; two networks are known.
_EITHER = "CASE WHEN id % 7 = 0 THEN concat('2001:db8:', id % 5, '::', id % 97) ELSE ip END"
_GEO6 = [("20010db80001", "NL", "Delft"), ("20010db80003", "SE", "Lund")]


def geo_ranges_of_both(spark):
    four = geo_ranges(spark).withColumns({c: number_key(c) for c in ("low", "high")})
    rows = [(net.ljust(32, "0"), net.ljust(32, "f"), cc, city, "", "1", "2") for net, cc, city in _GEO6]
    return four.unionByName(spark.createDataFrame(rows, ", ".join(f"{c} string" for c in four.columns)))


@check(
    "geo_range_lookup",
    sql(
        f"""SELECT r.id,
  CASE WHEN r.id % 7 > 0 THEN lower(g.cc) WHEN r.id % 5 = 1 THEN 'nl' WHEN r.id % 5 = 3 THEN 'se' END AS geo_country,
  CASE WHEN r.id % 7 > 0 THEN CASE WHEN g.sub <> '' THEN concat(g.city, ' (', g.sub, ')') ELSE g.city END
    WHEN r.id % 5 = 1 THEN 'Delft' WHEN r.id % 5 = 3 THEN 'Lund' END AS geo_city,
  CASE WHEN r.id % 7 > 0 AND g.cc IS NOT NULL THEN concat(g.lat, ',', g.lon) WHEN r.id % 7 = 0 AND r.id % 5 IN (1, 3) THEN '1,2' END AS geo_location
FROM pageviews r LEFT JOIN geo g ON {IP_NUMBER} BETWEEN g.low AND g.high AND g.cc <> 'XX'""",
        f"geo(low, high, cc, city, sub, lat, lon) AS (VALUES {GEO_VALUES})",
    ),
)
def geo_range_lookup(spark, sf_dir):
    rows = pv(spark, sf_dir, "id ip").withColumn("ip", F.expr(_EITHER))
    out = joins.geo_lookup(rows, geo_ranges_of_both(spark))
    return out.select("id", "geo_country", "geo_city", "geo_location")


# A search-result referrer for every page view; some engines keep the words elsewhere.
SEARCH_URL = (
    "concat('https://', CASE id % 4 WHEN 0 THEN 'www.finder.de' WHEN 1 THEN 'seek.com' WHEN 2 THEN 'm.looker.co.jp' "
    "ELSE 'other.example.net' END, '/find?', CASE id % 4 WHEN 0 THEN 'suche=' WHEN 1 THEN 'p=' WHEN 2 THEN 'none=' "
    "ELSE 'q=' END, 'red+shoe%20', id % 50, '&cd=', id % 9, '&source=web')"
)


def search_engines(spark):
    return spark.sql(
        "SELECT * FROM VALUES ('finder.{}', 'Finder', array('text', 'suche')), ('seek.com', 'Seek', array('p')), "
        "('looker.{}', 'Looker', array('q')) AS engines(host_key, engine, parameters)"
    )


@check(
    "search_engine_lookup",
    sql(
        """SELECT id, CASE id % 4 WHEN 0 THEN 'Finder' WHEN 1 THEN 'Seek' WHEN 2 THEN 'Looker' END AS engine,
  CASE WHEN id % 4 <> 2 THEN concat('red shoe ', id % 50) END AS searchterms FROM pageviews"""
    ),
)
def search_engine_lookup(spark, sf_dir):
    rows = pv(spark, sf_dir, "id").withColumn("referer", F.expr(SEARCH_URL))
    return search_words_by_engine(rows, search_engines(spark)).select("id", "engine", "searchterms")


_PAGE_PATH = "regexp_extract(url, '^[a-z]+://[^/]+(/[^#]*)', 1)"


@check(
    "title_lookup",
    sql(
        "SELECT r.id, coalesce(t.title, r.resource) AS title FROM pageviews r LEFT JOIN titles t ON t.resource = r.resource",
        f"titles AS (SELECT {_PAGE_PATH} AS resource, concat('Page ', min(page_id)) AS title FROM pages WHERE url LIKE 'https%' GROUP BY 1)",
    ),
)
def title_lookup(spark, sf_dir):
    """Pages served by https have a title; the rest show their path."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").where("url LIKE 'https%'")
    titles = pages.selectExpr(f"{_PAGE_PATH} AS resource", "page_id").groupBy("resource").agg(
        F.concat(F.lit("Page "), F.min("page_id")).alias("title")
    )
    return joins.with_titles(pv(spark, sf_dir, "id resource"), titles).select("id", "title")


@check(
    "heatmap_screen_join",
    sql(
        """SELECT s.event_id, s.position, p.screen_width FROM site_events s JOIN pageviews p ON p.id = s.id
WHERE regexp_matches(s.position, '^[0-9]+$') AND p.screen_width > 0"""
    ),
)
def heatmap_screen_join(spark, sf_dir):
    return joins.damaged_positions(events(spark, sf_dir, "event_id id position"), pv(spark, sf_dir, "id screen_width"))


@check(
    "sessionize_gap",
    sql(
        """SELECT user_id, min(dt) AS start, max(dt) AS "end", count(*) AS hits, min(id) AS first_id FROM (
  SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY dt, id) AS visit FROM (
    SELECT *, CASE WHEN dt - lag(dt) OVER (PARTITION BY user_id ORDER BY dt, id) < 1800 THEN 0 ELSE 1 END AS opens FROM hits) AS a) AS b
GROUP BY user_id, visit""",
        _HITS,
    ),
)
def sessionize_gap(spark, sf_dir):
    return visits.visits_of(visits.gap_starts(hits(spark, sf_dir), "user_id"), "user_id")


@check(
    "sessionize_fixed",
    sql(
        """SELECT h.user_id, s.start, max(h.dt) AS "end", count(*) AS hits, min(h.id) AS first_id
FROM hits h JOIN (SELECT user_id, start, lead(start) OVER (PARTITION BY user_id ORDER BY start) AS next_start
  FROM starts WHERE start IS NOT NULL) s
  ON s.user_id = h.user_id AND h.dt >= s.start AND (h.dt < s.next_start OR s.next_start IS NULL)
GROUP BY h.user_id, s.start""",
        f"""{_HITS},
starts AS (
  SELECT user_id, min(dt) AS start FROM hits GROUP BY user_id
  UNION ALL
  SELECT s.user_id, (SELECT min(h.dt) FROM hits h WHERE h.user_id = s.user_id AND h.dt >= s.start + 1800) AS start
  FROM starts s WHERE s.start IS NOT NULL)""",
        recursive=True,
    ),
)
def sessionize_fixed(spark, sf_dir):
    return visits.visits_of(visits.fixed_starts(hits(spark, sf_dir), "user_id"), "user_id")


@check(
    "visit_numbering",
    sql(
        """SELECT user_id, start, 1000 + row_number() OVER (ORDER BY start, user_id) AS visit_id FROM (
  SELECT user_id, min(dt) AS start FROM (
  SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY dt, id) AS visit FROM (
    SELECT *, CASE WHEN dt - lag(dt) OVER (PARTITION BY user_id ORDER BY dt, id) < 1800 THEN 0 ELSE 1 END AS opens FROM hits) AS a) AS b
  GROUP BY user_id, visit) AS v""",
        _HITS,
    ),
)
def visit_numbering(spark, sf_dir):
    found = visits.visits_of(visits.gap_starts(hits(spark, sf_dir), "user_id"), "user_id")
    return visits.number_visits(found, "user_id", base=1000).select("user_id", "start", "visit_id")


def crowd(spark, sf_dir):
    """Hits of eight addresses on a clock 3,600 times as dense, so that the limit is met."""
    rows = testdata.base_events(spark, sf_dir)
    return rows.select(
        F.expr("concat('10.0.0.', user_id % 8)").alias("ip"),
        (F.call_function("div", F.col("dt") - FIRST, F.lit(3600)) + FIRST).alias("dt"),
    )


RATE_SQL = sql(
    "SELECT ip, dt, hits, accepted FROM walk",
    f"""crowd AS (SELECT concat('10.0.0.', user_id % 8) AS ip, {FIRST} + (dt - {FIRST}) // 3600 AS dt FROM e),
seconds AS (SELECT ip, dt, count(*) AS hits, row_number() OVER (PARTITION BY ip ORDER BY dt) AS n FROM crowd GROUP BY ip, dt),
walk AS (
  SELECT ip, dt, hits, n, least(hits, 10) AS accepted, least(hits, 10) AS used, dt AS last FROM seconds WHERE n = 1
  UNION ALL
  SELECT s.ip, s.dt, s.hits, s.n,
    least(s.hits, 10 - CASE WHEN s.dt - w.last > 5 THEN 0 ELSE w.used END),
    CASE WHEN s.dt - w.last > 5 THEN least(s.hits, 10) ELSE w.used + least(s.hits, 10 - w.used) END,
    CASE WHEN s.dt - w.last > 5 OR w.used < 10 THEN s.dt ELSE w.last END
  FROM walk w JOIN seconds s ON s.ip = w.ip AND s.n = w.n + 1)""",
    recursive=True,
)


@check("rate_limit", RATE_SQL)
def rate_limit(spark, sf_dir):
    return visits.rate_limited(crowd(spark, sf_dir))


@check(
    "visit_header_break",
    sql(
        """SELECT id, (lag(id) OVER w IS NULL OR visit_id IS DISTINCT FROM lag(visit_id) OVER w OR ip IS DISTINCT FROM lag(ip) OVER w
  OR browser IS DISTINCT FROM lag(browser) OVER w OR platform IS DISTINCT FROM lag(platform) OVER w
  OR username IS DISTINCT FROM lag(username) OVER w
  OR (coalesce(fingerprint, '') <> '' AND fingerprint IS DISTINCT FROM lag(fingerprint) OVER w)) AS new_block
FROM (SELECT * FROM ranged ORDER BY dt DESC, id DESC LIMIT 200) AS page WINDOW w AS (ORDER BY dt DESC, id DESC)"""
    ),
)
def visit_header_break(spark, sf_dir):
    rows = ranged(spark, sf_dir, "id visit_id ip browser platform username fingerprint")
    page = ranking.page(rows, ranking.sort_keys("dt, id"), 200)
    return visits.header_breaks(page).select("id", "new_block")


@check(
    "time_on_page",
    sql(
        """SELECT id, seconds, CASE WHEN seconds >= 3600 THEN strftime(make_timestamp(seconds * 1000000), '%H:%M:%S')
  ELSE strftime(make_timestamp(seconds * 1000000), '%M:%S') END AS shown
FROM (SELECT id, CASE WHEN dt_out <> 0 THEN dt_out - dt END AS seconds FROM pageviews) AS t"""
    ),
)
def time_on_page(spark, sf_dir):
    from footfall.functions.times import clock

    seconds = F.when(F.col("dt_out") != 0, F.col("dt_out") - F.col("dt"))
    rows = pv(spark, sf_dir, "id dt dt_out").select("id", seconds.alias("seconds"))
    return rows.withColumn("shown", clock("seconds"))


@check(
    "visitor_class",
    sql(
        """SELECT id, CASE WHEN referer LIKE '%://%.example.org/%' THEN 'search-engine' WHEN browser_type <> 1 THEN 'direct'
  ELSE 'bot' END AS traffic, CASE WHEN notes LIKE '%user:%' THEN 'known-user' WHEN username <> '' THEN 'known-visitor' END AS person
FROM pageviews"""
    ),
)
def visitor_class(spark, sf_dir):
    from footfall.operators.access_log import visitor_class as classify

    rows = pv(spark, sf_dir, "id referer browser_type notes username")
    engine = F.coalesce(F.col("referer").like("%://%.example.org/%"), F.lit(False))
    return classify(rows, engine).select("id", "traffic", "person")


_WANTED = """CASE id % 3 WHEN 0 THEN concat(upper(substr(resource, 1, length(resource) - 2)), '!!')
  WHEN 1 THEN concat('*', right(resource, 6)) ELSE concat(substr(resource, 1, 5), '*', right(resource, 3), '!') END"""


@check(
    "pattern_table",
    sql(
        """SELECT p.id, COALESCE(m.hit, false) AS listed FROM pageviews p LEFT JOIN (
  SELECT DISTINCT v.resource, true AS hit FROM (SELECT DISTINCT resource FROM pageviews) AS v JOIN (
    SELECT DISTINCT replace(replace(replace(replace(replace(lower(pattern), '\\', '\\\\'), '%', '\\%'), '_', '\\_'), '*', '%'), '!', '_') AS pattern FROM wanted) AS w
  ON lower(v.resource) LIKE w.pattern ESCAPE '\\') AS m ON m.resource = p.resource""",
        f"wanted AS (SELECT {_WANTED} AS pattern FROM pageviews WHERE id % 40 = 0 AND resource IS NOT NULL)",
    ),
)
def pattern_table(spark, sf_dir):
    """Patterns made of every fortieth page view, held against the pages of all."""
    rows = pv(spark, sf_dir, "id resource")
    wanted = rows.where("id % 40 = 0 AND resource IS NOT NULL").select(F.expr(_WANTED).alias("pattern"))
    return patterns.in_pattern_table(rows, wanted, ["resource"], "listed").select("id", "listed")
