"""Predicates, filter text, ranges, sorting and paging."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import END, MIDDAY, START, check, pv, ranged, sql
from footfall.operators import filters, ranking
from footfall.plans.ranges import presets, range_of

# query, column, operator, value, the same test in SQL
_CASES = [
    ("filter_equals", "browser", "equals", "Firefox", "browser = 'Firefox'"),
    ("filter_not_equal", "country", "is_not_equal_to", "france", "country <> 'france'"),
    ("filter_contains", "referer", "contains", "page=2", "referer LIKE '%page=2%'"),
    ("filter_in_set", "browser", "includes_in_set", "Chrome,Safari", "browser IN ('Chrome', 'Safari')"),
    ("filter_not_contains", "resource", "does_not_contain", "en", "resource NOT LIKE '%en%'"),
    ("filter_starts_with", "language", "starts_with", "en", "language LIKE 'en%'"),
    ("filter_ends_with", "ip", "ends_with", ".1", "ip LIKE '%.1'"),
    # Codes: Firefox and Fyrefux are both F612, no other browser name is.
    ("filter_sounds_like", "browser", "sounds_like", "Fyrefux", "browser = 'Firefox'"),
    ("filter_is_empty", "searchterms", "is_empty", "", "searchterms IS NULL"),
    ("filter_is_not_empty", "visit_id", "is_not_empty", "", "visit_id <> 0"),
    ("filter_gt", "server_latency", "is_greater_than", "500", "server_latency > 500"),
    ("filter_lt", "page_performance", "is_less_than", "300", "page_performance < 300"),
    ("filter_between", "screen_width", "between", "1500,1900", "screen_width BETWEEN 1500 AND 1900"),
    ("filter_matches", "platform", "matches", "^WIN", "regexp_matches(platform, '(?i)^WIN')"),
    ("filter_not_matches", "username", "does_not_match", "[05]$", "NOT regexp_matches(username, '(?i)[05]$')"),
    ("filter_multivalue", "notes", "equals", "new:yes", "notes LIKE '%new:yes%'"),
]


def _register(name, column, operator, value, condition):
    @check(name, sql(f"SELECT id, {column} FROM pageviews WHERE {condition}"))
    def query(spark, sf_dir):
        rows = pv(spark, sf_dir, f"id {column}")
        return rows.where(filters.predicate(column, operator, value)).select("id", column)


for _case in _CASES:
    _register(*_case)


@check(
    "filter_conjunction",
    sql("SELECT id, browser, country FROM pageviews WHERE browser = 'Chrome' AND country LIKE '%a%' AND visit_id > 0"),
)
def filter_conjunction(spark, sf_dir):
    tests = [("browser", "equals", "Chrome"), ("country", "contains", "a"), ("visit_id", "is_greater_than", "0")]
    spec = filters.Filters(columns=[*tests, ("addon_x", "equals", "y")])
    rows = pv(spark, sf_dir, "id browser country visit_id")
    return rows.where(filters.all_of(spec.predicates())).select("id", "browser", "country")


@check(
    "filter_spec",
    sql(
        f"SELECT id, browser, country, dt FROM pageviews WHERE browser = 'Firefox' AND country LIKE '%i%' AND dt BETWEEN {END - 10 * 86400 + 1} AND {END} "
        "ORDER BY dt DESC, id DESC LIMIT 50 OFFSET 10"
    ),
)
def filter_spec(spark, sf_dir):
    text = (
        "browser equals Firefox&&&country contains i&&&nosuch equals 1&&&city equals &&&"
        "interval equals -10&&&limit_results equals 50&&&start_from equals 10"
    )
    spec = filters.read_filters(text)
    rows = filters.apply_filters(pv(spark, sf_dir, "id dt browser country city"), text)
    rows = filters.in_time_range(rows, *range_of(spec.dates, END))
    out = rows.orderBy(F.desc("dt"), F.desc("id")).offset(spec.offset).limit(spec.limit)
    return out.select("id", "browser", "country", "dt")


@check("filter_time_range", sql("SELECT id, dt FROM ranged"))
def filter_time_range(spark, sf_dir):
    return ranged(spark, sf_dir, "id dt")


@check(
    "filter_not_null_injection",
    sql("SELECT id, searchterms, visit_id FROM pageviews WHERE searchterms IS NOT NULL AND visit_id <> 0"),
)
def filter_not_null_injection(spark, sf_dir):
    rows = pv(spark, sf_dir, "id searchterms visit_id")
    kept = rows.where(filters.reported("searchterms") & filters.reported("visit_id"))
    return kept.select("id", "searchterms", "visit_id")


@check("filter_author_scope", sql("SELECT id, author FROM pageviews WHERE author = 'author3'"))
def filter_author_scope(spark, sf_dir):
    return filters.only_author(pv(spark, sf_dir, "id author"), "author3").select("id", "author")


@check(
    "pred_in",
    sql(
        "SELECT id, platform, language FROM pageviews "
        "WHERE platform IN ('win10', 'ios') AND language NOT IN ('fr-fr', 'de-de') AND content_id = 7"
    ),
)
def pred_in(spark, sf_dir):
    rows = pv(spark, sf_dir, "id platform language content_id")
    test = filters.in_list("platform", "win10,ios,") & filters.in_list("language", ["fr-fr", "de-de"], negate=True)
    return rows.where(test & filters.in_list("content_id", [0, 7])).select("id", "platform", "language")


@check("pred_date_days", sql("SELECT id, dt FROM pageviews WHERE dt BETWEEN 1704844800 AND 1705017599"))
def pred_date_days(spark, sf_dir):
    return pv(spark, sf_dir, "id dt").where(filters.in_days("dt", "2024-01-10", "2024-01-11"))


_DAY = "CAST(make_timestamp(dt * 1000000) AS DATE)"


@check(
    "date_presets",
    sql(
        """SELECT name, first_second AS "start", last_second AS "end", count(pageviews.id) AS counthits
FROM ranges LEFT JOIN pageviews ON dt BETWEEN first_second AND last_second
GROUP BY ALL""",
        """day AS (SELECT CAST(make_timestamp(max(dt) * 1000000) AS DATE) AS d FROM pageviews),
days AS (
  SELECT 'today' AS name, d AS a, d AS b FROM day
  UNION ALL SELECT 'yesterday', d - 1, d - 1 FROM day
  UNION ALL SELECT 'this_week', CAST(date_trunc('week', d) AS DATE), CAST(date_trunc('week', d) AS DATE) + 6 FROM day
  UNION ALL SELECT 'last_week', CAST(date_trunc('week', d) AS DATE) - 7, CAST(date_trunc('week', d) AS DATE) - 1 FROM day
  UNION ALL SELECT 'this_month', CAST(date_trunc('month', d) AS DATE), last_day(d) FROM day
  UNION ALL SELECT 'last_month', CAST(date_trunc('month', d) - INTERVAL 1 MONTH AS DATE), CAST(date_trunc('month', d) AS DATE) - 1 FROM day
  UNION ALL SELECT 'last_7_days', d - 6, d FROM day
  UNION ALL SELECT 'last_28_days', d - 27, d FROM day
  UNION ALL SELECT 'last_30_days', d - 29, d FROM day
  UNION ALL SELECT 'last_90_days', d - 89, d FROM day
  UNION ALL SELECT 'last_6_months', CAST(d - INTERVAL 6 MONTH AS DATE), d FROM day
  UNION ALL SELECT 'this_year', CAST(date_trunc('year', d) AS DATE), CAST(date_trunc('year', d) + INTERVAL 1 YEAR AS DATE) - 1 FROM day),
ranges AS (
  SELECT name, CAST(epoch(CAST(a AS TIMESTAMP)) AS BIGINT) AS first_second,
         CAST(epoch(CAST(b AS TIMESTAMP)) AS BIGINT) + 86399 AS last_second
  FROM days)""",
    ),
)
def date_presets(spark, sf_dir):
    """Hits per named range: days are counted first, then met by the days of each range."""
    from checks.base import last_moment

    rows = pv(spark, sf_dir, "id dt")
    ranges = presets(spark, last_moment(spark, sf_dir))
    per_day = rows.groupBy(F.call_function("div", F.col("dt"), F.lit(86400)).alias("day")).agg(F.count("*").alias("n"))
    first, last = (F.call_function("div", F.col(c), F.lit(86400)) for c in ("start", "end"))
    days = ranges.select("name", "start", "end", F.explode(F.sequence(first, last)).alias("day"))
    joined = days.join(per_day, "day", "left")
    return joined.groupBy("name", "start", "end").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("counthits"))


@check(
    "previous_period",
    sql(
        f"""SELECT CASE WHEN dt BETWEEN {START} AND {END} THEN 'current' ELSE 'previous' END AS period,
       count(*) AS counthits, min(dt) AS first_dt, max(dt) AS last_dt
FROM pageviews
WHERE dt BETWEEN {START} AND {END}
   OR dt BETWEEN ({START} - ({END} - {START})) // 86400 * 86400 AND {END} - ({END} - {START})
GROUP BY 1"""
    ),
)
def previous_period(spark, sf_dir):
    from footfall.operators.series import both_periods

    rows = both_periods(pv(spark, sf_dir, "id dt"), START, END)
    return rows.groupBy("period").agg(
        F.count("*").alias("counthits"), F.min("dt").alias("first_dt"), F.max("dt").alias("last_dt")
    )


@check(
    "recent_rows",
    sql("SELECT resource, referer, country, dt, ip FROM ranged ORDER BY dt DESC, id DESC LIMIT 200 OFFSET 20"),
)
def recent_rows(spark, sf_dir):
    rows = ranged(spark, sf_dir, "id ip dt resource referer country")
    return ranking.recent_rows(rows, "resource", more_columns="referer, country", offset=20)


@check(
    "order_multi",
    sql("SELECT browser, country, id FROM pageviews ORDER BY browser ASC NULLS FIRST, country DESC NULLS LAST, id DESC"),
)
def order_multi(spark, sf_dir):
    rows = pv(spark, sf_dir, "id browser country")
    return rows.orderBy(*ranking.sort_keys("browser ASC, country, id")).select("browser", "country", "id")


@check(
    "order_tiebreak",
    sql(
        "SELECT resource, count(*) AS counthits FROM pageviews GROUP BY resource "
        "ORDER BY counthits DESC, resource ASC NULLS FIRST"
    ),
)
def order_tiebreak(spark, sf_dir):
    grouped = pv(spark, sf_dir, "resource").groupBy("resource").agg(F.count("*").alias("counthits"))
    return grouped.orderBy(*ranking.with_tiebreak("counthits DESC", ["resource"]))


@check(
    "order_nulls_last",
    sql("SELECT id, searchterms FROM pageviews ORDER BY searchterms ASC NULLS LAST, id DESC NULLS LAST"),
)
def order_nulls_last(spark, sf_dir):
    rows = pv(spark, sf_dir, "id searchterms")
    keys = ranking.sort_keys("searchterms ASC, id DESC", nulls_last=True)
    return rows.orderBy(*keys).select("id", "searchterms")


@check("limit_offset", sql("SELECT id, dt FROM pageviews ORDER BY dt DESC NULLS LAST, id DESC NULLS LAST LIMIT 50 OFFSET 100"))
def limit_offset(spark, sf_dir):
    return ranking.page(pv(spark, sf_dir, "id dt"), ranking.sort_keys("dt, id"), 50, 3).select("id", "dt")


@check(
    "union_distinct",
    sql("SELECT browser AS value FROM pageviews UNION SELECT platform FROM pageviews UNION SELECT country FROM pageviews"),
)
def union_distinct(spark, sf_dir):
    rows = pv(spark, sf_dir, "browser platform country")
    return ranking.union_distinct(*[rows.select(F.col(c).alias("value")) for c in ("browser", "platform", "country")])


_TWO_RANGES = [(START, START + 3 * 86400 - 1), (START + 2 * 86400, MIDDAY)]


@check(
    "union_all_ranges",
    sql(
        " UNION ALL ".join(
            f"SELECT id, dt, {i} AS range_no FROM pageviews WHERE dt BETWEEN {s} AND {e}"
            for i, (s, e) in enumerate(_TWO_RANGES)
        )
    ),
)
def union_all_ranges(spark, sf_dir):
    return ranking.union_ranges(pv(spark, sf_dir, "id dt"), _TWO_RANGES)
