"""Sources, sinks, retention, erasure. Jobs that write use fresh folders."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import MIDDAY, check, last_moment, pv, ranged, sql
from checks.joins import SPAM_SQL, spam_list
from footfall.operators import lifecycle, subjects
from footfall.schema import EVENT_COLUMNS, PAGEVIEW_COLUMNS
from footfall.session import scratch_path
from footfall.sources import tables, testdata

_ALL = ", ".join(PAGEVIEW_COLUMNS)
_ALL_EVENTS = ", ".join(EVENT_COLUMNS)


def stored(spark, sf_dir, label: str, is_event: bool = False) -> str:
    """A table by day in a fresh folder."""
    path = scratch_path(spark, label)
    rows = testdata.site_events(spark, sf_dir) if is_event else testdata.pageviews(spark, sf_dir)
    tables.append_rows(rows, path)
    return path


def halves(spark, sf_dir, label: str, is_event: bool = False, change=None) -> tuple[list[str], object]:
    """Paths of a live and an archive table (split at a moment), and a function that reads both."""
    read = tables.read_events if is_event else tables.read_pageviews
    rows = testdata.site_events(spark, sf_dir) if is_event else testdata.pageviews(spark, sf_dir)
    rows = change(rows) if change else rows
    paths = []
    for place, part in zip(("archive", "live"), lifecycle.split_by_age(rows, MIDDAY)):
        paths.append(scratch_path(spark, f"{label}-{place}"))
        tables.append_rows(part, paths[-1])
    return paths, lambda: read(spark, paths[0]).unionByName(read(spark, paths[1]))


@check("src_pageviews", sql(f"SELECT {_ALL} FROM pageviews"))
def src_pageviews(spark, sf_dir):
    """Written by day, read back with the fixed layout."""
    return tables.read_pageviews(spark, stored(spark, sf_dir, "pageviews")).select(*PAGEVIEW_COLUMNS)


@check("src_events", sql(f"SELECT {_ALL_EVENTS} FROM site_events"))
def src_events(spark, sf_dir):
    return tables.read_events(spark, stored(spark, sf_dir, "events", True)).select(*EVENT_COLUMNS)


@check(
    "src_archive_union",
    sql("SELECT content_type, count(*) AS counthits, min(dt) AS first_dt, max(dt) AS last_dt FROM pageviews GROUP BY content_type"),
)
def src_archive_union(spark, sf_dir):
    rows = pv(spark, sf_dir, "id dt content_type")
    old, kept = lifecycle.split_by_age(rows, MIDDAY)
    return tables.history(kept, old).groupBy("content_type").agg(
        F.count("*").alias("counthits"), F.min("dt").alias("first_dt"), F.max("dt").alias("last_dt")
    )


@check(
    "sink_append_ignore",
    sql(
        f"""SELECT id, browser, 'old' AS origin FROM pageviews WHERE dt < {MIDDAY}
UNION ALL SELECT id, browser, 'new' FROM pageviews WHERE dt >= {MIDDAY}"""
    ),
)
def sink_append_ignore(spark, sf_dir):
    """Rows before a moment are there; then every row is offered twice."""
    from pyspark.sql import types as T

    path = scratch_path(spark, "append")
    rows = pv(spark, sf_dir, "id browser dt")
    tables.append_rows(rows.where(F.col("dt") < MIDDAY).withColumn("origin", F.lit("old")), path)
    offered = rows.withColumn("origin", F.lit("new"))
    lifecycle.append_new(offered.unionByName(offered), path)
    layout = T.StructType([*offered.schema.fields, T.StructField("dt_date", T.DateType())])
    return spark.read.schema(layout).parquet(path).select("id", "browser", "origin")


_AGE_DAYS = 10


@check(
    "archive_old_rows",
    sql(
        f"""SELECT CASE WHEN dt < (SELECT max(dt) FROM pageviews) - {_AGE_DAYS} * 86400 THEN 'archive' ELSE 'live' END AS place, 'pageviews' AS kind,
  count(*) AS counthits, min(dt) AS first_dt, max(dt) AS last_dt, CAST(sum(id) AS BIGINT) AS ids FROM pageviews GROUP BY 1
UNION ALL
SELECT CASE WHEN dt < (SELECT max(dt) FROM pageviews) - {_AGE_DAYS} * 86400 THEN 'archive' ELSE 'live' END, 'events',
  count(*), min(dt), max(dt), CAST(sum(id) AS BIGINT) FROM site_events GROUP BY 1"""
    ),
)
def archive_old_rows(spark, sf_dir):
    as_of = last_moment(spark, sf_dir)
    out = None
    for kind, is_event in (("pageviews", False), ("events", True)):
        live, archive = stored(spark, sf_dir, f"live-{kind}", is_event), scratch_path(spark, f"archive-{kind}")
        lifecycle.archive_old(spark, live, archive, as_of, _AGE_DAYS, is_event)
        read = tables.read_events if is_event else tables.read_pageviews
        for place, path in (("live", live), ("archive", archive)):
            part = read(spark, path).agg(
                F.count("*").alias("counthits"), F.min("dt").alias("first_dt"), F.max("dt").alias("last_dt"), F.sum("id").alias("ids")
            ).select(F.lit(place).alias("place"), F.lit(kind).alias("kind"), "counthits", "first_dt", "last_dt", "ids")
            out = part if out is None else out.unionByName(part)
    return out


@check(
    "delete_by_id",
    sql("SELECT 'pageview' AS kind, id FROM pageviews WHERE id <> 42 UNION ALL SELECT 'event', event_id FROM site_events WHERE id <> 42"),
)
def delete_by_id(spark, sf_dir):
    """Live and archive tables are written, the job runs, both are read back."""
    (pages, read_pages), (clicks, read_clicks) = halves(spark, sf_dir, "delete"), halves(spark, sf_dir, "delete-events", True)
    lifecycle.delete_stored(spark, 42, pages, clicks)
    return read_pages().select(F.lit("pageview").alias("kind"), "id").unionByName(
        read_clicks().select(F.lit("event").alias("kind"), F.col("event_id").alias("id"))
    )


@check(
    "purge_spammer",
    sql(
        """SELECT id FROM pageviews WHERE (username IS NULL OR username NOT IN (SELECT username FROM spam)) AND ip NOT IN (SELECT ip FROM spam)""",
        SPAM_SQL,
    ),
)
def purge_spammer(spark, sf_dir):
    paths, read = halves(spark, sf_dir, "purge")
    lifecycle.purge_stored(spark, spam_list(spark, sf_dir), paths)
    return read().select("id")


@check("export_result", sql("SELECT browser, platform, count(*) AS counthits FROM ranged GROUP BY browser, platform"))
def export_result(spark, sf_dir):
    """A report's rows saved as CSV and read back."""
    path = scratch_path(spark, "export")
    rows = ranged(spark, sf_dir, "browser platform").groupBy("browser", "platform").agg(F.count("*").alias("counthits"))
    tables.write_result(rows, path, "csv")
    return spark.read.schema(rows.schema).option("header", "true").csv(path)


@check(
    "notes_layout_upgrade",
    sql(
        """SELECT id, CASE id % 3 WHEN 0 THEN notes ELSE concat('[a:', id % 5, '][b]') END AS notes FROM pageviews"""
    ),
)
def notes_layout_upgrade(spark, sf_dir):
    old = F.expr("CASE id % 3 WHEN 0 THEN notes ELSE concat('a:', id % 5, ';b') END")
    paths, read = halves(spark, sf_dir, "notes", change=lambda rows: rows.withColumn("notes", old))
    lifecycle.upgrade_stored_notes(spark, paths)
    return read().select("id", "notes")


@check(
    "subject_export_pageviews",
    sql(
        """SELECT id, dt, name, value FROM (
  SELECT id, dt, unnest(['ip', 'username', 'country', 'resource', 'visit_id', 'dt_out', 'browser']) AS name,
    unnest([ip, username, country, resource, CAST(visit_id AS VARCHAR), CAST(dt_out AS VARCHAR), browser]) AS value
  FROM (SELECT * FROM pageviews WHERE email = 'user3@example.com' ORDER BY dt DESC, id DESC LIMIT 500) AS page) AS items
WHERE value <> '' AND value <> '0'"""
    ),
)
def subject_export_pageviews(spark, sf_dir):
    rows = pv(spark, sf_dir, "id dt email ip username country resource visit_id dt_out browser")
    out = subjects.export_pageviews(rows, "user3@example.com", page=1)
    return out.where("name NOT IN ('email', 'dt')")


def people(spark, sf_dir):
    """Everybody with a purchase marked k = 50 asks for erasure."""
    rows = testdata.base_events(spark, sf_dir).where("event_type = 'purchase' AND k = 50")
    return rows.select(F.expr("concat('user', user_id, '@example.com')").alias("email"))


_PEOPLE = "people AS (SELECT DISTINCT concat('user', user_id, '@example.com') AS email FROM e WHERE event_type = 'purchase' AND k = 50)"


@check(
    "subject_erase_pageviews",
    sql("SELECT id FROM pageviews WHERE email IS NULL OR email NOT IN (SELECT email FROM people)", _PEOPLE),
)
def subject_erase_pageviews(spark, sf_dir):
    (pages, read_pages), (clicks, _) = halves(spark, sf_dir, "erase"), halves(spark, sf_dir, "erase-events", True)
    subjects.erase_stored(spark, people(spark, sf_dir), pages, clicks)
    return read_pages().select("id")


@check(
    "subject_erase_events",
    sql(
        "SELECT event_id FROM site_events WHERE id NOT IN (SELECT id FROM pageviews WHERE email IN (SELECT email FROM people))",
        _PEOPLE,
    ),
)
def subject_erase_events(spark, sf_dir):
    (pages, _), (clicks, read_clicks) = halves(spark, sf_dir, "erase"), halves(spark, sf_dir, "erase-events", True)
    subjects.erase_stored(spark, people(spark, sf_dir), pages, clicks)
    return read_clicks().select("event_id")


@check(
    "anonymize_by_ip",
    sql(
        """SELECT id, CASE WHEN hit THEN '0.0.0.0' ELSE ip END AS ip, CASE WHEN hit THEN '' ELSE other_ip END AS other_ip,
  CASE WHEN hit THEN '' ELSE username END AS username, CASE WHEN hit THEN '' ELSE email END AS email,
  CASE WHEN hit THEN '' ELSE fingerprint END AS fingerprint, country
FROM (SELECT *, ip IN ('10.1.1.1', '10.2.2.2', '10.3.3.3') AS hit FROM pageviews) AS p"""
    ),
)
def anonymize_by_ip(spark, sf_dir):
    paths, read = halves(spark, sf_dir, "anonymise")
    asked = pv(spark, sf_dir, "ip").where("ip IN ('10.1.1.1', '10.2.2.2', '10.3.3.3')")
    lifecycle.anonymise_stored(spark, asked, paths)
    return read().select("id", "ip", "other_ip", "username", "email", "fingerprint", "country")


