"""Streaming queries, run over what is there and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import FIRST, check, sql
from checks.ingest import FOLD_SQL, updates
from checks.joins import DENSE, RATE_SQL
from checks.lifecycle import stored
from footfall.operators import deltas
from footfall.session import checkpointed, scratch_path
from footfall.sources import tables, testdata
from footfall.streaming import late, live, visits
from footfall.streaming.runs import run_to_table, stream_table


def hit_stream(spark, sf_dir):
    """The events file as a stream of hits: id, user_id, event time, page view columns that need no join."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return _hits(stream_table(spark, sf_dir, schema, "events.parquet"))


def stored_hits(spark, sf_dir):
    """The same hits as a table."""
    return _hits(spark.read.parquet(f"{sf_dir}/events.parquet"))


def _hits(raw):
    timed = raw.withColumn("ts", F.col("ts").cast("timestamp"))
    base = timed.selectExpr(
        "event_id", "user_id", "event_type", "value", "ts", "unix_timestamp(ts) AS dt", "dayofyear(ts) AS doy",
        "CAST(get_json_object(props, '$.k') AS BIGINT) AS k",
    ).alias("e")
    wanted = ("visit_id", "fingerprint", "content_type", "browser", "content_id")
    columns = [F.expr(testdata.PAGEVIEW_SQL[c]).alias(c) for c in wanted]
    return base.select(F.expr("e.event_id + 1").alias("id"), "user_id", "ts", "dt", "k", *columns)


def dense(stream, factor: int):
    """The same hits on a denser clock."""
    dt = F.call_function("div", F.col("dt") - FIRST, F.lit(factor)) + FIRST
    return stream.withColumn("dt", dt).withColumn("ts", F.timestamp_seconds("dt"))


@check(
    "stream_sessions",
    sql(
        f"""SELECT user_id, min(dt) AS start, max(dt) AS "end", count(*) AS hits,
  max(dt) + 1799 <= (SELECT max({DENSE}) FROM e) - 3600 AS closed FROM (
  SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY dt, event_id) AS visit FROM (
    SELECT event_id, user_id, {DENSE} AS dt, CASE WHEN {DENSE} - lag({DENSE}) OVER (PARTITION BY user_id ORDER BY {DENSE}, event_id) < 1800
      THEN 0 ELSE 1 END AS opens FROM e) AS a) AS b GROUP BY user_id, visit"""
    ),
)
def stream_sessions(spark, sf_dir):
    """Visits closed by the stream, and the open ones added by the nightly pass over the stored hits."""
    closed = run_to_table(visits.gap_visits(dense(hit_stream(spark, sf_dir), 60), "user_id"), scratch_path(spark, "stream-sessions"))
    return late.corrected_visits(closed, dense(stored_hits(spark, sf_dir), 60), "user_id")


@check(
    "stream_sessions_fixed",
    sql(
        """SELECT CAST(h.user_id AS VARCHAR) AS user_id, s.start, count(*) AS hits
FROM hits h JOIN (SELECT user_id, start, lead(start) OVER (PARTITION BY user_id ORDER BY start) AS next_start
  FROM starts WHERE start IS NOT NULL) s
  ON s.user_id = h.user_id AND h.dt >= s.start AND (h.dt < s.next_start OR s.next_start IS NULL)
GROUP BY h.user_id, s.start""",
        f"""hits AS (SELECT user_id, {DENSE} AS dt FROM e),
starts AS (
  SELECT user_id, min(dt) AS start FROM hits GROUP BY user_id
  UNION ALL
  SELECT s.user_id, (SELECT min(h.dt) FROM hits h WHERE h.user_id = s.user_id AND h.dt >= s.start + 1800) AS start
  FROM starts s WHERE s.start IS NOT NULL)""",
        recursive=True,
    ),
)
def stream_sessions_fixed(spark, sf_dir):
    seconds = run_to_table(visits.fixed_visits(dense(hit_stream(spark, sf_dir), 60), "user_id"), scratch_path(spark, "stream-fixed"))
    return seconds.groupBy(F.col("key").alias("user_id"), "start").agg(F.sum("hits").alias("hits"))


#: What the streams' watermark has passed: an hour behind the newest minute.
_PASSED = "(SELECT max(dt) // 60 * 60 - 3600 FROM pageviews WHERE {})"


@check(
    "stream_online",
    sql(
        f"""SELECT (dt // 60 + n) * 60 AS minute, count(DISTINCT visit_id) AS online, (dt // 60 + n) * 60 < {_PASSED.format("visit_id > 0")} AS closed
FROM pageviews, generate_series(1, 30) AS g(n) WHERE visit_id > 0 GROUP BY ALL"""
    ),
)
def stream_online(spark, sf_dir):
    """The running sum of what the stream says about visits, with the last minutes added from the stored hits."""
    changes = run_to_table(live.online_changes(hit_stream(spark, sf_dir).where("visit_id > 0")), scratch_path(spark, "stream-online"))
    return late.corrected_online(changes, stored_hits(spark, sf_dir).where("visit_id > 0"))


@check(
    "stream_minute_series",
    sql(
        f"""SELECT dt // 60 * 60 AS minute, count(DISTINCT content_id) AS cnt, dt // 60 * 60 + 60 <= {_PASSED.format("content_id IS NOT NULL")} AS closed
FROM pageviews WHERE content_id IS NOT NULL GROUP BY ALL"""
    ),
)
def stream_minute_series(spark, sf_dir):
    closed = run_to_table(live.minute_series(hit_stream(spark, sf_dir), "content_id"), scratch_path(spark, "stream-minutes"))
    return late.corrected_minutes(closed, stored_hits(spark, sf_dir), lambda rows: live.stored_minutes(rows, "content_id"))


@check(
    "stream_dedupe",
    sql(
        "SELECT h.id FROM kept k JOIN firsts h ON h.fingerprint = k.fingerprint AND h.content_type = k.content_type "
        "AND h.browser IS NOT DISTINCT FROM k.browser AND h.dt = k.dt",
        f"""firsts AS (SELECT fingerprint, content_type, browser, {DENSE} AS dt, min(id) AS id FROM pageviews GROUP BY 1, 2, 3, 4),
kept AS (
  SELECT fingerprint, content_type, browser, min(dt) AS dt FROM firsts GROUP BY 1, 2, 3
  UNION ALL
  SELECT k.fingerprint, k.content_type, k.browser, (SELECT min(f.dt) FROM firsts f WHERE f.fingerprint = k.fingerprint
    AND f.content_type = k.content_type AND f.browser = k.browser AND f.dt > k.dt + 1800) AS next_dt
  FROM kept k WHERE k.dt IS NOT NULL)""",
        recursive=True,
    ),
)
def stream_dedupe(spark, sf_dir):
    rows = dense(hit_stream(spark, sf_dir), 60)
    return run_to_table(visits.drop_repeats(rows, ["fingerprint", "content_type", "browser"]), scratch_path(spark, "stream-repeats")).select("id")


@check("stream_rate_limit", RATE_SQL)
def stream_rate_limit(spark, sf_dir):
    rows = dense(hit_stream(spark, sf_dir), 3600).withColumn("ip", F.expr("concat('10.0.0.', user_id % 8)"))
    return run_to_table(visits.rate_limited(rows), scratch_path(spark, "stream-rate")).withColumnRenamed("key", "ip")


@check(
    "stream_pageview_updates",
    sql("SELECT *, 'read' AS place FROM folded UNION ALL SELECT *, 'compacted' FROM folded", FOLD_SQL),
)
def stream_pageview_updates(spark, sf_dir):
    """Updates arrive as files and are stored batch by batch; the table is read with them, and again after they are folded in."""
    table, inbox = stored(spark, sf_dir, "updated"), scratch_path(spark, "updates")
    rows = updates(spark, sf_dir, with_time=True)
    rows.write.parquet(inbox)
    folder = scratch_path(spark, "update-stream")
    for _ in range(2):  # a stream that is started again folds nothing twice
        late.stream_updates(spark, stream_table(spark, inbox, rows.schema), table, folder)
    columns = ["id", "notes", "outbound_resource", "dt_out", "resolution"]
    before = checkpointed(deltas.read_current(spark, table).select(*columns, F.lit("read").alias("place")))
    deltas.compact(spark, table)
    return before.unionByName(tables.read_pageviews(spark, table).select(*columns, F.lit("compacted").alias("place")))


@check(
    "stream_late_rows",
    sql(
        """SELECT strftime(make_timestamp(dt * 1000000), '%Y-%m-%d') AS day, count(*) AS hits,
  CASE WHEN (dt // 86400 + 1) * 86400 <= (SELECT max(dt) - 3600 FROM pageviews) THEN count(*) END AS streamed FROM pageviews GROUP BY dt // 86400, day"""
    ),
)
def stream_late_rows(spark, sf_dir):
    """Streamed day counts; days with late rows (put aside by a stream of their own) and open days counted from the stored rows."""
    streamed = run_to_table(late.daily_counts(hit_stream(spark, sf_dir)), scratch_path(spark, "stream-days"))
    aside = scratch_path(spark, "stream-late")
    late.split_late(hit_stream(spark, sf_dir), aside)
    whole = late.corrected_counts(streamed, testdata.pageviews(spark, sf_dir, "id dt"), late.late_days(spark, aside))
    return whole.select(F.date_format("dt_date", "yyyy-MM-dd").alias("day"), "hits", "streamed")
