"""Table upkeep: append, merge updates, archive, delete, anonymise, rollups.

Tables are Parquet by day. A job rewrites only the days it touches (dynamic
partition overwrite); days that end up empty are removed. Every job can run
again after a failure: appends skip known ids, archiving gives the same days,
and folded updates are staged under a name of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.functions.times import day_of
from footfall.operators.ingest import fold_updates
from footfall.schema import DAY, EMPTY_ADDRESS, RETENTION_DAYS
from footfall.session import checkpointed, scratch_path
from footfall.sources.membership import add_filters, ensure_filters, maybe_stored, stored_ids
from footfall.sources.tables import (
    append_rows,
    drop_days,
    drop_path,
    exists,
    is_complete,
    read_events,
    read_pageviews,
    replace_days,
    with_day,
)


def stored_keys(rows: DataFrame, path: str, key: str = "id", near: int | None = None) -> DataFrame | None:
    """The keys of `rows` that the table by day at `path` holds, None if the filters deny all; `near` as in `maybe_stored`.

    Only days whose filter says maybe are read, the key column alone, and joined with the keys that it said so of.
    """
    maybe = checkpointed(maybe_stored(rows, path, key, near))
    days = _days(maybe)
    if not days:
        return None
    stored = stored_ids(rows.sparkSession, path, rows.schema[key]).where(F.col("dt_date").isin(days)).select(key)
    return stored.join(maybe.select(key).distinct(), key, "left_semi")


def new_rows(rows: DataFrame, path: str, key: str = "id") -> DataFrame:
    """Rows whose key the table by day at `path` does not hold yet, whatever their day; `rows` have each key once."""
    known = stored_keys(rows, path, key)
    return rows if known is None else rows.join(known, key, "left_anti")


def append_new(rows: DataFrame, path: str, key: str = "id", unknown: bool = False) -> None:
    """Append rows with unknown keys; one row per key. `unknown` says that the table is known to hold none of the keys.

    The rows are checkpointed, since their keys are looked up, go to the filters, and are written.
    """
    rows, spark = checkpointed(with_day(rows).dropDuplicates([key])), rows.sparkSession
    if not unknown and exists(spark, path):
        ensure_filters(spark, path, rows.schema[key])
        rows = new_rows(rows, path, key)
    add_filters(rows, path, key)
    append_rows(rows, path, known=True)


def _days(rows: DataFrame) -> list:
    """The calendar days of some rows: bounded by the length of the history."""
    return [r[0] for r in rows.select("dt_date").distinct().collect()]


def rewrite(table: DataFrame, path: str, touched: DataFrame, change, stage: str | None = None) -> None:
    """Replace the days on which `touched` has rows by `change(rows of the day)`.

    The new content is written to the shared folder first, so a lost executor
    or a failed overwrite never leaves a half-read table behind. With a `stage`
    path a run that finds its own finished stage only repeats the overwrite;
    that makes changes which must not be applied twice safe to run again.
    """
    spark = table.sparkSession
    if stage and is_complete(spark, stage):
        replace_days(spark.read.schema(table.schema).parquet(stage), path)
        return
    days = _days(touched if "dt_date" in touched.columns else with_day(touched))
    if not days:
        return
    keep, stage = bool(stage), stage or scratch_path(spark, "rewrite")
    change(table.where(F.col("dt_date").isin(days))).write.mode("overwrite").parquet(stage)
    staged = spark.read.schema(table.schema).parquet(stage)
    left = set(_days(staged))
    replace_days(staged, path)
    drop_days(spark, path, [str(d) for d in days if d not in left])
    if not keep:  # a named stage marks its batch as done; others have served
        drop_path(spark, stage)


def merge_updates(spark: SparkSession, path: str, updates: DataFrame, stage: str | None = None) -> None:
    """Fold later updates into the stored page views.

    Updates that carry `page_dt`, the time of their page view, name the touched days themselves; for others the
    ids are looked up in the table.
    """
    table = read_pageviews(spark, path)
    if "page_dt" in updates.columns:
        touched = updates.select(day_of("page_dt").alias("dt_date"))
        updates = updates.drop("page_dt")
    else:
        touched = table.select("id", "dt_date").join(updates.select("id").distinct(), "id", "left_semi")
    rewrite(table, path, touched, lambda rows: fold_updates(rows, updates), stage)


def cutoff(as_of: int, days: int = RETENTION_DAYS) -> int:
    return as_of - days * DAY


def split_by_age(df: DataFrame, before: int) -> tuple[DataFrame, DataFrame]:
    """(old, kept) rows."""
    return df.where(F.col("dt") < before), df.where(F.col("dt") >= before)


def archive_old(spark: SparkSession, path: str, archive_path: str | None, as_of: int,
                days: int = RETENTION_DAYS, events: bool = False) -> None:
    """Move rows older than `days` to the archive, or drop them without one.

    Old whole days are removed as directories; the one day cut by the limit is
    rewritten.
    """
    table = read_events(spark, path) if events else read_pageviews(spark, path)
    limit = cutoff(as_of, days)
    last_day = F.to_date(F.timestamp_seconds(F.lit(limit)))
    old, _ = split_by_age(table.where(F.col("dt_date") <= last_day), limit)
    if archive_path:
        append_new(old, archive_path, "event_id" if events else "id")
    whole = _days(table.where(F.col("dt_date") < last_day))
    cut = table.where((F.col("dt_date") == last_day) & (F.col("dt") < limit))
    rewrite(table, path, cut, lambda rows: rows.where(F.col("dt") >= limit))
    drop_days(spark, path, [str(d) for d in whole])


def delete_stored(spark: SparkSession, page_id: int, pageviews: list[str], events: list[str]) -> None:
    """Take one page view and its events out of the live and archive tables; only their days are rewritten."""
    for path, read in [(p, read_pageviews) for p in pageviews] + [(p, read_events) for p in events]:
        table = read(spark, path)
        rewrite(table, path, table.where(F.col("id") == page_id), lambda rows: rows.where(F.col("id") != page_id))


def is_spam(pageviews: DataFrame, spam: DataFrame) -> DataFrame:
    """The page views of spammers, by name or address (spam has username, ip)."""
    by_name = spam.select("username").where("username <> ''").distinct()
    by_address = spam.select("ip").where("ip <> ''").distinct()
    columns = pageviews.columns
    named = pageviews.join(by_name, "username", "left_semi").select(*columns)
    rest = pageviews.join(by_name, "username", "left_anti").join(by_address, "ip", "left_semi").select(*columns)
    return named.unionByName(rest)


def purge_spam(pageviews: DataFrame, spam: DataFrame) -> DataFrame:
    """Page views without those of spammers."""
    by_name = spam.select("username").where("username <> ''").distinct()
    by_address = spam.select("ip").where("ip <> ''").distinct()
    kept = pageviews.join(by_name, "username", "left_anti").join(by_address, "ip", "left_anti")
    return kept.select(*pageviews.columns)


def purge_stored(spark: SparkSession, spam: DataFrame, paths: list[str]) -> None:
    """Take spammers out of the live and archive tables."""
    for path in paths:
        table = read_pageviews(spark, path)
        found = is_spam(table.select("dt_date", "username", "ip"), spam)
        rewrite(table, path, found, lambda rows: purge_spam(rows, spam))


def upgrade_notes(notes: str = "notes") -> Column:
    """Old `a;b` notes as `[a][b]`."""
    c = F.col(notes)
    return F.when(~F.startswith(c, F.lit("[")), F.concat(F.lit("["), F.replace(c, F.lit(";"), F.lit("][")), F.lit("]"))).otherwise(c)


def upgrade_stored_notes(spark: SparkSession, paths: list[str]) -> None:
    """Bring old notes of stored page views into the new layout; days without any stay as they are."""
    for path in paths:
        table = read_pageviews(spark, path)
        old = table.where("notes NOT LIKE '[%'")
        rewrite(table, path, old, lambda rows: rows.withColumn("notes", upgrade_notes()))


def anonymise(df: DataFrame, addresses: DataFrame) -> DataFrame:
    """Blank the identity of rows from some addresses (a table with column ip); the rows stay."""
    wanted = addresses.select(F.col("ip").alias("asked_ip")).where("asked_ip IS NOT NULL").distinct()
    marked = df.join(wanted, F.col("ip") == F.col("asked_ip"), "left")
    hit = F.col("asked_ip").isNotNull()
    blank = {"ip": EMPTY_ADDRESS, "other_ip": "", "username": "", "email": "", "fingerprint": ""}
    return marked.select(
        *[F.when(hit, F.lit(blank[c])).otherwise(F.col(c)).alias(c) if c in blank else F.col(c) for c in df.columns]
    )


def anonymise_stored(spark: SparkSession, addresses: DataFrame, paths: list[str]) -> None:
    """Blank the identity of some addresses in the live and archive tables."""
    for path in paths:
        table = read_pageviews(spark, path)
        found = table.select("dt_date", "ip").join(addresses.select("ip").distinct(), "ip", "left_semi")
        rewrite(table, path, found, lambda rows: anonymise(rows, addresses))


def daily_rollup(df: DataFrame, keys: list[str]) -> DataFrame:
    """Per day and key: hits, first and last time, and a sketch of the addresses."""
    day = F.col("dt_date") if "dt_date" in df.columns else day_of("dt")
    return df.groupBy(day.alias("dt_date"), *keys).agg(
        F.count("*").alias("counthits"),
        F.min("dt").alias("first_dt"),
        F.max("dt").alias("last_dt"),
        F.hll_sketch_agg("ip").alias("ips"),
    )


def merge_rollups(rollups: DataFrame, keys: list[str]) -> DataFrame:
    """Days (finished and partial) combined over all keys."""
    return rollups.groupBy(*keys).agg(
        F.sum("counthits").alias("counthits"),
        F.min("first_dt").alias("first_dt"),
        F.max("last_dt").alias("last_dt"),
        F.hll_sketch_estimate(F.hll_union_agg("ips")).alias("ips_estimate"),
    )
