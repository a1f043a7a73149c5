"""Requests of single persons: export and erasure by e-mail address."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.operators.lifecycle import rewrite
from footfall.sources.tables import read_events, read_pageviews


def export_pageviews(pageviews: DataFrame, email: str, page: int | None = None, size: int = 500) -> DataFrame:
    """Name/value items of one person's page views, newest first; empty fields are left out.

    `page` (from 1) gives one page of rows; without it the export is whole and
    unsorted, the id and time being part of every item.
    """
    rows = pageviews.where(F.col("email") == email)
    if page is not None:
        rows = rows.orderBy(F.desc("dt"), F.desc("id")).offset((page - 1) * size).limit(size)
    names = [c for c in pageviews.columns if c not in ("id", "dt_date")]
    items = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in names])
    out = rows.select("id", "dt", F.inline(items))
    return out.where("value <> '' AND value <> '0'")


def erase_pageviews(pageviews: DataFrame, subjects: DataFrame) -> DataFrame:
    """Page views without those of the listed persons (column email)."""
    return pageviews.join(subjects.select("email").distinct(), "email", "left_anti").select(*pageviews.columns)


def erase_stored(spark: SparkSession, subjects: DataFrame, pageviews: list[str], events: list[str]) -> None:
    """Take the listed persons out of the live and archive tables: their events first, then their page views.

    A person's events may lie in another table than the page view, so all page views are asked for their ids.
    """
    people = subjects.select("email").distinct()
    seen = [read_pageviews(spark, p).select("id", "email").join(people, "email", "left_semi").select("id") for p in pageviews]
    theirs = reduce(DataFrame.unionByName, seen).distinct()
    for path in events:
        table = read_events(spark, path)
        touched = table.select("id", "dt_date").join(theirs, "id", "left_semi")
        rewrite(table, path, touched, lambda rows: rows.join(theirs, "id", "left_anti").select(*rows.columns))
    for path in pageviews:
        table = read_pageviews(spark, path)
        touched = table.select("email", "dt_date").join(people, "email", "left_semi")
        rewrite(table, path, touched, lambda rows: erase_pageviews(rows, people))
