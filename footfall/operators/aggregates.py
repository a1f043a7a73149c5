"""Counts, top lists and per-visit aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.operators.filters import members, reported
from footfall.schema import COLUMN_KIND, LIST_LIMIT


def ratio(part: Column, whole: Column, scale: int = 1) -> Column:
    """`scale * part / whole` with two decimals, half up, in whole-number arithmetic; 0 for nothing."""
    cents = F.call_function("div", part * (200 * scale) + whole, whole * 2)
    return F.when(whole > 0, cents / F.lit(100.0)).otherwise(F.lit(0.0))


def percent(part: Column, whole: Column) -> Column:
    return ratio(part, whole, 100)


def count_records(df: DataFrame, column: str = "id", where: Column | None = None, approximate: bool = False) -> DataFrame:
    """One row `counthits`: rows, or distinct values of another column."""
    rows = df if where is None else df.where(where)
    if column == "id":
        counted = F.count("id")
    else:
        counted = F.approx_count_distinct(column) if approximate else F.count_distinct(column)
    return rows.agg(counted.alias("counthits"))


def count_groups(df: DataFrame, column: str, having: Column, where: Column | None = None) -> DataFrame:
    """One row `counthits`: groups of `column` whose aggregate passes `having`."""
    rows = df if where is None else df.where(where)
    groups = rows.where(reported(column)).groupBy(column).agg(having.alias("keep"))
    return groups.agg(F.count_if("keep").alias("counthits"))


def top(
    df: DataFrame,
    keys: dict[str, Column] | list[str],
    where: Column | None = None,
    having: Column | None = None,
    more: dict[str, Column] | None = None,
    recent: bool = False,
    limit: int | None = LIST_LIMIT,
    offset: int = 0,
    share: bool = True,
) -> DataFrame:
    """Most frequent values of one key, several keys or computed keys.

    Ordered by count, or by last use when `recent`; the keys break ties. The
    NULL group stays. `share` adds the percentage of all rows of `df`.
    """
    named = keys if isinstance(keys, dict) else {k: F.col(k) for k in keys}
    measures = {"counthits": F.count("*")}
    if recent:
        measures["dt"] = F.max("dt")
    measures.update(more or {})
    if having is not None:
        measures["_keep"] = having
    measured = [c.alias(n) for n, c in measures.items()]
    if share and not more:
        # rows outside `where` are one more group, so that the groups add up to all rows: both uses share one exchange
        fits = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
        keyed = df.groupBy(*[F.when(fits, c).alias(n) for n, c in named.items()], fits.alias("_fits"))
        groups = keyed.agg(*measured, F.min(fits).alias("_in"))  # as a measure, so that only one of both uses isn't filtered before
        total = _summed(groups, [*list(measures)[1:], "_in"]).scalar()
        out = groups.where("_in").drop("_fits", "_in")
    else:
        total = df.agg(F.count("*").alias("n")).scalar() if share else None
        out = (df if where is None else df.where(where)).groupBy(*[c.alias(n) for n, c in named.items()]).agg(*measured)
    if having is not None:
        out = out.where("_keep").drop("_keep")
    out = ranked(out, "dt" if recent else "counthits", list(named), limit, offset)
    return out.withColumn("pct", percent(F.col("counthits"), total)) if share else out


def _summed(groups: DataFrame, others: list[str]) -> DataFrame:
    """All rows of the groups. The other measures are asked for as well: without them the groups would be counted a second time, as another plan."""
    total = F.coalesce(F.sum("counthits"), F.lit(0))
    for c in others:
        total = F.when(F.count(c) >= 0, total)
    return groups.agg(total.alias("n"))


def ranked(
    df: DataFrame, measure: str, keys: list[str], limit: int | None = LIST_LIMIT, offset: int = 0
) -> DataFrame:
    """Rows by a measure, largest first, with the keys as tie-break."""
    order = [F.col(measure).desc_nulls_last(), *[F.col(k).asc_nulls_first() for k in keys if k != measure]]
    out = df.orderBy(*order)
    out = out.offset(offset) if offset else out
    return out if limit is None else out.limit(limit)


def companions(df: DataFrame, group_by: str, column: str, limit: int = LIST_LIMIT) -> DataFrame:
    """Per key: row count and its distinct companions as sorted `;;;` text.

    The busiest keys are found first by a plain count; only for those are the
    companions gathered, after the pairs have been reduced to distinct ones.
    """
    known = df.where(F.col(group_by).isNotNull())
    busiest = ranked(known.groupBy(group_by).agg(F.count("*").alias("counthits")), "counthits", [group_by], limit)
    pairs = known.where(F.col(column).isNotNull()).select(group_by, column)
    pairs = pairs.join(busiest.select(group_by), group_by, "left_semi").distinct()
    lists = pairs.groupBy(group_by).agg(
        F.array_join(F.sort_array(F.collect_list(column)), ";;;").alias("column_group")
    )
    out = busiest.join(lists, group_by, "left").select(group_by, "counthits", "column_group")
    return ranked(out, "counthits", [group_by], limit)


def bouncing_pages(df: DataFrame) -> DataFrame:
    """How many pages (404 aside) have exactly one hit inside a visit."""
    where = (F.col("visit_id") > 0) & (F.col("content_type") != "404")
    return count_groups(df, "resource", F.count("visit_id") == 1, where)


def edge_per_visit(df: DataFrame, last: bool) -> DataFrame:
    """First or last page view of every visit, by id, in one aggregate."""
    pick, pick_id = (F.max_by, F.max) if last else (F.min_by, F.min)
    visits = df.where(F.col("visit_id") != 0).groupBy("visit_id")
    return visits.agg(pick("resource", "id").alias("resource"), pick_id("id").alias("edge_id"))


def edge_pages(df: DataFrame, last: bool, limit: int = LIST_LIMIT) -> DataFrame:
    """Top entry (or exit) pages: visits that begin (or end) there."""
    sample = (F.max if last else F.min)("edge_id").alias("sample_id")
    pages = edge_per_visit(df, last).groupBy("resource").agg(F.count("*").alias("counthits"), sample)
    return ranked(pages, "counthits", ["resource"], limit)


def exit_pages_count(df: DataFrame) -> DataFrame:
    """Number of distinct pages on which some visit ends."""
    exits = edge_per_visit(df.where(F.col("resource").isNotNull()), last=True)
    return exits.agg(F.count_distinct("resource").alias("counthits"))


def pages_per_visit(df: DataFrame) -> DataFrame:
    per = df.where(F.col("visit_id") > 0).groupBy("visit_id").agg(F.count("ip").alias("hits"))
    return per.agg(
        ratio(F.sum("hits"), F.count("*")).alias("avghits"),
        F.max("hits").alias("maxhits"),
    )


def oldest_row(df: DataFrame) -> DataFrame:
    return df.agg(F.min("dt").alias("dt"))


def outbound_links(df: DataFrame) -> DataFrame:
    """One row per outbound link of every page view: url, time."""
    when_left = F.when(F.col("dt_out") > 0, F.col("dt_out")).otherwise(F.col("dt"))
    rows = df.where("outbound_resource IS NOT NULL AND outbound_resource <> ''")
    links = rows.select(F.explode(F.split("outbound_resource", ";;;")).alias("outbound_resource"), when_left.alias("dt"))
    return links.where("outbound_resource <> ''")


def outbound(df: DataFrame, recent: bool = False, limit: int = LIST_LIMIT) -> DataFrame:
    """Outbound links by count (then time), or by last use."""
    links = outbound_links(df).groupBy("outbound_resource").agg(F.count("*").alias("counthits"), F.max("dt").alias("dt"))
    order = ["dt"] if recent else ["counthits", "dt"]
    return links.orderBy(*[F.desc(c) for c in order], F.asc("outbound_resource")).limit(limit)


def filter_options(df: DataFrame, column: str, limit: int = 500) -> DataFrame:
    """Distinct non-empty values for a pick list, case-blind, ascending."""
    c = F.col(column)
    if COLUMN_KIND.get(column) != "varchar":
        values = df.where(c.isNotNull() & (c != 0)).select(c.cast("string").alias("value"))
    elif column in ("notes", "category", "outbound_resource"):
        values = df.where(c != "").select(F.explode(members(column)).alias("value"))
    else:
        values = df.where(c.isNotNull()).select(F.trim(c).alias("value"))
    distinct = values.where("value <> ''").groupBy(F.lower("value").alias("folded")).agg(F.min("value").alias("value"))
    return distinct.select("value").orderBy("value").limit(limit)


def world_map(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Page views by country with their share of all; the list of countries is whole."""
    return top(df, ["country"], F.col("country").isNotNull(), limit=limit)


def located_hits(df: DataFrame, limit: int = 50) -> DataFrame:
    """The newest hits with a place, its text split into latitude and longitude."""
    rows = df.where("city IS NOT NULL AND location IS NOT NULL AND location <> ''")
    parts = F.split("location", ",")
    return (
        rows.select(
            "id",
            "city",
            F.get(parts, F.lit(0)).try_cast("double").alias("lat"),
            F.get(parts, F.lit(1)).try_cast("double").alias("lon"),
            "dt",
        )
        .orderBy(F.desc("dt"), F.desc("id"))
        .limit(limit)
    )
