"""Sorting, paging, newest rows, unions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.operators.filters import in_time_range
from footfall.schema import LIST_LIMIT

# Columns of the access log.
LOG_COLUMNS = (
    "id ip dt username referer resource browser platform country city content_type notes visit_id server_latency "
    "page_performance browser_version browser_type language fingerprint user_agent resolution screen_width "
    "screen_height category author content_id outbound_resource tz_offset dt_out"
).split()


def sort_keys(spec: str | list[str], direction: str = "DESC", nulls_last: bool = False) -> list[Column]:
    """`a DESC, b` (or a list) as sort expressions; `direction` is the default."""
    items = spec.split(",") if isinstance(spec, str) else spec
    keys = []
    for item in items:
        name, _, way = item.strip().partition(" ")
        descending = (way.strip() or direction).upper() == "DESC"
        c = F.col(name)
        if descending:
            keys.append(c.desc_nulls_last())
        else:
            keys.append(c.asc_nulls_last() if nulls_last else c.asc_nulls_first())
    return keys


def with_tiebreak(spec: str, keys: list[str]) -> list[Column]:
    """Sort expressions plus the group keys that the text does not name yet."""
    named = {item.strip().split(" ")[0] for item in spec.split(",")}
    return sort_keys(spec) + [F.col(k).asc_nulls_first() for k in keys if k not in named]


def page(df: DataFrame, keys: list[Column], size: int, number: int = 1) -> DataFrame:
    """Page `number` (from 1) of an ordered result."""
    return df.orderBy(*keys).offset((number - 1) * size).limit(size)


def last_page(rows: int, size: int) -> int:
    return max(1, -(-rows // size))


def recent_rows(
    df: DataFrame,
    columns: str = "*",
    where: Column | None = None,
    more_columns: str = "",
    as_column: str = "",
    limit: int = LIST_LIMIT,
    offset: int = 0,
) -> DataFrame:
    """Newest rows of chosen columns; time and address are always added."""
    names = list(LOG_COLUMNS) if columns == "*" else [c.strip() for c in columns.split(",")]
    names += [c.strip() for c in more_columns.split(",") if c.strip()]
    names += [c for c in ("dt", "ip") if c not in names]
    rows = df if where is None else df.where(where)
    out = rows.orderBy(F.desc("dt"), F.desc("id")).offset(offset).limit(limit)
    cols = [F.col(n) for n in names]
    if as_column:
        cols[0] = cols[0].alias(as_column)
    return out.select(*cols)


def union_distinct(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out.distinct()


def union_ranges(df: DataFrame, ranges: list[tuple[int, int]]) -> DataFrame:
    """Rows of several date ranges, one after the other, nothing removed.

    One scan of the days between the first and the last serves all ranges: a row is repeated for each range it lies in.
    """
    if not ranges:
        return df.withColumn("range_no", F.lit(0)).where("false")
    df = in_time_range(df, min(s for s, _ in ranges), max(e for _, e in ranges))
    hits = F.array(*[F.when(F.col("dt").between(s, e), F.lit(i)) for i, (s, e) in enumerate(ranges)])
    return df.withColumn("range_no", F.explode(F.array_compact(hits)))
