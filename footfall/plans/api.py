"""The public query functions: count, recent, top over one dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame

from footfall.operators import aggregates, ranking
from footfall.operators.filters import all_of, in_time_range, read_filters
from footfall.plans.ranges import range_of

# Function names; "-all" leaves the date range out.
FUNCTIONS = ("count", "count-all", "recent", "recent-all", "top", "top-all")


def ask(pageviews: DataFrame, function: str, dimension: str, start: int, end: int, filters: str = "") -> DataFrame:
    """Rows of one of the public functions for a dimension and a filter text.

    Date words of the filter text count back from `end` and take the place of the range.
    """
    if function not in FUNCTIONS:
        raise ValueError(f"function {function} is not one of {', '.join(FUNCTIONS)}")
    asked = read_filters(filters)
    if asked.dates:
        start, end = range_of(asked.dates, end)
    rows = pageviews.where(all_of(asked.predicates()))
    if not function.endswith("-all"):
        rows = in_time_range(rows, start, end)
    kind = function.removesuffix("-all")
    if kind == "count":
        return aggregates.count_records(rows, dimension)
    if kind == "recent":
        return ranking.recent_rows(rows, dimension, limit=asked.limit, offset=asked.offset)
    return aggregates.top(rows, [dimension], limit=asked.limit, offset=asked.offset, share=False)
