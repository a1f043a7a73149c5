"""Row predicates: the fifteen comparison operators, filter text, time ranges."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from html.entities import codepoint2name
from urllib.parse import quote_plus

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.schema import ADDRESS_COLUMNS, COLUMN_KIND, EMPTY_ADDRESS, LIST_LIMIT, MULTIVALUE
from footfall.sources.tables import day_range, first_day

# Operator names.
OPERATORS = (
    "equals",
    "is_not_equal_to",
    "contains",
    "includes_in_set",
    "included_in_set",
    "does_not_contain",
    "starts_with",
    "ends_with",
    "sounds_like",
    "is_empty",
    "is_not_empty",
    "is_greater_than",
    "is_less_than",
    "between",
    "matches",
    "does_not_match",
)

# Names in filter text that set dates or paging, not columns.
DATE_WORDS = ("strtotime", "minute", "hour", "day", "month", "year")
PAGING_WORDS = ("limit_results", "start_from")

# A value list operator stands in for equality on columns with several values.
_MULTIVALUE_SWAP = {"equals": "contains", "is_not_equal_to": "does_not_contain"}


def kind_of(column: str) -> str:
    return COLUMN_KIND.get(column, "varchar")


def is_blank(column: str) -> Column:
    """Empty by kind: NULL text, number 0, address 0.0.0.0."""
    c = F.col(column)
    if column in ADDRESS_COLUMNS:
        return c == EMPTY_ADDRESS
    return c.isNull() if kind_of(column) == "varchar" else c == 0


def not_blank(column: str) -> Column:
    c = F.col(column)
    if column in ADDRESS_COLUMNS:
        return c != EMPTY_ADDRESS
    return c.isNotNull() if kind_of(column) == "varchar" else c != 0


def reported(column: str) -> Column:
    """What a report on `column` leaves out: NULL text or number 0."""
    c = F.col(column)
    return c.isNotNull() if kind_of(column) == "varchar" else c != 0


def escape_entities(value: str) -> str:
    """Text as it is stored: named entities, and `&#039;` for a quote."""
    names = (codepoint2name.get(ord(ch)) for ch in value)
    return "".join(f"&{n};" if n else ch for ch, n in zip(value, names)).replace("'", "&#039;")


def _typed(column: str, value: str) -> Column:
    return F.lit(value) if kind_of(column) == "varchar" else F.lit(value).try_cast("bigint")


def predicate(column: str, operator: str, value: str = "", exact_members: bool = False) -> Column:
    """One comparison; an unknown operator compares for equality.

    Columns with several values are searched instead of compared; with
    `exact_members` a whole member has to be equal.
    """
    if column in MULTIVALUE and operator in _MULTIVALUE_SWAP:
        if exact_members:
            has = F.array_contains(members(column), value)
            return has if operator == "equals" else ~has
        operator = _MULTIVALUE_SWAP[operator]
    if column == "resource":
        value = "/".join(quote_plus(part, safe="").replace("~", "%7E") for part in value.split("/"))
    value = escape_entities(value)
    c = F.col(column)
    text = c.cast("string")
    tests = {
        "is_not_equal_to": lambda: c != _typed(column, value),
        "contains": lambda: text.like(f"%{value}%"),
        "includes_in_set": lambda: F.find_in_set(text, F.lit(value)) > 0,
        "included_in_set": lambda: F.find_in_set(text, F.lit(value)) > 0,
        "does_not_contain": lambda: ~text.like(f"%{value}%"),
        "starts_with": lambda: text.like(f"{value}%"),
        "ends_with": lambda: text.like(f"%{value}"),
        "sounds_like": lambda: F.soundex(text) == F.soundex(F.lit(value)),
        "is_empty": lambda: is_blank(column),
        "is_not_empty": lambda: not_blank(column),
        "is_greater_than": lambda: c > _typed(column, value),
        "is_less_than": lambda: c < _typed(column, value),
        "between": lambda: c.between(*[int(float(v)) for v in value.split(",")[:2]]),
        "matches": lambda: text.rlike(f"(?i){value}"),
        "does_not_match": lambda: ~text.rlike(f"(?i){value}"),
    }
    return tests.get(operator, lambda: c == _typed(column, value))()


def members(column: str) -> Column:
    """The single values of a column that holds several."""
    if column == "notes":
        return F.regexp_extract_all(F.col(column), F.lit(r"\[([^\]]+)\]"), F.lit(1))
    delimiter = MULTIVALUE[column]
    return F.filter(F.transform(F.split(F.col(column), delimiter), F.trim), lambda v: v != "")


def all_of(predicates: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, predicates, F.lit(True))


@dataclass
class Filters:
    """Filter text taken apart."""

    columns: list[tuple[str, str, str]] = field(default_factory=list)
    dates: dict[str, tuple[str, str]] = field(default_factory=dict)
    limit: int = LIST_LIMIT
    offset: int = 0

    def predicates(self) -> list[Column]:
        return [predicate(c, o, v) for c, o, v in self.columns if not c.startswith("addon_")]


def read_filters(text: str) -> Filters:
    """`browser equals Firefox&&&country contains gb` as a `Filters`.

    Unknown columns and empty values are left out; date words and paging are
    kept apart from the column tests.
    """
    out = Filters()
    for part in (p.strip() for p in text.split("&&&")):
        name, _, rest = part.partition(" ")
        operator, _, value = rest.partition(" ")
        value = value.strip()
        if name in PAGING_WORDS:
            if value.isdigit():
                setattr(out, "limit" if name == "limit_results" else "offset", int(value))
        elif name in DATE_WORDS or name.startswith("interval"):
            out.dates[name] = (operator, value)
        elif name in COLUMN_KIND and (value or operator in ("is_empty", "is_not_empty")):
            out.columns.append((name, operator, value))
    return out


def apply_filters(df: DataFrame, text: str) -> DataFrame:
    """The rows that pass every column test of the filter text."""
    return df.where(all_of(read_filters(text).predicates()))


def in_time_range(df: DataFrame, start: int, end: int) -> DataFrame:
    """Rows with dt in [start, end]; prunes day partitions when there are any."""
    rows = df.where(F.col("dt").between(start, end))
    return rows.where(day_range(start, end)) if "dt_date" in df.columns else rows


def since(df: DataFrame, start: int, end: int | None = None) -> DataFrame:
    """Rows with dt from `start` on (and up to `end`); prunes day partitions when there are any."""
    if end is not None:
        return in_time_range(df, start, end)
    rows = df.where(F.col("dt") >= start)
    return rows.where(F.col("dt_date") >= first_day(start)) if "dt_date" in df.columns else rows


def only_author(df: DataFrame, user: str) -> DataFrame:
    return df.where(predicate("author", "equals", user))


def in_list(column: str, values, negate: bool = False) -> Column:
    """IN / NOT IN over a list or comma text; empty members are dropped."""
    items = values.split(",") if isinstance(values, str) else list(values)
    items = [i.strip() if isinstance(i, str) else i for i in items]
    items = [i for i in items if i not in ("", "0", 0, None, False)]
    c = F.col(column)
    if len(items) == 1:
        return c != F.lit(items[0]) if negate else c == F.lit(items[0])
    return ~c.isin(items) if negate else c.isin(items)


def in_days(column: str, first: str, last: str) -> Column:
    """Day range; a ten-character date covers its whole day."""
    low = F.lit(f"{first} 00:00:00" if len(first) == 10 else first).cast("timestamp")
    high = F.lit(f"{last} 23:59:59" if len(last) == 10 else last).cast("timestamp")
    if column in ("dt", "dt_out"):
        return F.col(column).between(F.unix_timestamp(low), F.unix_timestamp(high))
    return F.col(column).between(low, high)
