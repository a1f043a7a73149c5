"""Tags, lists and other delimited text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from footfall.schema import TEXT_LIMIT

DOWNLOAD_EXTENSIONS = ("pdf", "doc", "xls", "zip")  # fixed values


def as_column(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def blank_to_null(column) -> Column:
    return F.nullif(as_column(column), F.lit(""))


def language_family(language) -> Column:
    return F.substring(as_column(language), 1, 2)


def os_family(platform) -> Column:
    return F.concat(F.lit("p-"), F.substring(as_column(platform), 1, 3))


def first_language(accepted) -> Column:
    """`en_GB,fr;q=0.8` -> `en-gb`."""
    head = F.regexp_extract(as_column(accepted), "^([^,;]*)", 1)
    return F.translate(F.lower(head), "_", "-")


def parse_notes(notes) -> Column:
    """`[a][b]` -> array(a, b)."""
    return F.regexp_extract_all(as_column(notes), F.lit(r"\[([^\]]+)\]"), F.lit(1))


def join_notes(tags) -> Column:
    """array(a, b) -> `[a][b]`, NULL for no tags."""
    tags = as_column(tags)
    return F.when(F.size(tags) > 0, F.concat(F.lit("["), F.array_join(tags, "]["), F.lit("]")))


def append_note(notes, tag) -> Column:
    """Add `[tag]` unless the text already holds it."""
    before = F.coalesce(as_column(notes), F.lit(""))
    tag = as_column(tag)
    return F.when(F.contains(before, tag), before).otherwise(F.concat(before, tag))


def append_link(links, url, limit: int = TEXT_LIMIT) -> Column:
    """Add a URL behind `;;;`; links that would pass the limit are left out."""
    links, url = as_column(links), as_column(url)
    have = F.coalesce(F.octet_length(links), F.lit(0)) > 0
    fits = F.octet_length(links) + F.octet_length(url) + 3 <= limit
    return F.when(~have, url).when(fits, F.concat(links, F.lit(";;;"), url)).otherwise(links)


def split_values(column, delimiter: str) -> Column:
    """Delimited text as an array without empty members."""
    return F.filter(F.split(as_column(column), re.escape(delimiter)), lambda v: v != "")


def result_count(notes) -> Column:
    """The number in a `results:n` tag, NULL without one."""
    return F.nullif(F.regexp_extract(as_column(notes), r"results:(\d+)", 1), F.lit("")).cast("bigint")


def login_names(notes, tag: str) -> Column:
    """Names behind `loggedin:` or `loggedout:` tags."""
    picked = F.filter(parse_notes(notes), lambda t: F.startswith(t, F.lit(tag)))
    return F.transform(picked, lambda t: F.substring(t, len(tag) + 1, 2**30))


def clean_fingerprint(column) -> Column:
    return F.substring(F.regexp_replace(as_column(column), "[^a-zA-Z0-9_-]", ""), 1, 256)


def click_position(column) -> Column:
    """`x,y` with one to five digits each, else empty."""
    text = F.trim(as_column(column))
    return F.when(text.rlike(r"^[0-9]{1,5},[0-9]{1,5}$"), text).otherwise(F.lit(""))


def recover_position(position, width) -> Column:
    """Put the lost comma back where exactly one split is plausible.

    Both parts are free of leading zeros and at most 99999, x is not right of
    the screen and y at most ten screens down.
    """
    digits, width = as_column(position), as_column(width)
    size = F.length(digits)

    def cut(i: Column) -> Column:
        return F.struct(F.substr(digits, F.lit(1), i).alias("x"), F.substr(digits, i + 1).alias("y"))

    def tidy(part: Column) -> Column:
        return part.rlike("^(0|[1-9][0-9]{0,4})$")

    def plausible(s: Column) -> Column:
        x, y = s["x"].try_cast("int"), s["y"].try_cast("int")
        return tidy(s["x"]) & tidy(s["y"]) & (x <= width) & (y <= width * 10)

    splits = F.filter(F.transform(F.sequence(F.lit(1), size - 1), cut), plausible)
    one = F.when(
        F.size(splits) == 1, F.concat_ws(",", F.element_at(splits, 1)["x"], F.element_at(splits, 1)["y"])
    )
    return F.when(digits.rlike("^[0-9]+$") & (size >= 2) & (width > 0), one)


def viewport(width, height) -> Column:
    return F.when(blank_to_null(width).isNotNull(), F.concat(F.trim(as_column(width)), F.lit("x"), F.trim(as_column(height))))


def milliseconds(column) -> Column:
    """A client timing kept only inside 1..59999, else 0."""
    value = as_column(column).try_cast("bigint")
    return F.when(value.between(1, 59999), value).otherwise(F.lit(0).cast("bigint"))


def wildcard_pattern(spec: str) -> str:
    """A comma list with `*` (any text) and `!` (one character) as one expression."""
    marks = {"*": ".*", "!": "."}
    items = [i.strip() for i in spec.split(",") if i.strip()]
    bodies = ["".join(marks.get(ch, re.escape(ch)) for ch in item) for item in items]
    return "(?i)^(" + "|".join(bodies) + ")$" if bodies else "$.^"


def matches_wildcard(column, spec: str) -> Column:
    return as_column(column).rlike(wildcard_pattern(spec))


def fold_case(column, accents: bool = False) -> Column:
    """Text that compares without case (and, if asked, without accents)."""
    return F.collate(as_column(column), "UNICODE_CI_AI" if accents else "UTF8_LCASE")


def greatest_or_null(*columns) -> Column:
    """GREATEST that is NULL as soon as one argument is."""
    cols = [as_column(c) for c in columns]
    known = cols[0].isNotNull()
    for c in cols[1:]:
        known = known & c.isNotNull()
    return F.when(known, F.greatest(*cols))


def download_type(path) -> Column:
    extension = F.regexp_extract(as_column(path), r"\.([^./]+)$", 1)
    return F.when(extension.isin(*DOWNLOAD_EXTENSIONS), F.lit("download"))
