"""URLs, referrers and search words."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.functions.text import as_column

# Parameters that usually hold search words, in order.
SEARCH_PARAMETERS = ["ask", "k", "q", "qs", "qt", "query", "s", "string"]


def country_endings() -> list[str]:
    """Country parts a host name may carry: the ISO 3166 codes the platform knows."""
    codes = SparkSession.active()._jvm.java.util.Locale.getISOCountries()
    return sorted(code.lower() for code in codes)


def referrer_domain(referer) -> Column:
    """Host of a referrer, at most five labels, without `www.`."""
    after_scheme = F.substring_index(as_column(referer), "://", -1)
    host = F.substring_index(after_scheme, "/", 1)
    return F.replace(F.substring_index(host, ".", -5), F.lit("www."), F.lit(""))


def trim_slash(resource) -> Column:
    return F.rtrim(as_column(resource), F.lit("/"))


def strip_query(resource, mark: str = "?") -> Column:
    return F.substring_index(as_column(resource), mark, 1)


def url_part(url, part: str, key: str | None = None) -> Column:
    args = [as_column(url), F.lit(part)] + ([F.lit(key)] if key else [])
    return F.try_parse_url(*args)


def outside_host(host, own_hosts: list[str]) -> Column:
    """True when a host, without port, case and `www.`, is not one of ours."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(as_column(host)), r":\d+$", ""), r"^www\.", "")
    return ~bare.isin(*own_hosts)


def percent_encode_non_ascii(column) -> Column:
    """Every byte outside printable ASCII as `%` and two hex digits.

    The latin-1 reading of the UTF-8 bytes has one character per byte, so the
    work stays on strings: each character outside the range is looked up.
    """
    text = as_column(column)
    pieces = F.regexp_extract_all(text, F.lit(r"[\x20-\x7E]+|[^\x20-\x7E]+"), F.lit(0))
    coded = F.transform(
        pieces,
        lambda p: F.when(p.rlike(r"^[\x20-\x7E]"), p).otherwise(
            F.regexp_replace(F.lower(F.hex(F.encode(p, "UTF-8"))), "(..)", "%$1")
        ),
    )
    return F.when(text.rlike(r"[^\x20-\x7E]"), F.array_join(coded, "")).otherwise(text)


def normalise_resource(raw, limit: int = 2048) -> Column:
    """Stored path of a hit: decoded, non-ASCII bytes coded, `path?query#fragment`."""
    text = as_column(raw)
    decoded = percent_encode_non_ascii(F.coalesce(F.try_url_decode(text), text))
    path = F.regexp_extract(decoded, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    query = F.regexp_extract(decoded, r"^[^?#]*(\?[^#]+)", 1)
    fragment = F.regexp_extract(decoded, r"^[^#]*(#.+)$", 1)
    return F.substring(F.concat(path, query, fragment), 1, limit)


def lossy_host(host, endings: list[str] | None = None) -> Column:
    """Host as a dictionary key: no `www`/`search`/`m` label, country part as `{}`."""
    country = "(" + "|".join(endings or country_endings()) + ")"
    out = F.regexp_replace(as_column(host), r"^(w+\d*|search)\.", "")
    out = F.regexp_replace(out, r"(^|\.)m\.", "$1")
    out = F.regexp_replace(out, r"(\.(com|org|net|co|it|edu))?\." + country + r"(/|$)", ".{}$4")
    return F.regexp_replace(out, r"(^|\.)" + country + r"\.", "$1{}.")


def query_value(url, key: str) -> Column:
    """A decoded query parameter, NULL when missing or empty."""
    raw = F.nullif(url_part(url, "QUERY", key), F.lit(""))
    return F.coalesce(F.try_url_decode(raw), raw)


def search_words(referer, parameters: list[str] | None = None) -> Column:
    """Search words in a referrer by the first parameter that holds any; a URL is parsed for those that it names."""

    def value(key: str) -> Column:
        found = query_value(referer, key)  # other keys are patterns to the parser
        return F.when(F.contains(as_column(referer), F.lit(f"{key}=")), found) if re.fullmatch(r"\w+", key) else found

    return F.trim(F.coalesce(*[value(k) for k in parameters or SEARCH_PARAMETERS]))


def search_rank(referer) -> Column:
    return query_value(referer, "cd")


def search_source(referer) -> Column:
    return query_value(referer, "source")


def search_words_by_engine(hits: DataFrame, engines: DataFrame, referer: str = "referer") -> DataFrame:
    """Add `engine` and `searchterms` from a table (host_key, engine, parameters).

    `engines` has one row per host key; `parameters` is the array of its query
    keys. Hosts without an entry use the general list.
    """
    keyed = hits.withColumn("host_key", lossy_host(url_part(referer, "HOST")))
    joined = keyed.join(engines, "host_key", "left")
    found = F.filter(
        F.transform("parameters", lambda p: F.try_parse_url(F.col(referer), F.lit("QUERY"), p)), lambda v: v != ""
    )
    by_engine = F.get(found, F.lit(0))
    words = F.when(
        F.col("parameters").isNotNull(), F.trim(F.coalesce(F.try_url_decode(by_engine), by_engine))
    ).otherwise(search_words(referer))
    return joined.withColumn("searchterms", words).drop("host_key", "parameters")
