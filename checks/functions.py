"""Column functions on the columns of the page views."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from checks.aggregates import DOMAIN_SQL
from checks.base import check, events, pv, sql
from checks.joins import SEARCH_URL
from footfall.functions import addresses, agents, hashes, text, times, urls
from footfall.schema import HASH_LENGTH

SECRET = "a shared secret"


def _register(name: str, columns: str, values: dict[str, tuple], prepare: dict[str, str] | None = None) -> None:
    """A query of id and computed columns: values maps a name to (Column maker, SQL).

    `prepare` holds input columns both engines compute from the same text.
    """
    inputs = prepare or {}
    prepared = "".join(f", {e} AS {n}" for n, e in inputs.items())
    selected = ", ".join(f"{s} AS {n}" for n, (_, s) in values.items())

    @check(name, sql(f"SELECT id, {selected} FROM (SELECT *{prepared} FROM pageviews) AS r"))
    def query(spark, sf_dir):
        rows = pv(spark, sf_dir, f"id {columns}").selectExpr("*", *[f"{e} AS {n}" for n, e in inputs.items()])
        return rows.select("id", *[make().alias(n) for n, (make, _) in values.items()])


_register("fn_domain", "referer", {"domain": (lambda: urls.referrer_domain("referer"), DOMAIN_SQL)})
_register("fn_lang_family", "language", {"family": (lambda: text.language_family("language"), "substring(language, 1, 2)")})
_register("fn_os_family", "platform", {"family": (lambda: text.os_family("platform"), "concat('p-', substring(platform, 1, 3))")})
_register(
    "fn_trim_slash", "resource", {"path": (lambda: urls.trim_slash("slashed"), "rtrim(slashed, '/')")},
    {"slashed": "resource || CASE id % 3 WHEN 0 THEN '//' WHEN 1 THEN '/' ELSE '' END"},
)
_register("fn_strip_query", "resource", {"path": (lambda: urls.strip_query("resource"), "split_part(resource, '?', 1)")})
_register(
    "fn_host",
    "referer",
    {
        "host": (lambda: urls.url_part("referer", "HOST"), "regexp_extract(referer, '^[a-z]+://([^/?#]+)', 1)"),
        "path": (lambda: urls.url_part("referer", "PATH"), "regexp_extract(referer, '^[a-z]+://[^/?#]+([^?#]*)', 1)"),
        "query": (lambda: urls.url_part("referer", "QUERY"), "nullif(regexp_extract(referer, '[?]([^#]*)', 1), '')"),
        "fragment": (lambda: urls.url_part("referer", "REF"), "nullif(regexp_extract(referer, '#(.*)$', 1), '')"),
    },
)
_register(
    "fn_resource_normalize",
    "resource",
    {"path": (lambda: urls.normalise_resource("raw"), "concat('/caf%c3%a9 ', id % 7, '/x?q=a b#top')")},
    {"raw": "concat('https://example.com/caf%C3%A9+', id % 7, '/x?q=a%20b#top')"},
)
# The countries that occur in the hosts below.
_ENDINGS = ["de", "fr", "jp"]
_COUNTRY = "(" + "|".join(_ENDINGS) + ")"
_HOST = (
    "concat(CASE id % 5 WHEN 0 THEN 'www.' WHEN 1 THEN 'search.' WHEN 2 THEN 'm.' WHEN 3 THEN 'fr.' ELSE '' END, "
    "'finder', CASE id % 4 WHEN 0 THEN '.com' WHEN 1 THEN '.co.jp' WHEN 2 THEN '.de' ELSE '.org' END)"
)


def lossy_sql(host: str) -> str:
    bare = f"regexp_replace(regexp_replace({host}, '^(w+\\d*|search)\\.', ''), '(^|\\.)m\\.', '\\1', 'g')"
    ended = f"regexp_replace({bare}, '(\\.(com|org|net|co|it|edu))?\\.{_COUNTRY}(/|$)', '.{{}}\\4', 'g')"
    return f"regexp_replace({ended}, '(^|\\.){_COUNTRY}\\.', '\\1{{}}.', 'g')"


_register(
    "fn_lossy_host",
    "referer",
    {
        "own": (lambda: urls.lossy_host("host", _ENDINGS), lossy_sql("host")),
        "seen": (
            lambda: urls.lossy_host(urls.url_part("referer", "HOST"), _ENDINGS),
            lossy_sql("regexp_extract(referer, '^[a-z]+://([^/?#]+)', 1)"),
        ),
    },
    {"host": _HOST},
)
_register(
    "fn_search_terms",
    "resource",
    {"words": (lambda: urls.search_words("link"), "CASE WHEN id % 4 = 3 THEN concat('red shoe ', id % 50) END")},
    {"link": SEARCH_URL},
)
_register(
    "fn_serp_detail",
    "resource",
    {
        "rank": (lambda: urls.search_rank("link"), "CAST(id % 9 AS VARCHAR)"),
        "source": (lambda: urls.search_source("link"), "'web'"),
    },
    {"link": SEARCH_URL},
)
_register(
    "fn_language", "language", {"first": (lambda: text.first_language("accepted"), "language")},
    {"accepted": "concat(upper(replace(language, '-', '_')), ',fr;q=0.8')"},
)
_register(
    "fn_notes_parse", "notes",
    {"tags": (lambda: F.array_join(text.parse_notes("notes"), "|"), "array_to_string(regexp_extract_all(notes, '\\[([^\\]]+)\\]', 1), '|')")},
)
_register(
    "fn_notes_join", "notes",
    {"joined": (lambda: text.join_notes(text.parse_notes("notes")), "notes")},
)
_register(
    "fn_notes_append", "notes",
    {"added": (lambda: text.append_note("notes", F.lit("[new:yes]")),
               "CASE WHEN coalesce(notes, '') LIKE '%[new:yes]%' THEN notes ELSE concat(coalesce(notes, ''), '[new:yes]') END")},
)
_LINK = "concat('https://out.example.net/', repeat('x', CAST(id % 2100 AS INTEGER)))"
_register(
    "fn_outbound_append", "outbound_resource",
    {"links": (lambda: text.append_link("outbound_resource", "link"),
               "CASE WHEN outbound_resource IS NULL OR outbound_resource = '' THEN link "
               "WHEN length(outbound_resource) + length(link) + 3 <= 2048 THEN concat(outbound_resource, ';;;', link) "
               "ELSE outbound_resource END")},
    {"link": _LINK},
)
_register(
    "fn_split_multi", "outbound_resource category",
    {
        "links": (lambda: F.array_join(text.split_values("outbound_resource", ";;;"), " | "),
                  "array_to_string(list_filter(string_split(outbound_resource, ';;;'), lambda v: v <> ''), ' | ')"),
        "terms": (lambda: F.size(text.split_values("category", ",")),
                  "CASE WHEN category IS NULL THEN NULL ELSE len(string_split(category, ',')) END"),
    },
)
_register(
    "fn_results_note", "notes",
    {"found": (lambda: text.result_count("marked"), "CASE WHEN id % 2 = 0 THEN id % 31 END")},
    {"marked": "CASE WHEN id % 2 = 0 THEN concat(coalesce(notes, ''), '[results:', id % 31, ']') ELSE notes END"},
)
_register(
    "fn_login_notes", "notes username",
    {"came": (lambda: F.array_join(text.login_names("marked", "loggedin:"), ","), "coalesce(username, 'guest')"),
     "went": (lambda: F.array_join(text.login_names("marked", "loggedout:"), ","), "concat('u', id % 5)")},
    {"marked": "concat(coalesce(notes, ''), '[loggedin:', coalesce(username, 'guest'), '][loggedout:u', id % 5, ']')"},
)
_register(
    "fn_fingerprint", "fingerprint",
    {"clean": (lambda: text.clean_fingerprint("dirty"), "concat('a-b_', fingerprint)")},
    {"dirty": "concat('<a>-b_. ', fingerprint, '/!')"},
)
_register(
    "fn_client_info", "resolution screen_width server_latency page_performance",
    {
        "viewport": (lambda: text.viewport("bw", "bh"), "resolution"),
        "latency": (lambda: text.milliseconds("sl"), "CASE WHEN server_latency BETWEEN 1 AND 59999 THEN server_latency ELSE 0 END"),
        "performance": (lambda: text.milliseconds("pp"), "CASE WHEN page_performance * 50 BETWEEN 1 AND 59999 THEN page_performance * 50 ELSE 0 END"),
    },
    {
        "bw": "split_part(resolution, 'x', 1)",
        "bh": "split_part(resolution, 'x', 2)",
        "sl": "CAST(server_latency AS STRING)",
        "pp": "CAST(page_performance * 50 AS STRING)",
    },
)
_register(
    "fn_download", "resource",
    {"kind": (lambda: text.download_type("path"), "CASE WHEN resource IS NOT NULL AND id % 4 < 2 THEN 'download' END")},
    {"path": "split_part(resource, '?', 1) || CASE id % 4 WHEN 0 THEN '/a.pdf' WHEN 1 THEN '/b.tar.zip' WHEN 2 THEN '/c.html' ELSE '/d' END"},
)
_register(
    "fn_outbound_host", "referer",
    {"leaves": (lambda: urls.outside_host("host", ["ththre.example.com", "example.com"]),
                "CASE id % 3 WHEN 0 THEN false WHEN 1 THEN false ELSE host NOT IN ('ththre.example.com', 'example.com') END")},
    {"host": "CASE id % 3 WHEN 0 THEN 'WWW.Example.com:8080' WHEN 1 THEN 'ththre.example.com' ELSE regexp_extract(referer, '^[a-z]+://([^/?#]+)', 1) END"},
)
_register(
    "fn_mask_ip", "ip",
    {
        "v4": (lambda: addresses.mask_address("ip"), "regexp_replace(ip, '[.][0-9]+$', '.0')"),
        "v6": (lambda: addresses.mask_address("six"), "concat('2001:db8:', id % 97, '::')"),
    },
    {"six": "concat('2001:db8:', id % 97, ':1:2:3:4:', id % 10)"},
)


def hmac_sql(message: str, secret: str = SECRET) -> str:
    inner, outer = hashes.key_pads(secret)
    first = f"sha256(unhex('{inner}') || encode({message}))"
    return f"sha256(unhex('{outer}') || unhex({first}))"


_DAY_SALT = "strftime(make_timestamp(dt * 1000000), '%Y-%m-%d')"


def _salt() -> Column:
    return F.date_format(times.as_timestamp("dt"), "yyyy-MM-dd")


_register(
    "fn_hash_ip", "ip user_agent dt",
    {"hashed": (lambda: hashes.hash_address("ip", "user_agent", SECRET, _salt()),
                "substring(" + hmac_sql(f"{_DAY_SALT} || '|' || ip || '|' || user_agent") + f", 1, {HASH_LENGTH})")},
)
_register(
    "fn_visitor_hash", "ip user_agent dt",
    {"visitor": (lambda: hashes.visitor_hash("ip", "user_agent", "dt", SECRET),
                 hmac_sql("regexp_replace(ip, '[.][0-9]+$', '.0') || '|' || substring(user_agent, 1, 512) || '|' || strftime(make_timestamp(dt * 1000000), '%Y%m%d')"))},
)
_register(
    "anonymous_visit_id", "ip user_agent fingerprint dt",
    {"visit": (
        lambda: hashes.anonymous_visit_id("fp", "ip", "user_agent", "dt", SECRET, _salt()),
        "CAST(concat('0x', substring(CASE WHEN fp <> '' THEN "
        + hmac_sql(f"{_DAY_SALT} || '|' || fp")
        + " ELSE "
        + hmac_sql(f"{_DAY_SALT} || '|' || ip || '|' || user_agent || '|' || (dt // 300 * 300)")
        + " END, 1, 8)) AS BIGINT)",
    )},
    {"fp": "CASE WHEN id % 2 = 0 THEN fingerprint ELSE '' END"},
)
_NUMBER = (
    "(CAST(split_part(ip, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(ip, '.', 2) AS BIGINT) * 65536 "
    "+ CAST(split_part(ip, '.', 3) AS BIGINT) * 256 + CAST(split_part(ip, '.', 4) AS BIGINT))"
)
_register(
    "fn_cidr_match", "ip",
    {
        "v4": (lambda: addresses.in_ranges("ip", ["10.3.0.0/16", "10.1.64.0/18", "10.5.5.2"]),
               f"{_NUMBER} BETWEEN 167968768 AND 168034303 OR {_NUMBER} BETWEEN 167854080 AND 167870463 OR ip = '10.5.5.2'"),
        "v6": (lambda: addresses.in_ranges("six", ["2001:db8:4::/46"]), "id % 10 BETWEEN 4 AND 7"),
    },
    {"six": "concat('2001:db8:', id % 10, '::', id % 97)"},
)
_register(
    "fn_private_ip", "ip",
    {"private": (lambda: addresses.is_private("address"), "id % 12 < 9")},
    {"address": "CASE id % 12 WHEN 0 THEN ip WHEN 1 THEN '192.168.7.7' WHEN 2 THEN '172.31.0.1' WHEN 3 THEN '127.0.0.1' WHEN 4 THEN '169.254.1.1' "
     "WHEN 5 THEN 'fc00::1' WHEN 6 THEN 'fe80::1' WHEN 7 THEN '::1' WHEN 8 THEN 'nobody' WHEN 9 THEN concat('8.8.', id % 100, '.8') "
     "WHEN 10 THEN concat('2a00:1450::', id % 100) ELSE '2607:f8b0:4005:805:0:0:0:200e' END"},
)
_register(
    "fn_wildcard", "resource",
    {"listed": (lambda: text.matches_wildcard("resource", "/EN/*, /fr/!!!, /de/*page=2"),
                "regexp_matches(resource, '(?i)^(/en/.*|/fr/...|/de/.*page=2)$')")},
)
# Which of the test agents are crawlers by their words (or say nothing at all).
_BOTS = "(4, 5, 6, 12)"


@check("fn_bot_flag", sql(f"SELECT id, (page_performance // 20) % 13 IN {_BOTS} AS bot FROM pageviews"))
def fn_bot_flag(spark, sf_dir):
    return agents.flag_bots(pv(spark, sf_dir, "id user_agent")).select("id", "bot")


_register(
    "fn_case_fold", "browser country",
    {"same": (lambda: text.fold_case("mixed") == text.fold_case("browser"), "true"),
     "accents": (lambda: text.fold_case("accented", accents=True) == text.fold_case(F.lit("ete"), accents=True), "true")},
    {"mixed": "CASE WHEN id % 2 = 0 THEN upper(browser) ELSE lower(browser) END", "accented": "CASE WHEN id % 2 = 0 THEN 'été' ELSE 'ÉTÉ' END"},
)
_register(
    "fn_nullif_coalesce", "dt dt_out searchterms country visit_id",
    {
        "words": (lambda: text.blank_to_null("searchterms"), "nullif(searchterms, '')"),
        "place": (lambda: F.coalesce("country", F.lit("unknown")), "coalesce(country, 'unknown')"),
        "seen": (lambda: F.when(F.col("visit_id") > 0, F.lit("visit")).otherwise(F.lit("none")), "CASE WHEN visit_id > 0 THEN 'visit' ELSE 'none' END"),
        "latest": (lambda: text.greatest_or_null("dt", "left_at"), "CASE WHEN left_at IS NOT NULL THEN greatest(dt, left_at) END"),
    },
    {"left_at": "nullif(dt_out, 0)"},
)
_register(
    "fn_epoch_convert", "dt",
    {
        "day": (lambda: F.date_format(times.as_timestamp("dt"), "yyyy-MM-dd HH:mm:ss"), "strftime(make_timestamp(dt * 1000000), '%Y-%m-%d %H:%M:%S')"),
        "weekday": (lambda: F.dayofweek(times.day_of("dt")), "dayofweek(make_timestamp(dt * 1000000)) + 1"),
        "year": (lambda: F.year(times.day_of("dt")), "year(make_timestamp(dt * 1000000))"),
        "before": (lambda: F.date_format(F.date_sub(times.day_of("dt"), 3), "yyyy-MM-dd"), "strftime(CAST(make_timestamp(dt * 1000000) AS DATE) - 3, '%Y-%m-%d')"),
        "back": (lambda: F.unix_timestamp(F.to_date(F.date_format(times.as_timestamp("dt"), "yyyy-MM-dd")).cast("timestamp")), "dt // 86400 * 86400"),
        "moved": (lambda: F.date_format(times.shift_zone("dt", "UTC", "+02:00"), "HH:mm"), "strftime(make_timestamp((dt + 7200) * 1000000), '%H:%M')"),
    },
)


@check(
    "fn_position",
    sql(
        """SELECT event_id, CASE WHEN regexp_matches(trim(position), '^[0-9]{1,5},[0-9]{1,5}$') THEN trim(position) ELSE '' END AS kept
FROM site_events"""
    ),
)
def fn_position(spark, sf_dir):
    return events(spark, sf_dir, "event_id position").select("event_id", text.click_position("position").alias("kept"))


@check(
    "fn_position_recover",
    sql(
        """SELECT d.event_id, CASE WHEN count(x) = 1 THEN max(x || ',' || y) END AS recovered
FROM damaged d LEFT JOIN (
  SELECT event_id, substring(position, 1, i) AS x, substring(position, i + 1) AS y, screen_width AS w
  FROM damaged, generate_series(1, 9) AS g(i) WHERE i < length(position)) s
  ON s.event_id = d.event_id AND regexp_matches(x, '^(0|[1-9][0-9]{0,4})$') AND regexp_matches(y, '^(0|[1-9][0-9]{0,4})$')
  AND CAST(x AS BIGINT) <= w AND CAST(y AS BIGINT) <= 10 * w
GROUP BY d.event_id""",
        """damaged AS (SELECT s.event_id, s.position, p.screen_width FROM site_events s JOIN pageviews p ON p.id = s.id
  WHERE regexp_matches(s.position, '^[0-9]+$') AND p.screen_width > 0)""",
    ),
)
def fn_position_recover(spark, sf_dir):
    from footfall.operators.joins import damaged_positions

    rows = damaged_positions(events(spark, sf_dir, "event_id id position"), pv(spark, sf_dir, "id screen_width"))
    return rows.select("event_id", text.recover_position("position", "screen_width").alias("recovered"))
