"""From raw hits to stored rows: cleaning, enrichment, refusal codes, consent."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.functions.addresses import in_ranges, mask_address
from footfall.functions.hashes import hash_address
from footfall.functions.text import (
    append_link,
    append_note,
    as_column,
    blank_to_null,
    clean_fingerprint,
    click_position,
    download_type,
    matches_wildcard,
    milliseconds,
    viewport,
)
from footfall.functions.urls import normalise_resource, outside_host, search_words, url_part
from footfall.operators.joins import in_range_table, latest_visit
from footfall.operators.patterns import in_pattern_table
from footfall.schema import NOTE_LIMIT, SESSION_SECONDS

# Refusal codes in the order in which they are tested.
REJECT_ORDER = [301, 302, 202, 304, 203, 305, 201, 306, 307, 308, 309, 317, 310, 311, 312, 313, 314, 315, 316]

# Schemes a referrer may have.
REFERRER_SCHEMES = ("http", "https", "android-app")

CONTENT_INFO = "content_type STRING, category STRING, content_id BIGINT, author STRING"


@dataclass
class Policy:
    """What the site owner wants kept, refused or hidden."""

    site_host: str = "example.com"
    own_hosts: list[str] = field(default_factory=list)
    ignore_ranges: list[str] = field(default_factory=list)
    ignore_resources: str = ""
    ignore_referers: str = ""
    ignore_content_types: str = ""
    ignore_users: str = ""
    ignore_capabilities: str = ""
    ignore_all_users: bool = False
    ignore_languages: str = ""
    ignore_countries: str = ""
    ignore_browsers: str = ""
    ignore_platforms: str = ""
    ignore_bots: bool = False
    ignore_prefetch: bool = False
    ignore_spammers: bool = False
    own_call: str = "admin-ajax.php"
    keep_own_referers: bool = False
    consent_required: bool = False
    consent_source: str = "banner"  # banner, consent_api, client_only or empty
    banner_enabled: bool = True
    respect_dnt: bool = False
    anonymous: bool = False
    set_cookie: bool = True
    mask: bool = False
    hash: bool = False
    secret: str = "secret"

    @property
    def personal(self) -> bool:
        """True when the settings keep personal data."""
        return self.set_cookie or (not self.mask and not self.hash)


def may_track(policy: Policy, consent, dnt, programmatic=None) -> Column:
    """May a hit be kept at all, from its consent answer and do-not-track flag."""
    programmatic = F.lit(False) if programmatic is None else as_column(programmatic)
    refused = as_column(dnt) if policy.respect_dnt else F.lit(False)
    if not policy.consent_required:
        allowed = F.lit(True)
    elif not policy.consent_source:
        allowed = F.lit(False)
    elif policy.anonymous or not policy.personal or policy.consent_source == "client_only":
        allowed = F.lit(True)
    elif policy.consent_source == "banner" and not policy.banner_enabled:
        allowed = F.lit(True)
    else:
        allowed = programmatic | as_column(consent)
    return F.coalesce(~refused & allowed, F.lit(False))


def may_identify(policy: Policy, consent, dnt, upgrade=None, programmatic=None) -> Column:
    """May a hit carry personal data; `upgrade` marks consent given in this very hit."""
    upgrade = F.lit(False) if upgrade is None else as_column(upgrade)
    programmatic = F.lit(False) if programmatic is None else as_column(programmatic)
    if not policy.consent_required:
        return F.lit(True)
    if not policy.consent_source:
        return F.lit(False)
    refused = as_column(dnt) if policy.respect_dnt else F.lit(False)
    if policy.anonymous:
        allowed = F.when(programmatic, upgrade).otherwise(upgrade | as_column(consent))
    elif not policy.personal or (policy.consent_source == "banner" and not policy.banner_enabled):
        allowed = F.lit(True)
    else:
        allowed = programmatic | as_column(consent)
    return F.coalesce(~refused & allowed, F.lit(False))


def stored_address(df: DataFrame, policy: Policy, identify: Column, salt: Column) -> DataFrame:
    """Replace ip and other_ip by what may be stored: full, masked or hashed.

    Anonymous mode hashes without consent and keeps (or masks) with it. In the
    standard mode a hash beats a mask, and without consent both are forced. A
    hashed row loses other_ip.
    """
    hashed = F.struct(
        hash_address("ip", "user_agent", policy.secret, salt).alias("ip"), F.lit("").alias("other_ip")
    )
    masked = F.struct(
        mask_address("ip").alias("ip"), mask_address("other_ip").alias("other_ip")
    )
    full = F.struct(F.col("ip").alias("ip"), F.col("other_ip").alias("other_ip"))
    if policy.anonymous:
        allowed = masked if policy.mask else full
    else:
        allowed = hashed if policy.hash else masked if policy.mask else full
    kept = F.when(identify, allowed).otherwise(hashed)
    out = df.withColumn("_kept", F.when(F.coalesce(F.col("ip"), F.lit("")) == "", full).otherwise(kept))
    return out.withColumn("ip", F.col("_kept.ip")).withColumn("other_ip", F.col("_kept.other_ip")).drop("_kept")


def bad_url(column) -> Column:
    """A URL without the host its form promises."""
    return as_column(column).rlike(r"^([A-Za-z][A-Za-z0-9+.-]*:)?//([/?#:]|$)|^:")


def excluded_user(policy: Policy, user="username", roles="roles", capabilities="capabilities") -> Column:
    """Refuse a signed-in user: all, by role or capability, or by name."""
    signed_in = blank_to_null(user).isNotNull()
    if policy.ignore_all_users:
        return signed_in
    reason = F.lit(False)
    if policy.ignore_capabilities:
        for group in (roles, capabilities):
            listed = F.exists(F.coalesce(as_column(group), F.array().cast("array<string>")),
                              lambda r: matches_wildcard(r, policy.ignore_capabilities))
            reason = reason | listed
    if policy.ignore_users:
        reason = reason | matches_wildcard(user, policy.ignore_users)
    return signed_in & F.coalesce(reason, F.lit(False))


def reject_code(policy: Policy, columns: list[str]) -> Column:
    """The first refusal that applies to a hit, NULL for an accepted one.

    `columns` are the hit's column names; a test whose column is missing never
    fires. The order is that of REJECT_ORDER.
    """

    def listed(column: str, spec: str) -> Column:
        if _LISTED + column in columns:  # a long list has been met as a table
            return F.col(_LISTED + column)
        return matches_wildcard(column, spec) if spec and column in columns else F.lit(False)

    def named_in(column: str, text: str) -> Column:
        if not text or column not in columns:
            return F.lit(False)
        return (F.col(column) != "") & F.contains(F.lit(text.lower()), F.lower(F.col(column)))

    def given(column: str, test: Column) -> Column:
        return test if column in columns else F.lit(False)

    resource = F.col("resource")
    users = excluded_user(
        policy,
        roles="roles" if "roles" in columns else F.array().cast("array<string>"),
        capabilities="capabilities" if "capabilities" in columns else F.array().cast("array<string>"),
    ) if "username" in columns else F.lit(False)
    in_range = in_ranges("ip", policy.ignore_ranges) if policy.ignore_ranges else F.lit(False)
    if _IN_RANGE in columns:  # a long list has been met as a table
        in_range = F.col(_IN_RANGE)
    elif policy.ignore_ranges and "other_ip" in columns:
        in_range = in_range | in_ranges("other_ip", policy.ignore_ranges)
    tests = {
        301: ~may_track(policy, "consent", "dnt") if {"consent", "dnt"} <= set(columns) else F.lit(False),
        302: F.col("dt").isNull(),
        202: F.coalesce(F.col("ip"), F.lit("")).isin("", "0.0.0.0"),
        304: in_range,
        203: resource.isNull() | bad_url(resource),
        305: listed("resource", policy.ignore_resources),
        201: given("referer", bad_url("referer")),
        306: listed("referer", policy.ignore_referers),
        307: listed("content_type", policy.ignore_content_types),
        308: F.contains(resource, F.lit(policy.own_call)),
        309: users,
        317: given("spam", F.col("spam")) if policy.ignore_spammers else F.lit(False),
        310: named_in("language", policy.ignore_languages),
        311: named_in("country", policy.ignore_countries),
        312: given("prefetch", F.col("prefetch")) if policy.ignore_prefetch else F.lit(False),
        313: given("browser_type", F.col("browser_type") == 1) if policy.ignore_bots else F.lit(False),
        314: listed("browser", policy.ignore_browsers) | listed("user_agent", policy.ignore_browsers),
        315: listed("platform", policy.ignore_platforms),
        316: given("vetoed", F.col("vetoed")),
    }
    return F.coalesce(*[F.when(tests[code], F.lit(code)) for code in REJECT_ORDER])


_IN_RANGE = "_in_ignored_range"
#: Ranges that are tested as one expression; more of them come as a table, with the same answer.
FEW_RANGES = 32
_LISTED = "_listed_"
#: So many patterns of one list are one expression; a longer list comes as a table, with the same answer.
FEW_PATTERNS = 200


def _with_long_lists(hits: DataFrame, policy: Policy) -> DataFrame:
    lists = {
        "resource": policy.ignore_resources, "referer": policy.ignore_referers, "content_type": policy.ignore_content_types,
        "browser": policy.ignore_browsers, "user_agent": policy.ignore_browsers, "platform": policy.ignore_platforms,
    }
    for column, spec in lists.items():
        patterns = [x.strip() for x in spec.split(",") if x.strip()]
        if len(patterns) > FEW_PATTERNS and column in hits.columns:
            table = hits.sparkSession.createDataFrame([(x,) for x in patterns], "pattern string")
            hits = in_pattern_table(hits, table, [column], _LISTED + column)
    return hits


def with_reject_code(hits: DataFrame, policy: Policy) -> DataFrame:
    """Add `reject_code`."""
    hits = _with_long_lists(hits, policy)
    if len(policy.ignore_ranges) > FEW_RANGES:
        listed = hits.sparkSession.createDataFrame([(r,) for r in policy.ignore_ranges], "cidr string")
        hits = in_range_table(hits, listed, [c for c in ("ip", "other_ip") if c in hits.columns], _IN_RANGE)
    return hits.withColumn("reject_code", reject_code(policy, hits.columns)).drop(_IN_RANGE, *[c for c in hits.columns if c.startswith(_LISTED)])


def reject_stats(hits: DataFrame, policy: Policy) -> DataFrame:
    """Refused hits per code."""
    refused = with_reject_code(hits, policy).where("reject_code IS NOT NULL")
    return refused.groupBy("reject_code").agg(F.count("*").alias("counthits"))


def clean_referer(hits: DataFrame, policy: Policy) -> DataFrame:
    """Referrer rules: a strange scheme is noted and dropped, the own host dropped.

    Search words are taken first.
    """
    scheme = F.lower(F.regexp_extract("referer", r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    strange = F.coalesce((scheme != "") & ~scheme.isin(*REFERRER_SCHEMES), F.lit(False))
    host = F.regexp_extract("referer", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1)
    own = F.lit(False) if policy.keep_own_referers else F.coalesce(host == policy.site_host, F.lit(False))
    note = F.concat(F.lit("[Attempted XSS Injection: "), "referer", F.lit("]"))
    return hits.select(
        *[c for c in hits.columns if c not in ("referer", "notes", "searchterms")],
        F.when(strange, append_note("notes", note)).otherwise(F.col("notes")).alias("notes"),
        F.when(~strange, blank_to_null(search_words("referer"))).alias("searchterms"),
        F.when(~strange & ~own, F.col("referer")).alias("referer"),
    )


def content_info(info) -> Column:
    """Struct (content_type, category, content_id, author) of a payload's JSON.

    Missing or unreadable text means content from outside the site.
    """
    parsed = F.from_json(as_column(info), CONTENT_INFO)
    readable = F.coalesce(F.get_json_object(as_column(info), "$"), F.lit("")).startswith("{")
    outside = F.struct(
        F.lit("external").alias("content_type"),
        F.lit(None).cast("string").alias("category"),
        F.lit(None).cast("bigint").alias("content_id"),
        F.lit(None).cast("string").alias("author"),
    )
    tidy = F.struct(
        blank_to_null(parsed["content_type"]).alias("content_type"),
        blank_to_null(parsed["category"]).alias("category"),
        F.nullif(F.abs(parsed["content_id"]), F.lit(0).cast("bigint")).alias("content_id"),
        blank_to_null(parsed["author"]).alias("author"),
    )
    return F.when(readable, tidy).otherwise(outside)


def client_info(hits: DataFrame) -> DataFrame:
    """Typed sizes and timings out of the payload's text keys."""
    return hits.select(
        "*",
        viewport("bw", "bh").alias("resolution"),
        F.col("sw").try_cast("int").alias("screen_width"),
        F.col("sh").try_cast("int").alias("screen_height"),
        milliseconds("sl").alias("server_latency"),
        milliseconds("pp").alias("page_performance"),
        clean_fingerprint("fh").alias("fingerprint"),
        F.col("tz").try_cast("int").alias("tz_offset"),
    )


def is_pageview() -> Column:
    """No id: the one kind that is told without the other keys."""
    return F.coalesce("id", F.lit("")) == ""  # names the id once: as a filter it is parsed out of the payload for each mention


def hit_kind(own_hosts: list[str]) -> Column:
    """What a payload is.

    No id: pageview. An id without position: client details (with a viewport)
    or a heartbeat. An id with a position: an event, and with a link also a
    download or an outbound click.
    """
    has_position = blank_to_null("pos").isNotNull()
    has_link = blank_to_null("res").isNotNull()
    path, host = url_part("res", "PATH"), url_part("res", "HOST")
    return (
        F.when(is_pageview(), F.lit("pageview"))
        .when(~has_position & blank_to_null("bw").isNotNull(), F.lit("info"))
        .when(~has_position, F.lit("heartbeat"))
        .when(~has_link, F.lit("event"))
        .when(download_type(path).isNotNull(), F.lit("download"))
        .when(outside_host(host, own_hosts), F.lit("outbound"))
        .otherwise(F.lit("event"))
    )


def event_rows(hits: DataFrame) -> DataFrame:
    """Event rows out of hits that carry an id and a position."""
    carriers = hits.where((F.coalesce("id", F.lit("")) != "") & (F.coalesce("pos", F.lit("")) != ""))
    return carriers.select(
        F.col("id").try_cast("bigint").alias("id"),
        click_position("pos").alias("position"),
        F.substring("no", 1, NOTE_LIMIT).alias("notes"),
        F.col("dt"),
    )


def redirect_content_type(status, content_type) -> Column:
    status = as_column(status)
    return F.when(status.between(300, 399), F.concat(F.lit("redirect:"), status)).otherwise(as_column(content_type))


def stored_resource(hits: DataFrame) -> DataFrame:
    return hits.withColumn("resource", normalise_resource("resource"))


def upgrade_consent(
    pageviews: DataFrame, grants: DataFrame, window: int = SESSION_SECONDS
) -> DataFrame:
    """Give anonymous rows of a visit the identity that came with consent.

    `grants` has one row per consent: dt, ip_hash, resource, fingerprint and
    the new ip, username, email, user_id, new_visit_id. The latest row with the
    same hashed address and resource in the window names the visit; all rows of
    that visit and address since the window opened are rewritten. Of several
    consents for one visit the latest counts.

    The visit is found by an as-of lookup over time slots, with the fingerprint
    as a further key where the consent carries one.
    """
    asked = grants.select(
        F.col("dt").alias("g_dt"), F.col("ip_hash").alias("ip"), "resource",
        blank_to_null("fingerprint").alias("g_print"), F.col("ip").alias("g_ip"),
        F.col("username").alias("g_user"), F.col("email").alias("g_email"),
        F.col("user_id").alias("g_id"), F.col("new_visit_id").alias("g_visit"),
    )
    with_print = asked.where("g_print IS NOT NULL").withColumn("fingerprint", F.col("g_print"))
    without = asked.where("g_print IS NULL")

    def found(some: DataFrame, keys: list[str]) -> DataFrame:
        probes = some.select(*keys, F.col("g_dt").alias("dt"))
        visits = latest_visit(probes, pageviews, keys, window).withColumnRenamed("dt", "g_dt")
        return some.join(visits, [*keys, "g_dt"]).drop("fingerprint")

    target = (
        found(with_print, ["ip", "resource", "fingerprint"])
        .unionByName(found(without, ["ip", "resource"]))
        .withColumnRenamed("visit_found", "visit_id")
        .where("visit_id > 0")
    )
    latest = target.groupBy("visit_id", "ip").agg(
        F.max_by(F.struct("g_dt", "g_ip", "g_user", "g_email", "g_id", "g_visit", "g_print"), "g_dt").alias("g")
    )
    joined = pageviews.join(latest, ["visit_id", "ip"], "left")
    hit = F.col("g").isNotNull() & (F.col("dt") >= F.col("g.g_dt") - window)
    tag = F.concat(F.lit("[user:"), "g.g_id", F.lit("]"))
    changes = {
        "ip": F.when(hit, F.col("g.g_ip")).otherwise(F.col("ip")),
        "username": F.when(hit, F.coalesce("g.g_user", "username")).otherwise(F.col("username")),
        "email": F.when(hit, F.coalesce("g.g_email", "email")).otherwise(F.col("email")),
        "fingerprint": F.when(hit, F.coalesce(blank_to_null("g.g_print"), "fingerprint")).otherwise(F.col("fingerprint")),
        "visit_id": F.when(hit, F.coalesce("g.g_visit", "visit_id")).otherwise(F.col("visit_id")),
        "notes": F.when(hit & F.col("g.g_id").isNotNull(), append_note("notes", tag)).otherwise(F.col("notes")),
    }
    return joined.select(*[changes[c].alias(c) if c in changes else F.col(c) for c in pageviews.columns])


def apply_hooks(hits: DataFrame, before=None, after=None, enrich=None) -> DataFrame:
    """User transforms around enrichment; a row whose dt becomes NULL is refused.

    The code is 302 when the first transform cleared it, 316 for the second.
    """
    out = hits.transform(before) if before else hits
    out = out.withColumn("hook_code", F.when(F.col("dt").isNull(), F.lit(302)))
    out = out.transform(enrich) if enrich else out
    out = out.transform(after) if after else out
    late = F.when(F.col("dt").isNull(), F.lit(316))
    return out.withColumn("hook_code", F.coalesce("hook_code", late))


def fold_updates(pageviews: DataFrame, updates: DataFrame, limit: int = 2048, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """Apply later updates to page views with the same `keys`.

    `updates` has id, seq (arrival order), notes, outbound_resource, dt_out and
    any other columns of the table. Non-empty fields overwrite, the last one
    winning; notes are appended; links are joined with `;;;` up to a limit.
    Updates are combined per page before the join: last values by `max_by`,
    appended texts as a list in order.
    """
    appended = ("notes", "outbound_resource")
    plain = [c for c in updates.columns if c not in (*keys, "seq", *appended)]

    def present(c: str) -> Column:
        text = F.col(c).cast("string")
        return (text != "") & (text != "0")

    def in_order(c: str) -> Column:
        pairs = F.collect_list(F.when(present(c), F.struct("seq", F.col(c).alias("v"))))
        return F.transform(F.array_sort(pairs), lambda p: p["v"])

    per_page = updates.groupBy(*keys).agg(
        *[F.max_by(c, F.when(present(c), F.col("seq"))).alias(f"u_{c}") for c in plain],
        *[in_order(c).alias(f"u_{c}") for c in appended if c in updates.columns],
    )
    joined = pageviews.join(per_page, list(keys), "left")
    nothing = F.array().cast("array<string>")
    changes = {c: F.coalesce(f"u_{c}", c) for c in plain}
    if "notes" in updates.columns:
        added = F.array_join(F.coalesce("u_notes", nothing), "")
        changes["notes"] = F.when(added != "", F.concat(F.coalesce("notes", F.lit("")), added)).otherwise(F.col("notes"))
    if "outbound_resource" in updates.columns:
        changes["outbound_resource"] = F.aggregate(
            F.coalesce("u_outbound_resource", nothing),
            F.col("outbound_resource"),
            lambda links, url: append_link(links, url, limit),
        )
    return joined.select(*[changes[c].alias(c) if c in changes else F.col(c) for c in pageviews.columns])
