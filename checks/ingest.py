"""Raw hits, refusals, consent, enrichment, updates."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.agents import ANSWERS
from checks.base import check, pv, sql
from checks.functions import SECRET, hmac_sql
from checks.joins import GEO_VALUES, IP_NUMBER, SPAM_SQL, geo_ranges, spam_list
from footfall.functions import agents
from footfall.operators import hit_pipeline, ingest
from footfall.schema import HASH_LENGTH
from footfall.session import scratch_path
from footfall.sources.hits import CODED_KEYS, RAW, encode_base64url, parse_hits, read_hits, stream_hits
from footfall.sources.tables import read_pageviews

_RAW_COLUMNS = (
    "id dt ip user_agent referer resource resolution screen_width screen_height server_latency page_performance "
    "fingerprint tz_offset content_type category content_id author"
)

# What a payload says, as text both engines read: a quarter are page views, the rest follow-ups.
PAYLOAD_SQL = {
    "id": "CASE WHEN id % 4 > 0 THEN concat('', id) END",
    "ref": "referer",
    "res": "CASE id % 8 WHEN 0 THEN 'https://example.com' || resource WHEN 4 THEN 'https://example.com' || resource "
    "WHEN 3 THEN 'https://example.com/files/report.pdf' WHEN 6 THEN 'https://www.elsewhere.net:8080/x' WHEN 7 THEN 'https://www.example.com/in' END",
    "pos": "CASE WHEN id % 4 > 1 THEN CASE id % 5 WHEN 0 THEN 'bad' ELSE concat(id % 900, ',', id % 700) END END",
    "no": "CASE WHEN id % 4 > 1 THEN concat('type:click <b>', id % 9, '</b>') END",
    "ci": "CASE id % 8 WHEN 0 THEN concat('{\"content_type\":\"', content_type, '\",\"category\":\"1,2\",\"content_id\":', content_id, '}') "
    "WHEN 4 THEN CASE id % 3 WHEN 0 THEN 'O:8:broken' END END",
    "bw": "CASE WHEN id % 8 IN (0, 1, 4) THEN split_part(resolution, 'x', 1) END",
    "bh": "CASE WHEN id % 8 IN (0, 1, 4) THEN split_part(resolution, 'x', 2) END",
    "sw": "concat('', screen_width)",
    "sh": "concat('', screen_height)",
    "sl": "concat('', server_latency)",
    "pp": "concat('', page_performance)",
    "fh": "concat(fingerprint, '!')",
    "tz": "concat('', tz_offset)",
}


def raw_hits(spark, sf_dir):
    """Page views re-encoded as the payloads a browser sends."""
    rows = pv(spark, sf_dir, _RAW_COLUMNS)
    fields = [
        (encode_base64url(F.expr(e)) if k in CODED_KEYS else F.expr(e)).alias(k) for k, e in PAYLOAD_SQL.items()
    ]
    return rows.select(
        F.col("id").alias("hit_no"), F.col("dt").alias("received"), "ip", "user_agent", F.to_json(F.struct(*fields)).alias("payload")
    )


def parsed(spark, sf_dir):
    return parse_hits(raw_hits(spark, sf_dir))


_PARSED = ", ".join(f"{e} AS {k}" for k, e in PAYLOAD_SQL.items() if k != "no")
HITS_SQL = f"""hits AS (SELECT id AS hit_no, dt AS received, ip, user_agent, {_PARSED},
  CASE WHEN id % 4 > 1 THEN concat('type:click ', id % 9) END AS "no" FROM pageviews)"""
_KEYS = ", ".join(f'"{k}"' for k in PAYLOAD_SQL)


@check("src_hits_stream", sql(f"SELECT hit_no, received, ip, user_agent, {_KEYS} FROM hits", HITS_SQL))
def src_hits_stream(spark, sf_dir):
    return parsed(spark, sf_dir)


@check(
    "hit_kind",
    sql(
        """SELECT hit_no, CASE hit_no % 8 WHEN 0 THEN 'pageview' WHEN 4 THEN 'pageview' WHEN 1 THEN 'info' WHEN 5 THEN 'heartbeat'
  WHEN 3 THEN 'download' WHEN 6 THEN 'outbound' ELSE 'event' END AS kind FROM hits""",
        HITS_SQL,
    ),
)
def hit_kind(spark, sf_dir):
    return parsed(spark, sf_dir).select("hit_no", ingest.hit_kind(["example.com"]).alias("kind"))


@check(
    "event_row",
    sql(
        """SELECT CAST(id AS BIGINT) AS id, CASE WHEN pos = 'bad' THEN '' ELSE pos END AS position, "no" AS notes, received AS dt
FROM hits WHERE id IS NOT NULL AND pos IS NOT NULL""",
        HITS_SQL,
    ),
)
def event_row(spark, sf_dir):
    return ingest.event_rows(parsed(spark, sf_dir).withColumnRenamed("received", "dt"))


@check(
    "hit_content_info",
    sql(
        """SELECT id, CASE WHEN id % 8 = 0 THEN content_type ELSE 'external' END AS content_type,
  CASE WHEN id % 8 = 0 THEN '1,2' END AS category, CASE WHEN id % 8 = 0 THEN nullif(content_id, 0) END AS content_id
FROM pageviews WHERE id % 4 = 0"""
    ),
)
def hit_content_info(spark, sf_dir):
    rows = parsed(spark, sf_dir).where("id IS NULL").withColumn("info", ingest.content_info("ci"))
    return rows.select(F.col("hit_no").alias("id"), "info.content_type", "info.category", "info.content_id")


_STRANGE = "CASE id % 10 WHEN 0 THEN 'javascript:alert(1)' WHEN 1 THEN concat('https://example.com/find?q=own+words', id % 5) ELSE referer END"


@check(
    "hit_referer_clean",
    sql(
        """SELECT id, CASE WHEN id % 10 = 0 THEN concat(coalesce(notes, ''), '[Attempted XSS Injection: javascript:alert(1)]') ELSE notes END AS notes,
  CASE WHEN id % 10 = 1 THEN concat('own words', id % 5) END AS searchterms,
  CASE WHEN id % 10 > 1 THEN referer END AS referer FROM pageviews"""
    ),
)
def hit_referer_clean(spark, sf_dir):
    rows = pv(spark, sf_dir, "id referer notes").withColumn("referer", F.expr(_STRANGE))
    return ingest.clean_referer(rows, ingest.Policy()).select("id", "notes", "searchterms", "referer")


POLICY = ingest.Policy(
    consent_required=True,
    respect_dnt=True,
    ignore_ranges=["10.7.0.0/16"],
    ignore_resources="/en/*page=2, *ref=x",
    ignore_referers="*.example.org/de/*",
    ignore_content_types="404",
    ignore_users="user9, user2!",
    ignore_languages="es-es, xx",
    ignore_countries="nation_11,nation_7",
    ignore_bots=True,
    ignore_prefetch=True,
    ignore_spammers=True,
    ignore_browsers="edge",
    ignore_platforms="ios*",
)
_HIT_COLUMNS = "id dt ip other_ip resource referer content_type username language country browser_type browser user_agent platform"


def hits_to_judge(spark, sf_dir):
    """Page views with the columns a live hit carries besides."""
    rows = pv(spark, sf_dir, _HIT_COLUMNS)
    spam = spam_list(spark, sf_dir).select("ip").distinct().withColumn("spam", F.lit(True))
    rows = rows.withColumn("dt", F.expr("CASE WHEN id % 101 = 5 THEN NULL ELSE dt END"))
    rows = rows.withColumn("ip", F.expr("CASE WHEN id % 103 = 7 THEN '0.0.0.0' ELSE ip END"))
    rows = rows.withColumn("resource", F.expr("CASE WHEN id % 107 = 9 THEN 'http:///x' WHEN id % 109 = 3 THEN '/admin-ajax.php?a=1' ELSE resource END"))
    rows = rows.withColumn("referer", F.expr("CASE WHEN id % 113 = 4 THEN 'https://' ELSE referer END"))
    extra = {"consent": "id % 11 <> 0", "dnt": "id % 37 = 1", "prefetch": "id % 41 = 2", "vetoed": "id % 43 = 3"}
    rows = rows.selectExpr("*", *[f"{e} AS {n}" for n, e in extra.items()])
    return rows.join(spam, "ip", "left")


_JUDGED = f"""{SPAM_SQL},
live AS (SELECT id, CASE WHEN id % 101 = 5 THEN NULL ELSE dt END AS dt, CASE WHEN id % 103 = 7 THEN '0.0.0.0' ELSE ip END AS ip, other_ip,
  CASE WHEN id % 107 = 9 THEN 'http:///x' WHEN id % 109 = 3 THEN '/admin-ajax.php?a=1' ELSE resource END AS resource,
  CASE WHEN id % 113 = 4 THEN 'https://' ELSE referer END AS referer, content_type, username, language, country, browser_type, browser,
  user_agent, platform, id % 11 <> 0 AS consent, id % 37 = 1 AS dnt, id % 41 = 2 AS prefetch, id % 43 = 3 AS vetoed FROM pageviews),
judged AS (SELECT id, CASE
  WHEN dnt OR NOT consent THEN 301
  WHEN dt IS NULL THEN 302
  WHEN ip = '0.0.0.0' THEN 202
  WHEN ip LIKE '10.7.%' THEN 304
  WHEN resource IS NULL OR resource = 'http:///x' THEN 203
  WHEN regexp_matches(resource, '(?i)^(/en/.*page=2|.*ref=x)$') THEN 305
  WHEN referer = 'https://' THEN 201
  WHEN regexp_matches(referer, '(?i)^.*\\.example\\.org/de/.*$') THEN 306
  WHEN content_type = '404' THEN 307
  WHEN resource LIKE '%admin-ajax.php%' THEN 308
  WHEN regexp_matches(username, '^(user9|user2.)$') THEN 309
  WHEN ip IN (SELECT ip FROM spam) THEN 317
  WHEN language = 'es-es' THEN 310
  WHEN country IN ('nation_11', 'nation_7', 'nation_1') THEN 311
  WHEN prefetch THEN 312
  WHEN browser_type = 1 THEN 313
  WHEN browser = 'Edge' THEN 314
  WHEN platform = 'ios' THEN 315
  WHEN vetoed THEN 316 END AS reject_code FROM live)"""


@check("hit_reject_codes", sql("SELECT id, reject_code FROM judged", _JUDGED))
def hit_reject_codes(spark, sf_dir):
    return ingest.with_reject_code(hits_to_judge(spark, sf_dir), POLICY).select("id", "reject_code")


@check(
    "hit_reject_stats",
    sql("SELECT reject_code, count(*) AS counthits FROM judged WHERE reject_code IS NOT NULL GROUP BY reject_code", _JUDGED),
)
def hit_reject_stats(spark, sf_dir):
    return ingest.reject_stats(hits_to_judge(spark, sf_dir), POLICY)


@check(
    "hit_user_exclusion",
    sql(
        """SELECT id, username IS NOT NULL AND (id % 5 = 0 OR id % 7 = 0 OR regexp_matches(username, '^user1.*$')) AS excluded FROM pageviews"""
    ),
)
def hit_user_exclusion(spark, sf_dir):
    rows = pv(spark, sf_dir, "id username").selectExpr(
        "*",
        "CASE WHEN id % 5 = 0 THEN array('author', 'editor') ELSE array('reader') END AS roles",
        "CASE WHEN id % 7 = 0 THEN array('manage_options') END AS capabilities",
    )
    policy = ingest.Policy(ignore_capabilities="Editor, manage*", ignore_users="user1*")
    return rows.select("id", ingest.excluded_user(policy).alias("excluded"))


_CONSENT = {"answer": "id % 3 = 0", "dnt": "id % 5 = 0", "upgrade": "id % 7 = 0"}


@check(
    "hit_consent_gate",
    sql(
        """SELECT id, NOT (id % 5 = 0) AND id % 3 = 0 AS standard_track, NOT (id % 5 = 0) AND id % 3 = 0 AS standard_identify,
  NOT (id % 5 = 0) AS anonymous_track, NOT (id % 5 = 0) AND (id % 3 = 0 OR id % 7 = 0) AS anonymous_identify,
  true AS free_track, true AS free_identify, true AS faceless_track, true AS faceless_identify FROM pageviews"""
    ),
)
def hit_consent_gate(spark, sf_dir):
    rows = pv(spark, sf_dir, "id").selectExpr("*", *[f"{e} AS {n}" for n, e in _CONSENT.items()])
    policies = {
        "standard": ingest.Policy(consent_required=True, respect_dnt=True),
        "anonymous": ingest.Policy(consent_required=True, respect_dnt=True, anonymous=True),
        "free": ingest.Policy(),
        "faceless": ingest.Policy(consent_required=True, set_cookie=False, mask=True),
    }
    columns = []
    for name, policy in policies.items():
        columns.append(ingest.may_track(policy, "answer", "dnt").alias(f"{name}_track"))
        columns.append(ingest.may_identify(policy, "answer", "dnt", "upgrade").alias(f"{name}_identify"))
    return rows.select("id", *columns)


_DAY = "strftime(make_timestamp(dt * 1000000), '%Y-%m-%d')"
_HASHED = "substring(" + hmac_sql(f"{_DAY} || '|' || ip || '|' || user_agent") + f", 1, {HASH_LENGTH})"


@check(
    "hit_privacy_mode",
    sql(
        f"""SELECT id, mode, CASE WHEN answer AND mode = 'plain' THEN ip WHEN answer AND mode = 'masked' THEN regexp_replace(ip, '[.][0-9]+$', '.0')
  ELSE hashed END AS ip,
  CASE WHEN answer AND mode = 'plain' THEN other_ip WHEN answer AND mode = 'masked' THEN regexp_replace(other_ip, '[.][0-9]+$', '.0')
  ELSE '' END AS other_ip
FROM (SELECT id, ip, other_ip, id % 3 = 0 AS answer, {_HASHED} AS hashed FROM pageviews) AS r
CROSS JOIN (SELECT unnest(['plain', 'masked', 'hashed']) AS mode) AS m"""
    ),
)
def hit_privacy_mode(spark, sf_dir):
    rows = pv(spark, sf_dir, "id ip other_ip user_agent dt")
    salt = F.date_format(F.timestamp_seconds("dt"), "yyyy-MM-dd")
    modes = {
        "plain": ingest.Policy(consent_required=True, secret=SECRET),
        "masked": ingest.Policy(consent_required=True, mask=True, anonymous=True, secret=SECRET),
        "hashed": ingest.Policy(consent_required=True, mask=True, hash=True, secret=SECRET),
    }
    out = None
    for name, policy in modes.items():
        identify = ingest.may_identify(policy, F.expr("id % 3 = 0"), F.lit(False))
        part = ingest.stored_address(rows, policy, identify, salt).select("id", F.lit(name).alias("mode"), "ip", "other_ip")
        out = part if out is None else out.unionByName(part)
    return out


_ANSWERS = ", ".join(f"({i}, '{b}', '{v}', {k}, '{p}')" for i, (b, v, k, p) in enumerate(ANSWERS))


@check(
    "hit_ua_enrich",
    sql(
        f"""SELECT r.id, a.browser, a.browser_version, a.browser_type, a.platform
FROM pageviews r JOIN answers a ON a.n = (r.page_performance // 20) % {len(ANSWERS)}""",
        f"answers(n, browser, browser_version, browser_type, platform) AS (VALUES {_ANSWERS})",
    ),
)
def hit_ua_enrich(spark, sf_dir):
    rows = agents.enrich_agents(pv(spark, sf_dir, "id user_agent"))
    return rows.select("id", "browser", "browser_version", "browser_type", "platform")


@check(
    "redirect_content_type",
    sql(
        """SELECT id, CASE WHEN 200 + content_id * 4 BETWEEN 300 AND 399 THEN concat('redirect:', 200 + content_id * 4) ELSE content_type END AS content_type
FROM pageviews"""
    ),
)
def redirect_content_type(spark, sf_dir):
    status = F.col("content_id") * 4 + 200
    return pv(spark, sf_dir, "id content_id content_type").select(
        "id", ingest.redirect_content_type(status, "content_type").alias("content_type")
    )


@check(
    "consent_upgrade",
    sql(
        """SELECT p.id, CASE WHEN hit THEN '203.0.113.7' ELSE p.ip END AS ip,
  CASE WHEN hit THEN concat('member', g.n) ELSE p.username END AS username,
  CASE WHEN hit THEN g.n + 900000000 ELSE p.visit_id END AS visit_id,
  CASE WHEN NOT hit OR coalesce(p.notes, '') LIKE concat('%[user:', g.n, ']%') THEN p.notes ELSE concat(coalesce(p.notes, ''), '[user:', g.n, ']') END AS notes
FROM (SELECT a.*, g.n AS grant_no, coalesce(a.dt >= g.dt - 1800, false) AS hit FROM anon a
      LEFT JOIN latest g ON g.visit_id = a.visit_id AND g.ip = a.ip) AS p LEFT JOIN latest g ON g.n = p.grant_no""",
        """anon AS (SELECT id, dt, ip, resource, fingerprint, username, notes, visit_id FROM pageviews),
grants AS (SELECT id AS n, dt + 600 AS dt, ip, resource, CASE WHEN id % 2 = 0 THEN fingerprint END AS fingerprint
  FROM pageviews WHERE content_type = 'download' AND resource IS NOT NULL),
named AS (SELECT n, dt, ip, (SELECT a.visit_id FROM anon a WHERE a.ip = grants.ip AND a.resource = grants.resource
   AND a.dt BETWEEN grants.dt - 1800 AND grants.dt AND (grants.fingerprint IS NULL OR grants.fingerprint = a.fingerprint)
   ORDER BY a.dt DESC, a.id DESC LIMIT 1) AS visit_id FROM grants),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY visit_id, ip ORDER BY dt DESC, n DESC) AS k
   FROM named WHERE visit_id > 0) AS x WHERE k = 1)""",
    ),
)
def consent_upgrade(spark, sf_dir):
    """Every download is followed ten minutes later by a consent from the same page."""
    anonymous = pv(spark, sf_dir, "id dt ip resource fingerprint username email notes visit_id")
    buyers = pv(spark, sf_dir, "id dt ip resource fingerprint content_type")
    grants = buyers.where("content_type = 'download' AND resource IS NOT NULL").selectExpr(
        "dt + 600 AS dt", "ip AS ip_hash", "resource", "CASE WHEN id % 2 = 0 THEN fingerprint END AS fingerprint",
        "'203.0.113.7' AS ip", "concat('member', id) AS username", "concat('member', id, '@example.com') AS email",
        "CAST(id AS STRING) AS user_id", "id + 900000000 AS new_visit_id",
    )
    return ingest.upgrade_consent(anonymous, grants).select("id", "ip", "username", "visit_id", "notes")


@check("ext_hit_hooks", sql(
    """SELECT id, upper(browser) AS browser, CASE WHEN id % 13 = 0 THEN 302 WHEN id % 17 = 0 THEN 316 END AS hook_code FROM pageviews"""
))
def ext_hit_hooks(spark, sf_dir):
    def drop_some(df):
        return df.withColumn("dt", F.when(F.col("id") % 13 != 0, F.col("dt")))

    def shout(df):
        return df.withColumn("browser", F.upper("browser"))

    def veto(df):
        return df.withColumn("dt", F.when(F.col("id") % 17 != 0, F.col("dt")))

    rows = pv(spark, sf_dir, "id dt browser")
    return ingest.apply_hooks(rows, before=drop_some, enrich=shout, after=veto).select("id", "browser", "hook_code")


def updates(spark, sf_dir, with_time: bool = False):
    """Two later updates for every page that was found, of which some fields are empty."""
    time = ["dt AS page_dt"] if with_time else []
    rows = pv(spark, sf_dir, "id dt content_type").where("content_type <> '404'")
    first = rows.selectExpr(
        "id", "id * 2 AS seq", "concat('[tag:', id % 5, ']') AS notes",
        "CASE WHEN id % 4 = 0 THEN concat('https://one.example.net/', id % 7) ELSE '' END AS outbound_resource",
        "dt + 30 AS dt_out", "CASE WHEN id % 5 = 0 THEN concat('10x', id % 9) END AS resolution", *time,
    )
    second = rows.selectExpr(
        "id", "id * 2 + 1 AS seq", "CASE WHEN id % 2 = 0 THEN '[late:yes]' END AS notes",
        "CASE WHEN id % 6 = 2 THEN concat('https://two.example.net/', id % 7) END AS outbound_resource",
        "CASE WHEN id % 7 = 0 THEN 0 ELSE dt + 90 END AS dt_out", "'' AS resolution", *time,
    )
    return first.unionByName(second)


FOLD_SQL = """folded AS (SELECT id,
  CASE WHEN content_type = '404' THEN notes ELSE concat(coalesce(notes, ''), '[tag:', id % 5, ']', CASE WHEN id % 2 = 0 THEN '[late:yes]' ELSE '' END) END AS notes,
  CASE WHEN content_type = '404' OR (id % 4 <> 0 AND id % 6 <> 2) THEN outbound_resource ELSE concat_ws(';;;', nullif(outbound_resource, ''),
    CASE WHEN id % 4 = 0 THEN concat('https://one.example.net/', id % 7) END, CASE WHEN id % 6 = 2 THEN concat('https://two.example.net/', id % 7) END) END AS outbound_resource,
  CASE WHEN content_type = '404' THEN dt_out WHEN id % 7 = 0 THEN dt + 30 ELSE dt + 90 END AS dt_out,
  CASE WHEN content_type <> '404' AND id % 5 = 0 THEN concat('10x', id % 9) ELSE resolution END AS resolution
FROM pageviews)"""


@check("sink_update_fold", sql("SELECT * FROM folded", FOLD_SQL))
def sink_update_fold(spark, sf_dir):
    rows = pv(spark, sf_dir, "id notes outbound_resource dt_out resolution")
    return ingest.fold_updates(rows, updates(spark, sf_dir)).select("id", "notes", "outbound_resource", "dt_out", "resolution")


_FLOW_POLICY = ingest.Policy(ignore_bots=True, mask=True, secret=SECRET)
_FLOW_COLUMNS = (
    "dt ip country city referer resource visit_id server_latency browser browser_version browser_type platform fingerprint resolution "
    "content_type category"
).split()
_FLOW_SQL = sql(
    f"""SELECT p.dt, regexp_replace(p.ip, '[.][0-9]+$', '.0') AS ip, lower(g.cc) AS country,
  CASE WHEN g.sub <> '' THEN concat(g.city, ' (', g.sub, ')') ELSE g.city END AS city, p.referer, p.resource,
  CAST(concat('0x', substring({hmac_sql(f"{_DAY.replace('dt', 'p.dt')} || '|' || p.fingerprint")}, 1, 8)) AS BIGINT) AS visit_id,
  CASE WHEN p.server_latency BETWEEN 1 AND 59999 THEN p.server_latency ELSE 0 END AS server_latency,
  a.browser, a.browser_version, a.browser_type, a.platform, p.fingerprint, p.resolution,
  CASE WHEN p.id % 8 = 0 THEN p.content_type ELSE 'external' END AS content_type, CASE WHEN p.id % 8 = 0 THEN '1,2' END AS category
FROM pageviews p JOIN answers a ON a.n = (p.page_performance // 20) % {len(ANSWERS)}
LEFT JOIN geo g ON {IP_NUMBER} BETWEEN g.low AND g.high AND g.cc <> 'XX'
WHERE p.id % 4 = 0 AND p.resource IS NOT NULL AND a.browser_type <> 1""",
    f"""answers(n, browser, browser_version, browser_type, platform) AS (VALUES {_ANSWERS}),
geo(low, high, cc, city, sub, lat, lon) AS (VALUES {GEO_VALUES})""",
)


def inbox(spark, sf_dir):
    """The raw hits as JSON files, each delivered twice."""
    path = scratch_path(spark, "inbox")
    rows = raw_hits(spark, sf_dir).select([f.name for f in RAW.fields])
    rows.write.json(path)
    lines = spark.read.text(path)  # the second delivery repeats the lines of the first
    lines.coalesce(len(lines.inputFiles())).write.mode("append").text(path)
    return path


@check("hit_pipeline", _FLOW_SQL)
def run_hit_pipeline(spark, sf_dir):
    """Files of raw hits through every step into a stored table."""
    table = scratch_path(spark, "from-hits")
    hit_pipeline.store_hits(read_hits(spark, inbox(spark, sf_dir)), table, _FLOW_POLICY, geo_ranges(spark))
    return read_pageviews(spark, table).select(*_FLOW_COLUMNS)


@check("stream_hit_pipeline", _FLOW_SQL)
def run_stream_hit_pipeline(spark, sf_dir):
    """The same hits as a stream of files, in two runs of the stream."""
    table, folder, path = scratch_path(spark, "streamed-hits"), scratch_path(spark, "hit-stream"), inbox(spark, sf_dir)
    for _ in range(2):
        hit_pipeline.stream_store_hits(spark, stream_hits(spark, path, 4), table, _FLOW_POLICY, geo_ranges(spark), folder)
    return read_pageviews(spark, table).select(*_FLOW_COLUMNS)
