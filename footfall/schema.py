"""Table layouts and the kind of every filterable column."""

from __future__ import annotations

from pyspark.sql import types as T

_TEXT = T.StringType()
_LONG = T.LongType()
_INT = T.IntegerType()

# Column names and types of the page view table.
PAGEVIEW = T.StructType(
    [
        T.StructField("id", _LONG),
        T.StructField("ip", _TEXT),
        T.StructField("other_ip", _TEXT),
        T.StructField("username", _TEXT),
        T.StructField("email", _TEXT),
        T.StructField("country", _TEXT),
        T.StructField("location", _TEXT),
        T.StructField("city", _TEXT),
        T.StructField("referer", _TEXT),
        T.StructField("resource", _TEXT),
        T.StructField("searchterms", _TEXT),
        T.StructField("notes", _TEXT),
        T.StructField("visit_id", _LONG),
        T.StructField("server_latency", _LONG),
        T.StructField("page_performance", _LONG),
        T.StructField("browser", _TEXT),
        T.StructField("browser_version", _TEXT),
        T.StructField("browser_type", _INT),
        T.StructField("platform", _TEXT),
        T.StructField("language", _TEXT),
        T.StructField("fingerprint", _TEXT),
        T.StructField("user_agent", _TEXT),
        T.StructField("resolution", _TEXT),
        T.StructField("screen_width", _INT),
        T.StructField("screen_height", _INT),
        T.StructField("content_type", _TEXT),
        T.StructField("category", _TEXT),
        T.StructField("author", _TEXT),
        T.StructField("content_id", _LONG),
        T.StructField("outbound_resource", _TEXT),
        T.StructField("tz_offset", _INT),
        T.StructField("dt_out", _LONG),
        T.StructField("dt", _LONG),
    ]
)

# Column names and types of the event table.
EVENT = T.StructType(
    [
        T.StructField("event_id", _LONG),
        T.StructField("type", _INT),
        T.StructField("event_description", _TEXT),
        T.StructField("notes", _TEXT),
        T.StructField("position", _TEXT),
        T.StructField("id", _LONG),
        T.StructField("dt", _LONG),
    ]
)

PAGEVIEW_COLUMNS = [f.name for f in PAGEVIEW.fields]
EVENT_COLUMNS = [f.name for f in EVENT.fields]

# What "empty" means for a column: text is NULL, a number is 0.
COLUMN_KIND = {
    f.name: "varchar" if isinstance(f.dataType, T.StringType) else "int" for f in PAGEVIEW.fields
}

ADDRESS_COLUMNS = ("ip", "other_ip")
EMPTY_ADDRESS = "0.0.0.0"

# Columns holding several values, with the text between two values.
MULTIVALUE = {"outbound_resource": ";;;", "category": ",", "notes": "]["}

# Payload keys of a raw hit.
HIT = T.StructType(
    [
        T.StructField(k, _TEXT)
        for k in ("id", "ref", "res", "pos", "no", "ci", "bw", "bh", "sw", "sh", "sl", "pp", "fh", "tz")
    ]
)

# Limits and defaults.
SESSION_SECONDS = 1800
ONLINE_SECONDS = 1800
RECENTLY_ACTIVE_SECONDS = 300
LIST_LIMIT = 200
RETENTION_DAYS = 420
TEXT_LIMIT = 2048
NOTE_LIMIT = 256
HASH_LENGTH = 39
DAY = 86400
