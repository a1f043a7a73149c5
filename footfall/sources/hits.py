"""Raw hits: one JSON payload per row, from files or a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from footfall.functions.text import as_column
from footfall.schema import HIT

# Payload keys whose values are base64url text.
CODED_KEYS = ("ref", "res", "no", "ci")

RAW = T.StructType(
    [
        T.StructField("received", T.LongType()),
        T.StructField("ip", T.StringType()),
        T.StructField("user_agent", T.StringType()),
        T.StructField("payload", T.StringType()),
    ]
)


def decode_base64url(column) -> Column:
    """Text out of the URL-safe alphabet `._-` for `+/=`; NULL when it is not base64."""
    padded = F.translate(as_column(column), "._-", "+/=")
    raw = F.try_to_binary(padded, F.lit("base64"))
    return F.regexp_replace(F.trim(F.decode(raw, "UTF-8")), "<[^>]*>", "")


def encode_base64url(column) -> Column:
    one_line = F.regexp_replace(F.base64(F.encode(as_column(column), "UTF-8")), r"[\r\n]", "")
    return F.translate(one_line, "+/=", "._-")


def parse_hits(raw: DataFrame) -> DataFrame:
    """Payload keys as columns, coded ones decoded; works on batch and stream."""
    rows = raw.withColumn("hit", F.from_json("payload", HIT))
    fields = [
        (decode_base64url(f"hit.{f.name}") if f.name in CODED_KEYS else F.col(f"hit.{f.name}")).alias(f.name)
        for f in HIT.fields
    ]
    return rows.select(*[c for c in raw.columns if c != "payload"], *fields)


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    return parse_hits(spark.read.schema(RAW).json(path))


def stream_hits(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Hits arriving as JSON files; a message bus needs only another reader."""
    reader = spark.readStream.schema(RAW).option("maxFilesPerTrigger", files_per_trigger)
    return parse_hits(reader.json(path))
