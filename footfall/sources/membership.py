"""Bloom filters of the ids of a stored table, per day and append, kept beside its day folders.

A filter is a number of blocks of 64 words. An id's hash names its block and HASHES bits inside. Filters are a table of
blocks, built and asked by joins and aggregates, so neither side passes the driver. They are written
before the rows that they stand for: what breaks in between leaves a filter that says maybe for ids that aren't there, never one
that denies an id. Jobs that take rows away leave the filters as they are, for the same reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from footfall.sources.tables import drop_path, is_complete, members_path

WORDS = 64
BITS = WORDS * 64
#: Bits of an id and what they cost: 24 bits an id, and about one id in 70,000 that isn't there is said to be maybe.
HASHES = 12
IDS = BITS // 24
_SCHEMA = "dt_date date, level int, block long, bits array<long>"


def _hashed(rows: DataFrame, key: str) -> DataFrame:
    """`rows` with two hashes of the key: one for the block, one for the bits."""
    return rows.withColumns({"place_": F.xxhash64(key), "bits_": F.xxhash64(F.lit(7), key)})


def _block(level: Column) -> Column:
    return F.col("place_").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), level) - 1)


def _positions() -> Column:
    """The HASHES bits of a block: steps of an odd length from a start."""
    start, step = F.col("bits_").bitwiseAND(BITS - 1), F.shiftrightunsigned("bits_", 20).bitwiseAND(BITS - 1).bitwiseOR(1)
    return F.array(*[(start + step * i).bitwiseAND(BITS - 1) for i in range(HASHES)])


def filters(rows: DataFrame, key: str) -> DataFrame:
    """(dt_date, level, block, bits) over the ids of `rows`, which have dt_date; a day has 2 ** level blocks."""
    days = rows.groupBy("dt_date").agg(F.greatest(F.lit(0), F.ceil(F.log2(F.count("*") / IDS))).cast("int").alias("level"))
    hashed = _hashed(rows.select("dt_date", key), key).join(days, "dt_date")
    bits = hashed.select("dt_date", "level", _block(F.col("level")).alias("block"), F.explode(_positions()).alias("at"))
    word = F.shiftright("at", 6).cast("int").alias("word")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(63).cast("int"))
    words = bits.groupBy("dt_date", "level", "block", word).agg(F.bit_or(bit).alias("bits"))
    blocks = words.groupBy("dt_date", "level", "block").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda w: F.coalesce(F.try_element_at("words", w), F.lit(0).cast("long")))
    return blocks.select("dt_date", "level", "block", dense.alias("bits"))


def add_filters(rows: DataFrame, path: str, key: str) -> None:
    """Write the filters of rows that are about to be appended."""
    filters(rows, key).write.mode("append").parquet(members_path(path))


def stored_ids(spark: SparkSession, path: str, key: T.StructField) -> DataFrame:
    """(key, dt_date) of a table that may still be empty."""
    return spark.read.schema(T.StructType([key, T.StructField("dt_date", T.DateType())])).parquet(path)


def ensure_filters(spark: SparkSession, path: str, key: T.StructField) -> None:
    """Filters for a table that has none, such as one that was loaded from elsewhere: its ids are read once."""
    if not is_complete(spark, members_path(path)):
        filters(stored_ids(spark, path, key), key.name).write.mode("overwrite").parquet(members_path(path))


def compact_filters(spark: SparkSession, path: str, key: str) -> None:
    """One filter per day instead of one per day and append, made from the ids."""
    field = spark.read.parquet(path).schema[key]
    drop_path(spark, members_path(path))
    ensure_filters(spark, path, field)


def maybe_stored(ids: DataFrame, path: str, key: str, near: int | None = None) -> DataFrame:
    """(key, dt_date): the ids among `ids` that a day's filter doesn't deny.

    With `near`, `ids` have dt_date, and each asks the filters of so many days before and after it alone, however many days there are.
    """
    spark = ids.sparkSession
    stored = spark.read.schema(_SCHEMA).parquet(members_path(path))
    levels = [r["level"] for r in stored.select("level").distinct().collect()]  # powers of two: a few dozens
    if not levels:
        return spark.createDataFrame([], ids.select(key).schema).withColumn("dt_date", F.lit(None).cast("date"))
    asked, day = ids.select(key), []
    if near is not None:
        days = F.sequence(F.date_sub("dt_date", near), F.date_add("dt_date", near))
        asked, day = ids.select(key, F.explode(days).alias("dt_date")), ["dt_date"]
    asked = _hashed(asked, key).withColumn("level", F.explode(F.array(*[F.lit(x) for x in levels])))
    asked = asked.select(key, *day, "level", _block(F.col("level")).alias("block"), _positions().alias("at"))
    met = asked.join(stored, [*day, "level", "block"])
    present = F.forall("at", lambda p: F.getbit(F.element_at("bits", (F.shiftright(p, 6) + 1).cast("int")), p.bitwiseAND(63).cast("int")) == 1)
    return met.where(present).select(key, "dt_date").distinct()
