"""Distinct counts of any days from what is kept per day, without another look at the hits.

Distinct counts can't be added, so each day keeps a set. Two kinds: bitmaps over the numbers of a dictionary, which give
exact counts of any union of days, and theta sketches, which also know differences and overlaps of two ranges of days.
Both are columns of an ordinary table by day: a day is built once, and merged in the engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Parts of a dictionary; numbers are dense inside a part. Fixed for the life of a dictionary.
PARTS = 256
#: A theta sketch keeps 2^SHARPNESS values; sets up to that size are exact.
SHARPNESS = 16


def number_values(values: DataFrame, known: DataFrame | None = None, parts: int = PARTS) -> DataFrame:
    """Rows (value, part, position) for the values that `known` (a dictionary so far) lacks; append them to it.

    Values are dealt to parts by a hash and numbered from 1 inside each, after the numbers that are taken, so no task
    numbers more than its part. Nulls have no number. The same values and dictionary give the same numbers.
    """
    fresh = values.select("value").where("value IS NOT NULL").distinct()
    fresh = fresh.withColumn("part", F.pmod(F.xxhash64("value"), F.lit(parts)).cast("int"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("value")).cast("long")
    if known is None:
        return fresh.withColumn("position", place)
    fresh = fresh.join(known.select("value"), "value", "left_anti").withColumn("position", place)
    taken = known.groupBy("part").agg(F.max("position").alias("taken"))  # one row per part
    after = F.col("position") + F.coalesce("taken", F.lit(0))
    return fresh.join(taken, "part", "left").select("value", "part", after.alias("position"))


def daily_sets(rows: DataFrame, dictionary: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows (dt_date, keys, part, block, bits): which numbers each day has, as bitmaps of 32,768 numbers.

    `rows` has dt_date, value and the keys. Rows are reduced to one per day, key and value before they meet the
    dictionary, so a value with most of the rows counts as one. Values without a number are left out.
    """
    keys = keys or []
    seen = rows.where("value IS NOT NULL").select("dt_date", *keys, "value").distinct()
    placed = seen.join(dictionary, "value")
    return placed.groupBy("dt_date", *keys, "part", F.bitmap_bucket_number("position").alias("block")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("position")).alias("bits")
    )


def merge_sets(sets: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, distinct) over all given days: bitmaps of one block are united, then their bits are counted."""
    blocks = sets.groupBy(*keys, "part", "block").agg(F.bitmap_or_agg("bits").alias("bits"))
    return blocks.groupBy(*keys).agg(F.sum(F.bitmap_count("bits")).alias("distinct"))


def rolling_distinct(sets: DataFrame, days: int, keys: list[str] | None = None) -> DataFrame:
    """(dt_date, keys, distinct): for each day with rows, the distinct values of it and the `days - 1` days before."""
    keys = keys or []
    asked = sets.select(*keys, F.col("dt_date").alias("asked")).distinct()
    reach = F.sequence("dt_date", F.date_add("dt_date", days - 1))
    spread = sets.select("*", F.explode(reach).alias("asked")).drop("dt_date")
    blocks = spread.groupBy("asked", *keys, "part", "block").agg(F.bitmap_or_agg("bits").alias("bits"))
    same = F.col("l.asked") == F.col("r.asked")
    for key in keys:
        same = same & F.col(f"l.{key}").eqNullSafe(F.col(f"r.{key}"))
    wanted = blocks.alias("l").join(asked.alias("r"), same, "left_semi")
    counted = wanted.groupBy("asked", *keys).agg(F.sum(F.bitmap_count("bits")).alias("distinct"))
    return counted.withColumnRenamed("asked", "dt_date")


def daily_sketches(rows: DataFrame, keys: list[str] | None = None, sharpness: int = SHARPNESS) -> DataFrame:
    """Rows (dt_date, keys, sketch) of the values of each day."""
    return rows.groupBy("dt_date", *(keys or [])).agg(F.theta_sketch_agg("value", sharpness).alias("sketch"))


def visitor_flow(
    sketches: DataFrame, before: tuple[str, str], after: tuple[str, str], keys: list[str] | None = None, sharpness: int = SHARPNESS
) -> DataFrame:
    """(keys, new, returning, lost, error) of two ranges of days, first and last day included, from sketches per day.

    `new` is only in the later range, `returning` in both, `lost` only in the earlier. Each number is off by more than
    `error` in about one case of twenty; error 0 means exact, which holds while both ranges together fit the sketch.
    """

    def union_of(days: tuple[str, str]):
        inside = F.col("dt_date").between(F.lit(days[0]).cast("date"), F.lit(days[1]).cast("date"))
        return F.theta_union_agg(F.when(inside, F.col("sketch")), sharpness)

    asked = F.col("dt_date").between(F.lit(min(before[0], after[0])).cast("date"), F.lit(max(before[1], after[1])).cast("date"))
    both = sketches.where(asked).groupBy(*(keys or [])).agg(union_of(before).alias("a"), union_of(after).alias("b"))
    all_seen = F.theta_sketch_estimate(F.theta_union("a", "b", sharpness))
    error = F.when(all_seen < 2**sharpness, F.lit(0.0)).otherwise(2 * all_seen / 2 ** (sharpness / 2))
    return both.select(
        *(keys or []),
        F.theta_sketch_estimate(F.theta_difference("b", "a")).alias("new"),
        F.theta_sketch_estimate(F.theta_intersection("a", "b")).alias("returning"),
        F.theta_sketch_estimate(F.theta_difference("a", "b")).alias("lost"),
        error.alias("error"),
    )
