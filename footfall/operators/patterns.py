"""Long lists of wildcard patterns as a table, met by equality.

A value can only match a pattern if it holds every literal piece of it. So the rarest gram (up to three characters of a
literal piece) of a pattern is its key; distinct values meet it by their own grams, and only those that meet are matched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_GRAM = 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _folded(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def _grams(text: Column, size: Column) -> Column:
    """Distinct substrings of `size` characters; none of a shorter text."""
    starts = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, size)))


def read_patterns(patterns: DataFrame) -> DataFrame:
    """(pattern, regex, size, grams, least, whole) of each distinct pattern that isn't blank.

    `*` stands for any text, `!` for one character. `size` is the length of the grams, 0 for a pattern without literals;
    `least` counts the characters it asks for, `whole` tells that it has no `*`.
    """
    rows = patterns.select(F.trim("pattern").alias("pattern")).where("pattern <> ''").distinct()
    quoted = F.regexp_replace("pattern", r"([\p{Punct}\s&&[^*!]])", r"\\$1")
    body = F.replace(F.replace(quoted, F.lit("!"), F.lit(".")), F.lit("*"), F.lit(".*"))
    pieces = F.split(_folded(F.col("pattern")), "[*!]")
    size = F.least(F.array_max(F.transform(pieces, F.length)), F.lit(_GRAM))
    grams = F.flatten(F.transform(pieces, lambda x: _grams(x, size)))
    return rows.select(
        "pattern", F.concat(F.lit("(?i)^("), body, F.lit(")$")).alias("regex"), size.alias("size"), F.when(size > 0, F.array_distinct(grams)).alias("grams"),
        F.length(F.replace("pattern", F.lit("*"), F.lit(""))).alias("least"), (~F.contains("pattern", F.lit("*"))).alias("whole"),
    )


def matching_values(values: DataFrame, patterns: DataFrame) -> DataFrame:
    """The distinct `value`s that match at least one `pattern`, by case only in letters outside A to Z. Nulls match none."""
    listed = read_patterns(patterns)
    known = values.select("value").where("value IS NOT NULL").distinct()
    facts = listed.agg(  # at most three sizes and one length come to the driver
        F.collect_set(F.when(F.col("size") > 0, F.col("size"))).alias("sizes"),
        F.min(F.when((F.col("size") == 0) & ~F.col("whole"), F.col("least"))).alias("open"),
    ).first()
    found = known.where(F.lit(False))
    if facts["sizes"]:
        own = F.flatten(F.array(*[_grams(_folded(F.col("value")), F.lit(n)) for n in sorted(facts["sizes"])]))
        asked = listed.where("size > 0").select("regex", F.explode("grams").alias("gram"))
        held = known.select("value", F.explode(own).alias("gram")).join(asked.select("gram").distinct(), "gram")
        often = held.groupBy("gram").agg(F.count("*").alias("n"))
        # a gram that no value holds rules its pattern out
        keys = asked.join(often, "gram", "left").groupBy("regex").agg(
            F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"), F.count_if(F.col("n").isNull()).alias("lacking")
        )
        candidates = held.join(keys.where("lacking = 0").drop("lacking"), "gram")
        found = found.unionByName(candidates.where(F.expr("value RLIKE regex")).select("value"))
    if facts["open"] is not None:
        found = found.unionByName(known.where(F.col("value").rlike(f"^.{{{facts['open']},}}$")))
    # patterns of `!` alone ask for a length; a line end at the end of a value doesn't count
    lengths = listed.where("size = 0 AND whole").select("least", "regex").distinct()
    near = F.sequence(F.greatest(F.length("value") - 2, F.lit(0)), F.length("value"))
    sized = known.select("value", F.explode(near).alias("least")).join(lengths, "least")
    found = found.unionByName(sized.where(F.expr("value RLIKE regex")).select("value"))
    return found.distinct()


def in_pattern_table(df: DataFrame, patterns: DataFrame, columns: list[str], name: str) -> DataFrame:
    """Add the boolean `name`: one of the row's `columns` matches one of many `patterns` (column pattern), which come as a table."""
    asked = df.select(F.explode(F.array(*columns)).alias("value"))
    listed = matching_values(asked, patterns)
    flags = []
    for i, column in enumerate(columns):
        flags.append(f"listed{i}_")
        one = listed.select(F.col("value").alias(f"value{i}_"), F.lit(True).alias(flags[-1]))
        df = df.join(one, F.col(column) == F.col(f"value{i}_"), "left").drop(f"value{i}_")
    return df.withColumn(name, F.coalesce(*flags, F.lit(False))).drop(*flags)
