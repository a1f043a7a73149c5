"""Marks shown beside the rows of the access log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def visitor_class(rows: DataFrame, from_search_engine: Column) -> DataFrame:
    """`traffic` (search-engine, direct or bot) and `person` (known-user, known-visitor or NULL)."""
    traffic = (
        F.when(from_search_engine, F.lit("search-engine"))
        .when(F.col("browser_type") != 1, F.lit("direct"))
        .otherwise(F.lit("bot"))
    )
    person = F.when(F.contains(F.col("notes"), F.lit("user:")), F.lit("known-user")).when(
        F.col("username") != "", F.lit("known-visitor")
    )
    return rows.withColumn("traffic", traffic).withColumn("person", person)
