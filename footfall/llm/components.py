"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import stored


def _towards(edges: DataFrame, low: DataFrame) -> DataFrame:
    """Each edge (a, b) with `m`, the least node that a sees; a busy `a` is a skewed join, which Spark splits."""
    return edges.join(low, "a")


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b: long); root is the least node that it reaches.

    Self edges and repeats are allowed. Every round is written to the shared folder, so a lost executor
    costs one round. Empty edges give an empty table.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e, seen = stored(e, "edges"), None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            break
        seen = now
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = _towards(both, low).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = _towards(large, low)
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        e = stored(small.distinct(), "edges")
    star = e.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    roots = e.select(F.col("b").alias("node")).distinct().join(star, "node", "left_anti")
    return star.unionByName(roots.select("node", F.col("node").alias("root")))
