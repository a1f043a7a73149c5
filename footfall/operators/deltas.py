"""Later updates of stored page views, merged when they are read and folded into the table once per day.

A table's updates lie beside its days, by batch and day. A micro-batch writes only its own rows, a repeated batch replaces
itself, and readers fold what is there. Compaction folds the updates of whole days into the table and takes them away.
Like all jobs that rewrite days, compaction runs on its own: readers started before it ended may see an update twice or not at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.functions.times import day_of
from footfall.operators.ingest import fold_updates
from footfall.operators.lifecycle import rewrite
from footfall.sources.tables import drop_path, exists, folders, is_complete, read_pageviews, updates_path

_STAGE = "folding-upto-"


def append_updates(spark: SparkSession, path: str, updates: DataFrame, batch: int) -> None:
    """Store the updates of a batch (id, seq, fields, and page_dt, the time of the page view); the same batch again replaces them.

    Without `page_dt` the days are looked up in the table's ids; updates of unknown pages are left out then.
    """
    if "page_dt" in updates.columns:
        dated = updates.withColumn("dt_date", day_of("page_dt")).drop("page_dt")
    else:
        dated = updates.join(read_pageviews(spark, path).select("id", "dt_date"), "id")
    writer = dated.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "static")
    writer.partitionBy("dt_date").parquet(f"{updates_path(path)}/{batch:012d}")


def _batches(spark: SparkSession, path: str) -> list[str]:
    """Folders of finished batches, in order."""
    root = updates_path(path)
    return [f"{root}/{name}" for name in folders(spark, root) if name.isdigit() and is_complete(spark, f"{root}/{name}")]


def _updates(spark: SparkSession, batches: list[str]) -> DataFrame:
    """The updates of some batches; later batches count as later whatever their seq."""
    found = None
    for b in batches:
        # a batch of no rows has no files to tell columns from
        rows = spark.read.parquet(b) if folders(spark, b) else None
        if rows is not None:
            found = rows if found is None else found.unionByName(rows, allowMissingColumns=True)
    return None if found is None else found.withColumn("seq", F.struct("batch", "seq")).drop("batch")


def read_current(spark: SparkSession, path: str) -> DataFrame:
    """The stored page views with all updates; a range of days prunes both."""
    table, updates = read_pageviews(spark, path), _updates(spark, _batches(spark, path))
    return table if updates is None else fold_updates(table, updates, keys=("dt_date", "id"))


def compact(spark: SparkSession, path: str) -> None:
    """Fold all updates into their days and take them away; days without any stay as they are.

    What was folded waits under a name that says up to which batch, so a run that breaks off is finished by the next
    one and nothing is folded twice.
    """
    root = updates_path(path)
    waiting = [n for n in folders(spark, root) if n.startswith(_STAGE) and is_complete(spark, f"{root}/{n}")]
    batches = _batches(spark, path)
    last = waiting[0].removeprefix(_STAGE) if waiting else batches[-1].rsplit("/", 1)[1] if batches else ""
    taken = [b for b in batches if b.rsplit("/", 1)[1] <= last]
    updates = _updates(spark, taken)
    stage = f"{root}/{_STAGE}{last}"
    if waiting or updates is not None:
        rewrite(read_pageviews(spark, path), path, updates, lambda rows: fold_updates(rows, updates, keys=("dt_date", "id")), stage)
    for b in taken:
        drop_path(spark, b)
    if exists(spark, stage):
        drop_path(spark, stage)
