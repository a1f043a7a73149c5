"""Updates that arrive later, and rows behind the watermark.

The streams answer for what their watermark has passed. A nightly pass adds what is still open, and days with rows behind
the watermark, from the stored rows of these days alone.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.operators.deltas import append_updates
from footfall.operators.visits import gap_starts, visits_of
from footfall.schema import DAY, SESSION_SECONDS
from footfall.session import checkpointed
from footfall.sources.tables import first_day, folders, with_day
from footfall.streaming.live import MINUTE, ONLINE, online_numbers, stored_changes
from footfall.streaming.runs import run_for_each


def stream_updates(spark: SparkSession, updates: DataFrame, path: str, folder: str) -> None:
    """Store a stream of updates beside the page views, batch by batch; `deltas.read_current` reads both, `deltas.compact` folds them.

    `folder` is the stream's own. A micro-batch writes its own rows only. A batch that is repeated after a failure, or a stream that is started
    again, replaces the batch of the same number.
    """
    run_for_each(updates, folder, lambda batch, number: append_updates(spark, path, batch, number))


def split_late(hits: DataFrame, folder: str, delay: int = 3600) -> None:
    """Write the rows of a stream of hits (with ts) that come more than `delay` seconds behind the newest row of the batches before.

    They go to `folder`/late by day; `late_days` reads which days they touch. Each batch leaves its newest time, so that a stream
    which is started again goes on, and a repeated batch replaces its own rows.
    """
    spark = hits.sparkSession

    def work(batch: DataFrame, number: int) -> None:
        marks = [int(n) for n in folders(spark, f"{folder}/newest") if n.isdigit()]
        earlier = [f"{folder}/newest/{n:012d}" for n in marks if n < number]
        newest = spark.read.schema("newest long").parquet(*earlier).agg(F.max("newest")).first()[0] if earlier else None
        now = batch.agg(F.max(F.unix_timestamp("ts")).alias("newest"))
        if newest is not None:
            behind = batch.where(F.unix_timestamp("ts") < newest - delay)
            behind = behind.withColumn("dt_date", F.to_date("ts"))
            behind.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("dt_date").parquet(f"{folder}/late/{number:012d}")
        now.write.mode("overwrite").parquet(f"{folder}/newest/{number:012d}")

    run_for_each(hits, folder, work)


def late_days(spark: SparkSession, folder: str) -> list:
    """The days of all rows that `split_late` has put aside: folder names, no rows are read."""
    found = {d for batch in folders(spark, f"{folder}/late") for d in folders(spark, f"{folder}/late/{batch}")}
    return sorted(dt.date.fromisoformat(d.split("=")[1]) for d in found if d.startswith("dt_date="))


def daily_counts(hits: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Hits per day of a stream, for days that the watermark has passed; rows behind the watermark are not counted."""
    counted = hits.withWatermark("ts", watermark).groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("hits"))
    return counted.select(F.to_date("window.start").alias("dt_date"), "hits")


def _to_recount(streamed: DataFrame, late: list) -> Column:
    """Days that the stream can't answer for: those with late rows, and those after its last one."""
    last = streamed.agg(F.max("dt_date")).first()[0]
    open_days = F.lit(True) if last is None else F.col("dt_date") > F.lit(last)
    return open_days | F.col("dt_date").isin(late) if late else open_days


def corrected_counts(streamed: DataFrame, stored: DataFrame, late: list) -> DataFrame:
    """(dt_date, hits, streamed) after the nightly pass: closed days as the stream counted them, others from the stored rows.

    `late` are the days with late rows (`late_days`). Of the stored table, which has every row, only these days and the
    open ones are read; `streamed` is what the stream had said, null for an open day.
    """
    asked = _to_recount(streamed, late)
    again = with_day(stored).where(asked).groupBy("dt_date").agg(F.count("*").alias("hits"))
    said = streamed.select("dt_date", F.col("hits").alias("streamed"))
    kept = said.where(~asked).select("dt_date", F.col("streamed").alias("hits"), "streamed")
    return kept.unionByName(again.join(said, "dt_date", "left").select("dt_date", "hits", "streamed"))


def corrected_visits(streamed: DataFrame, hits: DataFrame, key: str, gap: int = SESSION_SECONDS) -> DataFrame:
    """(key, start, end, hits, closed): the streamed visits and, from the stored hits (key, dt, id), those still open in the stream.

    A key's visits end in order, so all hits behind its last streamed end belong to visits that the
    stream has not closed yet. The hits of the last day before the stream's newest end are read, and twice as many days
    as long as an open visit may have begun before them.
    """
    newest, reach = streamed.agg(F.max("end")).first()[0], DAY
    while True:
        edge = None if newest is None else newest - reach
        done, tail = streamed, hits
        if edge is not None:
            done, tail = streamed.where(F.col("end") > edge), hits.where(F.col("dt") > edge)
            tail = tail.where(F.col("dt_date") >= first_day(edge)) if "dt_date" in hits.columns else tail
        done = done.groupBy(F.col(key).alias("done_key")).agg(F.max("end").alias("done"))
        tail = tail.join(done, F.col(key).eqNullSafe(F.col("done_key")), "left").where("done IS NULL OR dt > done")
        open_visits = checkpointed(visits_of(gap_starts(tail.select(key, "dt", "id"), key, gap), key))
        if edge is None or open_visits.where(F.col("start") < edge + gap).isEmpty() or hits.where(F.col("dt") <= edge).isEmpty():
            break
        reach *= 2
    first, second = (rows.select(key, "start", "end", "hits", F.lit(closed).alias("closed")) for rows, closed in ((streamed, True), (open_visits, False)))
    return first.unionByName(second)


def corrected_minutes(streamed: DataFrame, stored: DataFrame, count: Callable[[DataFrame], DataFrame], minute: str = "minute") -> DataFrame:
    """The streamed minutes (`closed`) and, by `count` over the stored hits (dt) after the last of them, the others."""
    last = streamed.agg(F.max(minute)).first()[0]
    rest = stored
    if last is not None:
        rest = stored.where(F.col("dt") >= last + 60)
        rest = rest.where(F.col("dt_date") >= first_day(last + 60)) if "dt_date" in rest.columns else rest
    return streamed.withColumn("closed", F.lit(True)).unionByName(count(rest).select(*streamed.columns, F.lit(False).alias("closed")))


def corrected_online(changes: DataFrame, stored: DataFrame, visit: str = "visit_id") -> DataFrame:
    """(minute, online, closed): from the stream's changes where its watermark has passed, from the stored hits (visit, dt) behind that.

    Who is online at a minute was seen in the thirty minutes before, so no older hits are read.
    """
    upto = changes.agg(F.max("watermark")).first()[0] or 0
    said = online_numbers(changes.where(F.col("minute") < upto)).where(F.col("minute") < upto)
    reach = upto - (ONLINE + 1) * MINUTE
    rest = stored.where(F.col("dt") >= reach)
    rest = rest.where(F.col("dt_date") >= first_day(reach)) if "dt_date" in rest.columns else rest
    open_minutes = online_numbers(stored_changes(rest, visit)).where(F.col("minute") >= upto)
    return said.withColumn("closed", F.lit(True)).unionByName(open_minutes.withColumn("closed", F.lit(False)))
