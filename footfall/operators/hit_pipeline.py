"""From raw hits to stored page views in one flow, the same for files and streams.

Parse, client details, place, agent, consent and address, refusal, visit, cleaning, append. A hit's row depends
on that hit alone: its id and its visit are keyed hashes, so a stream and a batch over the same hits
store the same rows, and a hit that is delivered twice is stored once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from footfall.functions.agents import enrich_agents
from footfall.functions.hashes import anonymous_visit_id
from footfall.functions.text import as_column
from footfall.functions.times import day_of
from footfall.operators import ingest
from footfall.operators.joins import geo_lookup
from footfall.operators.lifecycle import append_new, stored_keys
from footfall.schema import PAGEVIEW
from footfall.session import scratch_path
from footfall.sources.membership import ensure_filters
from footfall.sources.tables import drop_path, exists, folder_bytes, folders
from footfall.streaming.runs import run_for_each

#: What a hit's id is made of, as received.
HIT_KEY = ["received", "ip", "user_agent", "res", "fh"]
#: Days between a hit's day in this session's time zone and the day that a session of another zone stored it under.
ZONES = 2
#: Page views of a stream wait until they take so many bytes or come from so many batches; then they are stored together.
WAITING_BYTES, WAITING_BATCHES = 256 << 20, 100
#: The batch that brought a waiting hit.
BATCH = "_batch"
#: Text columns that are links; the others are stripped of markup.
LINKS = ("resource", "referer", "outbound_resource")


def strip_markup(column) -> Column:
    """Text without tags; links lose control signs, white space and quotes instead."""
    return F.trim(F.regexp_replace(as_column(column), "<[^>]*>", ""))


def clean_link(column) -> Column:
    return F.regexp_replace(as_column(column), "[\\x00-\\x20\"'<>]", "")


def cleaned(rows: DataFrame) -> DataFrame:
    """Every text value made safe to show."""
    texts = {f.name for f in rows.schema.fields if f.dataType == T.StringType()}
    return rows.select(
        *[(clean_link(c) if c in LINKS else strip_markup(c)).alias(c) if c in texts else F.col(c) for c in rows.columns]
    )


def hit_id(columns: list) -> Column:
    """A positive number out of what was received."""
    return F.xxhash64(*columns).bitwiseAND(F.lit((1 << 63) - 1))


def page_rows(hits: DataFrame, policy: ingest.Policy, ranges: DataFrame) -> DataFrame:
    """Page views out of parsed hits (`sources.hits.parse_hits`), with `reject_code`; other kinds of hits are left out.

    Hits may carry further columns, among them username, email, consent and dnt.
    """
    pages = hits.withColumn("kind", ingest.hit_kind([policy.site_host, *policy.own_hosts])).where("kind = 'pageview'")
    pages = ingest.client_info(pages.withColumn("info", ingest.content_info("ci")))
    pages = pages.select(
        "*",
        F.col("received").alias("dt"),
        F.col("res").alias("resource"),
        F.col("ref").alias("referer"),
        F.lit(None).cast("string").alias("notes"),
        F.col("info.content_type").alias("content_type"),
        F.col("info.category").alias("category"),
        F.col("info.content_id").alias("content_id"),
        F.col("info.author").alias("author"),
    ).drop("info", "kind", "id")
    pages = ingest.clean_referer(ingest.stored_resource(pages), policy)
    pages = geo_lookup(pages, ranges).withColumnsRenamed({"geo_country": "country", "geo_city": "city", "geo_location": "location"})
    pages = enrich_agents(pages)
    salt = F.date_format(F.timestamp_seconds("dt"), "yyyy-MM-dd")
    judged = ingest.with_reject_code(pages, policy)
    visit = anonymous_visit_id("fingerprint", "ip", "user_agent", "dt", policy.secret, salt)
    judged = judged.withColumn("id", hit_id(HIT_KEY)).withColumn("visit_id", visit)
    given = lambda c: F.col(c) if c in judged.columns else F.lit(False)
    if "other_ip" not in judged.columns:
        judged = judged.withColumn("other_ip", F.lit(None).cast("string"))
    identify = ingest.may_identify(policy, given("consent"), given("dnt"))
    return cleaned(ingest.stored_address(judged, policy, identify, salt))


def as_pageviews(rows: DataFrame) -> DataFrame:
    """Accepted rows in the layout of the stored table."""
    kept = rows.where("reject_code IS NULL")
    return kept.select(
        *[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in PAGEVIEW.fields]
    )


def earliest(rows: DataFrame, order: str) -> DataFrame:
    """Of rows with one id the one with the least `order`."""
    place = F.row_number().over(Window.partitionBy("id").orderBy(order))
    return rows.withColumn("place_", place).where("place_ = 1").drop("place_")


def store_hits(hits: DataFrame, path: str, policy: ingest.Policy, ranges: DataFrame, order: str | None = None) -> None:
    """Append the page views among parsed hits to a stored table; ids that it holds are skipped.

    The hits are read and parsed once: page views are staged in the shared folder, since addresses and agents are looked up
    beside the rows themselves. A hit's id and day are told by what was received, so equal hits and those that the table holds
    go before anything is looked up for them; if none are left, nothing more is done. Of accepted hits with one id one is
    stored, with an `order` column the first.
    """
    spark, stage = hits.sparkSession, scratch_path(hits.sparkSession, "page-hits")
    pages = hits.where(ingest.is_pageview())
    if "map<" not in pages.schema.simpleString():  # maps can't be compared
        told = [c for c in pages.columns if c != order]
        pages = pages.groupBy(*told).agg(F.min(order).alias(order)) if order else pages.dropDuplicates()
    pages.write.parquet(stage)
    staged, stages = spark.read.schema(pages.schema).parquet(stage), [stage]
    known, stored = None, exists(spark, path)
    if stored:
        ensure_filters(spark, path, PAGEVIEW["id"])
        ids = staged.select(hit_id(HIT_KEY).alias("id"), day_of("received").alias("dt_date")).distinct()
        known = stored_keys(ids, path, near=ZONES)
    if known is not None:
        stages.append(scratch_path(spark, "new-hits"))
        staged.join(known, hit_id([staged[c] for c in HIT_KEY]) == known["id"], "left_anti").write.parquet(stages[-1])
        staged = spark.read.schema(pages.schema).parquet(stages[-1])
    if not stored or not staged.isEmpty():
        rows = page_rows(staged, policy, ranges)
        if order:
            rows = earliest(rows.where("reject_code IS NULL"), order)
        append_new(as_pageviews(rows), path, unknown=True)
    for stage in stages:
        drop_path(spark, stage)


def stream_store_hits(spark: SparkSession, hits: DataFrame, path: str, policy: ingest.Policy, ranges: DataFrame, folder: str) -> None:
    """The same for a stream of hits. `folder` is the stream's own; a repeated batch appends nothing twice.

    A batch puts its page views aside in `folder`: one job without a shuffle. Looking up, enriching and appending take some dozens
    of stages whatever the number of rows, each with plans, threads and figures that the driver keeps for a while, so what
    waits is stored together, when it is much and at the end of a run. What a run that broke off left is stored by the next one.
    """
    waiting, waits = f"{folder}/page-hits", []
    schema = T.StructType([*hits.schema.fields, T.StructField(BATCH, T.LongType())])

    def store_waiting() -> None:
        batches = [f"{waiting}/{name}" for name in folders(spark, waiting)]
        if batches:
            store_hits(spark.read.schema(schema).parquet(*batches), path, policy, ranges, BATCH)
        for batch in batches:
            drop_path(spark, batch)
        waits.clear()

    def put_aside(batch: DataFrame, number: int) -> None:
        aside = f"{waiting}/{number}"  # of a repeated batch: the same hits again
        batch.where(ingest.is_pageview()).withColumn(BATCH, F.lit(number).cast("long")).write.mode("overwrite").parquet(aside)
        waits.append(folder_bytes(spark, aside))
        if sum(waits) >= WAITING_BYTES or len(waits) >= WAITING_BATCHES:
            store_waiting()

    run_for_each(hits, folder, put_aside)
    store_waiting()
