"""Streams over several micro-batches against the batch operators."""

import base64
import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from footfall.operators import hit_pipeline, ingest
from footfall.operators import visits as batch
from footfall.session import scratch_path
from footfall.sources import tables
from footfall.sources.hits import RAW, read_hits, stream_hits
from footfall.streaming import late, live, visits
from footfall.streaming.runs import run_to_table

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("visitor", T.StringType()), T.StructField("dt", T.LongType())])


def arriving(spark, files=4):
    """Hits in time order, in several files, read one file per micro-batch."""
    rng, base = random.Random(11), 1704067200
    rows = sorted((base + rng.randrange(20000), "hot" if rng.random() < 0.5 else f"k{rng.randrange(3)}") for _ in range(800))
    hits = [(i + 1, key, t) for i, (t, key) in enumerate(rows)]
    path = scratch_path(spark, "inbox")
    size = len(hits) // files
    for f in range(files):
        part = hits[f * size:] if f == files - 1 else hits[f * size:(f + 1) * size]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    return spark.createDataFrame(hits, SCHEMA), stream


def test_fixed_visits_over_batches(spark):
    whole, stream = arriving(spark)
    want = {(r.visitor, r.dt, r.start, r.hits) for r in batch.fixed_starts(whole, "visitor", 700).collect()}
    parts = run_to_table(visits.fixed_visits(stream, "visitor", 700), scratch_path(spark, "fixed"))
    got = parts.groupBy("key", "dt", "start").agg(F.sum("hits").alias("hits")).collect()
    assert {(r.key, r.dt, r.start, r.hits) for r in got} == want


def test_repeats_over_batches(spark):
    whole, stream = arriving(spark)
    want = {r.id for r in batch.drop_repeats(whole, ["visitor"], 400).select("id").collect()}
    assert {r.id for r in run_to_table(visits.drop_repeats(stream, ["visitor"], 400), scratch_path(spark, "repeats")).collect()} == want


def one_by_one(spark, rows, schema=SCHEMA):
    """A stream that gets each of some lists of rows in a micro-batch of its own."""
    path = scratch_path(spark, "late")
    for r in rows:
        spark.createDataFrame(r, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def by_day(spark, rows):
    path = scratch_path(spark, "by-day")
    tables.append_rows(spark.createDataFrame(rows, SCHEMA), path)
    return spark.read.parquet(path)


def test_late_rows_are_added_by_the_nightly_pass(spark):
    day = 86400
    # The late row comes last: rows are dropped by the watermark of the batch before.
    times = [10, day + 5, 5 * day, 5 * day + 60, 5 * day + 120, 20]
    rows = [(i, "a", 1704067200 + t) for i, t in enumerate(times)]
    stream = one_by_one(spark, [[r] for r in rows]).withColumn("ts", F.timestamp_seconds("dt"))
    streamed = run_to_table(late.daily_counts(stream), scratch_path(spark, "days"))
    folder = scratch_path(spark, "aside")
    late.split_late(stream, folder)
    late.split_late(stream, folder)  # goes on where it ended
    days = late.late_days(spark, folder)
    assert [str(d) for d in days] == ["2024-01-01"]
    stored = by_day(spark, rows)
    counted = late.corrected_counts(streamed, stored, days)
    assert {str(r.dt_date): (r.hits, r.streamed) for r in counted.collect()} == {"2024-01-01": (2, 1), "2024-01-02": (1, 1), "2024-01-06": (3, None)}
    # the second day isn't read again: what it holds by now doesn't matter
    changed = by_day(spark, [*rows, (9, "b", 1704067200 + day + 7)])
    assert {str(r.dt_date): r.hits for r in late.corrected_counts(streamed, changed, days).collect()}["2024-01-02"] == 1
    assert re.search(r"PartitionFilters: \[[^\]]*dt_date", counted._jdf.queryExecution().executedPlan().toString())


def spells(rows):
    """Per visit the merged online intervals [from, to) in minutes."""
    found = {}
    for _, visit, t in rows:
        found.setdefault(visit, set()).add(t // 60)
    out = {}
    for visit, minutes in found.items():
        out[visit] = sorted({m + n for m in minutes for n in range(1, 31)})
    return out


def online(rows):
    seen = {}
    for minutes in spells(rows).values():
        for m in minutes:
            seen[m * 60] = seen.get(m * 60, 0) + 1
    return seen


def test_online_numbers_are_the_sum_of_changes(spark):
    rng, base = random.Random(4), 1704067200 + 80000  # crosses midnight
    rows = [(i, f"v{rng.randrange(6)}", base + rng.choice([0, 9000, 2 * 86400]) + rng.randrange(9000)) for i in range(400)]
    rows.sort(key=lambda r: r[2] + rng.randrange(1800))  # out of order by less than the watermark
    parts = [rows[i : i + 50] for i in range(0, 400, 50)] + [[(999, "end", base + 4 * 86400)]]
    stream = one_by_one(spark, parts).withColumn("ts", F.timestamp_seconds("dt")).withColumnRenamed("visitor", "visit_id")
    changes = run_to_table(live.online_changes(stream), scratch_path(spark, "changes"))
    want = online(rows)
    said = changes.where("visit <> 'end'")
    assert {r.minute: r.online for r in live.online_numbers(said).collect()} == want
    stored = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("visitor", "visit_id")
    assert {r.minute: r.online for r in live.online_numbers(live.stored_changes(stored)).collect()} == want
    # what the watermark hasn't passed comes from the stored hits
    every = stored.unionByName(spark.createDataFrame([(999, "end", base + 4 * 86400)], SCHEMA).withColumnRenamed("visitor", "visit_id"))
    got = late.corrected_online(changes, every).collect()
    assert {r.minute: r.online for r in got} == online([*rows, (999, "end", base + 4 * 86400)])
    assert {r.closed for r in got} == {True, False}


def test_a_visit_costs_two_changes_however_many_hits(spark):
    base = 1704067200
    rows = [(i, "busy", base + i * 20) for i in range(3000)] + [(9000, "other", base + 5 * 86400)]
    stream = one_by_one(spark, [rows[:1500], rows[1500:3000], rows[3000:]]).withColumn("ts", F.timestamp_seconds("dt")).withColumnRenamed("visitor", "visit_id")
    folder = scratch_path(spark, "changes")
    changes = run_to_table(live.online_changes(stream), folder)
    assert sorted((r.minute, r.change) for r in changes.where("visit = 'busy'").collect()) == [(base + 60, 1), (base + 2999 * 20 // 60 * 60 + 31 * 60, -1)]
    state = spark.read.format("statestore").load(f"{folder}/checkpoint")
    assert state.count() == 1  # the visit that is over has no state left


def test_spells_move_and_join():
    minute = lambda *m: [60 * x for x in m]
    assert live.merged_spells([], minute(5, 6, 36, 67)) == [(300, 36 * 60), (67 * 60, 67 * 60)]
    assert live.merged_spells([(300, 300), (3600, 3600)], minute(34)) == [(300, 3600)]
    assert live.merged_spells([(3600, 3600)], minute(1)) == [(60, 60), (3600, 3600)]


def test_visits_that_stay_open_for_days(spark):
    """The pass reads back as far as an open visit began, and no further."""
    base, day = 1704067200, 86400
    rows = [(i, "long", base + 10 * day + i * 1500) for i in range(400)]  # seven days without rest
    rows += [(1000 + i, "a", base + i * day) for i in range(17)] + [(2000, "new", base + 16 * day + 4000)]
    streamed = [("a", base + i * day, base + i * day, 1) for i in range(16)]
    streamed = spark.createDataFrame(streamed, "visitor string, start long, end long, hits long")
    got = late.corrected_visits(streamed, by_day(spark, rows), "visitor").collect()
    assert {(r.visitor, r.start, r.hits) for r in got if not r.closed} == {("long", base + 10 * day, 400), ("a", base + 16 * day, 1), ("new", base + 16 * day + 4000, 1)}
    assert sum(r.closed for r in got) == 16


def test_a_silent_stream_shows(spark, sf_dir, monkeypatch):
    """With streams that emit nothing, no streaming query gives its right answer."""
    from checks import streaming

    silent = lambda stream, folder: spark.createDataFrame([], stream.schema)
    for name in ("stream_sessions", "stream_online", "stream_minute_series", "stream_late_rows"):
        query = getattr(streaming, name)
        mark = "streamed IS NOT NULL" if name == "stream_late_rows" else "closed"
        assert query(spark, sf_dir).where(mark).count() > 0
        with monkeypatch.context() as m:
            m.setattr(streaming, "run_to_table", silent)
            assert query(spark, sf_dir).where(mark).count() == 0


def test_a_stream_goes_on_where_it_ended(spark):
    whole, _ = arriving(spark)
    path, folder = scratch_path(spark, "grows"), scratch_path(spark, "stream")
    rows = whole.orderBy("id").collect()
    for part in (rows[:300], rows[300:301], rows[301:]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(SCHEMA).parquet(path)
        got = run_to_table(visits.fixed_visits(stream, "visitor", 700), folder)
    found = got.groupBy("key", "dt", "start").agg(F.sum("hits").alias("hits")).collect()
    want = {(r.visitor, r.dt, r.start, r.hits) for r in batch.fixed_starts(whole, "visitor", 700).collect()}
    assert {(r.key, r.dt, r.start, r.hits) for r in found} == want


def test_null_keys_have_a_state_of_their_own(spark):
    rows = [(1, None, 100), (2, "", 105), (3, None, 110), (4, "", 900), (5, None, 905)]
    path = scratch_path(spark, "nulls")
    for r in rows:
        spark.createDataFrame([r], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    got = run_to_table(visits.fixed_visits(stream, "visitor", 700), scratch_path(spark, "null-visits"))
    assert {(r.key, r.dt, r.start) for r in got.collect()} == {(None, 100, 100), ("", 105, 105), (None, 110, 100), ("", 900, 900), (None, 905, 905)}
    whole = spark.createDataFrame(rows, SCHEMA)
    assert {(r.visitor, r.dt, r.start) for r in batch.fixed_starts(whole, "visitor", 700).collect()} == {(r.key, r.dt, r.start) for r in got.collect()}
    gaps = {(r.visitor, r.dt, r.start) for r in batch.gap_starts(whole, "visitor", 700).collect()}
    assert (None, 110, 100) in gaps and ("", 900, 900) in gaps and len(gaps) == 5


def test_state_is_dropped_behind_the_watermark(spark):
    path, folder = scratch_path(spark, "ends"), scratch_path(spark, "ending")
    for i, t in enumerate((0, 100_000, 200_000)):
        spark.createDataFrame([(i, f"k{i}", 1704067200 + t)], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    stream = visits.fixed_visits(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path), "visitor", 700)
    writer = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint")
    query = writer.option("path", f"{folder}/out").trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] < 3


def test_visits_share_their_state(spark):
    """Many visits are a few groups, each with one state; the number of groups changes no change."""
    rng, base = random.Random(5), 1704067200
    rows = [(i, f"v{rng.randrange(300)}", base + i * 20) for i in range(1200)]
    stream = one_by_one(spark, [rows[i : i + 300] for i in range(0, 1200, 300)]).withColumn("ts", F.timestamp_seconds("dt")).withColumnRenamed("visitor", "visit_id")
    said = []
    for groups in (4, 1_000_000):
        folder = scratch_path(spark, "shared")
        changes = run_to_table(live.online_changes(stream, groups=groups), folder)
        said.append(sorted((r.visit, r.minute, r.change) for r in changes.collect()))
        open_visits = spark.read.format("statestore").load(f"{folder}/checkpoint").count()
        assert open_visits <= 4 if groups == 4 else open_visits > 50
    assert said[0] == said[1] and len(said[0]) > 300


def hit(i, kind="post", own="", referer="https://one.org/"):
    """A raw hit: `i` tells its time and address, so its id; `own` is the id that a browser gives a follow-up."""
    code = lambda text: base64.b64encode(text.encode()).decode().translate(str.maketrans("+/=", "._-"))
    payload = '{"res":"%s","ref":"%s","fh":"f%d","ci":"%s"%s}' % (
        code("https://example.com/a"), code(referer), i, code('{"content_type":"%s"}' % kind), f',"id":"{own}"' if own else "")
    return (1704067200 + 7200 * i, f"10.0.0.{i % 5}", "Mozilla/5.0 (X11; Linux x86_64; rv:109.0) Gecko/20100101 Firefox/115.0", payload)


def delivered(spark, files):
    """Raw hits in JSON files, each read by a micro-batch of its own, in order."""
    path = scratch_path(spark, "raw")
    for rows in files:
        spark.createDataFrame(rows, RAW).coalesce(1).write.mode("append").json(path)
    return path


def places(spark):
    layout = "low long, high long, country_code string, city string, subdivision string, latitude double, longitude double"
    return spark.createDataFrame([(0, 1, "us", "", "", 0.0, 0.0)], layout)


def counted(monkeypatch, name):
    """The calls of one of the hit pipeline's steps."""
    calls, step = [], getattr(hit_pipeline, name)
    monkeypatch.setattr(hit_pipeline, name, lambda *given, **more: calls.append(name) or step(*given, **more))
    return calls


FILES = [[hit(i) for i in range(n, n + 4)] + [hit(n, own="7"), hit(n)] for n in range(0, 14, 2)]  # neighbours share hits


@pytest.mark.parametrize("batches, bytes_, rounds", [(100, 1 << 30, 1), (3, 1 << 30, 3), (100, 1, 7)])
def test_batches_wait_and_are_stored_together(spark, monkeypatch, batches, bytes_, rounds):
    """Places and agents are looked up once for all that waits, not once per micro-batch; the rows are those of a batch."""
    path, whole, folder, table = delivered(spark, FILES), scratch_path(spark, "whole"), scratch_path(spark, "hits"), scratch_path(spark, "table")
    hit_pipeline.store_hits(read_hits(spark, path), whole, ingest.Policy(), places(spark))
    monkeypatch.setattr(hit_pipeline, "WAITING_BATCHES", batches)
    monkeypatch.setattr(hit_pipeline, "WAITING_BYTES", bytes_)
    stored, enriched = counted(monkeypatch, "store_hits"), counted(monkeypatch, "page_rows")
    for _ in range(2):
        hit_pipeline.stream_store_hits(spark, stream_hits(spark, path, 1), table, ingest.Policy(), places(spark), folder)
    assert len(stored) == len(enriched) == rounds
    got, want = [sorted(map(repr, tables.read_pageviews(spark, p).collect())) for p in (table, whole)]
    assert got == want and len(got) == 16
    assert tables.folders(spark, f"{folder}/page-hits") == []


@pytest.mark.parametrize("broken", ["append_new", "drop_path"])
def test_waiting_hits_outlive_a_broken_run(spark, monkeypatch, broken):
    """What the stream has read is stored by the next run, though no file is new, and once."""
    path, folder, table = delivered(spark, FILES[:2]), scratch_path(spark, "hits"), scratch_path(spark, "table")
    run = lambda: hit_pipeline.stream_store_hits(spark, stream_hits(spark, path, 1), table, ingest.Policy(), places(spark), folder)

    def fail(*_, **__):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(hit_pipeline, broken, fail)
        with pytest.raises(RuntimeError, match="lost"):
            run()
    for _ in range(2):
        run()
    assert sorted(r.fingerprint for r in tables.read_pageviews(spark, table).collect()) == [f"f{i}" for i in range(6)]


def test_of_unlike_hits_with_one_id_the_first_accepted_is_stored(spark):
    """Also where batches wait together; a refused hit hides none that comes later."""
    files = [[hit(1, "secret"), hit(2, referer="https://b.org/")], [hit(1, referer="https://z.org/"), hit(2)], [hit(1), hit(2, "secret")], [hit(2)]]
    path, table = delivered(spark, files), scratch_path(spark, "table")
    policy = ingest.Policy(ignore_content_types="secret")
    hit_pipeline.stream_store_hits(spark, stream_hits(spark, path, 1), table, policy, places(spark), scratch_path(spark, "hits"))
    got = {(r.fingerprint, r.referer, r.content_type) for r in tables.read_pageviews(spark, table).collect()}
    assert got == {("f1", "https://z.org/", "post"), ("f2", "https://b.org/", "post")}
