"""Operators against golden rows and brute force on small fixtures."""

import base64
import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from footfall.functions import text, urls
from footfall.operators import aggregates, deltas, distinct, filters, hit_pipeline, ingest, joins, lifecycle, live, patterns, ranking, series, visits
from footfall.plans.ranges import range_of
from footfall.session import scratch_path
from footfall.sources import membership, tables
from footfall.sources.hits import RAW, parse_hits


def moment(text: str) -> int:
    return int(dt.datetime.fromisoformat(text + "+00:00").timestamp())


def page_rows(spark, days):
    rows = [(moment(day + "T00:00:00") + i, f"10.0.0.{i % 7}") for day, n in days.items() for i in range(n)]
    return spark.createDataFrame([(i + 1, t, ip) for i, (t, ip) in enumerate(rows)], "id long, dt long, ip string")


def weekly(df, first_weekday=6):
    start, end = moment("2026-02-18T00:00:00"), moment("2026-03-17T23:59:59")
    v = series.measure("COUNT", "id")
    return series.chart(df, start, end, "week", v, v, first_weekday=first_weekday).orderBy("ordinal").collect()


def test_weekly_steps(spark):
    days = {"2026-02-18": 5, "2026-02-25": 8, "2026-03-03": 12, "2026-03-07": 10, "2026-03-09": 20,
            "2026-03-13": 15, "2026-03-14": 30, "2026-03-16": 25, "2026-03-17": 35}
    assert [r.v1 for r in weekly(page_rows(spark, days))] == [5, 8, 12, 45, 90]
    got = weekly(page_rows(spark, {"2026-03-13": 100, "2026-03-14": 200}))
    assert (got[3].v1, got[4].v1) == (100, 200)
    assert [r.label for r in got][:2] == ["2026/02/18", "2026/02/21"]


def test_previous_period(spark):
    got = weekly(page_rows(spark, {"2026-03-07": 10, "2026-03-10": 15, "2026-02-07": 8, "2026-02-10": 12}))
    assert sum(r.v1 for r in got) == 25
    assert sum(r.v1_prev for r in got) == 20


def test_monthly_steps_and_totals(spark):
    days = {"2025-11-20": 15, "2025-12-25": 20, "2026-01-10": 25, "2026-02-14": 30, "2026-03-07": 35}
    df = page_rows(spark, days)
    start, end = moment("2025-11-01T00:00:00"), moment("2026-03-31T23:59:59")
    v = series.measure("COUNT", "id")
    months = [r.v1 for r in series.chart(df, start, end, "month", v, v).orderBy("ordinal").collect()]
    assert months == [15, 20, 25, 30, 35]
    for step in ("day", "week", "year"):
        for first in (0, 1, 6):
            rows = series.chart(df, start, end, step, v, v, first_weekday=first).collect()
            assert sum(r.v1 for r in rows) == 125


def test_top_is_ordered_and_shares_add_up(spark):
    df = spark.createDataFrame([("/a",)] * 50 + [("/b",)] * 30 + [("/c",)] * 10 + [(None,)] * 10, "resource string")
    rows = aggregates.top(df, ["resource"]).collect()
    assert [(r.resource, r.counthits, r.pct) for r in rows] == [("/a", 50, 50.0), ("/b", 30, 30.0), (None, 10, 10.0), ("/c", 10, 10.0)]


def test_filter_text(spark):
    spec = filters.read_filters("browser equals Firefox&&&country contains gb&&&zzz equals 1&&&city equals &&&limit_results equals 5&&&day equals 3")
    assert spec.columns == [("browser", "equals", "Firefox"), ("country", "contains", "gb")]
    assert spec.limit == 5 and spec.dates == {"day": ("equals", "3")}


def test_multivalue_filters(spark):
    df = spark.createDataFrame([(1, "[new:yes][pre:yes]", "1,5,12"), (2, "[pre:yes]", "15"), (3, None, None)], "id int, notes string, category string")

    def ids(test):
        return sorted(r.id for r in df.where(test).collect())

    assert ids(filters.predicate("notes", "equals", "new:yes")) == [1]
    assert ids(filters.predicate("category", "equals", "5")) == [1, 2]
    assert ids(filters.predicate("category", "equals", "5", exact_members=True)) == [1]
    assert ids(filters.predicate("notes", "is_not_equal_to", "new:yes")) == [2]
    assert ids(filters.predicate("notes", "is_empty")) == [3]


def test_filter_values_are_escaped(spark):
    assert filters.escape_entities("a & b's é") == "a &amp; b&#039;s &eacute;"
    df = spark.createDataFrame([("/a%3Fx",), ("/a?x",)], "resource string")
    assert [r[0] for r in df.where(filters.predicate("resource", "equals", "/a?x")).collect()] == ["/a%3Fx"]


def test_order_nulls_last(spark):
    df = spark.createDataFrame([(3,), (None,), (1,)], "v int")
    assert [r.v for r in df.orderBy(*ranking.sort_keys("v ASC", nulls_last=True)).collect()] == [1, 3, None]
    assert [r.v for r in df.orderBy(*ranking.sort_keys("v")).collect()] == [3, 1, None]
    assert ranking.last_page(101, 50) == 3


def test_ranges():
    now = moment("2024-01-31T12:00:00")
    assert range_of({}, now) == (moment("2024-01-04T00:00:00"), now)
    assert range_of({"day": ("equals", "10")}, now) == (moment("2024-01-10T00:00:00"), moment("2024-01-10T23:59:59"))
    assert range_of({"day": ("equals", "10"), "interval": ("equals", "3")}, now) == (moment("2024-01-10T00:00:00"), moment("2024-01-12T23:59:59"))


def random_hits(seed, n=600, keys=4, span=30000):
    """One key owns most hits; several fall on one second and on the chunk edges."""
    rng = random.Random(seed)
    base = 1704067200 + 86400 - span // 2  # crosses midnight
    return [(i + 1, "hot" if rng.random() < 0.6 else f"k{rng.randrange(keys)}", base + rng.randrange(span)) for i in range(n)]


def by_key(hits):
    out = {}
    for i, key, t in sorted(hits, key=lambda h: (h[2], h[0])):
        out.setdefault(key, []).append((t, i))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_visits_against_brute_force(spark, seed):
    hits = random_hits(seed)
    df = spark.createDataFrame(hits, "id long, visitor string, dt long")
    gap, fixed = set(), set()
    for key, seen in by_key(hits).items():
        open_gap = open_fixed = previous = None
        for t, _ in seen:
            if previous is None or t - previous >= 300:
                open_gap = t
            if open_fixed is None or t - open_fixed >= 300:
                open_fixed = t
            previous = t
            gap.add((key, t, open_gap))
            fixed.add((key, t, open_fixed))
    got_gap = visits.gap_starts(df, "visitor", 300, chunk=3600)
    got_fixed = visits.fixed_starts(df, "visitor", 300)
    assert {(r.visitor, r.dt, r.start) for r in got_gap.collect()} == gap
    assert {(r.visitor, r.dt, r.start) for r in got_fixed.collect()} == fixed


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_against_brute_force(spark, seed):
    hits = random_hits(seed)
    df = spark.createDataFrame(hits, "id long, visitor string, dt long").withColumn("page", F.lit(None).cast("string"))
    kept = set()
    for seen in by_key(hits).values():
        last = None
        for t, i in seen:
            if last is None or t - last > 200:
                kept.add(i)
                last = t
    assert {r.id for r in visits.drop_repeats(df, ["visitor", "page"], 200).collect()} == kept


def test_rate_limit_against_brute_force(spark):
    hits = random_hits(7, n=3000, span=900)
    df = spark.createDataFrame(hits, "id long, ip string, dt long")
    want = {}
    for key, seen in by_key(hits).items():
        used, last = 0, None
        for t, _ in seen:
            if last is not None and t - last > 5:
                used = 0
            if used < 10:
                used, last = used + 1, t
                want[key, t] = want.get((key, t), 0) + 1
    got = {(r.ip, r.dt): r.accepted for r in visits.rate_limited(df).collect() if r.accepted}
    assert got == want


def test_busy_keys_in_slices(spark):
    """A key that never rests, and a null key; slices of time far shorter than the chains."""
    rng = random.Random(3)
    base = 1704067200
    hits = [(i, None if i % 10 == 9 else "hot", base + rng.randrange(6000)) for i in range(5000)] + [(9000 + i, f"k{i}", base + 7 * i) for i in range(300)]
    df = spark.createDataFrame(hits, "id long, ip string, dt long")
    fixed, limited = set(), {}
    for key, seen in by_key(hits).items():
        open_at, used, last = None, 0, None
        for t, _ in seen:
            if open_at is None or t - open_at >= 40:
                open_at = t
            fixed.add((key, t, open_at))
            if last is not None and t - last > 5:
                used = 0
            if used < 10:
                used, last = used + 1, t
                limited[key, t] = limited.get((key, t), 0) + 1
    got = visits.anchors(visits.per_second(df, "ip"), "ip", 40, chunk=100)
    assert {(r.ip, r.dt, r.start) for r in got.collect()} == fixed
    got = visits.rate_limited(df, chunk=100)
    assert {(r.ip, r.dt): r.accepted for r in got.collect() if r.accepted} == limited
    assert got.count() == len({(k, t) for _, k, t in hits})


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_with_an_unknown_key(spark, seed):
    rng = random.Random(seed)
    hits = [(i + 1, "hot" if rng.random() < 0.7 else "k", rng.choice([None, "a", "b"]), 1704067200 + 86000 + rng.randrange(4000)) for i in range(600)]
    df = spark.createDataFrame(hits, "id long, visitor string, mark string, dt long")
    kept, state = set(), {}
    firsts = {}
    for i, v, m, t in hits:
        firsts[v, m, t] = min(firsts.get((v, m, t), i), i)
    for (v, m, t), i in sorted(firsts.items(), key=lambda x: (x[0][2], x[1])):
        last, newest = state.setdefault(v, ({}, [None]))
        before = newest[0] if m is None else last.get(m)
        if before is None or t - before > 90:
            kept.add(i)
            newest[0] = t
            if m is not None:
                last[m] = t
    assert {r.id for r in visits.drop_repeats(df, ["visitor"], 90, "mark").collect()} == kept


def test_chains_of_a_busy_key_stay_in_the_engine(spark):
    df = spark.range(20000).select("id", F.lit("hot").alias("ip"), (F.col("id") * 7 % 9000).alias("dt"))
    for found in (visits.fixed_starts(df, "ip", 60), visits.rate_limited(df), visits.drop_repeats(df, ["ip"], 60)):
        plan = found._jdf.queryExecution().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    sliced = visits._sliced(df.withColumn("block", F.lit(0)), 120, 500)
    slices = sliced.where("NOT ahead").groupBy("chunk").count().collect()
    assert len(slices) == 18 and max(r["count"] for r in slices) <= 20000 / 17


def test_asof_against_brute_force(spark):
    rng = random.Random(5)
    hits = [(i, "hot" if i % 3 else f"k{i % 5}", 1704067200 + rng.randrange(9000), rng.randrange(1, 50)) for i in range(1, 400)]
    df = spark.createDataFrame(hits, "id long, ip string, dt long, visit_id long")
    sources = [h for h in hits if h[0] % 2]
    want = {}
    for i, ip, t, _ in hits:
        near = [(s[2], s[0], s[3]) for s in sources if s[1] == ip and t - 600 <= s[2] <= t]
        want[ip, t] = max(near)[2] if near else None
    got = joins.latest_visit(df, df.where("id % 2 = 1"), ["ip"], 600).collect()
    assert {(r.ip, r.dt): r.visit_found for r in got} == want


def test_visit_numbers_rise_without_gaps(spark):
    found = spark.createDataFrame([(f"v{i % 9}", 1704067200 + (i * 7919) % 200000) for i in range(300)], "visitor string, start long").distinct()
    rows = sorted((r.visit_id, r.start) for r in visits.number_visits(found, "visitor", 50).collect())
    assert [n for n, _ in rows] == list(range(51, 51 + len(rows)))
    assert [s for _, s in rows] == sorted(s for _, s in rows)


def test_update_fold(spark):
    pages = spark.createDataFrame([(1, "[a]", None, 0), (2, None, "x", 5)], "id long, notes string, outbound_resource string, dt_out long")
    later = spark.createDataFrame(
        [(1, 2, "[c]", "u2", 9), (1, 1, "[b]", "u1", 7), (1, 3, "", "", 0), (2, 1, None, "y" * 2100, None)],
        "id long, seq long, notes string, outbound_resource string, dt_out long",
    )
    got = {r.id: tuple(r)[1:] for r in ingest.fold_updates(pages, later).collect()}
    assert got == {1: ("[a][b][c]", "u1;;;u2", 9), 2: (None, "x", 5)}


def stored_pages(spark):
    path = scratch_path(spark, "test-pages")
    day = 86400
    rows = spark.createDataFrame([(i, f"u{i % 3}", 1704067200 + (i % 5) * day + i) for i in range(100)], "id long, username string, dt long")
    full = rows.select(*[F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name)
                         for f in tables.PAGEVIEW.fields])
    tables.append_rows(full, path)
    return path


def test_append_twice_keeps_one_copy(spark):
    path = stored_pages(spark)
    rows = tables.read_pageviews(spark, path).drop("dt_date")
    lifecycle.append_new(rows.unionByName(rows.withColumn("id", F.col("id") + 50)), path)
    assert tables.read_pageviews(spark, path).select("id").distinct().count() == 150
    assert tables.read_pageviews(spark, path).count() == 150


def test_archive_can_run_again(spark):
    path, archive = stored_pages(spark), scratch_path(spark, "test-archive")
    as_of = 1704067200 + 12 * 86400 + 43200
    for _ in range(2):
        lifecycle.archive_old(spark, path, archive, as_of, days=10)
    live, old = tables.read_pageviews(spark, path), tables.read_pageviews(spark, archive)
    assert live.count() + old.count() == 100
    assert live.where(F.col("dt") < as_of - 10 * 86400).count() == 0
    assert old.where(F.col("dt") >= as_of - 10 * 86400).count() == 0


def test_updates_are_not_applied_twice(spark):
    path, stage = stored_pages(spark), scratch_path(spark, "test-stage")
    later = spark.createDataFrame([(7, 1, "[x]")], "id long, seq long, notes string")
    for _ in range(2):
        lifecycle.merge_updates(spark, path, later, stage)
    table = tables.read_pageviews(spark, path)
    assert table.count() == 100
    assert [r.notes for r in table.where("id = 7").collect()] == ["[x]"]


def test_appending_a_day_reads_no_other_day(spark):
    """The files of the other days are spoiled: whoever read one would fail."""
    import glob

    path, day = scratch_path(spark, "test-filters"), 86400
    schema = "id long, dt long"
    rows = [(i * 1000 + k, 1704067200 + i * day + k) for i in range(100) for k in range(40)]
    lifecycle.append_new(spark.createDataFrame(rows, schema), path)
    for name in glob.glob(f"{path}/dt_date=*/*.parquet"):
        with open(name, "wb") as out:
            out.write(b"spoiled")
    new = [(900_000 + k, 1704067200 + 100 * day + k) for k in range(500)]
    lifecycle.append_new(spark.createDataFrame(new, schema), path)
    assert spark.read.schema(schema).parquet(f"{path}/dt_date=2024-04-10").count() == 500
    with pytest.raises(Exception, match="(?i)parquet"):  # an id of the third day is looked up there
        lifecycle.append_new(spark.createDataFrame([(2005, 1704067200 + 101 * day)], schema), path)


def test_filters_deny_nothing_that_is_there(spark):
    path, schema = scratch_path(spark, "test-members"), "id long, dt long"
    rows = spark.range(20000).select(F.col("id") * 7, (1704067200 + F.col("id") % 3 * 86400).alias("dt")).toDF("id", "dt")
    for part in range(3):  # several appends a day
        lifecycle.append_new(rows.where(F.col("id") % 3 == part), path)
    found = membership.maybe_stored(rows, path, "id")
    assert found.join(tables.with_day(rows), ["id", "dt_date"]).count() == 20000
    others = spark.range(1, 20000 * 7, 7)
    assert membership.maybe_stored(others, path, "id").count() < 40
    lifecycle.append_new(rows.withColumn("dt", F.col("dt") + 5 * 86400).unionByName(others.select("id", F.lit(0).cast("long").alias("dt"))), path)
    assert spark.read.parquet(path).groupBy("dt_date").count().count() == 4 and spark.read.parquet(path).count() == 40000
    membership.compact_filters(spark, path, "id")
    lifecycle.append_new(rows, path)
    assert spark.read.parquet(path).count() == 40000
    tables.append_rows(spark.createDataFrame([(-1, 0)], schema), path)  # behind the filters' back
    lifecycle.append_new(spark.createDataFrame([(-1, 999999)], schema), path)
    assert spark.read.parquet(path).where("id = -1").count() == 1
    empty = scratch_path(spark, "test-no-rows")
    lifecycle.append_new(rows.limit(0), empty)
    lifecycle.append_new(rows, empty)
    assert spark.read.parquet(empty).count() == 20000


def test_updates_wait_beside_the_table(spark, monkeypatch):
    path = stored_pages(spark)
    files = lambda: {r[0] for r in tables.read_pageviews(spark, path).select(F.input_file_name()).distinct().collect()}
    before = files()
    first = spark.createDataFrame([(7, 5, "[x]", 1704067200 + 2 * 86400 + 7), (8, 1, "[y]", 1704067200 + 3 * 86400 + 8)], "id long, seq long, notes string, page_dt long")
    second = spark.createDataFrame([(7, 1, "[z]", "u9"), (999, 1, "[w]", "")], "id long, seq long, notes string, username string")
    for _ in range(2):  # a repeated batch counts once
        deltas.append_updates(spark, path, first, 0)
        deltas.append_updates(spark, path, second, 1)
    deltas.append_updates(spark, path, first.limit(0), 2)
    assert files() == before
    want = {7: ("[x][z]", "u9"), 8: ("[y]", "u2")}
    seen = lambda table: {r.id: (r.notes, r.username) for r in table.where("notes IS NOT NULL").collect()}
    current = deltas.read_current(spark, path)
    assert seen(current) == want and current.count() == 100
    plan = current.where("dt_date = date'2024-01-03'")._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"PartitionFilters: \[[^\]]*dt_date", plan)) == 3  # the table and both batches
    # a run that breaks off after its stage was written, then the whole job again
    kept = lifecycle.replace_days
    monkeypatch.setattr(lifecycle, "replace_days", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        deltas.compact(spark, path)
    monkeypatch.setattr(lifecycle, "replace_days", kept)
    deltas.append_updates(spark, path, spark.createDataFrame([(8, 1, "[late]")], "id long, seq long, notes string"), 3)
    deltas.compact(spark, path)
    assert seen(tables.read_pageviews(spark, path)) == want
    assert seen(deltas.read_current(spark, path)) == {**want, 8: ("[y][late]", "u2")}
    for _ in range(2):
        deltas.compact(spark, path)
    assert seen(tables.read_pageviews(spark, path)) == seen(deltas.read_current(spark, path)) == {**want, 8: ("[y][late]", "u2")}
    untouched = [f for f in before if "2024-01-05" in f]
    assert untouched and set(untouched) <= files()


def test_deleting_every_row_of_a_day_removes_it(spark):
    path = stored_pages(spark)
    table = tables.read_pageviews(spark, path)
    touched = table.where("dt_date = date'2024-01-02' OR id = 0")
    lifecycle.rewrite(table, path, touched, lambda rows: rows.where("dt_date <> date'2024-01-02' AND id <> 0"))
    left = tables.read_pageviews(spark, path)
    assert left.count() == 79
    assert left.where("dt_date = date'2024-01-02'").count() == 0


def test_a_page_counts_for_every_article_above_it(spark):
    pages = spark.createDataFrame([(1, "/a/b/c"), (2, "/a/b"), (3, "/a"), (4, "/z")], "id long, resource string")
    articles = spark.createDataFrame([(1, "/a"), (2, "/a/b"), (3, "/q")], "article_id long, path string")
    got = {r.article_id: r.counthits for r in joins.hits_per_article(pages, articles).collect()}
    assert got == {1: 3, 2: 2, 3: 0}


def test_known_ids_are_found_on_any_day(spark):
    from footfall.operators.lifecycle import append_new
    from footfall.session import scratch_path

    path, schema = scratch_path(spark, "ids"), "id long, dt long"
    append_new(spark.createDataFrame([(1, 0), (2, 86400)], schema), path)
    append_new(spark.createDataFrame([(1, 5 * 86400), (3, 7), (3, 8)], schema), path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 2, 3]


def test_places_of_both_kinds_of_addresses(spark):
    ranges = [("20010db8" + "0" * 24, "20010db8" + "f" * 24, "NL", "Delft", "", "1", "2")]
    table = spark.createDataFrame(ranges, "low string, high string, country_code string, city string, subdivision string, latitude string, longitude string")
    hits = spark.createDataFrame([("2001:db8::1",), ("2001:DB8:ffff::",), ("2001:db9::",), ("1.2.3.4",), ("x",), (None,)], "ip string")
    assert {r.ip: r.geo_country for r in joins.geo_lookup(hits, table).collect()} == {
        "2001:db8::1": "nl", "2001:DB8:ffff::": "nl", "2001:db9::": None, "1.2.3.4": None, "x": None, None: None,
    }


def test_ranges_as_prefixes(spark):
    """Against the standard library; a wide range is a handful of rows."""
    import ipaddress

    from footfall.functions import addresses

    rng = random.Random(8)
    rows = [(0, 0), (0, 2**128 - 1), (5, 4), (2**125, 2**125 + 2**124 - 1)]
    for _ in range(60):
        low = rng.getrandbits(128) >> rng.randrange(120)
        rows.append((low, min(2**128 - 1, low + (rng.getrandbits(128) >> rng.randrange(128)))))
    df = spark.createDataFrame([(i, f"{a:032x}", f"{b:032x}") for i, (a, b) in enumerate(rows)], "n int, low string, high string")
    got = df.select("n", addresses.range_prefixes(addresses.address_bits("low"), addresses.address_bits("high")).alias("p")).collect()
    for r in got:
        low, high = rows[r.n]
        nets = ipaddress.summarize_address_range(ipaddress.IPv6Address(low), ipaddress.IPv6Address(high)) if low <= high else []
        assert sorted(r.p) == sorted(f"{int(net.network_address):0128b}"[: net.prefixlen] for net in nets)


def test_many_ignored_ranges_come_as_a_table(spark, monkeypatch):
    ranges = [f"10.{i}.0.0/{rng}" for i in range(60) for rng in (16, 20)] + ["2001:db8::/32", "2001:db9::1", "::/0x", "nonsense", "192.168.1.0/33"]
    hits = [(1, "10.5.9.9", None), (2, "10.60.0.1", None), (3, "11.0.0.1", "10.59.1.1"), (4, "2001:db8:1::5", ""), (5, "2001:db9::1", None), (6, "2001:db9::2", "x"), (7, None, None), (8, "192.168.1.7", None)]
    df = spark.createDataFrame(hits, "id long, ip string, other_ip string")
    got = joins.in_range_table(df, spark.createDataFrame([(r,) for r in ranges], "cidr string"), ["ip", "other_ip"], "inside")
    assert {r.id for r in got.where("inside").collect()} == {1, 3, 4, 5} and got.count() == 8 and got.columns == ["id", "ip", "other_ip", "inside"]
    rows = df.selectExpr("*", "1 AS dt", "'/a' AS resource")
    code = lambda: {r.id: r.reject_code for r in ingest.with_reject_code(rows, ingest.Policy(ignore_ranges=[f"10.{i}.0.0/16" for i in range(60)])).collect()}
    many = code()
    monkeypatch.setattr(ingest, "FEW_RANGES", 1000)
    assert many == code() and many[3] == 304


def test_pages_open_for_weeks_are_online(spark):
    """A page that came twenty days ago and is still alive counts; one that ended doesn't. Stored and unstored alike."""
    now = moment("2024-02-01T12:00:00")
    rows = [(1, now - 20 * 86400, now - 30, 7, "10.0.0.1"), (2, now - 20 * 86400, now - 19 * 86400, 8, "10.0.0.2"), (3, now - 60, None, 9, "10.0.0.3"), (4, now - 40 * 86400, 0, 10, None)]
    df = spark.createDataFrame(rows, "id long, dt long, dt_out long, visit_id long, ip string")
    path = scratch_path(spark, "open")
    tables.append_rows(df, path)
    stored = spark.read.parquet(path)
    for table in (df, stored):
        assert live.online_count(table, now).first().online == 2
        assert {r.ip for r in live.online_now(table, "ip", now).collect()} == {"10.0.0.1", "10.0.0.3"}
        assert live.users_per_minute(table, now).agg(F.max("cnt")).first()[0] == 2
    assert live.online_count(stored.where("id = 4"), now).first().online == 0


def test_distinct_of_any_days(spark):
    """Against sets; one value has most rows, nulls have no number, a second batch keeps the first one's numbers."""
    rng = random.Random(3)
    rows = [(f"2024-01-{1 + i % 9:02d}", "hot" if rng.random() < 0.6 else None if rng.random() < 0.1 else f"v{rng.randrange(300)}", rng.choice("ab") if i % 7 else None) for i in range(2000)]
    df = spark.createDataFrame(rows, "day string, value string, k string").selectExpr("CAST(day AS DATE) AS dt_date", "value", "k")
    first = distinct.number_values(df.where("dt_date < '2024-01-04'"), parts=4)
    more = distinct.number_values(df, first, parts=4)
    assert distinct.number_values(df, first.unionByName(more), parts=4).count() == 0
    numbers = first.unionByName(more).collect()
    assert len({(r.part, r.position) for r in numbers}) == len(numbers) == len({v for _, v, _ in rows if v})
    sets = distinct.daily_sets(df, first.unionByName(more), ["k"])
    got = {r.k: r.distinct for r in distinct.merge_sets(sets.where("dt_date BETWEEN '2024-01-02' AND '2024-01-05'"), ["k"]).collect()}
    assert got == {k: len({v for d, v, x in rows if x == k and v and "2024-01-02" <= d <= "2024-01-05"}) for k in ("a", "b", None)}
    rolling = {(str(r.dt_date), r.k): r.distinct for r in distinct.rolling_distinct(sets, 3, ["k"]).collect()}
    days = sorted({d for d, _, _ in rows})
    assert rolling == {(d, k): len({v for e, v, x in rows if x == k and v and d[:8] + f"{int(d[8:]) - 2:02d}" <= e <= d}) for d in days for k in ("a", "b", None)}
    assert distinct.merge_sets(sets.where("false"), ["k"]).count() == 0


def test_visitor_flow(spark):
    rows = [("2024-01-01", "a"), ("2024-01-02", "b"), ("2024-01-08", "b"), ("2024-01-09", "c"), ("2024-01-09", "d"), ("2024-01-09", None), ("2024-01-20", "e")]
    df = spark.createDataFrame(rows, "day string, value string").selectExpr("CAST(day AS DATE) AS dt_date", "value")
    flow = distinct.visitor_flow(distinct.daily_sketches(df), ("2024-01-01", "2024-01-07"), ("2024-01-08", "2024-01-14")).first()
    assert tuple(flow) == (2, 1, 1, 0.0)
    nobody = distinct.visitor_flow(distinct.daily_sketches(df), ("2023-01-01", "2023-01-07"), ("2024-01-08", "2024-01-14")).first()
    assert tuple(nobody) == (3, 0, 0, 0.0)
    many = spark.range(60000).selectExpr("CAST(CASE WHEN id < 40000 THEN '2024-01-01' ELSE '2024-01-08' END AS DATE) AS dt_date", "id % 50000 AS value")
    flow = distinct.visitor_flow(distinct.daily_sketches(many, sharpness=12), ("2024-01-01", "2024-01-07"), ("2024-01-08", "2024-01-14"), sharpness=12).first()
    for got, want in zip(flow[:3], (10000, 10000, 30000), strict=True):
        assert 0 < abs(got - want) <= flow.error


def test_long_lists_of_patterns(spark, monkeypatch):
    """A table gives what one expression of the same patterns gives."""
    rng = random.Random(5)
    values = ["", "a", "ab", "abc", "ABC", "a.c", "a+b(c", "/blog/x", "/BLOG/été", "x\n", "xyz\n", "\n", "100%", "a_b", "İstanbul", "istanbul", "Kk", None]
    values += ["".join(rng.choice("abAB./") for _ in range(rng.randrange(9))) for _ in range(200)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, value string")
    lists = [["*"], ["!"], ["!!!"], ["!*!"], ["a*c", "a!c"], ["/blog/*", "*ÉTÉ"], ["a+b(c", "100%", "a_b", "istanbul", "kk"], ["zzz*", "abc*zzz"], ["", " "], []]
    lists += [["".join(rng.choice("abAB./*!") for _ in range(rng.randrange(1, 6))) for _ in range(40)] for _ in range(2)]
    for items in lists:
        table = spark.createDataFrame([(x,) for x in items], "pattern string")
        got = {r.id for r in patterns.in_pattern_table(df, table, ["value"], "hit").where("hit").collect()}
        want = {r.id for r in df.where(text.matches_wildcard("value", ",".join(items))).collect()}
        assert got == want, items
    hits = df.selectExpr("id", "value AS resource", "1 AS dt", "'10.0.0.1' AS ip")
    policy = ingest.Policy(ignore_resources=", ".join(f"a{i % 7}*{i}, *b{i}" for i in range(150)) + ", a*, /BLOG/*")
    code = lambda: {r.id: r.reject_code for r in ingest.with_reject_code(hits, policy).collect()}
    many = code()
    monkeypatch.setattr(ingest, "FEW_PATTERNS", 1000)
    assert many == code() and many[7] == 305


def test_raw_hits_are_read_once(spark):
    """Places and agents are looked up from staged page views, not from the raw hits again."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    rows = [(1704067200 + i, f"10.0.0.{i % 5}", "curl/8.0", '{"res":"aHR0cHM6Ly9leGFtcGxlLmNvbS9h","fh":"f%d"%s}' % (i, ',"id":"7"' if i % 4 else "")) for i in range(40)]
    raw = spark.createDataFrame(rows, RAW).mapInPandas(counted, RAW)
    ranges = spark.createDataFrame([(0, 1, "us", "", "", 0.0, 0.0)], "low long, high long, country_code string, city string, subdivision string, latitude double, longitude double")
    path = scratch_path(spark, "read-once")
    hit_pipeline.store_hits(parse_hits(raw), path, ingest.Policy(), ranges)
    assert tables.read_pageviews(spark, path).count() == 10 and seen.value == 40


def test_hits_that_are_stored_are_not_enriched_again(spark, monkeypatch):
    """Equal hits and hits whose ids are stored go before places and agents are looked up; rejected ones may come again."""
    def raw(numbers):
        rows = [(1704067200 + 43_200 * i if i % 7 else None, f"10.0.0.{i % 5}", "curl/8.0", '{"res":"aHR0cHM6Ly9leGFtcGxlLmNvbS9h","fh":"f%d"}' % i) for i in numbers]
        return parse_hits(spark.createDataFrame(rows, RAW))

    seen, rows_of = [], hit_pipeline.page_rows

    def counted(hits, *more):
        seen.append(hits.count())
        return rows_of(hits, *more)

    monkeypatch.setattr(hit_pipeline, "page_rows", counted)
    ranges = spark.createDataFrame([(0, 1, "us", "", "", 0.0, 0.0)], "low long, high long, country_code string, city string, subdivision string, latitude double, longitude double")
    path = scratch_path(spark, "known-hits")
    for numbers in ([1, 2, 3, 3, 3], [2, 3], [3, 4, 4, 5, 7, 7], [7, 5], [6]):
        hit_pipeline.store_hits(raw(numbers), path, ingest.Policy(), ranges)
    assert seen == [3, 3, 1, 1]  # the second batch has nothing new; hit 7 has no time and is refused each time
    stored = tables.read_pageviews(spark, path)
    assert sorted(r.fingerprint for r in stored.collect()) == ["f1", "f2", "f3", "f4", "f5", "f6"]
    spark.conf.set("spark.sql.session.timeZone", "Pacific/Kiritimati")  # the same moments fall on other days there
    try:
        hit_pipeline.store_hits(raw([1, 2, 3, 4, 5, 6]), path, ingest.Policy(), ranges)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert tables.read_pageviews(spark, path).count() == 6


def test_equal_ids_of_unlike_hits(spark):
    """The id leaves out what a payload says of its content, so one refused hit hides no accepted one of the same id."""
    code = lambda kind: base64.b64encode(('{"content_type":"%s"}' % kind).encode()).decode().translate(str.maketrans("+/=", "._-"))
    rows = [(1704067200, "10.0.0.1", "curl/8.0", '{"res":"aHR0cHM6Ly9leGFtcGxlLmNvbS9h","fh":"f","ci":"%s"}' % code(kind)) for kind in ("secret", "post")]
    hits = parse_hits(spark.createDataFrame(rows, RAW)).withColumn("labels", F.create_map(F.lit("a"), F.lit(1)))
    ranges = spark.createDataFrame([(0, 1, "us", "", "", 0.0, 0.0)], "low long, high long, country_code string, city string, subdivision string, latitude double, longitude double")
    path = scratch_path(spark, "equal-ids")
    for _ in range(2):
        hit_pipeline.store_hits(hits, path, ingest.Policy(ignore_content_types="secret"), ranges)
        assert [r.content_type for r in tables.read_pageviews(spark, path).collect()] == ["post"]


def test_filters_of_near_days(spark):
    """Asked about a day, filters of far days aren't met: an id stored there is found with all days only."""
    path, day = scratch_path(spark, "test-near"), 86400
    lifecycle.append_new(spark.createDataFrame([(i, 1704067200 + (i % 20) * day) for i in range(200)], "id long, dt long"), path)
    asked = tables.with_day(spark.createDataFrame([(i, 1704067200 + (i % 20 + i // 20) * day) for i in range(200)] + [(7, None)], "id long, dt long"))
    assert membership.maybe_stored(asked, path, "id").select("id").distinct().count() == 200
    assert {r.id for r in membership.maybe_stored(asked, path, "id", near=2).collect()} == set(range(60))


def test_search_words_parse_named_parameters_only(spark):
    links = ["http://a.org/?q=x+y", "http://a.org/?qq=1&q=2", "http://a.org/?qs=%C3%A9&q=", "http://a.org/q=1", "http://a.org/#q=1", "a b?q=1", "", None, "http://a.org/?axb=5&a.b=6", "http://a.org/?s= "]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(links)], "id int, link string")
    for keys in (urls.SEARCH_PARAMETERS, ["q"], ["a.b", "q"]):
        plain = F.trim(F.coalesce(*[urls.query_value("link", k) for k in keys]))
        got = df.select(urls.search_words("link", keys).alias("got"), plain.alias("want")).collect()
        assert [r.got for r in got] == [r.want for r in got]
