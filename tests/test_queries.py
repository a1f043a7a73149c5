"""Every registered query against its checking SQL, and plan properties."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from checks.base import END, QUERIES, START, ranged
from checks.run import compare, connect
from footfall.operators import aggregates, live, ranking, summaries
from footfall.operators.filters import in_time_range
from footfall.sources import testdata
from footfall.sources.tables import append_rows, read_pageviews
from footfall.session import scratch_path


LARGER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def engine(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, engine, name):
    """Equal to the checking SQL, on rows: nothing is proved by two empty results."""
    query, oracle = entry.queries()[name], entry.oracle_sql().get(name)
    verdict, _, _ = compare(spark, engine, name, query, oracle, sf_dir)
    if "empty" in verdict:  # nobody is there at the smallest size
        verdict, _, _ = compare(spark, connect(LARGER), name, query, oracle, LARGER)
    assert verdict == "ok", verdict


def test_operator_queries_read_their_whole_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    for name in ("src_pageviews", "fn_domain", "fn_mask_ip", "hit_referer_clean", "hit_ua_enrich", "order_multi", "time_on_page", "geo_range_lookup"):
        assert entry.queries()[name](spark, sf_dir).count() == rows, name


def test_sorting(spark, sf_dir):
    got = [(r.browser, r.country, r.id) for r in entry.queries()["order_multi"](spark, sf_dir).collect()]
    assert got == sorted(got, key=lambda r: (r[0], r[1] is None, [-ord(c) for c in r[1] or ""] + [1], -r[2]))


def test_live_numbers_prune_days(spark, sf_dir):
    path = scratch_path(spark, "live")
    append_rows(testdata.pageviews(spark, sf_dir), path)
    table = read_pageviews(spark, path)
    frames = {
        "online_count": live.online_count(table, END), "online_now": live.online_now(table, "ip", END),
        "users": live.users_per_minute(table, END), "values": live.values_per_minute(table, "resource", END),
        "counts": live.live_counts(table, END), "overview": summaries.overview(table, START, END, END),
        "days": summaries.today_against_yesterday(table, END, "example.com"), "traffic": summaries.traffic(table, START, END, END, "x"),
        "ranges": ranking.union_ranges(table, [(START, START + 9), (END - 9, END)]),
    }
    for name, frame in frames.items():
        scans = [x for x in plan(frame).split("\n") if "FileScan" in x]
        assert scans and all("PartitionFilters: [isnotnull(dt_date" in x for x in scans), name
    for frame, most in ((frames["traffic"], 2), (summaries.visitors(table), 1), (frames["overview"], 1)):
        assert plan(frame).count("FileScan") <= most


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_range_and_columns_reach_the_scan(spark, sf_dir):
    text = plan(aggregates.top(ranged(spark, sf_dir, "country"), ["country"], share=False))
    assert "GreaterThanOrEqual(ts" in text and "TakeOrderedAndProject" in text
    assert "url" not in text and "html" not in text


def test_stored_table_prunes_days(spark, sf_dir):
    path = scratch_path(spark, "prune")
    append_rows(testdata.pageviews(spark, sf_dir), path)
    text = plan(in_time_range(read_pageviews(spark, path), START, END).select("id", "dt"))
    assert "PartitionFilters: [isnotnull(dt_date" in text
    assert "ReadSchema: struct<id:bigint,dt:bigint>" in text


def test_no_nested_loops_or_cross_products(spark, sf_dir):
    for name in ("live_users_minutes", "post_prefix_join", "geo_range_lookup", "edge_pages_entry", "consent_upgrade"):
        text = plan(entry.queries()[name](spark, sf_dir))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_a_top_list_and_its_share_read_once(spark, sf_dir):
    path = scratch_path(spark, "top-once")
    append_rows(testdata.pageviews(spark, sf_dir), path)
    rows = read_pageviews(spark, path)
    total = rows.count()
    for found in (
        aggregates.top(rows, ["resource"]),
        aggregates.top(rows, ["resource"], rows["content_type"] != "404", recent=True),
        aggregates.top(rows, ["browser", "country"], rows["country"].isNotNull(), having=F.count("*") > 2),
    ):
        lines = found.collect()
        assert lines and all(abs(r.pct - 100 * r.counthits / total) <= 0.005 + 1e-9 for r in lines)
        plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        final = plan[plan.index("== Final Plan ==") :]
        assert "ReusedExchange" in found._jdf.queryExecution().executedPlan().toString(), final
    nothing = aggregates.top(rows.where("id < 0"), ["resource"])
    assert nothing.collect() == []
