"""Overview tables: eight numbers each, as rows (position, metric, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.operators.aggregates import percent, ratio
from footfall.operators.filters import in_time_range, since as rows_since
from footfall.schema import DAY, ONLINE_SECONDS, RECENTLY_ACTIVE_SECONDS

# Upper bound and weight in seconds of each duration class.
DURATION_CLASSES = [
    ("0 - 30 seconds", 30, 30),
    ("31 - 60 seconds", 60, 60),
    ("1 - 3 minutes", 180, 180),
    ("3 - 5 minutes", 300, 300),
    ("5 - 7 minutes", 420, 420),
    ("7 - 10 minutes", 600, 600),
    ("More than 10 minutes", None, 900),
]

HUMAN = "browser_type <> 1"


def as_rows(one_row: DataFrame, metrics: dict[str, tuple[int, Column]]) -> DataFrame:
    """A one-row aggregate turned into (position, metric, value) rows."""
    entries = [
        F.struct(F.lit(p).alias("position"), F.lit(m).alias("metric"), v.cast("double").alias("value"))
        for m, (p, v) in metrics.items()
    ]
    return one_row.select(F.inline(F.array(*entries)))


def overview(df: DataFrame, start: int, end: int, as_of: int) -> DataFrame:
    """Page views, days, daily average, search hits, addresses, and live counts.

    `df` is the whole table: three of the numbers do not follow the range. One
    scan covers range, today, yesterday and the last half hour.
    """
    midnight = as_of - as_of % DAY
    inside = F.col("dt").between(start, end)
    days = max(1, -(-(end - start) // DAY))
    since = min(start, midnight - DAY, as_of - ONLINE_SECONDS)
    one = rows_since(df, since).agg(
        F.count_if(inside).alias("pageviews"),
        F.count_if(inside & F.col("searchterms").isNotNull()).alias("searches"),
        F.count_distinct(F.when(inside, F.col("ip"))).alias("ips"),
        F.count_if(F.col("dt") > as_of - ONLINE_SECONDS).alias("half_hour"),
        F.count_if(F.col("dt") > midnight).alias("today"),
        F.count_if(F.col("dt").between(midnight - DAY, midnight - 1)).alias("yesterday"),
    )
    average = F.call_function("div", F.col("pageviews") * 2 + days, F.lit(2 * days))
    return as_rows(
        one,
        {
            "Pageviews": (1, F.col("pageviews")),
            "Days in Range": (2, F.lit(days)),
            "Average Daily Pageviews": (3, average),
            "From Any SERP": (4, F.col("searches")),
            "Unique IPs": (5, F.col("ips")),
            "Last 30 minutes": (6, F.col("half_hour")),
            "Today": (7, F.col("today")),
            "Yesterday": (8, F.col("yesterday")),
        },
    )


def traffic(df: DataFrame, start: int, end: int, as_of: int, site: str) -> DataFrame:
    """Referrers, search hits, landing pages, bounce pages, new visitors.

    One scan of the range: every row is dealt to the groups it counts for (page, address, referrer), so the
    distinct counts share one grouping; a second, short scan counts what is going on now.
    """
    rows = in_time_range(df, start, end)
    outside = F.col("referer").isNotNull() & ~F.col("referer").like(f"%{site}%")
    searched = F.col("searchterms").isNotNull() & outside
    in_visit = (F.col("visit_id") > 0) & (F.col("content_type") != "404")

    def part(kind: str, condition: Column, value, first: Column, second: Column) -> Column:
        fields = (F.lit(kind).alias("kind"), value.alias("value"), first.cast("int").alias("a"), second.cast("int").alias("b"))
        return F.when(condition, F.struct(*fields))

    no = F.lit(False)
    parts = F.array(
        part("all", F.lit(True), F.lit(None).cast("string"), F.col("resource").isNull(), F.coalesce(searched, no)),
        part("page", F.col("resource").isNotNull(), F.col("resource"), F.coalesce(in_visit, no), no),
        part("ip", (F.col("visit_id") > 0) & F.col("ip").isNotNull(), F.col("ip"), F.coalesce(F.expr(HUMAN), no), no),
        part("referer", F.coalesce(outside, no), F.col("referer"), no, no),
    )
    groups = rows.select(F.inline(F.array_compact(parts))).groupBy("kind", "value")
    counted = groups.agg(F.count("*").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    of = lambda kind: F.col("kind") == kind
    total = lambda kind, c: F.coalesce(F.sum(F.when(of(kind), F.col(c))), F.lit(0))
    one = counted.agg(
        total("all", "n").alias("pageviews"),
        total("all", "a").alias("direct"),
        total("all", "b").alias("serp"),
        F.count_if(of("referer")).alias("referers"),
        F.count_if(of("page")).alias("pages"),
        F.count_if(of("page") & (F.col("a") == 1)).alias("bounce"),
        F.count_if(of("ip") & (F.col("n") == 1)).alias("fresh"),
        total("ip", "a").alias("human"),
    )
    rate = percent(F.col("fresh"), F.col("human"))
    rate = F.when(rate >= 100, F.lit(100.0)).otherwise(rate)
    now = rows_since(df, as_of - RECENTLY_ACTIVE_SECONDS + 1).agg(F.count_if(searched).alias("now"))
    numbers = as_rows(
        one,
        {
            "Pageviews": (1, F.col("pageviews")),
            "Unique Referrers": (2, F.col("referers")),
            "resource_null": (3, F.col("direct")),
            "From External SERP": (4, F.col("serp")),
            "Unique Landing Pages": (5, F.col("pages")),
            "Bounce Pages": (6, F.col("bounce")),
            "New Visitors Rate": (7, rate),
        },
    )
    return numbers.unionByName(as_rows(now, {"Currently from search engines": (8, F.col("now"))}))


def visitors(df: DataFrame) -> DataFrame:
    """Visits, addresses, bounce rate, known visitors, bots, pages per visit.

    The bounce rate counts visit number 0 among the visits but not among the
    one-page visits. One scan: each row is dealt to its visit, address and name, which share one grouping.
    """
    human = F.coalesce(F.expr(HUMAN), F.lit(False))
    visit = F.when(F.col("visit_id") > 0, F.col("visit_id"))

    def part(kind: str, condition: Column, value) -> Column:
        fields = (
            F.lit(kind).alias("kind"), value.cast("string").alias("value"), human.cast("int").alias("human"),
            F.expr("coalesce(browser_type = 1, false)").cast("int").alias("bot"), F.col("ip").isNotNull().cast("int").alias("hit"),
        )
        return F.when(condition, F.struct(*fields))

    parts = F.array(
        part("visit", F.lit(True), F.col("visit_id")),
        part("ip", visit.isNotNull() & human & F.col("ip").isNotNull(), F.col("ip")),
        part("name", F.col("username").isNotNull(), F.col("username")),
    )
    groups = df.select(F.inline(F.array_compact(parts))).groupBy("kind", "value")
    per = groups.agg(F.sum("human").alias("human"), F.sum("bot").alias("bots"), F.sum("hit").alias("hits"))
    per_visit = F.col("kind") == "visit"
    real = per_visit & (F.col("value").cast("bigint") > 0)
    one = per.agg(
        F.count_if(per_visit & F.col("value").isNotNull() & (F.col("human") > 0)).alias("all_visits"),
        F.count_if(real & (F.col("human") > 0)).alias("visits"),
        F.count_if(per_visit & (F.col("human") == 1) & (F.col("value") != "0")).alias("single"),
        F.coalesce(F.sum(F.when(per_visit, F.col("bots"))), F.lit(0)).alias("bots"),
        F.count_if(real).alias("n"),
        F.coalesce(F.sum(F.when(real, F.col("hits"))), F.lit(0)).alias("hits"),
        F.coalesce(F.max(F.when(real, F.col("hits"))), F.lit(0)).alias("longest"),
        F.count_if(F.col("kind") == "ip").alias("ips"),
        F.count_if(F.col("kind") == "name").alias("known"),
    )
    bounce = percent(F.col("single"), F.col("all_visits"))
    bounce = F.when(bounce >= 100, F.lit(100.0)).otherwise(bounce)
    return as_rows(
        one,
        {
            "Visits": (1, F.col("visits")),
            "Unique IPs": (2, F.col("ips")),
            "Bounce rate": (3, bounce),
            "Known visitors": (4, F.col("known")),
            "Single-page Visits": (5, F.col("single")),
            "Bots": (6, F.col("bots")),
            "Pageviews per visit": (7, ratio(F.col("hits"), F.col("n"))),
            "Longest visit": (8, F.col("longest")),
        },
    )


def visit_durations(df: DataFrame) -> DataFrame:
    """Human visits by duration class, with shares and the weighted average.

    Rows: the seven classes by count, then the average in seconds.
    """
    per = (
        df.where("visit_id > 0 AND browser_type <> 1")
        .groupBy("visit_id")
        .agg((F.greatest(F.max("dt"), F.max("dt_out")) - F.min("dt")).alias("seconds"))
    )
    counts, low = [F.count("*").alias("total")], -1
    for i, (_, high, _) in enumerate(DURATION_CLASSES):
        inside = F.col("seconds") > low
        inside = inside & (F.col("seconds") <= high) if high else inside
        counts.append(F.count_if(inside).alias(f"c{i}"))
        low = high
    one = per.agg(*counts)
    total = F.col("total")
    weighted = sum((F.col(f"c{i}") * w for i, (_, _, w) in enumerate(DURATION_CLASSES)), F.lit(0))
    nothing = F.lit(None)

    def entry(position, metric, count, share, seconds) -> Column:
        return F.struct(
            F.lit(position).alias("position"),
            F.lit(metric).alias("metric"),
            count.cast("bigint").alias("counthits"),
            share.cast("double").alias("pct"),
            seconds.cast("bigint").alias("average_seconds"),
        )

    rows = [
        entry(i + 1, name, F.col(f"c{i}"), percent(F.col(f"c{i}"), total), nothing)
        for i, (name, _, _) in enumerate(DURATION_CLASSES)
    ]
    average = F.when(total > 0, F.call_function("div", weighted, total)).otherwise(F.lit(0))
    rows.append(entry(8, "Average Visit Duration", nothing, nothing, average))
    out = one.select(F.inline(F.array(*rows)))
    return out.orderBy(F.col("counthits").desc_nulls_last(), "position")


def content(items: DataFrame, comments: DataFrame, pageviews: DataFrame) -> DataFrame:
    """Content items by type, comments, comments per post, mean latency."""
    one = items.agg(
        F.count_if(F.expr("type <> 'revision'")).alias("items"),
        F.count_if(F.expr("type = 'post'")).alias("posts"),
        F.count_if(F.expr("type = 'page'")).alias("pages"),
        F.count_if(F.expr("type = 'attachment'")).alias("attachments"),
        F.count_if(F.expr("type = 'revision'")).alias("revisions"),
    )
    said = comments.agg(F.count("*").alias("comments"))
    per_post = F.when(
        F.col("posts") > 0, F.call_function("div", F.col("comments") * 2 + F.col("posts"), F.col("posts") * 2)
    ).otherwise(F.lit(0))
    latency = pageviews.where("server_latency <> 0").agg(
        F.sum("server_latency").alias("total"), F.count("*").alias("n")
    )
    mean = F.when(F.col("n") > 0, F.call_function("div", F.col("total") * 2 + F.col("n"), F.col("n") * 2))
    counted = one.withColumn("comments", said.scalar())
    return as_rows(
        counted,
        {
            "Content Items": (1, F.col("items")),
            "Posts": (2, F.col("posts")),
            "Pages": (3, F.col("pages")),
            "Attachments": (4, F.col("attachments")),
            "Revisions": (5, F.col("revisions")),
            "Comments": (6, F.col("comments")),
            "Avg Comments per Post": (7, per_post),
        },
    ).unionByName(as_rows(latency, {"Avg Server Latency": (8, F.coalesce(mean, F.lit(0)))}))


def today_against_yesterday(df: DataFrame, as_of: int, site: str) -> DataFrame:
    """Sessions, views and outside referrals of two days in one pass."""
    midnight = as_of - as_of % DAY
    today = F.col("dt") >= midnight
    yesterday = F.col("dt").between(midnight - DAY, midnight - 1)
    visit = F.when(F.col("visit_id") > 0, F.col("visit_id"))
    outside = F.col("referer").isNotNull() & ~F.col("referer").like(f"%{site}%")
    return rows_since(df, midnight - DAY).agg(
        F.count_distinct(F.when(today, visit)).alias("sessions_today"),
        F.count_distinct(F.when(yesterday, visit)).alias("sessions_yesterday"),
        F.count_if(today).alias("views_today"),
        F.count_if(yesterday).alias("views_yesterday"),
        F.count_if(today & outside).alias("referrals_today"),
        F.count_if(yesterday & outside).alias("referrals_yesterday"),
    )
