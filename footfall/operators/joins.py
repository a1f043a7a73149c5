"""Joins between page views, events and lookup tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.functions.addresses import address_bits, address_key, cidr_prefix, number_key, range_prefixes
from footfall.operators.aggregates import ranked
from footfall.schema import LIST_LIMIT, SESSION_SECONDS

CLICK = "_ype:click%"


def join_on(
    left: DataFrame, right: DataFrame, pair: tuple[str, str] | None = None, condition: Column | None = None,
    also: list[Column] | None = None, how: str = "inner",
) -> DataFrame:
    """General join: an equality pair or a condition, plus further conditions.

    Physical strategy is left to the optimizer; a condition should hold at
    least one equality.
    """
    test = condition if pair is None else left[pair[0]] == right[pair[1]]
    for extra in also or []:
        test = test & extra
    return left.join(right, test, how)


def events_with_pageview(events: DataFrame, pageviews: DataFrame, limit: int | None = None) -> DataFrame:
    """Custom events with address and page of their page view, newest first.

    The time range belongs to `pageviews`.
    """
    custom = events.where(~F.col("notes").like(CLICK))
    out = custom.join(pageviews.select("id", "ip", "resource"), "id")
    return out.orderBy(F.desc("dt"), F.desc("event_id")).limit(limit) if limit else out


def top_events(events: DataFrame, pageviews: DataFrame | None = None, limit: int = LIST_LIMIT) -> DataFrame:
    """Most frequent custom events; with `pageviews` only events of those rows."""
    custom = events.where(~F.col("notes").like(CLICK))
    if pageviews is not None:
        custom = custom.join(pageviews.select("id"), "id", "left_semi")
    return ranked(custom.groupBy("notes").agg(F.count("*").alias("counthits")), "counthits", ["notes"], limit)


def subject_events(events: DataFrame, pageviews: DataFrame, email: str) -> DataFrame:
    """Events of one person, by way of the page views with that e-mail."""
    return events.join(pageviews.where(F.col("email") == email).select("id"), "id", "left_semi")


def latest_visit(
    probes: DataFrame, history: DataFrame, keys: list[str], seconds: int = SESSION_SECONDS, optional: tuple[str, ...] = ()
) -> DataFrame:
    """For each probe (keys, dt) the visit of the latest earlier-or-same row.

    A key that is `optional` and unknown (NULL) in the probe matches any row; the probes are parted by which
    of these they lack. The history is first narrowed to the probes' keys, then both sides are reduced to
    one row per key and second. Windows run per key and time slot of eight look-back lengths; a row near the
    end of its slot is repeated in the next. So a window holds at most nine lengths of seconds, however
    busy a key is.
    """
    if optional:
        first, *rest = optional
        known = latest_visit(probes.where(F.col(first).isNotNull()), history, keys, seconds, tuple(rest))
        fewer = [k for k in keys if k != first]
        lacking = latest_visit(probes.where(F.col(first).isNull()), history, fewer, seconds, tuple(rest))
        lacking = lacking.withColumn(first, F.lit(None).cast(probes.schema[first].dataType))
        return known.unionByName(lacking).select(*keys, "dt", "visit_found")
    history = history.join(probes.select(*keys).distinct(), keys, "left_semi")
    size = F.lit(8 * seconds)
    asked = probes.select(*keys, "dt", F.lit(None).cast("bigint").alias("visit_id"), F.lit(None).cast("bigint").alias("id"),
                          F.lit(True).alias("probe"))
    known = history.select(*keys, "dt", "visit_id", "id", F.lit(False).alias("probe"))
    each = asked.unionByName(known).groupBy(*keys, "dt").agg(
        F.max_by("visit_id", "id").alias("found"), F.bool_or("probe").alias("probe")
    )
    own, later = F.call_function("div", F.col("dt"), size), F.call_function("div", F.col("dt") + seconds, size)
    slots = F.when(F.col("found").isNotNull(), F.array_distinct(F.array(own, later))).otherwise(F.array(own))
    placed = each.withColumn("slot", F.explode(slots))
    window = Window.partitionBy(*keys, "slot").orderBy("dt").rangeBetween(-seconds, 0)
    out = placed.withColumn("visit_found", F.last("found", ignorenulls=True).over(window))
    return out.where(F.col("probe") & (F.col("slot") == own)).select(*keys, "dt", "visit_found")


def flag_new_visitors(df: DataFrame) -> DataFrame:
    """`is_new`: the first row in which a fingerprint is seen.

    One aggregate per fingerprint (combined before the shuffle) names the first
    id; ids are unique, so joining it back cannot pile up on one key.
    """
    first = df.where("fingerprint <> ''").groupBy("fingerprint").agg(F.min_by("id", F.struct("dt", "id")).alias("id"))
    marked = first.select("id", F.lit(True).alias("is_new"))
    return df.join(marked, "id", "left").withColumn("is_new", F.coalesce("is_new", F.lit(False)))


def mark_spam(df: DataFrame, spam: DataFrame) -> DataFrame:
    """`spam` tells whether the address is in the spam list (column ip)."""
    listed = spam.select("ip").distinct().withColumn("spam", F.lit(True))
    return df.join(listed, "ip", "left").withColumn("spam", F.coalesce("spam", F.lit(False)))


def hits_per_article(pageviews: DataFrame, articles: DataFrame, count: str = "id") -> DataFrame:
    """Per article: distinct ids (or addresses) of pages whose URL begins with its path.

    `articles` has (article_id, path). Pages are counted once each, then every
    page is expanded into its own prefixes, whose lengths are those that occur
    among the articles (at most as many as a URL has characters), and meets the
    articles by equality.
    """
    pages = pageviews.where("resource IS NOT NULL").groupBy("resource").agg(F.count_distinct(count).alias("n"))
    lengths = [r[0] for r in articles.select(F.length("path")).distinct().collect()]
    fitting = F.filter(F.array(*[F.lit(n) for n in sorted(lengths)]).cast("array<int>"), lambda n: n <= F.length("resource"))
    prefixes = pages.select("n", F.explode(fitting).alias("size"), "resource")
    prefixes = prefixes.select(F.substr("resource", F.lit(1), F.col("size")).alias("path"), "n")
    sums = prefixes.join(articles.select("path").distinct(), "path").groupBy("path").agg(F.sum("n").alias("counthits"))
    out = articles.join(sums, "path", "left")
    return out.select("article_id", "path", F.coalesce("counthits", F.lit(0)).alias("counthits"))


def meet_prefixes(addresses: DataFrame, prefixes: DataFrame, key: Column) -> DataFrame:
    """`addresses` joined with all `prefixes` (column prefix) that its address begins with, by equality.

    Every address is cut to the lengths that occur among the prefixes, at most 129.
    """
    lengths = sorted(r[0] for r in prefixes.select(F.length("prefix")).where("prefix IS NOT NULL").distinct().collect())
    cuts = F.transform(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: F.substring(F.col("bits_"), F.lit(1), n))
    cut = addresses.withColumn("bits_", address_bits(key)).where("bits_ IS NOT NULL").withColumn("prefix", F.explode(cuts)).drop("bits_")
    return cut.join(prefixes, "prefix").drop("prefix")


def geo_lookup(hits: DataFrame, ranges: DataFrame, address: str = "ip", with_city: bool = True) -> DataFrame:
    """Country, city and location of an address from a range table.

    `ranges` has low, high (IPv4 numbers, or 32 hex digits for any address), country_code, city,
    subdivision, latitude, longitude; ranges do not overlap. Each range becomes the few binary prefixes that
    cover it, however wide it is, and every distinct address meets them by equality.
    """
    kind = dict(ranges.dtypes)["low"]
    ends = {c: address_bits(F.col(c) if kind == "string" else number_key(c)) for c in ("low", "high")}
    prefixes = ranges.withColumns(ends).withColumn("prefix", F.explode(range_prefixes("low", "high"))).drop("low", "high")
    found = meet_prefixes(hits.select(address).distinct(), prefixes, address_key(address))
    place = F.when(F.col("subdivision") != "", F.concat("city", F.lit(" ("), "subdivision", F.lit(")"))).otherwise(F.col("city"))
    known = found.where("lower(country_code) <> 'xx' AND country_code <> ''").select(
        address,
        F.lower("country_code").alias("geo_country"),
        (place if with_city else F.lit(None).cast("string")).alias("geo_city"),
        (F.concat_ws(",", "latitude", "longitude") if with_city else F.lit(None).cast("string")).alias("geo_location"),
    )
    return hits.join(known, address, "left")


def in_range_table(hits: DataFrame, ranges: DataFrame, addresses: list[str], name: str) -> DataFrame:
    """Add the boolean `name`: one of the hit's `addresses` lies in one of many `ranges` (column cidr), which come as a table."""
    prefixes = ranges.select(cidr_prefix("cidr").alias("prefix")).where("prefix IS NOT NULL").distinct()
    asked = hits.select(F.explode(F.array(*addresses)).alias("address_")).distinct()
    inside = meet_prefixes(asked, prefixes, address_key("address_")).select("address_").distinct()
    out, flags = hits, []
    for i, a in enumerate(addresses):
        flags.append(f"inside{i}_")
        out = out.join(inside.select(F.col("address_").alias(f"address{i}_"), F.lit(True).alias(flags[-1])), F.col(a) == F.col(f"address{i}_"), "left").drop(f"address{i}_")
    return out.withColumn(name, F.coalesce(*flags, F.lit(False))).drop(*[f for f in flags if f != name])


def with_titles(df: DataFrame, titles: DataFrame, key: str = "resource") -> DataFrame:
    """Display title of a key; the key itself where none is known. `titles` has (key, title)."""
    return df.join(titles, key, "left").withColumn("title", F.coalesce("title", key))


def damaged_positions(events: DataFrame, pageviews: DataFrame) -> DataFrame:
    """Event positions without a comma, with the width of their screen."""
    bare = events.where(F.col("position").rlike("^[0-9]+$"))
    wide = pageviews.where("screen_width > 0").select("id", "screen_width")
    return bare.join(wide, "id").select("event_id", "position", "screen_width")
