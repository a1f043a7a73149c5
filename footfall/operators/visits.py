"""Visits from hits: by inactivity, by fixed length, numbering, repeats, rate limit.

A busy visitor may own a large part of all hits. Every operator here first
reduces hits to one row per key and second, so a key has at most 86,400 rows a
day no matter how often it was seen.

Fixed visits, repeats and the rate limit are chains: each second knows the second at which the next visit would open if
one opened here, and what opens is what the chain from the first second reaches. The links are found in
slices of a key's time, and pointer doubling follows them in a number of joins that grows with the logarithm of the
longest chain, so a key that never rests is many tasks all along.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.schema import DAY, SESSION_SECONDS
from footfall.session import checkpointed


def per_second(hits: DataFrame, key: str) -> DataFrame:
    """(key, dt, hits, first_id): one row per key and second."""
    return hits.groupBy(key, "dt").agg(F.count("*").alias("hits"), F.min("id").alias("first_id"))


def with_blocks(seconds: DataFrame, key: str, gap: int, chunk: int = DAY) -> DataFrame:
    """`seconds` (one row per key and dt) with `block`: the first second since a silence of `gap` seconds.

    Windows run per key and day; what crosses midnight (last hit and open block
    of the days before) comes from one small row per key and day. A null key
    is a key like any other.
    """
    seconds = seconds.withColumn("chunk", F.call_function("div", F.col("dt"), F.lit(chunk)))
    inside = Window.partitionBy(key, "chunk").orderBy("dt")
    before = F.lag("dt").over(inside)
    marked = seconds.withColumn("opens", F.when(F.col("dt") - before >= gap, F.col("dt")))
    days = marked.groupBy(key, "chunk").agg(
        F.min("dt").alias("first"), F.max("dt").alias("last"), F.max("opens").alias("last_open")
    )
    across = Window.partitionBy(key).orderBy("chunk")
    fresh = F.coalesce(F.col("first") - F.lag("last").over(across) >= gap, F.lit(True))
    days = days.withColumn("day_open", F.when(fresh, F.col("first")))
    newest = F.coalesce("last_open", "day_open")
    carried = F.last(newest, ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1))
    days = days.select(F.col(key).alias("day_key"), F.col("chunk").alias("day_chunk"), F.coalesce("day_open", carried).alias("entry"))
    same = F.col(key).eqNullSafe(F.col("day_key")) & (F.col("chunk") == F.col("day_chunk"))
    running = F.max("opens").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    out = [c for c in seconds.columns if c != "chunk"]
    return marked.join(days, same).select(*out, F.coalesce(running, "entry").alias("block"))


def gap_starts(hits: DataFrame, key: str, gap: int = SESSION_SECONDS, chunk: int = DAY) -> DataFrame:
    """(key, dt, hits, first_id, start): the visit each second belongs to; a silence of `gap` seconds ends a visit."""
    return with_blocks(per_second(hits, key), key, gap, chunk).withColumnRenamed("block", "start")


def visits_of(starts: DataFrame, key: str) -> DataFrame:
    """One row per visit: key, start, end, hits, first_id."""
    return starts.groupBy(key, "start").agg(
        F.max("dt").alias("end"), F.sum("hits").alias("hits"), F.min("first_id").alias("first_id")
    )


_UP_TO_HERE = (Window.unboundedPreceding, 0)


def _sliced(rows: DataFrame, within: int, chunk: int) -> DataFrame:
    """`rows` with `chunk`, a slice of time, and `ahead`: copies of a slice's first `within` seconds, as the slice before sees them."""
    width = max(chunk, within)
    at = F.call_function("div", F.col("dt"), F.lit(width))
    seen = F.array(F.struct(at.alias("chunk"), F.lit(False).alias("ahead")))
    before = F.array(F.struct((at - 1).alias("chunk"), F.lit(True).alias("ahead")))
    both = F.when(F.col("dt") - at * width < within, F.concat(seen, before)).otherwise(seen)
    return rows.withColumn("slice_", F.explode(both)).select(*rows.columns, "slice_.chunk", "slice_.ahead")


def _next(sliced: DataFrame, key: str, axis: Column, ask: Column, name: str) -> DataFrame:
    """Add `name`: the dt of the first row of the same block whose `axis` is at least `ask`, as far as its slice sees.

    Every row is a place and a question on one axis; walking down it, a question's answer is the last place passed.
    """
    points = F.array(F.struct(axis.alias("t"), F.lit(0).alias("asks")), F.struct(ask.alias("t"), F.lit(1).alias("asks")))
    down = Window.partitionBy(key, "chunk").orderBy(F.desc("point_.t"), "point_.asks").rowsBetween(*_UP_TO_HERE)
    both = sliced.withColumn("point_", F.explode(points))
    place = F.when(F.col("point_.asks") == 0, F.struct("dt", "block"))
    found = both.withColumn("found_", F.last(place, ignorenulls=True).over(down)).where("point_.asks = 1")
    same = F.col("point_.t").isNotNull() & (F.col("found_.block") == F.col("block"))
    return found.withColumn(name, F.when(same, F.col("found_.dt"))).drop("point_", "found_")


def _opened(linked: DataFrame, key: str) -> DataFrame:
    """(key, dt) of every second that opens something: the first of its block, and all that `next` leads to from there.

    `linked` has key, dt, block and next. After round k the marks are the first 2^k of each chain, and jumps lead 2^k
    links ahead; the jumps run out as the chains end.
    """
    owner = F.struct(key).alias("owner")  # a null key equals itself inside
    starts = linked.where("dt = block")
    jumps = linked.where("next IS NOT NULL").select(owner, "dt", F.col("next").alias("to"))
    going = starts.where("next IS NOT NULL").select(owner, "dt", F.col("next").alias("to"))
    marks = [going.select("owner", "dt"), going.select("owner", F.col("to").alias("dt"))]
    found = marks[1:]
    while True:
        ahead = jumps.select("owner", F.col("dt").alias("to"), F.col("to").alias("far"))
        jumps = checkpointed(jumps.join(ahead, ["owner", "to"]).select("owner", "dt", F.col("far").alias("to")))
        if jumps.isEmpty():
            break
        new = reduce(DataFrame.unionByName, marks).join(jumps, ["owner", "dt"]).select("owner", F.col("to").alias("dt"))
        new = checkpointed(new)
        marks, found = [*marks, new], [*found, new]
    return reduce(DataFrame.unionByName, [starts.select(owner, "dt"), *found]).select(F.col(f"owner.{key}").alias(key), "dt")


def _latest(rows: DataFrame, marks: DataFrame, key: str, within: int, name: str, chunk: int) -> DataFrame:
    """Add `name`: the last mark (key, dt) at or before each row, which lies at most `within` seconds back."""
    width = max(chunk, within + 1)
    at = F.call_function("div", F.col("dt"), F.lit(width))
    both = rows.withColumns({"chunk": at, "mark_": F.lit(None).cast("long")}).unionByName(
        marks.select(key, "dt", F.explode(F.array(at, at + 1)).alias("chunk"), F.col("dt").alias("mark_")), allowMissingColumns=True
    )
    past = Window.partitionBy(key, "chunk").orderBy("dt", F.desc_nulls_last("mark_")).rowsBetween(*_UP_TO_HERE)
    return both.withColumn(name, F.max("mark_").over(past)).where("mark_ IS NULL").select(*rows.columns, name)


def anchors(seconds: DataFrame, key: str, length: int, name: str = "start", chunk: int = DAY) -> DataFrame:
    """For each second (key, dt: once each) the anchor it belongs to.

    The first second is an anchor; the next anchor is the first second at least `length` after it, and so on.
    A silence of `length` seconds makes the next second an anchor in any case, so chains lie in blocks
    between silences, where the next anchor is less than twice the length away.
    """
    blocks = with_blocks(seconds, key, length).select(*seconds.columns, "block")
    sliced = _sliced(blocks.select(key, "dt", "block"), 2 * length, chunk)
    linked = _next(sliced, key, F.col("dt"), F.col("dt") + length, "next").where("NOT ahead")
    linked = checkpointed(linked.select(key, "dt", "block", "next"))
    return _latest(seconds, _opened(linked, key), key, length, name, chunk)


def fixed_starts(hits: DataFrame, key: str, length: int = SESSION_SECONDS) -> DataFrame:
    """(key, dt, hits, first_id, start) for visits of fixed length.

    A hit `length` or more seconds after the start of its visit opens a new
    one; hits in between do not prolong it.
    """
    return anchors(per_second(hits, key), key, length)


def drop_repeats(hits: DataFrame, keys: list[str], seconds: int = SESSION_SECONDS, optional: str | None = None) -> DataFrame:
    """Hits without repeats: same keys within `seconds` of the last *kept* hit.

    A dropped hit does not extend the window. Of several hits in one second the smallest id is kept. A hit
    whose `optional` key is unknown (NULL) repeats any kept hit of its other keys; one that has it repeats
    only kept hits with the same.
    """

    def coded(rows: DataFrame, columns: list[str]) -> DataFrame:
        code = F.concat_ws("\u0001", *[F.coalesce(F.col(k).cast("string"), F.lit("\u0002")) for k in columns])
        return rows.withColumn("key", code)

    def chained(rows: DataFrame) -> DataFrame:
        return anchors(rows.groupBy("key", "dt").agg(F.min("id").alias("id")), "key", seconds + 1, "kept").where("dt = kept")

    if optional is None:
        kept = chained(coded(hits, keys))
        return hits.join(kept.select("id"), "id", "left_semi")
    # hits with the key don't depend on those without, so they come first; the others must then be clear of them
    known = chained(coded(hits.where(F.col(optional).isNotNull()), [*keys, optional]))
    known = checkpointed(hits.select(*keys, optional, "id").join(known.select("id", "dt"), "id"))
    open_hits = coded(hits.where(F.col(optional).isNull()), keys).groupBy("key", "dt").agg(F.min("id").alias("id"))
    at = F.call_function("div", F.col("dt"), F.lit(max(DAY, seconds + 1)))
    before = coded(known, keys).select("key", "dt", "id", F.explode(F.array(at, at + 1)).alias("chunk"), F.col("dt").alias("last"))
    asked = open_hits.withColumn("chunk", at).unionByName(before, allowMissingColumns=True)
    past = Window.partitionBy("key", "chunk").orderBy("dt", "id").rowsBetween(*_UP_TO_HERE)
    near = F.coalesce(F.col("dt") - F.max("last").over(past) <= seconds, F.lit(False))
    clear = asked.withColumn("near", near).where("last IS NULL AND NOT near").select("key", "dt", "id")
    return hits.join(known.select("id").unionByName(chained(clear).select("id")), "id", "left_semi")


def rate_limited(hits: DataFrame, key: str = "ip", most: int = 10, quiet: int = 5, chunk: int = DAY) -> DataFrame:
    """(key, dt, hits, accepted): how many hits of each second pass the limit.

    A counter admits `most` hits and lives through `quiet` seconds after the
    last admitted one; refused hits do not keep it alive. A counter that opens here is full at the first second by which
    its block has had `most` hits, and the next one opens at the first second more than `quiet` after that.
    """
    seconds = hits.groupBy(key, "dt").agg(F.count("*").alias("hits"))
    blocks = with_blocks(seconds, key, quiet + 1).select(*seconds.columns, "block")
    within = (most + 2) * (quiet + 1)  # seconds of a block are at most `quiet` apart and have a hit each
    sliced = _sliced(blocks, within, chunk)
    summed = sliced.withColumn("upto", F.sum("hits").over(Window.partitionBy(key, "chunk").orderBy("dt").rowsBetween(*_UP_TO_HERE)))
    full = _next(summed, key, F.col("upto"), F.col("upto") - F.col("hits") + most, "full")
    linked = _next(full, key, F.col("dt"), F.col("full") + quiet + 1, "next").where("NOT ahead")
    linked = checkpointed(linked.select(key, "dt", "block", "next"))
    placed = _latest(seconds, _opened(linked, key), key, within, "opening", chunk)
    earlier = Window.partitionBy(key, "opening").orderBy("dt").rowsBetween(Window.unboundedPreceding, -1)
    left = F.greatest(F.lit(most) - F.coalesce(F.sum("hits").over(earlier), F.lit(0)), F.lit(0))
    return placed.withColumn("accepted", F.least("hits", left)).select(key, "dt", "hits", "accepted")


def number_visits(visits: DataFrame, key: str, base: int = 0) -> DataFrame:
    """Distinct rising visit numbers above `base`.

    Numbers rise with the visit start: visits are counted per day, the days
    (few rows) are summed up in order, and inside a day visits are ranked in
    slices of one second each, again summed up. No window sees more than one
    second's visits or one day's seconds.
    """
    day = F.call_function("div", F.col("start"), F.lit(DAY))
    counted = visits.groupBy("start").agg(F.count("*").alias("n")).withColumn("day", day)
    of_day = Window.partitionBy("day").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    seconds = counted.withColumn("before", F.coalesce(F.sum("n").over(of_day), F.lit(0)))
    days = counted.groupBy("day").agg(F.sum("n").alias("n"))
    # One row per calendar day of history: the only unpartitioned order.
    earlier = days.withColumn("one", F.lit(1))
    of_all = Window.partitionBy("one").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    offsets = earlier.select("day", F.coalesce(F.sum("n").over(of_all), F.lit(0)).alias("offset"))
    placed = seconds.join(offsets, "day").select("start", (F.col("before") + F.col("offset")).alias("before"))
    within = Window.partitionBy("start").orderBy(key)
    ranked = visits.withColumn("rank", F.row_number().over(within)).join(placed, "start")
    return ranked.withColumn("visit_id", F.col("before") + F.col("rank") + base).drop("before", "rank")


def header_breaks(page: DataFrame) -> DataFrame:
    """`new_block` where the access log starts a new visit header.

    `page` is one page of the log (a bounded number of rows), newest first.
    """
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("dt"), F.desc("id"))
    different = F.lag("id").over(order).isNull()
    for c in ("visit_id", "ip", "browser", "platform", "username"):
        different = different | ~F.col(c).eqNullSafe(F.lag(c).over(order))
    print_seen = F.coalesce(F.col("fingerprint") != "", F.lit(False))
    different = different | (print_seen & ~F.col("fingerprint").eqNullSafe(F.lag("fingerprint").over(order)))
    return page.withColumn("new_block", different)
