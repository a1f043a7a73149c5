"""Live numbers over a stream of hits with an event time `ts`.

Hits are never late in a tracker that stamps them on arrival; the watermark is
what bounds the state here, and rows behind it are left to `late.py`.

A visit is online in the thirty minutes that follow each of its hits. The stream says when a visit comes online (+1) and when it
goes (-1), and the number online is their running sum: two rows for a visit, however many hits it has.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from footfall.operators.visits import gap_starts, visits_of
from footfall.schema import DAY

WATERMARK = "1 hour"
MINUTE = 60
#: Minutes that a hit keeps its visit online.
ONLINE = 30
_SPELL = (ONLINE + 1) * MINUTE
#: Groups of visits that have their state together.
GROUPS = 1024


def merged_spells(spells: list[tuple[int, int]], minutes: list[int]) -> list[tuple[int, int]]:
    """Spells (first and last minute with a hit) with more minutes; a spell goes on if a hit falls into its online minutes."""
    found: list[tuple[int, int]] = []
    for low, high in sorted([*spells, *((m, m) for m in minutes)]):
        if found and low < found[-1][1] + _SPELL:
            found[-1] = (found[-1][0], max(found[-1][1], high))
        else:
            found.append((low, high))
    return found


def online_changes(hits: DataFrame, visit: str = "visit_id", watermark: str = WATERMARK, groups: int = GROUPS) -> DataFrame:
    """(visit, minute, change, watermark): +1 when a visit comes online, -1 when it has gone.

    The state of a visit is its spells that the watermark hasn't passed, one as a rule; a timer ends them. A
    hit that arrives out of order may move or join spells; what was said before is taken back by the opposite
    change. Hits behind the watermark are left to the nightly pass. `watermark` is the watermark (in seconds) when the row was sent.

    Visits are dealt by a hash to `groups`, each with one state and one timer for the first of its spells that ends, so Python is
    called once for a group and a batch, not for a visit. The number holds for the stream's life.
    """

    def distinct(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.drop_duplicates()

    rows = hits.where(F.col(visit).isNotNull()).select(F.col(visit).cast("string").alias("visit"), (F.call_function("div", F.unix_timestamp("ts"), F.lit(MINUTE)) * MINUTE).alias("minute"))
    timed = rows.mapInPandas(distinct, "visit string, minute long").withColumn("ts", F.timestamp_seconds("minute")).withWatermark("ts", watermark)
    dealt = timed.withColumn("part", F.pmod(F.xxhash64("visit"), F.lit(groups)))

    def step(_, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {v: [(low, high) for low, high in spells] for v, spells in json.loads(state.get[0]).items()} if state.exists else {}
        minutes: dict[str, set[int]] = {}
        for batch in () if state.hasTimedOut else batches:
            for v, minute in zip(batch["visit"].tolist(), batch["minute"].tolist(), strict=True):
                minutes.setdefault(v, set()).add(minute)
        now, sent = state.getCurrentWatermarkMs() // 1000, []
        for v, seen in minutes.items():
            before = held.get(v, [])
            held[v] = merged_spells(before, sorted(seen))
            old, new = {low for low, _ in before}, {low for low, _ in held[v]}
            sent += [(v, low + MINUTE, 1) for low in sorted(new - old)] + [(v, low + MINUTE, -1) for low in sorted(old - new)]
        sent += [(v, high + _SPELL, -1) for v, spells in held.items() for _, high in spells if high + _SPELL <= now]
        left = {v: [s for s in spells if s[1] + _SPELL > now] for v, spells in held.items()}
        left = {v: spells for v, spells in left.items() if spells}
        if left:
            state.update((json.dumps(left),))
            first = min(spells[0][1] for spells in left.values()) + _SPELL
            state.setTimeoutTimestamp(max(first * 1000, state.getCurrentWatermarkMs() + 1))
        else:
            state.remove()
        yield pd.DataFrame({"visit": [v for v, _, _ in sent], "minute": [m for _, m, _ in sent], "change": [c for _, _, c in sent], "watermark": [max(now, 0)] * len(sent)})

    return dealt.groupBy("part").applyInPandasWithState(step, "visit string, minute long, change int, watermark long", "spells string", "append", GroupStateTimeout.EventTimeTimeout)


def stored_changes(hits: DataFrame, visit: str = "visit_id") -> DataFrame:
    """(minute, change) of stored hits (visit, dt), as `online_changes` says them in the end."""
    minutes = hits.where(F.col(visit).isNotNull()).select(visit, (F.call_function("div", F.col("dt"), F.lit(MINUTE)) * MINUTE).alias("dt"), F.lit(0).alias("id"))
    spells = visits_of(gap_starts(minutes, visit, _SPELL), visit)
    both = F.array(F.struct((F.col("start") + MINUTE).alias("minute"), F.lit(1).alias("change")), F.struct((F.col("end") + _SPELL).alias("minute"), F.lit(-1).alias("change")))
    return spells.select(F.inline(both))


def online_numbers(changes: DataFrame) -> DataFrame:
    """(minute, online) for minutes with somebody online, as the running sum of changes.

    Changes are summed per minute and counted through per day, from what the days before leave. No window sees more than one day's
    minutes or one row per day.
    """
    day = F.call_function("div", F.col("minute"), F.lit(DAY))
    each = changes.groupBy("minute").agg(F.sum("change").alias("change")).where("change <> 0").withColumn("day", day)
    days = each.groupBy("day").agg(F.sum("change").alias("change")).withColumn("one", F.lit(1))
    order = Window.partitionBy("one").orderBy("day")
    days = days.withColumns({"before": F.coalesce(F.sum("change").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "until": F.lead("day").over(order)})
    # a row for the start of each day up to the next one with changes
    first = days.select(F.explode(F.sequence("day", F.coalesce(F.col("until") - 1, "day"))).alias("day"), F.col("day").alias("from_day"), "before", "change")
    first = first.select("day", (F.col("day") * DAY).alias("minute"), (F.col("before") + F.when(F.col("day") > F.col("from_day"), F.col("change")).otherwise(0)).alias("change"))
    steps = first.unionByName(each.select("day", "minute", "change")).groupBy("day", "minute").agg(F.sum("change").alias("change"))
    inside = Window.partitionBy("day").orderBy("minute")
    counted = steps.withColumns({"online": F.sum("change").over(inside.rowsBetween(Window.unboundedPreceding, 0)), "next": F.lead("minute", 1).over(inside)})
    last = F.coalesce("next", (F.col("day") + 1) * DAY) - MINUTE
    return counted.where("online > 0").select(F.explode(F.sequence("minute", last, F.lit(MINUTE).cast("long"))).alias("minute"), F.col("online").cast("long").alias("online"))


def minute_series(hits: DataFrame, value: str, watermark: str = WATERMARK) -> DataFrame:
    """Exact distinct values per minute, for minutes the watermark has passed.

    Repeats of a value in a minute are dropped first, so the count that follows
    is a plain one and no set is kept per minute.
    """
    minute = F.window("ts", "1 minute")
    timed = hits.where(F.col(value).isNotNull()).withColumn("ts", F.date_trunc("minute", "ts"))
    once = timed.withWatermark("ts", watermark).dropDuplicates(["ts", value])
    counted = once.groupBy(minute).agg(F.count("*").alias("cnt"))
    return counted.select(F.unix_timestamp("window.start").alias("minute"), "cnt")


def stored_minutes(hits: DataFrame, value: str) -> DataFrame:
    """(minute, cnt) of stored hits, as `minute_series` counts them."""
    minute = F.unix_timestamp(F.date_trunc("minute", "ts")).alias("minute")
    return hits.where(F.col(value).isNotNull()).groupBy(minute).agg(F.count_distinct(value).alias("cnt"))
