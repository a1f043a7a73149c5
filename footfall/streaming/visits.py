"""Visits, repeats and rate limits over a stream, with state per key.

The state of a key is one or two numbers. Of a micro-batch only the distinct
seconds of a key (with their counts) are held, not its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from footfall.schema import SESSION_SECONDS
from footfall.streaming.live import WATERMARK


def gap_visits(hits: DataFrame, key: str, watermark: str = "1 hour") -> DataFrame:
    """Visits that end after thirty quiet minutes, once the watermark has passed them.

    Times count in whole seconds. A session window also takes a row exactly at
    its end, so a window one second shorter parts visits at a gap of 1,800 s.
    """
    timed = hits.withColumn("ts", F.date_trunc("second", "ts")).withWatermark("ts", watermark)
    visits = timed.groupBy(F.col(key), F.session_window("ts", f"{SESSION_SECONDS - 1} seconds")).agg(
        F.count("*").alias("hits"), F.unix_timestamp(F.max("ts")).alias("end")
    )
    return visits.select(key, F.unix_timestamp("session_window.start").alias("start"), "end", "hits")


def _combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Hits of one Arrow batch reduced to one row per key and second."""
    for batch in batches:
        yield batch.groupby(["key", "dt"], as_index=False).agg(hits=("id", "size"), id=("id", "min"))


def _seconds(batches: Iterator[pd.DataFrame]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct seconds of a key in order, hits per second, smallest id per second."""
    whole: pd.DataFrame | None = None
    for batch in batches:
        rows = batch[["dt", "hits", "id"]] if whole is None else pd.concat([whole, batch[["dt", "hits", "id"]]])
        whole = rows.groupby("dt", as_index=False).agg(hits=("hits", "sum"), id=("id", "min"))
    return whole["dt"].to_numpy(), whole["hits"].to_numpy(), whole["id"].to_numpy()


def _keyed(hits: DataFrame, key: str, work, output: str, state: str, rest: int, watermark: str) -> DataFrame:
    """Run `work` per key; hits are combined per second before the shuffle.

    A null key is the key NULL, told apart from any text. Once the watermark lies `rest` seconds behind a
    key's last second its state can't matter any more and is dropped; rows behind the watermark are left to
    the nightly pass.
    """
    named = F.when(F.col(key).isNotNull(), F.concat(F.lit("="), F.col(key).cast("string"))).otherwise("")
    rows = hits.select(named.alias("key"), "dt", "id")
    combined = rows.mapInPandas(_combine, "key string, dt long, hits long, id long")
    timed = combined.withColumn("ts", F.timestamp_seconds("dt")).withWatermark("ts", watermark)

    def step(owner, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        last = 0
        for out in work(owner, batches, held):
            last = max(last, int(out.attrs["last"]))
            yield out
        held.setTimeoutTimestamp(max((last + rest + 1) * 1000, held.getCurrentWatermarkMs() + 1))

    timeout = GroupStateTimeout.EventTimeTimeout
    found = timed.groupBy("key").applyInPandasWithState(step, output, state, "append", timeout)
    return found.withColumn("key", F.when(F.col("key") != "", F.substring("key", 2, 1 << 20)))


def _result(dt: np.ndarray, columns: dict) -> pd.DataFrame:
    out = pd.DataFrame(columns)
    out.attrs["last"] = int(dt.max())
    return out


def _anchors(dt: np.ndarray, open_at: int | None, length: int) -> tuple[np.ndarray, int | None]:
    out, at = np.empty(len(dt), dtype=np.int64), 0
    while at < len(dt):
        if open_at is None or dt[at] >= open_at + length:
            open_at = int(dt[at])
        until = int(np.searchsorted(dt, open_at + length))
        out[at:until] = open_at
        at = until
    return out, open_at


def fixed_visits(hits: DataFrame, key: str, length: int = SESSION_SECONDS, watermark: str = WATERMARK) -> DataFrame:
    """(key, dt, hits, start): the fixed-length visit of every second.

    A row that arrives behind the open visit's start counts to that visit.
    """

    def work(owner, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        dt, n, _ = _seconds(batches)
        start, open_at = _anchors(dt, state.get[0] if state.exists else None, length)
        state.update((int(open_at),))
        yield _result(dt, {"key": owner[0], "dt": dt, "hits": n, "start": start})

    return _keyed(hits, key, work, "key string, dt long, hits long, start long", "open_at long", length, watermark)


def drop_repeats(hits: DataFrame, keys: list[str], seconds: int = SESSION_SECONDS, watermark: str = WATERMARK) -> DataFrame:
    """(key, dt, id) of hits that do not repeat a kept hit within `seconds`.

    A row that arrives out of order is a repeat if it lies within `seconds` of the kept hit, before or behind it.
    """
    label = F.concat_ws("\u0001", *[F.coalesce(F.col(k).cast("string"), F.lit("\u0002")) for k in keys])

    def work(owner, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        dt, _, ids = _seconds(batches)
        known = state.get[0] if state.exists else None
        early = dt < (known if known is not None else -1)
        kept_early = early & (dt + seconds < (known if known is not None else 0))
        before, _ = _anchors(dt[kept_early], None, seconds + 1)
        start, open_at = _anchors(dt[~early], known, seconds + 1)
        if open_at is not None:
            state.update((int(open_at),))
        kept = np.zeros(len(dt), bool)
        kept[np.flatnonzero(kept_early)] = before == dt[kept_early]
        kept[np.flatnonzero(~early)] = (start == dt[~early]) & (dt[~early] != (known if known is not None else -1))
        yield _result(dt, {"key": owner[0], "dt": dt[kept], "id": ids[kept]})

    return _keyed(hits.withColumn("label", label), "label", work, "key string, dt long, id long", "open_at long", seconds, watermark)


def rate_limited(hits: DataFrame, key: str = "ip", most: int = 10, quiet: int = 5, watermark: str = WATERMARK) -> DataFrame:
    """(key, dt, hits, accepted): how many hits of each second pass the limit."""

    def work(owner, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        dt, n, _ = _seconds(batches)
        used, last = state.get if state.exists else (0, None)
        accepted = np.empty(len(dt), dtype=np.int64)
        for i, (second, count) in enumerate(zip(dt.tolist(), n.tolist())):
            if last is None or second - last > quiet:
                used = 0
            accepted[i] = min(count, most - used)
            if accepted[i]:
                used, last = used + int(accepted[i]), second
        state.update((used, last))
        yield _result(dt, {"key": owner[0], "dt": dt, "hits": n, "accepted": accepted})

    return _keyed(hits, key, work, "key string, dt long, hits long, accepted long", "used long, last long", quiet, watermark)
