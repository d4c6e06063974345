"""Streams of evaluation events: appending records once, counts in event-time windows, and the protocol as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessella.operators import protocol


def first_by_key(stream: DataFrame, key: str, time: str, delay: str = "1 hour") -> DataFrame:
    """The first record of each key; state older than the watermark is dropped."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, time: str, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Events by type in tumbling windows."""
    return events.withWatermark(time, delay).groupBy(F.window(time, width).alias("span"), "event_type").agg(F.count("*").alias("n")).select(F.col("span.start").alias("start"), "event_type", "n")


def _advanced(idle_ms: int):
    """Leads an attempt's state over the events of one trigger; an attempt idle for longer than idle_ms is forgotten."""

    def run(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        at, taken = state.get if state.exists else (0, 0)
        events = pd.concat(chunks).sort_values(["ord", "symbol"], kind="stable")
        for symbol in events["symbol"]:
            at = protocol.TABLES[symbol][at]
        state.update((at, taken + len(events)))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), int(events["ms"].max())) + idle_ms)
        yield pd.DataFrame({"attempt_id": [key[0]], "at": [at], "events": [taken + len(events)]})

    return run


def replayed(stream: DataFrame, time: str, delay: str = "1 hour", idle_ms: int = 86_400_000) -> DataFrame:
    """attempt_id, stage, rated, error and events (their number so far) of each attempt that a trigger's events concern.

    The state of an attempt is two numbers. Its events are taken in their order within a trigger, and triggers as they come;
    events later than the watermark are still taken as long as their attempt is known.
    """
    events = stream.withWatermark(time, delay).select("attempt_id", "ord", protocol.symbol().alias("symbol"), F.col(time).alias("time"), F.unix_millis(time).alias("ms"))
    ended = events.groupBy("attempt_id").applyInPandasWithState(_advanced(idle_ms), "attempt_id long, at int, events long", "at int, events long", "update", GroupStateTimeout.EventTimeTimeout)
    return protocol.named(ended)
