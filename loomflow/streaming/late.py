"""Pairs behind a watermark: events wait until no earlier one is expected, late ones go to a side output, idle cases are forgotten.

A late event is one that arrives when the watermark has passed it. The watermark is set
on one column, the operator gets another of the same times, so that Spark keeps such
rows and they are told apart here. Needs the RocksDB state store.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "case_id long, kind string, origin timestamp, destination timestamp, transition string, delay double"
_COLUMNS = ["case_id", "kind", "origin", "destination", "transition", "delay"]


def _millis(ts) -> int:
    return int(pd.Timestamp(ts).value // 1_000_000)


class Pairing(StatefulProcessor):
    """State of a case: events that wait, and the last one that was paired."""

    def __init__(self, idle: timedelta):
        self.idle = int(idle.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts timestamp, ord long, activity string")
        self.last = handle.getValueState("last", "ts timestamp, activity string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        late, timers = [], set()
        for frame in rows:
            for r in frame.itertuples():
                if _millis(r.ts) < mark:
                    late.append((key[0], "late", r.ts, None, r.activity, None))
                else:
                    self.waiting.appendValue((r.ts.to_pydatetime(), int(r.ord), r.activity))
                    timers.add(_millis(r.ts))
        for t in timers:
            self.handle.registerTimer(t)
        yield pd.DataFrame(late, columns=_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark, out = timerValues.getCurrentWatermarkInMs(), []
        waiting = sorted(self.waiting.get()) if self.waiting.exists() else []
        due = [w for w in waiting if _millis(w[0]) <= mark]
        last = self.last.get() if self.last.exists() else None
        for ts, _, activity in due:
            if last is not None:
                out.append((key[0], "pair", last[0], ts, f"{last[1]} -> {activity}", (ts - last[0]).total_seconds() / 3600))
            last = (ts, activity)
        if due:
            self.last.update(last)
            self.handle.registerTimer(_millis(last[0]) + self.idle)
            self.waiting.clear()
            if len(due) < len(waiting):
                self.waiting.put(waiting[len(due) :])
        if last is not None and not self.waiting.exists() and _millis(last[0]) + self.idle <= mark:
            self.last.clear()
        yield pd.DataFrame(out, columns=_COLUMNS)

    def close(self) -> None:
        pass


def paired(events: DataFrame, lateness: str, idle: timedelta) -> DataFrame:
    """Pairs (kind pair) and late events (kind late; `origin` their time, `transition` their activity) of a stream of (case_id long, ts timestamp, ord long, activity).

    A pair comes out once the watermark, `lateness` behind the latest event, has passed
    its destination, so that it equals the batch's but for late events. A case without
    events for `idle` behind the watermark loses its state; its next event starts anew.
    """
    own = events.withWatermark("ts", lateness).select("case_id", (F.col("ts") + F.expr("INTERVAL 0 SECONDS")).alias("ts"), F.col("ord").cast("long").alias("ord"), "activity")
    return own.groupBy("case_id").transformWithStateInPandas(Pairing(idle), OUTPUT, "Append", "EventTime")


def late_by_block(rows: DataFrame, start: str, days: int) -> DataFrame:
    """(block, late, pairs) of what paired() wrote: late events, and pairs, by calendar blocks of their origin."""
    block = F.floor(F.timestamp_diff("SECOND", F.lit(start).cast("timestamp"), F.col("origin")) / (days * 86400)).cast("int")
    return rows.groupBy(block.alias("block")).agg(F.count_if(F.col("kind") == "late").alias("late"), F.count_if(F.col("kind") == "pair").alias("pairs"))
