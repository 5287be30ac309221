"""Structured Streaming: successor pairs as events arrive, block counts behind a watermark, and late pairs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

PAIRS = "case_id long, origin timestamp, destination timestamp, transition string, delay double"


def _pairs(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Pairs of one case; the state is its last event."""
    if state.hasTimedOut:
        state.remove()
        return
    last = state.get if state.exists else None
    rows = pd.concat(list(frames)).sort_values(["ts", "ord"])
    out = []
    for r in rows.itertuples():
        if last is not None and r.ts >= last[0]:  # an event before the last one seen is late: batch pairing has it
            out.append((key[0], last[0], r.ts, f"{last[1]} -> {r.activity}", (r.ts - last[0]).total_seconds() / 3600))
        if last is None or r.ts >= last[0]:
            last = (r.ts.to_pydatetime(), r.activity)
    state.update(last)
    yield pd.DataFrame(out, columns=["case_id", "origin", "destination", "transition", "delay"])


def stream_pairs(events: DataFrame) -> DataFrame:
    """Directly-follows pairs of a stream of (case_id, ts timestamp, ord, activity), with a state of one event a case."""
    return events.groupBy("case_id").applyInPandasWithState(_pairs, PAIRS, "ts timestamp, activity string", "append", GroupStateTimeout.NoTimeout)


def stream_blocks(pairs: DataFrame, start: str, days: int, lateness: str = "90 days") -> DataFrame:
    """(window, transition, n, burden) of calendar blocks counted from `start`; closed once the watermark passes them."""
    window = F.window("origin", f"{days} days", startTime=f"{_offset(start, days)} seconds")
    return pairs.withWatermark("origin", lateness).groupBy(window, "transition").agg(F.count("*").alias("n"), F.sum("delay").alias("burden"))


def _offset(start: str, days: int) -> int:
    return int(pd.Timestamp(start, tz="UTC").timestamp()) % (days * 86400)


def availability_stream(pairs: DataFrame, decision: str) -> DataFrame:
    """Each pair with whether it was recorded before the decision, or later."""
    return pairs.withColumn("available", F.col("destination") < F.lit(decision).cast("timestamp"))


