"""Streaming form of the sliding-log admission: state per key is its log of accepted times.

Keys whose log has run out are dropped once the watermark passes, so state is bounded by the active keys; events
later than the watermark (one window behind the newest) are left out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from leadloom.operators.admission import AdmissionLog

OUTPUT = "key string, event_id long, at double, admitted boolean, retry_after int"
STATE = "times array<double>"


def admission_step(limit: int, window_seconds: int):  # noqa: ANN201
    """State function for ``applyInPandasWithState``; events of a batch are taken in (time, id) order."""

    def step(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        log = AdmissionLog(limit, window_seconds, state.get[0] if state.exists else [])
        rows = pd.concat(list(batches)).sort_values(["at", "event_id"])
        checks = [log.check(t) for t in rows["at"]]
        state.update((list(log.times),))
        last = max(log.times[-1] if log.times else 0.0, float(rows["at"].max()))
        state.setTimeoutTimestamp(max(int((last + window_seconds) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(
            {
                "key": [str(key[0])] * len(rows),
                "event_id": rows["event_id"].to_numpy(),
                "at": rows["at"].to_numpy(),
                "admitted": [a for a, _ in checks],
                "retry_after": [w for _, w in checks],
            }
        )

    return step


def admit_stream(events: DataFrame, key: str, ts: str, event_id: str, limit: int, window_seconds: int) -> DataFrame:
    """Decisions for a stream of events; a batch that restarts from its checkpoint decides the same again."""
    shaped = events.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(
        F.col(key).cast("string").alias("key"),
        F.col(event_id).cast("long").alias("event_id"),
        (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("at"),
        F.col(ts).cast("timestamp").alias("event_time"),
    ).withWatermark("event_time", f"{window_seconds} seconds")
    return shaped.groupBy("key").applyInPandasWithState(
        admission_step(limit, window_seconds), OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout
    )
