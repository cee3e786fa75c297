"""Sliding-log admission: at most ``limit`` accepted events per key in any window; rejected ones leave no trace.

Whether an event is accepted depends on which earlier ones were, so this is a fold in time order per key and no
window aggregate. ``AdmissionLog`` is the one implementation behind the batch and the streaming form. Its state is
at most ``limit`` times per key; the batch form streams sorted rows through it and never holds a key's rows.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class AdmissionLog:
    def __init__(self, limit: int, window_seconds: float, times: Iterable[float] = (), ceil: bool = False):
        self.limit, self.window, self.ceil = limit, window_seconds, ceil
        self.times = deque(times)

    def check(self, now: float) -> tuple[bool, int]:
        """(accepted, seconds to wait)."""
        while self.times and self.times[0] <= now - self.window:
            self.times.popleft()
        if len(self.times) >= self.limit:
            wait = self.times[0] + self.window - now
            return False, max(1, math.ceil(wait) if self.ceil else int(wait))
        self.times.append(now)
        return True, 0


def admit(
    events: DataFrame, key: str, ts: str, tie: str, limit: int, window_seconds: int, partitions: int | None = None
) -> DataFrame:
    """``events`` with ``admitted`` and ``retry_after``; order per key is (``ts``, ``tie``).

    Rows with a NULL key or time are left out. One exchange by key, a sort inside each partition, then one pass.
    """
    fields = events.schema.fields
    kept = events.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).withColumn(
        "_at", F.unix_micros(F.col(ts).cast("timestamp"))
    )
    kept = kept.repartition(partitions, key) if partitions else kept.repartition(key)
    ordered = kept.sortWithinPartitions(key, "_at", tie)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", admitted boolean, retry_after int"

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, log = None, None
        for b in batches:
            ok, wait = [], []
            for k, at in zip(b[key], b["_at"], strict=True):
                if log is None or k != current:
                    current, log = k, AdmissionLog(limit, window_seconds)
                a, w = log.check(at / 1e6)
                ok.append(a)
                wait.append(w)
            yield b.drop(columns="_at").assign(admitted=ok, retry_after=wait)

    return ordered.mapInPandas(run, schema)
