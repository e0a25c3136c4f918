"""Reuse of results on a stream of requests, with state that ends by event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_OUT = "id long, served boolean, run long"
_HOUR_US = 3_600_000_000


class _Reuse(StatefulProcessor):
    """Keeps the last request of a key that ran, until no request can be served from it."""

    def __init__(self, hours: int):
        self.span = hours * _HOUR_US

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "t long, id long, ok boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["t", "id"])
        known = self.last.get()
        at, run, ok = known if known is not None else (0, -1, False)
        served, by = [], []
        for t, i, good in zip(pdf.t.tolist(), pdf.id.tolist(), pdf.ok.tolist()):
            reused = bool(ok) and t <= at + self.span
            if not reused:
                at, run, ok = t, i, bool(good)
            served.append(reused)
            by.append(run)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.last.update((at, run, ok))
        # the moment after the last one that the result serves, in whole milliseconds
        self.handle.registerTimer((at + self.span) // 1000 + 1)
        yield pd.DataFrame({"id": pdf.id.tolist(), "served": served, "run": by})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def reuse(log: DataFrame, hours: int = 24, delay: str = "1 hour") -> DataFrame:
    """The stream of ``operators.requests.reuse``: ``id, served, run`` for requests (key, ts, id, ok).

    Requests of a key may come out of order inside a micro-batch but not over micro-batches; those later than ``delay`` are dropped by the watermark, as are those without a time; those without a key are one key. A timer on event time
    removes a key's state once the watermark has passed the last moment that its result serves. A micro-batch's requests of one key are sorted in memory: bound the batch at the source. Needs
    ``spark.sql.streaming.stateStore.providerClass`` set to the RocksDB provider."""
    rows = log.withWatermark("ts", delay).select("key", F.unix_micros("ts").alias("t"), "id", F.coalesce("ok", F.lit(False)).alias("ok"), "ts")
    return rows.groupBy("key").transformWithStateInPandas(_Reuse(hours), _OUT, "append", "eventTime")
