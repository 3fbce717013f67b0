"""Keyed reuse state on a request stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = T.StructType([T.StructField("request_id", T.LongType()), T.StructField("hit", T.BooleanType())])
STATE = T.StructType([T.StructField("written_us", T.LongType())])


class ReuseState(StatefulProcessor):
    """Last write per key; a hit does not extend its life."""

    def __init__(self, ttl_seconds: int, keep_ms: int | None):
        self.ttl_us = ttl_seconds * 1_000_000
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        if self.keep_ms is None:
            self.written = handle.getValueState("written", STATE)
        else:
            self.written = handle.getValueState("written", STATE, ttlDurationMs=self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.written.get()[0] if self.written.exists() else None
        for frame in rows:
            frame = frame.sort_values(["us", "request_id"])
            hits = []
            for us in frame["us"].tolist():
                hit = last is not None and us - last < self.ttl_us
                if not hit:
                    last = us
                hits.append(hit)
            yield pd.DataFrame({"request_id": frame["request_id"].to_numpy(), "hit": hits})
        if last is not None:
            self.written.update((int(last),))

    def close(self) -> None:
        pass


def stream_reuse(requests: DataFrame, keys: list[str], ttl_seconds: int = 300, keep_ms: int | None = None) -> DataFrame:
    """``hit`` per request (request_id, us = event time in microseconds, key columns) in arrival order.

    With ``keep_ms`` the state of idle keys is dropped by processing time, which bounds it on an endless stream (needs
    the RocksDB state store); without, the state lives as long as the checkpoint, for runs over what is available.
    """
    return requests.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=ReuseState(ttl_seconds, keep_ms), outputStructType=OUT, outputMode="Append",
        timeMode="None" if keep_ms is None else "ProcessingTime",
    )
