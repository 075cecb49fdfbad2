"""Collections that arrive as a stream and expire: keyed state with event-time timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What the stream tells of a collection: how many references it holds, and whether it was loaded or has expired.
TOLD = "collection string, loaded boolean, members long, at timestamp"


class Held(StatefulProcessor):
    """The references of one collection, until ``idle`` milliseconds of event time pass without an upload."""

    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # One entry a reference, so that a large collection is no single value.
        self.members = handle.getMapState("members", "reference string", "seen boolean")
        self.last = handle.getValueState("last", "ms long, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.last.get() if self.last.exists() else None
        last, n = (held[0], held[1]) if held else (None, 0)
        newest = last
        for batch in rows:
            at = batch["at"].max()
            ms = int(at.timestamp() * 1000)
            newest = ms if newest is None else max(newest, ms)
            for text in batch["reference"].dropna().drop_duplicates():
                if not self.members.containsKey((text,)):
                    self.members.updateValue((text,), (True,))
                    n += 1
        if last is not None and last != newest:
            self.handle.deleteTimer(last + self.idle)
        if last != newest:
            self.handle.registerTimer(newest + self.idle)
        self.last.update((newest, n))
        yield pd.DataFrame({"collection": [key[0]], "loaded": [True], "members": [n], "at": [pd.Timestamp(newest, unit="ms")]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n = self.last.get()[1] if self.last.exists() else 0
        self.members.clear()
        self.last.clear()
        yield pd.DataFrame({"collection": [key[0]], "loaded": [False], "members": [n], "at": [pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")]})

    def close(self) -> None:
        pass


def held_collections(uploads: DataFrame, idle_seconds: int = 3600, late: str = "10 seconds") -> DataFrame:
    """A stream of (collection, reference, at) -> a stream of (collection, loaded, members, at): a row for each batch that adds to
    a collection, with its distinct references so far, and one when ``idle_seconds`` of event time have passed since its
    last upload; then it is empty again. Uploads later than ``late`` behind the watermark are dropped. The state lives in
    the checkpoint, so a restart forgets nothing. Needs a state store of column families (RocksDB)."""
    asked = uploads.where(F.col("collection").isNotNull()).select("collection", "reference", "at").withWatermark("at", late)
    return asked.groupBy("collection").transformWithStateInPandas(Held(idle_seconds * 1000), TOLD, "append", "EventTime")
