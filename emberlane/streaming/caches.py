"""The caches of a session as streaming state: texts with a lifetime, of which the least recently used one makes room.

State is a map of texts and one value per session; an event-time timer clears a session that has been idle for its lifetime, which is
when its last text has expired as well. A limit on the number of sessions guards a process's memory and has no equivalent here.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SIZE, LIFETIME = 50, 3600
OUTPUT = "session string, event long, hit boolean, held int, fresh boolean"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class SessionCache(StatefulProcessor):
    """One row an event: whether its text was held, how many texts are held after it, and whether the session's cache was new."""

    def __init__(self, size: int, lifetime: float):
        self.size, self.lifetime = size, lifetime

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.texts = handle.getMapState("texts", "text string", "since double, used long")
        self.last = handle.getValueState("last", "at double, uses long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        stored = {k[0]: (v[0], v[1]) for k, v in self.texts.iterator()}
        held = OrderedDict(sorted(stored.items(), key=lambda x: x[1][1]))  # the least recently used one first
        at, uses = self.last.get() if self.last.exists() else (None, 0)
        out = []
        for r in pd.concat(list(rows)).sort_values(["at", "event"]).itertuples():
            fresh = at is None or r.at - at > self.lifetime
            if fresh:
                held.clear()
            at, uses = r.at, uses + 1
            since = held[r.text][0] if r.text in held else None
            hit = since is not None and r.at - since < self.lifetime
            held.pop(r.text, None)
            held[r.text] = (since if hit else r.at, uses)
            if len(held) > self.size:
                held.popitem(last=False)
            out.append((key[0], r.event, hit, len(held), fresh))
        for text in stored.keys() - held.keys():
            self.texts.removeKey((text,))
        for text, value in held.items():
            if stored.get(text) != value:
                self.texts.updateValue((text,), value)
        self.last.update((at, uses))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(max(int((at + self.lifetime) * 1000) + 1, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame(out, columns=["session", "event", "hit", "held", "fresh"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.texts.clear()
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def session_caches(events: DataFrame, session: str, event: str, text: str, time: str, size: int = SIZE, lifetime: float = LIFETIME, late: str = "1 hour") -> DataFrame:
    """Streaming input with a timestamp ``time``; see :class:`SessionCache`. Rows of a session come in order of time within a micro-batch.

    Start the query within :func:`state_with_timers`.
    """
    rows = events.withWatermark(time, late).select(F.col(session).cast("string").alias("session"), F.col(event).cast("long").alias("event"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), (F.unix_micros(F.col(time).cast("timestamp")) / 1e6).alias("at"), F.col(time).alias("time"))
    return rows.groupBy("session").transformWithStateInPandas(SessionCache(size, lifetime), OUTPUT, "Append", "EventTime")


@contextmanager
def state_with_timers(spark: SparkSession) -> Iterator[None]:
    """The state store that maps and timers need, for queries that start inside; the session's setting comes back after it."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)
