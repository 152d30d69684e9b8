"""Alarms over a stream of events: failures in a row, and silence."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ALARM = "key bigint, kind string, at timestamp, streak bigint"


class Alarms(StatefulProcessor):
    """Of each key: `failures` when a row of that many failures is reached, `silence` when nothing came for a while.

    State of a key: its failures in a row, and when it was last heard of. Events of a
    key count in the order of their time and id within a batch; later batches count as
    later. Silence is told once: by the next event, if that came first, or by a timer at the
    last event plus `silent_ms` of event time, once the watermark has passed it; a second one, after `forget_ms`, drops the state.
    """

    def __init__(self, in_a_row: int, silent_ms: int, forget_ms: int):
        self.in_a_row, self.silent_ms, self.forget_ms = in_a_row, silent_ms, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "streak bigint, heard bigint, told boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        streak, heard, told = self.state.get() if self.state.exists() else (0, None, False)
        out = []
        for batch in rows:
            for at, bad in batch.sort_values(["at", "id"])[["at", "bad"]].itertuples(index=False):
                now = at.value // 1_000_000
                if heard is not None and now > heard + self.silent_ms and not told:
                    out.append((key[0], "silence", pd.Timestamp(heard + self.silent_ms, unit="ms"), streak))
                streak = streak + 1 if bad else 0
                heard, told = max(heard or now, now), False
                if streak == self.in_a_row:
                    out.append((key[0], "failures", at, streak))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(heard + self.silent_ms)
        self.state.update((streak, heard, told))
        yield pd.DataFrame(out, columns=["key", "kind", "at", "streak"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        streak, heard, told = self.state.get() if self.state.exists() else (0, 0, True)
        due = expiredTimerInfo.getExpiryTimeInMs()
        if due >= heard + self.forget_ms:
            self.state.clear()
            return
        self.handle.registerTimer(heard + self.forget_ms)
        if told or due < heard + self.silent_ms:
            return
        self.state.update((streak, heard, True))
        yield pd.DataFrame([(key[0], "silence", pd.Timestamp(due, unit="ms"), streak)], columns=["key", "kind", "at", "streak"])

    def close(self) -> None:
        pass


def alarms(events: DataFrame, *, in_a_row: int = 3, silent: str = "2 days", late: str = "0 seconds", forget_ms: int = 90 * 86_400_000) -> DataFrame:
    """key, kind, at, streak of a stream of events (key bigint, at timestamp, id, bad boolean), which needs the RocksDB state store."""
    silent_ms = int(pd.Timedelta(silent).total_seconds() * 1000)
    if not 0 < silent_ms < forget_ms:
        raise ValueError("silent must be shorter than what is forgotten")
    return events.withWatermark("at", late).groupBy("key").transformWithStateInPandas(Alarms(in_a_row, silent_ms, forget_ms), ALARM, "append", "EventTime")
