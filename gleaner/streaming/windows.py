"""Timed state of the request audit: the open window of each key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

#: Seconds that requests may come late before a window's state goes.
LATE_SECONDS = 3600
#: Counts that a task holds before it sends them on.
HELD = 200_000


def count_per_second(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``(key_hash, second, n)`` from a task's ``(key_hash, second)`` rows: few rows, whatever a key sends."""
    held: pd.Series | None = None

    def rows(counts: pd.Series) -> pd.DataFrame:
        return counts.rename("n").reset_index()

    for pdf in batches:
        counts = pdf.groupby(["key_hash", "second"], dropna=False).size()
        held = counts if held is None else held.add(counts, fill_value=0).astype("int64")
        if len(held) > HELD:
            yield rows(held)
            held = None
    if held is not None and len(held):
        yield rows(held)


class OpenWindow(StatefulProcessor):
    """A key's first request opens a window; the first one after its end opens the next.

    Counts of a batch are walked in time order. A request that arrives late counts into the open window, as it would at the
    gate, so none is lost. State is one row: the window's start and its requests. A timer is set to the window's end; when the
    watermark has passed it, the key's state is cleared, and a key that is not heard of any more costs nothing. A request
    that comes later still opens a window of its own.
    """

    def __init__(self, window_seconds: int):
        self.window_seconds = window_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "window_start bigint, requests bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        counts: dict[int, int] = {}
        for pdf in rows:
            for second, n in zip(pdf["second"].tolist(), pdf["n"].tolist()):
                counts[second] = counts.get(second, 0) + n
        start, requests = self.open.get() if self.open.exists() else (None, 0)
        touched: dict[int, int] = {}
        for second in sorted(counts):
            if start is None or second >= start + self.window_seconds:
                start, requests = second, 0
            requests += counts[second]
            touched[start] = requests
        if start is None:
            return
        self.open.update((start, requests))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        # Not before the next batch: a window that the watermark has passed is kept as long as its batch.
        self.handle.registerTimer(max(1000 * (start + self.window_seconds), timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame({"key_hash": [key[0]] * len(touched), "window_start": list(touched), "requests": list(touched.values())})

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.open.clear()
        return iter(())

    def close(self) -> None:
        pass
