"""Movement and population events on streams.

Rows are timestamped; late ones beyond the watermark are dropped.  Both detectors keep one small value for each pane
(a slide's time) of a session: a sum, or a bitmap of cells.  Windows are unions of panes; a timer for each window's
end fires when the watermark passes it.  A row with a null value (or cell) says that a session's signal has ended:
then all windows that hold samples are judged, and what is open is closed at the last sample.

State is kept by transformWithState, for which the session needs the RocksDB state store (``use_state_store``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_STORE = "spark.sql.streaming.stateStore.providerClass"


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def movement_windows(signal: DataFrame, window: str, slide: str, threshold: float, late: str = "1 minute") -> DataFrame:
    """Sliding windows whose mean passes the threshold; signal: (session_id, ts, value)."""
    w = signal.withWatermark("ts", late).groupBy("session_id", F.window("ts", window, slide)).agg(F.avg("value").alias("mean"), F.count("value").alias("n"))
    return w.filter(F.col("mean") > threshold)


def _ms(text: str) -> int:
    return int(pd.Timedelta(text).total_seconds() * 1000)


class Panes(StatefulProcessor):
    """Panes of a session, and the windows over them.  What a pane holds, and what a window means, is the detector's."""

    PANE, OPEN = "", "start long, end long, n long"

    def __init__(self, window: str, slide: str, threshold: float, gap: str = "0 s"):
        self.width, self.slide, self.gap, self.threshold = _ms(window), _ms(slide), _ms(gap), threshold
        if self.width % self.slide:
            raise ValueError("a window has to be a number of slides")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.panes = handle.getMapState("panes", "at long", self.PANE)
        self.open = handle.getValueState("open", self.OPEN)
        self.seen = handle.getValueState("seen", "fired long, last long")

    def close(self) -> None:
        pass

    # -- of the detectors

    def added(self, pane: Row | None, rows: pd.DataFrame) -> tuple:
        raise NotImplementedError

    def judged(self, panes: list[Row]) -> float:
        raise NotImplementedError

    def hit(self, key: tuple, start: int, end: int, value: float) -> list[tuple]:
        raise NotImplementedError

    def closed(self, key: tuple, now: int | None, last: int) -> list[tuple]:
        return []

    # -- common

    def _frame(self, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame(rows, columns=self.COLUMNS)

    def _seen(self) -> tuple[int, int]:
        """The latest timer that has fired, and the last sample's time."""
        return tuple(self.seen.get()) if self.seen.exists() else (-(1 << 60), -(1 << 60))

    def _window(self, key: tuple, start: int) -> list[tuple]:
        held = [self.panes.getValue((at,)) for at in range(start, start + self.width, self.slide) if self.panes.containsKey((at,))]
        if not held:
            return []
        value = self.judged(held)
        return self.hit(key, start, start + self.width, value)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        data = pd.concat(list(rows))
        ms = data["ms"].astype("int64")
        ended = data["value"].isna()
        fired, last = self._seen()
        last = max(last, int(ms[~ended].max())) if (~ended).any() else last
        self.seen.update((fired, last))
        # all timers up to the latest have fired by now: their windows need no panes
        for (at,) in list(self.panes.keys()):
            if at + self.width <= fired:
                self.panes.removeKey((at,))
        data = data.assign(_pane=ms // self.slide * self.slide)[~ended]
        for at, own in data.groupby("_pane"):
            k = (int(at),)
            self.panes.updateValue(k, self.added(self.panes.getValue(k) if self.panes.containsKey(k) else None, own))
            for start in range(k[0] - self.width + self.slide, k[0] + 1, self.slide):
                self.handle.registerTimer(start + self.width)
        if ended.any():
            yield from self._frame(self._end(key, fired, last))

    def _end(self, key: tuple, fired: int, last: int) -> list[tuple]:
        """All windows that have not fired, then what is still open."""
        starts = {s for (at,) in self.panes.keys() for s in range(at - self.width + self.slide, at + 1, self.slide) if s + self.width > fired}
        out = []
        for s in sorted(starts):
            out += self.closed(key, s + self.width, last)
            out += self._window(key, s)
        out += self.closed(key, None, last)
        self.panes.clear()
        return out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        fired, last = self._seen()
        now = expiredTimerInfo.getExpiryTimeInMs()
        self.seen.update((max(fired, now), last))
        yield from self._frame(self.closed(key, now, last) + self._window(key, now - self.width))


class CellCounts(Panes):
    """Windows with at least so many different cells; a pane is a bitmap of cells."""

    PANE, COLUMNS = "cells binary", ["session_id", "start", "end", "n"]

    def added(self, pane, rows):
        bits = int.from_bytes(pane[0], "little") if pane else 0
        for c in rows["value"].astype("int64").unique().tolist():
            bits |= 1 << c
        return (bits.to_bytes((bits.bit_length() + 7) // 8, "little"),)

    def judged(self, panes):
        bits = 0
        for p in panes:
            bits |= int.from_bytes(p[0], "little")
        return bits.bit_count()

    def hit(self, key, start, end, value):
        return [(key[0], start, end, int(value))] if value >= self.threshold else []


class Movements(Panes):
    """Windows whose mean passes a threshold, joined while the next ends at most a gap later."""

    PANE, COLUMNS = "sum double, n long", ["session_id", "start", "end", "n_windows"]

    def added(self, pane, rows):
        total, n = (pane[0], pane[1]) if pane else (0.0, 0)
        return (float(total + rows["value"].sum()), int(n + len(rows)))

    def judged(self, panes):
        return sum(p[0] for p in panes) / sum(p[1] for p in panes)

    def hit(self, key, start, end, value):
        if value > self.threshold:
            was = self.open.get() if self.open.exists() else None
            self.open.update((start, end, 1) if was is None else (was[0], end, was[2] + 1))
            self.handle.registerTimer(end + self.gap + 1)
        return []

    def closed(self, key, now, last):
        """The open movement, where the next window would end too late for it, or the signal has ended."""
        if not self.open.exists():
            return []
        start, end, n = self.open.get()
        if now is not None and now <= end + self.gap:
            return []
        self.open.clear()
        return [(key[0], start, min(end, last), n)]


def _detected(rows: DataFrame, value: str, processor: Panes, late: str, count: str) -> DataFrame:
    told = rows.select("session_id", "ts", F.unix_millis("ts").alias("ms"), F.col(value).cast("double").alias("value")).withWatermark("ts", late)
    found = told.groupBy("session_id").transformWithStateInPandas(processor, f"session_id string, start long, end long, {count} long", "append", "eventTime")
    return found.select("session_id", F.timestamp_millis("start").alias("start"), F.timestamp_millis("end").alias("end"), count)


def stream_movement(signal: DataFrame, window: str, slide: str, threshold: float, gap: str, late: str = "1 minute") -> DataFrame:
    """Movements (session_id, start, end, n_windows): windows whose mean passes the threshold, joined until a gap; signal:
    (session_id, ts, value).  A movement ends with its last window, or with the last sample before that."""
    return _detected(signal, "value", Movements(window, slide, threshold, gap), late, "n_windows")


def stream_events(activity: DataFrame, window: str, slide: str, threshold: int, late: str = "1 minute", exact: bool = True) -> DataFrame:
    """Windows with at least so many different active cells; activity: (session_id, cell, ts).

    The count is exact for any slide.  exact=False: an approximate count by Spark's own window aggregate.
    """
    if not exact:
        w = activity.withWatermark("ts", late).groupBy("session_id", F.window("ts", window, slide)).agg(F.approx_count_distinct("cell").alias("n"))
        return w.filter(F.col("n") >= threshold).select("session_id", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n")
    return _detected(activity, "cell", CellCounts(window, slide, threshold), late, "n")
