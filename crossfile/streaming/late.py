"""Saves and readings by event time: bursts, saves that were read in time, and files that were not, under a watermark.

Rows later than the watermark are counted and left out; state is dropped once the watermark says nothing more can come. All state is in
the query's checkpoint, so a restarted query goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

UNREAD = "package string, file string, saved timestamp, due timestamp"


def bursts(saves: DataFrame, gap: str = "600 milliseconds", delay: str = "10 seconds") -> DataFrame:
    """package, since, until, saves, files: saves (package, file, ts) of a package with no gap between them, told once the watermark
    has passed their end. A save that comes late but in time joins its burst, or joins two bursts to one."""
    window = F.session_window("ts", gap)
    found = saves.withWatermark("ts", delay).groupBy(window, "package").agg(F.count(F.lit(1)).alias("saves"), F.array_sort(F.collect_set("file")).alias("files"), F.max("ts").alias("until"))
    return found.select("package", F.col("session_window.start").alias("since"), "until", "saves", F.size("files").alias("files"))


def counts(saves: DataFrame, width: str = "1 minute", slide: str | None = None, delay: str = "10 seconds") -> DataFrame:
    """package, start, end, saves of tumbling windows, or of sliding ones."""
    window = F.window("ts", width, slide or width)
    found = saves.withWatermark("ts", delay).groupBy(window, "package").agg(F.count(F.lit(1)).alias("saves"))
    return found.select("package", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "saves")


def read_in_time(saves: DataFrame, readings: DataFrame, within: str = "30 seconds", delay: str = "10 seconds") -> DataFrame:
    """Saves (package, file, ts) with the readings (package, file, at, findings) of their file made within some time after them; those
    without any come with nulls, once none can come any more. Both sides are kept no longer than that."""
    s = saves.withWatermark("ts", delay).select("package", "file", "ts")
    r = readings.withWatermark("at", delay).select(F.col("package").alias("_p"), F.col("file").alias("_f"), "at", "findings")
    met = (F.col("package") == F.col("_p")) & (F.col("file") == F.col("_f")) & (F.col("at") >= F.col("ts")) & (F.col("at") <= F.col("ts") + F.expr(f"interval {within}"))
    return s.join(r, met, "leftOuter").drop("_p", "_f")


class Unread(StatefulProcessor):
    """Of a file: when it was saved last. A timer tells it, in event time, unless a reading comes first. The last reading is kept until the
    watermark passes it, as a save it followed may come in a later batch."""

    def __init__(self, seconds: int):
        self.millis = 1000 * seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.saved = handle.getValueState("saved", "ts long")
        self.read = handle.getValueState("read", "ts long")

    def _clear(self) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        all_ = pd.concat(list(rows))
        at = all_["ts"].astype("datetime64[ms, UTC]" if all_["ts"].dt.tz is not None else "datetime64[ms]").astype("int64")
        is_read = all_["read"].fillna(False).astype(bool)
        saved = max([int(x) for x in at[~is_read]], default=None)
        read = max([int(x) for x in at[is_read]], default=None)
        if self.saved.exists():
            before = int(self.saved.get()[0])
            saved = before if saved is None else max(saved, before)
        if self.read.exists():
            before = int(self.read.get()[0])
            read = before if read is None else max(read, before)
        self._clear()
        if read is not None:
            self.read.update((read,))
            self.handle.registerTimer(read + 1)
        if saved is not None and (read is None or read < saved):
            self.saved.update((saved,))
            self.handle.registerTimer(saved + self.millis)
        elif self.saved.exists():
            self.saved.clear()
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        if self.read.exists() and int(self.read.get()[0]) < now:
            self.read.clear()
        if self.saved.exists() and int(self.saved.get()[0]) + self.millis <= now:
            saved = pd.Timestamp(int(self.saved.get()[0]), unit="ms")
            self.saved.clear()
            yield pd.DataFrame({"package": [key[0]], "file": [key[1]], "saved": [saved], "due": [saved + pd.Timedelta(self.millis, "ms")]})

    def close(self) -> None:
        pass


def unread(events: DataFrame, seconds: int = 30, delay: str = "10 seconds") -> DataFrame:
    """UNREAD: files whose last save no reading has followed in time. events: package, file, ts, read (false for a save). Needs the state store
    that can keep timers (spark.sql.streaming.stateStore.providerClass: RocksDB)."""
    return events.withWatermark("ts", delay).groupBy("package", "file").transformWithStateInPandas(Unread(seconds), UNREAD, "Append", "EventTime")


def late_rows(query: StreamingQuery) -> int:
    """How many rows came later than the watermark, over the batches the query remembers."""
    return sum(int(s["numRowsDroppedByWatermark"]) for p in query.recentProgress for s in p["stateOperators"])


def state_rows(query: StreamingQuery) -> int:
    """How many rows of state the last batch left."""
    last = query.lastProgress
    return sum(int(s["numRowsTotal"]) for s in last["stateOperators"]) if last else 0
