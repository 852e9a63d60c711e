"""Re-reading a package when its files have been still for a while."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

QUIET_MS, POLL = 600, "250 milliseconds"
VERSIONS = "version long, good boolean, error string"


class Saves(DataSource):
    """Saved files below a folder. A file is told again whenever its time or size changes, and once more, without a size, when it
    is gone. What has been told is the stream's offset: time and size by path, of one package."""

    @classmethod
    def name(cls) -> str:
        return "crossfile_saves"

    def schema(self) -> str:
        return "package string, path string, ts timestamp, length long"

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return SavesReader(self.options["path"], self.options.get("glob", "*.py"))


class SavesReader(SimpleDataSourceStreamReader):
    def __init__(self, folder: str, glob: str):
        self.folder, self.glob = folder, glob

    def _now(self) -> dict[str, list[int]]:
        found = {}
        for p in sorted(Path(self.folder).rglob(self.glob)):
            try:
                s = p.stat()
            except OSError:  # gone between listing and asking
                continue
            found[str(p)] = [s.st_mtime_ns, s.st_size]
        return found

    def initialOffset(self) -> dict:
        return {"files": json.dumps(self._now())}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        end = {"files": json.dumps(self._now())}
        return self.readBetweenOffsets(start, end), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        import datetime

        old, new = json.loads(start["files"]), json.loads(end["files"])
        at = lambda ns: datetime.datetime.fromtimestamp(ns / 1e9, datetime.timezone.utc)
        rows = [(self.folder, p, at(v[0]), v[1]) for p, v in new.items() if old.get(p) != v]
        return iter(rows + [(self.folder, p, at(v[0]), None) for p, v in old.items() if p not in new])


def changes(spark: SparkSession, folder: str, glob: str = "*.py") -> DataFrame:
    """package, path, ts, length: a stream of saves below a folder from now on."""
    spark.dataSource.register(Saves)
    return spark.readStream.format("crossfile_saves").option("path", folder).option("glob", glob).load()


def quiet(stream: DataFrame, gap_ms: int = QUIET_MS) -> DataFrame:
    """package, since, until, files: bursts of changes, each told once nothing has changed for the gap, by the clock: no later
    change is needed. since, until: first and last time of a file in the burst; files: how many were changed."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            since, until, paths = state.get
            state.remove()
            yield pd.DataFrame({"package": [key[0]], "since": [pd.Timestamp(since, unit="us")], "until": [pd.Timestamp(until, unit="us")], "files": [len(json.loads(paths))]})
            return
        since, until, paths = state.get if state.exists else (None, None, "[]")
        known = set(json.loads(paths))
        for f in frames:
            us = f["ts"].astype("int64") // (1000 if str(f["ts"].dtype).startswith("datetime64[ns") else 1)
            since = int(us.min()) if since is None else min(since, int(us.min()))
            until = int(us.max()) if until is None else max(until, int(us.max()))
            known |= set(f["path"])
        state.update((since, until, json.dumps(sorted(known))))
        state.setTimeoutDuration(gap_ms)

    return stream.groupBy("package").applyInPandasWithState(step, "package string, since timestamp, until timestamp, files long", "since long, until long, paths string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def recompute(bursts: DataFrame, read: Callable[[], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """Write ``read()`` to a new version below ``target`` for every batch of bursts, and a row of VERSIONS that says whether it is good.

    A package half saved can't be read: its version is told as not good, with the reason, and the last good one stays.
    """

    def once(batch: DataFrame, version: int) -> None:
        if not batch.count():  # all of it is computed, as its state has to be kept
            return
        error = None
        try:
            read().write.mode("overwrite").parquet(f"{target}/version={version}")
        except (ValueError, OSError, PySparkException) as e:
            error = str(e).strip().split("\n")[-1]
        row = batch.sparkSession.createDataFrame([(version, error is None, error)], VERSIONS)
        row.coalesce(1).write.mode("overwrite").json(f"{target}/versions/{version}")

    return bursts.writeStream.foreachBatch(once).option("checkpointLocation", checkpoint).outputMode("append").trigger(processingTime=POLL).start()


def versions(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.schema(VERSIONS).option("recursiveFileLookup", True).json(f"{target}/versions")


def last_good(spark: SparkSession, target: str) -> DataFrame | None:
    """The rows of the last version that could be read."""
    row = versions(spark, target).where("good").agg(F.max("version").alias("v")).first()
    return None if row.v is None else spark.read.parquet(f"{target}/version={row.v}")


def wait(query: StreamingQuery, until: Callable[[], bool], seconds: float = 60.0) -> bool:
    """Whether ``until`` came true in time while the query ran."""
    end = time.monotonic() + seconds
    while time.monotonic() < end and query.isActive:
        if until():
            return True
        time.sleep(0.2)
    return until()
