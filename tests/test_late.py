"""Event time: late saves are counted, state is dropped, a restarted query goes on."""

import json
import os
from datetime import datetime, timedelta

import pytest
from crossfile.streaming import late

START = datetime(2024, 5, 1, 12)
SAVES = "package string, file string, ts timestamp"
READINGS = "package string, file string, at timestamp, findings int"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Feed:
    """A folder of JSON lines, a file for each batch."""

    def __init__(self, folder, schema):
        self.folder, self.schema, self.n = folder, schema, 0
        folder.mkdir()

    def put(self, *rows):
        names = [c.split()[0] for c in self.schema.split(", ")]
        lines = [json.dumps({k: (START + timedelta(seconds=v)).isoformat() if k in ("ts", "at") else v for k, v in zip(names, r, strict=True)}) for r in rows]
        (self.folder / f"{self.n:04}.json").write_text("\n".join(lines))
        self.n += 1

    def stream(self, spark):
        return spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).json(str(self.folder))


def run(stream, out, checkpoint):
    q = stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(checkpoint)).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert q.exception() is None
    return q


def seconds(t):
    return (t - START).total_seconds()


def test_bursts_late_rows_and_a_restart(spark, tmp_path):
    feed = Feed(tmp_path / "saves", SAVES)
    feed.put(("p", "a", 0), ("p", "b", 3), ("q", "a", 1))
    feed.put(("p", "a", 7), ("p", "c", 40))
    go = lambda: run(late.bursts(feed.stream(spark), "5 seconds", "10 seconds"), tmp_path / "out", tmp_path / "check")
    first = go()
    assert late.late_rows(first) == 0
    feed.put(("p", "late", 2), ("p", "d", 42))  # the first is older than the watermark of 30
    feed.put(("p", "e", 100), ("q", "e", 100))
    feed.put(("p", "f", 200), ("q", "f", 200))
    second = go()  # goes on from the checkpoint
    assert late.late_rows(second) == 1
    got = sorted((r.package, seconds(r.since), seconds(r.until), r.saves, r.files) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("p", 0, 7, 3, 2), ("p", 40, 42, 2, 2), ("p", 100, 100, 1, 1), ("q", 1, 1, 1, 1), ("q", 100, 100, 1, 1)]
    assert late.state_rows(second) == 2  # the last of both packages, nothing before


def test_windows_slide(spark, tmp_path):
    feed = Feed(tmp_path / "saves", SAVES)
    feed.put(("p", "a", 5), ("p", "a", 65), ("p", "b", 95))
    feed.put(("p", "z", 600))
    feed.put(("p", "z", 601))
    run(late.counts(feed.stream(spark), "60 seconds", "30 seconds"), tmp_path / "out", tmp_path / "check")
    got = sorted((seconds(r.start), r.saves) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(-30, 1), (0, 1), (30, 1), (60, 2), (90, 1)]


def test_saves_meet_readings_in_time(spark, tmp_path):
    saves, readings = Feed(tmp_path / "saves", SAVES), Feed(tmp_path / "readings", READINGS)
    saves.put(("p", "a", 0), ("p", "b", 0), ("q", "a", 5))
    readings.put(("p", "a", 10, 3), ("p", "b", 31, 1), ("q", "z", 6, 0))
    saves.put(("p", "a", 200))
    readings.put(("p", "a", 200, 2))
    saves.put(("p", "x", 400))
    readings.put(("p", "x", 500, 2))
    q = run(late.read_in_time(saves.stream(spark), readings.stream(spark), "30 seconds"), tmp_path / "out", tmp_path / "check")
    got = sorted((r.package, r.file, seconds(r.ts), r.findings) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert [g for g in got if g[2] < 400] == [("p", "a", 0, 3), ("p", "a", 200, 2), ("p", "b", 0, None), ("q", "a", 5, None)]
    assert late.state_rows(q) <= 4  # what was met or can't be met is gone


@pytest.fixture
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_timers_tell_files_that_nobody_read(spark, tmp_path, rocks):
    feed = Feed(tmp_path / "events", "package string, file string, ts timestamp, read boolean")
    feed.put(("p", "a", 0, False), ("p", "b", 1, False), ("q", "a", 2, False))
    feed.put(("p", "a", 8, True), ("q", "a", 9, False))
    feed.put(("p", "z", 60, False))
    go = lambda: run(late.unread(feed.stream(spark), 30), tmp_path / "out", tmp_path / "check")
    go()
    feed.put(("p", "z", 61, True), ("q", "y", 200, True))
    feed.put(("q", "y", 201, True))
    go()
    got = sorted((r.package, r.file, seconds(r.saved), seconds(r.due)) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("p", "b", 1, 31), ("q", "a", 9, 39)]


def test_a_reading_that_comes_before_its_save_is_one(spark, tmp_path, rocks):
    """Batches out of order, within the watermark; files are read in the order of their times, set here."""
    feed = Feed(tmp_path / "events", "package string, file string, ts timestamp, read boolean")
    feed.put(("p", "a", 8, True), ("q", "a", 9, False))
    feed.put(("p", "a", 0, False), ("p", "b", 1, False), ("q", "a", 2, False))
    feed.put(("p", "d", 12, False), ("p", "c", 12, True))
    feed.put(("p", "z", 60, True))
    feed.put(("p", "z", 200, True))
    for i, f in enumerate(sorted(feed.folder.iterdir())):
        os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))
    run(late.unread(feed.stream(spark), 30), tmp_path / "out", tmp_path / "check")
    got = sorted((r.package, r.file, seconds(r.saved), seconds(r.due)) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("p", "b", 1, 31), ("p", "d", 12, 42), ("q", "a", 9, 39)]
