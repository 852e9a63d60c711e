"""What is new and what is fixed since the last reading: as a batch join and as keyed state of a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def snapshot_diff(before: DataFrame, now: DataFrame, keys: list[str]) -> DataFrame:
    """keys, state: 'new', 'fixed' or 'told' for every key of either snapshot."""
    a, b = before.select(*keys, F.lit(1).alias("_a")), now.select(*keys, F.lit(1).alias("_b"))
    return a.join(b, keys, "full").select(*keys, F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "fixed").otherwise("told").alias("state"))


def told(stream: DataFrame) -> DataFrame:
    """Changes per (package, file) of a stream of readings: columns package, file, reading (int), id (null: no finding left).

    A reading of a file replaces the one before it; state is the sorted set of its findings. Emits package, file, reading, new, fixed.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames))
        known = set(state.get[0]) if state.exists else set()
        for reading, part in rows.groupby("reading"):
            now = set(part["id"].dropna())
            if now != known:
                yield pd.DataFrame({"package": [key[0]], "file": [key[1]], "reading": [int(reading)], "new": [sorted(now - known)], "fixed": [sorted(known - now)]})
            known = now
        state.update((sorted(known),))

    return stream.groupBy("package", "file").applyInPandasWithState(step, "package string, file string, reading int, new array<string>, fixed array<string>", "ids array<string>", "append", GroupStateTimeout.NoTimeout)
