"""Cutting the lineage of iterative plans through the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset a temporary one, as in tests, but never on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = os.path.join(tempfile.gettempdir(), "crossfile-shared")
    return base.rstrip("/")


def cut(df: DataFrame, by: str | None = None) -> DataFrame:
    """The frame written below the shared folder and read back, so a lost executor loses nothing of it; in folders by a column
    of strings, if one is named, for readers of single values."""
    spark = df.sparkSession
    at = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    writer = df.write.partitionBy(by) if by else df.write
    writer.parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out._written_at = at
    return out


#: Rows to a task of ``dealt``, if they were even.
ROWS_A_TASK = 1 << 20


def dealt(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """The frame dealt by columns to as many tasks as so many rows need, so that a task's memory does not grow with the input: partitions
    that are merged by their compressed size, or as many for every input, may hold any number of rows."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_A_TASK)), *by)


def drop(*frames: DataFrame) -> None:
    """Delete the files of frames that ``cut`` returned and that nothing reads any more: rounds of a loop that a later one holds."""
    for at in {f.__dict__.get("_written_at") for f in frames} - {None}:
        spark = frames[0].sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
