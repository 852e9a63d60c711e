"""Small Spark helpers the operators share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossfile.ship import ship as ship_library

#: Bytes of an Arrow batch, so that what tasks hold of texts doesn't depend on how long these are. Spark's own is 64 MB.
BATCH = "8m"
_DEFAULT = "67108864b"


def ship(spark: SparkSession) -> None:
    """Give executors this package, as they share no folder with the driver, and bound batches of texts in bytes as well as rows."""
    ship_library(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", _DEFAULT) == _DEFAULT:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the checkpoint folder; where none is set, as in tests, below a temporary one, but never on a cluster."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = sc._jsc.sc().getCheckpointDir()
        if not held.isDefined() and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = held.get() if held.isDefined() else os.path.join(tempfile.gettempdir(), "crossfile-checkpoints")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The frame written to the shared folder and read back: its lineage ends, and lost executors cost nothing."""
    at = shared_folder(df.sparkSession)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def remove(df: DataFrame) -> None:
    """Delete the files of a frame that ``cut`` returned."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for at in {os.path.dirname(x) for x in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small(df: DataFrame, limit_rows: int) -> bool:
    """Whether a frame has at most ``limit_rows`` rows: the check before any broadcast."""
    return df.limit(limit_rows + 1).count() <= limit_rows


def text_key(col: str = "doc_id"):
    """crc32 of the id as text; null ids count as the empty string."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))
