"""Which files changed together, from git."""

from __future__ import annotations

import subprocess
from pathlib import Path

from crossfile.schemas import TABLES
from crossfile.sources.files import commits
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SOURCES = (".py", ".ts", ".tsx", ".mts", ".cts")
COMMITS = 1000


def prefix_of(package_dir: Path) -> str:
    """The package's path from git's top; empty without git."""
    try:
        top = subprocess.run(["git", "rev-parse", "--show-toplevel"], capture_output=True, text=True, cwd=package_dir, check=True).stdout.strip()
        return str(package_dir.resolve().relative_to(top))
    except (OSError, subprocess.CalledProcessError, ValueError):
        return ""


def parse(text: DataFrame, prefix: str, root: str = "") -> DataFrame:
    """commit_files of a captured log: rows (pos, value), a commit each: a line of hash and subject, then files."""
    lines = text.select("pos", F.split(F.trim("value"), "\n").alias("l")).where("size(l) > 1")
    head = lines.select(F.split_part(F.col("l")[0], F.lit(" "), F.lit(1)).alias("hash"), F.regexp_replace(F.col("l")[0], "^[^ ]* ?", "").alias("subject"), F.col("pos").cast("int").alias("pos"), F.explode(F.expr("slice(l, 2, size(l))")).alias("path"))
    under = head.where(F.startswith("path", F.lit(prefix + "/"))).where(" or ".join(f"endswith(path, '{s}')" for s in SOURCES))
    return under.select("hash", "subject", "pos", F.concat(F.lit(root), F.expr(f"substring(path, {len(prefix) + 1})")).alias("file")).distinct()


def commit_files(spark: SparkSession, package_dir: Path) -> DataFrame:
    """commit_files of a package, its log read by executors, some commits each."""
    rows = commits(spark, package_dir, COMMITS)
    return parse(rows, prefix_of(package_dir), package_dir.name).to(StructType.fromDDL(TABLES["commit_files"]))
