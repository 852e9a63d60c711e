"""Findings by check, folder and module with their subtotals, and how files and scores move over commits and days."""

from __future__ import annotations

from crossfile.functions.scalars import folder
from crossfile.operators.lineage import dealt
from crossfile.operators.temporal import as_of, innermost, last_rows, trailing
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The levels of a breakdown, by what stays of check, folder and module.
SETS = (("check", "folder", "module"), ("check", "folder"), ("check",), ("folder", "module"), ("folder",), ())


def breakdown(findings: DataFrame) -> DataFrame:
    """check, folder, module, level, findings, symbols: counts of every level of SETS. level has a bit for what is summed over (4 check, 2
    folder, 1 module), which tells a subtotal from a folder or module that is null."""
    module = F.split_part("symbol", F.lit(":"), F.lit(1))
    rows = findings.select("check", "symbol", module.alias("module")).withColumn("folder", folder(F.col("module")))
    sets = [[F.col(c) for c in s] for s in SETS]
    level = F.grouping_id("check", "folder", "module").cast("int").alias("level")
    out = rows.groupingSets(sets, F.col("check"), F.col("folder"), F.col("module")).agg(level, F.count(F.lit(1)).alias("findings"), F.count_distinct("symbol").alias("symbols"))
    return out.select("check", "folder", "module", "level", "findings", "symbols")


def churn(changes: DataFrame, commits: int = 10, days: int = 30) -> DataFrame:
    """changes (file, hash, at, lines) with the lines of the file's last ``commits`` changes, and the changes and lines of the last ``days``.
    Changes of one moment are ordered by their hash."""
    n = changes.count()
    rows = last_rows(dealt(changes, n, "file"), ["file"], ["at", "hash", "lines"], commits, lines_lately=F.col("lines"))
    return trailing(rows, ["file"], "at", days, n, changes_in_days=F.lit(1), lines_in_days=F.col("lines"))


def score_moves(scores: DataFrame, commits: int = 10, days: int = 30) -> DataFrame:
    """scores (key, hash, at, value) of every axis at every commit, with its change since the last one, its mean over the last ``commits`` and
    over the last ``days``. Commits of one moment are ordered by their hash."""
    before = Window.partitionBy("key").orderBy("at", "hash")
    rows = scores.withColumn("change", F.col("value") - F.lag("value").over(before))
    rows = last_rows(rows, ["key"], ["at", "hash"], commits, _sum=F.col("value"), _n=F.lit(1)).withColumn("lately", F.col("_sum") / F.col("_n"))
    rows = trailing(rows, ["key"], "at", days, _sum_days=F.col("value"), _n_days=F.lit(1)).withColumn("in_days", F.col("_sum_days") / F.col("_n_days"))
    return rows.drop("_sum", "_n", "_sum_days", "_n_days")


def brought_by(findings: DataFrame, changes: DataFrame) -> DataFrame:
    """findings (file, seen, ...) with the last change of their file by then: hash and since."""
    return as_of(findings, changes.select("file", F.col("at").alias("since"), "hash"), ["file"], "seen", "since")


def functions_around(lines: DataFrame, functions: DataFrame) -> DataFrame:
    """lines (file, line, ...) with the innermost function around them: sid, start, end."""
    return innermost(lines, functions.select("file", "start", "end", "sid"), ["file"], "line", "start", "end")
