"""Checks, readers and aggregates of a user's own.

A check is a function from facts to findings; registered, it is found, ordered, excused, printed and scored like the 24. A reader is a
table function (``@udtf``) from a file's name and content to facts as JSON; the engine lists and splits the files. An aggregate is
registered by name and called from checks and from SQL.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from crossfile.facts import Facts
from crossfile.operators.lineage import cut
from crossfile.rules import Project
from crossfile.schemas import TABLES
from crossfile.ship import ship
from crossfile.sources.files import sources
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

AXES = ("alive", "lean", "private", "shaped", "focused")


@dataclass(frozen=True)
class Check:
    """find: from facts to rows of ``schemas.FINDING``. axis: which axis of the score its findings weigh on, if any."""

    name: str
    find: Callable[[Facts], DataFrame]
    title: str
    note: str
    axis: str | None = None
    weight: int = 1


_REGISTERED: dict[str, Check] = {}


def register(check: Check) -> None:
    """Run a check with the others from now on, after them."""
    from crossfile.plans.checks import CHECKS

    if check.name in CHECKS:
        raise ValueError(f"{check.name} is the engine's own")
    if check.axis is not None and check.axis not in AXES:
        raise ValueError(f"no axis {check.axis}: one of {', '.join(AXES)}")
    _REGISTERED[check.name] = check


def unregister(name: str) -> None:
    _REGISTERED.pop(name, None)


def registered() -> dict[str, Check]:
    return dict(_REGISTERED)


def aggregate(spark: SparkSession, name: str, of: Callable, returns: str) -> None:
    """An aggregate over pandas series, called by name: ``F.call_function(name, column)``, or in SQL."""
    spark.udf.register(name, F.pandas_udf(of, returns, F.PandasUDFType.GROUPED_AGG))


def read(spark: SparkSession, folder: str | Path, suffixes: tuple[str, ...], reader, rules: Project | None = None) -> Facts:
    """Facts of the files below a folder by a table function (name string, content binary) -> (fact string, row string): the name of one of
    ``schemas.TABLES`` and a row of it as JSON. Without ``ord`` rows are ordered by file, then as they are told."""
    ship(spark)
    spark.udtf.register("crossfile_reader", reader)
    found = sources(spark, folder, suffixes)
    told = spark.sql("select s.place, f.fact, f.row from {found} s, lateral crossfile_reader(s.name, s.content) f", found=found)
    rows = cut(told.select("place", F.monotonically_increasing_id().alias("at"), "fact", "row"), by="fact")

    def table(name: str, ddl: str) -> DataFrame:
        kind = StructType.fromDDL(ddl)
        df = rows.where(F.col("fact") == name).select(F.from_json("row", ddl).alias("r"), (F.col("place") * (1 << 31) + F.col("at") % (1 << 31)).alias("_ord"))
        return df.select(*[F.coalesce("r.ord", "_ord").alias("ord") if c == "ord" else F.col(f"r.{c}") for c in kind.names]).to(kind)

    return Facts(spark, {n: table(n, ddl) for n, ddl in TABLES.items()}, rules or Project(Path(folder), "other"))
