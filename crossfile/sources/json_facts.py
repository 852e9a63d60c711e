"""Facts that another reader (of TypeScript, say) has written as JSON lines: {"fact": table, "row": {...}}."""

from __future__ import annotations

from crossfile.facts import Facts
from crossfile.rules import Project
from crossfile.schemas import TABLES
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str, rules: Project = Project(language="typescript")) -> Facts:
    lines = spark.read.text(path).select(F.get_json_object("value", "$.fact").alias("fact"), F.get_json_object("value", "$.row").alias("row"))

    def table(name: str, ddl: str) -> DataFrame:
        return lines.where(F.col("fact") == name).select(F.from_json("row", ddl).alias("r")).select("r.*")

    return Facts(spark, {n: table(n, ddl) for n, ddl in TABLES.items()}, rules)


def write(facts: Facts, path: str) -> None:
    parts = [df.select(F.to_json(F.struct(F.lit(n).alias("fact"), F.struct(*df.columns).alias("row"))).alias("value")) for n, df in facts.tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    out.write.mode("overwrite").text(path)
