"""Fact tables and the views over them that several checks share."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from crossfile.functions.scalars import is_dunder, last_name
from crossfile.operators.lineage import cut, drop
from crossfile.rules import Project
from crossfile.schemas import TABLES
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Tables that several checks read.
READ_OFTEN = ("modules", "imports", "symbols", "uses", "call_edges", "calls", "functions", "classes", "names", "name_counts", "entrypoints")


@dataclass
class Facts:
    """Named DataFrames (see ``schemas.TABLES``) of one package."""

    spark: SparkSession
    tables: dict[str, DataFrame]
    rules: Project = Project()

    @classmethod
    def of(cls, spark: SparkSession, rows: dict[str, list | DataFrame], rules: Project = Project()) -> Facts:
        return cls(spark, {n: r if isinstance(r := rows.get(n, []), DataFrame) else spark.createDataFrame(r, ddl) for n, ddl in TABLES.items()}, rules)

    @classmethod
    def read(cls, spark: SparkSession, folder: str, rules: Project = Project()) -> Facts:
        return cls(spark, {n: spark.read.schema(ddl).parquet(f"{folder}/{n}") for n, ddl in TABLES.items()}, rules)

    def write(self, folder: str) -> None:
        for name, df in self.tables.items():
            df.write.mode("overwrite").parquet(f"{folder}/{name}")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in TABLES:
            raise AttributeError(name)
        return self.tables[name]

    def shared(self) -> Facts:
        """The same facts, with the tables and views that many plans read kept once they are computed."""
        out = Facts(self.spark, {n: df.persist() for n, df in self.tables.items()}, self.rules)
        for view in ("users", "ours", "placed", "own_functions", "package_calls", "overriding", "checkable"):
            out.__dict__[view] = getattr(out, view).persist()
        return out

    def written(self) -> Facts:
        """The same facts, with the tables and views that several checks read written to the shared folder once: where each check's plan makes
        them again, the driver holds the plans, threads and code of all of that many times."""
        out = Facts(self.spark, {n: cut(self.tables[n]) if n in READ_OFTEN else self.tables[n] for n in TABLES}, self.rules)
        for view in ("users", "ours", "placed", "own_functions", "checkable"):
            out.__dict__[view] = cut(getattr(out, view))
        return out

    def named(self, values, column: str = "name") -> DataFrame:
        """values: a set of names, or a table (name) of many."""
        if isinstance(values, DataFrame):
            return values.select(F.col("name").alias(column))
        return self.spark.createDataFrame([(v,) for v in sorted(values)], f"{column} string")

    def names_of(self, *kinds: str) -> DataFrame:
        return self.names.where(F.col("kind").isin(*kinds)).select("name").distinct()

    @cached_property
    def ours(self) -> DataFrame:
        """Call edges whose callee is one of the package's functions or methods."""
        callable_ = self.symbols.where("kind in ('function', 'method')").select(F.col("sid").alias("callee"))
        return self.call_edges.join(callable_, "callee", "left_semi")

    @cached_property
    def users(self) -> DataFrame:
        """sid, scope: who uses or calls a symbol."""
        return self.uses.select("sid", "scope").union(self.call_edges.select(F.col("callee").alias("sid"), F.col("caller").alias("scope"))).distinct()

    @cached_property
    def placed(self) -> DataFrame:
        """Symbols with the file of their module and their last name."""
        return self.symbols.join(self.modules.select("module", "file"), "module").withColumn("last", last_name(F.col("sid")))

    @cached_property
    def own_functions(self) -> DataFrame:
        """Functions and methods with their facts."""
        facts = self.functions.drop("name", "ord")
        return self.placed.where("kind in ('function', 'method')").join(facts, "sid")

    @cached_property
    def package_calls(self) -> DataFrame:
        return self.calls.where("not in_tests")

    @cached_property
    def overriding(self) -> DataFrame:
        """Methods that may answer to someone else's call: of a library-based owner, or defined on a base as well.

        Bases are followed by bare name, level by level, as long as new ones turn up.
        """
        classes = self.classes.join(self.symbols.select("sid", F.col("name").alias("class")), "sid")
        methods = self.symbols.where("kind = 'method'").select("sid", "owner", last_name(F.col("sid")).alias("method"))
        library = methods.join(classes.where("library_base").select(F.col("sid").alias("owner")), "owner", "left_semi").select("sid")
        up = classes.select(F.col("sid").alias("owner"), F.explode("bases").alias("base")).distinct()
        named = classes.select(F.col("class").alias("base"), F.col("sid").alias("base_sid"), F.col("bases").alias("more"))
        reach = cut(up)
        front = reach
        while not front.isEmpty():
            new = cut(front.join(named, "base").select("owner", F.explode("more").alias("base")).distinct().join(reach, ["owner", "base"], "left_anti"))
            wider = cut(reach.union(new))
            drop(front, reach)
            front, reach = new, wider
        # A base of the class's own name may be the class itself: then each of its methods answers to it.
        above = reach.join(named, "base").join(methods.select(F.col("owner").alias("base_sid"), "method").distinct(), "base_sid").select("owner", "method").distinct()
        return library.union(methods.join(above, ["owner", "method"], "left_semi").select("sid")).distinct()

    @cached_property
    def checkable(self) -> DataFrame:
        """Functions whose calls are all known by name: the name is unique, not a door's, not handed on, and not a library's."""
        f = self.own_functions
        unique = f.groupBy("last").count().where("count = 1").select("last")
        foreign = self.classes.where("library_base").select(F.col("sid").alias("owner"))
        return (
            f.where(~is_dunder(F.col("last")) & ~F.col("decorated"))
            .join(unique, "last", "left_semi")
            .join(self.entrypoints, "sid", "left_anti")
            .join(self.names_of("handed", "handed_in_tests").withColumnRenamed("name", "last"), "last", "left_anti")
            .join(foreign, "owner", "left_anti")
        )

    @cached_property
    def behaving(self) -> DataFrame:
        """class: names that mean exactly one own class, not library-based and with a method of its own."""
        classes = self.symbols.where("kind = 'class'").select("sid", F.col("name").alias("class"))
        one = classes.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("class"))).where("n = 1")
        acts = self.symbols.where("kind = 'method'").where(~is_dunder(last_name(F.col("sid")))).select(F.col("owner").alias("sid")).distinct()
        return one.join(self.classes.where("not library_base").select("sid"), "sid", "left_semi").join(acts, "sid", "left_semi").select("class", F.col("sid").alias("class_sid"))
