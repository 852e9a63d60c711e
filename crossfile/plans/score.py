"""The score: six axes from 0 to 100 over kept findings, and their mean."""

from __future__ import annotations

from crossfile.facts import Facts
from crossfile.functions.scalars import half_even, rate
from crossfile.plans.extension import registered
from crossfile.schemas import SCORE
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_HOPS, HOPELESS_HOPS = 3, 12
LONG_FUNCTION, LONG_MODULE = 50, 500
#: axis -> (label, weight of each check's findings). Fixed values.
WEIGHTS = {
    "alive": ("Alive", {"dead": 1, "tests_only": 0}),
    "lean": ("Lean", {"forward": 2, "tunnel": 1, "duplicate": 2, "ignored_return": 1, "unused_param": 1, "unused_default": 1}),
    "private": ("Private", {"private_abroad": 2, "home_only_public": 1}),
    "shaped": ("Shaped", {"bool_flag": 2, "twin_shapes": 1, "unread_field": 1, "clump": 2, "feature_envy": 1, "single_implementation": 2}),
    "focused": ("Focused", {"hub": 2, "cycle": 3, "shotgun": 1, "scattered_api": 1, "unstable_dependency": 1}),
}


def direct(hops: DataFrame) -> DataFrame:
    """One row, value: doors of at most MOST_HOPS count 1, falling to 0 at HOPELESS_HOPS; 100 without doors."""
    each = F.when(F.col("hops") <= MOST_HOPS, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - (F.col("hops") - MOST_HOPS) / (HOPELESS_HOPS - MOST_HOPS)))
    return hops.agg(F.coalesce(half_even(100 * F.avg(each)), F.lit(100)).alias("direct"), F.count(F.lit(1)).alias("doors"), F.count_if(F.col("hops") > MOST_HOPS).alias("over"), F.max("hops").alias("deepest"))


def score(f: Facts, kept: DataFrame, hops: DataFrame) -> DataFrame:
    """Rows of SCORE: six axes and the overall mean. ``hops``: door, hops of the doors known before library mode."""
    weights = {k: v | {c.name: c.weight for c in registered().values() if c.axis == k} for k, (_, v) in WEIGHTS.items()}
    w = {k: F.sum(F.coalesce(F.create_map(*[F.lit(x) for p in v.items() for x in p])[F.col("check")], F.lit(0))) for k, v in weights.items()}
    n = kept.agg(*[F.coalesce(x, F.lit(0)).alias(k) for k, x in w.items()], F.count_if(F.col("check") == "tests_only").alias("tests_only"))
    callable_ = F.col("kind").isin("function", "method")
    of = f.symbols.agg(
        F.count_if(callable_).alias("functions"), F.count_if(F.col("kind") == "class").alias("classes"), F.count_if(F.col("kind") != "method").alias("others"),
        F.count_if(~F.col("private")).alias("public"), F.count_if(callable_ & (F.col("lines") > LONG_FUNCTION)).alias("long_functions"),
    )
    mods = f.modules.agg(F.count(F.lit(1)).alias("modules"), F.count_if(F.col("lines") > LONG_MODULE).alias("long_modules"))
    row = n.crossJoin(of).crossJoin(mods).crossJoin(direct(hops))  # one row each
    part = lambda a, b, zero: F.greatest(F.lit(0.0), 1 - F.when(b > 0, a / b).otherwise(0.0) / zero)
    c = F.col
    values: dict[str, Column] = {
        "direct": c("direct"),
        "alive": rate(c("alive") + F.expr("tests_only div 2"), c("others") + F.expr("functions div 2"), 0.15),
        "lean": rate(c("lean"), c("functions"), 0.2),
        "private": rate(c("private"), c("public"), 0.3),
        "shaped": rate(c("shaped"), F.greatest(F.lit(1), c("classes") + F.expr("functions div 10")), 0.5),
        "focused": half_even(100 * (part(c("long_functions"), c("functions"), 0.1) + part(c("long_modules"), c("modules"), 0.4) + part(c("focused"), c("modules"), 0.3)) / 3),
    }
    axes = [F.struct(F.lit(k).alias("key"), F.lit("Direct" if k == "direct" else WEIGHTS[k][0]).alias("label"), v.alias("value"), F.array(*[F.lit(x) for x in weights.get(k, ())]).cast("array<string>").alias("checks")) for k, v in values.items()]
    row = row.select(F.array(*axes).alias("a"), "*")
    overall = F.struct(F.lit("overall").alias("key"), F.lit("Overall").alias("label"), half_even(F.aggregate("a", F.lit(0.0), lambda s, x: s + x["value"]) / 6).alias("value"), F.expr("cast(array() as array<string>)").alias("checks"))
    words = {
        "direct": F.when(c("doors") == 0, F.lit("no doors to measure")).otherwise(F.format_string(f"%d of %d doors over {MOST_HOPS} hops, the deepest %d", "over", "doors", "deepest")),
        "alive": F.format_string("%d dead of %d symbols, those of tests alone counted half", c("alive") + F.expr("tests_only div 2"), c("others") + F.expr("functions div 2")),
        "lean": F.format_string("%d needless things in %d functions", "lean", "functions"),
        "private": F.format_string("%d of %d public names in the wrong place", "private", "public"),
        "shaped": F.format_string("%d records and functions of the wrong shape", "shaped"),
        "focused": F.format_string(f"%d functions over {LONG_FUNCTION} lines, %d modules over {LONG_MODULE}, %d tangles", "long_functions", "long_modules", "focused"),
    }
    detail = F.create_map(*[x for k, v in words.items() for x in (F.lit(k), v)])
    out = row.select(F.explode(F.concat(F.array(overall), c("a"))).alias("x"), detail.alias("d"))
    return out.select("x.key", "x.label", "x.value", F.coalesce(F.try_element_at("d", c("x.key")), F.lit("")).alias("detail"), "x.checks").to(f.spark.createDataFrame([], SCORE).schema)
