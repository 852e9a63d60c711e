"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossfile.llm.frames import cut, remove

EDGES = 1 << 16


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Every neighbour above (large) or up to (small) a vertex is tied to the least vertex around it."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    tied = both.join(least, "u")
    if large:
        return tied.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    own = least.where("m < u").select("u", F.col("m").alias("v"))
    return tied.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(own).distinct()


def forest(pairs: list[tuple]) -> list[tuple]:
    """Those of the pairs that join what earlier ones haven't joined."""
    above: dict = {}

    def root(v):
        while above.get(v, v) != v:
            above[v] = above.get(above[v], above[v])
            v = above[v]
        return v

    kept = []
    for a, b in pairs:
        x, y = root(a), root(b)
        if x != y:
            above[max(x, y)] = min(x, y)
            kept.append((a, b))
    return kept


def thinned(edges: DataFrame) -> DataFrame:
    """The same components from fewer edges: of each ``EDGES`` a spanning forest, so that dense groups shrink first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = [p for b in batches for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        kept = forest(pairs)
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in kept], f.type) for i, f in enumerate(schema)], ["u", "v"])

    from pyspark.sql.pandas.types import to_arrow_schema

    edges = cut(edges.select("u", "v"))
    schema = to_arrow_schema(edges.schema)
    return edges.repartition(edges.count() // EDGES + 1).mapInArrow(run, edges.schema)


def components(edges: DataFrame) -> DataFrame:
    """(u, component): the least vertex each vertex of ``edges`` (u, v of one orderable type) is connected to.

    Rounds are few: paths halve. Each is written to the shared folder; nothing is collected but a count and a checksum.
    """
    now = cut(thinned(edges.where("u <> v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long"))).first())
        if mark == seen:
            break
        seen = mark
        after = cut(_stars(_stars(now, True), False))
        remove(now)
        now = after
    least = now.select("u", F.col("v").alias("component"))
    return least.union(now.select(F.col("v").alias("u"), F.col("v").alias("component"))).distinct()
