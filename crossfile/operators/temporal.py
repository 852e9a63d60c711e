"""Joins by time and by place: the last row before a moment, and the spans around a point, without comparing all with all.

A key may hold any share of the rows: its time line is cut into blocks that lie in tasks of their own, and what a block needs of those
before it is one row.
"""

from __future__ import annotations

from crossfile.operators.lineage import cut, dealt
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows to a block of time, if they were even.
ROWS = 1 << 18
#: Levels of cells, by powers of two; spans are shorter than the last.
LEVELS = 62


def as_of(left: DataFrame, right: DataFrame, by: list[str], at: str, since: str, rows: int = ROWS) -> DataFrame:
    """Every row of ``left`` with the columns of the last row of ``right`` of the same key whose ``since`` is at most ``at``; null where
    there is none, and where a key or a time is null. Of rows of one time the greatest counts. Times are timestamps or numbers; ``right``
    has no other column of ``left``'s but the keys."""
    number = lambda df, c: F.unix_micros(F.col(c).cast("timestamp")) if dict(df.dtypes)[c].startswith("timestamp") else F.col(c)
    others = [c for c in right.columns if c not in by]
    known = right.where(" and ".join(f"`{c}` is not null" for c in (*by, since))).select(*by, number(right, since).alias("_t"), F.struct(*[F.col(since)], *[F.col(c) for c in others if c != since]).alias("_r"))
    asked = left.select(*by, number(left, at).alias("_t"), F.struct(*left.columns).alias("_l"))
    both = cut(known.withColumn("_l", F.lit(None).cast(asked.schema["_l"].dataType)).unionByName(asked.withColumn("_r", F.lit(None).cast(known.schema["_r"].dataType))))
    n, low, high = both.agg(F.count(F.lit(1)), F.min("_t"), F.max("_t")).first()
    width = max((high - low) / max(n / rows, 1), 1) if n and low is not None else 1
    both = both.withColumn("_b", F.floor((F.col("_t") - F.lit(low if low is not None else 0)) / F.lit(float(width))))
    # Within a block: at one time what is known comes first, the greatest last of it.
    order = Window.partitionBy(*by, "_b").orderBy("_t", F.col("_l").isNotNull(), "_r").rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn("_r", F.last("_r", True).over(order)).where("_l is not null")
    last = both.where("_r is not null").groupBy(*by, "_b").agg(F.max(F.struct("_t", "_r")).alias("_m"))
    # Before a block: the last of all blocks before, one row each.
    blocks = both.select(*by, "_b").distinct().join(last, [*by, "_b"], "left")
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.withColumn("_c", F.last("_m", True).over(before)).where("_c is not null").select(*by, "_b", F.col("_c._r").alias("_c"))
    out = inside.join(carried, [*by, "_b"], "left").withColumn("_r", F.when(F.col("_t").isNotNull(), F.coalesce("_r", "_c")))
    return out.select("_l.*", *[F.col(f"_r.{c}").alias(c) for c in (since, *[c for c in others if c != since])])


def _level(start: Column, end: Column) -> Column:
    """The least level whose cells are as long as a span: it touches two of them at most."""
    return F.greatest(F.ceil(F.log2((end - start + 1).cast("double"))), F.lit(0)).cast("int")


def around(points: DataFrame, spans: DataFrame, by: list[str], at: str, start: str, end: str) -> DataFrame:
    """All pairs of a point and a span of its key with start <= at <= end, whole numbers all; columns of both, the keys once.

    Spans are dealt to cells about as long as they are, points looked up in one cell of every such length that occurs.
    """
    held = spans.where(F.col(start) <= F.col(end)).withColumn("_level", _level(F.col(start), F.col(end)))
    cell = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("_level"))).cast("long")
    held = held.withColumn("_cell", F.explode(F.array_distinct(F.array(cell(start), cell(end)))))
    levels = held.select("_level").distinct()  # LEVELS rows at most
    asked = points.crossJoin(F.broadcast(levels)).withColumn("_cell", cell(at))
    return asked.join(held, [*by, "_level", "_cell"]).where((F.col(start) <= F.col(at)) & (F.col(at) <= F.col(end))).drop("_level", "_cell")


def innermost(points: DataFrame, spans: DataFrame, by: list[str], at: str, start: str, end: str) -> DataFrame:
    """Every point with the shortest span around it (of equal ones that which starts first, then the least row); null without one."""
    mark = F.struct(*points.columns).alias("_p")
    kept = [c for c in spans.columns if c not in by]
    best = F.min(F.struct((F.col(end) - F.col(start)).alias("_n"), F.col(start), *[F.col(c).alias(f"_{c}") for c in kept])).alias("_s")
    met = around(points.distinct(), spans, by, at, start, end).select(mark, start, end, *[c for c in kept if c not in (start, end)]).groupBy("_p").agg(best)
    return points.withColumn("_p", F.struct(*points.columns)).join(met, "_p", "left").select(*points.columns, *[F.col(f"_s._{c}").alias(c) for c in kept])


def trailing(rows: DataFrame, by: list[str], at: str, days: int, n: int | None = None, /, **sums: Column) -> DataFrame:
    """The rows with sums over those of their key in the ``days`` up to and with their own moment (``at``, a timestamp).

    A key's time line is cut into blocks as long as the frame; each block is given the one before it to look back on. n: how many rows
    there are, if they may be many.
    """
    micros = days * 86_400_000_000
    block = F.floor(F.unix_micros(F.col(at).cast("timestamp")) / F.lit(float(micros)))
    held = rows.withColumn("_b", block)
    both = held.withColumn("_own", F.lit(True)).union(held.withColumn("_b", F.col("_b") + 1).withColumn("_own", F.lit(False)))
    both = dealt(both, 2 * n, *by, "_b") if n else both
    frame = Window.partitionBy(*by, "_b").orderBy(F.unix_micros(F.col(at).cast("timestamp"))).rangeBetween(-micros, 0)
    for name, value in sums.items():
        both = both.withColumn(name, F.sum(value).over(frame))
    return both.where("_own").drop("_own", "_b")


def last_rows(rows: DataFrame, by: list[str], order: list[str], n: int, **sums: Column) -> DataFrame:
    """The rows with sums over the last ``n`` of their key in an order, their own included."""
    frame = Window.partitionBy(*by).orderBy(*order).rowsBetween(1 - n, 0)
    for name, value in sums.items():
        rows = rows.withColumn(name, F.sum(value).over(frame))
    return rows
