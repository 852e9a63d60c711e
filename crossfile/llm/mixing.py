"""Temperature mixing of sources, in DataFrame functions only.

Shares p of the sources' tokens are raised to an exponent a and normalised: q = p^a / sum p^a. Bisection finds the largest
a in [0, 1] whose entropy reaches ``evenness`` * ln(number of sources); if some source would then be repeated more than
``repetition`` times, a rises to the least exponent that keeps the limit (with a = 1 every source is repeated alike).
A source's quota is floor(budget * q). It is realised epoch by epoch: every epoch deals the source's blocks in an order of
their own, and a block's documents likewise; the last epoch stops before the quota would be exceeded.

A block is a set of documents with equal leading bits of a hash of the id. Only block sums are sorted, and of the one block
in which a quota ends the documents; every other document only compares its place with its source's last place. So texts
are never shuffled and no source is gathered in a task, however large. The shares of many sources (``ONE_ROW``) aren't gathered either:
what bisection asks for are sums over them. Beyond ``SOURCES_BROADCAST`` sources documents are shuffled once to meet theirs.

Null sources count as the source "". A document has its words plus one end token, so null and empty texts have one token.
Texts of any length are counted whole
and stay where they are. Blocks and documents of equal hashes are ordered by block, id and tokens; rows with the same id, tokens and source have one
place: they are taken together. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crossfile.llm.frames import cut, small

WORD = r"[^\x20\x09-\x0D]+"
#: Source tables up to this size are broadcast; larger ones are joined by shuffle.
SOURCES_BROADCAST = 20_000
#: Shares of up to so many sources are one row, in which the exponent is bisected; of more the sums are taken over the table of sources.
ONE_ROW = 4096
#: Exponents tried at once there, and how often the span between two of them is divided.
TRIED, DIVISIONS = 33, 8


def tokens(text: str = "text") -> Column:
    return (F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)) + 1).cast("long")


def _prefix(*parts: Column) -> Column:
    return F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 12)


def _id(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _block(key: str, bits: int) -> Column:
    return F.shiftright(F.conv(_prefix(_id(key)), 16, 10).cast("long"), 48 - bits)


def exponent(shares: Column, evenness: float, repetition: float, scale: float | None) -> Column:
    """The exponent for an array of shares. ``scale``: budget / all tokens; None for the least that deals every source whole."""

    def powered(a: Column) -> Column:
        return F.aggregate(shares, F.lit(0.0), lambda s, p: s + F.pow(p, a))

    def even(a: Column) -> Column:
        total = powered(a)
        h = F.aggregate(shares, F.lit(0.0), lambda s, p: s - F.pow(p, a) / total * F.log(F.pow(p, a) / total))
        return h >= evenness * F.log(F.size(shares).cast("double")) - 1e-9

    def spared(a: Column) -> Column:
        if scale is None:  # the largest source is dealt once, and of the others the smallest is repeated most
            return F.pow(F.array_max(shares) / F.array_min(shares), 1 - a) <= repetition + 1e-12
        return scale * F.pow(F.array_min(shares), a) / powered(a) <= repetition * F.array_min(shares) + 1e-12

    def bisect(left_holds, lo: float, hi: float) -> Column:
        step = lambda s, _: F.when(left_holds((s.lo + s.hi) / 2), F.struct(((s.lo + s.hi) / 2).alias("lo"), s.hi.alias("hi"))).otherwise(F.struct(s.lo.alias("lo"), ((s.lo + s.hi) / 2).alias("hi")))
        end = F.aggregate(F.sequence(F.lit(1), F.lit(50)), F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi")), step)
        return F.round((end.lo + end.hi) / 2, 9)

    warm = F.when(even(F.lit(1.0)), F.lit(1.0)).otherwise(bisect(even, 0.0, 1.0))
    bound = F.when(spared(F.lit(0.0)), F.lit(0.0)).otherwise(bisect(lambda a: ~spared(a), 0.0, 1.0))
    return F.greatest(warm, bound)


def wide_exponent(sums: DataFrame, total: int, evenness: float, repetition: float, budget: float | None) -> float:
    """The exponent of ``exponent`` for sources (total) of any number: each round sums over all of them for several exponents at once, and
    goes on between the two where what is asked for begins or ends to hold."""
    p = F.col("total") / F.lit(float(total))
    k, least, most = sums.agg(F.count(F.lit(1)), F.min(p), F.max(p)).first()

    def holds(tried: list[float], asked: str) -> list[bool]:
        parts = [x for a in tried for x in (F.sum(F.pow(p, F.lit(a))), F.sum(F.pow(p, F.lit(a)) * F.log(p)))]
        row = sums.agg(*parts).first()
        found = []
        for i, a in enumerate(tried):
            z, t = row[2 * i], row[2 * i + 1]
            if asked == "even":
                found.append(math.log(z) - a * t / z >= evenness * math.log(k) - 1e-9)
            elif budget is None:
                found.append((most / least) ** (1 - a) <= repetition + 1e-12)
            else:
                found.append(budget * least**a / z <= repetition * least + 1e-12)
        return found

    def edge(asked: str, before: bool) -> float:
        """Where in [0, 1] it turns, if it holds ``before`` and not after, or the other way round."""
        lo, hi = 0.0, 1.0
        for _ in range(DIVISIONS):
            tried = [lo + (hi - lo) * i / (TRIED - 1) for i in range(TRIED)]
            turned = next((i for i, h in enumerate(holds(tried, asked)) if h != before), TRIED - 1)
            lo, hi = tried[max(turned - 1, 0)], tried[turned]
        return round((lo + hi) / 2, 9)

    warm = 1.0 if holds([1.0], "even")[0] else edge("even", True)
    bound = 0.0 if holds([0.0], "spared")[0] else edge("spared", False)
    return max(warm, bound)


def _weighted(sums: DataFrame, evenness: float, repetition: float, budget: float | None) -> DataFrame:
    """sums (source, total) with all (tokens), exponent, weight and scale."""
    if small(sums, ONE_ROW):
        # One row: an entry for each source, in order, so that sums of doubles come out alike every time.
        mix = sums.agg(F.array_sort(F.collect_list(F.struct("source", "total"))).alias("s")).select("s", F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x.total).alias("all"))
        mix = mix.withColumn("p", F.transform("s", lambda x: x.total / F.col("all")))
        mix = mix.withColumn("exponent", exponent(F.col("p"), evenness, repetition, budget))
        mix = mix.withColumn("w", F.transform("p", lambda p: F.pow(p, F.col("exponent")))).withColumn("wsum", F.aggregate("w", F.lit(0.0), lambda a, x: a + x))
        scale = F.array_max(F.zip_with("p", "w", lambda p, w: p / (w / F.col("wsum")))) if budget is None else F.lit(float(budget))
        each = mix.withColumn("scale", scale).select("all", "exponent", "scale", "wsum", F.explode(F.arrays_zip("s", "w")).alias("x"))
        return each.select(F.col("x.s.source").alias("source"), F.col("x.s.total").alias("total"), "exponent", (F.col("x.w") / F.col("wsum")).alias("weight"), "all", "scale")
    total = sums.agg(F.sum("total")).first()[0]
    a = wide_exponent(sums, total, evenness, repetition, budget)
    p = F.col("total") / F.lit(float(total))
    z, most = sums.agg(F.sum(F.pow(p, F.lit(a))), F.max(F.pow(p, F.lit(1 - a)))).first()
    return sums.select("source", "total", F.lit(a).alias("exponent"), (F.pow(p, F.lit(a)) / F.lit(z)).alias("weight"), F.lit(total).cast("long").alias("all"), F.lit(float(budget) if budget is not None else most * z).alias("scale"))


def plan(docs: DataFrame, evenness: float, repetition: float, budget: float | None, key: str = "doc_id") -> tuple[DataFrame, int]:
    """(one row per source: tokens, exponent, weight, quota, whole epochs and the last place of the partial one; block bits).

    ``budget``: tokens to emit as a multiple of all tokens; None for the least at which every source is dealt whole once.
    """
    bits = max(2, (docs.count().bit_length() + 1) // 2)  # about as many blocks as rows in a block
    source = F.coalesce("source", F.lit("")).alias("source")
    blocks = cut(docs.select(source, _block(key, bits).alias("block"), tokens().alias("n")).groupBy("source", "block").agg(F.sum("n").alias("n")))
    sums = cut(blocks.groupBy("source").agg(F.sum("n").alias("total")))
    each = (
        _weighted(sums, evenness, repetition, budget)
        .withColumn("quota", F.floor(F.col("scale") * F.col("all") * F.col("weight") + 1e-6).cast("long"))
        .withColumn("quota", F.least("quota", F.floor(repetition * F.col("total")).cast("long")) if budget is None else F.col("quota"))  # the exponent is rounded
        .withColumn("epochs", F.expr("quota div total").cast("int"))
        .withColumn("rest", F.col("quota") - F.col("epochs") * F.col("total"))
    )
    each = cut(each.select("source", "total", "exponent", "weight", "quota", "epochs", "rest"))
    order = Window.partitionBy("source").orderBy("block_key", "block")
    dealt = (
        blocks.join(each.select("source", "epochs", "rest"), "source")
        .withColumn("block_key", _prefix(F.col("epochs"), F.col("source"), F.col("block")))
        .withColumn("before", F.sum("n").over(order) - F.col("n"))
        .where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("n")))
        .select("source", "block", "block_key", "epochs", (F.col("rest") - F.col("before")).alias("left"))
    )
    last = docs.select(source, _block(key, bits).alias("block"), F.col(key).alias("_k"), "text")
    last = last.join(_by_source(dealt), ["source", "block"]).select("source", "block_key", "left", _prefix(F.col("epochs"), F.col("source"), _id("_k")).alias("doc_key"), _id("_k").alias("name"), tokens().alias("n"))
    last = last.groupBy("source", "block_key", "left", "doc_key", "name", "n").agg(F.sum("n").alias("sum"))
    place = F.struct("doc_key", "name", "n")
    last = last.withColumn("sum", F.sum("sum").over(Window.partitionBy("source").orderBy(place))).where("sum <= left").groupBy("source").agg(F.max(place).alias("doc"))
    ends = dealt.join(last, "source", "left").select("source", F.struct("block_key", "block").alias("_end_block"), F.col("doc").alias("_end_doc"))
    return each.join(ends, "source", "left"), bits


def _by_source(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if small(df, SOURCES_BROADCAST) else df


#: What ``mix`` adds to a table, and what it needs on the way.
ADDED, INNER = ("n_tokens", "exponent", "weight", "epoch", "order"), ("source", "block", "epochs", "end_block", "end_doc", "copies")


def added(columns: list[str]) -> str:
    """The prefix of the columns that ``mix`` adds: an underscore, or as many as keep them apart from the table's own."""
    prefix = "_"
    while any(f"{prefix}{n}" in columns for n in ADDED + INNER):
        prefix += "_"
    return prefix


def mix(docs: DataFrame, evenness: float = 0.95, repetition: float = 4.0, budget: float | None = 1.0, key: str = "doc_id") -> DataFrame:
    """Every copy dealt: the columns of ``docs``, then _n_tokens, _exponent, _weight, _epoch and _order, by which an epoch of
    a source is read. Where the table has such a column already, all of these start with one underscore more (see ``added``)."""
    sources, bits = plan(docs, evenness, repetition, budget, key)
    _ = added(docs.columns)
    c = {n: F.col(f"`{_}{n}`") for n in ADDED + INNER}
    table = _by_source(cut(sources).select(F.col("source").alias(f"{_}source"), F.col("exponent").alias(f"{_}exponent"), F.col("weight").alias(f"{_}weight"), F.col("epochs").alias(f"{_}epochs"), F.col("_end_block").alias(f"{_}end_block"), F.col("_end_doc").alias(f"{_}end_doc")))
    out = docs.withColumn(f"{_}source", F.coalesce("source", F.lit(""))).withColumn(f"{_}n_tokens", tokens()).withColumn(f"{_}block", _block(key, bits)).join(table, f"{_}source")
    block_key, doc_key = _prefix(c["epochs"], c["source"], c["block"]), _prefix(c["epochs"], c["source"], _id(key))
    at = F.struct(block_key.alias("block_key"), c["block"].alias("block"))
    here = F.struct(doc_key.alias("doc_key"), _id(key).alias("name"), c["n_tokens"].alias("n"))
    more = (at < c["end_block"]) | ((at == c["end_block"]) & F.coalesce(here <= c["end_doc"], F.lit(False)))
    out = out.withColumn(f"{_}copies", c["epochs"] + F.when(F.coalesce(more, F.lit(False)), 1).otherwise(0)).where(c["copies"] > 0)
    out = out.withColumn(f"{_}epoch", F.explode(F.sequence(F.lit(0), c["copies"] - 1)))
    order = F.concat(_prefix(c["epoch"], c["source"], c["block"]), _prefix(c["epoch"], c["source"], _id(key)))
    return out.select(*[F.col(f"`{x}`") for x in docs.columns], c["n_tokens"], c["exponent"], c["weight"], c["epoch"], order.alias(f"{_}order"))
