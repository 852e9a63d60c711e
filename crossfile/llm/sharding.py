"""Hierarchical weighted hash tree: documents descend region, rack and shard levels by weighted hash draws.

At each level a document draws -ln(u) / weight for every child, u in (0, 1) from md5 of its key and the child's name, and
takes the least draw. A child's draw depends on its own name and weight alone, so a change of weight moves documents only
into or out of the subtrees whose weights changed. ``grow`` adds a shard as a region of its own: no other weight changes,
so it takes rows only into itself.

Rows with a null key draw as the empty key. Repeated rows go to the same shard and get slots of their own. Null and empty
texts have size 1; long ones are measured whole, and never move. Of equal draws the first name wins; slots of equal
keys follow size and crc32. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Slots are numbered block by block; a block holds about so many rows.
BLOCK_ROWS = 16384


@dataclass(frozen=True)
class Shard:
    id: int
    region: str
    rack: str
    weight: float = 1.0


def tree(n: int, racks: int = 2, per_rack: int = 2) -> tuple[Shard, ...]:
    """n shards of weight 1, ``per_rack`` to a rack and ``racks`` racks to a region."""
    return tuple(Shard(i, f"r{i // (racks * per_rack)}", f"k{i // per_rack % racks}") for i in range(n))


def grow(shards: tuple[Shard, ...]) -> tuple[Shard, ...]:
    """One more shard, in a region of its own."""
    n = max((s.id for s in shards), default=-1) + 1
    return (*shards, Shard(n, f"r+{n}", "k0"))


def _draw(key: Column, name: Column, weight: Column) -> Column:
    u = (F.conv(F.substring(F.md5(F.concat(key, F.lit("|"), name)), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    return -F.log(u) / weight


def _choose(key: Column, children: Column) -> Column:
    """The name of the child, of an array of (name, weight), with the least draw; ties go to the first name."""
    draws = F.transform(children, lambda c: F.struct(_draw(key, c["n"], c["w"]).alias("d"), c["n"].alias("n")))
    return F.array_min(draws)["n"]


def place(key: Column, shards: tuple[Shard, ...]) -> Column:
    """The shard id of a key (string column): three descents, each among one node's children."""
    sums: dict[str, dict[str, float]] = {}
    for s in shards:
        if s.weight > 0:
            for above, name in (("", s.region), (s.region, f"{s.region}/{s.rack}"), (f"{s.region}/{s.rack}", f"{s.region}/{s.rack}/{s.id}")):
                node = sums.setdefault(above, {})
                node[name] = node.get(name, 0.0) + s.weight
    pairs = [x for above, node in sorted(sums.items()) for x in (F.lit(above), F.array(*[F.struct(F.lit(n).alias("n"), F.lit(w).alias("w")) for n, w in sorted(node.items())]))]
    children = F.create_map(*pairs)
    at = F.lit("")
    for _ in ("region", "rack", "shard"):
        at = _choose(key, F.element_at(children, at))
    return F.element_at(F.split(at, "/"), -1).cast("int")


def assign(docs: DataFrame, shards: tuple[Shard, ...], key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: its key, size, crc32, shard, gapless slot in the shard, and shard after one more.

    Slots follow (hash of the key, key, size, crc32). Numbering needs no shard in one task: blocks are leading bits of that
    hash, counted apart, and their offsets are summed over the few blocks.
    """
    bits = max(2, (max(1, docs.count() // (BLOCK_ROWS * max(1, len(shards))))).bit_length())
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    placed = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).withColumns({"k": F.col("k"), "name": F.coalesce(F.col("k").cast("string"), F.lit(""))})
    h = F.conv(F.substring(F.md5(F.col("name")), 1, 12), 16, 10).cast("long")
    rows = placed.select(
        F.col("k").alias(key),
        (F.coalesce(F.octet_length("t"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("t", F.lit("")).cast("binary")).alias("text_crc32"),
        place(F.col("name"), shards).alias("shard"),
        place(F.col("name"), grow(shards)).alias("grown_shard"),
        h.alias("_h"),
    ).withColumn("_block", F.shiftright("_h", 48 - bits))
    keys = docs.select(name.alias("name")).select(place(F.col("name"), shards).alias("shard"), F.shiftright(h, 48 - bits).alias("_block"))
    counts = keys.groupBy("shard", "_block").count()
    before = counts.select("shard", "_block", (F.sum("count").over(Window.partitionBy("shard").orderBy("_block")) - F.col("count")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("shard", "_block").orderBy("_h", key, "size", "text_crc32")) - 1
    return (
        rows.withColumn("_within", within)
        .join(before, ["shard", "_block"])
        .select(key, "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_before") + F.col("_within")).cast("long").alias("slot"), "grown_shard")
    )
