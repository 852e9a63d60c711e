"""Jaccard join of documents' sets of word n-grams: a size-aware heavy-light join.

Texts with equal sets are one class; only classes are joined. Two sets that are similar enough share most of their elements,
so under one order of all elements, rarer first, they share one of the first e + 1 of each, and two of the first e + 2 (e: how
many elements a set may hold that the other lacks).

* Small sets enumerate all two-element subsets of their first e + 2 elements and meet on equal subsets.
* Large sets are found in inverted lists of first e + 1 elements, which also hold the small sets that come near them in size.

The size where small ends is where the total cost of subsets and lists, summed over the corpus's histogram of sizes, is least.
What meets is filtered by size, by the two positions (elements before the first common one are not shared) and by parity bits,
then verified on the whole sets. Where many meet on one key, as copies with small changes do, they aren't paired: their bits are sent
to where they are compared block by block, and what leaves is a spanning forest. Elements are ordered by a count sketch of fixed size over all texts, so that passages common to many
documents come last and are looked up only by sets made of nothing else. Entries are packed as in ``substring``: a row is one
batch's entries for one bucket. Links are joined to components by stars; documents aren't collected anywhere.

Words are cut and lower-cased (A-Z) as the contract says; fewer words than n make one element. Null and empty texts, or texts
without words, have no elements and are linked with nothing. Repeated rows are in one class. A component is named by its least
id; null ids link like others, and only a component without any id has none. Texts of any length are read whole, one at a time at
least; a set's elements are in one task. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossfile.llm.components import components, forest
from crossfile.llm.frames import cut
from crossfile.llm.text import Words, buffers, frugal, inside, mix, slices, thrifty, windows

SKETCH = 1 << 18
#: Parity bits of a set: the next power of two above its size, between these.
PARITY = 2048, 1 << 16
#: Cost of an inverted list's entry, which is scanned against the list, in subset entries, which rarely meet.
LIST_COST = 4.0
#: Bits a name, and the least and most bits, as powers of two, of the filter by which texts that are no candidates aren't sent. It grows with
#: the names, to 64 MB; of those it lets pass a join by name decides.
FILTER_BITS, FILTER = 16, (20, 29)
#: Names a task remembers, so that copies of one set post once.
POSTED = 1 << 17
#: Elements to a bucket.
BUCKET = 1 << 18
BLOCK = 2048
#: Sets of a component that one task holds; two such blocks meet in a task.
GROUP = 512
#: Sets that meet on more than so many are compared as a crowd, by bits.
CROWD = 32
#: Parity bits of a crowd that one task holds; two such blocks meet in a task.
CROWD_GROUP = 1024
_U = np.uint64


def sets(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct elements, first of each row), by row and value."""
    h, count = w.hashes(), np.diff(w.first)
    at = np.flatnonzero(inside(w.first, n))
    key, row = windows(h, n)[at], w.row[at]
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        sums = np.concatenate([[_U(0)], np.cumsum(mix(h + (np.arange(len(h)) - w.first[w.row]).astype(_U)), dtype=_U)])
        key = np.concatenate([key, mix(sums[w.first[short + 1]] - sums[w.first[short]] + count[short].astype(_U))])
        row = np.concatenate([row, short])
    order = np.lexsort((key, row))
    key, row = key[order], row[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    return key[new], np.searchsorted(row[new], np.arange(len(count) + 1))


def names(key: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 128-bit name of each row's set, as 16-byte strings."""
    out = np.zeros((len(first) - 1, 2), dtype=_U)
    full = np.flatnonzero(np.diff(first) > 0)
    if len(full):
        for lane, salt in enumerate((0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179)):
            out[full, lane] = np.add.reduceat(mix(key ^ _U(salt)), first[full])
    return np.ascontiguousarray(out).view("V16").ravel()


def allowed(n: np.ndarray, percent: int) -> np.ndarray:
    """How many elements of a set of n a similar set may lack."""
    return n - -(-n * percent // 100)


class Ranks:
    """The order of elements: level of their cell in the sketch, then hash."""

    def __init__(self, cells: np.ndarray):
        mean = max(cells.mean(), 1.0)
        self.level = np.floor(np.log2(np.maximum(cells / mean, 1.0))).astype(np.uint8)

    def prefixes(self, key: np.ndarray, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(element, row, position) of each row's first ``length`` elements, in order."""
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        mixed = mix(key)
        order = np.lexsort((mixed, self.level[(mixed >> _U(46)).astype(np.int64)], row))
        position = np.arange(len(key)) - np.repeat(first[:-1], np.diff(first))
        take = position < length[row]
        return key[order][take], row[take], position[take]


def boundary(histogram: list[tuple[int, int]], percent: int) -> int:
    """The size from which sets are large."""
    if not histogram:
        return 0
    n, count = (np.array(x, dtype=float) for x in zip(*sorted(histogram), strict=True))
    e = allowed(n.astype(np.int64), percent).astype(float)
    subsets, lists = count * (e + 2) * (e + 1) / 2, count * (e + 1) * LIST_COST
    options = np.append(n, n[-1] * 100 // percent + 2)
    cost = [subsets[n < x].sum() + lists[n * 100 >= x * percent].sum() for x in options]
    return int(options[int(np.argmin(cost))])


def _read(batches: Iterator[pa.RecordBatch], n: int):
    for b in batches:
        data, offsets = buffers(b.column(1))
        for lo, hi in slices(offsets):
            yield b, lo, hi, sets(Words(data, offsets, lo, hi, lower=True), n)


def parities(key: np.ndarray, first: np.ndarray) -> list[bytes]:
    """Parity bits for each row: whether an odd number of its elements falls on each. Two rows' bits differ in no more places than
    their sets in elements. Bits fold: half as many are the two halves' exclusive or."""
    size, at = np.diff(first), mix(key)
    length = np.clip(1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64), *PARITY)
    out: list[bytes] = [b""] * len(size)
    for n in np.unique(length).tolist():
        rows = np.flatnonzero(length == n)
        for lo in range(0, len(rows), stripe := max(1, (1 << 22) // n)):
            some = rows[lo : lo + stripe]
            inner = np.concatenate([at[first[r] : first[r + 1]] for r in some])
            cell = np.repeat(np.arange(len(some)) * n, size[some]) + (inner & _U(n - 1)).astype(np.int64)
            odd = np.packbits((np.bincount(cell, minlength=len(some) * n) & 1).astype(np.uint8).reshape(len(some), n), axis=1)
            for r, x in zip(some.tolist(), odd, strict=True):
                out[r] = x.tobytes()
    return out


class Bits:
    """Parity bits of many sets, by their length."""

    def __init__(self, held: list[bytes]):
        self.length = np.array([len(x) // 8 for x in held], dtype=np.int64)
        self.row = np.zeros(len(held), dtype=np.int64)
        self.folded: dict[tuple[int, int], np.ndarray] = {}
        for n in np.unique(self.length).tolist():
            there = np.flatnonzero(self.length == n)
            self.row[there] = np.arange(len(there))
            self.folded[n, n] = np.frombuffer(b"".join(held[i] for i in there.tolist()), _U).reshape(-1, n)

    def _of(self, n: int, to: int) -> np.ndarray:
        """The bits of all sets of length n, folded."""
        if (n, to) not in self.folded:
            wide = self._of(n, 2 * to)
            self.folded[n, to] = wide[:, :to] ^ wide[:, to:]
        return self.folded[n, to]

    def differ(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many bits of each set x and of its y differ."""
        out, of = np.zeros(len(y), dtype=np.int64), self.length[x] * (1 << 32) + self.length[y]
        for pair in np.unique(of).tolist():
            there, (n, m) = np.flatnonzero(of == pair), divmod(pair, 1 << 32)
            to = min(n, m)
            for lo in range(0, len(there), BLOCK):
                some = there[lo : lo + BLOCK]
                out[some] = np.bitwise_count(self._of(n, to)[self.row[x[some]]] ^ self._of(m, to)[self.row[y[some]]]).sum(axis=1, dtype=np.int64)
        return out

    def alike(self, x: int, y: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
        """Which of the sets y may be similar to x, from the sizes n of all."""
        near, out = np.flatnonzero(alike(np.abs(n[y] - n[x]), n[x] + n[y], percent)), np.zeros(len(y), dtype=bool)
        out[near] = alike(self.differ(np.full(len(near), x), y[near]), n[x] + n[y[near]], percent)
        return out


def alike(differ: np.ndarray, total: np.ndarray, percent: int) -> np.ndarray:
    """|A - B| + |B - A| = d of total makes a similarity of (total - d) / (total + d). The sizes' difference is a d as well, and the
    only one that tells sets apart that are so much larger than the bits folded for them that these are full."""
    return 100 * (total - differ) >= percent * (total + differ)


def describe(docs: DataFrame, n: int) -> DataFrame:
    """d, n_shingles, name and parity bits of every row; and, with a cell instead, the sketch's counts by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, dtype=np.int64)
        kind = None
        for b, lo, hi, (key, first) in _read(batches, n):
            kind = b.schema[0].type
            total += np.bincount((mix(key) >> _U(46)).astype(np.int64), minlength=SKETCH)
            columns = [b.column(0).slice(lo, hi - lo), pa.array(np.diff(first)), pa.array([x.tobytes() for x in names(key, first)], pa.binary()), pa.array(parities(key, first), pa.binary()), pa.nulls(hi - lo, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["d", "n_shingles", "name", "bits", "cell"])
        at = np.flatnonzero(total)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.nulls(len(at), kind), pa.array(total[at]), pa.nulls(len(at), pa.binary()), pa.nulls(len(at), pa.binary()), pa.array(at.astype(np.int32))], ["d", "n_shingles", "name", "bits", "cell"])

    return docs.mapInArrow(frugal(run), f"d {docs.schema['d'].dataType.simpleString()}, n_shingles long, name binary, bits binary, cell int")


def sketch(about: DataFrame) -> np.ndarray:
    """Counts of all elements by cell. SKETCH numbers, whatever the corpus."""
    rows = about.where("cell is not null").groupBy("cell").agg(F.sum("n_shingles").alias("n")).toArrow()
    cells = np.zeros(SKETCH)
    cells[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    return cells


ENTRY = np.dtype([("key", "<u8"), ("name", "V16"), ("n", "<i4"), ("at", "<i4"), ("list", "?")])


def entries(key: np.ndarray, first: np.ndarray, ranks: Ranks, large: int, percent: int) -> np.ndarray:
    """What the sets post: subsets of small ones, list entries of large ones and of those near them in size."""
    size = np.diff(first)
    e, name = allowed(size, percent), names(key, first)
    # Sets of which nothing may be missing on either side are equal to all that are similar: classes hold them already.
    alone = (size == 0) | (e + (size * 100 // percent - size) == 0)
    in_list, in_subsets = (size * 100 >= large * percent) & ~alone, (size < large) & ~alone
    x, row, at = ranks.prefixes(key, first, np.where(in_subsets, e + 2, np.where(in_list, e + 1, 0)))
    out = []
    mine = in_list[row] & (at <= e[row])
    posted = np.empty(int(mine.sum()), dtype=ENTRY)
    posted["key"], posted["name"], posted["n"], posted["at"], posted["list"] = x[mine], name[row[mine]], size[row[mine]], at[mine], True
    out.append(posted)
    small_rows = in_subsets[row]
    x, row, at = x[small_rows], row[small_rows], at[small_rows]
    for gap in range(1, int(at.max(initial=0)) + 1):
        pair = np.flatnonzero(row[gap:] == row[:-gap])
        if not len(pair):
            break
        posted = np.empty(len(pair), dtype=ENTRY)
        a, b = x[pair], x[pair + gap]
        posted["key"], posted["name"], posted["n"], posted["at"], posted["list"] = mix(a * _U(0x2545F4914F6CDD1D) + (b << _U(1)) + _U(1)), name[row[pair]], size[row[pair]], at[pair], False
        out.append(posted)
    return np.concatenate(out)


def _meet(group: np.ndarray, large: int, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate pairs of one key's entries, block by block."""
    group = group[np.argsort(group["n"], kind="stable")]
    n, at = group["n"].astype(np.int64), group["at"].astype(np.int64)
    for i in range(0, len(group), BLOCK):
        reach = np.searchsorted(n, n[min(i + BLOCK, len(group)) - 1] * 100 // percent, "right")
        for j in range(i, reach, BLOCK):
            a, b = np.arange(i, min(i + BLOCK, len(group)))[:, None], np.arange(j, min(j + BLOCK, reach))[None, :]
            most = np.minimum(n[a] - at[a], n[b] - at[b])
            ok = (a < b) & (100 * most >= percent * (n[a] + n[b] - most))
            if group["list"][0]:
                ok &= (n[a] >= large) | (n[b] >= large)
            x, y = np.nonzero(ok)
            if len(x):
                yield group["name"][x + i], group["name"][y + j]


class Crowds:
    """The crowds of one bucket. A key's crowd joins another that holds half of it, as long as that doesn't grow beyond twice its
    first size, for copies meet on many keys."""

    def __init__(self):
        self.of: dict[bytes, int] = {}
        self.members: list[set[bytes]] = []
        self.key: list[int] = []
        self.most: list[int] = []

    def add(self, key: int, names: list[bytes]) -> None:
        near: dict[int, int] = {}
        for x in names:
            if (c := self.of.get(x)) is not None:
                near[c] = near.get(c, 0) + 1
        c = max(near, key=near.get, default=None)
        if c is None or 2 * near[c] < len(names) or len(self.members[c].union(names)) > self.most[c]:
            c = len(self.key)
            self.members.append(set())
            self.key.append(key)
            self.most.append(2 * len(names))
        self.members[c].update(names)
        self.of.update(dict.fromkeys(names, c))


def _crowded(members: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """(a, b): a spanning forest of what may be similar in each crowd (a, crowd)."""
    sizes = members.groupBy("crowd").agg(F.ceil(F.count(F.lit(1)) / CROWD_GROUP).cast("int").alias("blocks"))
    placed = members.join(sizes, "crowd").withColumn("block", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int"))
    rows = placed.join(bits.withColumnRenamed("name", "a"), "a").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("crowd", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "a", "bits", "n")

    def check(group: pa.Table) -> pa.Table:
        name, n, at = group.column("a").to_pylist(), group.column("n").to_numpy(), group.column("block").to_numpy()
        held = Bits(group.column("bits").to_pylist())
        apart = group.column("i")[0].as_py() != group.column("j")[0].as_py()
        # Each turn takes in all that one set reaches; sets left over meet the next.
        left, edges = np.arange(len(name)), []
        while len(left):
            todo, left = [int(left[0])], left[1:]
            while todo and len(left):
                x = todo.pop()
                hit = held.alike(x, left, n, percent)
                if apart:
                    hit &= at[left] != at[x]
                edges += [(name[x], name[y]) for y in left[hit].tolist()]
                todo += left[hit].tolist()
                left = left[~hit]
        return pa.table({"a": pa.array([e[0] for e in edges], pa.binary()), "b": pa.array([e[1] for e in edges], pa.binary())})

    return rows.groupBy("crowd", "i", "j").applyInArrow(thrifty(check), "a binary, b binary")


def link(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(links as ``_verified`` gives them, d, n_shingles, name of every row). docs: columns d, t."""
    spark = docs.sparkSession
    about = cut(describe(docs, n))
    ranks = Ranks(sketch(about))
    about = about.where("cell is null").drop("cell")
    histogram = [(r.n_shingles, r["count"]) for r in about.where("n_shingles > 0").groupBy("n_shingles").count().collect()]
    large = boundary(histogram, percent)
    total = sum(a * b for a, b in histogram)
    buckets = max(13, int(total * (100 - percent) / 100 * 1.5) // BUCKET * 2 + 1)
    shared = spark.sparkContext.broadcast(ranks)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = shared.value

        def packed(parts: list[np.ndarray]) -> pa.RecordBatch:
            found = np.concatenate(parts)
            bucket = ((found["key"] >> _U(20)) % _U(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            found, edges = found[order], np.searchsorted(bucket[order], np.arange(buckets + 1))
            there = np.flatnonzero(np.diff(edges))
            return pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array([found[edges[i] : edges[i + 1]].tobytes() for i in there], pa.binary())], ["bucket", "e"])

        held: list[np.ndarray] = []
        posted: set[bytes] = set()
        for _, _, _, (key, first) in _read(batches, n):
            new = []
            for i, x in enumerate(names(key, first)):
                if (name := x.tobytes()) not in posted and first[i + 1] > first[i]:
                    posted.add(name)
                    new.append(i)
            if len(posted) > POSTED:
                posted = set()
            if len(new) < len(first) - 1:
                size = np.diff(first)[new]
                key = key[np.repeat(first[new] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))] if new else key[:0]
                first = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
            held.append(entries(key, first, r, large, percent))
            if sum(map(len, held)) > 400_000:
                yield packed(held)
                held = []
        if held:
            yield packed(held)

    def meet(table: pa.Table) -> pa.Table:
        found = np.frombuffer(b"".join(x.as_py() for x in table.column("e")), dtype=ENTRY)
        order = np.argsort(found["key"], kind="stable")
        key = found["key"][order]
        new = np.ones(len(key), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(key)))
        a, b, crowds = [], [], Crowds()
        for s, k in zip(start[size > 1].tolist(), size[size > 1].tolist(), strict=True):
            group = found[order[s : s + k]]
            name = np.ascontiguousarray(group["name"]).view(_U).reshape(-1, 2)
            if (name == name[0]).all():
                continue  # copies of one set
            by = np.lexsort((name[:, 1], name[:, 0]))
            once = np.ones(k, dtype=bool)
            once[1:] = (name[by[1:]] != name[by[:-1]]).any(axis=1)
            group = group[by[once]]
            if len(group) > CROWD:
                crowds.add(int(group["key"][0].astype(np.int64)), [x.tobytes() for x in group["name"]])
            elif len(group) > 1:
                for x, y in _meet(group, large, percent):
                    a.append(x)
                    b.append(y)
        crowded = [(x, key) for key, names in zip(crowds.key, crowds.members, strict=True) for x in names]
        many = pa.table({"a": pa.array([x for x, _ in crowded], pa.binary()), "b": pa.nulls(len(crowded), pa.binary()), "crowd": pa.array([x for _, x in crowded], pa.int64())})
        if not a:
            return many
        pairs = np.stack([np.concatenate(a).view(_U).reshape(-1, 2), np.concatenate(b).view(_U).reshape(-1, 2)], axis=1)
        swap = (pairs[:, 0, 0] > pairs[:, 1, 0]) | ((pairs[:, 0, 0] == pairs[:, 1, 0]) & (pairs[:, 0, 1] > pairs[:, 1, 1]))
        pairs[swap] = pairs[swap][:, ::-1]
        flat = np.unique(np.ascontiguousarray(pairs).reshape(-1, 4), axis=0)
        few = {c: pa.array([x.tobytes() for x in np.ascontiguousarray(flat[:, i : i + 2])], pa.binary()) for c, i in (("a", 0), ("b", 2))}
        return pa.concat_tables([pa.table(few | {"crowd": pa.nulls(len(flat), pa.int64())}), many])

    came = cut(docs.mapInArrow(frugal(post), "bucket int, e binary").groupBy("bucket").applyInArrow(thrifty(meet), "a binary, b binary, crowd long"))
    pairs = came.where("crowd is null").select("a", "b")
    # What differs in more bits than it may in elements isn't similar: bits are far smaller than sets.
    bits = about.where("n_shingles > 0").groupBy("name").agg(F.first("bits").alias("bits"), F.first("n_shingles").alias("n"))
    met = pairs.distinct().join(bits.select(F.col("name").alias("a"), F.col("bits").alias("bits_a"), F.col("n").alias("n_a")), "a").join(bits.select(F.col("name").alias("b"), F.col("bits").alias("bits_b"), F.col("n").alias("n_b")), "b")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = np.arange(b.num_rows)
            differ = Bits(b.column("bits_a").to_pylist() + b.column("bits_b").to_pylist()).differ(k, k + b.num_rows)
            n, m = b.column("n_a").to_numpy(), b.column("n_b").to_numpy()
            yield b.select(["a", "b"]).filter(pa.array(alike(np.maximum(differ, np.abs(n - m)), n + m, percent)))

    few = met.select("a", "b", "bits_a", "bits_b", "n_a", "n_b").mapInArrow(frugal(near), "a binary, b binary")
    pairs = cut(few.union(_crowded(came.where("crowd is not null").select("a", "crowd"), bits, percent)))
    wanted = pairs.select(F.col("a").alias("name")).union(pairs.select("b")).distinct()

    held = spark.sparkContext.broadcast(_filter(wanted))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = held.value
        for _, _, _, (key, first) in _read(batches, n):
            own = names(key, first)
            rows = np.flatnonzero(_passes(words, own.view(_U).reshape(-1, 2)) & (np.diff(first) > 0)).tolist()
            yield pa.RecordBatch.from_arrays([pa.array([own[i].tobytes() for i in rows], pa.binary()), pa.array([key[first[i] : first[i + 1]].tobytes() for i in rows], pa.binary())], ["name", "s"])

    # Copies are one before they are sent; the join moves names only.
    held = docs.mapInArrow(frugal(whole), "name binary, s binary").groupBy("name").agg(F.first("s").alias("s")).join(wanted, "name", "left_semi")
    return _verified(held, components(pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))), percent), about


def _lanes(b: pa.RecordBatch) -> np.ndarray:
    """Two numbers a row: of a name of 128 bits, or of two columns."""
    if b.num_columns == 2:
        return np.stack([b.column(i).to_numpy() for i in range(2)], axis=1).view(_U)
    return np.frombuffer(b"".join(b.column(0).to_pylist()), _U).reshape(-1, 2)


def _places(lanes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Two bits of the filter for each name."""
    return (lanes >> _U(64 - 5 - len(words).bit_length())).astype(np.int64)


def _filter(wanted: DataFrame) -> np.ndarray:
    """Words of 64 bits in which the places of all names are set, as many as the names ask for."""
    wanted = cut(wanted)
    size = 1 << min(max((FILTER_BITS * wanted.count()).bit_length(), FILTER[0]), FILTER[1]) - 6

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(size, dtype=_U)
        for b in batches:
            at = _places(_lanes(b), words).ravel()
            np.bitwise_or.at(words, at >> 6, _U(1) << (at & 63).astype(_U))
        there = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(words[there].view(np.int64))], ["word", "bits"])

    rows = wanted.mapInArrow(run, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(size, dtype=_U)
    words[rows.column(0).to_numpy()] = rows.column(1).to_numpy().view(_U)
    return words


def _passes(words: np.ndarray, lanes: np.ndarray) -> np.ndarray:
    at = _places(lanes, words)
    return (words[at >> 6] >> (at & 63).astype(_U) & _U(1)).all(axis=1)


def _verified(held: DataFrame, of: DataFrame, percent: int) -> DataFrame:
    """(a, b, n) from sets (name, s) and the candidate component of each (u, component): n links of a where b is null, else an
    edge of a spanning forest of the links.

    A set is sent once, not once per pair: components share tasks, and one of more than GROUP sets is dealt to blocks, of which
    every two meet in a task of their own.
    """
    of = cut(of)
    tasks = of.count() // (2 * GROUP) + 61
    sizes = of.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("blocks"))
    placed = of.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("u"), F.col("blocks")).cast("int"))
    rows = held.join(placed, F.col("name") == F.col("u")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select(
        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("component"), F.lit(tasks)).cast("long")).otherwise(F.xxhash64("component")).alias("task"),
        F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "component", "block", "name", "s",
    )

    def check(group: pa.Table) -> pa.Table:
        counted: dict[bytes, int] = {}
        edges: list[tuple[bytes, bytes]] = []
        part, i, j = group.column("component").to_pylist(), group.column("i")[0].as_py(), group.column("j")[0].as_py()
        name, block = group.column("name").to_pylist(), np.array(group.column("block").to_pylist())
        members: dict[bytes, list[int]] = {}
        for k, c in enumerate(part):
            members.setdefault(c, []).append(k)
        for places in members.values():
            own = [np.frombuffer(group.column("s")[k].as_buffer(), _U) for k in places]
            first = np.concatenate([[0], np.cumsum([len(x) for x in own])])
            bits, n, at = Bits(parities(np.concatenate(own), first)), np.diff(first), block[places]
            for x in range(len(places)):
                y = np.arange(x + 1, len(places))
                y = y[(at[y] != at[x]) if i != j else np.ones(len(y), bool)]
                if len(y):
                    for k in y[bits.alike(x, y, n, percent)].tolist():
                        common = len(np.intersect1d(own[x], own[k], assume_unique=True))
                        if 100 * common >= percent * (n[x] + n[k] - common):
                            edges.append((name[places[x]], name[places[k]]))
        for e in edges:
            for v in e:
                counted[v] = counted.get(v, 0) + 1
        kept = forest(edges)
        return pa.table({"a": pa.array([*counted, *(e[0] for e in kept)], pa.binary()), "b": pa.array([*([None] * len(counted)), *(e[1] for e in kept)], pa.binary()), "n": pa.array([*counted.values(), *([0] * len(kept))], pa.int64())})

    return rows.groupBy("task", "i", "j").applyInArrow(thrifty(check), "a binary, b binary, n long")


def join(docs: DataFrame, n: int = 3, percent: int = 90, key: str = "doc_id", text: str = "text") -> DataFrame:
    """n_shingles, component_id, n_links (linked classes, by their sets) and class_size of every row."""
    docs = docs.select(F.col(key).alias("d"), F.col(text).alias("t"))
    links, about = link(docs, n, percent)
    classes = about.where("n_shingles > 0").groupBy("name").agg(F.min("d").alias("rep"), F.count(F.lit(1)).alias("class_size"))
    found = cut(links)
    degree = found.where("b is null").groupBy(F.col("a").alias("name")).agg(F.sum("n").alias("n_links"))
    shared = classes.where("rep is not null").groupBy("rep").agg(F.min("name").alias("v"), F.count(F.lit(1)).alias("k")).where("k > 1").select("rep", "v")
    shared = classes.join(shared, "rep").select(F.col("name").alias("u"), "v")  # sets of one least id are one
    edges = found.where("b is not null").select(F.col("a").alias("u"), F.col("b").alias("v")).union(shared)
    of = components(edges).withColumnRenamed("u", "name")  # by sets, as ids may be null
    classes = cut(classes.join(of, "name", "left").withColumn("component", F.coalesce("component", "name")))
    least = classes.groupBy("component").agg(F.min("rep").alias("component_id"))
    classes = classes.join(least, "component").join(degree, "name", "left").select("name", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "class_size")
    out = about.join(classes.withColumnRenamed("name", "_name"), (about.name == F.col("_name")) & (about.n_shingles > 0), "left")
    return out.select(F.col("d").alias(key), "n_shingles", F.coalesce("component_id", "d").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"))


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, one of each component: that of the least id, null ids last, and of equal ids the least by a hash of all
    columns. Rows equal in all columns are one. A row whose text has no words stays, as it is linked with nothing.

    A row is known by its id and 128 bits of hashes of all its columns, not by its id alone, which others may share.
    """
    plain = [F.to_json(c) if t.startswith("map") else F.col(c) for c, t in ((f"`{c}`", t) for c, t in docs.dtypes)]
    row = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), F.xxhash64(*plain).alias("h"), F.xxhash64(F.lit(7), *plain).alias("g"))
    found = cut(join(docs.select(row.alias("r"), F.col(text).alias("t")), n, percent, "r", "t").where("n_shingles > 0").select("r", "component_id"))
    gone = cut(found.where("r <> component_id").select("r").distinct())
    twice = cut(found.groupBy("r").count().where("count > 1").select("r"))
    mark = next(f"row{i}" for i in range(len(docs.columns) + 1) if f"row{i}" not in docs.columns)
    marked = docs.withColumn(mark, row)
    # Most rows are neither: those that a filter tells so stay where they are, and only the others' columns are sent.
    doubted = _doubted(gone.union(twice))(F.col(mark)["h"], F.col(mark)["g"])
    gone, twice = gone.withColumnRenamed("r", mark), twice.withColumnRenamed("r", mark)
    rest = marked.where(doubted).join(gone, mark, "left_anti").select(marked.columns)
    if not twice.isEmpty():
        rest = rest.join(twice, mark, "left_anti").select(marked.columns).union(rest.join(twice, mark, "left_semi").dropDuplicates([mark]).select(marked.columns))
    return marked.where(~doubted).union(rest).select(docs.columns)


def _doubted(rows: DataFrame):
    """A function of h and g: whether a row may be among ``rows`` (r, with h and g). It says so of all that are, and of few others."""
    held = rows.sparkSession.sparkContext.broadcast(_filter(rows.select("r.h", "r.g")))

    def run(h: pa.Array, g: pa.Array) -> pa.Array:
        return pa.array(_passes(held.value, np.stack([h.to_numpy(), g.to_numpy()], axis=1).view(_U)))

    return F.arrow_udf(run, "boolean")
