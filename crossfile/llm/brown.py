"""Brown class bigrams: P(token | previous) = P(class | what stands before) * P(token | class).

Every word of the training documents has one of ``CLASSES`` classes by the contexts it stands in:

* Words of at least 1 / 2**``CLUSTER_BITS`` of the training tokens (so at most that many) are exchanged: sweep by sweep, each moves to
  the class where the classes' mutual information is greatest; all counts follow every move.
* All others go to the class under which their own neighbours are likeliest, given those classes: words of at least 1 / 2**``HEAD_BITS``
  of the tokens by what stands on both sides, rarer ones by what stands before them. Their counts are made in one pass each,
  aggregated by word, and never gathered.

The end of a text, which is also what a text starts after, is a class of its own. What stands before is a class too, but for a word
below 1 / 2**``HEAD_BITS`` one of ``SURFACE`` by its last byte: only the classes of words above are looked up where the texts are, so what
is broadcast has a size fixed by the parameters, and the rarer ones are joined with their classes and counts by shuffle. Given
what stands before, probabilities sum to one over all words, with room in each class for one unseen. Every count is over all
training documents.

Rows are scored one by one, repeated ones alike, and whole, in slices of a few MB; a longer text is a slice of its own. Of classes
equally good a word stays in its own or goes to the first. Null and empty texts are one end token. Null ids hash as the empty
string. Extra columns are ignored. With no training rows every word is unseen and the classes are uniform. An empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossfile.llm.frames import cut, remove, text_key
from crossfile.llm.text import Words, buffers, frugal, slices

CLASSES, SURFACE, SWEEPS = 48, 16, 4
CLUSTER_BITS, HEAD_BITS = 12, 20
END = np.uint64(0x0E0D)
#: What can stand before a token: a class, a surface, the end. What a token can be: of a class, or the end.
BEFORE, BECOMES = CLASSES + SURFACE + 1, CLASSES + 1
#: Weight of the class's own share in a transition, room for an unseen word in a class, and average neighbours added to a word's own.
BACKOFF, ADDED, PRIOR = 20.0, 0.5, 1.0
#: Counts a task holds before it sends them on, and words to a bucket.
HELD, BUCKET = 2_000_000, 1 << 16


def sequence(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, surface class of each, first token by row): each row's words, then END, whose surface class is SURFACE."""
    h = np.insert(w.hashes(), w.first[1:], END)
    last = w.bytes[w.end - 1] % SURFACE if len(w) else np.zeros(0, np.uint8)
    return h, np.insert(last.astype(np.int8), w.first[1:], SURFACE), w.first + np.arange(len(w.first))


def _batches(batches: Iterator[pa.RecordBatch], column: int):
    for b in batches:
        data, offsets = buffers(b.column(column))
        for lo, hi in slices(offsets, 4 << 20):
            yield b, lo, hi, sequence(Words(data, offsets, lo, hi, lower=True))


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    u, first, n = np.unique(keys, return_index=True, return_counts=True)
    return u, first, n


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """h, s, n: training count of each token; h and s are its hash and surface class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, (h, s, _) in _batches(batches, 0):
            u, at, n = _counted(h)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(s[at]), pa.array(n)], ["h", "s", "n"])

    return docs.select(text).mapInArrow(run, "h long, s byte, n long").groupBy("h", "s").agg(F.sum("n").alias("n"))


@dataclass
class Table:
    """Head words, sorted by hash, with their counts, their numbers among the exchanged words (-1 for others) and their classes."""

    hashes: np.ndarray
    counts: np.ndarray
    symbol: np.ndarray
    classes: np.ndarray

    def find(self, h: np.ndarray) -> np.ndarray:
        """Position in the table, or -1."""
        if not len(self.hashes):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, at, -1)

    @property
    def clustered(self) -> int:
        return int(self.symbol.max(initial=-1)) + 1

    def _own(self, of: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.where(at >= 0, of[at], -1) if len(of) else np.full(len(at), -1)

    def symbols(self, h: np.ndarray, s: np.ndarray) -> np.ndarray:
        """Exchanged words by number, then surfaces, then the end."""
        own = self._own(self.symbol, self.find(h))
        return np.where(own >= 0, own, self.clustered + s.astype(np.int64))

    def stands(self, at: np.ndarray, s: np.ndarray) -> np.ndarray:
        """The class of each token, or else its surface, or the end, as what stands before the next. at: its place in the table."""
        own = np.where(s == SURFACE, -1, self._own(self.classes, at))
        return np.where(own >= 0, own, CLASSES + s.astype(np.int64))


def before(values: np.ndarray, first: np.ndarray, start: int) -> np.ndarray:
    """What precedes each token; ``start`` before the first of a row."""
    out = np.empty_like(values)
    out[1:] = values[:-1]
    out[first[:-1]] = start
    return out


def count_pairs(docs: DataFrame, table: Table, text: str = "text") -> DataFrame:
    """p, c, n: counts of neighbouring symbols."""
    size = table.clustered + SURFACE + 1
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        for _, _, _, (h, s, first) in _batches(batches, 0):
            x = t.symbols(h, s).astype(np.int64)
            u, _, n = _counted(before(x, first, size - 1) * size + x)
            yield pa.RecordBatch.from_arrays([pa.array((u // size).astype(np.int32)), pa.array((u % size).astype(np.int32)), pa.array(n)], ["p", "c", "n"])

    return docs.select(text).mapInArrow(run, "p int, c int, n long").groupBy("p", "c").agg(F.sum("n").alias("n"))


def _f(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


class Exchange:
    """Classes of symbols, of which the first ``words`` may move among the first ``n_classes``, and their counts: ``right`` and ``left``, how
    often a symbol stands before and after each class, and ``matrix``, of pairs of classes. All follow each move."""

    def __init__(self, p: np.ndarray, c: np.ndarray, n: np.ndarray, of: np.ndarray, words: int, n_classes: int):
        self.of, self.words, self.n_classes, self.total = of.astype(np.int64), words, n_classes, int(of.max()) + 1
        self.p, self.c, self.n = p.astype(np.int64), c.astype(np.int64), n.astype(np.float64)
        self.own = np.bincount(self.p[same := self.p == self.c], self.n[same], len(of))
        self.after, self.ahead = (self._by(x, y) for x, y in ((self.p, self.c), (self.c, self.p)))
        self.right, self.left, self.matrix = self.counted()

    def _by(self, key: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(key, kind="stable")
        return np.searchsorted(key[order], np.arange(len(self.of) + 1)), other[order], self.n[order]

    def counted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The counts, from all pairs anew."""
        k, size = self.total, len(self.of)
        sums = lambda a, b, rows: np.bincount(a * k + b, self.n, rows * k).reshape(rows, k)
        p, c = self.of[self.p], self.of[self.c]
        return sums(self.p, c, size), sums(self.c, p, size), sums(p, c, k)

    def sweep(self) -> int:
        """Move each word, most frequent first, to where it fits best; the number of those that moved."""
        moved = 0
        for w in range(self.words):
            a, o, m = int(self.of[w]), self.own[w], self.matrix
            r, l = self.right[w].copy(), self.left[w].copy()
            r[a] -= o
            l[a] -= o
            m[a] -= r
            m[:, a] -= l
            m[a, a] -= o
            rows, cols, d = m.sum(axis=1), m.sum(axis=0), np.diag(m)
            gain = (_f(m + r) - _f(m)).sum(axis=1) + (_f(m + l[:, None]) - _f(m)).sum(axis=0)
            gain += _f(d + r + l + o) + _f(d) - _f(d + r) - _f(d + l)  # the pair (class, class) gets both, and the word's pairs with itself
            gain -= _f(rows + r.sum() + o) - _f(rows) + _f(cols + l.sum() + o) - _f(cols)
            b = int(np.argmax(gain[: self.n_classes]))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            m[b] += r
            m[:, b] += l
            m[b, b] += o
            if a != b:
                moved += 1
                self.of[w] = b
                for (first, other, n), side in ((self.ahead, self.right), (self.after, self.left)):
                    near = slice(first[w], first[w + 1])
                    side[other[near], a] -= n[near]
                    side[other[near], b] += n[near]
        return moved


def cluster(pairs: DataFrame, words: int, sweeps: int = SWEEPS, n_classes: int = CLASSES) -> Exchange:
    """Classes of the exchanged words 0..words-1, most frequent first, and of surfaces and the end, from counts (p, c, n) of at most
    2**CLUSTER_BITS words and those: a table whose size the parameters fix."""
    got = pairs.toArrow()
    of = np.concatenate([np.arange(words) % n_classes, np.arange(n_classes, n_classes + SURFACE + 1)])
    out = Exchange(*(got.column(i).to_numpy() for i in range(3)), of, words, n_classes)
    for _ in range(sweeps if words else 0):
        if not out.sweep():
            break
    return out


class Counts:
    """Counts of numbered things, merged in a task before they are sent on."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray) -> None:
        self._put(*np.unique(keys, return_counts=True))

    def _put(self, keys: np.ndarray, n: np.ndarray) -> None:
        self.parts.append((keys, n))
        self.size += len(keys)

    def full(self) -> bool:
        if self.size > HELD:
            keys, n = self.taken()
            self._put(keys, n)
        return self.size > HELD // 2

    def taken(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, n = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.size = [], 0
        keys, which = np.unique(keys, return_inverse=True)
        return keys, np.bincount(which, n, len(keys)).astype(np.int64)


def context_counts(docs: DataFrame, table: Table, text: str = "text") -> DataFrame:
    """at, x, n: how often the head word in place ``at`` that isn't exchanged stands after x (< BEFORE), or before x - BEFORE."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, held = shared.value, Counts()

        def sent() -> pa.RecordBatch:
            key, n = held.taken()
            return pa.RecordBatch.from_arrays([pa.array((key // (2 * BEFORE)).astype(np.int32)), pa.array((key % (2 * BEFORE)).astype(np.int16)), pa.array(n)], ["at", "x", "n"])

        for _, _, _, (h, s, first) in _batches(batches, 0):
            at = t.find(h)
            x = t.stands(at, s)
            last = before(x, first, BEFORE - 1)
            following = np.append(x[1:], BEFORE - 1)
            mine = np.flatnonzero((at >= 0) & (s != SURFACE) & (t._own(t.symbol, at) < 0))
            held.add(np.concatenate([at[mine] * 2 * BEFORE + last[mine], at[mine] * 2 * BEFORE + BEFORE + following[mine]]))
            if held.size > HELD and held.full():
                yield sent()
        yield sent()

    return docs.select(text).mapInArrow(frugal(run), "at int, x short, n long").groupBy("at", "x").agg(F.sum("n").alias("n"))


def likeliest(pairs: np.ndarray, both: bool) -> np.ndarray:
    """Weights of a word's neighbours for each class, from counts of (what stands before, class or what stands after): the class where
    their weighted sum is greatest makes the word's own bigrams likeliest."""
    into, col = pairs[:, :CLASSES], pairs[:, :CLASSES].sum(axis=0)
    share = (col + 1) / (col.sum() + CLASSES)
    ahead = np.log((into + BACKOFF * share) / (col + BACKOFF * share.mean()))
    if not both:
        return ahead
    out, row = pairs[:CLASSES], pairs[:CLASSES].sum(axis=1, keepdims=True)
    back = (pairs.sum(axis=0) + 1) / (pairs.sum() + pairs.shape[1])
    return np.concatenate([ahead, np.log((out + BACKOFF * back) / (row + BACKOFF)).T])


def middle(counts: DataFrame, matrix: np.ndarray, size: int) -> np.ndarray:
    """The class of each place of the table that ``context_counts`` counts, -1 elsewhere. At most 2**HEAD_BITS numbers."""
    weights, usual = likeliest(matrix, True), PRIOR * np.concatenate([matrix.sum(axis=1), matrix.sum(axis=0)]) / max(matrix.sum(), 1.0)

    def assign(group: pa.Table) -> pa.Table:
        at, which = np.unique(group.column("at").to_numpy(), return_inverse=True)
        own = np.bincount(which * 2 * BEFORE + group.column("x").to_numpy(), group.column("n").to_numpy(), len(at) * 2 * BEFORE).reshape(len(at), -1)
        return pa.table({"at": pa.array(at, pa.int32()), "k": pa.array(np.argmax((own + usual) @ weights, axis=1).astype(np.int8))})

    buckets = size // (BUCKET // 16) + 1
    got = counts.groupBy(F.pmod("at", F.lit(buckets))).applyInArrow(assign, "at int, k byte").toArrow()
    out = np.full(size, -1, dtype=np.int8)
    out[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return out


def transitions(docs: DataFrame, table: Table, text: str = "text") -> DataFrame:
    """h, x, n: after x (< BEFORE) stood the rare word h; with a null h, a token of x % BECOMES after x / BECOMES."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        total = np.zeros(BEFORE * BECOMES, dtype=np.int64)
        for _, _, _, (h, s, first) in _batches(batches, 0):
            at = t.find(h)
            x = t.stands(at, s)
            last = before(x, first, BEFORE - 1)
            rare = (at < 0) & (s != SURFACE)
            total += np.bincount(last[~rare] * BECOMES + np.minimum(x[~rare], CLASSES), minlength=len(total))
            order = np.lexsort((last[rare], h[rare]))
            key, x = h[rare][order], last[rare][order]
            new = np.ones(len(key), dtype=bool)
            new[1:] = (key[1:] != key[:-1]) | (x[1:] != x[:-1])
            start = np.flatnonzero(new)
            yield pa.RecordBatch.from_arrays([pa.array(key[start].view(np.int64)), pa.array(x[start].astype(np.int16)), pa.array(np.diff(np.append(start, len(key))))], ["h", "x", "n"])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.int64()), pa.array(at.astype(np.int16)), pa.array(total[at])], ["h", "x", "n"])

    return docs.select(text).mapInArrow(frugal(run), "h long, x short, n long").groupBy("h", "x").agg(F.sum("n").alias("n"))


def rare_words(counts: DataFrame, known: np.ndarray, words: int) -> DataFrame:
    """h, k, n of every rare word: its class and its training count; with a null h, k of x: n of them stood after x, as x * BECOMES + k."""
    weights, usual = likeliest(known, False), PRIOR * known.sum(axis=1) / max(known.sum(), 1.0)

    def assign(group: pa.Table) -> pa.Table:
        h, which = np.unique(group.column("h").to_numpy(), return_inverse=True)
        x, n = group.column("x").to_numpy().astype(np.int64), group.column("n").to_numpy()
        total, best = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        order = np.argsort(which, kind="stable")
        edges = np.searchsorted(which[order], np.arange(len(h) + 1))
        for lo in range(0, len(h), 8192):
            hi = min(lo + 8192, len(h))
            rows = order[edges[lo] : edges[hi]]
            own = np.bincount((which[rows] - lo) * BEFORE + x[rows], n[rows], (hi - lo) * BEFORE).reshape(hi - lo, BEFORE)
            best[lo:hi], total[lo:hi] = np.argmax((own + usual) @ weights, axis=1), own.sum(axis=1)
        into = np.bincount(x * BECOMES + best[which], n, BEFORE * BECOMES).astype(np.int64)
        at = np.flatnonzero(into)
        return pa.table({"h": pa.array([*h.tolist(), *([None] * len(at))], pa.int64()), "k": pa.array(np.concatenate([best, at]).astype(np.int16)), "n": pa.array(np.concatenate([total, into[at]]))})

    return counts.where("h is not null").groupBy(F.pmod(F.shiftright("h", 16), F.lit(words // BUCKET + 13))).applyInArrow(assign, "h long, k short, n long")


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", fold: int = 7, held: int = 2) -> DataFrame:
    """held_out, token counts, base_score, score and perplexity of every row; learnt from the rows not held out."""
    spark = docs.sparkSession
    docs = docs.select(key, text, (text_key(key) % fold == held).alias("held_out"))
    training = docs.where("not held_out")
    counts = cut(count_words(training))
    total, distinct = (x or 0 for x in counts.agg(F.sum("n"), F.count(F.lit(1))).first())
    head = counts.where(F.col("n") * (1 << HEAD_BITS) >= total).toArrow()  # at most 2**HEAD_BITS rows
    hashes, surface, n = head.column("h").to_numpy().view(np.uint64), head.column("s").to_numpy(), head.column("n").to_numpy()
    order = np.argsort(hashes, kind="stable")
    hashes, surface, n = hashes[order], surface[order], n[order]
    symbol = np.full(len(n), -1)
    often = np.flatnonzero((n * (1 << CLUSTER_BITS) >= total) & (surface != SURFACE))
    often = often[np.lexsort((hashes[often], -n[often]))]
    symbol[often] = np.arange(len(often))
    words = Table(hashes, n, symbol, np.full(len(n), -1))
    pairs = cut(count_pairs(training, words))
    found = cluster(pairs, words.clustered)
    remove(pairs)
    words.classes[often] = found.of[: len(often)]
    near = context_counts(training, words)
    classes = middle(near, found.matrix, len(n))
    classes[often] = found.of[: len(often)]
    words = Table(hashes, n, symbol, classes.astype(np.int64))

    steps = cut(transitions(training, words))
    square = lambda df, c: _square(df.where("h is null").groupBy(c).agg(F.sum("n").alias("n")).toArrow())
    known = square(steps, "x")
    rare = cut(rare_words(steps, known, distinct))
    into = known + square(rare, "k")
    remove(steps)
    remove(counts)

    # Probabilities. size: tokens of each class; an unseen word may be of any.
    size = into.sum(axis=0)
    share = (size + 1) / (size.sum() + BECOMES)
    follows = (into + BACKOFF * share) / (into.sum(axis=1, keepdims=True) + BACKOFF)
    room = size[:CLASSES] + ADDED
    move, unseen = np.log10(follows), np.log10((follows[:, :CLASSES] * (ADDED / room)).sum(axis=1))
    own = words.classes
    emit = np.where(own >= 0, n / room[np.maximum(own, 0)], 1.0) if len(n) else np.zeros(0)
    ends = int(n[surface == SURFACE].sum()) if len(n) else 0
    base = lambda c: np.log10((c + 1) / (total + distinct + 1))
    shared = spark.sparkContext.broadcast((words, np.log10(emit), base(n), move, float(base(ends)), ends > 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, head_emit, head_base, step, end_base, end_known = shared.value
        for b, lo, hi, (h, s, first) in _batches(batches, 1):
            at = t.find(h)
            end = s == SURFACE
            known = (at >= 0) & ~end
            x = t.stands(at, s)
            last = before(x, first, BEFORE - 1)
            low, gain = np.zeros(len(h)), np.zeros(len(h))
            spot = np.flatnonzero(known)
            low[spot], gain[spot] = head_base[at[spot]], step[last[spot], x[spot]] + head_emit[at[spot]]
            low[end], gain[end] = end_base, step[last[end], CLASSES]
            sums = [np.add.reduceat(v, first[:-1]) for v in (low, gain, (known | (end & end_known)).astype(np.int64))]
            rare = np.flatnonzero(~known & ~end)
            row = np.repeat(np.arange(hi - lo), np.diff(first))[rare]
            order = np.lexsort((last[rare], h[rare], row))
            rare, row = rare[order], row[order]
            fresh = np.ones(len(rare), dtype=bool)
            fresh[1:] = (row[1:] != row[:-1]) | (h[rare[1:]] != h[rare[:-1]]) | (last[rare[1:]] != last[rare[:-1]])
            start = np.flatnonzero(fresh)
            times = np.diff(np.append(start, len(rare)))
            edges = pa.array(np.searchsorted(row[start], np.arange(hi - lo + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(edges, pa.array(v)) for v in (h[rare[start]].view(np.int64), last[rare[start]].astype(np.int8), times.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo), pa.array(np.diff(first)), *map(pa.array, sums), *lists], ["k", "held_out", "n_tokens", "low", "gain", "known", "h", "x", "times"])

    scored = docs.mapInArrow(frugal(run), f"k {docs.schema[0].dataType.simpleString()}, held_out boolean, n_tokens long, low double, gain double, known long, h array<long>, x array<byte>, times array<int>")
    scored = cut(scored.withColumn("row", F.monotonically_increasing_id()))
    asked = scored.where(F.size("h") > 0).select("row", F.explode(F.arrays_zip("h", "x", "times")).alias("x")).select("row", "x.h", "x.x", "x.times")
    told = asked.join(rare.where("h is not null"), "h", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    numbers = lambda v: F.array(*[F.lit(float(y)) for y in v])
    moves = spark.createDataFrame([(x, [float(v) for v in row]) for x, row in enumerate(move.tolist())], "x byte, step array<double>")  # a row for each of BEFORE
    told = told.join(F.broadcast(moves), "x")
    point = F.when(F.col("n") > 0, F.element_at("step", F.col("k") + 1) + F.log10(F.col("n") / F.element_at(numbers(room), F.col("k") + 1))).otherwise(F.element_at(numbers(unseen), F.col("x") + 1))
    rest = told.groupBy("row").agg(
        F.sum(F.col("times") * F.log10((F.col("n") + 1) / F.lit(float(total + distinct + 1)))).alias("low2"),
        F.sum(F.col("times") * point).alias("gain2"),
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("known2"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = scored.drop("h", "x", "times").join(rest, "row", "left")
    points = F.col("gain") + zero("gain2")
    return out.select(
        F.col("k").alias(key), "held_out", "n_tokens", (F.col("known") + zero("known2")).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("low") + zero("low2")).alias("base_score"), points.alias("score"), F.pow(F.lit(10.0), -points / F.col("n_tokens")).alias("perplexity"),
    )


def _square(rows: pa.Table) -> np.ndarray:
    out = np.zeros(BEFORE * BECOMES)
    out[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    return out.reshape(BEFORE, BECOMES)
