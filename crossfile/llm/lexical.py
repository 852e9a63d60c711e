"""Ranked lexical search: the k best documents of every item, by a threshold-seeded join.

Terms are maximal runs of ASCII letters and digits and of all characters beyond ASCII, with A-Z lower-cased. The corpus is read
once: an index keeps, for every row, its number of terms and those that some item asks for, with their counts. From it come, for
every term, the documents that hold it and its k greatest impacts; the kth is stored. A term's kth impact is a score that k documents
reach for certain, so the greatest of an item's terms bounds its kth score from below. Terms in order of their greatest impacts, the least
first, can't reach that bound together as long as their sum stays under it: documents with none but these are no candidates. All others are
found from the terms left; each that may still reach the bound with the rest is scored in full, in whole numbers, where its row lies,
and a task passes on only its own k best, so that what is shuffled doesn't grow with hot terms.

Items come in blocks of at most ``VOCABULARY`` terms and ``ENTRIES`` pairs of item and term, which bounds what is sent to executors; each
block reads the corpus again. Rows that share an item's id are one item with the terms of all of them; a null id is an item too.
Null and empty texts, and texts without terms, are no documents and score nothing. Rows that share a doc_id are ranked one by one; equal
scores are ranked by doc_id, null last. Texts are read whole. Extra columns are ignored; without rows on either side there are no rows.
Terms are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crossfile.llm.frames import cut
from crossfile.llm.text import Words, buffers, frugal, slices

VOCABULARY, ENTRIES = 1 << 20, 1 << 21
#: Pairs of a term's occurrence and an item that asks for it, looked at together. One row may have more.
PAIRS = 1 << 21
_TERM = np.zeros(256, dtype=bool)
_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _words(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int) -> Words:
    return Words(data, offsets, lo, hi, lower=True, inside=_TERM.__getitem__)


def gain(tf: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """What a term of weight 1 gives a document of n terms that holds it tf times."""
    m = 25 + (75 * n * documents) // max(length, 1)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def _counted(w: Words, keep: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, count) of the distinct terms of each row, in order; of ``keep`` only, if given (sorted)."""
    h, row = w.hashes().view(np.int64), w.row
    if keep is not None:
        at = np.minimum(np.searchsorted(keep, h), max(len(keep) - 1, 0))
        found = keep[at] == h if len(keep) else np.zeros(len(h), dtype=bool)
        h, row = h[found], row[found]
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return row[at], h[at], np.diff(np.append(at, len(h)))


def terms_of(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item, term, times) of every item; ``item`` is a struct of the id, so that null is one too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = buffers(b.column(1))
            for lo, hi in slices(offsets):
                row, term, n = _counted(_words(data, offsets, lo, hi), None)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row + lo)), pa.array(term), pa.array(n)], ["item", "term", "times"])

    df = items.select(F.col(key).alias("item"), text)
    found = df.mapInArrow(frugal(run), f"item {df.schema[0].dataType.simpleString()}, term long, times long")
    return found.groupBy("item", "term").agg(F.sum("times").alias("times"))


def index(docs: DataFrame, vocabulary: Broadcast, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, n, places, counts) of every row with a term: how many it has, and where those asked for stand in the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = vocabulary.value
        for b in batches:
            data, offsets = buffers(b.column(1))
            for lo, hi in slices(offsets):
                w = _words(data, offsets, lo, hi)
                n = np.diff(w.first)
                row, term, count = _counted(w, keep)
                at = np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32)
                places = pa.ListArray.from_arrays(pa.array(at), pa.array(np.searchsorted(keep, term).astype(np.int32)))
                counts = pa.ListArray.from_arrays(pa.array(at), pa.array(count.astype(np.int32)))
                out = pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(n), places, counts], ["doc", "n", "places", "counts"])
                yield out.filter(pa.array(n > 0))

    df = docs.select(F.col(key).alias("doc"), text)
    return df.mapInArrow(frugal(run), f"doc {df.schema[0].dataType.simpleString()}, n long, places array<int>, counts array<int>")


def _flat(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, tf, n) of a batch of the index."""
    row = np.repeat(np.arange(b.num_rows), np.diff(b.column(2).offsets.to_numpy()))
    n = b.column(1).to_numpy(zero_copy_only=False)
    return row, b.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64), b.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.int64), n[row]


def _best(place: np.ndarray, value: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k greatest values of every place."""
    order = np.lexsort((-value, place))
    p = place[order]
    first = np.searchsorted(p, p)
    return order[np.arange(len(p)) - first < k]


def impacts(found: DataFrame, documents: int, length: int, k: int) -> DataFrame:
    """(place, df, top, kth): documents that hold a term, its greatest gain, and its kth (0 where fewer hold it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, value = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held, df = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            _, p, tf, n = _flat(b)
            seen, times = np.unique(p, return_counts=True)
            held, back = np.unique(np.concatenate([held, seen]), return_inverse=True)
            df = np.bincount(back, np.concatenate([df, times]), len(held)).astype(np.int64)
            place, value = np.concatenate([place, p]), np.concatenate([value, gain(tf, n, documents, length)])
            keep = _best(place, value, k)
            place, value = place[keep], value[keep]
        at = np.searchsorted(place, np.append(held, np.iinfo(np.int64).max)).astype(np.int32)  # both are in order of place
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(df), pa.ListArray.from_arrays(pa.array(at), pa.array(value))], ["place", "df", "gains"])

    part = cut(found.mapInArrow(frugal(run), "place long, df long, gains array<long>"))
    total = part.groupBy("place").agg(F.sum("df").alias("df"))
    rank = F.row_number().over(Window.partitionBy("place").orderBy(F.desc("gain")))
    best = part.select("place", F.explode("gains").alias("gain")).withColumn("r", rank).where(F.col("r") <= k)
    best = best.groupBy("place").agg(F.max("gain").alias("top"), F.coalesce(F.min(F.when(F.col("r") == k, F.col("gain"))), F.lit(0)).alias("kth"))
    return total.join(best, "place")


class Plan:
    """A block of items, ready to be sent: for each term the items it belongs to, its weight there, and whether it finds candidates.

    item, place, weight (times included), top and kth are parallel; ``bound`` and ``rest`` are by item.
    """

    def __init__(self, item: np.ndarray, place: np.ndarray, weight: np.ndarray, top: np.ndarray, kth: np.ndarray, items: int, places: int):
        top, kth = weight * top, weight * kth
        self.bound = np.zeros(items, np.int64)
        np.maximum.at(self.bound, item, kth)
        order = np.lexsort((top, item))
        total = np.cumsum(top[order])
        first = np.searchsorted(item[order], item[order])
        within = total - np.where(first > 0, total[first - 1], 0)
        finds = np.empty(len(item), dtype=bool)
        finds[order] = within >= self.bound[item[order]]
        self.rest = np.zeros(items, np.int64)
        np.add.at(self.rest, item[~finds], top[~finds])
        self.finding, self.resting = (self._lists(item[x], place[x], weight[x], places) for x in (finds, ~finds))

    @staticmethod
    def _lists(item: np.ndarray, place: np.ndarray, weight: np.ndarray, places: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(place, kind="stable")
        return np.searchsorted(place[order], np.arange(places + 1)), item[order], weight[order]

    def parts(self, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """The batch in pieces of about ``PAIRS`` pairs."""
        row, place, _, _ = _flat(b)
        asked = sum(np.diff(x[0])[place] for x in (self.finding, self.resting))
        at = np.cumsum(np.bincount(row, asked, b.num_rows))
        lo = 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(at, (at[lo - 1] if lo else 0) + PAIRS, "right")))
            yield b.slice(lo, hi - lo)
            lo = hi

    @staticmethod
    def sums(lists: tuple, rows: int, row: np.ndarray, place: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item * rows + row in order, score) from the terms of ``lists``."""
        first, item, weight = lists
        n = first[place + 1] - first[place]
        at = np.repeat(first[place] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        pair, score = item[at] * rows + np.repeat(row, n), weight[at] * np.repeat(value, n)
        order = np.argsort(pair, kind="stable")
        pair = pair[order]
        start = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else np.zeros(0, np.int64)
        return pair[start], np.add.reduceat(score[order], start) if len(pair) else np.zeros(0, np.int64)

    def scored(self, row: np.ndarray, place: np.ndarray, value: np.ndarray, rows: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, row, score) of every pair that may reach ``least`` of its item, in full."""
        pair, score = self.sums(self.finding, rows, row, place, value)
        able = score + self.rest[pair // rows] >= least[pair // rows]
        pair, score = pair[able], score[able]
        likely = np.isin(row, np.unique(pair % rows))
        more, add = self.sums(self.resting, rows, row[likely], place[likely], value[likely])
        if len(more):
            at = np.minimum(np.searchsorted(more, pair), len(more) - 1)
            score = score + np.where(more[at] == pair, add[at], 0)
        able = (score >= least[pair // rows]) & (score > 0)
        return pair[able] // rows, pair[able] % rows, score[able]


def _ranks(doc: pa.Array) -> np.ndarray:
    """The order of ids, null last."""
    order = pa.compute.sort_indices(doc, null_placement="at_end").to_numpy()
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order))
    return out


def ranked(found: DataFrame, plan: Broadcast, documents: int, length: int, k: int) -> DataFrame:
    """(item, doc, score): every task's k best documents of each item; the least score that still counts rises as it goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p: Plan = plan.value
        least = p.bound.copy()
        item, score, doc = np.zeros(0, np.int64), np.zeros(0, np.int64), None
        for b in (part for whole in batches for part in p.parts(whole)):
            row, place, tf, n = _flat(b)
            i, r, s = p.scored(row, place, gain(tf, n, documents, length), b.num_rows, least)
            ids = b.column(0).take(pa.array(r))
            doc = ids if doc is None else pa.concat_arrays([doc, ids])
            item, score = np.concatenate([item, i]), np.concatenate([score, s])
            order = np.lexsort((_ranks(doc), -score, item))
            held = item[order]
            keep = order[np.arange(len(held)) - np.searchsorted(held, held) < k]
            item, score, doc = item[keep], score[keep], doc.take(pa.array(keep))
            full = np.flatnonzero(np.bincount(item, minlength=len(least)) == k)
            last = np.searchsorted(item, full, "right") - 1
            least[full] = np.maximum(least[full], score[last])
        if doc is not None:
            yield pa.RecordBatch.from_arrays([pa.array(item), doc, pa.array(score)], ["place", "doc", "score"])

    return found.mapInArrow(frugal(run), f"place long, doc {found.schema['doc'].dataType.simpleString()}, score long")


def _block(docs: DataFrame, asked: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """The best documents of a block of items (item, term, times)."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    rows = asked.orderBy("item", "term").toArrow()
    ids = rows.column("item").combine_chunks()
    new = np.append(True, pa.compute.fill_null(pa.compute.not_equal(ids.slice(1), ids.slice(0, len(ids) - 1)), True).to_numpy(zero_copy_only=False)) if len(ids) > 1 else np.ones(len(ids), bool)
    # Null ids come first and are equal to each other.
    new[1 : ids.null_count] = False
    item, term, times = np.cumsum(new) - 1, rows.column("term").to_numpy(), rows.column("times").to_numpy()
    vocabulary = np.unique(term)
    found = cut(index(docs, sc.broadcast(vocabulary), key, text))
    documents, length = found.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    stats = impacts(found, documents, length, k).toArrow()
    where = stats.column("place").to_numpy()
    df, top, kth = (np.zeros(len(vocabulary), np.int64) for _ in range(3))
    for name, to in (("df", df), ("top", top), ("kth", kth)):
        to[where] = stats.column(name).to_numpy()
    weight = np.floor(1000 * np.log((2 * documents + 2) / (2 * df + 1))).astype(np.int64)
    place = np.searchsorted(vocabulary, term)
    held = df[place] > 0
    item, place, times = item[held], place[held], times[held]
    plan = Plan(item, place, weight[place] * times, top[place], kth[place], int(new.sum()), len(vocabulary))
    best = ranked(found, sc.broadcast(plan), documents, length, k)
    rank = F.row_number().over(Window.partitionBy("place").orderBy(F.desc("score"), F.asc_nulls_last("doc")))
    names = spark.createDataFrame(pa.table({"place": pa.array(np.arange(int(new.sum()))), "item": ids.filter(pa.array(new))}))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).join(names, "place").select("item", "rank", "doc", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10, item_key: str = "item_id", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(item id, rank, doc id, score): the k best documents of every item with a score above 0."""
    asked = cut(terms_of(items, item_key, text))
    entries = asked.count()
    names = [F.col("item").alias(item_key), "rank", F.col("doc").alias(key), "score"]
    if not entries:
        kinds = items.schema[item_key].dataType.simpleString(), docs.schema[key].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], f"item {kinds[0]}, rank int, doc {kinds[1]}, score long").select(*names)
    blocks = max(-(-entries // ENTRIES), -(-entries // VOCABULARY)) * 2 if entries > min(ENTRIES, VOCABULARY) else 1
    if blocks == 1:
        return _block(docs, asked, key, text, k).select(*names)
    asked = asked.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))
    parts = [_block(docs, asked.where(F.col("block") == i).drop("block"), key, text, k) for i in range(blocks) if not asked.where(F.col("block") == i).isEmpty()]
    return reduce(DataFrame.unionByName, parts).select(*names)
