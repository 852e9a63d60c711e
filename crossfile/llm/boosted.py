"""Quality of documents by histogram gradient-boosted trees over statistics of their texts.

Statistics are counted over whole texts as UTF-8 bytes: lengths, kinds of characters, words, lines, repetition, and how even bytes are.
Each is cut into at most ``BINS`` bins at quantiles of the training rows; trees of a fixed depth are grown level by level from
histograms of gradients, split where the gain in logistic loss is greatest. All trees are then laid out in arrays of places (feature,
limit) and leaves, in which a batch of rows goes down every tree at once, level by level.

Fitted on at most ``SAMPLE`` labelled rows of each class (the least hashes of their ids), with weights that bring back their shares.
Ids with several labels count by their least label; rows that share an id all train with it. Null and empty texts have statistics of zero and a score like
any. Repeated rows score alike. Extra columns are ignored; an empty table gives no rows. Without both labels in the training part every score is the share
of label 1 there (1/2 without any).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossfile.llm.frames import text_key
from crossfile.llm.quality import repeated
from crossfile.llm.text import Words, buffers, frugal, inside, mix, segment_hashes, slices, windows

SAMPLE = 8000
BINS, DEPTH, TREES, RATE = 64, 4, 80, 0.15
LEAST_ROWS, RIDGE = 8, 1.0
THRESHOLD = 0.7

KINDS = ("upper", "lower", "digit", "space", "stop", "comma", "mark", "quote", "bracket", "symbol", "bar", "other", "beyond")
_KIND = np.full(256, KINDS.index("other"), dtype=np.int8)
for _kind, _chars in (
    ("upper", range(0x41, 0x5B)), ("lower", range(0x61, 0x7B)), ("digit", range(0x30, 0x3A)), ("space", (0x20, *range(0x09, 0x0E))), ("stop", b"."), ("comma", b",;:"), ("mark", b"!?"), ("quote", b"'\"`"),
    ("bracket", b"()[]{}"), ("symbol", b"#*$%&<>"), ("bar", b"|"), ("beyond", range(0x80, 0x100)),
):
    _KIND[list(_chars)] = KINDS.index(_kind)
GRAMS = (2, 5, 8)
FEATURES = (
    *KINDS, "log_bytes", "log_words", "bytes_a_word", "longest_word", "one_byte_words", "words_with_letters", "words_ending_in_stop", "words_ending_in_symbol", "words_starting_upper",
    "distinct_words", *(f"repeated_{k}" for k in GRAMS), "log_lines", "words_a_line", "repeated_lines", "lines_ending_in_stop", "evenness", "commonest_byte", "doubled_bytes",
)


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def _stats(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """FEATURES of rows lo..hi."""
    w, n_rows = Words(data, offsets, lo, hi), hi - lo
    size = np.diff(w.rows)
    row_of_byte = np.repeat(np.arange(n_rows), size)
    kind = _KIND[w.bytes]
    kinds = np.bincount(row_of_byte * len(KINDS) + kind, minlength=n_rows * len(KINDS)).reshape(n_rows, -1)
    words, row, length = np.diff(w.first), w.row, w.end - w.start
    by_word = lambda x: np.bincount(row, x, n_rows)
    letters = np.concatenate([[0], np.cumsum((kind == 0) | (kind == 1) | (kind == KINDS.index("beyond")), dtype=np.int64)])
    last, first = (kind[w.end - 1], kind[w.start]) if len(w) else (np.zeros(0, np.int8),) * 2
    longest = np.zeros(n_rows)
    np.maximum.at(longest, row, length)
    h, salt = w.hashes(), mix(np.arange(n_rows, dtype=np.uint64) + np.uint64(1))
    _, later = repeated(mix(h ^ salt[row]))
    grams = []
    for k in GRAMS:
        spot = np.flatnonzero(inside(w.first, k))
        twice, _ = repeated(mix(windows(h, k)[spot] ^ salt[row[spot]]))
        grams.append(_share(np.bincount(row[spot], twice, n_rows), words - k + 1))
    cuts = np.unique(np.concatenate([w.rows, np.flatnonzero(w.bytes == 10) + 1]))
    start, end = cuts[:-1], cuts[1:]
    at = np.searchsorted(w.start, end)
    held = at > np.searchsorted(w.start, start)
    start, end, at = start[held], end[held], at[held]
    line_row = np.searchsorted(w.rows, start, "right") - 1
    _, again = repeated(mix(segment_hashes(w.bytes, start, w.end[at - 1]) ^ salt[line_row])) if len(at) else (None, np.zeros(0, bool))
    lines = np.bincount(line_row, minlength=n_rows)
    counts = np.bincount(row_of_byte * 256 + w.bytes, minlength=n_rows * 256).reshape(n_rows, 256)
    p = counts / np.maximum(size, 1)[:, None]
    doubled = np.flatnonzero((w.bytes[1:] == w.bytes[:-1]) & (row_of_byte[1:] == row_of_byte[:-1]))
    symbols = np.isin(last, [KINDS.index(x) for x in ("mark", "symbol", "bar", "other")])
    out = [
        *_share(kinds, size[:, None]).T, np.log1p(size), np.log1p(words), _share(by_word(length), words), longest, _share(by_word(length == 1), words), _share(by_word(letters[w.end] > letters[w.start]), words),
        _share(by_word(last == KINDS.index("stop")), words), _share(by_word(symbols), words), _share(by_word(first == 0), words), _share(words - by_word(later), words), *grams,
        np.log1p(lines), _share(words, lines), _share(np.bincount(line_row, again, n_rows), lines), _share(np.bincount(line_row, last[at - 1] == KINDS.index("stop"), n_rows), lines),
        -(p * np.log2(np.where(p > 0, p, 1))).sum(axis=1), p.max(axis=1, initial=0), _share(np.bincount(row_of_byte[doubled], minlength=n_rows), size),
    ]
    return np.stack(out, axis=1).astype(np.float64)


def statistics(texts: pa.Array) -> np.ndarray:
    data, offsets = buffers(texts)
    got = [_stats(data, offsets, lo, hi) for lo, hi in slices(offsets)]
    return np.concatenate(got) if got else np.zeros((0, len(FEATURES)))


class Trees:
    """Complete trees in arrays: a row at place i of a level goes to 2i + 1, or to 2i + 2 if its feature is above the limit."""

    def __init__(self, feature: np.ndarray, limit: np.ndarray, leaf: np.ndarray, base: float):
        self.feature, self.limit, self.leaf, self.base = feature, limit, leaf, base

    def raw(self, x: np.ndarray) -> np.ndarray:
        trees, depth = len(self.leaf), int(np.log2(self.leaf.shape[1])) if len(self.leaf) else 0
        out = np.full(len(x), self.base)
        for a in range(0, len(x), 4096):
            part = x[a : a + 4096]
            rows, of, at = np.arange(len(part))[:, None], np.arange(trees)[None, :], np.zeros((len(part), trees), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (part[rows, self.feature[of, at]] > self.limit[of, at])
            out[a : a + 4096] += self.leaf[of, at - (self.leaf.shape[1] - 1)].sum(axis=1) if trees else 0.0
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -40, 40)))


def _level(binned: np.ndarray, node: np.ndarray, grad: np.ndarray, curve: np.ndarray, weight: np.ndarray, nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """The best (feature, bin) of each node of a level; bin BINS - 1 sends all rows left."""
    sums = []
    for values in (grad, curve, weight):
        h = np.stack([np.bincount(node * BINS + binned[:, j], values, nodes * BINS) for j in range(binned.shape[1])])
        sums.append(np.cumsum(h.reshape(binned.shape[1], nodes, BINS), axis=2))
    g, h, n = sums
    all_g, all_h, all_n = (s[:, :, -1:] for s in sums)
    gain = g**2 / (h + RIDGE) + (all_g - g) ** 2 / (all_h - h + RIDGE) - all_g**2 / (all_h + RIDGE)
    gain = np.where((n >= LEAST_ROWS) & (all_n - n >= LEAST_ROWS), gain, 0.0).transpose(1, 0, 2).reshape(nodes, -1)
    best = gain.argmax(axis=1)
    feature, cut = best // BINS, best % BINS
    return feature, np.where(gain[np.arange(nodes), best] > 1e-9, cut, BINS - 1)


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Trees:
    """Boosted trees for labels 0 and 1; weights are relative."""
    share = float(np.average(y, weights=weight)) if len(y) else 0.5
    if not len(y) or not 0 < share < 1:
        return Trees(np.zeros((0, 0), np.int64), np.zeros((0, 0)), np.zeros((0, 1 << depth)), float(np.clip(np.log(max(share, 1e-9) / max(1 - share, 1e-9)), -20, 20)))
    limits = [np.unique(np.quantile(x[:, j], np.arange(1, BINS) / BINS)) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(limits[j], x[:, j], "left") for j in range(x.shape[1])], axis=1)
    padded = np.full((x.shape[1], BINS), np.inf)
    for j, v in enumerate(limits):
        padded[j, : len(v)] = v
    weight = weight * (len(y) / weight.sum())
    base = float(np.log(share / (1 - share)))
    raw, places = np.full(len(y), base), (1 << depth) - 1
    feature, limit, leaf = np.zeros((trees, places), np.int64), np.full((trees, places), np.inf), np.zeros((trees, places + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        grad, curve = weight * (y - p), weight * p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for d in range(depth):
            best, cut = _level(binned, node, grad, curve, np.ones(len(y)), 1 << d)
            at = slice((1 << d) - 1, (2 << d) - 1)
            feature[t, at], limit[t, at] = best, padded[best, cut]
            node = 2 * node + (binned[np.arange(len(y)), best[node]] > cut[node])
        g, h = np.bincount(node, grad, places + 1), np.bincount(node, curve, places + 1)
        leaf[t] = rate * g / (h + RIDGE)
        raw += leaf[t][node]
    return Trees(feature, limit, leaf, base)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Trees:
    """Trees from the labelled documents outside the fold that is held out. Statistics are taken where the texts are."""
    labels = labels.select(F.col(key).alias("_k"), F.col(label).cast("int").alias("_y")).where("_y is not null and _k is not null").where(text_key("_k") % 4 != 2).groupBy("_k").agg(F.min("_y").alias("_y"))
    counts = {bool(r.y): r.n for r in labels.groupBy((F.col("_y") == 1).alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    texts = docs.select(F.col(key).alias("_k"), F.col(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = statistics(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))], ["h", "x"])

    found = []
    for y in (False, True):
        ids = labels.where((F.col("_y") == 1) == F.lit(y)).select("_k").orderBy(F.xxhash64("_k"), "_k").limit(sample)
        chosen = texts.join(F.broadcast(ids), "_k").select(F.xxhash64("_k", "t").alias("h"), "t")
        rows = chosen.mapInArrow(frugal(run), "h long, x array<double>").orderBy("h").limit(2 * sample).toArrow()
        found.append(np.array(rows.column("x").combine_chunks().flatten()).reshape(-1, len(FEATURES)))
    x, y = np.concatenate(found), np.repeat([0.0, 1.0], [len(v) for v in found])
    weight = np.where(y == 1, counts.get(True, 0) / max(len(found[1]), 1), counts.get(False, 0) / max(len(found[0]), 1))
    return train(x, y, weight)


def classify(docs: DataFrame, model: Trees, key: str = "doc_id", text: str = "text") -> DataFrame:
    """held_out, score and predicted of every row."""
    docs = docs.select(key, text, (text_key(key) % 4 == 2).alias("held_out"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = model.score(statistics(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], [key, "held_out", "score", "predicted"])

    return docs.mapInArrow(frugal(run), f"`{key}` {docs.schema[0].dataType.simpleString()}, held_out boolean, score double, predicted int")
