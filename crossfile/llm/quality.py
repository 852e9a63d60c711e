"""Repetition coverage: the share of a text's characters inside n-grams and lines that it holds more than once.

Every text is read whole, as UTF-8 bytes. Rolling hashes of several n-gram lengths are sorted per slice of texts; words in a
hash found twice in one document are marked, so overlapping copies count once. All of it is per row: nothing is shuffled.

Texts of any length are measured whole. A share equal to its limit passes. Null and empty texts have no words and fail the base rule. Repeated rows are judged alike, each by itself. Extra columns are
ignored by ``measure`` and kept by ``keep``. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from crossfile.llm.text import Words, buffers, frugal, inside, mix, segment_hashes, slices, windows

#: Largest share of characters in repeated n-grams, by n-gram length; and in repeated lines. Fixed values.
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINE_LIMIT = 0.20
BASE_WINDOW, BASE_WORDS, BASE_PERCENT = 8, 20, 30
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True

FIELDS = [("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"), ("base_failed", "boolean"), ("kept", "boolean"), *((f"gram{n}_share", "double") for n in NGRAM_LIMITS), ("line_share", "double")]


def repeated(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether each value occurs more than once, whether it is equal to an earlier one)."""
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    twice, later = np.zeros(len(key), dtype=bool), np.zeros(len(key), dtype=bool)
    later[order[1:]] = same
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    return twice, later


def _covered(hit: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of n positions lie in a marked window of k."""
    edge = np.zeros(n + 1, dtype=np.int32)
    edge[: len(hit)] += hit
    edge[k : k + len(hit)] -= hit
    return np.cumsum(edge[:-1]) > 0


def _by_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[first[1:]] - total[first[:-1]]


def _measures(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int) -> list[np.ndarray]:
    w = Words(data, offsets, lo, hi)
    n_rows = hi - lo
    point = (w.bytes & 0xC0) != 0x80
    points = np.concatenate([[0], np.cumsum(point, dtype=np.int64)])
    length = points[w.end] - points[w.start]
    n_words, chars = np.diff(w.first), _by_row(length, w.first)
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[w.bytes], dtype=np.int64)])
    symbols = symbols[w.rows[1:]] - symbols[w.rows[:-1]]

    # Lines: cut after every \\n and at every row; those that hold a word.
    cuts = np.unique(np.concatenate([w.rows, np.flatnonzero(w.bytes == 10) + 1]))
    start, end = cuts[:-1], cuts[1:]
    end = end - (w.bytes[end - 1] == 10)
    at = np.searchsorted(w.start, start)
    held = at < np.searchsorted(w.start, end)
    start, end = start[held], end[held]
    line_row = np.searchsorted(w.rows, start, "right") - 1
    salt = mix(np.arange(n_rows, dtype=np.uint64) + np.uint64(1))
    twice, later = repeated(mix(segment_hashes(w.bytes, start, end) ^ salt[line_row]))
    line_chars = np.bincount(line_row, np.where(twice, points[end] - points[start], 0), n_rows)
    all_chars = np.bincount(line_row, points[end] - points[start], n_rows)
    dup_lines = np.bincount(line_row, later, n_rows).astype(np.int64)

    row, h, shares, n_repeat = w.row, w.hashes(), [], np.zeros(n_rows, dtype=np.int64)
    for k in NGRAM_LIMITS:
        own = inside(w.first, k)
        spot = np.flatnonzero(own)
        twice, _ = repeated(mix(windows(h, k)[spot] ^ salt[row[spot]]))
        hit = np.zeros(len(own), dtype=np.int32)
        hit[spot] = twice
        covered = _covered(hit, k, len(w)) if len(own) else np.zeros(len(w), dtype=bool)
        shares.append(_by_row(length * covered, w.first) / np.maximum(chars, 1))
        if k == BASE_WINDOW:
            n_repeat = _by_row(covered, w.first)
    line_share = line_chars / np.maximum(all_chars, 1)
    failed = (n_words < BASE_WORDS) | (100 * n_repeat > BASE_PERCENT * n_words)
    kept = ~failed & (line_share <= LINE_LIMIT)
    for share, limit in zip(shares, NGRAM_LIMITS.values(), strict=True):
        kept &= share <= limit
    return [n_words, chars, symbols, dup_lines, n_repeat, failed, kept, *shares, line_share]


_TYPES = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}


def _columns(texts: pa.Array) -> list[pa.Array]:
    data, offsets = buffers(texts)
    got = [_measures(data, offsets, lo, hi) for lo, hi in slices(offsets)]
    return [pa.array(np.concatenate([x[i] for x in got]) if got else [], type=_TYPES[kind]) for i, (_, kind) in enumerate(FIELDS)]


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key and FIELDS of every row."""
    docs = docs.select(key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), *_columns(b.column(1))], [key, *(n for n, _ in FIELDS)])

    kind = docs.schema[0].dataType.simpleString()
    return docs.mapInArrow(frugal(run), ", ".join([f"`{key}` {kind}", *(f"{n} {t}" for n, t in FIELDS)]))


def keep(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(_columns(b.column(at))[[n for n, _ in FIELDS].index("kept")])

    return docs.mapInArrow(frugal(run), docs.schema)
