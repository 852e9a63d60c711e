"""Words of whole texts as numpy arrays, read straight from Arrow's UTF-8 buffers.

A word is a maximal run of bytes other than space and 0x09-0x0D. Those six bytes are ASCII, so cutting at them never
splits a UTF-8 character. Work goes over slices of about ``SLICE`` bytes, so temporary arrays stay small whatever a batch holds.
"""

from __future__ import annotations

import ctypes
import functools
import gc
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(33)
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


def frugal(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same work on a partition's batches; what it used goes back to the system afterwards, for workers wait for the next stage
    with all that their allocators hold."""

    @functools.wraps(run)
    def inner(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return inner


def thrifty(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """As ``frugal``, for a group, where that is large."""

    def inner(group: pa.Table) -> pa.Table:
        large = group.nbytes > 4 << 20
        out = run(group)
        if large:
            give_back()
        return out

    return inner


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def odd_numbers(n: int, lane: int = 0) -> np.ndarray:
    """n fixed pseudo-random odd 64-bit numbers; lanes are independent of each other."""
    return mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(lane * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)) | _U(1)


_weights = {0: odd_numbers(256)}


def _weights_for(n: int) -> np.ndarray:
    if len(_weights[0]) < n:
        _weights[0] = odd_numbers(max(n, 2 * len(_weights[0])))
    return _weights[0]


def buffers(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def slices(offsets: np.ndarray, limit: int = SLICE):
    """Ranges [lo, hi) of rows of about ``limit`` bytes; one row may be longer."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


class Words:
    """The words of rows lo..hi of (data, offsets).

    ``start`` and ``end`` are byte positions in ``bytes``; row i's words are first[i]:first[i + 1]. ``inside`` tells the bytes of words
    of another kind.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lo: int, hi: int, lower: bool = False, inside: Callable[[np.ndarray], np.ndarray] | None = None):
        base = offsets[lo]
        self.bytes = data[base : offsets[hi]]
        if lower:
            self.bytes = _LOWER[self.bytes]
        self.rows = (offsets[lo : hi + 1] - base).astype(np.int64)
        word = np.zeros(len(self.bytes) + 1, dtype=bool)
        word[:-1] = ~_SPACE[self.bytes] if inside is None else inside(self.bytes)
        before = np.zeros(len(word), dtype=bool)
        before[1:] = word[:-1]
        cut = np.zeros(len(word), dtype=bool)
        cut[self.rows] = True
        self.start = np.flatnonzero(word & (~before | cut))
        self.end = np.flatnonzero(before & (~word | cut))
        self.first = np.searchsorted(self.start, self.rows)
        self.word_bytes = word[:-1]

    def __len__(self) -> int:
        return len(self.start)

    @property
    def row(self) -> np.ndarray:
        """The row each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        return segment_hashes(self.bytes, self.start, self.end, self.word_bytes)


def segment_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, of: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each segment: multilinear over its bytes, then mixed with its length.

    Segments are in order, not empty, and don't overlap. ``of``: the bytes that lie in segments, where that is known.
    Segments longer than a slice are hashed by hashlib.
    """
    out = np.empty(len(start), dtype=_U)
    size = end - start
    at = 0
    while at < len(start):
        if size[at] > SLICE:
            out[at] = int.from_bytes(hashlib.blake2b(data[start[at] : end[at]].tobytes(), digest_size=8).digest(), "little")
            at += 1
            continue
        to = max(at + 1, int(np.searchsorted(start, start[at] + SLICE)))
        if size[to - 1] > SLICE:
            to -= 1
        n = size[at:to]
        span = slice(start[at], end[to - 1])
        begin = np.cumsum(n) - n
        inner = np.arange(int(n.sum())) - np.repeat(begin, n)
        values = data[span][of[span]] if of is not None else data[np.repeat(start[at:to], n) + inner]
        values = values.astype(_U) + _U(1)
        values *= _weights_for(int(n.max()))[inner]
        out[at:to] = mix(np.add.reduceat(values, begin) ^ (n.astype(_U) * _U(0x9E3779B97F4A7C15)))
        at = to
    return out


def windows(h: np.ndarray, k: int, lane: int = 0) -> np.ndarray:
    """Hashes of all k consecutive values: element i covers i..i+k-1 (len(h) - k + 1 of them)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=_U)
    r = odd_numbers(k, lane + 7 * k)
    out = np.zeros(n, dtype=_U)
    for i in range(k):
        out += h[i : i + n] * r[i]
    return mix(out)


def inside(first: np.ndarray, k: int) -> np.ndarray:
    """For windows of k over concatenated rows: whether each lies in one row. Rows bound at ``first``."""
    n = int(first[-1]) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=bool)
    left = np.repeat(first[1:], np.diff(first))  # the end of each word's row
    return np.arange(n) + k <= left[:n]
