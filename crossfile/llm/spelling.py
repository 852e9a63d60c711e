"""Spelling variants: words that differ by one inserted, deleted or replaced character, and the common form of each.

Words are runs of letters A-Z, a-z and U+00C0 to U+00FF with A-Z lower-cased; every character fits one byte. Occurrences are counted in
tasks before they are shuffled. Of every word each deletion gets a key of integers, from polynomial hashes of what stands before
and after the letter left out: one that keeps the place, which words differing in that letter alone share, and one that closes the gap,
which the word without the letter shares as its own. Keys are dealt by their high bits over as many buckets as there are keys
for, sorted there, and words that share one are compared as strings. Groups of equal keys are at most as large as the alphabet (or
the alphabet times the places of a word), and are reduced to counts and best words, not pairs. Words beyond ``LONG`` letters send their names
instead of themselves with every key, so their keys take space in proportion to their length; the few pairs they meet in are joined
with the words and compared as strings.

Null and empty texts have no words; rows that repeat count as often as they occur; of null ids the text is empty. Texts and runs of any length
are read whole. Extra columns are ignored; an empty table gives no rows. Ties of frequency go to the lesser word.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossfile.llm.frames import cut, parts
from crossfile.llm.text import Words, buffers, frugal, mix, segment_hashes, slices

#: Letters of the shortest word; occurrences of the rarest; how many times as frequent a form is.
LEAST_LETTERS, LEAST_TIMES, FACTOR = 7, 2, 10
#: One in so many pairs of document and run loses a letter.
SPOILT = 31
#: Letters of the longest word that is sent with its keys; keys to a bucket; words a task counts before it passes them on.
LONG, BUCKET, HELD = 64, 1 << 17, 1 << 17
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0xC3]] = True
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, _CRC >> 1 ^ np.uint32(0xEDB88320), _CRC >> 1)
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_U = np.uint64


def _letters(data: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 belong to letters: ASCII ones, and 0xC3 with the byte after it."""
    out = _LETTER[data]
    out[1:] |= data[:-1] == 0xC3
    return out


def crcs(data: np.ndarray, start: np.ndarray, end: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of each segment, continued from ``before``."""
    out, size = before.astype(np.uint32), end - start
    large = size > 4 * LONG
    for i in np.flatnonzero(large):
        out[i] = zlib.crc32(data[start[i] : end[i]].tobytes(), int(before[i]))
    order = np.flatnonzero(~large)
    order = order[np.argsort(-size[order], kind="stable")]
    state, at, less = ~out[order], start[order], -size[order]
    for j in range(-int(less.min(initial=0))):
        n = int(np.searchsorted(less, -j))  # those with a byte at j
        state[:n] = _CRC[(state[:n] ^ data[at[:n] + j]) & np.uint32(0xFF)] ^ state[:n] >> np.uint32(8)
    out[order] = ~state
    return out


def _occurrences(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int, prefix: np.ndarray) -> Iterator[tuple[str, int]]:
    """(word, times) of a slice of rows, spoilt runs with their letter left out."""
    w = Words(data, offsets, lo, hi, lower=True, inside=_letters)
    letter = (w.bytes & 0xC0) != 0x80
    seen = np.concatenate([[0], np.cumsum(letter, dtype=np.int64)])
    n = seen[w.end] - seen[w.start]
    use = np.flatnonzero(n >= LEAST_LETTERS)
    start, end, n = w.start[use], w.end[use], n[use]
    h = crcs(w.bytes, start, end, prefix[w.row[use]]).astype(np.int64)
    # From here on every letter is one byte.
    size = end - start
    spot = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    spot = spot[w.bytes[spot] != 0xC3]
    one = w.bytes[spot]
    one = np.where(one >= 0x80, one + 0x40, one).astype(np.uint8)
    at = np.cumsum(n) - n
    gone = h % SPOILT == 0
    keep = np.ones(len(one), dtype=bool)
    keep[(at + h % np.maximum(n, 1))[gone]] = False
    one, n = one[keep], n - gone
    at = np.cumsum(n) - n
    long = n >= LEAST_LETTERS
    at, n = at[long], n[long]
    if not len(n):
        return
    key = segment_hashes(one, at, at + n)
    _, first, which, times = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    spot = np.repeat(at - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    same = np.repeat(at[first][which] - at, n) + spot
    if (n != n[first][which]).any() or (one[spot] != one[np.minimum(same, len(one) - 1)]).any():  # two words of one hash
        raw = one.tobytes()
        for a, k in zip(at.tolist(), n.tolist(), strict=True):
            yield raw[a : a + k].decode("latin-1"), 1
        return
    raw = one.tobytes()
    for a, k, t in zip(at[first].tolist(), n[first].tolist(), times.tolist(), strict=True):
        yield raw[a : a + k].decode("latin-1"), t


def words(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): every word that occurs LEAST_TIMES times or more."""

    def out(held: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        for b in batches:
            data, offsets = buffers(b.column(1))
            prefix = np.array([zlib.crc32(f"{k}:".encode()) for k in b.column(0).to_pylist()], dtype=np.uint32)
            for lo, hi in slices(offsets):
                for word, times in _occurrences(data, offsets, lo, hi, prefix[lo:hi]):
                    held[word] = held.get(word, 0) + times
                if len(held) >= HELD:
                    yield out(held)
                    held = {}
        yield out(held)

    df = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), text)
    return df.mapInArrow(frugal(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_TIMES)


#: place is that of the letter left out, -1 for a word's own key, -2 where the gap is closed. word is null for long words.
KEYS = "bucket long, key long, place int, id long, n long, word binary"


def _keys(raw: pa.Array, ids: np.ndarray, n: np.ndarray, buckets: int) -> pa.RecordBatch:
    """KEYS of some words, as bytes of one letter each."""
    offsets = np.frombuffer(raw.buffers()[1], dtype=np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
    size = np.diff(offsets)
    c = np.frombuffer(raw.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]].astype(_U)
    owner = np.repeat(np.arange(len(size)), size)
    begin = np.cumsum(size) - size
    place = np.arange(len(c)) - begin[owner]
    power = np.full(int(size.max(initial=1)), _BASE, dtype=_U)
    power[0] = 1
    power = np.cumprod(power)
    value = (c + _U(1)) * power[place]
    upto = np.cumsum(value)
    before = upto - value - np.where(begin > 0, upto[np.maximum(begin - 1, 0)], _U(0))[owner]
    total = np.add.reduceat(value, begin) if len(size) else value
    after = total[owner] - before - value
    length = size[owner].astype(_U)
    replaced = mix(before + after ^ mix(place.astype(_U) * _U(_BASE) + length * _U(_BACK)))
    closed = mix(before + after * _U(_BACK) ^ mix(length - _U(1)))
    own = mix(total ^ mix(size.astype(_U)))
    # Of equal letters in a row leaving out any gives the same word.
    once = np.ones(len(c), dtype=bool)
    once[1:] = (c[1:] != c[:-1]) | (owner[1:] != owner[:-1])
    key = np.concatenate([own, replaced, closed[once]])
    row = np.concatenate([np.arange(len(size)), owner, owner[once]])
    places = np.concatenate([np.full(len(size), -1), place, -2 - place[once]])
    short = pa.array(np.where(size[row] <= LONG, row, -1))
    bucket = ((key >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)
    sent = raw.take(pa.compute.if_else(pa.compute.less(short, 0), None, short))
    return pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(key.view(np.int64)), pa.array(places.astype(np.int32)), pa.array(ids[row]), pa.array(n[row]), sent], ["bucket", "key", "place", "id", "n", "word"])


def _shared(group: pa.Table) -> pa.Table:
    """The rows of a bucket whose keys occur more than once, sorted by key."""
    key = group.column("key").to_numpy()
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    hit = np.append(same, False)
    hit[1:] |= same
    return group.take(pa.array(order[hit]))


def _meetings(group: pa.Table) -> Iterator[list[tuple[int, int, int, bytes | None]]]:
    """Rows (place, id, n, word) of each key, short words apart from long ones and told apart by what is left of them as strings."""
    shared = _shared(group)
    key = shared.column("key").to_numpy()
    bounds = np.flatnonzero(np.append(True, key[1:] != key[:-1])).tolist() if len(key) else []
    rows = list(zip(*(shared.column(c).to_pylist() for c in ("place", "id", "n", "word")), strict=True))
    for a, b in zip(bounds, [*bounds[1:], len(rows)], strict=True):
        if any(r[3] is None for r in rows[a:b]):
            yield rows[a:b]
            continue
        by: dict = {}
        for r in rows[a:b]:
            p, w = r[0], r[3]
            left = (p, w[:p], w[p + 1 :]) if p >= 0 else w if p == -1 else w[: -2 - p] + w[-1 - p :]
            by.setdefault(left, []).append(r)
        yield from (g for g in by.values() if len(g) > 1)


NEAR = "id long, n_near long, best_n long, best string, other long"


def _reduced(group: pa.Table) -> pa.Table:
    """NEAR of a bucket: for short words what a key adds to them; for long ones the pairs to be compared (best is null)."""
    out: list[tuple] = []
    for rows in _meetings(group):
        long = any(r[3] is None for r in rows)
        own = [r for r in rows if r[0] == -1]
        closed = [r for r in rows if r[0] <= -2]
        kept = [r for r in rows if r[0] >= 0]
        if long:
            out += [(x[1], 0, y[2], None, y[1]) for xs, ys in ((own, closed), (closed, own), (kept, kept)) for x in xs for y in ys if x[1] != y[1]]
            continue
        if own and closed:
            best = min(closed, key=lambda r: (-r[2], r[3]))
            out += [(o[1], len(closed), best[2], best[3].decode("latin-1"), None) for o in own]
            out += [(r[1], 1, own[0][2], own[0][3].decode("latin-1"), None) for r in closed]
        if len(kept) > 1:
            first, second = sorted(kept, key=lambda r: (-r[2], r[3]))[:2]
            for r in kept:
                b = second if r is first else first
                out.append((r[1], len(kept) - 1, b[2], b[3].decode("latin-1"), None))
    columns = list(zip(*out, strict=True)) if out else [()] * 5
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["id", "n_near", "best_n", "best", "other"])


def _differ_by_one(a: str, b: str) -> bool:
    """Whether two words differ by exactly one letter inserted, deleted or replaced."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :] if len(a) < len(b) else a[i + 1 :] == b[i:]


def near(known: DataFrame) -> DataFrame:
    """(id, n_near, best_n, best) for each of ``known`` (id, word, n) that has near words."""
    buckets = (known.agg(F.sum(2 * F.char_length("word") + 1)).first()[0] or 0) // BUCKET + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, n = b.column(0).to_numpy(), b.column(2).to_numpy()
            letters = np.cumsum(pa.compute.utf8_length(b.column(1)).to_numpy())
            lo = 0
            while lo < b.num_rows:
                hi = max(lo + 1, int(np.searchsorted(letters, (letters[lo - 1] if lo else 0) + (1 << 15), "right")))
                raw = pa.array([w.encode("latin-1") for w in b.column(1).slice(lo, hi - lo).to_pylist()], pa.binary())
                yield _keys(raw, ids[lo:hi], n[lo:hi], buckets)
                lo = hi

    keys = known.select("id", "word", "n").mapInArrow(frugal(run), KEYS)
    # As many tasks as buckets ask for, however few the session has.
    dealt = keys.repartition(max(parts(known.sparkSession), buckets), "bucket")
    met = cut(dealt.groupBy("bucket").applyInArrow(_reduced, NEAR))
    a, b = known.select("id", F.col("word").alias("a")), known.select(F.col("id").alias("other"), F.col("word").alias("b"))
    alike = F.udf(lambda x, y: _differ_by_one(x, y), "boolean")
    pairs = met.where("other is not null").select("id", "best_n", "other").distinct().join(a, "id").join(b, "other").where(alike("a", "b"))
    every = met.where("other is null").select("id", "n_near", "best_n", "best").union(pairs.select("id", F.lit(1).cast("long"), "best_n", F.col("b").alias("best")))
    least = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    return every.groupBy("id").agg(F.sum("n_near").alias("n_near"), least.alias("m")).select("id", "n_near", (-F.col("m.less")).alias("best_n"), F.col("m.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where the forms (word, form) lead, by doubling. Each form is FACTOR times as frequent, so ways are short."""
    now = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = cut(now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        now = after.drop("moved")
        if after.where("moved").isEmpty():
            return now


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    known = cut(words(docs, key, text).select(F.monotonically_increasing_id().alias("id"), "word", "n"))
    found = known.join(near(known), "id", "left")
    good = F.col("best_n") >= FACTOR * F.col("n")
    found = cut(found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(good, F.col("best")).alias("form"), F.when(good, F.col("best_n")).alias("form_n")))
    ends = roots(found.where("form is not null"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
