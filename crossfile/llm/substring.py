"""Substring removal by recompression: which 13-word windows start in an earlier document.

Words are parsed in rounds. The first names maximal runs of one word; each later one puts every symbol left or right by a bit
of its name and names each (left, right) pair. Names are hashes of what they stand for, so all tasks of a round agree on
them without a table. A symbol's parse depends on few words around it; the words it depends on are its reach. Wherever the
same words occur, every symbol whose reach lies among them occurs too, with the same reach: interior symbols are consistent.

1. Symbols after ``ROUNDS`` pair rounds, with their reaches, are gathered by name: those of two documents are shared.
2. A window that contains the reach of an unshared symbol is in no other document. The other windows are candidates.
3. Candidates are verified: 96-bit keys of their words are gathered, and every one that a smaller document has goes.

Entries are packed: a row is the entries of one batch for one bucket of names. A batch sends a name once per document, and
of documents that share it within the batch only the smallest asks elsewhere; so a hot name costs an entry per batch, not per
document. Buckets grow in number with the corpus; none is larger than its even share plus one entry per batch.

Documents are compared by id: rows with one id are one document. A null id is neither smaller nor larger than another: such
rows lose nothing and take nothing away. Null and empty texts have no words. Texts of fewer than 13 words stay whole. Extra
columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossfile.llm.text import Words, buffers, inside, mix, slices, windows

WINDOW, ROUNDS = 13, 2
#: Text bytes to a bucket of documents, and words to a bucket of names.
DOC_BUCKET, NAME_BUCKET = 4 << 20, 2 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    x = np.full(n + 1, base, dtype=_U)
    x[0] = 1
    return np.multiply.accumulate(x)


def symbols(h: np.ndarray, first: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(name, start, end, reach start, reach end) of the symbols that word hashes parse into; rows bound at ``first``.

    A reach that goes beyond its row is cut off by no other document's words: it ends outside the row, and no window holds it.
    """
    n = len(h)
    cut = np.zeros(n + 1, dtype=bool)
    cut[first] = True
    new = np.ones(n, dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | cut[1:n]
    a = np.flatnonzero(new)
    b = np.append(a[1:], n)[: len(a)]
    size = (b - a).astype(_U)
    name = np.where(size > 1, mix(h[a] + size * _U(0xD6E8FEB86659FD93)), h[a])
    da, db = a - 1, b + 1
    for r in range(1, rounds + 1):
        left = (mix(name + _U(r * 0xA0761D6478BD642F & (1 << 64) - 1)) & _U(1)) == 0
        joint = np.zeros(len(name), dtype=bool)  # with the next
        joint[:-1] = left[:-1] & ~left[1:] & ~cut[a[1:]]
        second = np.zeros(len(name), dtype=bool)
        second[1:] = joint[:-1]
        prev_da, next_db = da.copy(), db.copy()
        prev_da[1:] = np.where(cut[a[1:]], a[1:] - 1, da[:-1])
        next_db[:-1] = np.where(cut[a[1:]], a[1:] + 1, db[1:])
        alone = ~joint & ~second
        da = np.where(alone & ~left, np.minimum(da, prev_da), da)
        db = np.where(alone & left, np.maximum(db, next_db), db)
        at = np.flatnonzero(joint)
        name = name.copy()
        name[at] = mix(name[at] * _U(0xE7037ED1A0B428DB) + (name[at + 1] << _U(1)) + _U(r))
        b = b.copy()
        b[at], db[at] = b[at + 1], np.maximum(db[at], db[at + 1])
        da[at] = np.minimum(da[at], da[at + 1])
        keep = ~second
        name, a, b, da, db = name[keep], a[keep], b[keep], da[keep], db[keep]
    return name, a, b, da, db


def anchors(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, reach start, reach end) of every other symbol whose reach fits in a window. The key is of all the reach's words."""
    name, a, _, da, db = symbols(h, first)
    row = np.searchsorted(first, a, "right") - 1
    ok = (da >= first[row]) & (db <= first[row + 1]) & (db - da <= WINDOW)
    name, da, db = name[ok], da[ok], db[ok]
    sums = np.concatenate([[_U(0)], np.cumsum(h * _powers(_BASE, len(h))[: len(h)], dtype=_U)])
    back = _powers(_INVERSE, len(h))
    key = mix((sums[db] - sums[da]) * back[da] + (db - da).astype(_U) * _U(0x8EBC6AF09C88C6E3))
    thin = (key & _U(1)) == 0
    return key[thin], da[thin], db[thin]


def window_keys(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, 64 bits, 32 further bits) of every window."""
    at = np.flatnonzero(inside(first, WINDOW))
    return at, windows(h, WINDOW)[at], (windows(h, WINDOW, 3)[at] >> _U(32)).astype(np.uint32)


ENTRIES = "bucket int, asks boolean, k binary, k2 binary, d binary"


def _bucket_of(key: np.ndarray, n: int) -> np.ndarray:
    return ((key >> _U(32)) % _U(n)).astype(np.int32)


def _rows(bucket: np.ndarray, n: int, asks: bool, *columns: np.ndarray) -> pa.RecordBatch:
    """One row for each bucket that has entries; entries keep their order."""
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(n + 1))
    there = np.flatnonzero(np.diff(edges))
    packed = []
    for c in columns:
        c = c[order]
        packed.append(pa.array([c[edges[i] : edges[i + 1]].tobytes() for i in there], pa.binary()))
    return pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(np.full(len(there), asks)), *packed], ["bucket", "asks", "k", "k2", "d"])


def _ask(key: np.ndarray, key2: np.ndarray, doc: np.ndarray, shared_by_two: bool, n_names: int, n_docs: int) -> Iterator[pa.RecordBatch]:
    """Rows for the reducers: what must be asked elsewhere, and what this batch already knows, addressed to documents.

    shared_by_two: an entry holds if another document has its key; else, if a smaller one has.
    """
    order = np.lexsort((doc, key2, key))
    key, key2, doc = key[order], key2[order], doc[order]
    fresh = np.ones(len(key), dtype=bool)
    fresh[1:] = (key[1:] != key[:-1]) | (key2[1:] != key2[:-1])
    distinct = fresh.copy()
    distinct[1:] |= doc[1:] != doc[:-1]
    key, key2, doc, fresh = key[distinct], key2[distinct], doc[distinct], fresh[distinct]
    if not len(key):
        return
    start = np.flatnonzero(fresh)
    size = np.diff(np.append(start, len(key)))
    known = ~fresh
    if shared_by_two:
        known[start[size > 1]] = True
    ask = fresh
    yield _rows(_bucket_of(key[ask], n_names), n_names, True, key[ask], key2[ask], doc[ask])
    yield _rows((doc[known] % n_docs).astype(np.int32), n_docs, False, key[known], key2[known], doc[known])
    if shared_by_two:  # that two documents have it, others must hear too: a second entry, of another of them
        two = start[size > 1] + 1
        yield _rows(_bucket_of(key[two], n_names), n_names, True, key[two], key2[two], doc[two])


def _unpack(table: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(x.as_py() for x in table.column(c)), dtype=t) for c, t in (("k", _U), ("k2", np.uint32), ("d", np.int64))]


def _answer(shared_by_two: bool, n_docs: int):
    def run(table: pa.Table) -> pa.Table:
        asked = table.filter(table.column("asks"))
        told = table.filter(pa.compute.invert(table.column("asks")))
        key, key2, doc = _unpack(asked)
        out = []
        if len(key):
            order = np.lexsort((doc, key2, key))
            key, key2, doc = key[order], key2[order], doc[order]
            fresh = np.ones(len(key), dtype=bool)
            fresh[1:] = (key[1:] != key[:-1]) | (key2[1:] != key2[:-1])
            start = np.flatnonzero(fresh)
            size = np.diff(np.append(start, len(key)))
            least = np.repeat(doc[start], size)
            hit = np.repeat(doc[start + size - 1], size) > least if shared_by_two else doc > least
            rows = _rows((doc[hit] % n_docs).astype(np.int32), n_docs, False, key[hit], key2[hit], doc[hit])
            out.append(pa.table({"bucket": rows.column(0), "k": rows.column(2), "d": rows.column(4)}))
        if len(told):
            out.append(told.select(["bucket", "k", "d"]))
        schema = pa.schema([("bucket", pa.int32()), ("k", pa.binary()), ("d", pa.binary())])
        return pa.concat_tables([x.cast(schema) for x in out]) if out else schema.empty_table()

    return run


def _members(keys: np.ndarray, docs: np.ndarray, key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether each (key, doc) is among (keys, docs)."""
    x, y = mix(keys ^ mix(docs.view(_U))), mix(key ^ mix(doc.view(_U)))
    return np.isin(y, x)


def _ids(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids, whether they are given)."""
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), ~column.is_null().to_numpy(zero_copy_only=False)


def _sized(docs: DataFrame) -> tuple[int, int]:
    """Numbers of buckets (documents, names): primes, so that no step of ids meets in few."""
    total = docs.agg(F.sum(F.octet_length("t"))).first()[0] or 0

    def prime(n: int) -> int:
        while any(n % i == 0 for i in range(2, int(n**0.5) + 1)):
            n += 1
        return n

    return prime(max(13, total // DOC_BUCKET)), prime(max(17, total // 6 // NAME_BUCKET * 4))


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", keep_text: bool = False) -> DataFrame:
    """n_words, n_removed and kept_sha256 (and kept_text on request) of every row."""
    docs = docs.select(F.col(key).cast("long").alias("d"), F.col(text).alias("t"))
    n_docs, n_names = _sized(docs)

    def first_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, given = _ids(b.column(0))
            data, offsets = buffers(b.column(1))
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for lo, hi in slices(offsets):
                w = Words(data, offsets, lo, hi)
                k, at, _ = anchors(w.hashes(), w.first)
                row = lo + np.searchsorted(w.first, at, "right") - 1
                ok = given[row]
                found.append((k[ok], ids[row[ok]]))
            if found:
                k, d = (np.concatenate(x) for x in zip(*found, strict=True))
                yield from _ask(k, np.zeros(len(k), np.uint32), d, True, n_names, n_docs)

    def candidates(group: pa.Table, flags: pa.Table) -> pa.Table:
        keys, docs_ = (np.frombuffer(b"".join(x.as_py() for x in flags.column(c)), dtype=t) for c, t in (("k", _U), ("d", np.int64)))
        ids, given = _ids(group.column("d").combine_chunks())
        data, offsets = buffers(group.column("t"))
        found = []
        for lo, hi in slices(offsets):
            w = Words(data, offsets, lo, hi)
            h = w.hashes()
            k, da, db = anchors(h, w.first)
            row = lo + np.searchsorted(w.first, da, "right") - 1
            alone = ~_members(keys, docs_, k, ids[row])
            edge = np.zeros(len(h) + 1, dtype=np.int32)
            np.add.at(edge, np.maximum(db[alone] - WINDOW, 0), 1)
            np.add.at(edge, da[alone] + 1, -1)
            clear = np.cumsum(edge[:-1]) == 0
            at, k1, k2 = window_keys(h, w.first)
            row = lo + np.searchsorted(w.first, at, "right") - 1
            ok = clear[at] & given[row]
            found.append((k1[ok], k2[ok], ids[row[ok]]))
        k1, k2, d = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, _U), np.zeros(0, np.uint32), np.zeros(0, np.int64))
        schema = pa.schema([("bucket", pa.int32()), ("asks", pa.bool_()), ("k", pa.binary()), ("k2", pa.binary()), ("d", pa.binary())])
        return pa.Table.from_batches(list(_ask(k1, k2, d, False, n_names, n_docs)), schema)

    def removal(group: pa.Table, gone: pa.Table) -> pa.Table:
        keys, docs_ = (np.frombuffer(b"".join(x.as_py() for x in gone.column(c)), dtype=t) for c, t in (("k", _U), ("d", np.int64)))
        column = group.column("d").combine_chunks()
        ids, given = _ids(column)
        data, offsets = buffers(group.column("t"))
        n_words, n_removed, digests, kept = [], [], [], []
        for lo, hi in slices(offsets):
            w = Words(data, offsets, lo, hi)
            h = w.hashes()
            at, k1, _ = window_keys(h, w.first)
            row = lo + np.searchsorted(w.first, at, "right") - 1
            hit = _members(keys, docs_, k1, ids[row]) & given[row]
            edge = np.zeros(len(h) + 1, dtype=np.int32)
            np.add.at(edge, at[hit], 1)
            np.add.at(edge, at[hit] + WINDOW, -1)
            stay = np.cumsum(edge[:-1]) == 0
            # The kept words with a space after each, cut by row.
            size = np.where(stay, w.end - w.start + 1, 0)
            total = np.concatenate([[0], np.cumsum(size)])
            spot = np.flatnonzero(stay)
            begin = total[:-1][spot]
            source = np.repeat(w.start[spot] - begin, size[spot]) + np.arange(int(total[-1]))
            joined = np.append(w.bytes, np.uint8(0))[np.minimum(source, len(w.bytes))]
            joined[total[1:][spot] - 1] = 0x20
            whole = joined.tobytes()
            left = np.concatenate([[0], np.cumsum(stay)])
            for i in range(hi - lo):
                f, t = w.first[i], w.first[i + 1]
                x = whole[total[f] : max(total[f], total[t] - 1)]
                n_words.append(int(t - f))
                n_removed.append(int(t - f - (left[t] - left[f])))
                digests.append(hashlib.sha256(x).hexdigest())
                kept.append(x.decode() if keep_text else None)
        return pa.table({"d": column, "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string()), "kept_text": pa.array(kept, pa.string())})

    bucket = F.coalesce(F.pmod(F.col("d"), F.lit(n_docs)), F.lit(0)).cast("int").alias("bucket")
    texts = docs.select(bucket, "d", "t").repartition(n_docs, "bucket")
    flags = docs.mapInArrow(first_round, ENTRIES).groupBy("bucket").applyInArrow(_answer(True, n_docs), "bucket int, k binary, d binary")
    asked = texts.groupBy("bucket").cogroup(flags.groupBy("bucket")).applyInArrow(candidates, ENTRIES)
    gone = asked.groupBy("bucket").applyInArrow(_answer(False, n_docs), "bucket int, k binary, d binary")
    out = texts.groupBy("bucket").cogroup(gone.groupBy("bucket")).applyInArrow(removal, "d long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    return out.select(F.col("d").alias(key), "n_words", "n_removed", "kept_sha256", *(["kept_text"] if keep_text else []))
