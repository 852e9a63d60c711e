"""SentencePiece encoding by a streaming Viterbi over a given vocabulary, and decoding.

The best segmentation maximises the sum of the pieces' scores. Characters arrive one at a time; live are only the starts from
which some piece may still be growing, at most as many as the longest piece has characters. Whenever the best paths to all
live positions share a prefix, its ids are committed and forgotten. A character without a piece becomes its bytes' pieces.

The vocabulary's file is a parameter; its scores are used as they stand. As in the library, a space is written U+2581 and one
is put before the text. A U+2581 of the text itself is written as bytes, so that decoding gives back every text exactly.
No piece of the vocabulary joins a character to a space after it (checked when it is read), so paths always meet before a
space: texts are cut there, and each different cut of a slice is encoded once. Characters of many cuts arrive side by side, with
the live starts of all of them in arrays; a cut beyond ``LONG`` bytes is streamed alone, its ids committed on the way.

Null and empty texts have no ids. Repeated rows are encoded alike. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from crossfile.llm.text import buffers, frugal, segment_hashes, slices

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
NEVER = float("-inf")
#: Cuts of more bytes are streamed alone.
LONG = 1024
#: About as many bytes of cuts are encoded side by side.
BESIDE = 1 << 17
#: Stands for a U+2581 of the text, which no piece holds.
NO_CHARACTER = 0x110000


def read_pieces(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, kind) of a SentencePiece model file."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    return [(p.piece, p.score, p.type) for p in model.pieces]


class Codec:
    def __init__(self, pieces: list[tuple[str, float, int]]):
        self.root: dict = {}  # character -> (further characters, id or -1, score)
        self.byte = [0] * 256
        table, scores, self.longest = [], {}, 1
        for i, (piece, score, kind) in enumerate(pieces):
            table.append(b"")
            if kind == BYTE:
                self.byte[int(piece[3:5], 16)] = i
                table[i] = bytes([int(piece[3:5], 16)])
            elif kind in (NORMAL, USER):
                if SPACE in piece.lstrip(SPACE):
                    raise ValueError(f"piece {piece!r} joins a character to a space after it")
                scores[piece] = (i, score)
                table[i] = piece.replace(SPACE, " ").encode()
                self.longest = max(self.longest, len(piece))
        edges, at = [], {"": 0}  # of the same tree, by number: (node, character), in the order of the nodes they lead to
        for piece in sorted(scores):
            kids = self.root
            for n, c in enumerate(piece, 1):
                if c not in kids:
                    kids[c] = ({}, *scores.get(piece[:n], (-1, 0.0)))
                    edges.append((at[piece[: n - 1]], ord(c)))
                    at[piece[:n]] = len(edges)
                kids = kids[c][0]
        self.unknown = min(x[1] for x in scores.values()) - 10.0
        self.sizes = np.array([len(x) for x in table], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(table), dtype=np.uint8)
        self.id_at = np.array([scores.get(p, (-1, 0.0))[0] for p in at], dtype=np.int32)
        self.gain_at = np.array([scores.get(p, (-1, 0.0))[1] for p in at], dtype=np.float64)
        self._tabulate(np.array(edges, dtype=np.int64).reshape(-1, 2))

    def _tabulate(self, edges: np.ndarray) -> None:
        """Where each edge of the tree leads, in a table by hashes that is at most an eighth full."""
        self.further = np.zeros(len(edges) + 1, dtype=bool)
        self.further[edges[:, 0]] = True
        self.first = np.full(NO_CHARACTER + 1, -1, dtype=np.int32)  # from the root
        top = edges[:, 0] == 0
        self.first[edges[top, 1]] = np.flatnonzero(top) + 1
        key, to = (edges[:, 0] << 21 | edges[:, 1])[~top], np.flatnonzero(~top) + 1
        self.bits = max(10, (8 * len(key)).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.leads = np.full(1 << self.bits, -1, dtype=np.int32)
        slot = self._slot(key)
        while len(key):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = key[free]
            placed = self.keys[slot] == key
            self.leads[slot[placed]] = to[placed]
            key, to, slot = key[~placed], to[~placed], (slot[~placed] + 1) & (len(self.keys) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def _grown(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The nodes that characters lead to from nodes below the root, or -1."""
        key = node.astype(np.int64) << 21 | char
        slot = self._slot(key)
        there = self.keys[slot]
        out = np.where(there == key, self.leads[slot], np.int32(-1))
        again = np.flatnonzero((there != key) & (there >= 0))
        while len(again):
            slot[again] = (slot[again] + 1) & (len(self.keys) - 1)
            there = self.keys[slot[again]]
            out[again] = np.where(there == key[again], self.leads[slot[again]], np.int32(-1))
            again = again[(there != key[again]) & (there >= 0)]
        return out

    def stream(self, chars: Iterable[str]) -> Iterator[list[int]]:
        """Ids, as they are committed. Ties go to the piece that starts first. Spaces are given as ' '."""
        best: dict[int, tuple[float, int, tuple[int, ...] | int]] = {0: (0.0, -1, ())}
        live: list[tuple[int, dict]] = []  # starts from which pieces may still grow, in order
        root, done, n, wide = self.root, 0, 0, 2 * self.longest
        for c in chars:
            score, back, ids, known = NEVER, -1, (), False
            if c == SPACE:
                live = []
            else:
                if c == " ":
                    c = SPACE
                live.append((n, root))
                grown = []
                for s, kids in live:
                    hit = kids.get(c)
                    if hit is not None:
                        further, i, gain = hit
                        if i >= 0:
                            known = known or s == n
                            gain += best[s][0]
                            if gain > score:
                                score, back, ids = gain, s, i
                        if further:
                            grown.append((s, further))
                live = grown
            if not known and best[n][0] + self.unknown > score:
                score, back, ids = best[n][0] + self.unknown, n, tuple(self.byte[b] for b in c.encode())
            n += 1
            best[n] = (score, back, ids)
            if not live or n - done > wide:
                heads = {s for s, _ in live}  # walk back from the last live position until all paths have met
                heads.add(n)
                while len(heads) > 1:
                    top = max(heads)
                    heads.discard(top)
                    heads.add(best[top][1])
                at = heads.pop()
                if at > done:
                    yield self._between(best, done, at)
                    best = {p: x for p, x in best.items() if p >= at} if at < n else {n: best[n]}
                    done = at
        if n > done:
            yield self._between(best, done, n)

    @staticmethod
    def _between(best: dict, done: int, at: int) -> list[int]:
        back: list[int] = []
        while at > done:
            _, at, ids = best[at]
            if isinstance(ids, int):
                back.append(ids)
            else:
                back += ids[::-1]
        return back[::-1]

    def encode(self, text: str) -> list[int]:
        return [i for ids in self.stream(" " + text if text else "") for i in ids]

    def decode(self, ids: Iterable[int]) -> str:
        out = b"".join(self.flat[self.starts[i] : self.starts[i] + self.sizes[i]].tobytes() for i in ids).decode(errors="replace")
        return out.removeprefix(" ")

    def side_by_side(self, cuts: bytes, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, their number by cut), the same as from ``stream``, of cuts that follow each other, of n characters each, longest first."""
        base = np.cumsum(n + 1) - (n + 1)  # a cut has a position before each character and one after the last
        total = int((n + 1).sum())
        first, inner = np.zeros(total, dtype=bool), np.ones(total, dtype=bool)
        first[base], inner[base + n] = True, False
        char = np.full(total, NO_CHARACTER, dtype=np.int64)  # after each position
        char[inner] = np.frombuffer(cuts.decode().encode("utf-32-le"), dtype=np.uint32)
        char[char == ord(SPACE)] = NO_CHARACTER
        char[char == 0x20] = ord(SPACE)
        best, back, piece = np.zeros(total), np.zeros(total, dtype=np.int64), np.full(total, -1, dtype=np.int32)
        cut = at = np.zeros(0, dtype=np.int64)  # live starts of all cuts, in order: whose, where, and what has grown from there
        node = np.zeros(0, dtype=np.int32)
        for step, k in enumerate((len(n) - np.searchsorted(n[::-1], np.arange(n[0]), "right")).tolist()):
            here = base[:k] + step
            c = char[here]
            on = cut < k
            cut, at, node = cut[on], at[on], node[on]
            new = self.first[c]
            node = np.concatenate([self._grown(node, c[cut]), new])
            on = node >= 0
            cut, at, node = np.concatenate([cut, np.arange(k)])[on], np.concatenate([at, here])[on], node[on]
            ids = self.id_at[node]
            hit = np.flatnonzero(ids >= 0)
            whose, gain = cut[hit], best[at[hit]] + self.gain_at[node[hit]]
            score, source, which = np.full(k, NEVER), here.copy(), np.full(k, -1, dtype=np.int32)
            np.maximum.at(score, whose, gain)
            top = hit[gain == score[whose]][::-1]  # of equal ones the first start is written last, and stays
            source[cut[top]], which[cut[top]] = at[top], ids[top]
            alone = best[here] + self.unknown
            odd = ((new < 0) | (self.id_at[new] < 0)) & (alone > score)
            score[odd], source[odd], which[odd] = alone[odd], here[odd], -1
            best[here + 1], back[here + 1], piece[here + 1] = score, source, which
            on = self.further[node]
            cut, at, node = cut[on], at[on], node[on]
        count = np.zeros(total, dtype=np.int64)  # ids that end at each position
        p = base + n
        while len(p):
            count[p] = 1
            p = back[p]
            p = p[~first[p]]
        p = np.flatnonzero(count)
        ids = piece[p]
        if (spelt := ids < 0).any():
            text = char[back[p[spelt]]]
            text[text == NO_CHARACTER] = ord(SPACE)
            raw = np.frombuffer(text.astype("<u4").tobytes().decode("utf-32-le").encode(), dtype=np.uint8)
            size = np.diff(np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw)))
            count[p[spelt]] = size
            ids = np.repeat(ids, count[p])
            ids[ids < 0] = np.array(self.byte, dtype=np.int32)[raw]
        return ids, np.add.reduceat(count, base)

    def _found(self, text: np.ndarray, start: np.ndarray, size: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, the first, their number by cut) of cuts of a text, of n characters each."""
        first, count = np.zeros(len(start), dtype=np.int64), np.zeros(len(start), dtype=np.int64)
        parts, done = [], 0
        for i in np.flatnonzero(size > LONG).tolist():
            ids = [x for part in self.stream(text[start[i] : start[i] + size[i]].tobytes().decode()) for x in part]
            parts.append(np.array(ids, dtype=np.int32))
            first[i], count[i] = done, len(ids)
            done += len(ids)
        few = np.flatnonzero(size <= LONG)
        few = few[np.argsort(-n[few], kind="stable")]
        upto = np.cumsum(size[few])
        lo = 0
        while lo < len(few):
            hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + BESIDE)))
            i = few[lo:hi]
            begin = np.cumsum(size[i]) - size[i]
            ids, count[i] = self.side_by_side(text[np.repeat(start[i] - begin, size[i]) + np.arange(int(size[i].sum()))].tobytes(), n[i])
            first[i] = done + np.cumsum(count[i]) - count[i]
            parts.append(ids)
            done += len(ids)
            lo = hi
        return np.concatenate(parts), first, count

    def encode_slice(self, data: np.ndarray, offsets: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, their number by row) of rows lo..hi."""
        rows = offsets[lo : hi + 1] - offsets[lo]
        size = np.diff(rows)
        full = np.flatnonzero(size > 0)
        text = np.insert(data[offsets[lo] : offsets[hi]], rows[full], 0x20)  # the space before each text that isn't empty
        if not len(text):
            return np.zeros(0, dtype=np.int32), np.zeros(hi - lo, dtype=np.int64)
        begin = rows[full] + np.arange(len(full))
        space = text == 0x20
        start = space.copy()
        start[1:] &= ~space[:-1]
        start[begin] = True
        start = np.flatnonzero(start)
        end = np.append(start[1:], len(text))
        _, some, which = np.unique(segment_hashes(text, start, end), return_index=True, return_inverse=True)
        n = np.add.reduceat((text & 0xC0) != 0x80, start, dtype=np.int64)
        flat, first, n = self._found(text, start[some], (end - start)[some], n[some])
        count = n[which]
        at = np.cumsum(count) - count
        ids = flat[np.repeat(first[which] - at, count) + np.arange(int(count.sum()))]
        total = np.concatenate([[0], np.cumsum(count)])
        bounds = np.append(np.searchsorted(start, begin), len(start))
        by_row = np.zeros(hi - lo, dtype=np.int64)
        by_row[full] = np.diff(total[bounds])
        return ids, by_row

    def decode_slice(self, ids: np.ndarray, by_row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(UTF-8 bytes, their number by row)."""
        size = self.sizes[ids]
        at = np.cumsum(size) - size
        out = self.flat[np.repeat(self.starts[ids] - at, size) + np.arange(int(size.sum()))]
        total = np.concatenate([[0], np.cumsum(size)])
        edge = total[np.concatenate([[0], np.cumsum(by_row)])]
        length = np.diff(edge)
        lead = edge[:-1][length > 0]
        return np.delete(out, lead[out[lead] == 0x20]), length - (length > 0)


@lru_cache(maxsize=2)
def codec(pieces: bytes) -> Codec:
    import pickle

    return Codec(pickle.loads(pieces))


def encode(docs: DataFrame, pieces: list[tuple[str, float, int]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key, ``ids``, their number, and whether decoding them gave back the text, of every row."""
    import pickle

    docs = docs.select(key, text)
    model = docs.sparkSession.sparkContext.broadcast(pickle.dumps(pieces))  # a vocabulary file's size, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model.value)
        for b in batches:
            data, offsets = buffers(b.column(1))
            for lo, hi in slices(offsets):
                ids, by_row = c.encode_slice(data, offsets, lo, hi)
                back, length = c.decode_slice(ids, by_row)
                size = np.diff(offsets[lo : hi + 1])
                same = length == size
                if same.all():
                    wrong = np.concatenate([[0], np.cumsum(back != data[offsets[lo] : offsets[hi]])])
                    at = offsets[lo : hi + 1] - offsets[lo]
                    same = wrong[at[1:]] == wrong[at[:-1]]
                else:
                    at = np.concatenate([[0], np.cumsum(length)])
                    same = np.array([s and bytes(back[at[i] : at[i + 1]]) == bytes(data[offsets[lo + i] : offsets[lo + i + 1]]) for i, s in enumerate(same)])
                edges = np.concatenate([[0], np.cumsum(by_row)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(edges), pa.array(ids)), pa.array(by_row), pa.array(same)], [key, "ids", "n_ids", "exact"])

    return docs.mapInArrow(frugal(run), f"`{key}` {docs.schema[0].dataType.simpleString()}, ids array<int>, n_ids long, exact boolean")
