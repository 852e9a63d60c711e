"""Near-duplicate vectors by hierarchical navigable small-world graphs, one per shard.

Equal vectors of a label are one class, known by a number of its own. A label's classes are dealt to ``SHARDS`` shards, which grow with the
label as long as one fits a task (``SHARD_BYTES`` of vectors), so that each vector is sent to and looked up in as many shards at any size. Each shard's graph is built
once and written to the shared folder; vectors that its pruning left without a way in get one. Every shard is searched for the
vectors of every shard of its label: a task holds two shards, looks each one's vectors up in the other's graph, and takes the union
of what both searches find. A search is a beam that then spreads along edges through everything above the threshold; many are run side by side.

A vector up to half the threshold's angle from one of its shard's graph is a member of that one's ball and not of the graph, as all members
of a ball link. Searches find balls that may hold links; balls so near that all their members link are counted by their sizes, so that a
tight group of near vectors takes work as its rows, not as its links; the others' members are compared in double precision.

Each search audits itself on links that are known: of ``AUDIT`` vectors of the shard, turned until their cosine with what they were
is the threshold, and of up to ``EXACT`` queries answered exactly, those with at most ``M`` links and those with more. While the
mean recall of any of the three, each query counting alike, is below ``RECALL``, the beam is doubled; a beam as wide as the shard
is an exact scan. The number of shards, the widest beam and the least recall audited come back with every row of their label.
Every pair found is verified by its cosine in double precision before it links. A task sends counts and a spanning forest of its
links, never all pairs of a group; components are then joined by stars.

Vectors that are null, zero, or hold null or non-finite components, and vectors without a label, are linked with nothing; vectors
of different lengths aren't compared. Of vectors with equal cosines none is preferred: all pairs at the threshold or above link. Repeated vectors link with each
other, also under one id; rows that share an id but hold different vectors have links of their own. A null id takes no part. Extra
columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossfile.llm.components import components, forest
from crossfile.llm.frames import cut

SHARDS, SHARD_LEAST, SHARD_BYTES = 4, 256, 64 << 20
M, BUILD_BEAM, BEAM, AUDIT, EXACT, RECALL = 12, 48, 16, 32, 256, 0.99
#: Vectors searched for side by side, pairs whose edges are followed at once, and radians by which balls have to be clear of the threshold.
BATCH, SPREAD, MARGIN = 256, 1 << 14, 1e-6


class Graph:
    """Levels of neighbour lists over unit vectors; the last level a vector is on comes from a hash of its place.

    With ``tight``, a vector at least that similar to one of the graph doesn't become a place of it, but a member of that one's ball;
    ``lead`` holds the place each vector is a member of, its own for most. Searches run side by side, in single precision; what they
    find is checked in double.
    """

    def __init__(self, x: np.ndarray, levels: list[dict[int, list[int]]] | None = None, lead: np.ndarray | None = None, tight: float | None = None):
        self.x = x
        self.levels: list[dict[int, list[int]]] = levels if levels is not None else []
        self.lead = np.arange(len(x)) if lead is None else lead
        self._x = x.astype(np.float32)
        self._met = np.empty(0, np.int32)
        if levels is None:
            rng = np.random.default_rng(len(x))
            self._build(np.minimum(np.floor(-np.log(1 - rng.random(len(x))) / np.log(M)), 6).astype(int), tight)
            self._mend()
        self.leaders = np.flatnonzero(self.lead == np.arange(len(x)))
        away = np.where(self.lead == np.arange(len(x)), 0, np.arccos(np.clip(np.einsum("ij,ij->i", x, x[self.lead]), -1, 1)) + MARGIN)
        self.wide = np.zeros(len(x))
        np.maximum.at(self.wide, self.lead, away)

    @property
    def block(self) -> int:
        """Queries that are searched side by side."""
        return max(16, min(BATCH, (1 << 24) // max(1, len(self.x))))

    def _links(self, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places of all lists of a level, where each place's list starts, how long it is)."""
        near = self.levels[level]
        keys = np.fromiter(near, np.int64, len(near))
        sizes, starts = np.zeros(len(self.x), np.int64), np.zeros(len(self.x), np.int64)
        sizes[keys] = np.fromiter(map(len, near.values()), np.int64, len(near))
        starts[keys] = np.cumsum(sizes[keys]) - sizes[keys]
        return np.fromiter((j for v in near.values() for j in v), np.int64, int(sizes.sum())), starts, sizes

    def _fresh(self, r: np.ndarray, j: np.ndarray, touched: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Those of the places j that row r hasn't met yet, each once."""
        at = r * len(self.x) + j
        new = np.flatnonzero(self._met[at] < 0)
        at = at[new]
        self._met[at] = np.arange(len(at), dtype=np.int32)
        once = self._met[at] == np.arange(len(at))
        touched.append(at)
        return r[new[once]], j[new[once]]

    def _dots(self, q: np.ndarray, r: np.ndarray, j: np.ndarray, x: np.ndarray) -> np.ndarray:
        step = max(1, (1 << 22) // x.shape[1])
        parts = [np.einsum("ij,ij->i", q[r[i : i + step]], x[j[i : i + step]]) for i in range(0, len(r), step)]
        return np.concatenate(parts) if parts else np.empty(0, x.dtype)

    def _walk(self, q: np.ndarray, enter: np.ndarray, width: int, links: tuple, take: int = 1, enough=None) -> tuple:
        """(similarities, places) of the best ``width`` vectors that a best-first search finds for each query, best first, -1 for none.

        q: single precision, ``block`` rows at most; enter: places for each, -1 for none. Each step follows the ``take`` best places
        of every search. enough: which pairs of a query and a place count as found; the search then spreads along edges through
        all of them, and they are returned besides, as rows and places.
        """
        flat, starts, sizes = links
        if len(self._met) < len(q) * len(self.x):
            self._met = np.full(self.block * len(self.x), -1, np.int32)
        sims, ids, todo = np.full((len(q), width), -np.inf, np.float32), np.full((len(q), width), -1, np.int64), np.zeros((len(q), width), bool)
        touched: list[np.ndarray] = []
        hits: list[tuple[np.ndarray, np.ndarray]] = []

        def meet(r: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            r, j = self._fresh(r, j, touched)
            s = self._dots(q, r, j, self._x)
            if enough is not None:
                ok = enough(s, r, j)
                hits.append((r[ok], j[ok]))
            return r, j, s

        def beyond(r: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            n = sizes[j]
            return np.repeat(r, n), flat[np.repeat(starts[j] - np.cumsum(n) + n, n) + np.arange(n.sum())]

        r, c = np.nonzero(enter >= 0)
        r, j, s = meet(r, enter[r, c])
        while True:
            if len(r):
                n = np.bincount(r, minlength=len(q))
                rows = np.flatnonzero(n)
                column = np.arange(len(r)) - np.repeat((np.cumsum(n) - n)[rows], n[rows])
                row = np.repeat(np.arange(len(rows)), n[rows])
                more = np.full((len(rows), int(n.max())), -np.inf, np.float32)
                places = np.full(more.shape, -1, np.int64)
                more[row, column], places[row, column] = s, j
                more = np.concatenate([sims[rows], more], axis=1)
                best = np.argsort(-more, axis=1)[:, :width]
                sims[rows] = np.take_along_axis(more, best, axis=1)
                ids[rows] = np.take_along_axis(np.concatenate([ids[rows], places], axis=1), best, axis=1)
                todo[rows] = np.take_along_axis(np.concatenate([todo[rows], places >= 0], axis=1), best, axis=1)
            live = np.flatnonzero(todo.any(axis=1))
            if not len(live):
                break
            now = todo[live]
            now &= np.cumsum(now, axis=1) <= take
            todo[live] &= ~now
            row, column = np.nonzero(now)
            r, j, s = meet(*beyond(live[row], ids[live[row], column]))
        at = 0
        while at < len(hits):
            r, j = hits[at]
            at += 1
            for i in range(0, len(r), SPREAD):
                meet(*beyond(r[i : i + SPREAD], j[i : i + SPREAD]))
        for t in touched:
            self._met[t] = -1
        if enough is None:
            return sims, ids
        return sims, ids, np.concatenate([h[0] for h in hits]), np.concatenate([h[1] for h in hits])

    def _build(self, tops: np.ndarray, tight: float | None) -> None:
        """Vectors come in batches, as many as there are already: each looks for its neighbours in the graph and among the earlier of its batch."""
        lists: list[tuple[np.ndarray, np.ndarray]] = []
        start, at = -1, 0
        while at < len(self.x):
            part = np.arange(at, min(len(self.x), at + min(max(at, AUDIT), self.block)))
            at += len(part)
            q = self._x[part]
            enter = np.full((len(part), BUILD_BEAM), -1, np.int64)
            enter[:, 0] = start
            found = []
            for level in range(len(lists) - 1, -1, -1):
                near, size = lists[level]
                links = near.ravel(), np.arange(len(near)) * near.shape[1], size
                sims = np.full(enter.shape, -np.inf, np.float32)
                for rows, width in ((np.flatnonzero(tops[part] < level), 1), (np.flatnonzero(tops[part] >= level), BUILD_BEAM)):
                    if len(rows):
                        sims[rows, :width], places = self._walk(q[rows], enter[rows], width, links, 1 if width == 1 else 4)
                        enter[rows] = -1
                        enter[rows, :width] = places
                found.insert(0, (sims, enter.copy()))
            mates = q @ q.T
            mates[np.triu_indices(len(part))] = -np.inf
            if tight is not None:
                if found:
                    best = found[0][1][:, 0]
                    in_ball = np.einsum("ij,ij->i", self.x[part], self.x[best]) >= tight
                    self.lead[part[in_ball]] = best[in_ball]
                for i in np.flatnonzero((mates >= tight - 1e-5).any(axis=1)).tolist():
                    near = np.flatnonzero(mates[i] >= tight - 1e-5)
                    near = near[self.lead[part[near]] == part[near]]
                    near = near[self.x[part[near]] @ self.x[part[i]] >= tight]
                    if self.lead[part[i]] == part[i] and len(near):
                        self.lead[part[i]] = part[near[0]]
            alone = self.lead[part] == part
            for level in range(int(tops[part][alone].max(initial=-1)) + 1):
                rows = np.flatnonzero(alone & (tops[part] >= level))
                sims, places = mates[np.ix_(rows, rows)], np.broadcast_to(part[rows], (len(rows), len(rows)))
                if level < len(found):
                    sims, places = np.concatenate([found[level][0][rows], sims], axis=1), np.concatenate([found[level][1][rows], places], axis=1)
                else:
                    lists.append((np.full((len(self.x), 2 * M if level == 0 else M), -1, np.int32), np.zeros(len(self.x), np.int64)))
                    start = int(part[rows[0]])
                self._join(*lists[level], part[rows], sims, places)
        members = [np.flatnonzero((self.lead == np.arange(len(self.x))) & (tops >= level)).tolist() for level in range(len(lists))]
        self.levels = [{i: near[i, : size[i]].tolist() for i in m} for m, (near, size) in zip(members, lists, strict=True)]

    def _join(self, near: np.ndarray, size: np.ndarray, new: np.ndarray, sims: np.ndarray, places: np.ndarray) -> None:
        """New places get lists out of what was found for them, and come into the lists of those."""
        chosen = self._spread(sims, places, BUILD_BEAM, M)
        size[new] = (chosen >= 0).sum(axis=1)
        near[new, : chosen.shape[1]] = chosen
        row, column = np.nonzero(chosen >= 0)
        there = chosen[row, column]
        order = np.argsort(there, kind="stable")
        there, back = there[order], new[row[order]]
        ends, first, n = np.unique(there, return_index=True, return_counts=True)
        if not len(ends):
            return
        lists = np.full((len(ends), near.shape[1] + int(n.max())), -1, np.int64)
        lists[:, : near.shape[1]] = near[ends]
        end = np.repeat(np.arange(len(ends)), n)
        lists[end, size[there] + np.arange(len(there)) - first[end]] = back
        size[ends] += n
        full = size[ends] > near.shape[1]
        near[ends[~full]] = lists[~full, : near.shape[1]]
        if full.any():
            ends, lists = ends[full], lists[full]
            sims = np.full(lists.shape, -np.inf, np.float32)
            r, c = np.nonzero(lists >= 0)
            sims[r, c] = self._dots(self._x, ends[r], lists[r, c], self._x)
            near[ends] = self._spread(sims, lists, 4 * M, near.shape[1])
            size[ends] = near.shape[1]

    def _mend(self) -> None:
        """Every vector can be reached on the lowest level from where searches start: one that can't gets an edge from the nearest that can."""
        if not self.levels:
            return
        near, start = self.levels[0], next(iter(self.levels[-1]))
        met: set[int] = set()

        def reach(i: int) -> None:
            todo = {i}
            while todo:
                met.update(todo)
                todo = {j for k in todo for j in near[k]} - met

        reach(start)
        lost = [i for i in near if i not in met]
        links = self._links(0) if lost else ()
        for at in range(0, len(lost), self.block):
            part = lost[at : at + self.block]
            _, found = self._walk(self._x[part], np.full((len(part), 1), start), BUILD_BEAM, links)
            for i, j in zip(part, found[:, 0].tolist(), strict=True):
                if i not in met:
                    near[j].append(i)
                    near[i].append(j)
                    reach(i)

    def _spread(self, sims: np.ndarray, places: np.ndarray, best: int, most: int) -> np.ndarray:
        """Of the ``best`` of each row, up to ``most``: first those nearer to the row's vector than to one another, then the nearest of the rest."""
        order = np.argsort(-sims, axis=1)[:, :best]
        sims, places = np.take_along_axis(sims, order, axis=1), np.take_along_axis(places, order, axis=1)
        out = np.full((len(sims), min(most, sims.shape[1])), -1, np.int64)
        step = max(1, (1 << 22) // (sims.shape[1] * max(sims.shape[1], self.x.shape[1])))
        for at in range(0, len(sims), step):
            s, there = sims[at : at + step], places[at : at + step]
            x = self._x[there]
            between = x @ x.transpose(0, 2, 1)
            taken = np.zeros(s.shape, bool)
            count = np.zeros(len(s), int)
            for k in range(s.shape[1]):
                far = np.where(taken[:, :k], between[:, k, :k], -np.inf).max(axis=1, initial=-np.inf)
                taken[:, k] = (s[:, k] > -np.inf) & (far < s[:, k]) & (count < most)
                count += taken[:, k]
            rank = np.argsort(np.where(s > -np.inf, 1 - taken, 2), axis=1, kind="stable")[:, :most]
            out[at : at + step] = np.where(np.take_along_axis(s, rank, axis=1) > -np.inf, np.take_along_axis(there, rank, axis=1), -1)
        return out

    def floor(self, least: float, wide: np.ndarray, other: np.ndarray) -> np.ndarray:
        """The least similarity of two leaders whose balls reach so far that hold vectors with one of ``least``."""
        both = wide + other
        return np.where(both > 0, np.cos(np.minimum(np.pi, np.arccos(least) + both + MARGIN)), least)

    def above(self, q: np.ndarray, least: float, width: int, wide: np.ndarray | None = None) -> list[np.ndarray]:
        """For each query, leaders with a similarity of at least ``least``; wide: how far the queries' own balls reach."""
        wide = np.zeros(len(q)) if wide is None else wide
        out: list[np.ndarray] = []
        exact = width >= len(self.leaders)
        links = [] if exact else [self._links(level) for level in range(len(self.levels))]
        for at in range(0, len(q), self.block):
            part, reach = q[at : at + self.block], wide[at : at + self.block]
            if exact:
                out += [self.leaders[row] for row in part @ self.x[self.leaders].T >= self.floor(least, reach[:, None], self.wide[self.leaders])]
                continue
            single = part.astype(np.float32)
            enter = np.full((len(part), 1), next(iter(self.levels[-1])))
            for level in range(len(links) - 1, 0, -1):
                _, enter = self._walk(single, enter, 1, links[level])
            enough = lambda s, r, j, reach=reach: s >= self.floor(least, reach[r], self.wide[j]) - 1e-5
            _, _, r, j = self._walk(single, enter, width, links[0], 4, enough)
            ok = self._dots(part, r, j, self.x) >= self.floor(least, reach[r], self.wide[j])
            r, j = r[ok], j[ok]
            order = np.argsort(r, kind="stable")
            out += np.split(j[order], np.cumsum(np.bincount(r, minlength=len(part)))[:-1])
        return out

    def pack(self) -> bytes:
        out = [np.array([len(self.levels)], np.int32)]
        for level in self.levels:
            keys = np.array(list(level), np.int32)
            sizes = np.array([len(v) for v in level.values()], np.int32)
            out += [np.array([len(keys)], np.int32), keys, sizes, np.array([j for v in level.values() for j in v], np.int32)]
        return b"".join(x.tobytes() for x in out)

    @classmethod
    def unpack(cls, x: np.ndarray, packed: bytes, lead: np.ndarray | None = None) -> Graph:
        flat = np.frombuffer(packed, np.int32)
        levels, at = [], 1
        for _ in range(int(flat[0])):
            n = int(flat[at])
            keys, sizes = flat[at + 1 : at + 1 + n].tolist(), flat[at + 1 + n : at + 1 + 2 * n]
            at += 1 + 2 * n
            ends, lists = np.cumsum(sizes).tolist(), flat[at : at + int(sizes.sum())].tolist()
            levels.append({k: lists[e - z : e] for k, z, e in zip(keys, sizes.tolist(), ends, strict=True)})
            at += len(lists)
        return cls(x, levels, lead)


def planted(x: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(queries, place of each one's link): vectors of x, turned towards a random direction to a cosine of ``least`` and a little."""
    rng = np.random.default_rng(x.shape[0])
    at = rng.permutation(len(x))[:AUDIT]
    away = rng.standard_normal((len(at), x.shape[1]))
    away -= np.einsum("ij,ij->i", away, x[at])[:, None] * x[at]
    length = np.linalg.norm(away, axis=1, keepdims=True)
    cosine = np.where(length > 1e-9, min(1.0, least + 1e-6), 1.0)
    return cosine * x[at] + np.sqrt(1 - cosine**2) * away / np.maximum(length, 1e-9), at


def search(graph: Graph, queries: np.ndarray, least: float, same: bool = False, wide: np.ndarray | None = None) -> tuple[list[np.ndarray], int, float]:
    """(leaders above ``least`` for each query, beam, least recall audited): beams widen until the audit passes. same: the queries are
    the graph's own leaders, in order, and a vector found by itself doesn't count. wide: how far the queries' own balls reach."""
    wide = np.zeros(len(queries)) if wide is None else wide
    order = np.random.default_rng(len(queries)).permutation(len(queries))
    leaders = graph.leaders
    x = graph.x if len(leaders) == len(graph.x) else graph.x[leaders]
    true: dict[int, np.ndarray] = {}
    links: dict[int, set[int]] = {}
    few: list[int] = []
    many: list[int] = []
    for at in range(0, min(EXACT, len(order)), AUDIT):
        part = order[at : at + AUDIT]
        for i, row in zip(part.tolist(), queries[part] @ x.T >= graph.floor(least, wide[part][:, None], graph.wide[leaders]), strict=True):
            true[i] = leaders[row]
            if found := set(true[i].tolist()) - ({int(leaders[i])} if same else set()):
                links[i] = found
                (few if len(found) <= M else many).append(i)
        if len(few) >= AUDIT:
            break
    turned, at = planted(x, least)
    samples = [([{int(k)} for k in leaders[at]], turned, np.zeros(len(at)))]
    samples += [([links[i] for i in part[:AUDIT]], queries[part[:AUDIT]], wide[part[:AUDIT]]) for part in (few, many) if part]

    def recall(width: int) -> float:
        return min(float(np.mean([len(t.intersection(f.tolist())) / len(t) for t, f in zip(t, graph.above(q, least, width, w), strict=True)])) for t, q, w in samples)

    width = BEAM
    while width < len(leaders) and (found := recall(width)) < RECALL:
        width *= 2
    if width >= len(leaders):
        found = 1.0
    rest = np.array([i for i in range(len(queries)) if i not in true], int)
    true.update(zip(rest.tolist(), graph.above(queries[rest], least, width, wide[rest]), strict=True))
    return [true[i] for i in range(len(queries))], width, found


def counted(one: Graph, two: Graph, size: np.ndarray, size2: np.ndarray, a: np.ndarray, b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """(links of each vector of ``one``, of ``two``, edges) that balls with the leaders a and b have with each other.

    Balls so near that all of their members link are counted by their sizes, and others, unless they hold one vector each, member by member.
    """
    reach = one.wide[a] + two.wide[b]
    total, total2 = np.bincount(one.lead, size, len(size)), np.bincount(two.lead, size2, len(size2))
    n, n2 = np.bincount(one.lead, minlength=len(size)), np.bincount(two.lead, minlength=len(size2))
    s = one._dots(one.x, a, b, two.x)
    lone = (n[a] == 1) & (n2[b] == 1)
    whole = np.where(lone, s >= least, np.arccos(np.clip(s, -1, 1)) + reach <= np.arccos(least) - MARGIN)
    links, links2 = np.bincount(a[whole], total2[b[whole]], len(size))[one.lead], np.bincount(b[whole], total[a[whole]], len(size2))[two.lead]
    edges = list(zip(a[whole].tolist(), b[whole].tolist(), strict=True))
    rest = ~whole & ~lone
    if rest.any():
        by, by2 = np.argsort(one.lead, kind="stable"), np.argsort(two.lead, kind="stable")
        to, to2 = np.cumsum(n), np.cumsum(n2)
        for p, q in zip(a[rest].tolist(), b[rest].tolist(), strict=True):
            j = by2[to2[q] - n2[q] : to2[q]]
            step = max(1, (1 << 22) // len(j))
            for at in range(to[p] - n[p], to[p], step):
                i = by[at : min(at + step, to[p])]
                hit = one.x[i] @ two.x[j].T >= least
                links[i] += hit @ size2[j]
                links2[j] += size[i] @ hit
                if hit.any():
                    r, c = np.unravel_index(hit.argmax(), hit.shape)
                    edges.append((int(i[r]), int(j[c])))
    return links.astype(np.int64), links2.astype(np.int64), edges


def _vectors(blob: pa.Scalar, dim: int) -> np.ndarray:
    x = np.frombuffer(blob.as_py(), np.float64).reshape(-1, dim)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def near_duplicates(rows: DataFrame, least: float = 0.93, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """n_links, component_id and kept of every row, and what was audited of its label: shards, beam, recall."""
    rows = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.col(label).alias("label"))
    finite = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("v", lambda e: e != 0)
    fit = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.coalesce(finite, F.lit(False))
    classes = rows.where(fit).groupBy("label", "v").agg(F.min("id").alias("least_id"), F.count(F.lit(1)).alias("size"))
    classes = cut(classes.withColumn("rep", F.monotonically_increasing_id()))
    counts = classes.groupBy("label", F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    most = F.greatest(F.floor(SHARD_BYTES / (8 * F.col("dim"))), F.lit(1))
    dealt = classes.withColumn("dim", F.size("v")).join(counts, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("rep"), F.ceil(F.col("n") / F.least(F.greatest(F.ceil(F.col("n") / SHARDS), F.lit(SHARD_LEAST)), most))).cast("int"))

    # Of vectors up to half the threshold's angle from one, each two link.
    angle = float(np.arccos(np.clip(least, -1, 1)))
    tight = float(np.cos(0.499 * angle)) if angle > 1e-3 else None

    def build(group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("rep").to_numpy(), kind="stable")
        group = group.take(pa.array(order))
        dim = group.column("dim")[0].as_py()
        raw = np.concatenate([np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64) for v in group.column("v")])
        x = raw.reshape(-1, dim)
        x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares of very large or small components stay finite
        graph = Graph(x / np.linalg.norm(x, axis=1, keepdims=True), tight=tight)
        return pa.table({"label": group.column("label").slice(0, 1), "dim": pa.array([dim], pa.int32()), "shard": group.column("shard").slice(0, 1), "x": pa.array([x.tobytes()], pa.binary()), "g": pa.array([graph.pack()], pa.binary()), "lead": pa.array([graph.lead.tobytes()], pa.binary()), "rep": pa.array([group.column("rep").to_numpy().tobytes()], pa.binary()), "size": pa.array([group.column("size").to_numpy().tobytes()], pa.binary())})

    kind = dict(rows.dtypes)["label"]
    graphs = cut(dealt.select("label", "dim", "shard", "rep", "size", "v").groupBy("label", "dim", "shard").applyInArrow(build, f"label {kind}, dim int, shard int, x binary, g binary, lead binary, rep binary, size binary"))
    other = graphs.select("label", "dim", *[F.col(c).alias(f"{c}2") for c in ("shard", "x", "g", "lead", "rep", "size")])
    # Pairs of shards are made of their numbers alone; graphs come to each by its own, so no label is in one task.
    pairs = graphs.select("label", "dim", "shard").join(graphs.select("label", "dim", F.col("shard").alias("shard2")), ["label", "dim"]).where("shard <= shard2")
    both = pairs.join(graphs, ["label", "dim", "shard"]).join(other, ["label", "dim", "shard2"])

    def meet(group: pa.Table) -> pa.Table:
        links: dict[int, int] = {}
        edges: list[tuple[int, int]] = []
        beam, least_recall = 0, 1.0
        for i in range(group.num_rows):
            row = {c: group.column(c)[i] for c in group.column_names}
            dim, same = row["dim"].as_py(), row["shard"].as_py() == row["shard2"].as_py()
            one, two = (Graph.unpack(_vectors(row[f"x{k}"], dim), row[f"g{k}"].as_py(), np.frombuffer(row[f"lead{k}"].as_py(), np.int64)) for k in ("", "2"))
            ids, ids2 = (np.frombuffer(row[c].as_py(), np.int64) for c in ("rep", "rep2"))
            size, size2 = (np.frombuffer(row[c].as_py(), np.int64) for c in ("size", "size2"))
            pairs = []
            for at, by in ((one, two),) if same else ((one, two), (two, one)):
                hits, width, audited = search(at, by.x[by.leaders], least - 1e-9, same, by.wide[by.leaders])
                p, q = np.concatenate(hits), np.repeat(by.leaders, [len(h) for h in hits])
                pairs.append((p, q) if at is one and not same else (q, p) if not same else (np.minimum(p, q), np.maximum(p, q)))
                beam, least_recall = max(beam, width), min(least_recall, audited)
            code = np.unique(np.concatenate([a * len(two.x) + b for a, b in pairs]))
            a, b = np.divmod(code, len(two.x))
            if same:
                a, b = a[a != b], b[a != b]
            n, n2, near = counted(one, two, size, size2, a, b, least)
            edges += [(int(ids[p]), int(ids2[q])) for p, q in near]
            if same:
                n += np.bincount(one.lead, size, len(size))[one.lead].astype(np.int64) - size
                inner = np.flatnonzero(one.lead != np.arange(len(one.lead)))
                edges += zip(ids[inner].tolist(), ids[one.lead[inner]].tolist(), strict=True)
            for v, k in (*zip(ids[n > 0].tolist(), n[n > 0].tolist(), strict=True), *zip(ids2[n2 > 0].tolist(), n2[n2 > 0].tolist(), strict=True)):
                links[v] = links.get(v, 0) + k
        kept = forest(edges)
        a = [*links, *(u for u, _ in kept), None]
        b = [*([None] * len(links)), *(v for _, v in kept), None]
        rest = [None] * (len(a) - 1)
        audit = {"label": pa.array([*rest, group.column("label")[0].as_py()], group.schema.field("label").type), "shard": pa.array([*rest, group.column("shard")[0].as_py()], pa.int32()), "recall": pa.array([*rest, least_recall], pa.float64())}
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array([*links.values(), *([0] * len(kept)), beam], pa.int64())} | audit)

    found = cut(both.groupBy("label", "dim", "shard", "shard2").applyInArrow(meet, f"a long, b long, n long, label {kind}, shard int, recall double"))
    audits = found.where("recall is not null").groupBy(F.col("label").alias("l")).agg(F.count_distinct("shard").alias("shards"), F.max("n").alias("beam"), F.min("recall").alias("recall"))
    links = found.where("a is not null and b is null").groupBy("a").agg(F.sum("n").alias("n"))
    of = components(found.where("b is not null").select(F.col("a").alias("u"), F.col("b").alias("v")))
    known = cut(classes.join(links, F.col("a") == F.col("rep"), "left").join(of, F.col("u") == F.col("rep"), "left").select("label", "v", "least_id", (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component")))
    known = known.join(known.groupBy("component").agg(F.min("least_id").alias("component_id")), "component").drop("component", "least_id")
    known = known.withColumnRenamed("label", "l").withColumnRenamed("v", "w").join(audits, "l", "left")
    out = rows.join(known, fit & (F.col("label") == F.col("l")) & (F.col("v") == F.col("w")), "left")
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"), "shards", "beam", "recall").withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))
