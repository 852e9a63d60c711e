"""Graph queries over an edge table (src, dst): distances, strong and weak components, layers, longest and greedy chains.

Each is a loop of joins and aggregates whose state is cut every round; nothing but row counts reaches the driver.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crossfile.operators.lineage import cut, drop

#: Graphs of at most this many edges (a few MB) are taken by one task, as each round of a loop costs more than that; the rounds of
#: larger ones are distributed. Both give the same rows.
ONE_TASK = 200_000


def _simple(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").where("src <> dst").distinct()


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def shortest_paths(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node, path): for every node reachable from a seed the shortest path, the least of them by its nodes in order."""
    edges = cut(_simple(edges))
    front = cut(seeds.select("node").distinct().select("node", F.array("node").alias("path")))
    found = front
    while True:
        step = front.join(edges, front.node == edges.src).select(F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        new = cut(step.groupBy("node").agg(F.min("path").alias("path")).join(found.select("node"), "node", "left_anti"))
        if new.isEmpty():
            return found
        wider = cut(found.union(new))
        drop(front, found)
        front, found = new, wider


def flow(edges: DataFrame, stops: list) -> DataFrame:
    """One row: the path through all stops, each leg a shortest one; no row if some stop can't be reached."""
    spark, out = edges.sparkSession, None
    kind = edges.schema["src"].dataType.simpleString()
    for a, b in zip(stops, stops[1:], strict=False):
        leg = shortest_paths(edges, spark.createDataFrame([(a,)], f"node {kind}")).where(F.col("node") == F.lit(b)).select("path")
        out = leg if out is None else out.crossJoin(F.broadcast(leg.withColumnRenamed("path", "leg"))).select(F.concat("path", F.expr("slice(leg, 2, size(leg))")).alias("path"))  # one row each
    return out


def reaching(edges: DataFrame, target: DataFrame, doors: DataFrame) -> DataFrame:
    """(door, hops, path): the doors that reach the target, with the chain whose reading from the target is least."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    found = shortest_paths(back, target).join(doors.select(F.col("node")), "node", "left_semi")
    return found.select(F.col("node").alias("door"), (F.size("path") - 1).alias("hops"), F.reverse("path").alias("path"))


def _in_one_task(edges: DataFrame, most: int) -> bool:
    """Whether the edges are few enough, which is counted, never guessed."""
    return edges.limit(most + 1).count() <= most


def _rings(kids: dict) -> dict:
    """node -> least node of its strong component, by depth-first search with an explicit stack."""
    order, low, at, open_, path, out = {}, {}, {}, [], [], {}
    for start in sorted(kids):
        if start in order:
            continue
        path.append((start, iter(kids[start])))
        while path:
            node, rest = path[-1]
            if node not in order:
                order[node] = low[node] = len(order)
                at[node] = len(open_)
                open_.append(node)
            for k in rest:
                if k not in order:
                    path.append((k, iter(kids.get(k, ()))))
                    break
                if k not in out:
                    low[node] = min(low[node], order[k])
            else:
                path.pop()
                if path:
                    low[path[-1][0]] = min(low[path[-1][0]], low[node])
                if low[node] == order[node]:
                    ring, open_[at[node] :] = open_[at[node] :], []
                    out |= dict.fromkeys(ring, min(ring))
    return out


def _kids(src: list, dst: list) -> dict:
    kids: dict = {}
    for a, b in zip(src, dst, strict=True):
        kids.setdefault(a, []).append(b)
        kids.setdefault(b, [])
    return kids


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges without those that no ring can hold: nodes without a way in or a way out go, round by round while many do."""
    left = edges
    n = left.count()
    while n:
        after = cut(left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        m = after.count()
        if left is not edges:
            drop(left)
        left, n, small = after, m, n - m <= n // 20
        if small:
            break
    return left


def _coloured(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes on rings: each round names, by the least node that reaches it, every node of which that node
    can be reached within the colour."""
    left, out = _trimmed(edges), None
    while not left.isEmpty():
        held = colour = cut(vertices(left).select("node", F.col("node").alias("c")))
        while True:  # the least vertex that reaches each
            better = left.join(colour, left.src == colour.node).groupBy("dst").agg(F.min("c").alias("m"))
            after = cut(colour.join(better, colour.node == better.dst, "left").select("node", "c", F.least("c", F.coalesce("m", "c")).alias("d")))
            changed = not after.where("c <> d").isEmpty()
            drop(held)
            held, colour = after, after.select("node", F.col("d").alias("c"))
            if not changed:
                break
        inside = cut(colour.where("node = c"))
        front = inside
        ends = left.join(colour.select(F.col("node").alias("src"), F.col("c").alias("cs")), "src")
        while not front.isEmpty():  # and that each reaches within its colour
            new = cut(ends.join(front.select(F.col("node").alias("dst"), "c"), "dst").where("cs = c").select(F.col("src").alias("node"), "c").distinct().join(inside, ["node", "c"], "left_anti"))
            wider = cut(inside.union(new))
            drop(front, inside)
            front, inside = new, wider
        out = inside if out is None else out.union(inside)
        gone = inside.select("node")
        left = _trimmed(cut(left.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti")))
    return out.select("node", F.col("c").alias("component")) if out is not None else edges.select(F.col("src").alias("node"), F.col("dst").alias("component")).limit(0)


def strong_components(edges: DataFrame, one_task: int | None = None) -> DataFrame:
    """(node, component): the least node of each node's strong component, for components of two nodes or more."""
    edges = cut(_simple(edges))
    if _in_one_task(edges, ONE_TASK if one_task is None else one_task):
        kind = edges.schema["src"].dataType.simpleString()

        def find(group: pa.Table) -> pa.Table:
            ring = _rings(_kids(group.column("src").to_pylist(), group.column("dst").to_pylist()))
            return pa.table({"node": pa.array([*ring], group.schema.field("src").type), "component": pa.array([*ring.values()], group.schema.field("src").type)})

        found = edges.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(find, f"node {kind}, component {kind}")
    else:
        found = _coloured(edges)
    found = cut(found)
    return found.join(found.groupBy("component").count().where("count > 1").select("component"), "component", "left_semi").select("node", "component")


def components(edges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, node, component): the least node of each node's undirected component, separately for every value of the keys."""
    keys = keys or []
    ways = F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("w")
    both = cut(edges.select(*keys, ways).select(*keys, "w.*"))  # an edge that stands twice changes nothing
    held = label = cut(both.groupBy(*keys, "src").agg(F.min("dst").alias("m")).select(*keys, F.col("src").alias("node"), F.least("src", "m").alias("component")))
    while True:
        around = both.join(label.withColumnRenamed("node", "dst"), [*keys, "dst"]).groupBy(*keys, "src").agg(F.min("component").alias("m")).withColumnRenamed("src", "node")
        step = label.join(around, [*keys, "node"]).select(*keys, "node", F.col("component").alias("old"), F.least("component", "m").alias("component"))
        hop = step.select(*keys, F.col("node").alias("component"), F.col("component").alias("root"))  # the label's own label
        after = cut(step.join(hop, [*keys, "component"], "left").select(*keys, "node", "old", F.least("component", F.coalesce("root", "component")).alias("component")))
        drop(held)
        held, label = after, after.select(*keys, "node", "component")
        if after.where("old <> component").isEmpty():
            return label


def _together(src: list, dst: list) -> dict:
    """node -> least node of its undirected component."""
    over: dict = {}

    def top(n):
        while over.setdefault(n, n) != n:
            over[n] = n = over[over[n]]
        return n

    for a, b in zip(src, dst, strict=True):
        a, b = top(a), top(b)
        over[max(a, b)] = min(a, b)
    return {n: top(n) for n in over}


def pieces(edges: DataFrame, one_task: int | None = None) -> DataFrame:
    """(node, component): the rows of ``components`` without keys, those of a small graph by one task."""
    edges = cut(edges.select("src", "dst"))
    if not _in_one_task(edges, ONE_TASK if one_task is None else one_task):
        return components(edges)
    kind = edges.schema["src"].dataType.simpleString()

    def find(group: pa.Table) -> pa.Table:
        like, found = group.schema.field("src").type, _together(group.column("src").to_pylist(), group.column("dst").to_pylist())
        return pa.table({"node": pa.array([*found], like), "component": pa.array([*found.values()], like)})

    return edges.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(find, f"node {kind}, component {kind}")


def layers(edges: DataFrame, one_task: int | None = None) -> DataFrame:
    """(node, layer): 0 for nodes that point nowhere, else one above the highest node pointed to.

    Nodes of a strong component share a layer: the component is condensed first, so the result doesn't depend on an order.
    """
    edges = cut(_simple(edges))
    ring = cut(strong_components(edges, one_task))
    name = ring.select(F.col("node").alias("src"), F.col("component").alias("a"))
    name2 = ring.select(F.col("node").alias("dst"), F.col("component").alias("b"))
    folded = cut(edges.join(name, "src", "left").join(name2, "dst", "left").select(F.coalesce("a", "src").alias("src"), F.coalesce("b", "dst").alias("dst")).where("src <> dst").distinct())
    nodes = vertices(edges).join(ring, "node", "left").select("node", F.coalesce("component", "node").alias("group"))
    held = level = cut(nodes.select(F.col("group").alias("node")).distinct().withColumn("layer", F.lit(0)))
    while True:
        above = folded.join(level.withColumnRenamed("node", "dst"), "dst").groupBy("src").agg((F.max("layer") + 1).alias("m")).withColumnRenamed("src", "node")
        after = cut(level.join(above, "node", "left").select("node", F.col("layer").alias("old"), F.greatest("layer", F.coalesce("m", F.lit(0))).alias("layer")))
        drop(held)
        held, level = after, after.select("node", "layer")
        if after.where("old <> layer").isEmpty():
            return nodes.join(level.withColumnRenamed("node", "group"), "group").select("node", "layer")


def _longest_from(start, ring: set, kids: dict, best: dict) -> list:
    """The longest simple path from ``start``, the least of them, that stays in its ring, then leaves it for good by a node's best.

    A ring once left is never met again, so what follows is known. Within it paths are tried in order, as long as they could still
    become longer than the longest so far: by as many nodes as can be reached, and by the best that leaves any of them.
    """
    away = {n: max((len(best[k]) for k in kids[n] if k not in ring), default=0) for n in ring}
    found, path, on = [start], [start], {start}
    stack = [iter(sorted(kids[start]))]

    def most() -> int:
        met, todo = set(), [path[-1]]
        while todo:
            more = [k for k in kids[todo.pop()] if k in ring and k not in on and k not in met]
            met.update(more)
            todo += more
        return len(path) + len(met) + max(away[n] for n in (*met, path[-1]))

    while stack:
        for k in stack[-1]:
            if k not in ring:
                if len(path) + len(best[k]) > len(found):
                    found = path + best[k]
            elif k not in on:
                path.append(k)
                on.add(k)
                if len(path) > len(found):
                    found = path[:]
                if most() > len(found):
                    stack.append(iter(sorted(kids[k])))
                    break
                on.discard(path.pop())
        else:
            stack.pop()
            on.discard(path.pop())
    return found


def _all_longest(kids: dict, ring_of: dict, best: dict) -> dict:
    """node -> its longest path, for all nodes of ``kids``; rings below come first."""
    rings: dict = {}
    for node in kids:
        rings.setdefault(ring_of[node], set()).add(node)
    todo, state = [], {}
    for first in sorted(rings):
        todo.append(first)
        while todo:
            r = todo[-1]
            if state.get(r) == 2:
                todo.pop()
            elif r in state:
                for n in sorted(rings[r]):
                    best[n] = _longest_from(n, rings[r], kids, best)
                state[r] = 2
                todo.pop()
            else:
                state[r] = 1
                todo += {ring_of[k] for n in rings[r] for k in kids[n] if k not in best and ring_of[k] != r and ring_of[k] not in state}
    return best


def longest_chains(edges: DataFrame, doors: DataFrame, one_task: int | None = None) -> DataFrame:
    """(door, hops, path): the longest simple path from each door, the least of them by its nodes in order.

    A longest path is found once for each door and each node by which a ring is entered, from those of the rings below: level by level,
    each such node's search a group of its own that holds its ring's edges, or all of them in one task. Only within a ring are paths
    enumerated, those that a bound can't rule out; there is no cap.
    """
    edges = cut(_simple(edges))
    kind = edges.schema["src"].dataType.simpleString()
    doors = doors.select(F.col("node").alias("door")).distinct()
    out = f"node {kind}, path array<{kind}>"

    def table(best: dict, like: pa.DataType) -> pa.Table:
        return pa.table({"node": pa.array([*best], like), "path": pa.array([*best.values()], pa.list_(like))})

    if _in_one_task(edges, ONE_TASK if one_task is None else one_task):

        def every(group: pa.Table) -> pa.Table:
            kids = _kids(group.column("src").to_pylist(), group.column("dst").to_pylist())
            return table(_all_longest(kids, _rings(kids), {}), group.schema.field("src").type)

        best = edges.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(every, out)
    else:
        ring = strong_components(edges, one_task)
        named = cut(vertices(edges).join(ring, "node", "left").select("node", F.coalesce("component", "node").alias("ring")))
        ways = cut(edges.join(named.select(F.col("node").alias("src"), F.col("ring").alias("r")), "src").join(named.select(F.col("node").alias("dst"), F.col("ring").alias("below")), "dst"))
        entered = ways.where("r <> below").select(F.col("dst").alias("node")).union(doors.select(F.col("door").alias("node"))).distinct()
        starts = cut(named.join(entered, "node", "left_semi").select(F.col("node").alias("start"), "ring"))
        left, best = named, None

        def one(group: pa.Table) -> pa.Table:
            rows, start = group.to_pylist(), group.column("start")[0].as_py()
            own = {x["src"] for x in rows}
            kids = {n: [] for n in own}
            for x in rows:
                if x["dst"] is not None:
                    kids[x["src"]].append(x["dst"])
            known = {x["dst"]: x["path"] for x in rows if x["path"] is not None}
            return table({start: _longest_from(start, own, kids, known)}, group.schema.field("src").type)

        while not left.isEmpty():
            waiting = ways.where("r <> below").join(left.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("r").alias("ring")).distinct()
            ready = cut(left.join(waiting, "ring", "left_anti"))
            rows = ready.select(F.col("node").alias("src"), "ring").join(ways.select("src", "dst"), "src", "left")
            known = best.withColumnRenamed("node", "dst") if best is not None else edges.sparkSession.createDataFrame([], f"dst {kind}, path array<{kind}>")
            found = cut(rows.join(known, "dst", "left").join(starts, "ring").select("ring", "start", "src", "dst", "path").groupBy("ring", "start").applyInArrow(one, out))
            best = found if best is None else cut(best.union(found))
            left = cut(left.join(ready.select("node"), "node", "left_anti"))
        best = best if best is not None else edges.sparkSession.createDataFrame([], out)
    found = doors.join(best, doors.door == best.node, "left").select("door", F.coalesce("path", F.array("door")).alias("path"))
    return found.select("door", (F.size("path") - 1).alias("hops"), "path")


def greedy_chains(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, path): from each start, again and again to the least next node that isn't on the path yet."""
    edges = cut(_simple(edges))
    front = cut(starts.select(F.col("node").alias("start"), F.array("node").alias("path")))
    out = None
    while not front.isEmpty():
        step = front.join(edges, F.element_at("path", -1) == edges.src).where(~F.array_contains("path", F.col("dst"))).groupBy("start", "path").agg(F.min("dst").alias("next"))
        step = cut(front.join(step, ["start", "path"], "left"))
        ended = step.where("next is null").select("start", "path")
        out = ended if out is None else out.union(ended)
        front = step.where("next is not null").select("start", F.concat("path", F.array("next")).alias("path"))
    return out if out is not None else starts.select(F.col("node").alias("start"), F.array("node").alias("path")).limit(0)


def call_tree(edges: DataFrame, doors: DataFrame) -> DataFrame:
    """(door, pre_order, depth, node, lines, seen): each door's calls in the order (first line, name); a node read before is a leaf.

    Depth-first order is sequential: each door's reachable edges are walked by one task. edges: src, dst, lines array<int>.
    """
    edges = cut(edges.select("src", "dst", "lines"))
    met = cut(doors.select(F.col("node").alias("door"), F.col("node").alias("src")).distinct())
    front = met
    while not front.isEmpty():  # what each door reaches, and nothing else
        new = cut(front.join(edges, "src").select("door", F.col("dst").alias("src")).distinct().join(met, ["door", "src"], "left_anti"))
        wider = cut(met.union(new))
        drop(front, met)
        front, met = new, wider
    under = met.join(edges, "src", "left").select("door", "src", "dst", "lines")

    def walk(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        door, kids = rows[0]["door"], {}
        for r in rows:
            if r["dst"] is not None:
                kids.setdefault(r["src"], []).append((min(r["lines"] or [0]), r["dst"], sorted(r["lines"] or [])))
        out, read, todo = [], set(), [(door, [], 0)]
        while todo:
            node, lines, depth = todo.pop()
            out.append({"door": door, "pre_order": len(out), "depth": depth, "node": node, "lines": lines, "seen": node in read})
            if node not in read:
                read.add(node)
                todo += [(d, ls, depth + 1) for _, d, ls in sorted(kids.get(node, ()), reverse=True)]
        return pa.Table.from_pylist(out, schema)

    kind = edges.schema["src"].dataType.simpleString()
    schema = pa.schema([("door", pa.string()), ("pre_order", pa.int32()), ("depth", pa.int32()), ("node", pa.string()), ("lines", pa.list_(pa.int32())), ("seen", pa.bool_())])
    return under.groupBy("door").applyInArrow(walk, f"door {kind}, pre_order int, depth int, node {kind}, lines array<int>, seen boolean")


def first_in(partition: list[str], *order) -> Window:
    return Window.partitionBy(*partition).orderBy(*order)
