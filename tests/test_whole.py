"""The whole-job queries on the driver's tables, against brute force."""

from collections import defaultdict
from concurrent.futures import ThreadPoolExecutor

import __spark_entry__
import duckdb
import pytest
from crossfile import bindings, queries
from crossfile.operators import graph, lineage
from crossfile.operators.lineage import cut

SF = "/root/testdata/sf0.01"


def pairs(spark, least):
    return [(r.src, r.dst) for r in queries._edges(spark, SF, least).collect()]


def least_paths(edges, start):
    """The shortest path from the start to every node, the least of them by its nodes."""
    after = defaultdict(list)
    for a, b in edges:
        after[a].append(b)
    found = front = {start: (start,)}
    while front:
        step = defaultdict(list)
        for a, path in front.items():
            for b in after[a]:
                if b not in found:
                    step[b].append((*path, b))
        front = {b: min(ps) for b, ps in step.items()}
        found = found | front
    return found


def test_reach_doors_whole(spark):
    for least in (1, 10):
        edges = pairs(spark, least)
        want = {(n, len(p) - 1, ">".join(map(str, p[::-1]))) for n, p in least_paths([(b, a) for a, b in edges], max(b for _, b in edges)).items()}
        assert {tuple(r) for r in queries._reach_whole(queries._edges(spark, SF, least)).collect()} == want
        if least == 1:
            assert {tuple(r) for r in __spark_entry__.queries()["reach_doors_whole"](spark, SF).collect()} == want


def test_shortest_flow_whole(spark):
    edges = pairs(spark, 1)
    path = least_paths(edges, min(a for a, _ in edges))[max(b for _, b in edges)]
    got = __spark_entry__.queries()["shortest_flow_whole"](spark, SF).collect()
    assert [tuple(r) for r in got] == [(len(path) - 1, ">".join(map(str, path)))]


def test_layer_depth_whole(spark):
    for least in (1, 10):  # one ring, and many layers with rings
        edges = pairs(spark, least)
        nodes = {x for e in edges for x in e}
        reach = {n: set(least_paths(edges, n)) for n in nodes}
        group = {n: min(m for m in reach[n] if n in reach[m]) for n in nodes}
        above = {n: set() for n in group.values()}
        for a, b in edges:
            above[group[a]] |= {group[b]} - {group[a]}
        layer = lambda g: max((layer(h) + 1 for h in above[g]), default=0)
        want = {n: layer(g) for n, g in group.items()}
        assert {r.node: r.layer for r in graph.layers(queries._edges(spark, SF, least)).collect()} == want
    got = __spark_entry__.queries()["layer_depth_whole"](spark, SF).collect()
    assert len(got) == len({x for e in pairs(spark, 1) for x in e})


@pytest.mark.parametrize("name", ["instability_whole", "scc_modules_whole", "components_whole", "layer_violation_whole"])
def test_whole_queries_equal_their_sql(spark, name):
    db = duckdb.connect()
    for t in ("lineitem", "supplier", "nation"):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = [tuple(r) for r in __spark_entry__.queries()[name](spark, SF).collect()]
    assert got and sorted(got) == sorted(db.execute(__spark_entry__.oracle_sql()[name]).fetchall())


def test_dense_strong_components(spark):
    """More edges than squaring takes: the other way gives the same."""
    edges = spark.createDataFrame([(a, b) for a in range(40) for b in range(40) if a // 20 <= b // 20], "src int, dst int")
    want = {(n, n // 20 * 20) for n in range(40)}
    for limit in (41, 5_000):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(graph, "ONE_TASK", limit)
            assert {(r.node, r.component) for r in graph.strong_components(edges).collect()} == want


def test_told_new_fixed_whole_reads_every_event(spark):
    db = duckdb.connect()
    db.execute(f"create view events as select * from '{SF}/events.parquet'")
    got = [tuple(r) for r in __spark_entry__.queries()["told_new_fixed_whole"](spark, SF).collect()]
    assert sorted(got) == sorted(db.execute(__spark_entry__.oracle_sql()["told_new_fixed_whole"]).fetchall())
    assert {g[:2] for g in got} == set(db.execute("select distinct user_id, event_type from events").fetchall())


@pytest.fixture(scope="module")
def db():
    db = duckdb.connect()
    for t in ("lineitem", "supplier", "nation", "part"):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return db


@pytest.mark.parametrize("name", ["check_tunnel", "check_clump", "check_unused_default", "module_layers", "reach_doors_whole", "layer_depth_whole"])
def test_checks_equal_their_sql(spark, db, name):
    got = __spark_entry__.queries()[name](spark, SF)
    columns = sorted(got.columns)
    want = db.execute(f"select {', '.join(columns)} from ({__spark_entry__.oracle_sql()[name]})").fetchall()
    assert want and sorted(map(tuple, got.select(*columns).collect())) == sorted(want)


@pytest.mark.parametrize("name", ["bases_above", "star_names"])
def test_rings_equal_their_sql(spark, db, name):
    got = __spark_entry__.queries()[name](spark, SF)
    columns = sorted(got.columns)
    want = db.execute(f"select {', '.join(columns)} from ({__spark_entry__.oracle_sql()[name]})").fetchall()
    assert want and sorted(map(tuple, got.select(*columns).collect())) == sorted(want)


def test_flat_tables_are_written_once(spark, monkeypatch):
    """Checks that run at a time read the same flat tables."""
    written = []
    monkeypatch.setattr(bindings, "cut", lambda df: written.append(df.columns) or cut(df))
    held = bindings.facts(spark, SF).tables
    with ThreadPoolExecutor(8) as pool:
        list(pool.map(lambda n: held[n], ("symbols", "uses", "call_edges", "library_calls", "test_uses", "taken", "entrypoints", "externals")))
    assert len(written) == len(set(map(tuple, written))) == 4


@pytest.mark.parametrize(("name", "tasks"), [("co_change_pairs", None), ("clump_sets", 48), ("churn_frames", 24)])
def test_rows_are_dealt_to_as_many_tasks_as_they_need(spark, db, monkeypatch, name, tasks):
    """60,000 lines, 5,000 rows to a task; sets of three and blocks of time are four and two times the lines."""
    monkeypatch.setattr(lineage, "ROWS_A_TASK", 5_000)
    got = __spark_entry__.queries()[name](spark, SF)
    assert tasks is None or got.rdd.getNumPartitions() == tasks
    columns = sorted(got.columns)
    want = db.execute(f"select {', '.join(f'"{c}"' for c in columns)} from ({__spark_entry__.oracle_sql()[name]})").fetchall()
    assert want and sorted(map(tuple, got.select(*columns).collect())) == sorted(want)


def test_edges_are_dealt_and_components_ignore_edges_that_stand_twice(spark, monkeypatch):
    monkeypatch.setattr(lineage, "ROWS_A_TASK", 5_000)
    assert queries.weighted_edges(spark, SF).rdd.getNumPartitions() == 12
    edges = spark.createDataFrame([(1, 2), (1, 2), (2, 1), (4, 3), (3, 3)], "src int, dst int")
    assert {tuple(r) for r in graph.components(edges).collect()} == {(1, 1), (2, 1), (3, 3), (4, 3)}
