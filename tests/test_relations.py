"""Links, joins by time and place, frames, sketches, sources and extensions, against brute force."""

import json
import random
import resource
import subprocess
from datetime import datetime, timedelta

import pytest
from crossfile import bindings, check_queries, relation_queries
from crossfile.facts import Facts
from crossfile.functions import sketches
from crossfile.operators import alias, graph, lineage, pieces, temporal
from crossfile.plans import checks, extension, report, trends
from crossfile.plans.score import score
from crossfile.rules import Project, Skip, declares_rules
from crossfile.sources import files, gitlog, python_source
from pyspark.sql import functions as F
from test_checks import arg, call, fn, found
from test_checks import facts as made
from test_checks import sym

DAY = datetime(2024, 1, 1)
SF = "/root/testdata/sf0.001"


def test_chains_end_and_rings_do_not(spark):
    links = [(f"a{i}", f"a{i + 1}") for i in range(20)] + [(f"r{i}", f"r{(i + 1) % 5}") for i in range(5)] + [("in", "r2"), ("self", "self"), ("x", "a3"), ("two", "end"), ("two", "zzz")]
    got = dict(map(tuple, alias.collapsed(spark.createDataFrame(links, "node string, to string")).collect()))
    assert got == {**{f"a{i}": "a20" for i in range(20)}, "x": "a20", "two": "end"}
    assert alias.collapsed(spark.createDataFrame([], "node string, to string")).count() == 0


def test_above_on_rings(spark):
    rng = random.Random(1)
    edges = {(rng.randrange(12), rng.randrange(12)) for _ in range(16)}
    want = {}
    for a in range(12):
        front, d = {a}, 0
        while front:
            d += 1
            front = {y for x, y in edges if x in front} - {b for n, b in want if n == a}
            want |= {(a, b): d for b in front}
    got = {(r.node, r.up): r.depth for r in alias.above(spark.createDataFrame(sorted(edges), "node int, up int")).collect()}
    assert got == want


def test_names_spread_through_stars(spark):
    known = [("a", "x"), ("b", "x"), ("b", "y"), ("c", "default"), ("c", "z"), ("d", "z")]
    stars = [("a", "b", 1), ("a", "c", 2), ("e", "c", 1), ("e", "d", 0), ("b", "a", 1), ("f", "e", 1)]
    got = {(r.place, r.name): r.via for r in alias.spread(spark.createDataFrame(known, "place string, name string"), spark.createDataFrame(stars, "place string, of string, ord int"), "default").collect()}
    assert got == {("a", "x"): None, ("b", "x"): None, ("b", "y"): None, ("c", "default"): None, ("c", "z"): None, ("d", "z"): None, ("a", "y"): "b", ("a", "z"): "c", ("b", "z"): "a", ("e", "z"): "d", ("f", "z"): "e"}


@pytest.mark.parametrize("limit", [0, 200_000])
def test_rings_above_tell_the_same_as_above(spark, limit):
    rng = random.Random(3)
    for n, m in ((12, 16), (30, 30), (5, 0)):
        edges = spark.createDataFrame(sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(m)}), "node int, up int")
        rings, reached = alias.rings_above(edges, limit)
        ring = {r.node: r.ring for r in rings.collect()}
        pairs = {tuple(r) for r in reached.select("ring", "up").collect()}
        assert {(a, b) for a in ring for b in ring if (ring[a], ring[b]) in pairs} == {(r.node, r.up) for r in alias.above(edges).collect()}


def test_a_ring_is_one_row_above_others(spark):
    """A ring of 40 below another: pairs are of rings, where those of nodes would be 4,800."""
    ring = [(i, (i + 1) % 40) for i in range(40)] + [(100 + i, 100 + (i + 1) % 40) for i in range(40)] + [(0, 100)]
    rings, reached = alias.rings_above(spark.createDataFrame(ring, "node int, up int"))
    assert rings.count() == 80
    assert {tuple(r) for r in reached.select("ring", "up").collect()} == {(0, 0), (100, 100), (0, 100)}


def test_all_names_are_those_that_spread(spark):
    rng = random.Random(4)
    for n in (4, 9):
        known = [(f"p{rng.randrange(n)}", f"f{rng.randrange(6)}") for _ in range(2 * n)] + [("alone", "f1"), ("alone", "f2")]
        stars = [(f"p{rng.randrange(n)}", f"p{rng.randrange(n + 2)}", i) for i in range(n + 3)]
        known, stars = spark.createDataFrame(known, "place string, name string"), spark.createDataFrame(stars, "place string, of string, ord int")
        got = sorted(map(tuple, alias.all_names(known, stars, "f1").collect()))
        assert got == sorted((r.place, r.name) for r in alias.spread(known, stars, "f1").collect())


@pytest.mark.parametrize(("limit", "unit"), [(0, 4096), (25, 4096), (25, 3), (200_000, 5)])
def test_all_names_of_pieces_and_of_rounds_are_the_same(spark, monkeypatch, limit, unit):
    """Pieces of eight, one of 30 and two of one place, some too large for a task, some searched in parts; names that are fixed or null stay."""
    monkeypatch.setattr(pieces, "UNIT", unit)
    monkeypatch.setattr(pieces, "BATCH", 7)
    monkeypatch.setattr(pieces, "CELLS", 40)
    rng = random.Random(5)
    sizes = [8] * 4 + [30, 1, 1]
    stars = [(f"p{i}.{rng.randrange(n)}", f"p{i}.{rng.randrange(n)}", j) for i, n in enumerate(sizes) for j in range(n + n // 4)] + [("alone", None, 0)]
    known = [(f"p{i}.{rng.randrange(n)}", rng.choice(["f1", None, *(f"f{k}" for k in range(2, 9))])) for i, n in enumerate(sizes) for _ in range(n)] + [("alone", "f1"), ("alone", "f2"), (None, "f3")]
    known, stars = spark.createDataFrame(known, "place string, name string"), spark.createDataFrame(stars, "place string, of string, ord int")
    key = lambda r: tuple((x is not None, x or "") for x in r)
    got = sorted(((r.place, r.name) for r in alias.all_names(known, stars, "f1", limit).collect()), key=key)
    assert got == sorted({(r.place, r.name) for r in alias.spread(known.na.drop(), stars.na.drop(), "f1").collect()} | {tuple(r) for r in known.collect()}, key=key)


@pytest.mark.parametrize(("limit", "unit"), [(0, 4096), (25, 3), (200_000, 5)])
def test_counts_above_are_those_of_above(spark, monkeypatch, limit, unit):
    monkeypatch.setattr(pieces, "UNIT", unit)
    monkeypatch.setattr(pieces, "CELLS", 40)
    rng = random.Random(6)
    edges = [(100 * i + rng.randrange(n), 100 * i + rng.randrange(n)) for i, n in enumerate([8] * 4 + [30, 1]) for _ in range(n + n // 4)] + [(700, 701), (None, 1), (702, None)]
    marked = [(x,) for x in (1, 103, 105, 301, 404, 411, 701, 999, None)]
    edges, marked = spark.createDataFrame(edges, "node int, up int"), spark.createDataFrame(marked, "node int")
    want = {}
    for r in alias.above(edges.na.drop()).collect():
        n, hit = want.get(r.node, (0, False))
        want[r.node] = n + 1, hit or r.up in (1, 103, 105, 301, 404, 411, 701)
    assert sorted(map(tuple, alias.counts_above(edges, marked, limit).collect())) == sorted((a, n, hit) for a, (n, hit) in want.items())


def test_counts_along_a_chain_take_no_rounds(spark, monkeypatch):
    """Each module further was a round of joins before."""
    written = []
    for m in (alias, graph, pieces):
        monkeypatch.setattr(m, "cut", lambda df: written.append(df.columns) or lineage.cut(df))
    chain = spark.createDataFrame([(f"m{i}", f"m{i + 1}") for i in range(40)], "module string, target string")
    monkeypatch.setattr(relation_queries, "flat", lambda _, __, select, **___: chain.selectExpr("module node", "target up") if "few_imps" in select else chain.selectExpr("target node").where("node = 'm40'"))
    assert sorted(map(tuple, relation_queries.bases_above(spark, SF).collect())) == sorted((f"m{i}", 40 - i, True) for i in range(40))
    assert len(written) < 10


def test_names_along_a_chain_take_no_rounds(spark, monkeypatch):
    """Each place further was a round of joins before."""
    written = []
    for m in (alias, graph, pieces):
        monkeypatch.setattr(m, "cut", lambda df: written.append(df.columns) or lineage.cut(df))
    stars = spark.createDataFrame([(f"p{i}", f"p{i + 1}", 0) for i in range(40)], "place string, of string, ord int")
    got = alias.all_names(spark.createDataFrame([("p40", "x"), ("p3", "y")], "place string, name string"), stars, "f1").collect()
    assert sorted(map(tuple, got)) == sorted([(f"p{i}", "x") for i in range(41)] + [(f"p{i}", "y") for i in range(4)])
    assert len(written) < 10


def test_parts_may_be_more_than_places(spark, monkeypatch):
    monkeypatch.setattr(pieces, "UNIT", 3)
    known = spark.createDataFrame([("a", f"f{i}") for i in range(2, 40)] + [("b", "f1"), ("b", "x")], "place string, name string")
    got = alias.all_names(known, spark.createDataFrame([("a", "b", 0)], "place string, of string, ord int"), "f1").collect()
    assert sorted(map(tuple, got)) == sorted([*map(tuple, known.collect()), ("a", "x")])
    marked = known.where("place = 'b'").select(F.col("place").alias("node"))
    assert [tuple(r) for r in alias.counts_above(spark.createDataFrame([("a", "b")], "node string, up string"), marked).collect()] == [("a", 1, True)]


def test_lines_around_tell_what_follows(spark, tmp_path):
    """Orders without a line of the quantity aren't read; lines of no order are one."""
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").withColumn("l_orderkey", F.when(F.col("l_orderkey") % 50 > 0, F.col("l_orderkey")))
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    text = "select * from line where q = 50"
    around = bindings.lines_around(spark, str(tmp_path), 50)
    got = sorted(map(str, bindings.flat(spark, str(tmp_path), text, lines=around).collect()))
    assert got == sorted(map(str, bindings.flat(spark, str(tmp_path), text).collect())) and "o=None" in "".join(got)
    assert around.count() < lines.count() // 4


def test_all_checks_send_no_table_through_the_driver(spark, monkeypatch):
    key, seen = relation_queries._BROADCAST, []
    before = spark.conf.get(key)
    monkeypatch.setattr(relation_queries, "_written", lambda spark, *_: seen.append(spark.conf.get(key)))
    monkeypatch.setattr(relation_queries, "_all_findings", lambda spark, *_: seen.append(spark.conf.get(key)))
    monkeypatch.setattr(relation_queries, "score", lambda *_: spark.createDataFrame([], "key string, value int"))
    relation_queries.score_of_all_checks(spark, SF)
    assert seen == ["-1", "-1"]
    assert spark.conf.get(key) == before


def test_plans_of_checks_read_what_is_written_once(spark):
    """Each view of all checks is a file, and commits are read as one: made again in every plan, they were 1,900 nodes and 105 broadcasts in one."""
    f = relation_queries._written(spark, SF, bindings.Held())
    leaves = lambda df: df._jdf.queryExecution().optimizedPlan().collectLeaves().size()
    assert [leaves(x) for x in (f.symbols, f.functions, f.users, f.ours, f.placed, f.own_functions, f.checkable)] == [1] * 7
    assert leaves(checks.shotgun(f)) <= 6  # files of commits twice in pairs and twice in changes, and modules twice
    assert leaves(f.commit_files) <= 4
    assert leaves(checks.unused_param(f)) <= 5


@pytest.mark.parametrize("rows", [5, 1 << 18])
def test_as_of_with_a_hot_key(spark, rows):
    rng = random.Random(2)
    keys = lambda: rng.choice(["hot"] * 6 + ["a", "b", None])
    right = [(keys(), rng.choice([None, *range(40)]), rng.randrange(5)) for _ in range(60)]
    left = [(keys(), rng.choice([None, *range(-3, 44)]), i) for i in range(120)]

    def last(k, t):
        met = [(s, v) for kk, s, v in right if kk == k and k is not None and s is not None and t is not None and s <= t]
        return max(met, default=(None, None))

    got = temporal.as_of(spark.createDataFrame(left, "k string, at long, i int"), spark.createDataFrame(right, "k string, since long, v int"), ["k"], "at", "since", rows).collect()
    assert sorted(map(tuple, got), key=str) == sorted(((k, t, i, *last(k, t)) for k, t, i in left), key=str)
    assert temporal.as_of(spark.createDataFrame([], "k string, at long, i int"), spark.createDataFrame([], "k string, since long, v int"), ["k"], "at", "since").count() == 0


def test_innermost_spans(spark):
    rng = random.Random(3)
    spans = [(rng.choice("hhhx"), a, a + rng.choice([0, 1, 3, 10, 100]), f"s{i}") for i, a in enumerate(rng.randrange(120) for _ in range(80))] + [("h", 9, 5, "odd"), ("h", -4, 1000, "all")]
    points = [(rng.choice("hhxz"), rng.randrange(-10, 140)) for _ in range(100)]
    inside = lambda k, p: sorted((b - a, a, s, b) for kk, a, b, s in spans if kk == k and a <= p <= b)
    p, s = spark.createDataFrame(points, "k string, at int"), spark.createDataFrame(spans, "k string, a int, b int, sid string")
    got = sorted(map(tuple, temporal.innermost(p, s, ["k"], "at", "a", "b").select("k", "at", "a", "b", "sid").collect()), key=str)
    want = [(k, at, x[0][1], x[0][3], x[0][2]) if (x := inside(k, at)) else (k, at, None, None, None) for k, at in points]
    assert got == sorted(want, key=str)
    assert temporal.around(p.distinct(), s, ["k"], "at", "a", "b").count() == sum(len(inside(k, at)) for k, at in set(points))


def test_frames_look_back_over_rows_and_days(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["hot"] * 5 + ["b"]), f"h{i}", DAY + timedelta(days=rng.randrange(100)), rng.randrange(9)) for i in range(150)]
    got = trends.churn(spark.createDataFrame(rows, "file string, hash string, at timestamp, lines int"), commits=4, days=30).collect()
    assert len(got) == len(rows)
    for r in got:
        own = sorted((x[2], x[1], x[3]) for x in rows if x[0] == r.file)
        i = own.index((r.at, r.hash, r.lines))
        days = [x for x in own if timedelta(0) <= r.at - x[0] <= timedelta(days=30)]
        assert (r.lines_lately, r.changes_in_days, r.lines_in_days) == (sum(x[2] for x in own[max(0, i - 3) : i + 1]), len(days), sum(x[2] for x in days))


def test_scores_move_over_commits_and_days(spark):
    rng = random.Random(6)
    rows = [(key, f"h{i:02}", DAY + timedelta(days=3 * (i // 2)), rng.randrange(101)) for i in range(40) for key in ("overall", "lean")]
    for r in trends.score_moves(spark.createDataFrame(rows, "key string, hash string, at timestamp, value int"), commits=5, days=30).collect():
        own = sorted((x[2], x[1], x[3]) for x in rows if x[0] == r.key)
        i = own.index((r.at, r.hash, r.value))
        last, days = [x[2] for x in own[max(0, i - 4) : i + 1]], [x[2] for x in own if timedelta(0) <= r.at - x[0] <= timedelta(days=30)]
        assert r.change == (own[i][2] - own[i - 1][2] if i else None) and r.lately == pytest.approx(sum(last) / len(last)) and r.in_days == pytest.approx(sum(days) / len(days))


def test_findings_by_the_commit_that_brought_them(spark):
    changes = spark.createDataFrame([("a.py", DAY, "c1"), ("a.py", DAY + timedelta(days=5), "c2"), ("b.py", DAY, "c3")], "file string, at timestamp, hash string")
    found_ = spark.createDataFrame([("a.py", DAY + timedelta(days=4), "x"), ("a.py", DAY + timedelta(days=5), "y"), ("c.py", DAY, "z")], "file string, seen timestamp, id string")
    assert {r.id: r.hash for r in trends.brought_by(found_, changes).collect()} == {"x": "c1", "y": "c2", "z": None}
    functions = spark.createDataFrame([("a.py", 1, 30, "a:outer"), ("a.py", 5, 9, "a:inner")], "file string, start int, end int, sid string")
    lines = spark.createDataFrame([("a.py", 6), ("a.py", 20), ("a.py", 40)], "file string, line int")
    assert [r.sid for r in trends.functions_around(lines, functions).orderBy("line").collect()] == ["a:inner", "a:outer", None]


def test_subtotals_are_told_from_nulls(spark):
    rows = [("dead", "p.m:f"), ("dead", "p.m:f"), ("dead", "top:g"), (None, "p.n:h")]
    got = {(r.check, r.folder, r.module, r.level): (r.findings, r.symbols) for r in trends.breakdown(spark.createDataFrame(rows, "check string, symbol string")).collect()}
    assert got[None, None, None, 7] == (4, 3) and got[None, None, None, 3] == (1, 1) and got["dead", None, None, 3] == (3, 2)
    assert got["dead", "", "top", 0] == (1, 1) and got[None, "p", None, 5] == (3, 2) and got[None, "p", "p.n", 4] == (1, 1) and len(got) == 3 + 3 + 2 + 3 + 2 + 1


def test_sketches_merge_in_any_order(spark):
    rows = spark.range(60_000).select((F.col("id") % 7).alias("reading"), (F.col("id") * 7919 % 20_011).alias("name"), ((F.col("id") * 31) % 10_000).alias("size"))
    kept = sketches.states(rows, ["reading"], F.col("name"), F.col("size"))
    one = sketches.estimates(sketches.merged(kept, [])).first()
    halves = sketches.merged(kept.where("reading % 2 = 1"), []).unionByName(sketches.merged(kept.where("reading % 2 = 0"), []))
    two = sketches.estimates(sketches.merged(halves, [])).first()
    exact = rows.agg(F.count_distinct("name")).first()[0]
    for r in (one, two):
        assert r.n == 60_000 and abs(r.distinct - exact) <= sketches.distinct_bound() * exact
        for q, at in ((r.q50, 0.5), (r.q90, 0.9)):
            assert abs(rows.where(F.col("size") <= q).count() / 60_000 - at) <= sketches.rank_bound()
    assert one.distinct == two.distinct


def test_tunnels_may_end_on_their_path(spark):
    names = ["enter", "one", "two", "three"]
    edges = [("a:enter", "a:one"), ("a:one", "a:two"), ("a:two", "a:three"), ("a:three", "a:two")]
    f = made(spark, symbols=[sym(f"a:{n}", line=i) for i, n in enumerate(names)], functions=[fn(f"a:{n}", ["tok"], relayed=["tok"]) for n in names], call_edges=[(a, b, [1]) for a, b in edges])
    got = checks.tunnel(f).collect()
    assert [(r.symbol, r.key, r.related) for r in got] == [("a:enter", "tok", ["a:one", "a:two", "a:three", "a:two"])]


def test_a_class_may_be_its_namesakes_base(spark):
    to = call("g", [arg(name="x")])
    f = made(
        spark, symbols=[sym("base:Foo", "class"), sym("sub:Foo", "class"), sym("sub:Foo.only", "method", owner="sub:Foo"), sym("sub:g"), sym("sub:free")],
        functions=[fn("sub:Foo.only", ["x"], sole=to), fn("sub:free", ["x"], sole=to), fn("sub:g", ["x"])],
        classes=[("base:Foo", [], [], False, False, False, 0), ("sub:Foo", [], ["Foo"], False, False, False, 1)], call_edges=[("sub:Foo.only", "sub:g", [1]), ("sub:free", "sub:g", [1])],
    )
    assert found("forward", f) == [("sub:free", "")]


def test_a_margin_is_compared_as_it_is(spark):
    """0.6 - 0.2 is a little less than 0.4 in doubles."""
    assert 3 / 5 - 2 / 10 < 0.4 <= 3 / 5 - 2 / 10 + 1e-9
    imports = [(f"in{i}", "own") for i in range(8)] + [("own", "far"), ("own", "leaf"), ("in0", "far")] + [("far", f"far{i}") for i in range(3)]
    f = made(spark, modules=sorted({m for e in imports for m in e}), imports=[(a, b, 1, i) for i, (a, b) in enumerate(imports)])
    assert found("unstable_dependency", f) == []


def test_rules_are_looked_for_in_both_files(tmp_path):
    (tmp_path / "pyproject.toml").write_text("this is [not toml")
    (tmp_path / "package.json").write_text('{"crossfile": {}}')
    assert declares_rules(tmp_path)


def package(folder, n):
    at = folder / "pkg"
    at.mkdir()
    (at / "__init__.py").write_text("")
    for i in range(n):
        d = at / f"d{i % 50}"
        d.mkdir(exist_ok=True)
        (d / (f"_m{i}.py" if i % 7 == 0 else f"m{i}.py")).write_text(f"def f{i}(a):\n    return a\n")
    return at


def test_executors_read_what_the_driver_lists(spark, tmp_path):
    at = package(tmp_path, 3000)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    found_ = python_source.files(spark, at)
    assert found_.count() == 3000 and found_.where("file like '%/_m%'").count() == 429
    assert found_.where("module = 'd7._m7'").first().content == b"def f7(a):\n    return a\n"
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 64 << 10  # KB
    some = files.sources(spark, at, (".py",)).where("name = 'd8/m8.py'")
    assert some.count() == 1 and some.rdd.getNumPartitions() == 1  # the filter was met before files were opened
    assert files.sources(spark, at, (".py",)).where(F.startswith("name", F.lit("d1/"))).count() == 60


def test_commits_are_read_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "COMMITS", 2)
    run = lambda *a: subprocess.run(["git", "-c", "user.name=n", "-c", "user.email=e", *a], cwd=tmp_path, check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "pkg").mkdir()
    for i in range(5):
        (tmp_path / "pkg" / f"m{i % 2}.py").write_text(str(i))
        (tmp_path / "other.txt").write_text(str(i))
        run("add", "-A")
        run("commit", "-qm", f"change {i}")
    got = sorted((r.pos, r.subject, r.file) for r in gitlog.commit_files(spark, tmp_path / "pkg").collect())
    assert got == [(i, f"change {4 - i}", f"pkg/m{(4 - i) % 2}.py") for i in range(5)]
    (tmp_path / "none").mkdir()
    assert gitlog.commit_files(spark, tmp_path / "none").count() == 0


def long_names(f: Facts):
    """A user's check, with an aggregate of its own: modules of which the names are long on the whole."""
    means = f.symbols.groupBy("module").agg(F.call_function("mean_length", F.length("name")).alias("mean")).where("mean > 6")
    rows = f.modules.join(means, "module").select(F.col("module").alias("sid"), "module", "file", F.lit(1).alias("line"), "ord")
    return checks.finding(rows, "long_names", F.concat(F.col("sid"), F.lit(" has long names")), "shorten them")


def test_a_check_a_reader_and_an_aggregate_of_a_users_own(spark, tmp_path):
    from pyspark.sql.functions import udtf

    class TodoReader:
        """A user's reader: a function for every line `fn NAME`, a name read for every line `use NAME`."""

        def eval(self, name: str, content: bytes):
            module = name.removesuffix(".toy").replace("/", ".")
            yield "modules", json.dumps({"module": module, "file": name, "lines": content.count(b"\n")})
            for i, line in enumerate(content.decode().splitlines(), 1):
                word, _, rest = line.partition(" ")
                if word == "fn":
                    yield "symbols", json.dumps({"sid": f"{module}:{rest}", "module": module, "name": rest, "kind": "function", "doc": "", "line": i, "lines": 1, "private": False, "owner": None})
                elif word == "use":
                    yield "name_counts", json.dumps({"scope": "package", "name": rest, "n": 1})

    for name, text in {"a.toy": "fn short\nfn muchlongername\nuse short\n", "sub/b.toy": "fn averyverylongname\n", "c.toy": "fn x\nuse x\n"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    reader = udtf(TodoReader, returnType="fact string, row string")
    rules = Project(tmp_path, "toy", skips=(Skip("sub/*", "old", ("long_names",)),))
    f = extension.read(spark, tmp_path, (".toy",), reader, rules)
    assert sorted(r.sid for r in f.symbols.collect()) == ["a:muchlongername", "a:short", "c:x", "sub.b:averyverylongname"]
    with pytest.raises(ValueError):
        extension.register(extension.Check("dead", long_names, "", ""))
    extension.aggregate(spark, "mean_length", lambda v: float(v.mean()), "double")
    extension.register(extension.Check("long_names", long_names, "Long names", "Modules of long names.", axis="shaped", weight=3))
    try:
        r = report.reading(f)
        assert [(x.check, x.symbol, x.why) for x in r.rows()] == [("dead", "a:muchlongername", None), ("dead", "sub.b:averyverylongname", None), ("long_names", "a", None), ("long_names", "sub.b", "old")]
        assert "### Long names (1)" in report.markdown(r)
        shaped = next(x for x in r.axes.collect() if x.key == "shaped")
        assert shaped.value == 0 and "long_names" in shaped.checks
    finally:
        extension.unregister("long_names")
    assert next(x for x in score(f, r.found.where("why is null"), r.chains).collect() if x.key == "shaped").value == 100


def test_no_check_sorts_all_lines_in_one_task(spark):
    plan = check_queries.QUERIES["check_dead"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan
