"""Every check: rows that fire, and what is left alone."""

import random

import pytest
from crossfile import check_queries
from crossfile.facts import Facts
from crossfile.operators import graph
from crossfile.plans import checks
from crossfile.plans.score import score
from crossfile.rules import Project, Skip
from pathlib import Path

from pyspark.sql import functions as F


def sym(sid, kind="function", line=1, lines=5, owner=None, ord=0):
    module, name = sid.split(":")
    return (sid, module, name, kind, "", line, lines, name.split(".")[-1].startswith("_"), owner, ord)


def arg(text="x", literal=False, value=None, boolean=False, name=None, attr_of=None, names=None):
    return (text, literal, value, boolean, name, attr_of, names or ([name] if name else []))


def call(name, args=(), keywords=(), spreads=False, dropped=False, in_tests=False, file="a.py", line=1):
    return (name, file, line, list(args), [tuple(k) for k in keywords], spreads, dropped, in_tests)


def fn(sid, params=(), defaults=(), flags=(), decorated=False, stub=False, returns=False, loads=None, relayed=(), sole=None, first_if=None, shape=None, reads=None, notes=None, calls=()):
    return (sid, sid.split(":")[1], list(params), list(params), [tuple(d) for d in defaults], list(flags), decorated, stub, returns, loads or {}, list(relayed), sole, first_if, shape, reads or {}, notes or {}, list(calls), 0)


def facts(spark, rules=Project(), **rows):
    modules = rows.pop("modules", None) or sorted({s[1] for s in rows.get("symbols", [])})
    rows["modules"] = [(m, f"{m.replace('.', '/')}.py", 10, i) for i, m in enumerate(modules)]
    rows["calls"] = [(i, *c) for i, c in enumerate(rows.get("calls", []))]
    return Facts.of(spark, rows, rules)


def found(check, f):
    return sorted((r.symbol, r.key) for r in checks.CHECKS[check](f).collect())


def test_dead_and_tests_only(spark):
    f = facts(
        spark, Project(keep=frozenset({"kept"})),
        symbols=[sym("a:gone"), sym("a:door"), sym("a:__all__"), sym("a:kept"), sym("a:read"), sym("a:main"), sym("a:deco"), sym("a:used"), sym("a:tested"), sym("a:C", "class"), sym("a:C.m", "method", owner="a:C")],
        functions=[fn("a:gone"), fn("a:main"), fn("a:deco", decorated=True), fn("a:tested"), fn("a:C.m")], classes=[("a:C", [], ["Base"], True, True, False, 0)],
        entrypoints=[("a:door",)], uses=[("a:used", "a:gone")], name_counts=[("package", "read", 1), ("tests", "tested", 2)], test_uses=[("tested", "t.py", 3, 1, 9), ("tested", "u.py", 4, 1, 9)],
    )
    assert found("dead", f) == [("a:gone", "")]
    assert found("tests_only", f) == [("a:tested", "")]
    assert len(checks.tests_only(f).first().sites) == 2


def test_forward(spark):
    to = lambda **k: call("g", [arg(name="x"), arg(name="y")], **k)
    f = facts(
        spark, symbols=[sym("a:f"), sym("a:g"), sym("a:drops"), sym("a:spread"), sym("a:none"), sym("a:B", "class"), sym("a:B.m", "method", owner="a:B"), sym("a:D", "class"), sym("a:D.m", "method", owner="a:D")],
        functions=[fn("a:f", "xy", sole=to()), fn("a:g", "xy"), fn("a:drops", "xyz", sole=to()), fn("a:spread", "xy", sole=to(spreads=True)), fn("a:none", (), sole=call("g")), fn("a:B.m"), fn("a:D.m", "xy", sole=to())],
        classes=[("a:B", [], [], False, False, False, 0), ("a:D", [], ["B"], False, False, False, 1)], call_edges=[(s, "a:g", [1]) for s in ("a:f", "a:drops", "a:spread", "a:none", "a:D.m")],
    )
    assert found("forward", f) == [("a:f", "")]


def test_tunnel(spark):
    names = ["a:f1", "a:f2", "a:f3", "a:end", "a:other"]
    f = facts(spark, symbols=[sym(s, line=i) for i, s in enumerate(names)], functions=[fn(s, "p", relayed="p" if s != "a:end" else ()) for s in names], call_edges=[("a:f1", "a:f2", [1]), ("a:f2", "a:f3", [1]), ("a:f3", "a:end", [1]), ("a:other", "a:end", [1])])
    assert found("tunnel", f) == [("a:f1", "p")]
    assert checks.tunnel(f).first().related == ["a:f2", "a:f3", "a:end"]


def test_private_home_and_flags(spark):
    t = [call("run", [arg("True", True, "True", True)])]
    f = facts(
        spark, symbols=[sym("a:_x"), sym("a:_home"), sym("b:user"), sym("a:run"), sym("a:pub"), sym("a:handed")],
        functions=[fn("a:run", ["flag"], flags=["flag"], first_if=("flag", 2, 3)), fn("a:pub"), fn("a:handed"), fn("b:user"), fn("a:_x"), fn("a:_home")],
        uses=[("a:_x", "b:user"), ("a:_home", "a:run"), ("a:pub", "a:run"), ("a:handed", "a:run"), ("a:run", "b:user")], calls=t, names=[("handed", "a", "handed")],
    )
    assert found("private_abroad", f) == [("a:_x", "")]
    assert found("home_only_public", f) == [("a:pub", "")]
    assert found("bool_flag", f) == [("a:run", "flag")]


def test_imports(spark):
    imports = [("ui.p", "db.q", 3, 0), ("db.q", "ui.p", 5, 1), ("db.q", "core.r", 6, 2)]
    f = facts(spark, Project(package_dir=Path("/x/pkg"), layers=("core", "db", "ui"), forbid={"db": ("requests", "pkg.ui")}), modules=["core.r", "db.q", "ui.p"], imports=imports, externals=[("db.q", "requests", 1, 0), ("db.q", "requestsx", 1, 1), ("ui.p", "requests", 1, 2)])
    assert found("cycle", f) == [("db.q", "")]
    assert found("layer", f) == [("db.q", "ui.p")]
    assert found("forbid", f) == [("db.q", "pkg.ui.p"), ("db.q", "requests")]


def test_clump(spark):
    given = lambda to: [call(to, [arg(name=n) for n in "abc"])]
    f = facts(spark, symbols=[sym("m:f"), sym("m:g"), sym("m:h"), sym("m:two")], functions=[fn("m:f", "abc", calls=given("g")), fn("m:g", "abc", calls=given("h")), fn("m:h", "abc"), fn("m:two", "ab", calls=[call("h", [arg(name="a"), arg(name="b")])])], call_edges=[("m:f", "m:g", [1]), ("m:g", "m:h", [1]), ("m:two", "m:h", [1])])
    assert found("clump", f) == [("m:f", "a+b+c")]
    star = facts(spark, symbols=[sym("m:f"), sym("m:g"), sym("m:h")], functions=[fn("m:f", "abc", calls=given("g") + given("h")), fn("m:g", "abc"), fn("m:h", "abc")], call_edges=[("m:f", "m:g", [1]), ("m:f", "m:h", [1])])
    assert found("clump", star) == []


def test_calls_by_name(spark):
    one, true = arg("1", True, "int 1"), arg("True", True, "bool True", True)
    f = facts(
        spark, symbols=[sym(f"a:{n}") for n in ("same", "mixed", "drop", "deflt", "unread", "stub")],
        functions=[fn("a:same", "p"), fn("a:mixed", "p"), fn("a:drop", returns=True), fn("a:deflt", "pq", defaults=[("q", "2")]), fn("a:unread", ["p", "_u", "r"], loads={"p": 1}), fn("a:stub", "p", stub=True)],
        calls=[call("same", [one]), call("same", [one]), call("mixed", [one]), call("mixed", [true]), call("drop", dropped=True), call("drop", dropped=True, in_tests=True), call("deflt", [one], in_tests=True), call("unread", [one]), call("stub", [one])],
    )
    assert found("constant_param", f) == [("a:same", "p=1")]
    assert found("ignored_return", f) == [("a:drop", "")]
    assert found("unused_default", f) == [("a:deflt", "q")]
    assert ("a:unread", "r") in found("unused_param", f) and not [x for x in found("unused_param", f) if x[0] == "a:stub" or x[1] in ("p", "_u") and x[0] == "a:unread"]


def test_classes(spark):
    two = [("x", "int"), ("y", "int")]
    f = facts(
        spark, symbols=[sym("a:P", "class", ord=1), sym("a:Q", "class", ord=2), sym("b.m:R", "class", ord=3), sym("a:Abs", "class", ord=4), sym("a:Impl", "class", ord=5), sym("a:Impl.go", "method", owner="a:Impl"), sym("a:T", "class", ord=6), sym("a:T.envy", "method", owner="a:T")],
        classes=[("a:P", two, [], False, False, False, 1), ("a:Q", two[::-1], [], False, False, False, 2), ("b.m:R", two, [], False, False, False, 3), ("a:Abs", [], ["ABC"], False, False, True, 4), ("a:Impl", [("z", "int")], ["Abs"], False, False, False, 5), ("a:T", [], [], False, False, False, 6)],
        functions=[fn("a:Impl.go"), fn("a:T.envy", ["other"], reads={"other": 5, "self": 2}, notes={"other": "Impl"})], names=[("attribute_reads", "a", "x"), ("attribute_reads", "a", "y")],
    )
    assert found("twin_shapes", f) == [("a:Q", "")]
    assert found("unread_field", f) == [("a:Impl", "z")]
    assert found("single_implementation", f) == [("a:Abs", "")]
    assert found("feature_envy", f) == [("a:T.envy", "other")]


def test_duplicate_scattered_unstable_hub_shotgun(spark):
    mods = ["hub", *[f"u{i}" for i in range(10)], *[f"d{i}" for i in range(10)], "x.a", "y.b"]
    imports = [(f"u{i}", "hub", 1, i) for i in range(10)] + [("hub", f"d{i}", 1, 20 + i) for i in range(10)] + [("d0", f"d{i}", 2, 40 + i) for i in range(1, 10)]
    commits = [(f"h{i}", "s", i, n) for i in range(5) for n in ("x/a.py", "y/b.py")]
    f = facts(
        spark, modules=mods, symbols=[*(sym(f"hub:n{i}") for i in range(10)), sym("x.a:dup", line=1), sym("y.b:dup2", line=2)], functions=[fn("x.a:dup", shape="s"), fn("y.b:dup2", shape="s")], imports=imports, taken=[(f"u{i}", "hub", "n0") for i in range(10)],
        library_calls=[("np.dot", m, 1, False, i) for i, m in enumerate(["u0", "u1", "u2", "x.a", "y.b"])] + [("lib.field", m, 1, False, 9) for m in mods[:8]], commit_files=commits,
    )
    assert found("duplicate", f) == [("x.a:dup", "")]
    assert found("scattered_api", f) == [("u0", "np.dot")]
    assert found("hub", f) == [("hub", "")]
    assert found("shotgun", f) == [("x.a", "y.b")]
    assert found("unstable_dependency", f) == [("hub", "d0")]


def test_all_findings_skips_and_score(spark):
    f = facts(spark, symbols=[sym("a:gone"), sym("b:gone2")], functions=[fn("a:gone"), fn("b:gone2")])
    rows = checks.ordered(checks.excused(checks.all_findings(f), [Skip("b*", "generated")])).collect()
    assert [(r.check, r.symbol, r.why) for r in rows] == [("dead", "a:gone", None), ("dead", "b:gone2", "generated")]
    kept = checks.excused(checks.all_findings(f), []).drop("why")
    hops = spark.createDataFrame([("a:gone", 12), ("b:gone2", 3)], "door string, hops int")
    values = {r.key: r.value for r in score(f, kept, hops).collect()}
    assert values["direct"] == 50 and values["alive"] == 0 and values["lean"] == 100 and values["overall"] == round((50 + 0 + 400) / 6)
    assert score(f, kept, hops.limit(0)).where("key = 'direct'").first().value == 100


@pytest.mark.parametrize("limit", [10_000, 0])
def test_strong_components_both_ways(spark, limit, monkeypatch):
    monkeypatch.setattr(graph, "ONE_TASK", limit)
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 1)], "src int, dst int")
    assert {(r.node, r.component) for r in graph.strong_components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)}


def test_chains_on_rings_and_without(spark):
    dag = spark.createDataFrame([("d", "a"), ("d", "b"), ("a", "c"), ("b", "c")], "src string, dst string")
    doors = spark.createDataFrame([("d",), ("lone",)], "node string")
    assert {(r.door, r.hops, tuple(r.path)) for r in graph.longest_chains(dag, doors).collect()} == {("d", 2, ("d", "a", "c")), ("lone", 0, ("lone",))}
    ring = dag.union(spark.createDataFrame([("c", "a")], dag.schema))
    assert {(r.door, tuple(r.path)) for r in graph.longest_chains(ring, doors).collect()} == {("d", ("d", "b", "c", "a")), ("lone", ("lone",))}
    assert {(r.node, r.layer) for r in graph.layers(ring).collect()} == {("a", 0), ("c", 0), ("b", 1), ("d", 2)}
    lines = ring.selectExpr("src", "dst", "array(1) lines")
    assert [(r.depth, r.node, r.seen) for r in graph.call_tree(lines, doors.limit(1)).orderBy("pre_order").collect()] == [(0, "d", False), (1, "a", False), (2, "c", False), (3, "a", True), (1, "b", False), (2, "c", True)]
    assert graph.flow(dag, ["d", "b", "c"]).first().path == ["d", "b", "c"]


def test_beaten_groups_equal_brute_force(spark):
    """Groups of one key share no members; one is beaten by a group of more names, its own among them, that holds all its members."""
    rng = random.Random(5)
    groups = []
    for names in ("abc", "abd", "abcd", "abcde", "xyz", "wxyz"):
        nodes = [f"n{i:02}" for i in range(16)]
        rng.shuffle(nodes)
        if names in ("abcd", "wxyz"):
            nodes = [*sorted(nodes)]
        for at in range(0, 16, size := len(names) if rng.random() < 0.5 else 8):
            groups.append((names, sorted(nodes[at : at + size])))
    rows = [("+".join(names), min(m), list(names), len(m), n) for names, m in groups for n in m]
    members = spark.createDataFrame(rows, "key string, component string, names array<string>, size long, node string")
    want = {("+".join(n), min(m)) for n, m in groups if any(len(n2) > len(n) and set(n) <= set(n2) and set(m) <= set(m2) for n2, m2 in groups)}
    assert want and {tuple(r) for r in checks._beaten(members).collect()} == want


def test_kept_names_may_be_a_table(spark):
    """Names that grow with the tables stay on executors."""
    rules = check_queries._rules(spark, "/root/testdata/sf0.001", "dead")
    names = {r.name for r in Facts(spark, {}).named(rules.keep, "last").select(F.col("last").alias("name")).collect()}
    assert not isinstance(rules.keep, frozenset) and names and all(n.startswith("f") for n in names)


def test_files_count_as_large_as_they_are_while_checks_run(spark, monkeypatch):
    seen, name = [], "spark.sql.sources.fileCompressionFactor"
    monkeypatch.setitem(checks.CHECKS, "dead", lambda f: seen.append(spark.conf.get(name)) or checks.empty(f))
    assert checks.all_findings(facts(spark), ["dead"]).count() == 0
    assert seen == [checks.UNPACKED] and spark.conf.get(name) == "1.0"
