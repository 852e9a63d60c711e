"""From source files to facts, findings and reports; rules; streams."""

import json
import subprocess
import time

import pytest
from crossfile.functions.scalars import glob_regex
from crossfile.plans import checks, report
from crossfile.rules import project_for
from crossfile.sources import json_facts, python_source
from crossfile.sources.script import Script
from crossfile.streaming.diff import told
from crossfile.streaming.watch import changes, last_good, quiet, recompute, versions, wait
from pyspark.sql import functions as F

FILES = {
    "pkg/__init__.py": "",
    "pkg/core.py": '"""Core."""\nLIMIT = 3\n\n\nclass Gate:\n    """A gate."""\n\n    size: int = 1\n\n    def open(self, key, hard=False):\n        if hard:\n            return None\n        return key\n\n\ndef make(key) -> Gate:\n    return Gate()\n\n\ndef orphan():\n    pass\n',
    "pkg/web/app.py": "from pkg.core import Gate, make\nfrom pkg import core\nimport requests\n\n\n@app.get('/')\ndef index(key):\n    gate = make(key)\n    gate.open(key, True)\n    return core.make(key)\n\n\ndef tool(x):\n    return requests.get(x)\n",
    "tests/test_core.py": "from pkg.core import orphan\n\n\ndef test_it():\n    assert orphan() is None\n",
    "tests/broken.py": "def (",
    "pyproject.toml": '[project.scripts]\nrun = "pkg.web.app:tool"\n[tool.crossfile]\nlayers = ["core", "web"]\nskip = [{path = "pkg/core*", why = "old", checks = ["bool_flag"]}]\n',
}


@pytest.fixture(scope="module")
def project(tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    for name, text in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    git = lambda *a: subprocess.run(["git", "-c", "user.name=x", "-c", "user.email=x@example.com", *a], cwd=root, check=True, capture_output=True)
    git("init", "-q"), git("add", "."), git("commit", "-qm", "first thing")
    return root


@pytest.fixture(scope="module")
def facts(spark, project):
    rules = project_for(project)
    return python_source.read(spark, rules.package_dir, rules)


def test_facts_of_sources(facts):
    assert {r.module for r in facts.modules.collect()} == {"core", "web.app"}
    assert {(r.sid, r.kind) for r in facts.symbols.collect()} == {("core:LIMIT", "constant"), ("core:Gate", "class"), ("core:Gate.open", "method"), ("core:make", "function"), ("core:orphan", "function"), ("web.app:index", "function"), ("web.app:tool", "function")}
    edges = {(r.caller, r.callee): r.lines for r in facts.call_edges.collect()}
    assert edges == {("web.app:index", "core:make"): [8, 10], ("web.app:index", "core:Gate.open"): [9], ("core:make", "core:Gate"): [17]}
    assert {(r.module, r.target, r.line) for r in facts.imports.collect()} == {("web.app", "core", 1)}
    assert {(r.module, r.target) for r in facts.externals.collect()} == {("web.app", "requests")}
    assert {r.sid for r in facts.entrypoints.collect()} == {"web.app:index", "web.app:tool"}
    assert {r.api for r in facts.library_calls.collect()} == {"requests.get"}
    assert {r.file for r in facts.commit_files.collect()} == {"pkg/core.py", "pkg/web/app.py", "pkg/__init__.py"}
    f = facts.functions.where("sid = 'core:Gate.open'").first()
    assert f.params == ["key", "hard"] and f.flags == ["hard"] and f.first_if.name == "hard" and f.returns_value


def test_reading(spark, facts, project, tmp_path):
    r = report.reading(facts)
    rows = {(x.check, x.symbol): x.why for x in r.found.collect()}
    assert rows[("tests_only", "core:orphan")] is None and rows[("bool_flag", "core:Gate.open")] == "old"
    assert {(x.door, x.hops) for x in r.chains.collect()} == {("web.app:index", 1), ("web.app:tool", 0)}
    assert "Kept by tests (1)" in report.markdown(r)
    page = json.loads(json.dumps(report.payload(r)))
    assert page["score"]["overall"] and {m["module"]: m["layer"] for m in page["modules"]} == {"core": 0, "web.app": 1}
    assert [x["node"] for x in page["hops"][0]["tree"]] == ["web.app:index", "core:make", "core:Gate.open"]
    assert {x["check"] for x in report.check_json(r)["findings"]} == {x.check for x in r.rows() if x.why is None}
    assert [s["path"] for s in page["skipped"]] == ["pkg/core*"] and "excused in pkg/core*: old" in report.check_text(r)[1][-1]
    assert [(x.door, x.hops) for x in report.reach(facts, "make").collect()] == [("web.app:index", 1)]
    about = report.about_file(r, "pkg/core.py")
    assert {x.id for x in about} == {x.id for x in r.rows() if x.why is None and x.file == "pkg/core.py"} and "tests_only:core:orphan" in {x.id for x in about}
    said = report.note("f", about[:2], {"dead:x", about[1].id})
    assert said == "1 new in f:\n  " + f"{about[0].file}:{about[0].line}: {about[0].check}: {about[0].message}: {about[0].fix}" + "\nfixed 1 in f: dead"
    assert "core:make" in report.flow_text(facts, ["index", "make"])
    json_facts.write(facts, str(tmp_path / "facts"))
    again = json_facts.read(spark, str(tmp_path / "facts"), facts.rules)
    assert again.symbols.count() == facts.symbols.count()
    assert sorted(r.id for r in checks.tests_only(again).collect()) == sorted(r.id for r in checks.tests_only(facts).collect())


def test_rules_and_globs(project, tmp_path):
    rules = project_for(project)
    assert rules.entries == {"tool"} and rules.layers == ("core", "web")
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "__init__.py").write_text("")
    (tmp_path / "pyproject.toml").write_text('[tool.crossfile]\nskip = [{path = "x"}]\n')
    with pytest.raises(ValueError):
        project_for(tmp_path)
    import re

    assert re.search(glob_regex("a/*.py"), "a/b/c.py") and not re.search(glob_regex("a?[!b].py"), "axb.py")


def test_told_stream(spark, tmp_path):
    rows = [("p", "f", 1, "a"), ("p", "f", 1, "b"), ("p", "f", 2, "b"), ("p", "f", 3, None), ("p", "g", 1, "z")]
    for i, (r,) in enumerate(((r,) for r in ([x for x in rows if x[2] == k] for k in (1, 2, 3)))):
        spark.createDataFrame(r, "package string, file string, reading int, id string").coalesce(1).write.json(str(tmp_path / "in" / str(i)))
    stream = spark.readStream.schema("package string, file string, reading int, id string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in" / "*"))
    q = told(stream).writeStream.format("memory").queryName("told").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.file, r.reading): (r.new, r.fixed) for r in spark.table("told").collect()}
    assert got == {("f", 1): (["a", "b"], []), ("f", 2): ([], ["a"]), ("f", 3): ([], ["b"]), ("g", 1): (["z"], [])}


def test_saves_close_their_burst(spark, tmp_path):
    """A file saved twice is two bursts, the second without any later save; a reading that fails leaves the last good one."""
    folder, out = tmp_path / "pkg", str(tmp_path / "out")
    folder.mkdir()
    (folder / "a.py").write_text("x = 1\n")

    def read():
        if "(" in (folder / "a.py").read_text():
            raise ValueError("a.py can't be read")
        return spark.createDataFrame([((folder / "a.py").read_text(),)], "text string")

    q = recompute(quiet(changes(spark, str(folder))), read, out, str(tmp_path / "c"))
    said = lambda: versions(spark, out).orderBy("version").collect() if (tmp_path / "out" / "versions").exists() else []
    try:
        for i, text in enumerate(("x = 2222\n", "def (", "x = 333\n")):
            time.sleep(2 if i else 8)  # the stream has begun
            (folder / "a.py").write_text(text)
            if i == 0:
                (folder / "_b.py").write_text("")
            assert wait(q, lambda n=i + 1: len(said()) >= n, 60), q.exception()
            assert [r.good for r in said()] == [True, False, True][: i + 1]
            assert last_good(spark, out).first().text == ("x = 333\n" if i == 2 else "x = 2222\n")
    finally:
        q.stop()
    assert said()[1].error.endswith("a.py can't be read")


READER = {
    "pkg/__init__.py": "import os\n",
    "pkg/__main__.py": "from pkg._b import helper\n\nhelper()()(5)\n",
    "pkg/_b.py": "from abc import ABC\n\n\nclass Base(ABC):\n    pass\n\n\nclass Own:\n    pass\n\n\nclass Child(Own):\n    pass\n\n\ndef helper(a=np.linalg.norm(), b=True, *, c):\n    return lambda: np.zeros(a)\n",
    "pkg/_inner/c.py": "import numpy as np\n\n\ndef f(a, b):\n    np.linalg.norm(a)\n    return np.zeros(b)\n\n\ndef f(a, c=np.eye(2)):\n    def g():\n        np.ones(a)\n    yield c\n\n\nclass __T:\n    pass\n",
}


@pytest.mark.parametrize("above", ["", "src/"])
def test_reader_reads_every_file(spark, tmp_path, above):
    for name, text in READER.items():
        (tmp_path / above / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / above / name).write_text(text)
    (tmp_path / "tests").mkdir()
    (tmp_path / "tests" / "_test_a.py").write_text("from pkg._b import Own\n\n\ndef test_a():\n    Own()\n")
    f = python_source.read(spark, tmp_path / above / "pkg")
    assert {r.module for r in f.modules.collect()} == {"__main__", "_b", "_inner.c"}
    assert {(r.name, r.file, r.start, r.end) for r in f.test_uses.collect()} == {("Own", ("../" if above else "") + "tests/_test_a.py", 1, 1), ("Own", ("../" if above else "") + "tests/_test_a.py", 4, 5)}
    assert {r.sid: r.library_base for r in f.classes.collect()} == {"_b:Base": True, "_b:Own": False, "_b:Child": False, "_inner.c:__T": False}
    named = sorted((r.name, len(r.args)) for r in f.calls.where("file like '%__main__.py'").collect())
    assert named == [("", 0), ("", 1), ("helper", 0)]  # what a call gives has no name
    assert sorted((r.api, r.line) for r in f.library_calls.collect()) == [("np.ones", 11), ("np.ones", 11), ("np.zeros", 6)]  # bodies alone; once for each around
    f2 = f.functions.where("sid = '_inner.c:f'").collect()
    assert [(x.params, x.returns_value) for x in f2] == [(["a", "c"], False)]  # the later one
    h = f.functions.where("sid = '_b:helper'").first()
    assert h.params == ["a", "b", "c"] and h.flags == ["c"] and [d.text for d in h.defaults] == ["np.linalg.norm()", "True"] and h.returns_value
    assert checks.is_dunder(F.lit("__T")) is not None and f.symbols.where(checks.is_dunder(F.col("name"))).count() == 1
    with pytest.raises(ValueError):
        python_source.read(spark, tmp_path / "tests" / "none")


def test_shapes():
    body = "    total = 0\n    for x in {a}:\n        total += x * 2 + len({a}) - max(x, 3)\n    if total > 10:\n        print(total)\n    return total + 1\n"
    shape = lambda text: next(iter(Script("m", "m.py", text, "p").functions().values()))
    of = lambda text: Script("m", "m.py", text, "p").function(shape(text))["shape"]
    one = of("def f(a):\n" + body.format(a="a"))
    assert one and one == of("def g(z):\n" + body.format(a="z").replace("total", "sum_"))
    assert one != of("def g(z, y):\n" + body.format(a="z")) and one != of("def f(a):\n" + body.format(a="a").replace("10", "11"))
    assert of("def f(a):\n    return a\n") is None
