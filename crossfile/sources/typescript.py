"""Facts of a TypeScript project, without node: files are parsed on the executors, and what their names mean is found by joins.

Names that stand for others (imports, exports, re-exports, `export *`) are links, collapsed to their ends. What a class inherits is found
along its bases in any file. Uses and calls are chains of steps from such a name, or from `this`; each round takes one step of all chains.
Types are followed as far as they are written (annotations, `new`, what functions say they return or plainly return, two rounds deep), so
what only a type checker knows stays unresolved: generics, callbacks, narrowing, types of libraries. A call of something that isn't the
project's counts as worth a value.
"""

from __future__ import annotations

import json
import os
import posixpath
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pyarrow as pa
from crossfile.facts import Facts
from crossfile.operators.alias import above, collapsed, spread
from crossfile.operators.lineage import cut
from crossfile.rules import Project
from crossfile.schemas import TABLES
from crossfile.ship import ship
from crossfile.sources.files import sources
from crossfile.sources.gitlog import commit_files
from crossfile.sources.python_source import PLACES, ROWS, _batch
from crossfile.sources.ts_facts import TsScript
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SUFFIXES = (".ts", ".tsx", ".mts", ".cts")
#: Folders of tests, and files that are tests wherever they stand. Fixed values.
TEST_FOLDERS, TEST_FILE = ("test", "tests", "__tests__"), r"\.(test|spec)\.[cm]?tsx?$"
#: What a specifier without an extension may mean, in order.
TRIED = (".ts", ".tsx", ".d.ts", "/index.ts", "/index.tsx", "/index.d.ts")
#: Extensions of what is compiled, and what it is compiled from.
COMPILED = {".js": (".ts", ".tsx", ".d.ts"), ".jsx": (".tsx",), ".mjs": (".mts",), ".cjs": (".cts",)}
#: Tables written at a time.
AT_A_TIME = 8
CHAIN = "array<string>"
#: Facts that are told to be resolved.
TOLD = {
    "use": f"module string, scope string, line int, chain {CHAIN}",
    "binding": "module string, file string, local string, spec string, name string",
    "export": "module string, file string, name string, local string, spec string, of string",
    "star": "module string, file string, spec string",
    "spec": "module string, file string, spec string, line int, names array<string>",
    "base": f"module string, sid string, chain {CHAIN}",
    "member": f"module string, owner string, name string, sid string, chain {CHAIN}",
    "returns": f"module string, sid string, chain {CHAIN}, calls array<{CHAIN}>",
    "library_calls": "api string, module string, line int, raised_or_returned boolean, file string, spec string",
}


def project_folder(sources_: Path) -> Path:
    """The nearest folder with a package.json and a tsconfig.json."""
    found = next((d for d in (sources_, *sources_.parents) if (d / "package.json").is_file() and (d / "tsconfig.json").is_file()), None)
    if found is None:
        raise ValueError(f"no package.json with a tsconfig.json beside it above {sources_}")
    return found


def loose_json(text: str) -> dict:
    """JSON with comments and trailing commas, as tsconfig.json may have them."""
    text = re.sub(r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*[\s\S]*?\*/', lambda m: m.group(1) or "", text)
    found = json.loads(re.sub(r'("(?:[^"\\]|\\.)*")|,(?=\s*[}\]])', lambda m: m.group(1) or "", text))
    return found if isinstance(found, dict) else {}


def paths_of(project: Path) -> tuple[str | None, list[tuple[str, list[str]]]]:
    """(baseUrl, paths) of tsconfig.json and those it extends, from the project's folder; patterns of the longest prefix first."""
    at, base, paths = project / "tsconfig.json", None, None
    seen: set[Path] = set()
    while at is not None and at.is_file() and at not in seen:
        seen.add(at)
        try:
            config = loose_json(at.read_text(encoding="utf-8"))
        except (OSError, ValueError):
            break
        options = config.get("compilerOptions") or {}
        here = os.path.relpath(at.parent, project)
        own = posixpath.normpath(posixpath.join(here, options["baseUrl"])) if isinstance(options.get("baseUrl"), str) else None
        if paths is None and isinstance(options.get("paths"), dict):
            paths = {k: [posixpath.normpath(posixpath.join(own or here, x)) for x in v] for k, v in options["paths"].items() if isinstance(v, list)}
        base = base or own
        more = config.get("extends")
        at = (at.parent / more if more.endswith(".json") else at.parent / f"{more}.json") if isinstance(more, str) and more.startswith(".") else None
    return base, sorted((paths or {}).items(), key=lambda p: (-len(p[0].partition("*")[0]), "*" in p[0]))


def candidates(file: str, spec: str, base: str | None, paths: list[tuple[str, list[str]]]) -> list[str]:
    """Files, from the project's folder, that a specifier of a file may mean, in order."""
    stems = []
    if spec.startswith("."):
        stems = [posixpath.join(posixpath.dirname(file), spec)]
    else:
        for pattern, found in paths:
            head, star, tail = pattern.partition("*")
            if spec == pattern or star and spec.startswith(head) and spec.endswith(tail) and len(spec) >= len(head) + len(tail):
                stems = [x.replace("*", spec[len(head) : len(spec) - len(tail)], 1) for x in found]
                break
        if base is not None:
            stems.append(posixpath.join(base, spec))
    out = []
    for stem in map(posixpath.normpath, stems):
        root, ext = posixpath.splitext(stem)
        out += [root + x for x in COMPILED.get(ext, ())] + ([stem] if ext in SUFFIXES else []) + [stem + x for x in TRIED]
    return out


def files(spark: SparkSession, folder: Path, project: Path) -> DataFrame:
    """place, module, file (from the project's folder), content and test of sources and tests; declarations (.d.ts) aren't read."""

    def below(at: Path, test: Column, first: int) -> DataFrame:
        found = sources(spark, at, SUFFIXES, ("node_modules",), hidden=False).where(~F.endswith("name", F.lit(".d.ts")) & ~F.col("name").rlike(r"\.d\.[cm]ts$"))
        here = os.path.relpath(at, project)
        file = F.col("name") if here == "." else F.concat(F.lit(here + "/"), "name")
        module = F.replace(F.regexp_replace("name", r"\.[cm]?tsx?$", ""), F.lit("/"), F.lit("."))
        return found.select((F.col("place") + F.lit(first)).alias("place"), module.alias("module"), file.alias("file"), "content", test.alias("test"))

    own = below(folder, F.col("name").rlike(TEST_FILE), 0)
    tests = next((project / n for n in TEST_FOLDERS if (project / n).is_dir()), None)
    if tests is None or tests == folder or folder in tests.parents:
        return own if tests is None else own.withColumn("test", F.col("test") | F.startswith("file", F.lit(os.path.relpath(tests, project) + "/")))
    return own.union(below(tests, F.lit(True), 1 << 30))


def parsed(found: DataFrame) -> DataFrame:
    """ROWS of every file. What can't be read of a file is left out of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sys

        sys.setrecursionlimit(max(sys.getrecursionlimit(), 20_000))
        for b in batches:
            for place, module, file, content, test in zip(*(c.to_pylist() for c in b.columns), strict=True):
                script = TsScript(module, file, content.decode("utf-8", "replace").lstrip("﻿"), test)
                yield _batch([(fact, place * PLACES + k, row) for k, (fact, row) in enumerate(script.rows())])

    return found.mapInArrow(run, ROWS)


def targets(own: dict[str, DataFrame], modules: DataFrame, base: str | None, paths: list[tuple[str, list[str]]]) -> DataFrame:
    """(file, spec, target): the module that each specifier of a file means, if it is one of the project's."""
    asked = [own[n].select("file", "spec").where("spec is not null") for n in ("spec", "binding", "export", "star", "library_calls")]
    every = asked[0]
    for a in asked[1:]:
        every = every.union(a)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(f, s, i, c) for f, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for i, c in enumerate(candidates(f, s, base, paths))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int32(), pa.string()))], ["file", "spec", "i", "at"])

    tried = every.distinct().mapInArrow(run, "file string, spec string, i int, at string")
    met = tried.join(modules.select(F.col("file").alias("at"), F.col("module").alias("target")), "at")
    return met.groupBy("file", "spec").agg(F.min_by("target", "i").alias("target"))


def local(module: Column | str, name: Column | str) -> Column:
    return F.concat_ws("\n", F.lit("local"), module, name)


def exported(module: Column | str, name: Column | str) -> Column:
    return F.concat_ws("\n", F.lit("export"), module, name)


def links(own: dict[str, DataFrame], symbols: DataFrame, to: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links from names to what they stand for, (module, name) of everything a module exports). Ends are `symbol` or `module` and its name."""
    end = lambda kind, name: F.concat_ws("\n", F.lit(kind), name)
    there = lambda of: F.when(F.col(of) == "*", end("module", "target")).otherwise(exported("target", of))
    tops = symbols.where("owner is null").select(local("module", "name").alias("node"), end("symbol", "sid").alias("to"))
    bound = own["binding"].join(to, ["file", "spec"]).select(local("module", "local").alias("node"), there("name").alias("to")).join(tops.select("node"), "node", "left_anti")
    given = own["export"].join(to, ["file", "spec"], "left").where("spec is null or target is not null")
    named = given.select("module", "name", F.when(F.col("spec").isNull(), local("module", "local")).otherwise(there("of")).alias("to"))
    stars = own["star"].join(to, ["file", "spec"]).groupBy(F.col("module").alias("place"), F.col("target").alias("of")).agg(F.min("ord").alias("ord"))
    all_names = cut(spread(named.select(F.col("module").alias("place"), "name"), stars, "default"))
    through = all_names.where("via is not null").select(exported("place", "name").alias("node"), exported("via", "name").alias("to"))
    return tops.union(bound).union(named.select(exported("module", "name").alias("node"), "to")).union(through), all_names.select(F.col("place").alias("module"), "name")


def follow(chains: DataFrame, ends: DataFrame, moves: DataFrame, base: DataFrame) -> DataFrame:
    """(id, sid, at): where the chains (id, module, chain) lead: the symbol that the last step names, and the place reached: a class
    (`symbol`), one of its instances (`has`), or a module. Chains that lead nowhere are left out."""
    head = F.get("chain", F.lit(0))
    node = F.when(head == "name", local("module", F.get("chain", F.lit(1)))).when(head == "export", exported("module", F.get("chain", F.lit(1))))
    of = F.get("chain", F.lit(1))
    rest = F.expr("slice(chain, 3, size(chain))")
    named = chains.where(head.isin("name", "export")).select("id", node.alias("node"), rest.alias("rest")).join(ends, "node").select("id", F.col("end").alias("at"), "rest")
    this = chains.where(head == "this").select("id", F.concat_ws("\n", F.lit("has"), of).alias("at"), rest.alias("rest"))
    super_ = chains.where(head == "super").select("id", of.alias("class"), rest.alias("rest")).join(base, "class").select("id", F.concat_ws("\n", F.lit("has"), "up").alias("at"), "rest")
    symbol = F.when(F.startswith("at", F.lit("symbol\n")), F.substring_index("at", "\n", -1))
    left = cut(named.withColumn("sid", symbol).unionByName(this.union(super_).withColumn("sid", F.lit(None).cast("string"))))
    done = left.where("size(rest) = 0").select("id", "sid", "at")
    left = left.where("size(rest) > 0")
    while not left.isEmpty():
        step = left.select("id", "at", F.get("rest", F.lit(0)).alias("step"), F.expr("slice(rest, 2, size(rest))").alias("rest"))
        left = cut(step.join(moves, ["at", "step"]).select("id", F.col("then").alias("at"), "rest", "sid"))
        done = done.union(left.where("size(rest) = 0").select("id", "sid", "at"))
        left = left.where("size(rest) > 0")
    return cut(done)


class Resolved:
    """What the names of a project mean."""

    def __init__(self, own: dict[str, DataFrame], symbols: DataFrame, to: DataFrame):
        found, self.exports = links(own, symbols, to)
        self.ends = cut(collapsed(found))
        self.own, self.symbols = own, symbols
        classes = symbols.where("kind = 'class'").select("sid")
        at = lambda kind, name: F.concat_ws("\n", F.lit(kind), name)
        held = self.exports.select("module", "name", exported("module", "name").alias("node")).join(self.ends, "node")
        symbol = F.when(F.startswith("end", F.lit("symbol\n")), F.substring_index("end", "\n", -1))
        through = held.select(at("module", "module").alias("at"), F.concat(F.lit("."), "name").alias("step"), symbol.alias("sid"), F.col("end").alias("then"))
        made = classes.select(at("symbol", "sid").alias("at"), F.explode(F.array(F.lit("new"), F.lit("inst"))).alias("step"), F.lit(None).cast("string").alias("sid"), at("has", "sid").alias("then"))
        none = made.select(F.col("sid").alias("class"), F.col("sid").alias("up")).limit(0)
        # Bases, and all above them.
        bases = cut(own["base"].withColumn("id", F.monotonically_increasing_id()))
        led = follow(bases.where("chain is not null").select("id", "module", "chain"), self.ends, through.union(made), none).where("sid is not null")
        self.bases = cut(bases.select("id", F.col("sid").alias("class")).join(led.select("id", F.col("sid").alias("up")), "id", "left").drop("id"))
        base = self.bases.join(classes.select(F.col("sid").alias("up")), "up", "left_semi").select("class", "up")
        self.above = cut(above(base.select(F.col("class").alias("node"), "up")))
        # Members, of the nearest class that has them.
        ranked = self.above.union(classes.select("sid", F.col("sid").alias("up"), F.lit(0).alias("depth")))
        typed_members = own["member"].withColumn("mid", F.monotonically_increasing_id())
        typed_members = cut(typed_members)
        reach = ranked.join(typed_members.select(F.col("owner").alias("up"), "name", "sid", "mid"), "up")
        best = Window.partitionBy("node", "name").orderBy("depth", F.col("sid").isNull(), "mid")
        self.members = cut(reach.withColumn("r", F.row_number().over(best)).where("r = 1").select(F.col("node").alias("class"), "name", "sid", "mid"))
        plain = self._member_moves(self.members.withColumn("type", F.lit(None).cast("string")))
        self.moves = cut(through.union(made).union(plain))
        self.base = base
        # Types of members, and of what functions return: those found first help to find the others.
        told = own["returns"].where("chain is not null").select(F.concat(F.lit("r"), "sid").alias("id"), "module", "chain")
        told = cut(told.union(typed_members.where("chain is not null").select(F.concat(F.lit("m"), F.col("mid").cast("string")).alias("id"), "module", "chain")))
        for _ in range(2):
            types = follow(told, self.ends, self.moves, base).where(F.startswith("at", F.lit("has\n"))).select("id", F.substring_index("at", "\n", -1).alias("type")).distinct()
            given = types.where(F.startswith("id", F.lit("r"))).select(F.substring("id", 2, 1 << 30).alias("sid"), "type")
            back = given.select(at("symbol", "sid").alias("at"), F.explode(F.array(F.lit("()"), F.lit("inst"))).alias("step"), F.lit(None).cast("string").alias("sid"), at("has", "type").alias("then"))
            typed = self.members.join(types.select(F.expr("try_cast(substring(id, 2) as long)").alias("mid"), "type", "id").where(F.startswith("id", F.lit("m"))).drop("id"), "mid", "left")
            self.moves = cut(through.union(made).union(self._member_moves(typed)).union(back))

    @staticmethod
    def _member_moves(members: DataFrame) -> DataFrame:
        """From a class or what has it to a member. One with a type leads on to what has that, any other to itself."""
        place = F.explode(F.array(F.concat_ws("\n", F.lit("symbol"), "class"), F.concat_ws("\n", F.lit("has"), "class")))
        then = F.when(F.col("type").isNotNull(), F.concat_ws("\n", F.lit("has"), "type")).otherwise(F.concat_ws("\n", F.lit("symbol"), F.coalesce("sid", F.lit(""))))
        return members.select(place.alias("at"), F.concat(F.lit("."), "name").alias("step"), "sid", then.alias("then"))

    def symbols_of(self, chains: DataFrame) -> DataFrame:
        """(id, sid) of the chains (id, module, chain) that end at a symbol of the project."""
        return follow(chains, self.ends, self.moves, self.base).where("sid is not null").select("id", "sid")


def entry_patterns(package: dict) -> list[str]:
    """Files that main, module, types and exports of a package.json name; * stands for any path in those of exports."""
    out, todo = [], [package.get(k) for k in ("main", "module", "types", "exports")]
    while todo:
        v = todo.pop(0)
        if isinstance(v, str):
            out.append(posixpath.normpath(v))
        elif isinstance(v, dict):
            todo = [*v.values(), *todo]
        elif isinstance(v, list):
            todo = [*v, *todo]
    return out


def doors(r: Resolved, modules: DataFrame, patterns: list[str]) -> DataFrame:
    """sid of what the entry files export, wherever it is declared, and of the public methods of classes among it."""
    if not patterns:
        return r.symbols.select("sid").limit(0)
    named = F.lit(False)
    for p in patterns:
        head, star, tail = p.partition("*")
        named = named | ((F.startswith("file", F.lit(head)) & F.endswith("file", F.lit(tail)) & (F.length("file") > len(head) + len(tail))) if star else F.col("file") == p)
    entry = modules.where(named).select("module")
    found = r.exports.join(entry, "module", "left_semi").select(exported("module", "name").alias("node")).join(r.ends, "node").where(F.startswith("end", F.lit("symbol\n"))).select(F.substring_index("end", "\n", -1).alias("sid")).distinct()
    methods = r.symbols.where("owner is not null and not private").select("sid", F.col("owner").alias("class")).join(found.select(F.col("sid").alias("class")), "class", "left_semi").select("sid")
    return found.union(methods).distinct()


def read(spark: SparkSession, source_dir: str | Path, rules: Project | None = None) -> Facts:
    """The fact tables of the project whose sources are in a folder."""
    ship(spark)
    folder = Path(source_dir).resolve()
    project = project_folder(folder)
    rules = rules or Project(folder, "typescript")
    rows = cut(parsed(files(spark, folder, project)), by="fact")

    def told(name: str, ddl: str) -> DataFrame:
        ddl = ddl.removesuffix(", ord long")
        return rows.where(F.col("fact") == name).select("ord", F.from_json("row", ddl).alias("r")).select("ord", "r.*")

    own = {n: told(n, ddl) for n, ddl in TOLD.items()}
    modules, symbols = cut(told("modules", "module string, file string, lines int")), cut(told("symbols", TABLES["symbols"]))
    if modules.isEmpty():
        raise ValueError(f"no module in {folder}")
    base, paths = paths_of(project)
    to = cut(targets(own, modules, base, paths))
    r = Resolved(own, symbols, to)
    # Uses and calls.
    use = cut(own["use"].withColumn("id", F.monotonically_increasing_id()))
    led = use.join(r.symbols_of(use.select("id", "module", "chain")), "id")
    led = cut(led.select("sid", "scope", "line"))
    callee = symbols.where("kind in ('function', 'method', 'class')").select("sid")
    calls = led.where("line is not null and not endswith(scope, ':<module>')").join(callee, "sid", "left_semi")
    edges = calls.groupBy(F.col("scope").alias("caller"), F.col("sid").alias("callee")).agg(F.array_sort(F.collect_set("line")).alias("lines"))
    # Imports.
    spec = own["spec"].join(to, ["file", "spec"], "left")
    inner = spec.where("target is not null and target <> module")
    imports = inner.groupBy("module", "target").agg(F.min_by("line", "ord").alias("line"), F.min("ord").alias("ord"))
    part = F.split("spec", "/")
    library = F.when(F.startswith("spec", F.lit("@")), F.concat_ws("/", F.slice(part, 1, 2))).otherwise(part[0])
    outer = spec.where("target is null and not startswith(spec, '.')").withColumn("target", library)
    externals = outer.groupBy("module", "target").agg(F.min_by("line", "ord").alias("line"), F.min("ord").alias("ord"))
    # Library bases: a class with a base that is none of the project's, and all below it.
    foreign = r.bases.where("up is null").select(F.col("class").alias("sid")).distinct()
    below = r.above.join(foreign.select(F.col("sid").alias("up")), "up", "left_semi").select(F.col("node").alias("sid"))
    library_based = foreign.union(below).distinct().withColumn("far", F.lit(True))
    classes = told("classes", TABLES["classes"]).drop("library_base").join(library_based, "sid", "left").withColumn("library_base", F.coalesce("far", F.lit(False)))
    # What functions return that return what another one does.
    asked = own["returns"].where("size(calls) = 1").select(F.col("sid").alias("id"), "module", F.get("calls", F.lit(0)).alias("chain"))
    passed = collapsed(r.symbols_of(asked).select(F.col("id").alias("node"), F.col("sid").alias("to")))
    functions = told("functions", TABLES["functions"])
    worth = functions.select(F.col("sid").alias("end"), F.col("returns_value").alias("theirs"))
    on = passed.join(worth, "end", "left").select(F.col("node").alias("sid"), F.coalesce("theirs", F.lit(True)).alias("theirs"))
    functions = functions.join(on, "sid", "left").withColumn("returns_value", F.coalesce("theirs", "returns_value"))
    package = loose_json((project / "package.json").read_text(encoding="utf-8"))
    tables = {
        "modules": modules, "symbols": symbols, "imports": imports, "externals": externals,
        "taken": inner.select("module", "target", F.explode("names").alias("name")).distinct(),
        "uses": led.where("line is null and sid <> scope").select("sid", "scope").distinct(), "call_edges": edges,
        "calls": told("calls", TABLES["calls"]).withColumn("call_id", F.col("ord")), "functions": functions, "classes": classes,
        "library_calls": own["library_calls"].join(to, ["file", "spec"], "left_anti"), "names": told("names", TABLES["names"]).distinct(),
        "name_counts": told("name_counts", TABLES["name_counts"]).groupBy("scope", "name").agg(F.sum("n").alias("n")), "test_uses": told("test_uses", TABLES["test_uses"]),
        "commit_files": commit_files(spark, folder), "entrypoints": doors(r, modules, entry_patterns(package)),
    }
    kinds = {n: StructType.fromDDL(TABLES[n]) for n in tables}
    with ThreadPoolExecutor(AT_A_TIME) as pool:  # each is too small to keep a cluster busy
        fitted = dict(zip(tables, pool.map(lambda n: cut(tables[n].select(*kinds[n].names).to(kinds[n])), tables), strict=True))
    return Facts(spark, fitted, rules)
