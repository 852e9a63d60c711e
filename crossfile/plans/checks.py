"""The 24 checks: each is one plan from fact tables to findings."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from functools import reduce

from crossfile.facts import Facts
from crossfile.functions.scalars import folder, given, glob_regex, is_dunder, last_name, short
from crossfile.operators import graph
from crossfile.operators.lineage import cut, dealt, drop
from crossfile.plans.extension import registered
from crossfile.schemas import FINDING, SITE
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Names of one call that give a serialiser every field of an object. Fixed values.
SERIALIZERS = ("asdict", "astuple", "vars", "replace", "fields", "model_dump", "dict")
#: Last names of library calls that only set things up. Fixed values.
SETUP_CALLS = ("APIRouter", "ContextVar", "Field", "NewType", "TypeVar", "dataclass", "field", "getLogger")
NEVER_CLUMPED = ("args", "kwargs", "self", "cls")
TUNNEL, CLUMP_NAMES, CLUMP_FUNCTIONS = 3, 3, 3
HUB, HUB_SHARE = 10, 0.2
TOGETHER, TOGETHER_SHARE, SWEEP, HISTORY = 5, 0.75, 20, 1000
PAIRS_A_ROW = 4  # as dealt; in a commit of SWEEP files it is 9.5 at most
SCATTERED_MODULES, SCATTERED_FOLDERS = 5, 2
FAN_IN, MARGIN = 5, 0.4
ENVY = 4
TEST_SITES, SOME_RELATED = 12, 5

_NO_SITES = f"cast(array() as array<{SITE}>)"
_NO_COMMITS = "cast(array() as array<struct<hash:string,subject:string>>)"


def _finding(df: DataFrame, check: str, message: Column, fix: str, key: Column | None = None, related: Column | None = None, sites: Column | None = None, commits: Column | None = None, symbol: str = "sid") -> DataFrame:
    """Columns of FINDING from rows with sid, file, line and, for the order, module and ord."""
    key = F.lit("") if key is None else key
    name = F.concat_ws(":", F.lit(check), F.col(symbol), F.when(key != "", key))
    return df.select(
        name.alias("id"), F.lit(check).alias("check"), F.col(symbol).alias("symbol"), "file", F.col("line").cast("int").alias("line"), message.alias("message"), F.lit(fix).alias("fix"),
        (F.expr("cast(array() as array<string>)") if related is None else related).alias("related"), key.alias("key"),
        (F.expr(_NO_SITES) if sites is None else sites).alias("sites"), (F.expr(_NO_COMMITS) if commits is None else commits).alias("commits"),
    )


def _site(file, line, start=None, end=None) -> Column:
    return F.struct(F.col(file).alias("file"), F.col(line).cast("int").alias("line"), F.col(start or line).cast("int").alias("start"), F.col(end or line).cast("int").alias("end"))


def _module_of(scope: str) -> Column:
    return F.split_part(F.col(scope), F.lit(":"), F.lit(1))


def _unnamed(f: Facts) -> DataFrame:
    """Symbols nobody in the package names: not used, not called, not a door, not kept."""
    read = f.name_counts.where("scope = 'package' and n > 0").select(F.col("name").alias("last"))
    return (
        f.placed.where(~is_dunder(F.col("last")))
        .join(f.users.select("sid").distinct(), "sid", "left_anti")
        .join(f.entrypoints, "sid", "left_anti")
        .join(f.named(f.rules.keep, "name"), "name", "left_anti")
        .join(read, "last", "left_anti")
    )


def dead(f: Facts) -> DataFrame:
    tested = f.name_counts.where("scope = 'tests' and n > 0").select(F.col("name").alias("last"))
    facts = f.functions.select("sid", F.col("decorated").alias("f_decorated"))
    classes = f.classes.select("sid", F.col("decorated").alias("c_decorated"), F.col("library_base").alias("c_library"))
    owners = f.classes.where("library_base").select(F.col("sid").alias("owner"))
    rows = _unnamed(f).join(tested, "last", "left_anti").join(facts, "sid", "left").join(classes, "sid", "left")
    rows = rows.where(~(F.col("kind").isin("function", "method") & (F.coalesce("f_decorated", F.lit(False)) | (F.col("last") == "main"))))
    rows = rows.where(~F.coalesce((F.col("kind") == "class") & F.col("c_decorated") & F.col("c_library"), F.lit(False)))
    rows = rows.where("kind = 'method'").join(owners, "owner", "left_anti").unionByName(rows.where("kind <> 'method'"))
    return _finding(rows, "dead", F.concat(short(F.col("sid")), F.lit(" is named nowhere")), "delete it")


def tests_only(f: Facts) -> DataFrame:
    uses = f.test_uses.groupBy(F.col("name").alias("last")).agg(F.count_distinct("file").alias("files"), F.slice(F.array_sort(F.collect_set(_site("file", "line", "start", "end"))), 1, TEST_SITES).alias("sites"))
    tested = f.name_counts.where("scope = 'tests' and n > 0").select(F.col("name").alias("last"))
    rows = _unnamed(f).where("kind in ('function', 'method', 'class')").join(tested, "last", "left_semi").join(uses, "last", "left")
    message = F.concat(short(F.col("sid")), F.lit(" is named only by tests, in "), F.coalesce("files", F.lit(0)).cast("string"), F.lit(" files"))
    return _finding(rows, "tests_only", message, "delete it with its tests", sites=F.coalesce("sites", F.expr(_NO_SITES)))


def forward(f: Facts) -> DataFrame:
    callee = f.ours.groupBy(F.col("caller").alias("sid")).agg(F.collect_set("callee").alias("callees")).where("size(callees) = 1")
    rows = f.own_functions.where(~is_dunder(F.col("last"))).where("sole_call is not null and not sole_call.spreads and size(params) > 0")
    rows = rows.join(f.entrypoints, "sid", "left_anti").join(f.overriding, "sid", "left_anti").join(callee, "sid")
    given_ = F.concat(F.col("sole_call.args"), F.transform("sole_call.keywords", lambda k: k["arg"]))
    plain = lambda a: a["literal"] | F.array_contains("params", a["name"]) | (a["attr_of"] == "self") | F.array_contains("params", a["attr_of"])
    rows = rows.withColumn("given", given_).where(F.forall("given", lambda a: F.coalesce(plain(a), F.lit(False))))
    rows = rows.where(F.size(F.array_except("params", F.flatten(F.transform("given", lambda a: a["names"])))) == 0)
    to = F.element_at("callees", 1)
    return _finding(rows, "forward", F.concat(short(F.col("sid")), F.lit(" only forwards to "), short(to)), "call it directly", related=F.col("callees"))


def _tunnel_paths(f: Facts) -> DataFrame:
    """start, param, path: greedy walks over functions that relay a parameter of one name."""
    relay = f.own_functions.where(~is_dunder(F.col("last"))).select("sid", F.explode("relayed").alias("param")).where(~F.col("param").startswith("_"))
    relay = cut(relay.join(f.ours.select(F.col("caller").alias("sid")), "sid", "left_semi"))
    step = cut(f.ours.select(F.col("caller").alias("at"), F.col("callee").alias("next")).join(relay.select(F.col("sid").alias("next"), "param"), "next"))
    front = relay.select(F.col("sid").alias("start"), "param", F.array("sid").alias("path"))
    done = None
    while True:
        ahead = front.join(step, (F.element_at("path", -1) == step["at"]) & (front["param"] == step["param"])).where(~F.array_contains("path", F.col("next"))).groupBy("start", front["param"]).agg(F.min("next").alias("next"))
        walked = cut(front.join(ahead, ["start", "param"], "left"))
        ended = walked.where("next is null").select("start", "param", "path")
        done = ended if done is None else done.union(ended)
        front = walked.where("next is not null").select("start", "param", F.concat("path", F.array("next")).alias("path"))
        if front.isEmpty():
            return done


def tunnel(f: Facts) -> DataFrame:
    takes = f.functions.select(F.col("sid").alias("end"), "params")
    ends = f.ours.select(F.col("caller").alias("at"), F.col("callee").alias("end")).join(takes, "end")
    found = _tunnel_paths(f).where(F.size("path") >= TUNNEL)
    found = found.join(ends, (F.element_at("path", -1) == ends["at"]) & F.array_contains("params", F.col("param")))
    found = cut(found.groupBy("start", "param", "path").agg(F.min("end").alias("end")))  # which may be on the path itself
    midway = found.select("param", F.explode(F.concat(F.expr("slice(path, 2, size(path))"), F.array("end"))).alias("start")).distinct()
    found = found.join(midway, ["param", "start"], "left_anti").join(f.placed, F.col("start") == F.col("sid"))
    way = Window.partitionBy("param", "end").orderBy("module", "line", "sid")
    found = found.withColumn("rank", F.row_number().over(way)).withColumn("others", F.count(F.lit(1)).over(Window.partitionBy("param", "end")) - 1).where("rank = 1")
    message = F.concat(F.col("param"), F.lit(" crosses "), F.size("path").cast("string"), F.lit(" functions unread"), F.when(F.col("others") > 0, F.concat(F.lit("; other ways in: "), F.col("others").cast("string"))).otherwise(F.lit("")))
    return _finding(found, "tunnel", message, "hand it to the last one directly", F.col("param"), F.concat(F.expr("slice(path, 2, size(path))"), F.array("end")))


def private_abroad(f: Facts) -> DataFrame:
    used = f.placed.where("private").where(~is_dunder(F.col("last"))).join(f.users.withColumn("user_module", _module_of("scope")), "sid")
    rows = used.groupBy("sid", "module", "file", "line", "ord").agg(
        F.array_sort(F.collect_set(F.when(F.col("user_module") != F.col("module"), F.col("user_module")))).alias("modules"), F.array_sort(F.collect_set("scope")).alias("scopes")
    )
    rows = rows.where("size(modules) > 0")
    return _finding(rows, "private_abroad", F.concat(short(F.col("sid")), F.lit(" is private and used in "), F.concat_ws(", ", F.slice("modules", 1, 3))), "make it public or move it", related=F.slice("scopes", 1, SOME_RELATED))


def bool_flag(f: Facts) -> DataFrame:
    rows = f.own_functions.where(~is_dunder(F.col("last"))).where("first_if is not null and array_contains(flags, first_if.name)").join(f.entrypoints, "sid", "left_anti")
    calls = f.package_calls.select(F.col("name").alias("last"), F.struct("args", "keywords").alias("call"), F.col("file").alias("at_file"), F.col("line").alias("at_line"))
    hit = rows.join(calls, "last").withColumn("arg", given(F.col("call"), F.col("first_if.name"), F.col("positional"))).where("arg.boolean")
    hit = hit.groupBy("sid", "module", "file", "line", "ord", F.col("first_if").alias("f")).agg(F.array_sort(F.collect_list(_site("at_file", "at_line"))).alias("sites"))  # of those that choose
    first = F.struct(F.col("file"), F.col("f.start").alias("line"), F.col("f.start").alias("start"), F.col("f.end").alias("end"))
    return _finding(hit, "bool_flag", F.concat(F.col("f.name"), F.lit(" decides what "), short(F.col("sid")), F.lit(" does, and callers write it out")), "two functions", F.col("f.name"), sites=F.concat(F.array(first), "sites"))


def cycle(f: Facts) -> DataFrame:
    edges = f.imports.select(F.col("module").alias("src"), F.col("target").alias("dst"))
    rings = graph.strong_components(edges).groupBy(F.col("component").alias("module")).agg(F.array_sort(F.collect_list("node")).alias("members"))
    rings = rings.join(f.modules, "module")
    second = f.imports.select("module", "target", F.col("line").alias("at"))
    rings = rings.join(second, (second["module"] == rings["module"]) & (second["target"] == F.element_at("members", 2)), "left").select(rings["*"], "at")
    rows = rings.select(F.concat("module", F.lit(":<module>")).alias("sid"), "module", "file", F.coalesce("at", F.lit(1)).alias("line"), "ord", "members")
    return _finding(rows, "cycle", F.concat(F.lit("a ring of imports: "), F.concat_ws(", ", "members")), "move what they share below them", related=F.expr("slice(members, 2, size(members))"), symbol="module")


def layer(f: Facts) -> DataFrame:
    ranks = f.spark.createDataFrame([(n, i) for i, n in enumerate(f.rules.layers)], "folder string, rank int")
    edges = f.imports.withColumn("a", folder(F.col("module"))).withColumn("b", folder(F.col("target")))
    up = edges.join(ranks.select(F.col("folder").alias("a"), F.col("rank").alias("low")), "a").join(ranks.select(F.col("folder").alias("b"), F.col("rank").alias("high")), "b").where("high > low")
    rows = up.join(f.modules.select("module", "file"), "module")
    return _finding(rows, "layer", F.concat(F.col("a"), F.lit(" imports "), F.col("target"), F.lit(", "), (F.col("high") - F.col("low")).cast("string"), F.lit(" layers up")), "turn the import around", F.col("target"), F.array("target"), symbol="module")


def forbid(f: Facts) -> DataFrame:
    bans = f.spark.createDataFrame([(k, b, i) for k, v in f.rules.forbid.items() for i, b in enumerate(v)], "folder string, banned string, place int")
    package = f.rules.package_dir.name if f.rules.package_dir else ""
    used = f.externals.select("module", "target", "line", "ord").union(f.imports.select("module", F.concat(F.lit(f"{package}."), "target"), "line", "ord"))
    hit = used.withColumn("folder", folder(F.col("module"))).join(bans, "folder").where("target = banned or startswith(target, banned || '.')")
    hit = hit.withColumn("rank", F.row_number().over(Window.partitionBy("module", "target").orderBy("place"))).where("rank = 1")
    rows = hit.join(f.modules.select("module", "file"), "module")
    return _finding(rows, "forbid", F.concat(F.col("folder"), F.lit(" may not import "), F.col("banned")), "go through what may", F.col("target"), symbol="module")


def _handed(f: Facts) -> DataFrame:
    """caller, callee, names: for each resolved call the parameters of both ends handed on under their own name, by keyword under
    the same one, or by place."""
    calls = f.functions.where(~is_dunder(last_name(F.col("sid")))).select(F.col("sid").alias("caller"), F.col("params").alias("own"), F.posexplode("calls").alias("at", "call"))
    edges = f.ours.select("caller", "callee", last_name(F.col("callee")).alias("name"))
    called = calls.join(edges, (calls["caller"] == edges["caller"]) & (F.col("call.name") == edges["name"])).select(calls["caller"], "own", "at", "call", "callee")
    called = called.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("caller", "at"))).where("n = 1 and caller <> callee")
    called = called.join(f.functions.select(F.col("sid").alias("callee"), F.col("params").alias("theirs")), "callee")
    named = F.concat(F.transform("call.args", lambda a: a["name"]), F.transform(F.filter("call.keywords", lambda k: k["arg"]["name"] == k["k"]), lambda k: k["k"]))
    kept = F.filter(F.array_intersect("own", "theirs"), lambda p: ~p.startswith("_") & ~p.isin(*NEVER_CLUMPED))
    both = F.array_intersect(kept, F.filter(named, lambda n: n.isNotNull()))
    return called.select("caller", "callee", F.array_sort(both).alias("names")).where(F.size("names") >= CLUMP_NAMES).distinct()


def closed_sets(sets: DataFrame) -> DataFrame:
    """All intersections, of three names or more, of any number of the sets (column names).

    Sets that share three names share one besides the two most frequent of either: they meet on those, so not on names that many have.
    Each round meets what the last one found new with the sets given.
    """
    given_ = cut(sets.select("names").distinct())
    held = given_.select(F.explode("names").alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("n"))

    def meeting(df: DataFrame, name: str) -> DataFrame:
        ranked = df.select("names", F.explode("names").alias("x")).join(held, "x").groupBy("names").agg(F.array_sort(F.collect_list(F.struct("n", "x"))).alias("r"))
        rare = F.slice("r", F.lit(1), F.size("r") - (CLUMP_NAMES - 1))
        return ranked.select(F.col("names").alias(name), F.explode(rare).alias("k")).select(name, "k.x")

    against = cut(meeting(given_, "b"))
    closed = front = given_
    while not front.isEmpty():
        met = meeting(front, "a").join(against, "x").select("a", "b").distinct().select(F.array_sort(F.array_intersect("a", "b")).alias("names"))
        new = cut(met.where(F.size("names") >= CLUMP_NAMES).distinct().join(closed, "names", "left_anti"))
        wider = cut(closed.union(new))
        if closed is not given_:
            drop(front, closed)
        front, closed = new, wider
    return closed


def _beaten(members: DataFrame) -> DataFrame:
    """key, component of groups (rows key, component, names, size, node) that one of more names holds all members of.

    Both hold its first member, by which they meet; the members they share are counted as rows, as groups may hold most of a package.
    """
    wider = members.select(F.col("node").alias("component"), F.col("key").alias("k2"), F.col("component").alias("c2"), F.col("names").alias("n2"))
    met = members.where("node = component").select("key", "component", "names", "size").join(wider, "component")
    met = met.where((F.size("n2") > F.size("names")) & (F.size(F.array_except("names", "n2")) == 0)).select("key", "component", "size", "k2", "c2")
    theirs = members.select(F.col("key").alias("k2"), F.col("component").alias("c2"), "node")
    shared = met.join(members.select("key", "component", "node"), ["key", "component"]).join(theirs, ["k2", "c2", "node"])
    return shared.groupBy("key", "component", "k2", "c2", "size").count().where("count = size").select("key", "component").distinct()


def clump(f: Facts) -> DataFrame:
    edges = cut(_handed(f))
    if edges.isEmpty():
        return empty(f)
    sets = closed_sets(edges).select("names", F.explode("names").alias("x"))
    holds = edges.select("caller", "callee", F.col("names").alias("all"), F.explode("names").alias("x"))
    within = sets.join(holds, "x").groupBy("names", "caller", "callee", "all").count().where("count = size(names)")
    within = cut(within.select(F.concat_ws("+", "names").alias("key"), F.col("caller").alias("src"), F.col("callee").alias("dst")).distinct())
    groups = graph.components(within.select("key", "src", "dst"), ["key"])
    relays = within.select("key", F.col("src").alias("node")).intersect(within.select("key", F.col("dst").alias("node"))).withColumn("relay", F.lit(1))
    sizes = groups.join(relays, ["key", "node"], "left").groupBy("key", "component").agg(F.count(F.lit(1)).alias("size"), F.max("relay").alias("relay"))
    sizes = sizes.where(f"size >= {CLUMP_FUNCTIONS} and relay = 1").select("key", "component", "size", F.split("key", r"\+").alias("names"))
    members = cut(groups.join(sizes, ["key", "component"]))
    members = members.join(_beaten(members), ["key", "component"], "left_anti")
    placed = members.select("key", "component", "names", F.col("node").alias("sid")).join(f.placed, "sid")
    order = F.transform(F.array_sort(F.collect_list(F.struct("module", "line", "sid"))), lambda m: m["sid"])
    first = placed.groupBy("key", "component", "names").agg(order.alias("all"), F.min(F.struct("module", "line", "sid", "file", "ord")).alias("f")).select("key", "names", F.expr("slice(all, 2, size(all))").alias("rest"), "f.*")
    return _finding(first, "clump", F.concat(F.lit("travel together: "), F.concat_ws(", ", "names")), "make them one object", F.col("key"), F.col("rest"))


def _given_everywhere(f: Facts, rows: DataFrame, calls: DataFrame, column: str) -> DataFrame:
    """Rows (with last, positional) by call of their name, with the argument for the parameter in ``column``."""
    at = calls.select(F.col("name").alias("last"), F.struct("args", "keywords").alias("call"), "spreads", "dropped", F.col("file").alias("at_file"), F.col("line").alias("at_line"))
    return rows.join(at, "last").withColumn("arg", given(F.col("call"), F.col(column), F.col("positional")))


def constant_param(f: Facts) -> DataFrame:
    unique = f.own_functions.groupBy("last").count().where("count = 1").select("last")
    rows = f.own_functions.where(~is_dunder(F.col("last"))).join(unique, "last", "left_semi").join(f.entrypoints, "sid", "left_anti")
    rows = rows.select("sid", "module", "file", "line", "ord", "last", "positional", F.explode("params").alias("param"))
    all_ = _given_everywhere(f, rows, f.package_calls, "param").groupBy("sid", "module", "file", "line", "ord", "param")
    found = all_.agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.coalesce("arg.literal", F.lit(False))).alias("written"), F.min("arg.value").alias("least"), F.max("arg.value").alias("most"), F.min("arg.text").alias("text"))
    found = _with_sites(found.where("n >= 2 and written and least = most").withColumn("last", last_name(F.col("sid"))), f.package_calls)
    return _finding(found, "constant_param", F.concat(F.col("param"), F.lit(" is "), F.col("text"), F.lit(" in every call")), "make it a constant", F.concat_ws("=", "param", "text"), sites=F.col("sites"))


def hub(f: Facts) -> DataFrame:
    edges = f.imports.select("module", "target").distinct()
    fan_in = edges.groupBy(F.col("target").alias("module")).agg(F.count(F.lit(1)).alias("importers"), F.array_sort(F.collect_set("module")).alias("who"))
    fan_out = edges.groupBy("module").agg(F.count(F.lit(1)).alias("imports"))
    public = f.symbols.where("kind <> 'method' and not private").groupBy("module").agg(F.count(F.lit(1)).alias("public"))
    big = fan_in.join(fan_out, "module").join(public, "module").where(f"importers >= {HUB} and imports >= {HUB} and public >= {HUB}")
    taken = f.taken.groupBy(F.col("target").alias("hub"), F.col("module").alias("importer")).agg(F.count_distinct("name").alias("taken"))
    used = f.users.withColumn("importer", _module_of("scope")).join(f.symbols.where("kind <> 'method' and not private").select("sid", F.col("module").alias("hub")), "sid").groupBy("hub", "importer").agg(F.count_distinct("sid").alias("used"))
    pairs = edges.select(F.col("target").alias("hub"), F.col("module").alias("importer")).join(taken, ["hub", "importer"], "left").join(used, ["hub", "importer"], "left")
    shares = pairs.withColumn("n", F.coalesce("taken", "used", F.lit(0))).join(big.withColumnRenamed("module", "hub"), "hub").groupBy("hub", "public", "importers", "imports", "who").agg(F.median(F.col("n") / F.col("public")).alias("share")).where(f"share <= {HUB_SHARE}")
    rows = shares.withColumnRenamed("hub", "module").join(f.modules, "module").withColumn("line", F.lit(1))
    return _finding(rows, "hub", F.concat(F.col("importers").cast("string"), F.lit(" modules import it, it imports "), F.col("imports").cast("string"), F.lit(", and each takes a small part")), "split it by who uses what", related=F.slice("who", 1, SOME_RELATED), symbol="module")


def co_changes(commits: DataFrame, rows: int | None = None) -> DataFrame:
    """a, b, together, changes_a, changes_b, commits (newest first): files of one commit, sweeps left out. rows: how many rows of
    commits there are, if they may be many; pairs, few of which are equal, are then dealt as they are, by as many times that."""
    files = commits.where(f"pos < {HISTORY}")
    files = (dealt(files, rows, "hash") if rows else files).dropDuplicates(["hash", "file"])
    files = files.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("hash"))).where(f"n <= {SWEEP}")
    changes = files.groupBy("file").agg(F.count(F.lit(1)).alias("changes"))
    a, b = files.alias("a"), files.alias("b")
    pairs = a.join(b, (F.col("a.hash") == F.col("b.hash")) & (F.col("a.file") < F.col("b.file"))).select(F.col("a.file").alias("a"), F.col("b.file").alias("b"), F.col("a.pos").alias("pos"), F.col("a.hash").alias("hash"), F.col("a.subject").alias("subject"))
    pairs = dealt(pairs, PAIRS_A_ROW * rows, "a", "b") if rows else pairs
    pairs = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("together"), F.array_sort(F.collect_list(F.struct("pos", "hash", "subject"))).alias("commits"))
    return pairs.join(changes.select(F.col("file").alias("a"), F.col("changes").alias("changes_a")), "a").join(changes.select(F.col("file").alias("b"), F.col("changes").alias("changes_b")), "b")


def shotgun(f: Facts) -> DataFrame:
    of = f.modules.select("file", "module", "ord")
    pairs = co_changes(cut(f.commit_files)).where(f"together >= {TOGETHER} and together / least(changes_a, changes_b) >= {TOGETHER_SHARE}")
    pairs = pairs.join(of.select(F.col("file").alias("a"), F.col("module").alias("ma"), F.col("ord").alias("oa")), "a").join(of.select(F.col("file").alias("b"), F.col("module").alias("mb"), F.col("ord").alias("ob")), "b").where(folder(F.col("ma")) != folder(F.col("mb")))
    first = F.col("changes_a") <= F.col("changes_b")
    rows = pairs.select(F.when(first, F.col("ma")).otherwise(F.col("mb")).alias("module"), F.when(first, F.col("a")).otherwise(F.col("b")).alias("file"), F.when(first, F.col("mb")).otherwise(F.col("ma")).alias("other"), F.lit(1).alias("line"), "together", F.least("changes_a", "changes_b").alias("of"), "commits")
    commits = F.transform("commits", lambda c: F.struct(c["hash"].alias("hash"), c["subject"].alias("subject")))
    return _finding(rows, "shotgun", F.concat(F.col("together").cast("string"), F.lit(" of "), F.col("of").cast("string"), F.lit(" changes also changed "), F.col("other")), "move together what changes together", F.col("other"), F.array("other"), commits=commits, symbol="module")


def home_only_public(f: Facts) -> DataFrame:
    home = f.users.withColumn("at", _module_of("scope")).groupBy("sid").agg(F.collect_set("at").alias("modules"))
    tested = f.name_counts.where("scope = 'tests' and n > 0").select(F.col("name").alias("last"))
    rows = f.own_functions.where("kind = 'function' and not private and not decorated").where(~is_dunder(F.col("last"))).join(home, "sid").where("size(modules) = 1 and modules[0] = module")
    rows = rows.join(f.entrypoints, "sid", "left_anti").join(f.named(f.rules.keep, "last"), "last", "left_anti").join(tested, "last", "left_anti").join(f.names.where("kind = 'handed'").select("module", F.col("name").alias("last")).distinct(), ["module", "last"], "left_anti")
    return _finding(rows, "home_only_public", F.concat(short(F.col("sid")), F.lit(" is public and called only at home")), "make it private")


def _record_classes(f: Facts) -> DataFrame:
    return f.placed.where("kind = 'class'").join(f.classes.drop("ord"), "sid").where("not library_base")


def unread_field(f: Facts) -> DataFrame:
    serialises = f.names.where("kind = 'called_names'").where(F.col("name").isin(*SERIALIZERS)).select("module").distinct()
    rows = _record_classes(f).join(f.entrypoints, "sid", "left_anti").join(serialises, "module", "left_anti").select("sid", "module", "file", "line", "ord", F.explode("fields.name").alias("field")).where(~F.col("field").startswith("_"))
    rows = rows.join(f.names_of("attribute_reads", "matched_fields").withColumnRenamed("name", "field"), "field", "left_anti")
    return _finding(rows, "unread_field", F.concat(short(F.col("sid")), F.lit("."), F.col("field"), F.lit(" is never read")), "delete the field", F.col("field"))


def twin_shapes(f: Facts) -> DataFrame:
    rows = _record_classes(f).join(f.names_of("listed_names").withColumnRenamed("name", "last"), "last", "left_anti")
    rows = rows.withColumn("shape", F.array_sort(F.array_distinct("fields"))).where("size(shape) >= 2").withColumn("folder", folder(F.col("module")))
    order = Window.partitionBy("folder", "shape").orderBy("ord", "sid")
    rows = rows.withColumn("first", F.first("sid").over(order)).withColumn("rank", F.row_number().over(order)).where("rank > 1")
    return _finding(rows, "twin_shapes", F.concat(short(F.col("sid")), F.lit(" has the fields of "), short(F.col("first"))), "make them one class", related=F.array("first"))


def duplicate(f: Facts) -> DataFrame:
    rows = f.own_functions.where("shape is not null").where(~is_dunder(F.col("last")))
    order = Window.partitionBy("shape").orderBy("module", "line", "sid")
    every = Window.partitionBy("shape")
    rows = rows.withColumn("rank", F.row_number().over(order)).withColumn("n", F.count(F.lit(1)).over(every)).where("n >= 2")
    others = rows.groupBy("shape").agg(F.array_sort(F.collect_list(F.struct("module", "line", "sid"))).alias("all"))
    rows = rows.where("rank = 1").join(others, "shape")
    more = F.expr("slice(transform(all, x -> x.sid), 2, size(all))")
    return _finding(rows, "duplicate", F.concat(short(F.col("sid")), F.lit(" is written "), F.col("n").cast("string"), F.lit(" times")), "keep one", related=more)


def _by_name(f: Facts) -> DataFrame:
    at = f.calls.groupBy(F.col("name").alias("last")).agg(F.count(F.lit(1)).alias("n"), F.bool_and("dropped").alias("all_dropped"), F.bool_or("spreads").alias("any_spread"))
    return f.checkable.join(at, "last")


def _with_sites(found: DataFrame, calls: DataFrame) -> DataFrame:
    """What was found with the sites of all calls of its name (last). Only these calls are gathered."""
    at = calls.select(F.col("name").alias("last"), F.col("file").alias("at_file"), F.col("line").alias("at_line")).join(found.select("last").distinct(), "last", "left_semi")
    return found.join(at.groupBy("last").agg(F.array_sort(F.collect_list(_site("at_file", "at_line"))).alias("sites")), "last", "left")


def ignored_return(f: Facts) -> DataFrame:
    rows = _with_sites(_by_name(f).where("returns_value and all_dropped"), f.calls)
    return _finding(rows, "ignored_return", F.concat(F.lit("every call drops what "), short(F.col("sid")), F.lit(" returns")), "return nothing", sites=F.col("sites"))


def unused_default(f: Facts) -> DataFrame:
    rows = _by_name(f).where("not any_spread").select("sid", "module", "file", "line", "ord", "last", "positional", F.explode("defaults").alias("default")).withColumn("param", F.col("default.name"))
    found = _given_everywhere(f, rows, f.calls, "param").groupBy("sid", "module", "file", "line", "ord", "last", "param", F.col("default.text").alias("text")).agg(F.count("arg").alias("given")).where("given = 0")
    found = _with_sites(found, f.calls)
    return _finding(found, "unused_default", F.concat(F.lit("no call gives "), F.col("param"), F.lit(", it is always "), F.col("text")), "make it a constant", F.col("param"), sites=F.col("sites"))


def unused_param(f: Facts) -> DataFrame:
    rows = _by_name(f).where("not stub").select("sid", "module", "file", "line", "ord", "last", "loads", F.explode("params").alias("param")).where(~F.col("param").startswith("_"))
    rows = _with_sites(rows.where(F.coalesce(F.try_element_at("loads", F.col("param")), F.lit(0)) == 0), f.calls)
    return _finding(rows, "unused_param", F.concat(F.col("param"), F.lit(" is never read")), "delete it", F.col("param"), sites=F.col("sites"))


def scattered_api(f: Facts) -> DataFrame:
    used = f.library_calls.where("not raised_or_returned").where(~F.element_at(F.split("api", r"\."), -1).isin(*SETUP_CALLS))
    near = used.groupBy("api", "module").agg(F.min_by("line", "ord").alias("line")).join(f.modules.select("module", "file"), "module").withColumn("folder", folder(F.col("module")))
    by = near.groupBy("api").agg(F.count(F.lit(1)).alias("modules"), F.count_distinct("folder").alias("folders"), F.array_sort(F.collect_list(F.struct("module", "file", "line"))).alias("all"))
    rows = by.where(f"modules >= {SCATTERED_MODULES} and folders >= {SCATTERED_FOLDERS}").select("api", "modules", "all", F.col("all")[0].alias("first")).select("api", "modules", "all", "first.*")
    sites = F.transform("all", lambda m: F.struct(m["file"].alias("file"), m["line"].alias("line"), m["line"].alias("start"), m["line"].alias("end")))
    return _finding(rows, "scattered_api", F.concat(F.col("api"), F.lit(" is called in "), F.col("modules").cast("string"), F.lit(" modules")), "give it one home", F.col("api"), sites=sites, symbol="module")


def instability(edges: DataFrame) -> DataFrame:
    """node, fan_in, fan_out, instability of every node of (src, dst)."""
    edges = edges.select("src", "dst").distinct()
    fan_out = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("fan_out"))
    fan_in = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("fan_in"))
    both = fan_in.join(fan_out, "node", "full").na.fill(0, ["fan_in", "fan_out"])
    return both.withColumn("instability", F.col("fan_out") / (F.col("fan_in") + F.col("fan_out")))


def unstable_dependency(f: Facts) -> DataFrame:
    known = cut(instability(f.imports.select(F.col("module").alias("src"), F.col("target").alias("dst"))))
    own = known.select(F.col("node").alias("module"), "fan_in", F.col("instability").alias("own"))
    far = known.select(F.col("node").alias("target"), F.col("instability").alias("theirs"))
    worst = f.imports.join(own, "module").join(far, "target").where(f"fan_in >= {FAN_IN}").withColumn("rank", F.row_number().over(Window.partitionBy("module").orderBy(F.desc("theirs"), "ord", "target"))).where("rank = 1")
    rows = worst.where(f"theirs - own >= cast({MARGIN} as double)").join(f.modules.select("module", "file"), "module")
    return _finding(rows, "unstable_dependency", F.concat(F.col("fan_in").cast("string"), F.lit(" modules rest on it, and it rests on "), F.col("target"), F.lit(" ("), F.format_number("theirs", 2), F.lit(")")), "turn the import around", F.col("target"), F.array("target"), symbol="module")


def feature_envy(f: Facts) -> DataFrame:
    foreign = f.classes.where("library_base").select(F.col("sid").alias("owner"))
    rows = f.own_functions.where("kind = 'method'").where(~is_dunder(F.col("last"))).join(foreign, "owner", "left_anti")
    rows = rows.select("sid", "module", "file", "line", "ord", "annotations", "params", F.coalesce(F.try_element_at("receiver_reads", F.lit("self")), F.lit(0)).alias("own"), F.explode("receiver_reads").alias("param", "reads"))
    rows = rows.where(f"reads >= {ENVY} and reads > 2 * own and param <> 'self' and array_contains(params, param)").withColumn("class", F.try_element_at("annotations", F.col("param"))).join(f.behaving, "class")
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("sid").orderBy(F.desc("reads"), F.array_position("params", F.col("param"))))).where("rank = 1")
    return _finding(rows, "feature_envy", F.concat(short(F.col("sid")), F.lit(" reads "), F.col("param"), F.lit(" more than itself")), "move it there", F.col("param"), F.array("class_sid"))


def single_implementation(f: Facts) -> DataFrame:
    own = f.placed.where("kind = 'class'").join(f.classes.drop("ord"), "sid")
    first = own.withColumn("rank", F.row_number().over(Window.partitionBy("last").orderBy("ord", "sid"))).where("rank = 1")
    kids = own.select(F.col("sid").alias("child"), F.explode(F.array_distinct("bases")).alias("last")).groupBy("last").agg(F.count(F.lit(1)).alias("n"), F.min("child").alias("child")).where("n = 1")
    rows = first.where("abstract").join(kids, "last").join(f.entrypoints, "sid", "left_anti")
    return _finding(rows, "single_implementation", F.concat(short(F.col("sid")), F.lit(" has one implementation, "), short(F.col("child"))), "keep the implementation alone", related=F.array("child"))


#: In the order findings are printed.
CHECKS: dict[str, Callable[[Facts], DataFrame]] = {
    "dead": dead, "tests_only": tests_only, "forward": forward, "tunnel": tunnel, "private_abroad": private_abroad, "bool_flag": bool_flag, "cycle": cycle, "layer": layer, "forbid": forbid, "clump": clump, "constant_param": constant_param, "hub": hub,
    "shotgun": shotgun, "home_only_public": home_only_public, "unread_field": unread_field, "twin_shapes": twin_shapes, "duplicate": duplicate, "ignored_return": ignored_return, "unused_default": unused_default, "unused_param": unused_param,
    "scattered_api": scattered_api, "unstable_dependency": unstable_dependency, "feature_envy": feature_envy, "single_implementation": single_implementation,
}

#: check -> (title, what it looks for).
NOTES: dict[str, tuple[str, str]] = {
    "dead": ("Dead", "Symbols that neither the package nor its tests name."),
    "tests_only": ("Kept by tests", "Symbols that tests alone name."),
    "forward": ("Forwards", "Functions whose body is one call that hands on every parameter."),
    "tunnel": ("Tunnels", "Parameters that three functions or more hand on unread."),
    "private_abroad": ("Private, used abroad", "Names with an underscore that other modules use."),
    "bool_flag": ("Flags", "Functions that branch on a boolean first, which callers write out."),
    "cycle": ("Rings", "Modules that import each other, directly or through others."),
    "layer": ("Upward imports", "Imports from a layer into one above it."),
    "forbid": ("Forbidden imports", "Imports that the project's rules forbid a folder."),
    "clump": ("Clumps", "Three names or more handed on together through three functions or more."),
    "constant_param": ("Constants in disguise", "Parameters that every call sets to the same literal."),
    "hub": ("Hubs", "Modules that many import for a small part each, and that import many."),
    "shotgun": ("Changed together", "Files of different folders that nearly every commit changes together."),
    "home_only_public": ("Public for nobody", "Public functions that their own module alone calls."),
    "unread_field": ("Unread fields", "Fields of own records that nothing reads."),
    "twin_shapes": ("Twins", "Records of one folder with the same fields."),
    "duplicate": ("Duplicates", "Functions with the same body, names of locals aside."),
    "ignored_return": ("Ignored returns", "Functions of which every call drops what it returns."),
    "unused_default": ("Unused defaults", "Parameters with a default that no call gives."),
    "unused_param": ("Unread parameters", "Parameters that their function never reads."),
    "scattered_api": ("Scattered calls", "Functions of a library called from many modules of several folders."),
    "unstable_dependency": ("Unstable dependencies", "Modules many rest on, that rest on one far less stable."),
    "feature_envy": ("Envy", "Methods that read another object far more than their own."),
    "single_implementation": ("Lone implementations", "Abstract classes with one implementation."),
}


def catalog() -> dict[str, Callable[[Facts], DataFrame]]:
    """The engine's checks, then those registered besides (see ``extension``)."""
    return CHECKS | {c.name: c.find for c in registered().values()}


def notes() -> dict[str, tuple[str, str]]:
    return NOTES | {c.name: (c.title, c.note) for c in registered().values()}


def finding(df: DataFrame, check: str, message: Column, fix: str, **parts: Column) -> DataFrame:
    """Rows of FINDING for a check of a user's own; the rows hold sid, file, line, and module and ord for their order. parts: key, related,
    sites, commits."""
    return _finding(df, check, message, fix, **parts)


#: Checks that run at a time: most are too small to keep a cluster busy. Each may send tables through the driver to be joined.
AT_A_TIME = 4
#: How much larger tables are in memory than as files, when it is decided which are small enough for that.
UNPACKED, _FACTOR = "10.0", "spark.sql.sources.fileCompressionFactor"


@contextmanager
def _sized(spark: SparkSession) -> Iterator[None]:
    """Files of facts, which hold few values many times, count as large as they are in memory."""
    before = spark.conf.get(_FACTOR)
    if before == "1.0":
        spark.conf.set(_FACTOR, UNPACKED)
    try:
        yield
    finally:
        spark.conf.set(_FACTOR, before)


def all_findings(f: Facts, checks: list[str] | None = None) -> DataFrame:
    """Findings of all checks, with their place in the order of printing (check_ord).

    Each check is a plan of its own, written to the shared folder; one plan of all would take longer to make than to run.
    """
    runs = catalog()
    wanted = [(i, c) for i, c in enumerate(runs) if checks is None or c in checks]
    with _sized(f.spark), ThreadPoolExecutor(AT_A_TIME) as pool:
        found = list(pool.map(lambda x: cut(runs[x[1]](f).withColumn("check_ord", F.lit(x[0]))), wanted))
    return reduce(DataFrame.unionByName, found)


def excused(findings: DataFrame, skips) -> DataFrame:
    """The findings with ``why`` and ``skip``, reason and place of the first rule, in order, whose glob matches the file and which
    names the check or none; null where none does."""
    if not skips:
        return findings.withColumn("why", F.lit(None).cast("string")).withColumn("skip", F.lit(None).cast("int"))
    rules = [F.when(F.col("file").rlike(glob_regex(s.path)) & (F.lit(not s.checks) | F.col("check").isin(*s.checks)), F.struct(F.lit(s.why).alias("why"), F.lit(i).alias("skip"))) for i, s in enumerate(skips)]
    return findings.withColumn("_rule", F.coalesce(*rules)).withColumn("why", F.col("_rule.why")).withColumn("skip", F.col("_rule.skip")).drop("_rule")


def ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy(*_printed())


def _printed() -> list:
    """The order findings are printed in."""
    return ["check_ord", F.split_part("symbol", F.lit(":"), F.lit(1)), "line", "id"]


def numbered(findings: DataFrame) -> DataFrame:
    """Findings with their position in that order: numbered within each check, after the counts of those before."""
    before = findings.groupBy("check_ord").agg(F.count(F.lit(1)).alias("_n"))
    start = before.join(before.select(F.col("check_ord").alias("_c"), F.col("_n").alias("_m")), F.col("_c") < F.col("check_ord"), "left").groupBy("check_ord").agg(F.coalesce(F.sum("_m"), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("check_ord").orderBy(*_printed()[1:]))
    return findings.withColumn("_place", place).join(F.broadcast(start), "check_ord").withColumn("position", (F.col("_place") + F.col("_before")).cast("int")).drop("_place", "_before")


def empty(f: Facts) -> DataFrame:
    return f.spark.createDataFrame([], FINDING)
