"""Findings, score, doors and flows as text, Markdown and JSON."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

from crossfile.facts import Facts
from crossfile.operators import graph
from crossfile.plans import checks
from crossfile.plans.score import MOST_HOPS, score
from crossfile.rules import Project
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

DEEP = 8


@dataclass
class Reading:
    """A package, read whole. found: findings with the reason they are excused for (why, skip: place of the rule), or null."""

    facts: Facts
    found: DataFrame
    axes: DataFrame
    chains: DataFrame

    def rows(self) -> list[Row]:
        return checks.ordered(self.found).collect()


def load(spark: SparkSession, rules: Project, facts: str | None = None) -> Facts:
    """The facts of a project, by the reader of its language; or facts that any reader has written (see ``json_facts``)."""
    from crossfile.sources import json_facts, python_source, typescript

    if facts:
        return json_facts.read(spark, facts, rules)
    return {"python": python_source, "typescript": typescript}[rules.language].read(spark, rules.package_dir, rules)


def calls(f: Facts) -> DataFrame:
    return f.ours.select(F.col("caller").alias("src"), F.col("callee").alias("dst"), "lines")


def _within_sinks(f: Facts) -> DataFrame:
    """Own calls but for those that sinks make."""
    sink = F.lit(False)
    for s in f.rules.sinks:
        sink = sink | (F.col("src") == s) | F.endswith("src", F.lit(f":{s}")) | F.endswith("src", F.lit(f".{s}"))
    return calls(f).where(~sink)


def hops(f: Facts) -> DataFrame:
    """door, hops, path: the longest chain of own calls under each door, ending at a sink."""
    return graph.longest_chains(_within_sinks(f), f.entrypoints.withColumnRenamed("sid", "node"))


def trees(f: Facts) -> DataFrame:
    """door, pre_order, depth, node, lines, seen: every own call under each door, in the order of the code."""
    return graph.call_tree(_within_sinks(f), f.entrypoints.withColumnRenamed("sid", "node"))


def stop(f: Facts, name: str) -> str:
    """The one function that a name, with or without its module and class, means."""
    last = F.endswith("sid", F.lit(f":{name}")) | F.endswith("sid", F.lit(f".{name}"))
    hits = [r.sid for r in f.symbols.where("kind in ('function', 'method')").where((F.col("sid") == name) | last).select("sid").orderBy("sid").collect()]
    if len(hits) != 1:
        raise ValueError(f"{name} means {', '.join(hits) or 'no function'}")
    return hits[0]


def flow_text(f: Facts, names: list[str]) -> str:
    """The shortest flow through the named functions, a line each."""
    row = graph.flow(calls(f), [stop(f, n) for n in names]).first() if len(names) > 1 else Row(path=[stop(f, names[0])])
    if row is None:
        raise ValueError("no flow through these")
    path = f.spark.createDataFrame([(i, s, row.path[i - 1] if i else None) for i, s in enumerate(row.path)], "hop int, sid string, caller string")
    lines = path.join(f.placed, "sid").join(f.call_edges.select("caller", F.col("callee").alias("sid"), F.array_min("lines").alias("call_line")), ["sid", "caller"], "left").orderBy("hop").collect()
    return "\n".join(f"{r.hop}. {r.sid}  {r.file}:{r.line}" + (f"  called in line {r.call_line}" if r.call_line else "") + (f"  {r.doc}" if r.doc else "") for r in lines)


def reach(f: Facts, name: str) -> DataFrame:
    """door, hops, path: the doors that reach a function, nearest first."""
    target = f.spark.createDataFrame([(stop(f, name),)], "node string")
    return graph.reaching(calls(f), target, f.entrypoints.withColumnRenamed("sid", "node")).orderBy("hops", "door")


def _plain(df: DataFrame) -> list[dict]:
    return [json.loads(x) for x in df.toJSON().collect()]


def finding(r: Row) -> dict:
    return {k: v for k, v in r.asDict(recursive=True).items() if k not in ("check_ord", "why", "skip")}


def score_json(r: Reading) -> dict:
    rows = [x.asDict(recursive=True) for x in r.axes.collect()]
    return {"overall": next(x["value"] for x in rows if x["key"] == "overall"), "attributes": [x for x in rows if x["key"] != "overall"]}


def check_json(r: Reading) -> dict:
    """Findings to fix, and for every rule that excuses some, which and why."""
    rows, skips = r.rows(), r.facts.rules.skips
    return {"findings": [finding(x) for x in rows if x.why is None], "skipped": [{"path": s.path, "why": s.why, "findings": [finding(x) for x in rows if x.skip == i]} for i, s in enumerate(skips)]}


def payload(r: Reading) -> dict:
    """The whole reading as one document: what a page would draw."""
    f, rows = r.facts, check_json(r)
    levels = graph.layers(f.imports.select(F.col("module").alias("src"), F.col("target").alias("dst"))).withColumnRenamed("node", "module")
    imported = f.imports.groupBy("module").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("target", "line")))).alias("imports"))
    taken = f.taken.groupBy("module", "target").agg(F.array_sort(F.collect_set("name")).alias("n")).groupBy("module").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("target", "n")))).alias("taken"))
    modules = f.modules.join(levels, "module", "left").join(imported, "module", "left").join(taken, "module", "left").na.fill(0, ["layer"]).orderBy("ord").drop("ord")
    used = f.uses.groupBy("sid").agg(F.array_sort(F.collect_set("scope")).alias("used_by"))
    called = f.call_edges.groupBy(F.col("caller").alias("sid")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("callee", F.array_sort("lines").alias("lines"))))).alias("calls"))
    symbols = f.symbols.where("not (private and kind = 'constant')").join(used, "sid", "left").join(called, "sid", "left").orderBy("ord").drop("ord")
    tree: dict[str, list] = {}
    for x in _plain(trees(f).orderBy("door", "pre_order")):
        tree.setdefault(x.pop("door"), []).append(x)
    return {
        "package": f.rules.package_dir.name if f.rules.package_dir else "", "at": f.spark.range(1).select(F.date_format(F.current_timestamp(), "HH:mm:ss").alias("t")).first().t,
        "modules": _plain(modules), "symbols": _plain(symbols), "findings": rows["findings"], "skipped": [s | {"findings": len(s["findings"])} for s in rows["skipped"] if s["findings"]],
        "checks": {k: {"title": t, "note": n} for k, (t, n) in checks.notes().items()}, "score": score_json(r), "most_hops": MOST_HOPS,
        "hops": [x | {"tree": tree.get(x["door"], [])} for x in _plain(r.chains.orderBy(F.desc("hops"), "door"))], "rules": {"layers": list(f.rules.layers), "entries": sorted(f.rules.entries)},
    }


def check_text(r: Reading) -> tuple[list[str], list[str]]:
    """(a line for each finding to fix, counts by check and by rule that excuses some)."""
    rows, skips = r.rows(), r.facts.rules.skips
    left = [x for x in rows if x.why is None]
    counts = [f"{n} {title.lower()}" for c, (title, _) in checks.notes().items() if (n := sum(x.check == c for x in left))]
    hidden = [f"{n} excused in {s.path}: {s.why}" for i, s in enumerate(skips) if (n := sum(x.skip == i for x in rows))]
    return [f"{x.file}:{x.line}: {x.check}: {x.message}: {x.fix}" for x in left], [", ".join(counts) or "nothing to fix", *hidden]


def markdown(r: Reading) -> str:
    f, rows = r.facts, r.rows()
    own, axes = [x for x in rows if x.why is None], r.axes.collect()
    n = f.symbols.agg(F.count_if(F.col("kind").isin("function", "method")).alias("n")).first().n
    name = f.rules.package_dir.name if f.rules.package_dir else "package"
    out = [f"# {name}", "", f"{f.modules.count()} modules, {n} functions. Overall {next(x.value for x in axes if x.key == 'overall')} of 100.", ""]
    out += [f"- {x.label} {x.value}: {x.detail}" for x in axes if x.key != "overall"]
    out += ["", f"## {len(own)} to fix" if own else "Nothing to fix."]
    for check, (title, note) in checks.notes().items():
        if some := [x for x in own if x.check == check]:
            out += ["", f"### {title} ({len(some)})", "", note, "", *(f"- `{x.file}:{x.line}` {x.message}: {x.fix}" for x in some)]
    if hidden := check_text(r)[1][1:]:
        out += ["", "## Excused by the project's rules", "", *(f"- {x}" for x in hidden)]
    deep = r.chains.where(f"hops > {MOST_HOPS}")
    if shown := deep.orderBy(F.desc("hops"), "door").limit(DEEP).collect():
        out += ["", f"## Deepest doors ({deep.count()} of {r.chains.count()} over {MOST_HOPS} hops)", "", *(f"- {x.hops}: {' > '.join(p.partition(':')[2] for p in x.path)}" for x in shown)]
    if f.rules.layers:
        out += ["", f"Layers, lowest first: {', '.join(f.rules.layers)}."]
    return "\n".join(out) + "\n"


def about_file(r: Reading, file: str) -> list[Row]:
    """Findings to fix that are in a file, or name a symbol of it as related."""
    f = r.facts
    there = f.placed.where(F.col("file") == file).select(F.col("sid").alias("related_sid"))
    left = r.found.where("why is null")
    by_related = left.select("id", F.explode("related").alias("related_sid")).join(there, "related_sid", "left_semi").select("id")
    ids = left.where(F.col("file") == file).select("id").union(by_related).distinct()
    return checks.ordered(left.join(ids, "id", "left_semi")).collect()


def note(file: str, rows: list[Row], told: set[str], most: int = 8) -> str:
    """What a save has made new and what it has fixed, in a few lines."""
    new, fixed, out = [x for x in rows if x.id not in told], sorted(told - {x.id for x in rows}), []
    if new:
        out = [f"{len(new)} new in {file}:", *(f"  {x.file}:{x.line}: {x.check}: {x.message}: {x.fix}" for x in new[:most])]
        out += [f"  and {len(new) - most} more"] if len(new) > most else []
    return "\n".join(out + ([f"fixed {len(fixed)} in {file}: {', '.join(x.partition(':')[0] for x in fixed[:most])}"] if fixed else []))


def reading(f: Facts) -> Reading:
    """All findings and the score; library doors are added after the chains."""
    from crossfile.sources.python_source import with_library_doors

    f = f.shared()
    chains = hops(f).persist()
    wide = with_library_doors(f).shared() if f.rules.library else f
    found = checks.excused(checks.all_findings(wide), f.rules.skips).persist()
    return Reading(wide, found, score(wide, found.where("why is null"), chains).persist(), chains)


def saved(spark: SparkSession, file: Path, told: set[str]) -> tuple[str, set[str]]:
    """(note, ids now known) for a saved file of a project that has rules; ('', told) for any other."""
    from crossfile.rules import declares_rules, package_of_file, project_for

    package = package_of_file(file)
    if package is None or not declares_rules(package):
        return "", told
    rules = project_for(package)
    r = reading(load(spark, rules))
    name = str(file.resolve().relative_to(rules.package_dir.parent))
    rows = about_file(r, name)
    return note(name, rows, told), {x.id for x in rows}
