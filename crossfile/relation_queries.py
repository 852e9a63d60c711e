"""Links, joins by time, breakdowns, frames and sketches on the driver's tables, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import replace

from crossfile import check_queries
from crossfile.bindings import Held, facts, flat, lines_around, sql
from crossfile.facts import Facts
from crossfile.functions import sketches
from crossfile.operators import alias, temporal
from crossfile.operators.lineage import cut
from crossfile.plans import checks, trends
from crossfile.plans.score import score
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(text: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = text
        return f

    return add


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


LINKS = "select l.k node, min(l.k2) \"to\" from line l where l.rf <> 'N' and l.q >= 40 and l.k2 is not null and l.k2 <> l.k group by l.k"


@query(sql('select node, "at" "end" from walk where "at" not in (select node from links)', f'links as ({LINKS}), walk(node, "at") as (select node, "to" from links union select w.node, l."to" from walk w join links l on l.node = w."at")', True))
def alias_ends(spark, sf):
    """Where parts that stand for their next one end; those that lead into a ring end nowhere."""
    return alias.collapsed(flat(spark, sf, LINKS.replace('"', "`")))


@query(sql("select a node, cast(count(*) as bigint) n_up, bool_or(b in (select module from ext where target = 'lib1')) library from reach group by a", "reach(a, b) as (select module, target from few_imps union select r.a, e.target from reach r join few_imps e on r.b = e.module)", True))
def bases_above(spark, sf):
    """All above each module in a graph with rings, and whether something of a library is."""
    edges = flat(spark, sf, "select module node, target up from few_imps", lines=lines_around(spark, sf, 50))
    library = flat(spark, sf, "select distinct module node from ext where target = 'lib1'")
    return alias.counts_above(edges, library).withColumnRenamed("marked", "library")


@query(sql("select place, name from names", "names(place, name) as (select module, name from took union select s.module, n.name from names n join few_imps s on s.target = n.place where n.name <> 'f1')", True))
def star_names(spark, sf):
    """Names of modules with those of all modules they take everything from, however far."""
    held = Held()  # of lines only those that both tables are made of
    held["line"] = cut(flat(spark, sf, "select id, n, k, s, s2, q, d, rf from line where q = 50", lines=lines_around(spark, sf, 50)))
    stars = flat(spark, sf, "select module place, target of, ord from few_imps", held)
    return alias.all_names(flat(spark, sf, "select module place, name from took", held), stars, "f1")


@query("""with r as (select o_orderstatus l_linestatus, o_orderdate since, max(o_orderkey) "order" from orders group by 1, 2)
select l_orderkey, l_linenumber, l_partkey, l_shipdate, since, "order" from lineitem l asof left join r on l.l_linestatus = r.l_linestatus and l.l_shipdate >= r.since""")
def as_of_orders(spark, sf):
    """Every line with the last order of its status by its day: two keys hold all rows."""
    lines = _t(spark, sf, "lineitem").select("l_linestatus", "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    orders = _t(spark, sf, "orders").select(F.col("o_orderstatus").alias("l_linestatus"), F.col("o_orderdate").alias("since"), F.col("o_orderkey").alias("order"))
    return temporal.as_of(lines, orders, ["l_linestatus"], "l_shipdate", "since", rows=4096).drop("l_linestatus")


@query("""with s as (select distinct l_linenumber k, l_partkey low, l_partkey + cast(l_quantity as bigint) high from lineitem), p as (select distinct l_linenumber k, l_suppkey "at" from lineitem),
m as (select p.k, "at", low, high, row_number() over (partition by p.k, "at" order by high - low, low) r from p left join s on s.k = p.k and "at" between low and high) select k, "at", low, high from m where r = 1""")
def innermost_spans(spark, sf):
    """The shortest span around every point of its key."""
    lines = _t(spark, sf, "lineitem")
    spans = lines.select(F.col("l_linenumber").alias("k"), F.col("l_partkey").alias("low"), (F.col("l_partkey") + F.col("l_quantity").cast("long")).alias("high")).distinct()
    return temporal.innermost(lines.select(F.col("l_linenumber").alias("k"), F.col("l_suppkey").alias("at")).distinct(), spans, ["k"], "at", "low", "high")


CHANGES = "select 's' || cast(l_suppkey as string) file, cast(l_orderkey * 10 + l_linenumber as string) || '.' || cast(l_partkey as string) hash, l_shipdate at, cast(l_quantity as bigint) lines from "


@query(f"""with c as ({CHANGES.replace(" at,", ' "at",')} lineitem) select file, hash, "at", lines, sum(lines) over (partition by file order by "at", hash, lines rows 9 preceding)::bigint lines_lately,
count(*) over d changes_in_days, (sum(lines) over d)::bigint lines_in_days from c window d as (partition by file order by "at" range between interval 30 days preceding and current row)""")
def churn_frames(spark, sf):
    """Lines changed in the last ten changes and the last thirty days of every supplier's file."""
    return trends.churn(spark.sql(CHANGES + "{lineitem}", lineitem=_t(spark, sf, "lineitem")))


def _found_sql() -> str:
    """check and symbol of all findings."""
    parts = [f"select '{c}' \"check\", symbol from (with {'recursive ' if recursive else ''}{more + ',' if more else ''} one_row as (select 1) {select})" for c, (more, select, recursive) in check_queries.PARTS.items()]
    return " union all ".join(parts)


_BROADCAST = "spark.sql.autoBroadcastJoinThreshold"


@contextmanager
def _unsent(spark: SparkSession) -> Iterator[None]:
    """No table goes through the driver to be joined: plans of 24 checks send many, which grow with the input."""
    before = spark.conf.get(_BROADCAST)
    spark.conf.set(_BROADCAST, "-1")
    try:
        yield
    finally:
        spark.conf.set(_BROADCAST, before)


def _written(spark: SparkSession, sf: str, held: Held) -> Facts:
    """The facts of all checks, on most of the imports."""
    return facts(spark, sf, check_queries._rules(spark, sf, "dead", held), held=held).written()


def _all_findings(spark: SparkSession, sf: str, whole: Facts, held: Held) -> DataFrame:
    """What all checks find, each on the imports its row has."""
    by: dict[str, list[str]] = {}
    for c in checks.CHECKS:
        by.setdefault(check_queries.IMPORTS.get(c, "imps"), []).append(c)
    out = None
    for imports, names in by.items():
        f = whole if imports == "imps" else replace(whole, tables=whole.tables | {"imports": cut(facts(spark, sf, imports=imports, held=held).imports)})
        part = checks.all_findings(f, names)
        out = part if out is None else out.unionByName(part)
    return out


@query(sql("""select "check", folder, module, cast(grouping("check") * 4 + grouping(folder) * 2 + grouping(module) as int) "level", count(*) findings, count(distinct symbol) symbols
from placed group by grouping sets (("check", folder, module), ("check", folder), ("check"), (folder, module), (folder), ())""",
f"found as ({_found_sql()}), placed as (select \"check\", symbol, split_part(symbol, ':', 1) module, case when split_part(symbol, ':', 1) like '%.%' then split_part(split_part(symbol, ':', 1), '.', 1) else '' end folder from found)"))
def findings_cube(spark, sf):
    """All findings by check, folder and module, with every subtotal."""
    held = Held()
    with _unsent(spark):
        return trends.breakdown(_all_findings(spark, sf, _written(spark, sf, held), held))


def _weights() -> str:
    from crossfile.plans.score import WEIGHTS

    return ", ".join(f"('{axis}', '{c}', {w})" for axis, (_, checks_) in WEIGHTS.items() for c, w in checks_.items())


@query(sql("select r.key, r.\"value\" from r", f"""found as ({_found_sql()}), w(axis, "check", weight) as (values {_weights()}),
n as (select axis, coalesce(sum(case when f."check" is not null then weight end), 0) n from w left join found f on f."check" = w."check" group by axis),
t as (select count(*) n from found where "check" = 'tests_only'), hop as (select y.z % 15 hops from doors join syms y using (sid)),
s as (select count(*) filter (kind in ('function', 'method')) functions, count(*) filter (kind = 'class') classes, count(*) filter (kind <> 'method') others, count(*) filter (not private) public, count(*) filter (kind in ('function', 'method') and lines > 50) long_functions from syms),
m as (select count(*) modules, count(*) filter (lines > 500) long_modules from mods), part(axis, v) as (
select 'direct', avg(case when hops <= 3 then 1.0 else greatest(0.0, 1 - (hops - 3) / 9) end) from hop union all
select 'alive', greatest(0.0, 1 - (select n.n + t.n // 2 from n, t where axis = 'alive') / (others + functions // 2) / 0.15) from s union all
select 'lean', greatest(0.0, 1 - (select n from n where axis = 'lean') / functions / 0.2) from s union all select 'private', greatest(0.0, 1 - (select n from n where axis = 'private') / public / 0.3) from s union all
select 'shaped', greatest(0.0, 1 - (select n from n where axis = 'shaped') / greatest(1, classes + functions // 10) / 0.5) from s union all
select 'focused', (greatest(0.0, 1 - long_functions / functions / 0.1) + greatest(0.0, 1 - long_modules / modules / 0.4) + greatest(0.0, 1 - (select n from n where axis = 'focused') / modules / 0.3)) / 3 from s, m),
v as (select axis key, cast(round_even(100 * v, 0) as int) "value" from part), r as (select * from v union all select 'overall', cast(round_even(avg("value"), 0) as int) from v)"""))
def score_of_all_checks(spark, sf):
    """The axes over what all 24 checks find, with doors as deep as their sizes say."""
    held = Held()
    doors = flat(spark, sf, "select y.sid door, y.z % 15 hops, array(y.sid) path from doors join syms y using (sid)", held)
    with _unsent(spark):
        f = _written(spark, sf, held)
        found = _all_findings(spark, sf, f, held)
    return score(f, found, doors).select("key", "value")


_SHORT = "split_part(symbol, ':', 2)"


@query(sql("""select cast(row_number() over (order by place, module, line, id) as int) "position", "check", symbol, message from (
select 4 place, 'private_abroad' "check", symbol, y.module, y.line, 'private_abroad:' || symbol id, split_part(symbol, ':', 2) || ' is private and used in ' || array_to_string(away[1:3], ', ') message from far f join syms y on y.sid = symbol union all
select 10, 'constant_param', symbol, y.module, y.line, 'constant_param:' || symbol || ':' || key, split_part(key, '=', 1) || ' is ' || split_part(key, '=', 2) || ' in every call' from constants c join syms y on y.sid = symbol union all
select 16, 'duplicate', m[1], y.module, y.line, 'duplicate:' || m[1], split_part(m[1], ':', 2) || ' is written ' || len(m) || ' times' from alike join syms y on y.sid = m[1]
union all select 20, 'scattered_api', symbol, symbol, line, 'scattered_api:' || symbol || ':' || api, api || ' is called in ' || n || ' modules' from wide)""",
    f"""far as (select y.sid symbol, list_sort(list(distinct split_part(u.scope, ':', 1)) filter (split_part(u.scope, ':', 1) <> y.module)) away from syms y join every_user u on u.sid = y.sid where private and last not like '#_#_%' escape '#' group by 1 having bool_or(split_part(u.scope, ':', 1) <> y.module)),
{check_queries.PARTS["constant_param"][0]}, constants as (select symbol, finding_key key from ({check_queries.PARTS["constant_param"][1]})), {check_queries.PARTS["duplicate"][0]},
api_near as (select api, l.module, arg_min(line, id) line from lib l where not built group by all),
wide as (select api, min(n.module) symbol, arg_min(n.line, n.module) line, count(*) n from api_near n join mods m on m.module = n.module group by api having count(*) >= 5 and count(distinct m.folder) >= 2)"""))
def findings_in_order(spark, sf):
    """Findings of four checks with their messages, in the order they are printed."""
    wanted = ["private_abroad", "constant_param", "duplicate", "scattered_api"]
    found = cut(checks.all_findings(facts(spark, sf, check_queries._rules(spark, sf, "cycle")), wanted))
    return checks.numbered(found).select("position", "check", "symbol", "message")


@query("""with n as (select l_returnflag reading, count(distinct l_partkey) parts, count(*) n from lineitem group by 1) select reading, n, parts, true distinct_within, true half_within from n
union all select 'all', count(*), count(distinct l_partkey), true, true from lineitem""")
def sketched_parts(spark, sf):
    """Distinct parts and half of all prices, from states kept for every return flag and merged over them: whether they are as near the
    exact ones as their bounds say."""
    lines = _t(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "reading")
    kept = cut(sketches.states(lines, ["reading"], F.col("l_partkey"), F.col("l_extendedprice")))
    every = kept.unionByName(sketches.merged(kept.withColumn("reading", F.lit("all")), ["reading"]))
    read = sketches.estimates(every)
    both = lines.select("reading", "l_partkey", "l_extendedprice").union(lines.select(F.lit("all"), "l_partkey", "l_extendedprice"))
    exact = both.join(read.select("reading", "q50"), "reading").groupBy("reading").agg(F.count_distinct("l_partkey").alias("parts"), (F.count_if(F.col("l_extendedprice") <= F.col("q50")) / F.count(F.lit(1))).alias("rank"), (F.count_if(F.col("l_extendedprice") < F.col("q50")) / F.count(F.lit(1))).alias("under"))
    near = F.abs(F.col("distinct") - F.col("parts")) <= sketches.distinct_bound() * F.col("parts")
    half = (F.col("rank") >= 0.5 - sketches.rank_bound()) & (F.col("under") <= 0.5 + sketches.rank_bound())
    return read.join(exact, "reading").select("reading", "n", "parts", near.alias("distinct_within"), half.alias("half_within"))
