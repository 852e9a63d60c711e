"""Facts made of the driver's tables, so that every check runs on data that DuckDB reads as well.

Suppliers are modules in folders of nations; parts are symbols in the module of their first line's supplier; lines of an order are
calls, uses, imports and reads, told apart by quantity. All is relative to the tables, so that there are findings at any scale.
``FLAT`` is SQL that Spark and DuckDB both read; braces stand for the tables. ``facts`` nests it into fact tables.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from threading import RLock

from crossfile.facts import Facts
from crossfile.operators.lineage import cut
from crossfile.rules import Project
from crossfile.schemas import ARG, CALL, TABLES
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FLAT = """
line as (select l_orderkey o, l_linenumber n, l_partkey k, l_suppkey s, l_quantity q, l_discount d, l_tax t, l_returnflag rf, l_linestatus ls,
  lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) k2,
  lead(l_suppkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) s2,
  l_orderkey * 1000 + row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) id from {lineitem}),
mods as (select s_suppkey k, case when s_suppkey % 10 = 0 then 's' || cast(s_suppkey as string) else 'n' || cast(s_nationkey as string) || '.s' || cast(s_suppkey as string) end module,
  case when s_suppkey % 10 = 0 then '' else 'n' || cast(s_nationkey as string) end folder, 100 + s_suppkey % 900 lines from {supplier}),
home as (select k, min_by(s, id) s from line group by k),
p as (select p.p_partkey k, h.s, p.p_size z, m.module, row_number() over (partition by h.s, p.p_size % 10, p.p_partkey % 40 order by p.p_partkey) twin from {part} p join home h on p.p_partkey = h.k join mods m on m.k = h.s),
cls as (select s, min(k) c from p where z % 10 in (0, 1) group by s),
raw as (select p.k, p.s, p.z, p.module, case when z % 10 in (0, 1) then 'class' when z % 10 = 2 then 'constant' when z % 10 = 3 and c.c is not null then 'method' else 'function' end kind, c.c,
  case when z % 10 in (0, 1) then 'C' when z % 10 = 2 then 'K' when z = 49 then '__f' when z % 10 = 7 then '_f' when z % 10 = 8 and twin = 1 then 'g' else 'f' end || cast(case when z % 10 = 8 and twin = 1 then p.k % 40 else p.k end as string) last
  from p left join cls c on c.s = p.s),
syms as (select k, z, module, kind, last, case when kind = 'method' then 'C' || cast(c as string) || '.' || last else last end name, module || ':' || case when kind = 'method' then 'C' || cast(c as string) || '.' || last else last end sid,
  case when kind = 'method' then module || ':C' || cast(c as string) end owner, case when kind = 'class' and (c <> k or z % 3 = 0) then 'C' || cast(c as string) end base, last like '#_%' escape '#' private, k % 500 + 1 line, z * 2 lines from raw),
edges as (select a.sid caller, b.sid callee, l.n line from line l join syms a on a.k = l.k join syms b on b.k = l.k2 where l.q >= 44 and a.kind in ('function', 'method') and b.kind in ('function', 'method', 'class')),
users as (select distinct b.sid sid, case when l.n = 1 then a.module || ':<module>' else a.sid end scope from line l join syms a on a.k = l.k join syms b on b.k = l.k2 where l.q < 3 and a.k <> b.k),
every_user as (select sid, scope from users union select callee, caller from edges),
imps as (select a.module, b.module target, min(l.n) line, min(l.id) ord from line l join mods a on a.k = l.s join mods b on b.k = l.s2 where l.q = 50 and a.k <> b.k group by a.module, b.module),
few_imps as (select a.module, b.module target, min(l.n) line, min(l.id) ord from line l join mods a on a.k = l.s join mods b on b.k = l.s2 where l.q = 50 and l.d < 0.05 and a.k % 10 < b.k % 10 + 2 and a.k <> b.k group by a.module, b.module),
steep_imps as (select a.module, b.module target, min(l.n) line, min(l.id) ord from line l join mods a on a.k = l.s join mods b on b.k = l.s2 where l.q = 50 and (l.d < 0.08 and a.k % 10 < b.k % 10 or l.d > 0.095) and a.k <> b.k group by a.module, b.module),
took as (select distinct a.module, b.module target, 'f' || cast(l.k as string) name from line l join mods a on a.k = l.s join mods b on b.k = l.s2 where l.q = 50 and a.k <> b.k and l.rf <> 'R'),
ext as (select m.module, 'lib' || cast(l.k % 9 as string) target, min(l.n) line, min(l.id) ord from line l join mods m on m.k = l.s where l.q = 11 group by m.module, 'lib' || cast(l.k % 9 as string)),
fns as (select sid, module, k, z, kind, last, owner, line, z % 4 np, z % 13 = 0 decorated, z % 17 = 0 stub, z % 2 = 1 returns_value, case when z % 2 = 0 then 'sh' || cast(k % 300 as string) end shape from syms where kind in ('function', 'method')),
params as (select sid, 'a' param, 1 pos from fns where np >= 1 union all select sid, 'b', 2 from fns where np >= 2 union all select sid, 'c', 3 from fns where np >= 3),
called as (select l.id, y.last name, m.module, l.n line, l.n % 3 np, cast(case when y.z % 6 = 0 then y.z else l.n end as string) a, l.rf = 'R' kb, l.rf = 'A' kc, l.d > 0.095 spreads, l.ls = 'F' dropped, l.n = 7 in_tests
  from line l join syms y on y.k = l.k join mods m on m.k = l.s where l.q between 3 and 6 and y.kind in ('function', 'method')),
klass as (select sid, k, z, module, name, base, z % 20 = 0 library_base, z % 20 = 11 decorated, z % 10 = 1 abstract, z % 4 nf from syms where kind = 'class'),
fields as (select sid, 'q' || cast(k % 3 as string) || '_1' field, 't' || cast(k % 2 as string) type, 1 pos from klass where nf >= 1 union all select sid, 'q' || cast(k % 3 as string) || '_2', 'int', 2 from klass where nf >= 2 union all select sid, 'w' || cast(k as string), 'int', 3 from klass where nf >= 3),
lib as (select 'lib.a' || cast(l.k % 60 as string) api, m.module, l.n line, l.rf = 'R' built, l.id from line l join mods m on m.k = l.s where l.q = 10),
handed as (select distinct m.module, y.last name from line l join syms y on y.k = l.k join mods m on m.k = l.s where l.q = 7 and l.ls = 'F'),
attr as (select distinct 'q' || cast(l.k % 3 as string) || '_1' name from line l where l.q = 12 and l.k % 3 < 2 union select distinct 'w' || cast(l.k as string) from line l where l.q = 13),
listed as (select distinct 'C' || cast(l.k as string) name from line l where l.q = 14 and l.ls = 'F'),
serial as (select distinct m.module from line l join mods m on m.k = l.s where l.q = 15 and l.n = 1 and l.d > 0.075),
read_in as (select y.last name, count(*) n from line l join syms y on y.k = l.k where l.q = 8 group by y.last),
tested as (select y.last name, count(*) n from line l join syms y on y.k = l.k where l.q = 9 group by y.last),
test_use as (select distinct y.last name, 't' || cast(l.o % 5 as string) || '.py' file, l.n line, l.n - 1 first, l.n + 3 last from line l join syms y on y.k = l.k where l.q = 9),
doors as (select sid from syms where z % 25 = 5),
kept as (select 'f' || cast(k as string) name from syms where k % 17 = 0),
heads as (select n_nationkey, n_regionkey, min(s_suppkey) k from {supplier} join {nation} on s_nationkey = n_nationkey group by n_nationkey, n_regionkey),
chief as (select n_regionkey, min(k) k from heads group by n_regionkey),
near as (select s.s_suppkey s, h.k, c.k chief from {supplier} s join heads h on h.n_nationkey = s.s_nationkey join chief c on c.n_regionkey = h.n_regionkey),
changed as (select l.o, a.module, a.k from line l join near n on n.s = l.s join mods a on a.k = n.k where l.q = 1 union select l.o, b.module, b.k from line l join near n on n.s = l.s join mods b on b.k = n.chief where l.q = 1 and l.t < 0.07),
commit_at as (select o, row_number() over (order by o desc) - 1 pos from (select distinct o from changed order by o desc limit 1000) x)
"""
TABLE_NAMES = ("lineitem", "supplier", "part", "nation")


#: The flat tables by name, in order.
PARTS = {part.partition(" ")[0]: part.rstrip(",") for part in re.split(r"\n(?=\w+ as \()", FLAT.strip())}


def needed(select: str, parts: dict[str, str]) -> dict[str, str]:
    """The flat tables that a query names, directly or through others: plans of all of them would take longer to make than to run."""
    want: set[str] = set()
    todo = [select]
    while todo:
        new = (set(re.findall(r"\w+", todo.pop())) & parts.keys()) - want
        want |= new
        todo += [parts[n] for n in new]
    return {name: part for name, part in parts.items() if name in want}


#: Flat tables that many others are made of, or that one plan reads many times: those of one binding are written once.
HELD = ("line", "p", "syms", "edges", "near", "changed")


class Held(dict):
    """Flat tables that are written already. Checks that run at a time wait for one to write them, so each is written once."""

    def __init__(self):
        super().__init__()
        self.lock = RLock()


def lines_around(spark: SparkSession, sf: str, quantity: int) -> DataFrame:
    """All lines of the orders that hold a line of a quantity: what follows a line is told by its own order, so other orders need not be
    sorted to tell it of those lines."""
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    some = lines.where(F.col("l_quantity") == quantity).select(F.col("l_orderkey").alias("o")).hint("shuffle_hash")
    return lines.join(some, F.col("l_orderkey").eqNullSafe(F.col("o")), "left_semi")


def flat(spark: SparkSession, sf: str, select: str, held: Held | None = None, first: int = len(HELD), lines: DataFrame | None = None) -> DataFrame:
    """Rows of a query over the flat tables. held: those of the first of HELD that are written already, to which more are added.
    lines: what is read for the table of lines."""
    parts = dict(PARTS)
    if held is not None:
        for i, name in enumerate(HELD[:first]):
            if name in needed(select, parts):
                with held.lock:
                    if name not in held:
                        held[name] = cut(flat(spark, sf, f"select * from {name}", held, i))
            if name in held:
                parts[name] = f"{name} as (select * from {{{name}}})"
    text = f"with {', '.join(needed(select, parts).values())} {select}"
    tables = {t: spark.read.parquet(f"{sf}/{t}.parquet") for t in TABLE_NAMES if f"{{{t}}}" in text}
    if lines is not None and "lineitem" in tables:
        tables["lineitem"] = lines
    return spark.sql(text, **tables, **{n: held[n] for n in HELD if held and n in held and f"{{{n}}}" in text})


class Made(dict):
    """Tables that are made when they are first read."""

    def __init__(self, makers: dict[str, Callable[[], DataFrame]]):
        super().__init__()
        self.makers = makers

    def __missing__(self, name: str) -> DataFrame:
        self[name] = df = self.makers[name]()
        return df


def sql(select: str, more: str = "", recursive: bool = False) -> str:
    """DuckDB SQL over the flat facts. more: further named tables."""
    return f"with {'recursive ' if recursive else ''}{FLAT.format(**{t: t for t in TABLE_NAMES})}{', ' + more if more else ''} {select}"


def _arg(text: str, literal: bool = True, boolean: bool = False, name: str | None = None, of: str | None = None) -> str:
    """An argument as a struct of Spark SQL; text is an expression. of: whose attribute ``name`` is."""
    value = f"'bool ' || {text}" if boolean else f"'int ' || {text}"
    names = f"array('{of}', '{name}')" if of else f"array('{name}')" if name else "cast(array() as array<string>)"
    name = None if of else name
    return f"named_struct('text', {text}, 'literal', {str(literal).lower()}, 'value', {value if literal else 'cast(null as string)'}, 'boolean', {str(boolean).lower()}, 'name', {f"'{name}'" if name else 'cast(null as string)'}, 'attr_of', {f"'{of}'" if of else 'cast(null as string)'}, 'names', {names})"


def facts(spark: SparkSession, sf: str, rules: Project = Project(), imports: str = "imps", held: Held | None = None) -> Facts:
    """All fact tables. imports: which of the flat tables of imports. held: flat tables written for other facts of the same tables."""
    held = Held() if held is None else held
    q = lambda select: flat(spark, sf, select, held)
    none = "cast(array() as array<string>)"
    def calls() -> DataFrame:
        keywords = f"filter(array(case when kb then named_struct('k', 'b', 'arg', {_arg("'True'", boolean=True)}) end, case when kc then named_struct('k', 'c', 'arg', {_arg("'1'")}) end), x -> x is not null)"
        args = f"slice(array({_arg('a')}, {_arg("'2'")}, {_arg("'3'")}), 1, np)"
        return q(f"select id call_id, name, replace(module, '.', '/') || '.py' file, line, {args} args, {keywords} keywords, spreads, dropped, in_tests from called")

    def functions() -> DataFrame:
        own = F.array_sort(F.collect_list(F.struct("pos", "param")))
        params = q("select * from params").groupBy("sid").agg(F.transform(own, lambda x: x["param"]).alias("params"))
        # Calls that functions make: of each own callee, with the parameters both ends have, handed on under their names.
        hand = q("select distinct caller, callee, line from edges").join(q("select sid callee, np theirs, last from fns"), "callee").join(q("select sid caller, np own from fns"), "caller")
        inner = hand.selectExpr("caller sid", f"named_struct('name', last, 'file', 'x.py', 'line', cast(line as int), 'args', slice(array({', '.join(_arg(f"'{n}'", literal=False, name=n) for n in 'abc')}), 1, least(own, theirs)), 'keywords', cast(array() as array<struct<k:string,arg:{ARG}>>), 'spreads', false, 'dropped', false, 'in_tests', false) c")
        inner = inner.groupBy("sid").agg(F.collect_list("c").alias("calls"))
        first = f"case when z % 6 = 3 then {_arg("'self.a'", literal=False, name='a', of='self')} when k % 3 = 0 then {_arg("'other.a'", literal=False, name='a', of='other')} else {_arg("'a'", literal=False, name='a')} end"
        sole = f"case when z % 3 = 0 and np > 0 then named_struct('name', 'x', 'file', 'x.py', 'line', cast(line as int), 'args', slice(array({first}, {', '.join(_arg(f"'{n}'", literal=False, name=n) for n in 'bc')}), 1, np - cast(z % 5 = 1 as int)), 'keywords', cast(array() as array<struct<k:string,arg:{ARG}>>), 'spreads', z % 9 = 0, 'dropped', false, 'in_tests', false) end"
        body = q(
            f"select sid, last name, np, slice(array(named_struct('name', 'c', 'text', '1')), 1, cast(np = 3 as int)) defaults, slice(array('b'), 1, cast(np >= 2 as int)) flags, decorated, stub, returns_value, "
            f"map_from_entries(filter(array(struct('a', cast(z % 3 <> 0 as int)), struct('b', cast(z % 5 <> 0 as int)), struct('c', cast(z % 7 <> 0 as int))), x -> x.col2 > 0)) loads, filter(array(case when np >= 1 and z % 3 = 1 then 'a' end, case when np >= 2 and z % 3 <> 0 then 'b' end, case when np >= 3 and z % 3 = 2 then '_x' end), x -> x is not null) relayed, "
            f"{sole} sole_call, case when np >= 2 and z % 5 = 4 then named_struct('name', 'b', 'start', cast(line as int), 'end', cast(line + 2 as int)) end first_if, shape, map('self', cast(z % 3 as int), 'a', cast(z % 9 as int)) receiver_reads, "
            "map('a', coalesce(split_part(owner, ':', 2), 'C0')) annotations, k ord from fns"
        )
        return body.join(params, "sid", "left").withColumn("params", F.coalesce("params", F.expr(none))).withColumn("positional", F.col("params")).join(inner, "sid", "left").withColumn("calls", F.coalesce("calls", F.expr(f"cast(array() as array<{CALL}>)")))

    def classes() -> DataFrame:
        fields = q("select * from fields").groupBy("sid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "field", "type"))), lambda x: F.struct(x["field"].alias("name"), x["type"].alias("type"))).alias("fields"))
        return q("select sid, case when base is null then array() else array(base) end bases, library_base, decorated, abstract, k ord from klass").join(fields, "sid", "left").withColumn("fields", F.coalesce("fields", F.expr("cast(array() as array<struct<name:string,type:string>>)")))

    made = {
        "modules": lambda: q("select module, replace(module, '.', '/') || '.py' file, lines, k ord from mods"), "imports": lambda: q(f"select * from {imports}"), "externals": lambda: q("select * from ext"), "taken": lambda: q("select * from took"),
        "symbols": lambda: q("select sid, module, name, kind, '' doc, line, lines, private, owner, k ord from syms"), "uses": lambda: q("select * from users"),
        "call_edges": lambda: q("select * from edges").groupBy("caller", "callee").agg(F.array_sort(F.collect_set(F.col("line").cast("int"))).alias("lines")), "calls": calls, "functions": functions, "classes": classes,
        "library_calls": lambda: q("select api, module, line, built raised_or_returned, id ord from lib"),
        "names": lambda: q("select 'handed' kind, module, name from handed union all select 'attribute_reads', '', name from attr union all select 'listed_names', '', name from listed union all select 'called_names', module, 'asdict' from serial"),
        "name_counts": lambda: q("select 'package' scope, name, n from read_in union all select 'tests', name, n from tested"), "test_uses": lambda: q("select name, file, line, first start, last `end` from test_use"),
        "commit_files": lambda: q("select cast(c.o as string) hash, '' subject, cast(a.pos as int) pos, replace(c.module, '.', '/') || '.py' file from changed c join commit_at a on a.o = c.o"), "entrypoints": lambda: q("select sid from doors"),
    }

    def fitted(name: str) -> DataFrame:
        kind = StructType.fromDDL(TABLES[name])
        return made[name]().select(*[F.col(f"`{c}`") for c in kind.names]).to(kind)

    return Facts(spark, Made({n: (lambda n=n: fitted(n)) for n in made}), rules)
