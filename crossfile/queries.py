"""The engine's analytics bound to the driver's tables, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from crossfile import bindings, check_queries, relation_queries
from crossfile.functions.scalars import glob_regex, half_even
from crossfile.operators import graph
from crossfile.operators.lineage import cut, dealt
from crossfile.plans import checks
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
SQL_STEPS = f"""steps as (select l_suppkey src, lead(l_suppkey) over (partition by l_orderkey order by {", ".join(LINE_ORDER)}) dst from lineitem),
weighted as (select src, dst, count(*) n from steps where dst is not null and src <> dst group by all)"""


def weighted_edges(spark: SparkSession, sf: str) -> DataFrame:
    """src, dst, n: supplier to next supplier in an order."""
    nxt = F.lead("l_suppkey").over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER))
    lines = _t(spark, sf, "lineitem").select("l_orderkey", *LINE_ORDER)
    rows = lines.count()
    steps = dealt(lines, rows, "l_orderkey").select(F.col("l_suppkey").alias("src"), nxt.alias("dst")).where("src <> dst")
    return dealt(steps, rows, "src", "dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def _edges(spark: SparkSession, sf: str, least: int) -> DataFrame:
    return weighted_edges(spark, sf).where(f"n >= {least}").select("src", "dst")


def _sql_edges(least: int) -> str:
    return f"with recursive {SQL_STEPS}, edges as (select src, dst from weighted where n >= {least})"


def _event_edges(spark: SparkSession, sf: str) -> DataFrame:
    nxt = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return _t(spark, sf, "events").select(F.col("event_type").alias("src"), nxt.alias("dst")).where("src <> dst").distinct()


SQL_EVENTS = "with recursive s as (select event_type src, lead(event_type) over (partition by user_id order by ts, event_id) dst from events), edges as (select distinct src, dst from s where src <> dst)"


@query("""with d as (select doc_id, md5(lower(regexp_replace(coalesce(text, ''), '[ \t\n\r]+', ' ', 'g'))) shape from documents)
select shape, min(doc_id) first_doc, count(*) n from d group by shape having count(*) >= 2""")
def duplicate_bodies(spark, sf):
    d = _t(spark, sf, "documents").select("doc_id", F.md5(F.lower(F.regexp_replace(F.coalesce("text", F.lit("")), r"[ \t\n\r]+", " "))).alias("shape"))
    return d.groupBy("shape").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n")).where("n >= 2")


@query("""with f as (select distinct l_orderkey h, l_partkey p from lineitem), k as (select h, p, count(*) over (partition by h) n from f),
s as (select * from k where n <= 20), c as (select p, count(*) changes from s group by p)
select a.p a, b.p b, count(*) together, least(any_value(ca.changes), any_value(cb.changes)) rarer
from s a join s b on a.h = b.h and a.p < b.p join c ca on ca.p = a.p join c cb on cb.p = b.p group by a.p, b.p having count(*) >= 3""")
def co_change_pairs(spark, sf):
    lines = _t(spark, sf, "lineitem")
    commits = lines.select(F.col("l_orderkey").alias("hash"), F.lit("").alias("subject"), F.lit(0).alias("pos"), F.col("l_partkey").alias("file"))
    pairs = checks.co_changes(commits, lines.count()).where("together >= 3")
    return pairs.select("a", "b", "together", F.least("changes_a", "changes_b").alias("rarer"))


@query("""select l_orderkey, count(distinct l_partkey) parts from lineitem group by 1 having count(distinct l_partkey) between 1 and 8""")
def co_change_sweep_cut(spark, sf):
    return _t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count_distinct("l_partkey").alias("parts")).where("parts between 1 and 8")


@query(f"""with {SQL_STEPS}, o as (select src node, count(*) fan_out from weighted group by 1), i as (select dst node, count(*) fan_in from weighted group by 1)
select coalesce(o.node, i.node) node, coalesce(fan_in, 0) fan_in, coalesce(fan_out, 0) fan_out from o full join i on o.node = i.node""")
def import_graph_degrees(spark, sf):
    return checks.instability(weighted_edges(spark, sf)).select("node", "fan_in", "fan_out")


SQL_INSTABILITY = """o as (select src node, count(*) fan_out from edges group by 1), i as (select dst node, count(*) fan_in from edges group by 1),
k as (select coalesce(o.node, i.node) node, coalesce(fan_in, 0) fan_in, coalesce(fan_out, 0) fan_out from o full join i on o.node = i.node)
select node, fan_in, round(fan_out / (fan_in + fan_out), 9) instability from k where fan_in >= 5"""


@query(f"{_sql_edges(1)}, {SQL_INSTABILITY}")
def instability_whole(spark, sf):
    return checks.instability(_edges(spark, sf, 1)).where("fan_in >= 5").select("node", "fan_in", F.round("instability", 9).alias("instability"))


@query("""with t as (select l_suppkey s, l_orderkey o, count(distinct l_partkey) taken from lineitem group by 1, 2), p as (select l_suppkey s, count(distinct l_partkey) parts from lineitem group by 1)
select t.s supplier, round(median(taken / parts), 9) share from t join p on t.s = p.s group by t.s""")
def hub_median_share(spark, sf):
    li = _t(spark, sf, "lineitem")
    taken = li.groupBy(F.col("l_suppkey").alias("supplier"), "l_orderkey").agg(F.count_distinct("l_partkey").alias("taken"))
    parts = li.groupBy(F.col("l_suppkey").alias("supplier")).agg(F.count_distinct("l_partkey").alias("parts"))
    return taken.join(parts, "supplier").groupBy("supplier").agg(F.round(F.median(F.col("taken") / F.col("parts")), 9).alias("share"))


SQL_CLOSURE = "reach(a, b) as (select src, dst from edges union select r.a, e.dst from reach r join edges e on r.b = e.src)"


@query(f"""{_sql_edges(1)}, {SQL_CLOSURE} select x.a node, min(y.a) component from reach x join reach y on x.a = y.b and x.b = y.a group by x.a having count(distinct y.a) > 1""")
def scc_modules_whole(spark, sf):
    return graph.strong_components(_edges(spark, sf, 1))


@query(f"""{_sql_edges(1)}, twoway as (select src a, dst b from edges union select dst, src from edges), reach(a, b) as (select a, b from twoway union select r.a, e.b from reach r join twoway e on r.b = e.a)
select a node, least(a, min(b)) component from reach group by a""")
def components_whole(spark, sf):
    return graph.components(_edges(spark, sf, 1))


SQL_LEAST = """dist as (select node, min(hops) d from met group by 1),
least(node, path, d) as (select b, [b], 0 from start union all select w.dst, min(list_append(path, w.dst)), any_value(l.d + 1) from least l join ways w on w.src = l.node join dist x on x.node = w.dst and x.d = l.d + 1 group by w.dst)"""


def _sql_met(start: str, ways: str) -> str:
    """Least shortest paths from a node. A hop more than there are nodes leads nowhere new."""
    return f"""{_sql_edges(1)}, n as (select count(distinct src) + count(distinct dst) n from edges), start as ({start}), ways as ({ways}),
met(node, hops) as (select b, 0 from start union select w.dst, hops + 1 from met join ways w on w.src = met.node, n where hops < n.n), {SQL_LEAST}"""


@query(f"""{_sql_met("select min(src) b from edges", "select src, dst from edges")} select len(path) - 1 hops, array_to_string(path, '>') path from least where node = (select max(dst) from edges)""")
def shortest_flow_whole(spark, sf):
    """The shortest way from the least to the greatest supplier, at any number of hops."""
    return _flow_ends(_edges(spark, sf, 1))


def _flow_ends(edges: DataFrame) -> DataFrame:
    e = cut(edges)
    ends = e.agg(F.min("src"), F.max("dst")).first()
    if ends[0] is None:
        return e.sparkSession.createDataFrame([], "hops int, path string")
    return graph.flow(e, list(ends)).select((F.size("path") - 1).alias("hops"), F.concat_ws(">", "path").alias("path"))


@query(f"""{_sql_met("select max(dst) b from edges", "select dst src, src dst from edges")} select node door, len(path) - 1 hops, array_to_string(list_reverse(path), '>') path from least""")
def reach_doors_whole(spark, sf):
    """The suppliers that reach the greatest one, each with its nearest way, at any number of hops."""
    return _reach_whole(_edges(spark, sf, 1))


def _reach_whole(edges: DataFrame) -> DataFrame:
    e = cut(edges)
    found = graph.reaching(e, e.agg(F.max("dst").alias("node")).where("node is not null"), graph.vertices(e))
    return found.select("door", "hops", F.concat_ws(">", "path").alias("path"))


@query(f"""{SQL_EVENTS}, p(door, path) as (select distinct src, [src] from edges union all select door, list_append(path, e.dst) from p join edges e on p.path[-1] = e.src where not list_contains(path, e.dst)),
k as (select door, path, row_number() over (partition by door order by len(path) desc, path) r from p) select door, len(path) - 1 hops, array_to_string(path, '>') path from k where r = 1""")
def longest_simple_chain(spark, sf):
    e = _event_edges(spark, sf)
    return graph.longest_chains(e, e.select(F.col("src").alias("node")).distinct()).select("door", "hops", F.concat_ws(">", "path").alias("path"))


@query(f"""{SQL_EVENTS}, p(start, path) as (select distinct src, [src] from edges union all
select start, list_append(path, nxt) from (select start, path, min(e.dst) nxt from p join edges e on p.path[-1] = e.src where not list_contains(path, e.dst) group by start, path)),
k as (select start, path, row_number() over (partition by start order by len(path) desc) r from p) select start, array_to_string(path, '>') path from k where r = 1""")
def greedy_chain(spark, sf):
    e = _event_edges(spark, sf)
    return graph.greedy_chains(e, e.select(F.col("src").alias("node")).distinct()).select("start", F.concat_ws(">", "path").alias("path"))


#: Layers of the graph of strong components, from edges e(src, dst) and reach(a, b), their closure.
SQL_LAYERS = """ring as (select x.a node, min(y.a) g from reach x join reach y on x.a = y.b and x.b = y.a group by 1),
node as (select n.node, coalesce(g, n.node) g from (select src node from e union select dst from e) n left join ring r on r.node = n.node),
way as (select distinct a.g src, b.g dst from e join node a on a.node = e.src join node b on b.node = e.dst where a.g <> b.g),
level(g, d) as (select distinct g, 0 from node union select w.src, d + 1 from level l join way w on w.dst = l.g)
select node, max(d) layer from node join level using (g) group by node"""


@query(f"{_sql_edges(1)}, e as (select src, dst from edges), {SQL_CLOSURE}, {SQL_LAYERS}")
def layer_depth_whole(spark, sf):
    """Layers of all suppliers, however deep; nodes on a cycle share a layer."""
    return graph.layers(_edges(spark, sf, 1))


@query(f"""{_sql_edges(1)}, r as (select s_suppkey k, n_regionkey rank from supplier join nation on s_nationkey = n_nationkey)
select src, dst, b.rank - a.rank up from edges join r a on src = a.k join r b on dst = b.k where b.rank > a.rank""")
def layer_violation_whole(spark, sf):
    return _violations(spark, sf, 1)


def _violations(spark: SparkSession, sf: str, least: int) -> DataFrame:
    ranks = _t(spark, sf, "supplier").join(_t(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_regionkey")
    a, b = ranks.toDF("src", "low"), ranks.toDF("dst", "high")
    return _edges(spark, sf, least).join(a, "src").join(b, "dst").where("high > low").select("src", "dst", (F.col("high") - F.col("low")).alias("up"))


HREF = r'href="([^"]*)"'


def _hrefs(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]*)", 1).alias("host"), F.explode(F.regexp_extract_all("html", F.lit(HREF), 1)).alias("href"))


SQL_HREFS = f"h as (select page_id, regexp_extract(url, '^[a-z]+://([^/]*)', 1) host, unnest(regexp_extract_all(html, '{HREF}', 1)) href from pages)"
BANS = ["/a", "/b", "http://", "https://", "#"]


@query(f"""with {SQL_HREFS}, b as (select unnest({BANS!r}) banned, generate_subscripts({BANS!r}, 1) place)
select page_id, href, count(*) n, arg_min(banned, place) banned from (select page_id, href, banned, place, row_number() over (partition by page_id, href, place) from h join b on starts_with(href, banned)) group by page_id, href""".replace("count(*) n, ", ""))
def forbidden_prefix(spark, sf):
    bans = spark.createDataFrame(list(zip(BANS, range(len(BANS)), strict=True)), "banned string, place int")
    return _hrefs(spark, sf).join(F.broadcast(bans), F.expr("startswith(href, banned)")).groupBy("page_id", "href").agg(F.min_by("banned", "place").alias("banned"))


@query(f"""with {SQL_HREFS} select regexp_extract(href, '^/?([^/?#]*)', 1) api, count(distinct page_id) modules, count(distinct host) folders from h group by 1 having count(distinct page_id) >= 5 and count(distinct host) >= 2""")
def scattered_calls(spark, sf):
    used = _hrefs(spark, sf).withColumn("api", F.regexp_extract("href", "^/?([^/?#]*)", 1))
    return used.groupBy("api").agg(F.count_distinct("page_id").alias("modules"), F.count_distinct("host").alias("folders")).where("modules >= 5 and folders >= 2")


@query("""select l_orderkey, count(*) n, min(l_returnflag) "value" from lineitem group by 1 having count(*) >= 2 and count(distinct l_returnflag) = 1""")
def constant_value(spark, sf):
    return _t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.min("l_returnflag").alias("value"), F.count_distinct("l_returnflag").alias("d")).where("n >= 2 and d = 1").drop("d")


@query("""select l_orderkey, count(*) n from lineitem group by 1 having bool_and(l_discount > 0.05)""")
def all_dropped(spark, sf):
    return _t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("l_discount") > 0.05).alias("all")).where("all").drop("all")


@query("""select p_partkey from part where not exists (select 1 from lineitem where l_partkey = p_partkey and l_tax >= 0.08)""")
def never_given(spark, sf):
    return _t(spark, sf, "part").select("p_partkey").join(_t(spark, sf, "lineitem").where("l_tax >= 0.08").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti")


@query("""select user_id, cast(ts as date) "day", count(*) n from events group by 1, 2 having not bool_or(event_type = 'purchase')""")
def never_read(spark, sf):
    return _t(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("event_type") == "purchase").alias("p")).where("not p").select("user_id", "day", "n")


@query("""select p_partkey, p_name from part where not exists (select 1 from lineitem where l_partkey = p_partkey and l_quantity >= 45)""")
def dead_nodes(spark, sf):
    return _t(spark, sf, "part").select("p_partkey", "p_name").join(_t(spark, sf, "lineitem").where("l_quantity >= 45").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti")


@query("""select p_partkey from part where not exists (select 1 from lineitem where l_partkey = p_partkey and l_quantity >= 45) and exists (select 1 from lineitem where l_partkey = p_partkey and l_quantity < 45)""")
def tests_only(spark, sf):
    li = _t(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_quantity")
    return _t(spark, sf, "part").select("p_partkey").join(li.where("l_quantity >= 45"), "p_partkey", "left_anti").join(li.where("l_quantity < 45"), "p_partkey", "left_semi")


def _order_nations(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "lineitem").join(_t(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey").groupBy("l_orderkey").agg(F.count_distinct("s_nationkey").alias("nations"), F.min("s_nationkey").alias("first_nation"))


SQL_NATIONS = "select l_orderkey, count(distinct s_nationkey) nations, min(s_nationkey) first_nation from lineitem join supplier on l_suppkey = s_suppkey group by 1"


@query(f"select l_orderkey, first_nation from ({SQL_NATIONS}) where nations = 1")
def home_only(spark, sf):
    return _order_nations(spark, sf).where("nations = 1").select("l_orderkey", "first_nation")


@query(f"select l_orderkey, nations from ({SQL_NATIONS}) where nations > 1")
def abroad(spark, sf):
    return _order_nations(spark, sf).where("nations > 1").select("l_orderkey", "nations")


@query("""with s as (select conv_id, array_to_string(list_sort(list(distinct role || ':' || turn)), ',') shape from conversations group by 1),
k as (select conv_id, shape, first_value(conv_id) over w first_conv, row_number() over w r from s window w as (partition by shape order by conv_id)) select conv_id, first_conv, shape from k where r > 1""")
def twin_shapes(spark, sf):
    s = _t(spark, sf, "conversations").groupBy("conv_id").agg(F.concat_ws(",", F.array_sort(F.collect_set(F.concat("role", F.lit(":"), F.col("turn").cast("string"))))).alias("shape"))
    w = Window.partitionBy("shape").orderBy("conv_id")
    return s.withColumn("first_conv", F.first("conv_id").over(w)).withColumn("r", F.row_number().over(w)).where("r > 1").select("conv_id", "first_conv", "shape")


@query("""select distinct k field from (select unnest(json_keys(props)) k from events) where k not in ('id', 'name')""")
def unread_field(spark, sf):
    return _t(spark, sf, "events").select(F.explode(F.expr("json_object_keys(props)")).alias("field")).where("field not in ('id', 'name')").distinct()


@query("""with c as (select o_custkey, o_orderpriority p, count(*) n from orders group by 1, 2), t as (select o_custkey, p, n, row_number() over (partition by o_custkey order by n desc, p) r, sum(n) over (partition by o_custkey) total from c)
select o_custkey, p priority, n reads from t where r = 1 and n >= 4 and n > 2 * (total - n)""")
def envy(spark, sf):
    c = _t(spark, sf, "orders").groupBy("o_custkey", F.col("o_orderpriority").alias("priority")).agg(F.count(F.lit(1)).alias("reads"))
    w = Window.partitionBy("o_custkey")
    c = c.withColumn("r", F.row_number().over(w.orderBy(F.desc("reads"), "priority"))).withColumn("total", F.sum("reads").over(w))
    return c.where("r = 1 and reads >= 4 and reads > 2 * (total - reads)").select("o_custkey", "priority", "reads")


@query("""select n_name, min(s_name) only_supplier from nation join supplier on n_nationkey = s_nationkey group by n_name having count(*) = 1""")
def single_implementation(spark, sf):
    return _t(spark, sf, "nation").join(_t(spark, sf, "supplier"), F.col("n_nationkey") == F.col("s_nationkey")).groupBy("n_name").agg(F.min("s_name").alias("only_supplier"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")


@query("""with b as (select distinct l_orderkey o, l_suppkey s from lineitem)
select x.s || ',' || y.s || ',' || z.s names, count(*) baskets from b x join b y on x.o = y.o and x.s < y.s join b z on z.o = y.o and y.s < z.s group by 1 having count(*) >= 3""")
def clump_sets(spark, sf):
    """Sets of three that stand together in three orders or more: every order's own sets, counted."""
    lines = _t(spark, sf, "lineitem").select("l_orderkey", "l_suppkey")
    rows = lines.count()
    b = dealt(lines, rows, "l_orderkey").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("s"))
    after = lambda xs, x: F.filter(xs, lambda y: y > x)
    triples = F.flatten(F.transform("s", lambda x: F.flatten(F.transform(after("s", x), lambda y: F.transform(after("s", y), lambda z: F.struct(x.alias("x"), y.alias("y"), z.alias("z")))))))
    # Few sets stand twice: they are dealt as they are, three numbers each.
    found = dealt(b.select(F.explode(triples).alias("t")).select("t.*"), 4 * rows, "x", "y", "z").groupBy("x", "y", "z").agg(F.count(F.lit(1)).alias("baskets")).where("baskets >= 3")
    return found.select(F.concat_ws(",", *[F.col(c).cast("string") for c in "xyz"]).alias("names"), "baskets")


GLOBS = ["*/index*", "https://*1*", "*.org/*", "http*"]


@query("select page_id, case " + " ".join(f"when regexp_matches(url, '{glob_regex(g)}') then {i}" for i, g in enumerate(GLOBS)) + " end rule from pages")
def skip_first_match(spark, sf):
    rule = F.coalesce(*[F.when(F.col("url").rlike(glob_regex(g)), F.lit(i)) for i, g in enumerate(GLOBS)])
    return _t(spark, sf, "pages").select("page_id", rule.alias("rule"))


@query("""with n as (select count(*) filter (where l_returnflag = 'R') r, count(*) filter (where l_discount = 0) z, count(*) total from lineitem),
a as (select 'returned' "key", greatest(0.0, 1 - r / total / 0.5) v from n union all select 'undiscounted', greatest(0.0, 1 - z / total / 0.2) from n)
select "key", cast(round_even(100 * v, 0) as int) "value" from a union all select 'overall', cast(round_even(sum(round_even(100 * v, 0)) / 2, 0) as int) from a""")
def score_card(spark, sf):
    n = _t(spark, sf, "lineitem").agg(F.count_if(F.col("l_returnflag") == "R").alias("r"), F.count_if(F.col("l_discount") == 0).alias("z"), F.count(F.lit(1)).alias("t"))
    part = lambda c, zero: half_even(100 * F.greatest(F.lit(0.0), 1 - F.col(c) / F.col("t") / zero))
    n = n.select(part("r", 0.5).alias("a"), part("z", 0.2).alias("b")).withColumn("o", half_even((F.col("a") + F.col("b")) / 2))
    return n.selectExpr("stack(3, 'returned', a, 'undiscounted', b, 'overall', o) as (key, value)")


@query("""with m as (select date_trunc('day', min(ts) + (max(ts) - min(ts)) / 2) mid from events), a as (select distinct user_id, event_type from events, m where ts < mid or ts is null), b as (select distinct user_id, event_type from events, m where ts >= mid)
select coalesce(a.user_id, b.user_id) user_id, coalesce(a.event_type, b.event_type) event_type, case when a.user_id is null then 'new' when b.user_id is null then 'fixed' else 'told' end state from a full join b on a.user_id = b.user_id and a.event_type = b.event_type""")
def told_new_fixed_whole(spark, sf):
    """What users do before and from the day in the middle of the table's time."""
    from crossfile.streaming.diff import snapshot_diff

    e = _t(spark, sf, "events")
    mid = e.agg(F.expr("date_trunc('DAY', min(ts) + (max(ts) - min(ts)) / 2)").alias("mid"))
    e = e.crossJoin(F.broadcast(mid))  # one row
    snap = lambda late: e.where("ts >= mid" if late else "ts < mid or ts is null").select("user_id", "event_type").distinct()
    return snapshot_diff(snap(False), snap(True), ["user_id", "event_type"])


@query("""select event_type, json_extract_string(props, '$.k') given, count(*) n from events group by 1, 2""")
def json_args_given(spark, sf):
    return _t(spark, sf, "events").groupBy("event_type", F.get_json_object("props", "$.k").alias("given")).agg(F.count(F.lit(1)).alias("n"))


@query("""select o_custkey, o_orderkey, r from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) r from orders) where r <= 3""")
def stop_limits(spark, sf):
    r = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return _t(spark, sf, "orders").select("o_custkey", "o_orderkey", r.alias("r")).where("r <= 3")


@query(ORACLES["scc_modules_whole"])
def scc_in_rounds(spark, sf):
    """Strong components of suppliers by distributed rounds, at any size."""
    return graph.strong_components(_edges(spark, sf, 1), one_task=0)


@query("""with recursive edges as (select distinct o_orderkey % 12 src, (o_orderkey % 12 + 1 + o_custkey % 2) % 12 dst from orders),
p(door, path) as (select distinct src, [src] from edges union all select door, list_append(path, e.dst) from p join edges e on p.path[-1] = e.src where not list_contains(path, e.dst)),
k as (select door, path, row_number() over (partition by door order by len(path) desc, path) r from p) select door, len(path) - 1 hops, array_to_string(path, '>') path from k where r = 1""")
def chains_in_rounds(spark, sf):
    """Longest simple paths by distributed rounds on a ring of twelve residues, of which every order ties two."""
    e = _t(spark, sf, "orders").selectExpr("o_orderkey % 12 src", "(o_orderkey % 12 + 1 + o_custkey % 2) % 12 dst").distinct()
    return graph.longest_chains(e, e.select(F.col("src").alias("node")).distinct(), one_task=0).select("door", "hops", F.concat_ws(">", "path").alias("path"))


def _module_edges(spark: SparkSession, sf: str) -> DataFrame:
    return bindings.flat(spark, sf, "select module src, target dst from few_imps")


@query(bindings.sql(SQL_LAYERS.rpartition("\n")[2], f"e as (select module src, target dst from few_imps), {SQL_CLOSURE.replace('edges', 'e')}, {SQL_LAYERS.rpartition(chr(10))[0]}", recursive=True))
def module_layers(spark, sf):
    """Layers of modules of which some are on rings and most aren't."""
    return graph.layers(_module_edges(spark, sf))


QUERIES |= check_queries.QUERIES | relation_queries.QUERIES
ORACLES |= check_queries.ORACLES | relation_queries.ORACLES
