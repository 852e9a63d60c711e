"""A TypeScript project of twelve files, read without node; the facts expected were written from its lines by hand."""

import json

import pytest
from crossfile.plans import report
from crossfile.rules import project_for
from crossfile.sources import ts_facts, typescript
from crossfile.sources.ts_syntax import Parser, doc_before

FILES = {
    "package.json": '{"name": "shop", "main": "./src/index.ts", "exports": {".": {"import": "./src/index.ts"}, "./tools/*": "./src/tools/*.ts"}, "crossfile": {"keep": ["kept"]}}',
    "tsconfig.json": """{
  // comments are allowed
  "compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["src/*"], "@money": ["src/core/money.ts"]}},
}""",
    "src/index.ts": """export * from "./core";
export { Cart as Basket, type Line } from "./cart.js";
export { default } from "./app";
""",
    "src/app.ts": """import { Cart } from "@/cart";
import { format as show } from "@money";
import type { Line } from "./cart";
import express, { Router } from "express";
import * as path from "node:path";

/** Starts the shop.
 * @param port where
 */
export default function start(port: number, quiet = false, name?: string): void {
  if (!quiet) { console.log(show(port), name); }
  const cart = new Cart("x");
  cart.add({ id: 1 });
  cart.base().touch();
  Router();
  import("./lazy");
}

const helper = async (line: Line) => await hidden(line);

function hidden(line: Line): Line { return line; }
""",
    "src/cart.ts": """import { Base } from "./core/base";
import { Money, LIMIT } from "./core";

export interface Line { id: number }

export class Cart extends Base<Line> {
  private lines: Line[] = [];
  total: Money = new Money(0);
  #secret = 1;
  onAdd = (line: Line) => this.log(line);

  constructor(public owner: string) { super(); }

  add(line: Line): this { this.lines.push(line); this.log(line); this.total.plus(1); return this; }

  base(): Base<Line> { return this; }

  private log(line: Line) { if (this.lines.length > LIMIT) throw new Error("full"); }

  get size() { return this.lines.length; }

  async wait(): Promise<void> { await this.owner; }
}
""",
    "src/core/index.ts": """export * from "./money";
export { Base } from "./base";
export * as deep from "./deep";
""",
    "src/core/base.ts": """import { EventEmitter } from "events";
import { Root } from "./deep";

export abstract class Base<T> extends Root {
  touch(): void {}
  abstract open(): T;
}

export class Loud extends EventEmitter {}
export class Louder extends Loud {}
""",
    "src/core/deep.ts": """export class Root { touchAll(n: number) { return todo(n); } }
function todo(n: number) { throw new Error("Not implemented"); }
export { Root as Deepest };
""",
    "src/core/money.ts": """export const LIMIT = 10;
export type Cash = Money;
export class Money {
  constructor(private cents: number) {}
  plus(more: number): Money { return new Money(this.cents + more); }
  static zero() { return new Money(0); }
}
export function format(cents: number): string { return Money.zero().plus(cents).plus(1) + `€${cents}`; }
export const kept = () => format(1);
""",
    "src/lazy.ts": """import { Loud } from "./core/base";
import { deep, type Cash } from "./core";
function pay(c: Cash, flag: boolean, other?: boolean) { return c.plus(flag ? 1 : 2); }
pay(null as any, true);
new deep.Root().touchAll(3);
const { a, b: c } = { a: 1, b: 2 };
export enum Kind { One, Two }
""",
    "src/tools/view.tsx": """import { kept } from "../core/money";
export const View = ({ size }: { size: number }) => <div title="a">{size > 1 ? <Row n={size} /> : kept()}</div>;
export function Row(props: { n: number }) { return <b>{props.n}</b>; }
""",
    "src/tools/broken.ts": """export function fine() { return 1; }
const = = ;;; %%
export function after() { return fine(); }
""",
    "tests/cart.spec.ts": """import { Cart } from "../src/cart";
test("adds", () => {
  const c = new Cart("me");
  c.add({ id: 2 });
});
""",
    "src/app.test.ts": "import start from './app';\nstart(1);\n",
}


def write(folder, files):
    for name, text in files.items():
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(text)
    return folder / "src"


@pytest.fixture(scope="module")
def facts(spark, tmp_path_factory):
    src = write(tmp_path_factory.mktemp("shop"), FILES)
    return typescript.read(spark, src, project_for(src))


def rows(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=str)


def test_modules_and_imports(facts):
    assert rows(facts.modules, "module", "file", "lines")[:3] == [("app", "src/app.ts", 22), ("cart", "src/cart.ts", 24), ("core.base", "src/core/base.ts", 11)]
    assert facts.modules.count() == 10
    assert rows(facts.imports, "module", "target", "line") == [
        ("app", "cart", 1), ("app", "core.money", 2), ("app", "lazy", 16), ("cart", "core.base", 1), ("cart", "core.index", 2), ("core.base", "core.deep", 2), ("core.index", "core.base", 2), ("core.index", "core.deep", 3),
        ("core.index", "core.money", 1), ("index", "app", 3), ("index", "cart", 2), ("index", "core.index", 1), ("lazy", "core.base", 1), ("lazy", "core.index", 2), ("tools.view", "core.money", 1),
    ]
    assert rows(facts.externals, "module", "target", "line") == [("app", "express", 4), ("app", "node:path", 5), ("core.base", "events", 1)]
    assert rows(facts.taken.where("module in ('app', 'lazy', 'index')"), "module", "target", "name") == [
        ("app", "cart", "Cart"), ("app", "core.money", "format"), ("index", "app", "default"), ("index", "cart", "Cart"), ("index", "cart", "Line"), ("lazy", "core.base", "Loud"), ("lazy", "core.index", "Cash"), ("lazy", "core.index", "deep")
    ]


def test_symbols(facts):
    assert rows(facts.symbols.where("module in ('app', 'cart')"), "sid", "kind", "line", "lines", "private", "owner", "doc") == sorted([
        ("app:start", "function", 10, 8, False, None, "Starts the shop."), ("app:helper", "function", 19, 1, True, None, ""), ("app:hidden", "function", 21, 1, True, None, ""), ("cart:Line", "type", 4, 1, False, None, ""),
        ("cart:Cart", "class", 6, 18, False, None, ""), ("cart:Cart.onAdd", "method", 10, 1, False, "cart:Cart", ""), ("cart:Cart.add", "method", 14, 1, False, "cart:Cart", ""), ("cart:Cart.base", "method", 16, 1, False, "cart:Cart", ""),
        ("cart:Cart.log", "method", 18, 1, True, "cart:Cart", ""), ("cart:Cart.size", "method", 20, 1, False, "cart:Cart", ""), ("cart:Cart.wait", "method", 22, 1, False, "cart:Cart", ""),
    ], key=str)
    assert rows(facts.symbols.where("kind in ('constant', 'type') and module <> 'cart'"), "sid", "kind", "private") == [("core.money:Cash", "type", False), ("core.money:LIMIT", "constant", False), ("lazy:Kind", "type", False)]
    assert rows(facts.symbols.where("module = 'tools.broken'"), "sid") == [("tools.broken:after",), ("tools.broken:fine",)]


def test_calls_resolve_over_files(facts):
    got = {(a, b): lines for a, b, lines in rows(facts.call_edges, "caller", "callee", "lines")}
    assert got == {
        ("app:start", "core.money:format"): [11], ("app:start", "cart:Cart"): [12], ("app:start", "cart:Cart.add"): [13], ("app:start", "cart:Cart.base"): [14], ("app:start", "core.base:Base.touch"): [14],
        ("app:helper", "app:hidden"): [19], ("cart:Cart", "core.money:Money"): [8], ("cart:Cart.onAdd", "cart:Cart.log"): [10], ("cart:Cart.add", "cart:Cart.log"): [14], ("cart:Cart.add", "core.money:Money.plus"): [14],
        ("core.deep:Root.touchAll", "core.deep:todo"): [1], ("core.money:Money.plus", "core.money:Money"): [5], ("core.money:Money.zero", "core.money:Money"): [6], ("core.money:format", "core.money:Money.zero"): [8],
        ("core.money:format", "core.money:Money.plus"): [8], ("core.money:kept", "core.money:format"): [9], ("lazy:pay", "core.money:Money.plus"): [3], ("tools.broken:after", "tools.broken:fine"): [3],
        ("tools.view:View", "core.money:kept"): [2], ("tools.view:View", "tools.view:Row"): [2],
    }


def test_uses(facts):
    got = {}
    for sid, scope in rows(facts.uses, "sid", "scope"):
        got.setdefault(sid, set()).add(scope)
    assert got["core.deep:Root"] == {"core.base:<module>", "core.base:Base", "core.deep:<module>", "lazy:<module>"}
    assert got["core.deep:Root.touchAll"] == {"lazy:<module>"}
    assert got["cart:Cart"] == {"app:<module>", "app:start", "index:<module>"}
    assert got["core.base:Loud"] == {"core.base:Louder", "lazy:<module>"}
    assert got["core.money:LIMIT"] == {"cart:<module>", "cart:Cart.log"}
    assert got["app:start"] == {"index:<module>"} and "cart:Cart.wait" not in got


def test_functions(facts):
    f = {r.sid: r.asDict(recursive=True) for r in facts.functions.collect()}
    s = f["app:start"]
    assert (s["params"], s["defaults"], s["flags"]) == (["port", "quiet", "name"], [{"name": "quiet", "text": "false"}, {"name": "name", "text": "undefined"}], ["quiet"])
    assert s["first_if"] == {"name": "quiet", "start": 11, "end": 11} and s["loads"]["port"] == 1 and s["relayed"] == ["port", "name"] and s["annotations"] == {}
    assert [c["name"] for c in s["calls"]] == ["log", "show", "Cart", "add", "base", "touch", "Router", ""] or [c["name"] for c in s["calls"]] == ["log", "show", "Cart", "add", "touch", "base", "Router", ""]
    worth = {k for k, v in f.items() if v["returns_value"]}
    assert worth == {"app:helper", "app:hidden", "cart:Cart.base", "cart:Cart.size", "core.money:Money.plus", "core.money:Money.zero", "core.money:format", "core.money:kept", "lazy:pay", "tools.view:View", "tools.view:Row", "tools.broken:fine", "tools.broken:after"}
    assert {k for k, v in f.items() if v["stub"]} == {"core.base:Base.touch", "core.deep:todo"}
    assert f["app:helper"]["sole_call"]["name"] == "hidden" and f["app:helper"]["annotations"] == {"line": "Line"} and f["cart:Cart.onAdd"]["sole_call"]["args"][0]["name"] == "line"
    assert f["lazy:pay"]["flags"] == ["flag", "other"] and f["cart:Cart.add"]["receiver_reads"] == {"self": 3}
    assert f["core.money:format"]["shape"] is None


def test_classes_and_library_bases(facts):
    got = {r.sid: r for r in facts.classes.collect()}
    assert {k: (r.bases, r.library_base, r.abstract) for k, r in got.items()} == {
        "cart:Cart": (["Base"], False, False), "core.base:Base": (["Root"], False, True), "core.base:Loud": (["EventEmitter"], True, False), "core.base:Louder": (["Loud"], True, False),
        "core.deep:Root": ([], False, False), "core.money:Money": ([], False, False),
    }
    assert [(x.name, x.type) for x in got["cart:Cart"].fields] == [("lines", "Line[]"), ("total", "Money")]


def test_doors(facts):
    assert rows(facts.entrypoints, "sid") == [(x,) for x in sorted((
        "app:start", "cart:Cart", "cart:Cart.add", "cart:Cart.base", "cart:Cart.onAdd", "cart:Cart.size", "cart:Cart.wait", "cart:Line", "core.base:Base", "core.base:Base.touch", "core.money:Cash", "core.money:LIMIT", "core.money:Money",
        "core.money:Money.plus", "core.money:Money.zero", "core.money:format", "core.money:kept", "tools.broken:after", "tools.broken:fine",  # ./tools/* names .ts files, not .tsx
    ))]


def test_names_and_tests(facts):
    names = {k: {n for kk, n in rows(facts.names, "kind", "name") if kk == k} for k in ("attribute_reads", "handed_in_tests", "listed_names", "called_names")}
    assert {"lines", "length", "owner", "cents", "a", "b", "total"} <= names["attribute_reads"] and names["listed_names"] == set() and "pay" in names["called_names"]
    assert "c" in names["handed_in_tests"] and "add" not in names["handed_in_tests"]
    counts = {(s, n): k for s, n, k in rows(facts.name_counts, "scope", "name", "n")}
    assert counts["package", "Loud"] == 2 and counts["tests", "Cart"] == 2 and counts["package", "kept"] == 2
    assert ("add", "tests/cart.spec.ts", 4, 2, 5) in rows(facts.test_uses, "name", "file", "line", "start", "end") and ("start", "src/app.test.ts", 2, 2, 2) in rows(facts.test_uses, "name", "file", "line", "start", "end")
    assert rows(facts.library_calls, "api", "module", "line", "raised_or_returned") == [("Router", "app", 15, False)]
    given = {(r.name, r.line): r for r in facts.calls.where("file = 'src/lazy.ts'").collect()}
    assert [a.boolean for a in given["pay", 4].args] == [False, True] and given["pay", 4].dropped and given["pay", 4].args[0].names == []


def test_a_whole_reading(facts):
    r = report.reading(facts)
    found = {(x.check, x.symbol) for x in r.rows()}
    assert ("dead", "lazy:Kind") in found and ("bool_flag", "lazy:pay") not in found and not any(s == "core.money:kept" for _, s in found)
    assert 0 <= report.score_json(r)["overall"] <= 100


def chain_of(n, ring):
    """n modules that pass one name on, and a ring of them."""
    files = {"package.json": "{}", "tsconfig.json": "{}", "src/end.ts": "export function far() {}\n", "src/user.ts": "import { far } from './m0';\nexport function use() { far(); }\n"}
    for i in range(n):
        to = f"./m{i + 1}" if i < n - 1 else "./end"
        files[f"src/m{i}.ts"] = (f"export * from '{to}';\n", f"export {{ far }} from '{to}';\n", f"import {{ far as g }} from '{to}';\nexport {{ g as far }};\n")[i % 3]
    for i in range(ring):
        files[f"src/r{i}.ts"] = f"export {{ lost }} from './r{(i + 1) % ring}';\nexport * from './r{(i + 1) % ring}';\n"
    files["src/ringer.ts"] = "import { lost } from './r0';\nexport function call() { lost(); }\n"
    return files


def test_chains_and_rings_of_exports_end(spark, tmp_path):
    f = typescript.read(spark, write(tmp_path, chain_of(20, 5)))
    assert rows(f.call_edges, "caller", "callee") == [("user:use", "end:far")]
    assert ("end:far", "user:<module>") in rows(f.uses, "sid", "scope") and f.uses.where("scope like 'r%'").count() == 0


def test_a_base_five_files_away(spark, tmp_path):
    files = {"package.json": "{}", "tsconfig.json": "{}", "src/c0.ts": "export class C0 { go(): C0 { return this; } }\nclass Odd extends Missing {}\n", "src/ns.ts": "export * as all from './c5';\n"}
    for i in range(1, 6):
        files[f"src/c{i}.ts"] = f"import {{ C{i - 1} }} from './c{i - 1}';\nexport class C{i} extends C{i - 1} {{ up() {{ super.go(); }} }}\n"
    files["src/lib.ts"] = "import { all } from './ns';\nimport { L } from 'lib';\nexport class Far extends all.C5 { m() { this.go().go(); } }\nclass A extends L {}\nclass B extends A {}\nclass Me extends Me {}\n"
    f = typescript.read(spark, write(tmp_path, files))
    assert {r.sid for r in f.classes.where("library_base").collect()} == {"c0:Odd", "lib:A", "lib:B"}
    assert ("lib:Far.m", "c0:C0.go") in rows(f.call_edges, "caller", "callee") and ("c5:C5.up", "c0:C0.go") in rows(f.call_edges, "caller", "callee")


def kinds(source, jsx=False):
    p = Parser(source, jsx)
    tree = p.file()
    return [s.kind for s in tree.statements], p.wrong, tree


@pytest.mark.parametrize(
    "source,first",
    [
        ("const f = <T,>(x: T): x is string => /[/]/g.test(`a${`b${x}`}c`);", "VariableStatement"),
        ("a ? (b) : c => d;", "ExpressionStatement"),
        ("x = a < b && c > (d);", "ExpressionStatement"),
        ("f<Map<string, Array<number>>>(x >>> 2, y >= 3, z! as unknown as T[]);", "ExpressionStatement"),
        ("label: for await (const [k, { v = 1 }] of m) { if (k) continue label; else break }", "LabeledStatement"),
        ("type M<T> = { readonly [K in keyof T as `on${K & string}`]?: T[K] extends infer U ? U : never };", "TypeAliasDeclaration"),
        ("abstract class A<T> extends B.C<T>(x) implements I { static { f() } declare x?: number; get [k](): T { return 1 } private async *g() {} }", "ClassDeclaration"),
        ("declare module 'x' { export default function f(this: Window, ...a: any[]): asserts a is string; }", "ModuleDeclaration"),
        ("export default abstract class { @dec() m?(): void }", "ClassDeclaration"),
        ("let { a, b: { c } = {}, ...rest } = o, g = async <T>(x) => { await x }", "VariableStatement"),
        ("import type { A } from 'a'", "ImportDeclaration"),
        ("enum E { A = 1 << 2, 'b' }", "EnumDeclaration"),
        ("let t: [a: string, b?: number, ...rest: T[]] | (new () => X) | typeof import('y') = null", "VariableStatement"),
        ("switch (x) { case 1: { break } default: throw new Error() }", "SwitchStatement"),
        ("if (a) return\nelse b++", "IfStatement"),
    ],
)
def test_syntax(source, first):
    got, wrong, tree = kinds(source)
    assert got[0] == first and not wrong and len(got) == 1
    assert all(k.up is n for n in tree.walk() for k in n.kids)


def test_jsx_and_what_cannot_be_read():
    got, wrong, tree = kinds("const a = <A.B x='1' {...p} on={() => <></>}>it's {v} <c-d/> </A.B>, b = <T,>(x: T) => x;", True)
    assert got == ["VariableStatement"] and not wrong and {"JsxSelfClosingElement", "JsxFragment", "JsxText", "ArrowFunction"} <= {n.kind for n in tree.walk()}
    got, wrong, _ = kinds("let a = 1;\n@@ (( {{\nexport function f() {}\nclass K { a( ; m() {} }\nlet z = `open ${")
    assert "FunctionDeclaration" in got and wrong
    assert kinds("")[0] == [] and kinds("(" * 3000)[1] and kinds("#!/bin/x\n1")[0] == ["ExpressionStatement"]
    text = "/** a */ /** b\n * c\n @d */\nfunction"
    assert doc_before(text, text.index("function")) == "b" and doc_before("/* a */ x", 8) == ""


def test_shapes_tell_bodies_apart_but_not_names():
    def shape(text):
        s = ts_facts.TsScript("m", "m.ts", text, False)
        s._find_symbols()
        return s._shape(next(iter(s.functions.values())))

    body = "function {f}({a}: number) {{ const {v} = {a} * 2 + g({a}); for (const x of list) {{ if (x > {v}) {{ out.push({lit} + x); }} else {{ out.pop(); }} }} return {v} + {a}; }}"
    one, two = body.format(f="f", a="a", v="v", lit="'s'"), body.format(f="h", a="b", v="w", lit="'s'")
    assert shape(one) == shape(two) is not None and shape(one) != shape(body.format(f="f", a="a", v="v", lit="'t'")) and shape("function s(a) { return a }") is None


def test_settings(tmp_path):
    (tmp_path / "base.json").write_text('{"compilerOptions": {"baseUrl": "lib"}}')
    (tmp_path / "tsconfig.json").write_text('{"extends": "./base.json", "compilerOptions": {"paths": {"a/*": ["x/*"], "a/b/*": ["y/*", "z/*"], "url": ["https//x"]}}, /* c */ "x": "// kept",}')
    base, paths = typescript.paths_of(tmp_path)
    assert base == "lib" and [p for p, _ in paths] == ["a/b/*", "a/*", "url"] or [p for p, _ in paths][0] == "a/b/*"
    assert typescript.candidates("src/m.ts", "../k.js", base, paths)[:3] == ["k.ts", "k.tsx", "k.d.ts"]
    assert typescript.candidates("src/m.ts", "a/b/c", base, paths)[0] == "y/c.ts" and "lib/a/b/c.ts" in typescript.candidates("src/m.ts", "a/b/c", base, paths)
    assert typescript.entry_patterns(json.loads('{"main": "a.ts", "exports": {".": [{"import": "./b.ts"}], "./x/*": "./s/*.ts"}}')) == ["a.ts", "b.ts", "s/*.ts"]
