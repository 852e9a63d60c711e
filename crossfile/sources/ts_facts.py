"""What one TypeScript file says by itself: facts that need no other file, and what is to be resolved over all of them.

Names that are used are told as chains: a place to start from ("name" and a name of the module, "this" or "super" and a class, "export" and a
name the module exports) and steps (".name", "()", "new", and "inst", from a type to what has it). ``typescript`` follows them.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections import Counter
from collections.abc import Iterator

from crossfile.sources.ts_syntax import Node, Parser, doc_before

#: A body of fewer nodes is too small to be a copy. A fixed value.
SHAPE_NODES = 40
#: How far from a name its type is looked for.
FAR = 8
_UPPER = re.compile(r"[A-Z][A-Z0-9_]*")
_UNBUILT = re.compile("not implemented", re.I)
LITERALS = frozenset(("NumericLiteral", "StringLiteral", "NoSubstitutionTemplateLiteral", "TrueKeyword", "FalseKeyword", "NullKeyword", "BigIntLiteral"))
FUNCTIONS = frozenset(("FunctionDeclaration", "FunctionExpression", "ArrowFunction", "MethodDeclaration", "GetAccessor", "SetAccessor", "Constructor"))
VALUES = frozenset(("ArrowFunction", "FunctionExpression"))
#: Declarations whose own name isn't a use of it.
NAMED = frozenset(
    ("FunctionDeclaration", "ClassDeclaration", "MethodDeclaration", "VariableDeclaration", "InterfaceDeclaration", "TypeAliasDeclaration", "PropertyDeclaration", "Parameter", "EnumDeclaration", "PropertySignature", "MethodSignature", "GetAccessor", "SetAccessor")
)
CALLS = frozenset(("CallExpression", "NewExpression"))
EMPTY_TYPES = frozenset(("VoidKeyword", "UndefinedKeyword", "NeverKeyword", "AnyKeyword", "UnknownKeyword"))
#: Types that stand for what they hold, as far as methods are asked for.
TRANSPARENT = frozenset(("Promise", "Readonly", "Partial", "Required", "NonNullable"))


def is_name(n: Node) -> bool:
    return n.kind in ("Identifier", "PrivateIdentifier")


def declares(n: Node) -> bool:
    return n.up is not None and n.up.name is n and n.up.kind in NAMED


def is_callee(n: Node) -> bool:
    return n.up is not None and n.up.kind in CALLS and n.up.expression is n


def is_member_name(n: Node) -> bool:
    return n.up is not None and n.up.kind == "PropertyAccessExpression" and n.up.name is n


def is_written(n: Node) -> bool:
    return n.up.kind == "BinaryExpression" and n.up.left is n and n.up.op == "="


def unwrapped(e: Node | None, kinds: tuple[str, ...] = ("AwaitExpression", "ParenthesizedExpression")) -> Node | None:
    while e is not None and e.kind in kinds:
        e = e.expression
    return e


def modified(n: Node, word: str) -> bool:
    return any(m.kind == f"{word}Keyword" for m in n.mods or ())


def decorated(n: Node) -> bool:
    return any(m.kind == "Decorator" for m in n.mods or ())


def bound(name: Node | None) -> list[Node]:
    """The names that a name or a pattern binds."""
    if name is None:
        return []
    return [name] if is_name(name) else [n for e in name.elements or () if e.name is not None for n in bound(e.name)]


class Env:
    """Names declared around a place, with their declarations, innermost first."""

    def __init__(self, above: Env | None, names: dict[str, Node], this: str | None = None):
        self.above, self.names, self.this = above, names, this

    def find(self, name: str) -> Node | None:
        e = self
        while e is not None:
            if name in e.names:
                return e.names[name]
            e = e.above
        return None


def _hoisted(body: Node) -> Iterator[Node]:
    """Variables of a function's body, wherever they stand in it."""
    todo = [body]
    while todo:
        n = todo.pop()
        if n.kind == "VariableDeclaration":
            yield n
        if n.kind not in FUNCTIONS and not n.kind.startswith("Class"):
            todo += n.kids
        elif n is body:
            todo += n.kids


def _own_names(n: Node) -> dict[str, Node] | None:
    """What a node declares for all below it; None if it is no scope."""
    out: dict[str, Node] = {}
    if n.kind in FUNCTIONS or n.kind in ("FunctionType", "ConstructorType", "MethodSignature", "CallSignature", "ConstructSignature"):
        out |= {k.name.text: k for k in n.kids if k.kind == "TypeParameter"} | {x.text: p for p in n.params or () for x in bound(p.name)}
        if n.kind == "FunctionExpression" and n.name is not None:
            out.setdefault(n.name.text, n)
        return out
    if n.kind in ("ClassDeclaration", "ClassExpression", "InterfaceDeclaration", "TypeAliasDeclaration"):
        return {k.name.text: k for k in n.kids if k.kind == "TypeParameter"} | ({n.name.text: n} if n.kind == "ClassExpression" and n.name is not None else {})
    if n.kind in ("Block", "ModuleBlock", "CaseClause", "DefaultClause"):
        for s in n.statements:
            for d in s.declarations or ():
                out |= {x.text: d for x in bound(d.name)}
            if s.kind in ("FunctionDeclaration", "ClassDeclaration", "EnumDeclaration", "InterfaceDeclaration", "TypeAliasDeclaration", "ModuleDeclaration") and s.name is not None:
                out[s.name.text] = s
        if n.up is not None and n.up.kind in FUNCTIONS:
            out = {x.text: d for d in _hoisted(n) for x in bound(d.name)} | out
        return out
    if n.kind in ("ForStatement", "ForOfStatement", "ForInStatement"):
        return {x.text: d for d in (n.first.declarations or () if n.first is not None else ()) for x in bound(d.name)}
    if n.kind == "CatchClause":
        return {x.text: n.declaration for x in bound(n.declaration.name)} if n.declaration is not None else {}
    if n.kind in ("MappedType", "InferType", "ConditionalType"):
        return {k.name.text: k for k in n.walk() if k.kind == "TypeParameter"}
    return None


class TsScript:
    """A file of a project. file: from the project's folder; module: from that of its sources."""

    def __init__(self, module: str, file: str, source: str, test: bool):
        self.module, self.file, self.source, self.test = module, file, source, test
        self.lines = [0, *(m.end() for m in re.finditer("\n", source))]
        parser = Parser(source, file.endswith("x"))
        self.tree = parser.file()
        self.symbols: dict[str, dict] = {}
        self.sids: dict[Node, str] = {}
        self.functions: dict[str, Node] = {}
        self.classes: dict[str, Node] = {}

    def line(self, at: int) -> int:
        return bisect.bisect_right(self.lines, at)

    # Symbols.

    def _add(self, name: str, kind: str, node: Node, owner: str | None, private: bool, *nodes: Node) -> str | None:
        full = f"{owner.partition(':')[2]}.{name}" if owner else name
        sid = f"{self.module}:{full}"
        if sid in self.symbols:
            return None
        first, last = self.line(node.start), self.line(node.end)
        at = node.up.up.start if node.kind == "VariableDeclaration" else node.start
        self.symbols[sid] = {"sid": sid, "module": self.module, "name": full, "kind": kind, "doc": doc_before(self.source, at), "line": first, "lines": last - first + 1, "private": private, "owner": owner}
        self.sids |= dict.fromkeys(nodes, sid)
        return sid

    def _find_symbols(self) -> None:
        for s in self.tree.statements:
            hidden = not modified(s, "Export")
            if s.kind == "FunctionDeclaration" and s.name is not None:
                if sid := self._add(s.name.text, "function", s, None, hidden, s):
                    self.functions[sid] = s
            elif s.kind == "VariableStatement":
                for d in s.declarations:
                    if not is_name(d.name):
                        continue
                    if d.init is not None and d.init.kind in VALUES:
                        if sid := self._add(d.name.text, "function", d, None, hidden, d, d.init):
                            self.functions[sid] = d.init
                    elif _UPPER.fullmatch(d.name.text):
                        self._add(d.name.text, "constant", d, None, hidden, d)
            elif s.kind == "ClassDeclaration" and s.name is not None:
                if sid := self._add(s.name.text, "class", s, None, hidden, s):
                    self.classes[sid] = s
                    for m in s.members:
                        self._add_member(sid, m)
            elif s.kind in ("InterfaceDeclaration", "TypeAliasDeclaration", "EnumDeclaration"):
                self._add(s.name.text, "type", s, None, hidden, s)

    def _add_member(self, owner: str, m: Node) -> None:
        if m.name is None:
            return
        name, private = self._text(m.name), modified(m, "Private") or m.name.kind == "PrivateIdentifier"
        if m.kind in ("MethodDeclaration", "GetAccessor", "SetAccessor") and m.body is not None:
            if sid := self._add(name, "method", m, owner, private, m):
                self.functions[sid] = m
        elif m.kind == "PropertyDeclaration" and m.init is not None and m.init.kind in VALUES:
            if sid := self._add(name, "method", m, owner, private, m, m.init):
                self.functions[sid] = m.init

    def _text(self, n: Node) -> str:
        return self.source[n.start : n.end]

    # Calls, functions and classes.

    def _arg(self, n: Node) -> dict:
        nothing = n.kind == "Identifier" and n.text == "undefined"
        literal, base = n.kind in LITERALS or nothing, n.expression if n.kind == "PropertyAccessExpression" else None
        return {
            "text": self._text(n), "literal": literal, "value": f"{n.kind}:{self._text(n)}" if literal else "", "boolean": n.kind in ("TrueKeyword", "FalseKeyword"),
            "name": n.text if n.kind == "Identifier" and not nothing else None,
            "attr_of": None if base is None else base.text if base.kind == "Identifier" else "self" if base.kind == "ThisKeyword" else None,
            "names": [x.text for x in n.walk() if x.kind == "Identifier"],
        }

    @staticmethod
    def _callee(n: Node) -> str:
        e = n.expression
        return e.text if e.kind == "Identifier" else e.name.text if e.kind == "PropertyAccessExpression" else ""

    def _call(self, n: Node) -> dict:
        up = n.up
        while up is not None and up.kind in ("AwaitExpression", "ParenthesizedExpression", "VoidExpression"):
            up = up.up
        return {
            "name": self._callee(n), "file": self.file, "line": self.line(n.start), "args": [self._arg(a) for a in n.args if a.kind != "SpreadElement"], "keywords": [],
            "spreads": any(a.kind == "SpreadElement" for a in n.args), "dropped": up is not None and up.kind == "ExpressionStatement", "in_tests": self.test,
        }

    @staticmethod
    def _params(fn: Node) -> list[Node]:
        return [p for p in fn.params or () if is_name(p.name) and p.name.text != "this"]

    @staticmethod
    def _statements(fn: Node) -> list[Node]:
        if fn.body is None:
            return []
        return fn.body.statements if fn.body.kind == "Block" else [fn.body]

    def _shape(self, fn: Node) -> str | None:
        local = {p.name.text: f"p{i}" for i, p in enumerate(self._params(fn))}
        statements = self._statements(fn)
        for n in (n for s in statements for n in s.walk() if n.kind == "VariableDeclaration" and n.name.kind == "Identifier"):
            local.setdefault(n.name.text, f"v{len(local)}")
        parts, count = [], 0
        todo: list = list(reversed(statements))
        while todo:
            n = todo.pop()
            if n is None:
                parts.append(")")
                continue
            count += 1
            parts.append(f"I:{local.get(n.text, n.text)}" if n.kind == "Identifier" else f"L:{n.text}" if n.kind in LITERALS else n.kind)
            todo += [None, *reversed(n.kids)]
        if fn.body is not None and fn.body.kind != "Block":  # as if it were returned
            count, parts = count + 1, ["ReturnStatement", *parts, ")"]
        return hashlib.sha1(" ".join(parts).encode()).hexdigest() if count >= SHAPE_NODES else None

    def _function(self, sid: str, fn: Node) -> dict:
        params = self._params(fn)
        names = [p.name.text for p in params]
        loads, given, calls, reads = Counter(), set(), [], Counter()
        for root in (fn.body, *(p.init for p in fn.params or ())):
            for n in root.walk() if root is not None else ():
                if n.kind in CALLS:
                    given |= {a.text for a in n.args if a.kind == "Identifier"}
                    calls.append(self._call(n))
                if n.kind == "Identifier" and not declares(n) and not is_member_name(n):
                    loads[n.text] += 1
                if n.kind == "PropertyAccessExpression" and not is_written(n):
                    base = n.expression
                    if key := base.text if base.kind == "Identifier" else "self" if base.kind == "ThisKeyword" else None:
                        reads[key] += 1
        statements = self._statements(fn)
        first = statements[0] if statements else None
        plain = fn.body is not None and fn.body.kind != "Block"
        only = None
        if len(statements) == 1 and (plain or first.kind in ("ReturnStatement", "ExpressionStatement")):
            only = unwrapped(first if plain else first.expression)
        test = None
        if first is not None and first.kind == "IfStatement":
            test = first.expression.operand if first.expression.kind == "PrefixUnaryExpression" else first.expression
        stub = fn.body is None or not plain and (not statements or len(statements) == 1 and first.kind == "ThrowStatement" and bool(_UNBUILT.search(self._text(first))))
        typed = {p.name.text: p.type.name.text for p in params if p.type is not None and p.type.kind == "TypeReference" and p.type.name is not None and p.type.name.kind == "Identifier"}
        flags = [p.name.text for p in params if p.type is not None and p.type.kind == "BooleanKeyword" or p.init is not None and p.init.kind in ("TrueKeyword", "FalseKeyword")]
        return {
            "sid": sid, "name": sid.rpartition(":")[2].rpartition(".")[2], "params": names, "positional": names,
            "defaults": [{"name": p.name.text, "text": self._text(p.init) if p.init is not None else "undefined"} for p in params if p.init is not None or p.question],
            "flags": flags, "decorated": decorated(fn), "stub": stub, "returns_value": self._returns(fn)[0], "loads": dict(loads), "relayed": [p for p in names if loads[p] == 1 and p in given],
            "sole_call": self._call(only) if only is not None and only.kind in CALLS else None,
            "first_if": {"name": test.text, "start": self.line(first.start), "end": self.line(first.end)} if test is not None and test.kind == "Identifier" else None,
            "shape": self._shape(fn), "receiver_reads": dict(reads), "annotations": typed, "calls": calls,
        }

    def _returns(self, fn: Node) -> tuple[bool, list[Node]]:
        """(whether what it returns is worth something as far as this file tells, calls of which the answer is theirs)."""
        if fn.type is not None:
            return not self._empty(fn.type), []
        if fn.body is None:
            return False, []  # any
        if fn.star:
            return True, []
        found = [fn.body] if fn.body.kind != "Block" else []
        todo = [] if found else [fn.body]
        while todo:
            n = todo.pop()
            if n.kind == "ReturnStatement" and n.expression is not None:
                found.append(n.expression)
            todo += [k for k in n.kids if k.kind not in FUNCTIONS and not k.kind.startswith("Class")]
        found = [unwrapped(e, ("ParenthesizedExpression", "AwaitExpression", "NonNullExpression")) for e in found]
        anys = {p.name.text for p in self._params(fn) if p.type is None and p.init is None or p.type is not None and p.type.kind in ("AnyKeyword", "UnknownKeyword")}
        if any(e.kind == "Identifier" and e.text in anys or e.kind in ("AsExpression", "TypeAssertionExpression") and e.type.kind in ("AnyKeyword", "UnknownKeyword") for e in found):
            return False, []
        worth = [e for e in found if not (e.kind == "Identifier" and e.text == "undefined" or e.kind == "VoidExpression")]
        if not worth or all(e.kind == "ThisKeyword" for e in found):
            return False, []
        calls = [e for e in worth if e.kind == "CallExpression"]
        return True, calls if len(calls) == len(worth) else []

    def _empty(self, of: Node) -> bool:
        if of.kind == "UnionType":
            return all(self._empty(t) for t in of.types)
        if of.kind == "ParenthesizedType":
            return self._empty(of.type)
        if of.kind == "TypeReference" and of.name.kind == "Identifier" and of.name.text == "Promise" and of.args:
            return self._empty(of.args[0])
        return of.kind in EMPTY_TYPES or of.kind == "ThisType" or of.kind == "TypePredicate" and self.source.startswith("asserts", of.start)

    def _class(self, sid: str, node: Node) -> dict:
        bases = self._bases(node)
        return {
            "sid": sid, "fields": [{"name": self._text(m.name), "type": self._text(m.type)} for m in node.members if m.kind == "PropertyDeclaration" and m.type is not None and not (m.init is not None and m.init.kind in VALUES)],
            "bases": [e.text if e.kind == "Identifier" else e.name.text if e.kind == "PropertyAccessExpression" else "" for e in bases],
            "library_base": bool(bases), "decorated": decorated(node), "abstract": modified(node, "Abstract"),
        }

    @staticmethod
    def _bases(node: Node) -> list[Node]:
        return [t.expression for h in node.heritage if h.word == "extends" for t in h.types]

    # Chains.

    def _type_chain(self, of: Node | None, env: Env | None) -> list[str] | None:
        if of is None:
            return None
        if of.kind == "ParenthesizedType":
            return self._type_chain(of.type, env)
        if of.kind == "UnionType":
            left = [t for t in of.types if t.kind != "UndefinedKeyword" and not (t.kind == "LiteralType" and self._text(t) == "null")]
            return self._type_chain(left[0], env) if len(left) == 1 else None
        if of.kind == "ThisType" and env is not None and env.this:
            return ["this", env.this]
        if of.kind != "TypeReference" or of.name is None:
            return None
        if of.name.kind == "Identifier" and of.name.text in TRANSPARENT and of.args:
            return self._type_chain(of.args[0], env)
        path = self._entity_chain(of.name, env)
        return path and [*path, "inst"]

    def _entity_chain(self, name: Node, env: Env | None) -> list[str] | None:
        if name.kind == "Identifier":
            return ["name", name.text] if env is None or env.find(name.text) is None else None
        left = self._entity_chain(name.left, env) if name.left is not None else None
        return left and [*left, f".{name.right.text}"]

    def _chain(self, e: Node | None, env: Env | None, far: int = FAR) -> list[str] | None:
        """Where what an expression means is to be looked for, or None."""
        if e is None or far <= 0:
            return None
        if e.kind in ("Identifier", "PrivateIdentifier"):
            d = env.find(e.text) if env is not None else None
            if d is None:
                return ["name", e.text]
            if d.type is not None and d.kind in ("VariableDeclaration", "Parameter"):
                return self._type_chain(d.type, env)
            return self._chain(d.init, env, far - 1) if d.init is not None and is_name(d.name) and d.init.kind not in VALUES else None
        if e.kind in ("ThisKeyword", "SuperKeyword"):
            return [e.text, env.this] if env is not None and env.this else None
        if e.kind in ("ParenthesizedExpression", "AwaitExpression", "NonNullExpression", "SatisfiesExpression"):
            return self._chain(e.expression, env, far)
        if e.kind in ("AsExpression", "TypeAssertionExpression"):
            return self._type_chain(e.type, env)
        step = {"PropertyAccessExpression": lambda: f".{e.name.text}", "CallExpression": lambda: "()", "NewExpression": lambda: "new"}.get(e.kind)
        if step is None:
            return None
        before = self._chain(e.expression, env, far)
        return before and [*before, step()]

    def _name_chain(self, n: Node, env: Env | None) -> list[str] | None:
        """The chain of a name where it is used."""
        up = n.up
        if up.name is n and up.kind == "PropertyAccessExpression":
            before = self._chain(up.expression, env)
            return before and [*before, f".{n.text}"]
        if up.kind == "QualifiedName" and up.right is n:
            before = self._entity_chain(up.left, env)
            return before and [*before, f".{n.text}"]
        if up.kind in ("ImportSpecifier", "ImportClause", "NamespaceImport"):
            return ["name", up.name.text]
        if up.kind == "ExportSpecifier":
            return ["export", up.name.text]
        own = up.name is n and up.kind in ("PropertyAssignment", "ShorthandPropertyAssignment", "EnumMember", "BindingElement", "TypeParameter", "FunctionExpression", "ClassExpression", "JsxAttribute", "NamedTupleMember", "MetaProperty", "ModuleDeclaration", "NamespaceExport")
        if own or up.property is n or up.kind in ("LabeledStatement", "BreakStatement", "ContinueStatement"):
            return None
        return ["name", n.text] if env is None or env.find(n.text) is None else None

    def _uses(self) -> Iterator[dict]:
        """Names used and calls made, with the innermost symbol around them."""
        top = {x.text: d for s in self.tree.statements for d in s.declarations or () for x in bound(d.name) if d not in self.sids}
        todo: list[tuple[Node, str, Env]] = [(self.tree, f"{self.module}:<module>", Env(None, top))]
        while todo:
            n, scope, env = todo.pop()
            if is_name(n) and not declares(n) and (chain := self._name_chain(n, env)):
                yield {"module": self.module, "scope": scope, "line": None, "chain": chain}
            if n.kind in ("CallExpression", "NewExpression", "JsxOpeningElement", "JsxSelfClosingElement", "Decorator"):
                callee = n.tag if n.kind.startswith("Jsx") else n.expression
                name = callee.name if callee is not None and callee.kind == "PropertyAccessExpression" else callee
                if name is not None and is_name(name) and (chain := self._name_chain(name, env)):
                    yield {"module": self.module, "scope": scope, "line": self.line(n.start), "chain": chain}
            names = _own_names(n)
            sid = self.sids.get(n)
            this = env.this
            if n.kind.startswith("Class") and n.members is not None:
                this = sid
            elif n.kind in ("FunctionDeclaration", "FunctionExpression") or n.kind in ("MethodDeclaration", "GetAccessor", "SetAccessor") and n.up.kind == "ObjectLiteralExpression":
                this = None
            inner = Env(env, names or {}, this) if names is not None or this != env.this else env
            if n is not self.tree and sid and self.symbols[sid]["kind"] in ("function", "method", "class"):
                scope = sid
            self.envs[n] = inner
            todo += [(k, scope, inner) for k in reversed(n.kids)]

    # What is told.

    def rows(self) -> Iterator[tuple[str, dict]]:
        """(fact, row). Facts of ``schemas.TABLES`` that need no other file; ``use``, ``binding``, ``export``, ``star``, ``spec``, ``base``,
        ``member`` and ``returns`` are to be resolved."""
        self.envs: dict[Node, Env] = {}
        if self.test:
            yield from self._test_rows()
            return
        self._find_symbols()
        yield "modules", {"module": self.module, "file": self.file, "lines": len(self.lines)}
        yield from (("symbols", s) for s in self.symbols.values())
        yield from (("use", u) for u in self._uses())
        yield from (("functions", self._function(sid, fn)) for sid, fn in self.functions.items())
        yield from (("classes", self._class(sid, c)) for sid, c in self.classes.items())
        yield from self._imports()
        yield from self._exports()
        yield from self._typed()
        yield from self._read()

    def _imports(self) -> Iterator[tuple[str, dict]]:
        outside: dict[str, str] = {}
        for n in self.tree.walk():
            spec, names = None, []
            if n.kind in ("ImportDeclaration", "ExportDeclaration") and n.spec is not None and n.spec.kind == "StringLiteral":
                spec = n.spec.text[1:-1]
                clause = n.clause
                named = clause.named if clause is not None else n.named
                if not self._types_only(n):
                    names = ([clause.name.text] if clause is not None and clause.name is not None else []) + [self._word(e.property or e.name) for e in (named.elements or () if named is not None else ())]
                    yield "spec", {"module": self.module, "file": self.file, "spec": spec, "line": self.line(n.start), "names": names}
                if clause is not None:
                    for local, of in self._bindings(clause):
                        yield "binding", {"module": self.module, "file": self.file, "local": local, "spec": spec, "name": of}
                    if n.up is self.tree and not clause.types and not spec.startswith((".", "node:")):
                        outside |= {local: spec for local, _ in self._bindings(clause, values=True)}
            elif n.kind == "CallExpression" and n.expression.kind == "ImportKeyword" and n.args and n.args[0].kind == "StringLiteral":
                yield "spec", {"module": self.module, "file": self.file, "spec": n.args[0].text[1:-1], "line": self.line(n.start), "names": []}
        todo = [(self.tree, False)]
        while todo:
            n, within = todo.pop()
            if n.kind in CALLS and within:
                e = n.expression
                base = e.expression if e.kind == "PropertyAccessExpression" else e
                if base.kind == "Identifier" and base.text in outside:
                    api = base.text if base is e else f"{base.text}.{e.name.text}"
                    up = n.up
                    while up is not None and up.kind in ("AwaitExpression", "ParenthesizedExpression"):
                        up = up.up
                    built = up is not None and up.kind in ("ThrowStatement", "ReturnStatement") and api.rpartition(".")[2][:1] in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
                    yield "library_calls", {"api": api, "module": self.module, "line": self.line(n.start), "raised_or_returned": built, "file": self.file, "spec": outside[base.text]}
            inner = within or n.kind in FUNCTIONS and n.body is not None
            todo += [(k, inner) for k in reversed(n.kids)]

    @staticmethod
    def _word(n: Node) -> str:
        return n.text[1:-1] if n.kind == "StringLiteral" else n.text

    def _types_only(self, n: Node) -> bool:
        if n.kind == "ExportDeclaration":
            return n.types or n.named.kind == "NamedExports" and bool(n.named.elements) and all(e.types for e in n.named.elements)
        c = n.clause
        if c is None or c.types:
            return c is not None
        found = c.named.elements if c.named is not None and c.named.kind == "NamedImports" else []
        return c.name is None and not (c.named is not None and c.named.kind == "NamespaceImport") and bool(found) and all(e.types for e in found)

    def _bindings(self, clause: Node, values: bool = False) -> list[tuple[str, str]]:
        """(local name, name there; * for all of them). values: without those that are types only."""
        out = [(clause.name.text, "default")] if clause.name is not None else []
        named = clause.named
        if named is not None and named.kind == "NamespaceImport":
            out.append((named.name.text, "*"))
        elif named is not None:
            out += [(e.name.text, self._word(e.property or e.name)) for e in named.elements if not (values and e.types)]
        return out

    def _exports(self) -> Iterator[tuple[str, dict]]:
        row = lambda name, local=None, spec=None, of=None: ("export", {"module": self.module, "file": self.file, "name": name, "local": local, "spec": spec, "of": of})
        for s in self.tree.statements:
            if s.kind == "ExportDeclaration":
                spec = s.spec.text[1:-1] if s.spec is not None else None
                if s.named.kind == "NamespaceExport":
                    if s.named.name is not None:
                        yield row(self._word(s.named.name), spec=spec, of="*")
                    else:
                        yield "star", {"module": self.module, "file": self.file, "spec": spec}
                for e in s.named.elements or ():
                    of = self._word(e.property or e.name)
                    yield row(self._word(e.name), **({"spec": spec, "of": of} if spec else {"local": of}))
            elif s.kind == "ExportAssignment" and s.expression.kind == "Identifier":
                yield row("default", s.expression.text)
            elif modified(s, "Export"):
                if modified(s, "Default"):
                    if s.name is not None:
                        yield row("default", s.name.text)
                elif s.declarations is not None:
                    yield from (row(x.text, x.text) for d in s.declarations for x in bound(d.name))
                elif s.name is not None:
                    yield row(s.name.text, s.name.text)

    def _typed(self) -> Iterator[tuple[str, dict]]:
        """Bases of classes, members of classes with their types, and what functions return."""
        for sid, c in self.classes.items():
            for e in self._bases(c):
                yield "base", {"module": self.module, "sid": sid, "chain": self._chain(e, self.envs.get(c)) if e.kind in ("Identifier", "PropertyAccessExpression") else None}
            for m in c.members:
                env = self.envs.get(c)
                if m.kind == "Constructor":
                    for p in m.params:
                        if p.mods and is_name(p.name):
                            yield "member", {"module": self.module, "owner": sid, "name": p.name.text, "sid": None, "chain": self._type_chain(p.type, env)}
                    assigned = [x for x in (m.body.walk() if m.body is not None else ()) if x.kind == "BinaryExpression" and x.op == "=" and x.left.kind == "PropertyAccessExpression" and x.left.expression.kind == "ThisKeyword"]
                    for x in assigned:
                        if (chain := self._chain(x.right, self.envs.get(m.body))) is not None:
                            yield "member", {"module": self.module, "owner": sid, "name": x.left.name.text, "sid": None, "chain": chain}
                elif m.name is not None:
                    own = self.sids.get(m)
                    field = m.kind == "PropertyDeclaration" and own is None
                    chain = self._type_chain(m.type, env) or (self._chain(m.init, env) if m.type is None and m.init is not None else None) if field else None
                    if m.kind == "GetAccessor":
                        chain = self._type_chain(m.type, env)
                    yield "member", {"module": self.module, "owner": sid, "name": self._text(m.name), "sid": own, "chain": chain}
        for s in self.tree.statements:
            if s.kind == "TypeAliasDeclaration" and s in self.sids:
                yield "returns", {"module": self.module, "sid": self.sids[s], "chain": self._type_chain(s.type, self.envs.get(s)), "calls": []}
        for sid, fn in self.functions.items():
            env = self.envs.get(fn)
            chain = self._type_chain(fn.type, env)
            worth, calls = self._returns(fn)
            inner = self.envs.get(fn.body) if fn.body is not None else env
            if chain is None and fn.type is None and worth:
                found = [n.expression for n in fn.body.walk() if n.kind == "ReturnStatement" and n.expression is not None] if fn.body.kind == "Block" else [fn.body]
                chain = self._chain(found[0], inner) if len(found) == 1 else None
            yield "returns", {"module": self.module, "sid": sid, "chain": chain, "calls": [c for c in (self._chain(x.expression, inner) for x in calls) if c] if len(calls) == 1 else []}

    def _read(self) -> Iterator[tuple[str, dict]]:
        """Calls and names, as the checks ask for them."""
        names = {k: {} for k in ("handed", "attribute_reads", "listed_names", "called_names")}
        note = lambda kind, name: names[kind].setdefault(name)
        for n in self.tree.walk():
            if n.kind in CALLS:
                yield "calls", self._call(n)
                if name := self._callee(n):
                    note("called_names", name)
            elif n.kind == "PropertyAccessExpression" and not is_written(n):
                note("attribute_reads", n.name.text)
            elif n.kind == "BindingElement" and n.up.kind == "ObjectBindingPattern":
                note("attribute_reads", self._text(n.property or n.name))
            elif n.kind == "ArrayLiteralExpression":
                for e in n.elements:
                    if e.kind == "Identifier":
                        note("listed_names", e.text)
            elif n.kind == "PropertyAssignment" and n.init.kind == "Identifier":
                note("listed_names", n.init.text)
            elif n.kind == "ShorthandPropertyAssignment":
                note("listed_names", n.name.text)
            elif n.kind == "SpreadAssignment":
                note("called_names", "...")
        names["handed"] = dict.fromkeys(self._handed())
        for kind, found in names.items():
            yield from (("names", {"kind": kind, "module": self.module, "name": x}) for x in found)
        yield from self._counts("package")

    def _handed(self) -> Iterator[str]:
        return (n.text for n in self.tree.walk() if n.kind == "Identifier" and not declares(n) and not is_callee(n) and not (is_member_name(n) and is_callee(n.up)))

    def _counts(self, scope: str) -> Iterator[tuple[str, dict]]:
        counts = Counter(n.text for n in self.tree.walk() if is_name(n) and not declares(n))
        return (("name_counts", {"scope": scope, "name": x, "n": k}) for x, k in counts.items())

    def _test_rows(self) -> Iterator[tuple[str, dict]]:
        yield from (("calls", self._call(n)) for n in self.tree.walk() if n.kind in CALLS)
        yield from (("names", {"kind": "handed_in_tests", "module": self.module, "name": x}) for x in dict.fromkeys(self._handed()))
        yield from self._counts("tests")
        found: dict[tuple, None] = {}
        todo: list[tuple[Node, tuple[int, int] | None]] = [(self.tree, None)]
        while todo:
            n, around = todo.pop()
            if n.kind in FUNCTIONS and n.body is not None:
                around = self.line(n.start), self.line(n.end)
            if n.kind == "Identifier" and not declares(n):
                at = self.line(n.start)
                found.setdefault((n.text, at, *(around or (at, at))))
            todo += [(k, around) for k in reversed(n.kids)]
        yield from (("test_uses", {"name": x, "file": self.file, "line": at, "start": a, "end": b}) for x, at, a, b in found)
