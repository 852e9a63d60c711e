"""One pass over a parsed Python file: every node is met once and leaves events in the scope that is open there.

What a file means by itself comes out as fact rows. What needs the rest of the package comes out as a *program*: imports, and for
each scope its bindings, reads and calls as small expressions, which ``meaning`` evaluates without the syntax tree.

An expression is a name (a string), ``[".", e, attribute]``, ``["()", e]`` (a call of e), ``["await", e]``, ``["?", e, e]`` or null.
"""

from __future__ import annotations

import ast
import hashlib
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

#: Decorators, by attribute, that make a function a door. Fixed values.
DOORS = ("get", "post", "put", "patch", "delete", "websocket", "route", "api_route")
#: A body of fewer nodes, its own root among them, has no shape.
SHAPE_NODES = 40
RECEIVERS = ("self", "cls")
Function = ast.FunctionDef | ast.AsyncFunctionDef
Row = tuple[str, dict]


def code(e: ast.AST | None):
    """The expression that ``meaning`` evaluates."""
    match e:
        case ast.Name(id=name):
            return name
        case ast.Attribute(value=inner, attr=attr):
            return [".", code(inner), attr]
        case ast.Call(func=inner):
            return ["()", code(inner)]
        case ast.Await(value=inner):
            return ["await", code(inner)]
        case ast.IfExp(body=a, orelse=b):
            return ["?", code(a), code(b)]
    return None


def tail(e: ast.AST | None) -> str:
    """The last name of a name or attribute; '' for anything else."""
    return e.id if isinstance(e, ast.Name) else e.attr if isinstance(e, ast.Attribute) else ""


def base(e: ast.AST | None) -> str:
    """As ``tail``, and what a subscript is taken of."""
    while isinstance(e, ast.Subscript):
        e = e.value
    return tail(e)


def mentions(note: ast.AST | None) -> list[str]:
    """Names and string constants of an annotation, nearest to its root first."""
    level, out = [note] if note is not None else [], []
    while level:
        out += [e.id if isinstance(e, ast.Name) else e.value for e in level if isinstance(e, ast.Name) or (isinstance(e, ast.Constant) and isinstance(e.value, str))]
        level = [c for e in level for c in ast.iter_child_nodes(e)]
    return out


@dataclass
class Place:
    """Where a node stands: what is above it, how deep, and what is open around it."""

    up: ast.AST | None
    depth: int
    scope: Scope | None
    above: Place | None = None
    bodies: int = 0  # function bodies around
    inner: int = 0  # functions, lambdas and classes around, inside the scope
    decided: bool = False  # inside a return that says what the scope gives
    klass: Scope | None = None

    @property
    def statement(self) -> bool:
        """Whether what stands here is a statement, perhaps an awaited one."""
        at = self.above if isinstance(self.up, ast.Await) and self.above else self
        return isinstance(at.up, ast.Expr)


@dataclass
class Scope:
    """A place where code runs, with what the pass has met in it."""

    sid: str
    owner: str | None = None
    node: Function | None = None
    binds: list[tuple[int, str, object]] = field(default_factory=list)  # (depth, name, expression)
    said: list[tuple[int, str, list[str]]] = field(default_factory=list)  # (depth, name, mentions)
    reads: list = field(default_factory=list)
    called: list[tuple[object, int]] = field(default_factory=list)
    loads: Counter = field(default_factory=Counter)
    handed_on: Counter = field(default_factory=Counter)
    receivers: Counter = field(default_factory=Counter)
    calls: list[dict] = field(default_factory=list)
    gives: bool = False  # as the last of its returns and yields says

    def program(self) -> dict:
        near = lambda found: [list(x[1:]) for x in sorted(found, key=lambda x: x[0])]
        params = [*self.node.args.posonlyargs, *self.node.args.args, *self.node.args.kwonlyargs] if self.node else []
        said = [[a.arg, mentions(a.annotation)] for a in params if a.annotation is not None]
        return {"sid": self.sid, "owner": self.owner, "said": said + near(self.said) if self.node else None, "binds": near(self.binds), "reads": self.reads, "called": self.called}


class Script:
    """A file, read."""

    def __init__(self, module: str, file: str, source: str, package: str, test: bool = False):
        self.module, self.file, self.package, self.test = module, file, package, test
        self.tree = ast.parse(source)
        self.lines = len(source.splitlines())
        self.scopes: list[Scope] = []
        self.calls: list[dict] = []
        self.names: set[tuple[str, str]] = set()
        self.seen: list[tuple[str, int]] = []  # names read, with their lines
        self.spans: list[tuple[int, int]] = []
        self.imports: list[tuple[int, dict]] = []
        self.library: list[dict] = []
        self.outside = self._outside()
        for statement in self.tree.body:
            self._enter(statement)

    # --- the pass -------------------------------------------------------------------------------------------------------

    def _enter(self, statement: ast.stmt) -> None:
        """Open the scopes of a statement at the top and pass over it."""
        if isinstance(statement, Function):
            self._pass(statement, Place(self.tree, 1, self._open(statement.name, None, statement)))
        elif isinstance(statement, ast.ClassDef):
            around, inside = self._open(statement.name, statement.name), {*statement.body, *statement.bases}
            for child in ast.iter_child_nodes(statement):
                if isinstance(child, Function):
                    own = self._open(f"{statement.name}.{child.name}", statement.name, child)
                    self._pass(child, Place(statement, 2, own, klass=around))
                else:
                    self._pass(child, Place(statement, 2, around if child in inside else None))
        else:
            self._pass(statement, Place(self.tree, 1, self._open("<module>")))

    def _open(self, name: str, owner: str | None = None, node: Function | None = None) -> Scope:
        scope = Scope(f"{self.module}:{name}", f"{self.module}:{owner}" if owner else None, node)
        self.scopes.append(scope)
        return scope

    def _pass(self, root: ast.AST, at: Place) -> None:
        todo = [(root, at)]
        while todo:
            node, at = todo.pop()
            decided = self._meet(node, at) or at.decided
            inner = at.inner + (isinstance(node, Function | ast.Lambda | ast.ClassDef) and at.scope is not None and node is not at.scope.node)
            below = []
            for name, value in ast.iter_fields(node):
                bodies = at.bodies + (isinstance(node, Function) and name == "body")
                under = Place(node, at.depth + 1, at.scope, at, bodies, inner, decided, at.klass)
                below += [(c, under) for c in (value if isinstance(value, list) else [value]) if isinstance(c, ast.AST)]
            todo += reversed(below)

    def _meet(self, node: ast.AST, at: Place) -> bool:
        """Leave the node's events. True for a return that decides what its function gives."""
        match node:
            case ast.Return(value=v) if at.scope and not at.inner and v is not None and not (isinstance(v, ast.Constant) and v.value is None):
                at.scope.gives = not (isinstance(v, ast.Name) and v.id == "self")
                return True
            case ast.Yield() | ast.YieldFrom() if at.scope and not at.inner and not at.decided:
                at.scope.gives = False
            case ast.Name(ctx=ast.Load()) | ast.Attribute(ctx=ast.Load()):
                self._read(node, at)
            case ast.Call():
                self._call(node, at)
            case ast.FunctionDef() | ast.AsyncFunctionDef():
                self.spans.append((node.lineno, node.end_lineno or node.lineno))
            case ast.Import():
                self.imports.append((at.depth, {"from": None, "level": 0, "names": [[a.name, a.asname] for a in node.names], "line": node.lineno}))
            case ast.ImportFrom():
                self.imports.append((at.depth, {"from": node.module or "", "level": node.level, "names": [[a.name, a.asname] for a in node.names], "line": node.lineno}))
                self.seen += [(a.name, node.lineno) for a in node.names]
            case ast.MatchClass():
                self.names |= {("matched_fields", a) for a in node.kwd_attrs} | {("listed_names", base(node.cls))}
            case ast.Dict() | ast.List() | ast.Set() | ast.Tuple():
                items = [*node.keys, *node.values] if isinstance(node, ast.Dict) else node.elts
                self.names |= {("listed_names", tail(i)) for i in items if tail(i)}
            case ast.Assign(targets=[ast.Name(id=name)], value=value):
                self._bind(at, name, code(value))
            case ast.AnnAssign(target=ast.Name(id=name), annotation=note) if at.scope:
                at.scope.said.append((at.depth, name, mentions(note)))
            case ast.withitem(optional_vars=ast.Name(id=name), context_expr=value):
                self._bind(at, name, code(value), -1)
            case ast.For(target=ast.Name(id=name), iter=value) | ast.AsyncFor(target=ast.Name(id=name), iter=value):
                self._bind(at, name, code(value))
        return False

    def _bind(self, at: Place, name: str, value, nearer: int = 0) -> None:
        for scope in (at.scope, at.klass):  # a class's body also goes by what its methods bind
            if scope is not None:
                scope.binds.append((at.depth + nearer, name, value))

    def _read(self, node: ast.Name | ast.Attribute, at: Place) -> None:
        name, plain = tail(node), isinstance(node, ast.Name)
        self.seen.append((name, node.lineno))
        if not plain:
            self.names.add(("attribute_reads", name))
        if not (isinstance(at.up, ast.Call) and at.up.func is node):
            self.names.add(("handed_in_tests" if self.test else "handed", name))
        if (s := at.scope) is None:
            return
        s.reads.append(code(node))
        if plain:
            s.loads[name] += 1
            argument = isinstance(at.up, ast.Call) and at.up.func is not node
            s.handed_on[name] += argument or (isinstance(at.up, ast.keyword) and at.above is not None and isinstance(at.above.up, ast.Call))
        elif isinstance(node.value, ast.Name):
            s.receivers[node.value.id] += 1

    def _call(self, node: ast.Call, at: Place) -> None:
        fact = self.call(node, at.statement)
        self.calls.append(fact)
        if fact["name"]:
            self.names.add(("called_names", fact["name"]))
        if at.scope:
            at.scope.calls.append(fact)
            at.scope.called.append((code(node.func), node.lineno))
        api, root = code(node.func), None
        match api:
            case str():
                api, root = api, api
            case [".", str() as root, attr]:
                api = f"{root}.{attr}"
        if root in self.outside:
            made = isinstance(at.up, (ast.Raise, ast.Return)) and api.rpartition(".")[2][:1].isupper()
            self.library += [{"api": api, "module": self.module, "line": node.lineno, "raised_or_returned": made}] * at.bodies

    def _outside(self) -> set[str]:
        """Names bound at the top by imports of what is neither the standard library's nor the package's."""
        bound: dict[str, str] = {}
        for s in self.tree.body:
            match s:
                case ast.Import():
                    bound |= {a.asname or a.name.partition(".")[0]: a.name for a in s.names}
                case ast.ImportFrom(module=str() as source, level=0):
                    bound |= {a.asname or a.name: source for a in s.names}
        own = sys.stdlib_module_names | {self.package}
        return {name for name, source in bound.items() if source.partition(".")[0] not in own}

    # --- rows -----------------------------------------------------------------------------------------------------------

    def call(self, node: ast.Call, dropped: bool) -> dict:
        places = [a for a in node.args if not isinstance(a, ast.Starred)]
        return {
            "name": tail(node.func), "file": self.file, "line": node.lineno,
            "args": [argument(a) for a in places], "keywords": [{"k": k.arg, "arg": argument(k.value)} for k in node.keywords if k.arg],
            "spreads": len(places) < len(node.args) or any(not k.arg for k in node.keywords),
            "dropped": dropped, "in_tests": self.test,
        }

    def symbols(self) -> dict[str, dict]:
        """By id; what is defined again under the same name replaces what was."""
        out: dict[str, dict] = {}

        def add(name: str, kind: str, node: ast.stmt, owner: str | None = None) -> None:
            doc = ast.get_docstring(node) if isinstance(node, ast.ClassDef | Function) else None
            sid, end = f"{self.module}:{name}", node.end_lineno or node.lineno
            out[sid] = {"sid": sid, "module": self.module, "name": name, "kind": kind, "doc": doc.splitlines()[0] if doc else "", "line": node.lineno, "lines": end - node.lineno + 1, "private": name.rpartition(".")[2].startswith("_"), "owner": owner}

        for s in self.tree.body:
            match s:
                case ast.ClassDef():
                    add(s.name, "class", s)
                    for m in s.body:
                        if isinstance(m, Function):
                            add(f"{s.name}.{m.name}", "method", m, f"{self.module}:{s.name}")
                case ast.FunctionDef() | ast.AsyncFunctionDef():
                    add(s.name, "function", s)
                case ast.TypeAlias():
                    add(s.name.id, "type", s)
                case ast.Assign() | ast.AnnAssign():
                    for t in s.targets if isinstance(s, ast.Assign) else [s.target]:
                        if isinstance(t, ast.Name) and t.id.lstrip("_").isupper():
                            add(t.id, "constant", s)
        return out

    def functions(self) -> dict[str, Scope]:
        return {s.sid: s for s in self.scopes if s.node is not None}

    def function(self, s: Scope) -> dict:
        a, body = s.node.args, [x for x in s.node.body if not (isinstance(x, ast.Expr) and isinstance(x.value, ast.Constant))]
        places = [x for x in (*a.posonlyargs, *a.args)]
        every = [*places, *a.kwonlyargs]
        params = [x.arg for x in every if x.arg not in RECEIVERS]
        named = {k.arg: d for k, d in zip(a.kwonlyargs, a.kw_defaults, strict=True) if d is not None}
        filled = {x.arg: d for x, d in zip(reversed(places), reversed(a.defaults), strict=False)}
        # Whether a default makes a flag is decided against the tail of all parameters, keyword-only ones included.
        by_tail = {x.arg: d for x, d in zip(reversed(every), reversed(a.defaults), strict=False)} | named
        notes = {x.arg: x.annotation for x in every}
        first = body[0] if body else None
        one = first.value if len(body) == 1 and isinstance(first, (ast.Return, ast.Expr)) else None
        one = one.value if isinstance(one, ast.Await) else one
        test = first.test if isinstance(first, ast.If) else None
        test = test.operand if isinstance(test, ast.UnaryOp) else test
        return {
            "sid": s.sid, "name": s.sid.partition(":")[2], "params": params, "positional": [x.arg for x in places if x.arg not in RECEIVERS],
            "defaults": [{"name": x.arg, "text": ast.unparse(d)} for x in every if x.arg not in RECEIVERS and (d := filled.get(x.arg, named.get(x.arg))) is not None],
            "flags": [p for p in params if tail(notes[p]) == "bool" and isinstance(notes[p], ast.Name) or _boolean(by_tail.get(p))],
            "decorated": bool(s.node.decorator_list), "stub": len(body) == 1 and _unwritten(first), "returns_value": s.gives,
            "loads": {p: n for p in params if (n := s.loads[p])}, "relayed": [p for p in params if s.loads[p] == s.handed_on[p] == 1],
            "sole_call": self.call(one, isinstance(first, ast.Expr)) if isinstance(one, ast.Call) else None,
            "first_if": {"name": test.id, "start": first.lineno, "end": first.end_lineno} if isinstance(test, ast.Name) else None,
            "shape": shape(params, body), "receiver_reads": dict(s.receivers), "calls": s.calls,
            "annotations": {p: t for p, n in notes.items() if (t := n.id if isinstance(n, ast.Name) else n.value if isinstance(n, ast.Constant) else None) and isinstance(t, str)},
        }

    def classes(self) -> Iterator[dict]:
        own = {s.name: s for s in self.tree.body if isinstance(s, ast.ClassDef)}
        bases = {name: [base(b) for b in s.bases] for name, s in own.items()}
        foreign = {name for name, above in bases.items() if any(b not in own for b in above)}
        while more := {name for name, above in bases.items() if name not in foreign and foreign & {*above}}:
            foreign |= more
        for name, s in own.items():
            notes = [m for m in s.body if isinstance(m, ast.AnnAssign) and isinstance(m.target, ast.Name) and base(m.annotation) != "ClassVar"]
            hollow = any(base(d) == "abstractmethod" for m in s.body if isinstance(m, Function) for d in m.decorator_list)
            yield {"sid": f"{self.module}:{name}", "fields": [{"name": m.target.id, "type": ast.unparse(m.annotation)} for m in notes], "bases": bases[name], "library_base": name in foreign, "decorated": bool(s.decorator_list), "abstract": hollow or "ABC" in bases[name]}

    def test_uses(self) -> Iterator[dict]:
        near = sorted(self.spans, key=lambda s: s[1] - s[0])
        around = {line: next((s for s in near if s[0] <= line <= s[1]), (line, line)) for line in {line for _, line in self.seen}}
        for name, line in sorted(set(self.seen)):
            yield {"name": name, "file": self.file, "line": line, "start": around[line][0], "end": around[line][1]}

    def doors(self, entries: frozenset[str]) -> Iterator[str]:
        for sid, s in self.functions().items():
            routed = s.owner is None and any(isinstance(f := d.func if isinstance(d, ast.Call) else d, ast.Attribute) and f.attr in DOORS for d in s.node.decorator_list)
            if routed or s.node.name in entries:
                yield sid

    def rows(self, entries: frozenset[str]) -> Iterator[Row]:
        """(fact, row) of all that the file says by itself, and its program."""
        yield from (("name_counts", {"scope": "tests" if self.test else "package", "name": n, "n": k}) for n, k in Counter(n for n, _ in self.seen).items())
        yield from (("calls", c) for c in self.calls)
        kinds = {"handed_in_tests"} if self.test else {"handed", "attribute_reads", "matched_fields", "listed_names", "called_names"}
        yield from (("names", {"kind": k, "module": self.module, "name": n}) for k, n in sorted(self.names) if k in kinds)
        if self.test:
            yield from (("test_uses", r) for r in self.test_uses())
            return
        yield "modules", {"module": self.module, "file": self.file, "lines": self.lines}
        yield from (("symbols", r) for r in self.symbols().values())
        yield from (("functions", self.function(s)) for s in self.functions().values())
        yield from (("classes", r) for r in self.classes())
        yield from (("library_calls", r) for r in self.library)
        yield from (("entrypoints", {"sid": sid}) for sid in self.doors(entries))
        yield "program", {"module": self.module, "imports": [x for _, x in sorted(self.imports, key=lambda x: x[0])], "scopes": [s.program() for s in self.scopes]}
        yield "declares", self.declares()

    def declares(self) -> dict:
        """What other modules have to know: kinds of symbols, names bound at the top, and notes of types, still unread."""
        top = [{"from": s.module, "level": s.level, "names": [[a.name, a.asname] for a in s.names]} for s in self.tree.body if isinstance(s, ast.ImportFrom) and s.module]
        aliases, attributes, returns = [], [], []
        for s in self.tree.body:
            match s:
                case ast.Assign(targets=[ast.Name(id=name)], value=value):
                    aliases.append([name, mentions(value)])
                case ast.TypeAlias(name=ast.Name(id=name), value=value):
                    aliases.append([name, mentions(value)])
                case ast.ClassDef():
                    attributes += self._attributes(s)
        for sid, s in ((s.sid, s) for s in self.scopes if s.node is not None and s.node.returns is not None):
            returns.append([sid, mentions(s.node.returns)])
        return {"module": self.module, "kinds": {sid: r["kind"] for sid, r in self.symbols().items()}, "top": top, "aliases": aliases, "attributes": attributes, "returns": returns}

    def _attributes(self, s: ast.ClassDef) -> Iterator[list]:
        """[class.attribute, mentions of its annotation, mentions of the parameter it is set from, name it is made by calling]."""
        for m in s.body:
            match m:
                case ast.AnnAssign(target=ast.Name(id=name), annotation=note):
                    yield [f"{self.module}:{s.name}.{name}", mentions(note), [], None]
                case ast.FunctionDef(name="__init__", args=a):
                    notes = {x.arg: mentions(x.annotation) for x in (*a.args, *a.kwonlyargs)}
                    level = [m]
                    while level:
                        for x in level:
                            match x:
                                case ast.AnnAssign(target=ast.Attribute(value=ast.Name(id="self"), attr=name), value=value, annotation=note):
                                    pass
                                case ast.Assign(targets=[ast.Attribute(value=ast.Name(id="self"), attr=name)], value=value):
                                    note = None
                                case _:
                                    continue
                            made = value.func.id if isinstance(value, ast.Call) and isinstance(value.func, ast.Name) else None
                            yield [f"{self.module}:{s.name}.{name}", mentions(note), notes.get(tail(value), []) if isinstance(value, ast.Name) else [], made]
                        level = [c for x in level for c in ast.iter_child_nodes(x)]


def argument(e: ast.expr) -> dict:
    """What is handed over in one place of a call."""
    out = {"text": ast.unparse(e), "literal": False, "value": None, "boolean": False, "name": None, "attr_of": None, "names": sorted({x for x in _names(e)})}
    match e:
        case ast.Constant(value=v):
            out |= {"literal": True, "value": f"{type(v).__name__} {v!r}", "boolean": isinstance(v, bool)}
        case ast.Name(id=name):
            out["name"] = name
        case ast.Attribute(value=ast.Name(id=name)):
            out["attr_of"] = name
    return out


def _names(e: ast.AST) -> Iterator[str]:
    todo = [e]
    while todo:
        x = todo.pop()
        if isinstance(x, ast.Name):
            yield x.id
        todo += ast.iter_child_nodes(x)


def _boolean(e: ast.AST | None) -> bool:
    return isinstance(e, ast.Constant) and isinstance(e.value, bool)


def _unwritten(s: ast.stmt) -> bool:
    return isinstance(s, ast.Pass) or (isinstance(s, ast.Raise) and "NotImplementedError" in ast.unparse(s))


def shape(params: list[str], body: list[ast.stmt]) -> str | None:
    """A hash of the body in which parameters and assigned names are numbers; none for a small body.

    Numbers go by where a name is first assigned, nearest to the root first, after those of the parameters.
    """
    level, count, stored = list(body), 1, []
    while level:
        count += len(level)
        stored += [n.id for n in level if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store)]
        level = [c for n in level for c in ast.iter_child_nodes(n)]
    if not body or count < SHAPE_NODES:
        return None
    number = {name: i for i, name in enumerate(dict.fromkeys([*params, *stored]))}
    out, todo = hashlib.sha1(), list(reversed(body))
    while todo:
        n = todo.pop()
        match n:
            case ast.Name(id=name):
                out.update(f"({number.get(name, name)!r} {type(n.ctx).__name__})".encode())
            case ast.AST():
                out.update(f"({type(n).__name__}".encode())
                todo += reversed([value for _, value in ast.iter_fields(n)])
            case list():
                out.update(f"[{len(n)}".encode())
                todo += reversed(n)
            case _:
                out.update(f"<{type(n).__name__} {n!r}>".encode())
    return out.hexdigest()
