"""The syntax of TypeScript and JSX, file by file: tokens as they are asked for, and a parser by recursive descent.

Nodes are named and nested as TypeScript's own syntax trees are, as far as facts are read from them. What can't be read as a statement is
left out, up to where the next one seems to begin, and noted in ``Parser.wrong``.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

_NAME = r"(?:[^\W\d]|\$|\\u\{?[0-9a-fA-F]+\}?)(?:\w|\$|‌|‍|\\u\{?[0-9a-fA-F]+\}?)*"
_TRIVIA = re.compile(r"(?:[\s﻿]+|//[^\n]*|/\*[\s\S]*?(?:\*/|$))*")
_TOKEN = re.compile(
    rf"(?P<name>{_NAME})|(?P<private>\#{_NAME})"
    r"|(?P<number>0[xXbBoO][\da-fA-F_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?[\d_]+)?n?)"
    r"""|(?P<string>"(?:[^"\\\n]|\\[\s\S])*"|'(?:[^'\\\n]|\\[\s\S])*')|(?P<template>`)"""
    r"|(?P<op>\.\.\.|===|!==|\*\*=|<<=|&&=|\|\|=|\?\?=|=>|==|!=|<=|\+\+|--|&&|\|\||\?\?|\?\.(?!\d)|\*\*|<<|[-+*/%&|^]=|[{}()\[\];,<>+\-*/%&|^!~?:=.@])"
)
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[A-Za-z]*")
_CHUNK = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*")
_GREATER = re.compile(r">>>=|>>=|>>>|>>|>=")
_JSX_NAME = re.compile(r"[A-Za-z_$][\w$-]*(?::[\w$-]+)?")
_DOC = re.compile(r"/\*\*(?!/)[\s\S]*?\*/")

BINARY = {op: i for i, ops in enumerate((("??",), ("||",), ("&&",), ("|",), ("^",), ("&",), ("==", "!=", "===", "!=="), ("<", ">", "<=", ">=", "instanceof", "in", "as", "satisfies"), ("<<", ">>", ">>>"), ("+", "-"), ("*", "/", "%"), ("**",)), 1) for op in ops}
ASSIGN = frozenset(("=", "+=", "-=", "*=", "/=", "%=", "**=", "<<=", ">>=", ">>>=", "&=", "|=", "^=", "&&=", "||=", "??="))
#: Words that are never names of values. Fixed values.
RESERVED = frozenset(
    ("break", "case", "catch", "class", "const", "continue", "debugger", "default", "delete", "do", "else", "enum", "export", "extends", "false", "finally", "for", "function", "if", "import", "in", "instanceof", "new", "null", "return", "super", "switch", "this", "throw", "true", "try", "typeof", "var", "void", "while", "with")
)
MODIFIERS = frozenset(("public", "private", "protected", "static", "abstract", "override", "readonly", "async", "declare", "accessor", "export", "default", "const", "in", "out"))
#: Words that begin a statement wherever they begin a line, brackets left open before them or not.
TOP = frozenset(("export", "import", "function", "class", "const", "interface"))
TYPE_WORDS = frozenset(("any", "unknown", "number", "bigint", "object", "boolean", "string", "symbol", "void", "undefined", "never", "intrinsic"))


class Wrong(Exception):
    """Something that can't be read at this place."""


class Token(NamedTuple):
    kind: str
    text: str
    start: int
    end: int
    fresh: bool
    """Whether a line ends before it."""


class Node:
    """kids: in the order of the code. Parts with a name of their own (``name``, ``body``, ``type`` and others) are None where absent."""

    def __init__(self, kind: str, start: int, end: int, kids: list, text: str, **parts):
        self.kind, self.start, self.end, self.text, self.up = kind, start, end, text, None
        self.kids: list[Node] = [k for part in kids for k in (part if isinstance(part, list) else (part,)) if k is not None]
        self.__dict__.update(parts)
        for k in self.kids:
            k.up = self

    def __getattr__(self, name: str):
        if name.startswith("__"):
            raise AttributeError(name)
        return None

    def walk(self):
        """This node and all below it, in order."""
        todo = [self]
        while todo:
            n = todo.pop()
            yield n
            todo += reversed(n.kids)


class Parser:
    def __init__(self, source: str, jsx: bool = False):
        self.source, self.jsx, self.wrong, self.last = source, jsx, [], 0
        self.not_arrows: set[int] = set()
        self.t = self._token(re.match(r"(?:#![^\n]*)?", source).end())

    # Tokens.

    def _token(self, at: int) -> Token:
        start = _TRIVIA.match(self.source, at).end()
        fresh = "\n" in self.source[at:start]
        if start >= len(self.source):
            return Token("end", "", start, start, True)
        m = _TOKEN.match(self.source, start)
        return Token(m.lastgroup, m.group(), start, m.end(), fresh) if m else Token("odd", self.source[start], start, start + 1, fresh)

    def next(self) -> Token:
        t = self.t
        self.last = t.end
        self.t = self._token(t.end)
        return t

    def peek(self) -> Token:
        return self._token(self.t.end)

    def is_(self, *texts: str) -> bool:
        return self.t.text in texts and self.t.kind in ("op", "name")

    def take(self, *texts: str) -> Token | None:
        return self.next() if self.is_(*texts) else None

    def need(self, text: str) -> Token:
        if not self.is_(text):
            raise Wrong(f"{text} expected at {self.t.start}")
        return self.next()

    def attempt(self, read: Callable):
        """What ``read`` makes of this place, or None with nothing taken."""
        held = self.t, self.last, len(self.wrong)
        try:
            return read()
        except Wrong:
            self.t, self.last = held[:2]
            del self.wrong[held[2] :]
            return None

    def node(self, kind: str, start: int, *kids, **parts) -> Node:
        return Node(kind, start, self.last, [*kids], self.source[start : self.last] if not any(kids) else "", **parts)

    def leaf(self, kind: str) -> Node:
        t = self.next()
        return Node(kind, t.start, t.end, [], t.text)

    def name(self) -> Node:
        if self.t.kind == "private":
            return self.leaf("PrivateIdentifier")
        if self.t.kind != "name":
            raise Wrong(f"a name expected at {self.t.start}")
        return self.leaf("Identifier")

    def binding_name(self) -> Node:
        if self.t.text in RESERVED and self.t.text != "this":
            raise Wrong(f"a name expected at {self.t.start}")
        return self.name()

    def semicolon(self) -> None:
        if not self.take(";") and not self.t.fresh and not self.is_("}"):
            raise Wrong(f"; expected at {self.t.start}")

    def list_(self, close: str, read: Callable, sep: str = ",") -> list[Node]:
        out = []
        while not self.is_(close):
            out.append(read())
            if not self.take(sep):
                break
        self.need(close)
        return out

    # Statements.

    def file(self) -> Node:
        kids = self._statements("")
        self.last = len(self.source)
        return self.node("SourceFile", 0, kids, statements=kids)

    def _statements(self, close: str) -> list[Node]:
        out = []
        while self.t.kind != "end" and not (close and self.is_(close)):
            held = self.t
            try:
                out.append(self.statement())
            except (Wrong, RecursionError) as e:
                self.wrong.append(str(e))
                self._skip(held)
        return out

    def _skip(self, start: Token) -> None:
        """On to where the next statement may begin: after a semicolon, or at a line, outside of brackets opened since."""
        self.t, depth = start, 0
        while self.t.kind != "end":
            t = self.next()
            depth += (t.text in "([{") - (t.text in ")]}") if t.kind == "op" and len(t.text) == 1 else 0
            line_begins = self.t.fresh and self.source[self.t.start - 1 : self.t.start] == "\n" and self.t.text in TOP
            if depth < 0 or depth == 0 and (t.text == ";" or self.t.fresh or self.is_("}")) or line_begins:
                return

    def block(self) -> Node:
        start = self.need("{").start
        kids = self._statements("}")
        self.need("}")
        return self.node("Block", start, kids, statements=kids)

    def statement(self) -> Node:
        t = self.t
        start = t.start
        if t.kind == "op":
            if t.text == "{":
                return self.block()
            if t.text == ";":
                self.next()
                return self.node("EmptyStatement", start)
            if t.text == "@":
                return self.declaration(start)
        if t.kind == "name":
            read = getattr(self, f"_{t.text}_statement", None)
            if read:
                return read(start)
            if self._declares():
                return self.declaration(start)
            after = self.peek()
            if t.text not in RESERVED and after.kind == "op" and after.text == ":":
                label = self.name()
                self.next()
                body = self.statement()
                return self.node("LabeledStatement", start, label, body)
        e = self.expression()
        self.semicolon()
        return self.node("ExpressionStatement", start, e, expression=e)

    def _declares(self) -> bool:
        t, n = self.t, self.peek()
        if t.text in ("var", "const", "function", "class", "enum"):
            return True
        if t.text == "let":
            return n.kind == "name" or n.text in ("[", "{")
        if n.fresh or t.text not in ("async", "abstract", "declare", "type", "interface", "namespace", "module", "global"):
            return False
        if t.text == "async":
            return n.text == "function"
        if t.text == "abstract":
            return n.text == "class"
        if t.text == "global":
            return n.text == "{"
        if t.text in ("namespace", "module"):
            return n.kind in ("name", "string") and n.text not in ("instanceof", "in", "as")
        return n.kind == "name" and n.text not in ("instanceof", "in", "as", "satisfies")

    def _modifiers(self, member: bool = False) -> list[Node]:
        out = []
        while True:
            if self.is_("@"):
                start = self.next().start
                e = self.lhs()
                out.append(self.node("Decorator", start, e, expression=e))
                continue
            n = self.peek()
            if self.t.kind != "name" or self.t.text not in MODIFIERS or n.kind == "op" and n.text in ("(", "=", ";", ",", ":", "?", "!", "<", "}", "=>", ")", "."):
                return out
            if self.t.text == "const" and n.text != "enum" or member and n.fresh and self.t.text in ("async", "accessor", "declare", "readonly"):
                return out
            if self.t.text == "default" and not member and n.text not in ("class", "function", "async", "abstract", "interface", "enum"):
                return out
            if self.t.text == "static" and n.text == "{" or self.t.text == "async" and not member and n.text != "function":
                return out
            out.append(self.leaf(f"{self.t.text.capitalize()}Keyword"))

    def declaration(self, start: int, mods: list[Node] | None = None) -> Node:
        mods = (mods or []) + self._modifiers()
        t = self.t
        if t.text in ("var", "let", "const"):
            at = self.next().start
            found = self._declarations()
            self.semicolon()
            both = self.node("VariableDeclarationList", at, found, declarations=found)
            return self.node("VariableStatement", start, mods, both, mods=mods, declarations=found)
        if t.text == "function":
            return self._function(start, mods, "FunctionDeclaration")
        if t.text == "class":
            return self._class(start, mods, "ClassDeclaration")
        if t.text == "interface":
            self.next()
            name, args, base = self.name(), self.type_params(), self._heritage()
            return self.node("InterfaceDeclaration", start, mods, name, args, base, self.type_members(), name=name, mods=mods)
        if t.text == "type":
            self.next()
            name, args = self.name(), self.type_params()
            self.need("=")
            of = self.type_()
            self.semicolon()
            return self.node("TypeAliasDeclaration", start, mods, name, args, of, name=name, type=of, mods=mods)
        if t.text == "enum":
            self.next()
            name = self.name()
            self.need("{")
            members = self.list_("}", self._enum_member)
            return self.node("EnumDeclaration", start, mods, name, members, name=name, mods=mods)
        if t.text in ("namespace", "module", "global"):
            if t.text != "global":
                self.next()
            name = self.literal() if self.t.kind == "string" else self.name()
            while self.take("."):
                name = self.name()
            if not self.is_("{"):
                self.semicolon()
                return self.node("ModuleDeclaration", start, mods, name, name=name, mods=mods)
            at = self.need("{").start
            kids = self._statements("}")
            self.need("}")
            body = self.node("ModuleBlock", at, kids, statements=kids)
            return self.node("ModuleDeclaration", start, mods, name, body, name=name, body=body, mods=mods)
        raise Wrong(f"a declaration expected at {t.start}")

    def _enum_member(self) -> Node:
        start = self.t.start
        name = self.property_name()
        init = self.assignment() if self.take("=") else None
        return self.node("EnumMember", start, name, init, name=name, init=init)

    def _declarations(self, no_in: bool = False) -> list[Node]:
        out = []
        while True:
            start = self.t.start
            name = self.binding()
            self.take("!")
            of = self.type_() if self.take(":") else None
            init = self.assignment(no_in) if self.take("=") else None
            out.append(self.node("VariableDeclaration", start, name, of, init, name=name, type=of, init=init))
            if not self.take(","):
                return out

    def binding(self) -> Node:
        start = self.t.start
        if self.take("{"):
            return self.node("ObjectBindingPattern", start, found := self.list_("}", self._binding_element), elements=found)
        if self.take("["):
            return self.node("ArrayBindingPattern", start, found := self.list_("]", self._array_element), elements=found)
        return self.binding_name()

    def _array_element(self) -> Node:
        return self.node("OmittedExpression", self.t.start) if self.is_(",") else self._binding_element(False)

    def _binding_element(self, named: bool = True) -> Node:
        start, of = self.t.start, None
        rest = self.take("...")
        if named and not rest and (self.t.kind in ("string", "number") or self.is_("[") or self.peek().text == ":"):
            of = self.property_name()
            self.need(":")
        name = self.binding()
        init = self.assignment() if self.take("=") else None
        return self.node("BindingElement", start, of, name, init, name=name, property=of, init=init)

    def _function(self, start: int, mods: list[Node], kind: str) -> Node:
        self.need("function")
        star = self.take("*")
        name = self.name() if self.t.kind == "name" and not self.is_("(") else None
        args, params, of = self.type_params(), self.params(), self._returns()
        body = self.block() if self.is_("{") else None
        if body is None:
            self.semicolon()
        return self.node(kind, start, mods, name, args, params, of, body, name=name, params=params, type=of, body=body, mods=mods, star=star)

    def _returns(self) -> Node | None:
        return self.type_() if self.take(":") else None

    def params(self) -> list[Node]:
        self.need("(")
        return self.list_(")", self._param)

    def _param(self) -> Node:
        start = self.t.start
        mods = self._modifiers(True)
        rest = self.take("...")
        name = self.binding()
        asked = self.take("?")
        of = self.type_() if self.take(":") else None
        init = self.assignment() if self.take("=") else None
        return self.node("Parameter", start, mods, name, of, init, name=name, type=of, init=init, question=asked, rest=rest, mods=mods)

    def _heritage(self) -> list[Node]:
        out = []
        while self.is_("extends", "implements"):
            start, word, types = self.t.start, self.next().text, []
            while True:
                at = self.t.start
                e = self.lhs(calls=True)
                args = self.type_args() if self.is_("<") else []
                types.append(e if e.kind == "ExpressionWithTypeArguments" else self.node("ExpressionWithTypeArguments", at, e, args, expression=e))
                if not self.take(","):
                    break
            out.append(self.node("HeritageClause", start, types, word=word, types=types))
        return out

    def _class(self, start: int, mods: list[Node], kind: str) -> Node:
        self.need("class")
        name = self.name() if self.t.kind == "name" and not self.is_("extends", "implements") else None
        args, base = self.type_params(), self._heritage()
        self.need("{")
        members = []
        while not self.is_("}"):
            if self.take(";"):
                continue
            if self.t.kind == "end":
                raise Wrong("} expected at the end")
            held = self.t
            try:
                members.append(self._member())
            except Wrong as e:
                self.wrong.append(str(e))
                self._skip(held)
        self.need("}")
        return self.node(kind, start, mods, name, args, base, members, name=name, heritage=base, members=members, mods=mods)

    def _member(self) -> Node:
        start = self.t.start
        mods = self._modifiers(True)
        if self.is_("static") and self.peek().text == "{":
            self.next()
            body = self.block()
            return self.node("ClassStaticBlockDeclaration", start, mods, body, body=body, mods=mods)
        if self.is_("[") and (found := self.attempt(lambda: self._index(start, mods))):
            return found
        kind, n = "MethodDeclaration", self.peek()
        if self.is_("get", "set") and not (n.kind == "op" and n.text in ("(", "=", ";", ":", "?", "!", "<", "}")):
            kind = "GetAccessor" if self.next().text == "get" else "SetAccessor"
        star = self.take("*")
        if self.is_("constructor") and self.peek().text == "(" and kind == "MethodDeclaration":
            self.next()
            params = self.params()
            body = self.block() if self.is_("{") else None
            if body is None:
                self.semicolon()
            return self.node("Constructor", start, mods, params, body, params=params, body=body, mods=mods)
        name = self.property_name()
        asked = self.take("?", "!")
        if self.is_("(", "<"):
            return self._method(start, mods, kind, name, star)
        of = self.type_() if self.take(":") else None
        init = self.assignment() if self.take("=") else None
        self.semicolon()
        return self.node("PropertyDeclaration", start, mods, name, of, init, name=name, type=of, init=init, mods=mods, question=asked)

    def _method(self, start: int, mods: list[Node], kind: str, name: Node, star=None) -> Node:
        args, params, of = self.type_params(), self.params(), self._returns()
        body = self.block() if self.is_("{") else None
        if body is None and not self.is_(","):
            self.semicolon()
        return self.node(kind, start, mods, name, args, params, of, body, name=name, params=params, type=of, body=body, mods=mods, star=star)

    def _index(self, start: int, mods: list[Node]) -> Node:
        self.need("[")
        key = self._param()
        if key.type is None:
            raise Wrong("no index")
        self.need("]")
        of = self.type_() if self.take(":") else None
        self.take(";", ",")
        return self.node("IndexSignature", start, mods, key, of, mods=mods)

    def property_name(self) -> Node:
        if self.t.kind in ("string", "number"):
            return self.literal()
        if self.is_("["):
            start = self.next().start
            e = self.assignment()
            self.need("]")
            return self.node("ComputedPropertyName", start, e, expression=e)
        return self.name()

    def _if_statement(self, start: int) -> Node:
        self.next()
        test = self._tested()
        then = self.statement()
        other = self.statement() if self.take("else") else None
        return self.node("IfStatement", start, test, then, other, expression=test)

    def _tested(self) -> Node:
        self.need("(")
        e = self.expression()
        self.need(")")
        return e

    def _for_statement(self, start: int) -> Node:
        self.next()
        self.take("await")
        self.need("(")
        first, at = None, self.t.start
        if not self.is_(";"):
            if self.is_("var", "const") or self.is_("let") and self._declares():
                self.next()
                found = self._declarations(True)
                first = self.node("VariableDeclarationList", at, found, declarations=found)
            else:
                first = self.expression(True)
        if kind := {"of": "ForOfStatement", "in": "ForInStatement"}.get(self.t.text):
            self.next()
            rest = [self.assignment() if kind == "ForOfStatement" else self.expression()]
        else:
            kind, rest = "ForStatement", []
            self.need(";")
            for close in (";", ")"):
                rest += [] if self.is_(close) else [self.expression()]
                if close == ";":
                    self.need(";")
        self.need(")")
        return self.node(kind, start, first, rest, self.statement(), first=first, rest=rest)

    def _while_statement(self, start: int) -> Node:
        self.next()
        test = self._tested()
        return self.node("WhileStatement", start, test, self.statement())

    def _with_statement(self, start: int) -> Node:
        return self._while_statement(start)

    def _do_statement(self, start: int) -> Node:
        self.next()
        body = self.statement()
        self.need("while")
        test = self._tested()
        self.take(";")
        return self.node("DoStatement", start, body, test)

    def _return_statement(self, start: int) -> Node:
        kind = "ReturnStatement" if self.next().text == "return" else "ThrowStatement"
        e = None if self.t.fresh or self.is_(";", "}") or self.t.kind == "end" else self.expression()
        self.semicolon()
        return self.node(kind, start, e, expression=e)

    def _throw_statement(self, start: int) -> Node:
        return self._return_statement(start)

    def _break_statement(self, start: int) -> Node:
        kind = f"{self.next().text.capitalize()}Statement"
        label = self.name() if self.t.kind == "name" and not self.t.fresh and self.t.text not in RESERVED else None
        self.semicolon()
        return self.node(kind, start, label)

    def _continue_statement(self, start: int) -> Node:
        return self._break_statement(start)

    def _debugger_statement(self, start: int) -> Node:
        return self._break_statement(start)

    def _try_statement(self, start: int) -> Node:
        self.next()
        body, handler, last = self.block(), None, None
        if self.is_("catch"):
            at, name = self.next().start, None
            if self.take("("):
                found = self.binding()
                of = self.type_() if self.take(":") else None
                name = self.node("VariableDeclaration", found.start, found, of, name=found, type=of)
                self.need(")")
            inner = self.block()
            handler = self.node("CatchClause", at, name, inner, declaration=name)
        if self.take("finally"):
            last = self.block()
        return self.node("TryStatement", start, body, handler, last)

    def _switch_statement(self, start: int) -> Node:
        self.next()
        of = self._tested()
        at, cases = self.need("{").start, []
        while not self.take("}"):
            if self.t.kind == "end":
                raise Wrong("} expected at the end")
            begin = self.t.start
            value = None if self.take("default") else self.need("case") and self.expression()
            self.need(":")
            kids = []
            while not self.is_("case", "default", "}") and self.t.kind != "end":
                kids.append(self.statement())
            cases.append(self.node("CaseClause" if value else "DefaultClause", begin, value, kids, statements=kids))
        return self.node("SwitchStatement", start, of, self.node("CaseBlock", at, cases))

    def _import_statement(self, start: int) -> Node:
        after = self.peek()
        if after.text in ("(", "."):
            e = self.expression()
            self.semicolon()
            return self.node("ExpressionStatement", start, e, expression=e)
        self.next()
        clause, types = None, False
        if self.t.kind != "string":
            at = self.t.start
            n = self.peek()
            if self.is_("type") and (n.text in ("{", "*") or n.kind == "name" and n.text != "from"):
                types = bool(self.next())
            name = self.name() if self.t.kind == "name" else None
            if name and self.take("="):
                e = self.expression()
                self.semicolon()
                return self.node("ImportEqualsDeclaration", start, name, e, name=name, expression=e, types=types)
            named = None
            if name is None or self.take(","):
                named = self._named("Import")
            clause = self.node("ImportClause", at, name, named, name=name, named=named, types=types)
            self.need("from")
        spec = self.literal()
        self._attributes()
        self.semicolon()
        return self.node("ImportDeclaration", start, clause, spec, clause=clause, spec=spec)

    def _attributes(self) -> None:
        if self.is_("with", "assert") and self.peek().text == "{":
            self.next()
            self.primary()

    def _named(self, what: str) -> Node:
        start = self.t.start
        if self.take("*"):
            name = (self.literal() if self.t.kind == "string" else self.name()) if self.take("as") else None
            return self.node(f"Namespace{what}", start, name, name=name)
        self.need("{")
        found = self.list_("}", lambda: self._specifier(what))
        return self.node(f"Named{what}s", start, found, elements=found)

    def _specifier(self, what: str) -> Node:
        start, types = self.t.start, False
        word = lambda: self.literal() if self.t.kind == "string" else self.name()
        if self.is_("type") and self.peek().text not in (",", "}", "as") or self.is_("type") and self.peek().text == "as" and self._token(self.peek().end).text == "as":
            types = bool(self.next())
        of, name = word(), None
        if self.take("as"):
            name = word()
        return self.node(f"{what}Specifier", start, of, name, property=of if name else None, name=name or of, types=types)

    def _export_statement(self, start: int) -> Node:
        n = self.peek()
        if n.text == "type" and self._token(n.end).text in ("{", "*") or n.text in ("*", "{"):
            self.next()
            types = bool(self.take("type"))
            named = self._named("Export")
            spec = self.literal() if self.take("from") else None
            self._attributes()
            self.semicolon()
            return self.node("ExportDeclaration", start, named, spec, named=named, spec=spec, types=types)
        if n.text == "=" or n.text == "default":
            held = self.t
            mods = self._modifiers()
            if self.is_("class", "function", "interface", "enum"):
                return self.declaration(start, mods)
            self.t = held
            self.next()
            self.next()
            e = self.assignment()
            self.semicolon()
            return self.node("ExportAssignment", start, e, expression=e)
        if n.text == "import":
            self.next()
            return self._import_statement(start)
        if n.text == "as":
            for _ in range(4):
                self.next()
            return self.node("NamespaceExportDeclaration", start)
        return self.declaration(start)

    # Types.

    def type_params(self) -> list[Node]:
        return self.list_(">", self._type_param) if self.take("<") else []

    def _type_param(self) -> Node:
        start = self.t.start
        mods = self._modifiers(True)
        name = self.name()
        bound = self.type_() if self.take("extends") else None
        default = self.type_() if self.take("=") else None
        return self.node("TypeParameter", start, mods, name, bound, default, name=name)

    def type_args(self) -> list[Node]:
        self.need("<")
        return self.list_(">", self.type_)

    def type_(self) -> Node:
        start = self.t.start
        if self.is_("new", "<", "(") or self.is_("abstract") and self.peek().text == "new":
            if found := self.attempt(lambda: self._function_type(start)):
                return found
        of = self._union(start)
        if self.is_("extends") and not self.t.fresh and (found := self.attempt(lambda: self._conditional_type(start, of))):
            return found
        return of

    def _function_type(self, start: int) -> Node:
        self.take("abstract")
        kind = "ConstructorType" if self.take("new") else "FunctionType"
        args, params = self.type_params(), self.params()
        self.need("=>")
        of = self.type_()
        return self.node(kind, start, args, params, of, params=params, type=of)

    def _conditional_type(self, start: int, of: Node) -> Node:
        self.need("extends")
        kids = [of, self._union(self.t.start)]
        for sep in ("?", ":"):
            self.need(sep)
            kids.append(self.type_())
        return self.node("ConditionalType", start, kids)

    def _union(self, start: int) -> Node:
        self.take("|")
        found = [self._intersection()]
        while self.take("|"):
            found.append(self._intersection())
        return found[0] if len(found) == 1 else self.node("UnionType", start, found, types=found)

    def _intersection(self) -> Node:
        start = self.t.start
        self.take("&")
        found = [self._type_operator()]
        while self.take("&"):
            found.append(self._type_operator())
        return found[0] if len(found) == 1 else self.node("IntersectionType", start, found, types=found)

    def _type_operator(self) -> Node:
        start, n = self.t.start, self.peek()
        begins = n.kind in ("name", "string", "number") and not n.fresh or n.text in ("{", "[", "(")
        if self.is_("keyof", "unique", "readonly") and begins:
            self.next()
            return self.node("TypeOperator", start, self._type_operator())
        if self.is_("infer") and n.kind == "name":
            self.next()
            name = self.name()
            bound = self.attempt(lambda: (self.need("extends"), self._union(self.t.start))[1])
            return self.node("InferType", start, self.node("TypeParameter", name.start, name, bound, name=name))
        if self.is_("asserts") and n.kind == "name" and not n.fresh and n.text != "is":
            self.next()
            name = self.name()
            of = self.type_() if self.take("is") else None
            return self.node("TypePredicate", start, name, of, type=of)
        of = self._array_type()
        if self.is_("is") and not self.t.fresh and of.kind in ("TypeReference", "ThisType"):
            self.next()
            return self.node("TypePredicate", start, of, self.type_())
        return of

    def _array_type(self) -> Node:
        start = self.t.start
        of = self._plain_type()
        while self.is_("[") and not self.t.fresh:
            self.next()
            if self.take("]"):
                of = self.node("ArrayType", start, of)
            else:
                at = self.type_()
                self.need("]")
                of = self.node("IndexedAccessType", start, of, at)
        return of

    def _entity(self) -> Node:
        start = self.t.start
        at = self.name()
        while self.take("."):
            right = self.name()
            at = self.node("QualifiedName", start, at, right, left=at, right=right)
        return at

    def _plain_type(self) -> Node:
        t = self.t
        start = t.start
        if t.kind in ("string", "number") or t.text == "-" or t.kind == "name" and t.text in ("true", "false", "null"):
            return self.node("LiteralType", start, self.unary())
        if t.kind == "template":
            return self.node("TemplateLiteralType", start, self.template(self.type_).kids)
        if t.text == "(":
            self.next()
            of = self.type_()
            self.need(")")
            return self.node("ParenthesizedType", start, of, type=of)
        if t.text == "[":
            self.next()
            return self.node("TupleType", start, self.list_("]", self._tuple_member))
        if t.text == "{":
            return self.attempt(self._mapped) or self.node("TypeLiteral", start, self.type_members())
        if t.text == "typeof":
            self.next()
            name = self._plain_type() if self.is_("import") else self._entity()
            return self.node("TypeQuery", start, name, self.type_args() if self.is_("<") and not self.t.fresh else [])
        if t.text == "import":
            self.next()
            self.need("(")
            of = self.type_()
            self.need(")")
            name = self._entity() if self.take(".") else None
            return self.node("ImportType", start, of, name, self.type_args() if self.is_("<") else [])
        if t.text == "this":
            self.next()
            return self.node("ThisType", start)
        if t.kind == "name" and t.text in TYPE_WORDS and self.peek().text != ".":
            return self.leaf(f"{t.text.capitalize()}Keyword")
        if t.kind != "name" or t.text in RESERVED:
            raise Wrong(f"a type expected at {start}")
        name = self._entity()
        args = self.type_args() if self.is_("<") and not self.t.fresh else []
        return self.node("TypeReference", start, name, args, name=name, args=args)

    def _tuple_member(self) -> Node:
        start = self.t.start
        rest = self.take("...")
        n = self.peek()
        if self.t.kind == "name" and (n.text == ":" or n.text == "?" and self._token(n.end).text == ":"):
            name = self.name()
            self.take("?")
            self.need(":")
            return self.node("NamedTupleMember", start, name, self.type_(), name=name)
        of = self.type_()
        asked = self.take("?")
        return self.node("RestType" if rest else "OptionalType", start, of) if rest or asked else of

    def _mapped(self) -> Node:
        start = self.need("{").start
        self.take("+", "-")
        self.take("readonly")
        self.need("[")
        at = self.t.start
        name = self.name()
        self.need("in")
        of = self.type_()
        key = self.node("TypeParameter", at, name, of, name=name)
        new = self.type_() if self.take("as") else None
        self.need("]")
        self.take("+", "-")
        self.take("?")
        value = self.type_() if self.take(":") else None
        self.take(";", ",")
        self.need("}")
        return self.node("MappedType", start, key, new, value)

    def type_members(self) -> list[Node]:
        self.need("{")
        out = []
        while not self.take("}"):
            if self.t.kind == "end":
                raise Wrong("} expected at the end")
            out.append(self._type_member())
            if not self.take(";", ",") and not self.t.fresh and not self.is_("}"):
                raise Wrong(f"; expected at {self.t.start}")
        return out

    def _type_member(self) -> Node:
        start = self.t.start
        if self.is_("(", "<") or self.is_("new") and self.peek().text in ("(", "<"):
            kind = "ConstructSignature" if self.take("new") else "CallSignature"
            args, params, of = self.type_params(), self.params(), self._returns()
            return self.node(kind, start, args, params, of, params=params)
        mods = self._modifiers(True)
        if self.is_("[") and (found := self.attempt(lambda: self._index(start, mods))):
            return found
        n = self.peek()
        if self.is_("get", "set") and n.kind in ("name", "string") and not n.fresh:
            self.next()
        name = self.property_name()
        self.take("?")
        if self.is_("(", "<"):
            args, params, of = self.type_params(), self.params(), self._returns()
            return self.node("MethodSignature", start, mods, name, args, params, of, name=name, params=params)
        of = self.type_() if self.take(":") else None
        return self.node("PropertySignature", start, mods, name, of, name=name, type=of)

    # Expressions.

    def expression(self, no_in: bool = False) -> Node:
        start = self.t.start
        e = self.assignment(no_in)
        while self.is_(","):
            op = self.leaf("op:,")
            right = self.assignment(no_in)
            e = self.node("BinaryExpression", start, e, op, right, left=e, op=",", right=right)
        return e

    def assignment(self, no_in: bool = False) -> Node:
        start = self.t.start
        if self.is_("yield"):
            self.next()
            self.take("*")
            bare = self.t.fresh or self.is_(")", "]", "}", ",", ";", ":") or self.t.kind == "end"
            e = None if bare else self.assignment(no_in)
            return self.node("YieldExpression", start, e, expression=e)
        if (self.t.kind == "name" or self.is_("(", "<")) and (arrow := self._arrow(start)):
            return arrow
        e = self._conditional(no_in)
        op = self._operator()
        if op in ASSIGN:
            op = self._operator_node(op)
            right = self.assignment(no_in)
            return self.node("BinaryExpression", start, e, op, right, left=e, op=op.text, right=right)
        return e

    def _arrow(self, start: int) -> Node | None:
        n = self.peek()
        if start in self.not_arrows:
            return None
        if self.t.kind == "name" and self.t.text not in RESERVED and n.text == "=>" and n.kind == "op":
            name = self.name()
            return self._arrow_body(start, [], [], [self.node("Parameter", start, name, name=name)], None)
        if self.is_("async") and not n.fresh and (n.kind == "name" and n.text not in RESERVED or n.text in ("(", "<")):
            found = self.attempt(lambda: self._arrow_head(start, [self.leaf("AsyncKeyword")]))
        elif self.is_("(") or self.is_("<") and not (self.jsx and not re.match(r"<\s*[\w$]+\s*(?:,|extends\b(?!\s*[>=]))", self.source[start : start + 200])):
            found = self.attempt(lambda: self._arrow_head(start, []))
        else:
            return None
        if not found:
            self.not_arrows.add(start)
            return None
        return self._arrow_body(*found)

    def _arrow_head(self, start: int, mods: list[Node]) -> tuple:
        if self.t.kind == "name":
            at = self.t.start
            name = self.binding_name()
            params, args, of = [self.node("Parameter", at, name, name=name)], [], None
        else:
            args, params, of = self.type_params(), self.params(), self._returns()
        if not self.is_("=>") or self.t.fresh:
            raise Wrong("no arrow")
        return start, mods, args, params, of

    def _arrow_body(self, start: int, mods: list[Node], args: list[Node], params: list[Node], of: Node | None) -> Node:
        self.need("=>")
        arrow = Node("op:=>", self.last - 2, self.last, [], "=>")
        body = self.block() if self.is_("{") else self.assignment()
        return self.node("ArrowFunction", start, mods, args, params, of, arrow, body, params=params, type=of, body=body, mods=mods)

    def _operator(self) -> str:
        """The operator here; tokens hold > alone."""
        if self.t.text == ">" and self.t.kind == "op":
            m = _GREATER.match(self.source, self.t.start)
            return m.group() if m else ">"
        return self.t.text if self.t.kind in ("op", "name") else ""

    def _operator_node(self, op: str) -> Node:
        start = self.t.start
        self.last = start + len(op)
        self.t = self._token(self.last)
        return Node(f"op:{op}", start, self.last, [], op)

    def _conditional(self, no_in: bool) -> Node:
        start = self.t.start
        e = self._binary(0, no_in)
        if not self.is_("?"):
            return e
        self.next()
        a = self.attempt(lambda: (self.assignment(), self.need(":"))[0])
        if a is None:  # what looks like the type an arrow returns is the other branch
            self.not_arrows.add(self.t.start)
            a = self.assignment()
            self.need(":")
        b = self.assignment(no_in)
        marks = (Node("op:?", a.start, a.start, [], "?"), Node("op::", b.start, b.start, [], ":"))
        return self.node("ConditionalExpression", start, e, marks[0], a, marks[1], b, yes=a, no=b)

    def _binary(self, least: int, no_in: bool) -> Node:
        start = self.t.start
        e = self.unary()
        while True:
            op = self._operator()
            level = BINARY.get(op, 0)
            if level <= least or op == "in" and no_in or op in ("as", "satisfies") and self.t.fresh:
                return e
            if op in ("as", "satisfies"):
                self.next()
                of = self.node("TypeReference", self.t.start, self.leaf("Identifier")) if self.is_("const") else self.type_()
                e = self.node("AsExpression" if op == "as" else "SatisfiesExpression", start, e, of, expression=e, type=of)
                continue
            op = self._operator_node(op)
            right = self._binary(level - (op.text == "**"), no_in)
            e = self.node("BinaryExpression", start, e, op, right, left=e, op=op.text, right=right)

    def unary(self) -> Node:
        t = self.t
        start = t.start
        if t.kind == "op" and t.text in ("+", "-", "~", "!", "++", "--"):
            self.next()
            e = self.unary()
            return self.node("PrefixUnaryExpression", start, e, operand=e)
        if t.kind == "name" and t.text in ("typeof", "void", "delete", "await"):
            n = self.peek()
            if t.text != "await" or not (n.kind == "op" and n.text in (")", ",", ";", "=", ".", ":", "=>", "]", "}") or n.fresh and n.kind == "op"):
                self.next()
                e = self.unary()
                return self.node({"typeof": "TypeOfExpression", "void": "VoidExpression", "delete": "DeleteExpression", "await": "AwaitExpression"}[t.text], start, e, expression=e)
        if t.text == "<" and t.kind == "op":
            if self.jsx:
                return self._jsx()
            self.next()
            of = self.type_()
            self.need(">")
            e = self.unary()
            return self.node("TypeAssertionExpression", start, of, e, expression=e, type=of)
        e = self.lhs()
        if self.is_("++", "--") and not self.t.fresh:
            self.next()
            return self.node("PostfixUnaryExpression", start, e, operand=e)
        return e

    def _arguments(self) -> list[Node]:
        self.need("(")
        return self.list_(")", self._argument)

    def _argument(self) -> Node:
        start = self.t.start
        if self.take("..."):
            e = self.assignment()
            return self.node("SpreadElement", start, e, expression=e)
        return self.node("OmittedExpression", start) if self.is_(",") else self.assignment()

    def lhs(self, calls: bool = True) -> Node:
        start = self.t.start
        if self.is_("new"):
            self.next()
            if self.take("."):
                name = self.name()
                e = self.node("MetaProperty", start, name, name=name)
            else:
                of = self.lhs(False)
                args = self.attempt(self._call_type_args) or []
                given = self._arguments() if self.is_("(") else None
                e = self.node("NewExpression", start, of, args, given, expression=of, args=given or [])
        else:
            e = self.primary()
        while True:
            if self.is_(".", "?."):
                asked = self.next().text == "?."
                if asked and self.is_("(") and calls:
                    given = self._arguments()
                    e = self.node("CallExpression", start, e, given, expression=e, args=given)
                elif asked and self.is_("["):
                    e = self._element(start, e)
                else:
                    name = self.name()
                    e = self.node("PropertyAccessExpression", start, e, name, expression=e, name=name)
            elif self.is_("["):
                e = self._element(start, e)
            elif self.is_("(") and calls:
                given = self._arguments()
                e = self.node("CallExpression", start, e, given, expression=e, args=given)
            elif self.is_("!") and not self.t.fresh:
                self.next()
                e = self.node("NonNullExpression", start, e, expression=e)
            elif self.t.kind == "template":
                text = self.template(self.expression)
                e = self.node("TaggedTemplateExpression", start, e, text, expression=e)
            elif calls and self.is_("<") and not self.t.fresh and (args := self.attempt(self._call_type_args)):
                if self.is_("("):
                    given = self._arguments()
                    e = self.node("CallExpression", start, e, args, given, expression=e, args=given)
                elif self.t.kind != "template":
                    e = self.node("ExpressionWithTypeArguments", start, e, args, expression=e)
            else:
                return e

    def _element(self, start: int, e: Node) -> Node:
        self.need("[")
        at = self.expression()
        self.need("]")
        return self.node("ElementAccessExpression", start, e, at, expression=e)

    def _call_type_args(self) -> list[Node]:
        args = self.type_args()
        follows = self.is_("(", ")", "]", "}", ",", ";", ":", ".", "?.", "?", "==", "===", "!=", "!==", "&&", "||", "??", "extends", "implements", "{") or self.t.kind in ("template", "end") or self.t.fresh
        if not follows:
            raise Wrong("no type arguments")
        return args

    def literal(self) -> Node:
        kind = {"string": "StringLiteral", "number": "BigIntLiteral" if self.t.text.endswith("n") and not self.t.text.startswith("0x") else "NumericLiteral"}.get(self.t.kind)
        if not kind:
            raise Wrong(f"a literal expected at {self.t.start}")
        return self.leaf(kind)

    def template(self, read: Callable) -> Node:
        """A template from its backtick on."""
        start = at = self.t.start
        pos, spans, head = _CHUNK.match(self.source, start + 1).end(), [], None
        while self.source.startswith("${", pos):
            head = head or Node("TemplateHead", start, pos + 2, [], self.source[start : pos + 2])
            self.last = pos + 2
            self.t = self._token(pos + 2)
            at = self.t.start
            e = read()
            if not self.is_("}"):
                raise Wrong(f"}} expected at {self.t.start}")
            end = _CHUNK.match(self.source, self.t.end).end()
            more = self.source.startswith("${", end)
            text = Node("TemplateMiddle" if more else "TemplateTail", self.t.start, end + 1 + more, [], self.source[self.t.start : end + 1 + more])
            self.last = end
            spans.append(self.node("TemplateSpan", at, e, text, expression=e))
            pos = end
        if not self.source.startswith("`", pos):
            raise Wrong("an open template")
        self.last = pos + 1
        self.t = self._token(self.last)
        return self.node("TemplateExpression", start, head, spans) if head else self.node("NoSubstitutionTemplateLiteral", start)

    def primary(self) -> Node:
        t = self.t
        start = t.start
        if t.kind in ("string", "number"):
            return self.literal()
        if t.kind == "template":
            return self.template(self.expression)
        if t.kind == "private":
            return self.leaf("PrivateIdentifier")
        if t.kind == "name":
            word = {"this": "ThisKeyword", "super": "SuperKeyword", "null": "NullKeyword", "true": "TrueKeyword", "false": "FalseKeyword"}.get(t.text)
            if word:
                return self.leaf(word)
            if t.text == "function" or t.text == "async" and self.peek().text == "function" and not self.peek().fresh:
                return self._function(start, [self.leaf("AsyncKeyword")] if t.text == "async" else [], "FunctionExpression")
            if t.text == "class":
                return self._class(start, [], "ClassExpression")
            if t.text == "import":
                self.next()
                if self.take("."):
                    name = self.name()
                    return self.node("MetaProperty", start, name, name=name)
                return Node("ImportKeyword", start, self.last, [], "import")
            if t.text in RESERVED:
                raise Wrong(f"an expression expected at {start}")
            return self.leaf("Identifier")
        if t.text == "(":
            self.next()
            e = self.expression()
            self.need(")")
            return self.node("ParenthesizedExpression", start, e, expression=e)
        if t.text == "[":
            self.next()
            found = self.list_("]", self._argument)
            return self.node("ArrayLiteralExpression", start, found, elements=found)
        if t.text == "{":
            self.next()
            found = self.list_("}", self._property)
            return self.node("ObjectLiteralExpression", start, found, properties=found)
        if t.text == "@":
            return self._class(start, self._modifiers(), "ClassExpression")
        if t.text in ("/", "/=") and (m := _REGEX.match(self.source, start)):
            self.last = m.end()
            self.t = self._token(self.last)
            return Node("RegularExpressionLiteral", start, self.last, [], m.group())
        raise Wrong(f"an expression expected at {start}")

    def _property(self) -> Node:
        start = self.t.start
        if self.take("..."):
            e = self.assignment()
            return self.node("SpreadAssignment", start, e, expression=e)
        mods, kind, n = [], "MethodDeclaration", self.peek()
        plain = n.kind == "op" and n.text in ("(", ":", ",", "}", "=", "<")
        if self.is_("async") and not plain:
            mods = [self.leaf("AsyncKeyword")]
        elif self.is_("get", "set") and not plain:
            kind = "GetAccessor" if self.next().text == "get" else "SetAccessor"
        star = self.take("*")
        name = self.property_name()
        if self.is_("(", "<"):
            args, params, of = self.type_params(), self.params(), self._returns()
            body = self.block()
            return self.node(kind, start, mods, name, args, params, of, body, name=name, params=params, type=of, body=body, mods=mods, star=star)
        if self.take(":"):
            e = self.assignment()
            return self.node("PropertyAssignment", start, name, e, name=name, init=e)
        init = self.assignment() if self.take("=") else None
        return self.node("ShorthandPropertyAssignment", start, name, init, name=name, init=init)

    # JSX.

    def _jsx(self) -> Node:
        start = self.need("<").start
        if self.is_(">"):
            return self._jsx_children(start, self.t.end, None)
        tag = self._jsx_tag()
        args = self.type_args() if self.is_("<") else []
        at, found = self.t.start, []
        while not self.is_(">", "/"):
            found.append(self._jsx_attribute())
        parts = self.node("JsxAttributes", at, found)
        if self.take("/"):
            self.need(">")
            return self.node("JsxSelfClosingElement", start, tag, args, parts, tag=tag)
        if not self.is_(">"):
            raise Wrong(f"> expected at {self.t.start}")
        self.last = self.t.end
        return self._jsx_children(start, self.t.end, self.node("JsxOpeningElement", start, tag, args, parts, tag=tag))

    def _jsx_tag(self) -> Node:
        start = self.t.start
        m = _JSX_NAME.match(self.source, start)
        if not m:
            raise Wrong(f"a tag expected at {start}")
        self.last = m.end()
        self.t = self._token(self.last)
        e = Node("ThisKeyword" if m.group() == "this" else "Identifier", start, self.last, [], m.group())
        while self.take("."):
            name = self.name()
            e = self.node("PropertyAccessExpression", start, e, name, expression=e, name=name)
        return e

    def _jsx_attribute(self) -> Node:
        start = self.t.start
        if self.take("{"):
            self.need("...")
            e = self.assignment()
            self.need("}")
            return self.node("JsxSpreadAttribute", start, e, expression=e)
        name = self._jsx_tag()
        value = None
        if self.is_("="):
            at = _TRIVIA.match(self.source, self.t.end).end()
            if self.source[at : at + 1] in ("'", '"'):  # without escapes
                end = self.source.find(self.source[at], at + 1)
                if end < 0:
                    raise Wrong("an open string")
                value = Node("StringLiteral", at, end + 1, [], self.source[at : end + 1])
                self.last = end + 1
                self.t = self._token(self.last)
            else:
                self.next()
                value = self._jsx_expression() if self.is_("{") else self._jsx()
        return self.node("JsxAttribute", start, name, value, name=name)

    def _jsx_expression(self) -> Node:
        start = self.need("{").start
        self.take("...")
        e = None if self.is_("}") else self.expression()
        self.need("}")
        return self.node("JsxExpression", start, e, expression=e)

    def _jsx_children(self, start: int, pos: int, opening: Node | None) -> Node:
        kids = []
        while True:
            end = min((i for i in (self.source.find("<", pos), self.source.find("{", pos)) if i >= 0), default=-1)
            if end < 0:
                raise Wrong("an open element")
            if end > pos:
                kids.append(Node("JsxText", pos, end, [], self.source[pos:end]))
            self.t = self._token(end)
            if self.is_("<") and self.peek().text == "/":
                at = self.next().start
                self.next()
                tag = None if self.is_(">") else self._jsx_tag()
                self.need(">")
                closing = self.node("JsxClosingElement", at, tag, tag=tag)
                return self.node("JsxElement" if opening else "JsxFragment", start, opening, kids, closing, opening=opening)
            kids.append(self._jsx() if self.is_("<") else self._jsx_expression())
            pos = self.last


def doc_before(source: str, start: int) -> str:
    """The first line of the /** */ comment that stands right before a place, without its tags."""
    at = len(source[:start].rstrip())
    if not source.endswith("*/", 0, at):
        return ""
    found = None
    for m in _DOC.finditer(source, max(source.rfind("/**", 0, at), 0), at):
        found = m
    if not found or found.end() != at:
        return ""
    lines = [re.sub(r"^\s*\*? ?", "", x) for x in found.group()[3:-2].split("\n")]
    text = "\n".join(lines).strip()
    return "" if text.startswith("@") else text.split("\n")[0].strip()
