"""Recursive-descent parser of the filter language.

From loosest to tightest: ``,``; ``|``; ``+= |=``; ``or``; ``and``; comparison
(does not chain); ``+ -``; ``* /``; prefix ``not`` and ``del``; postfix access.
Both ``,`` and ``;`` separate arguments.  ``def name(a; b): body;`` before a
filter defines a macro.
"""

from __future__ import annotations

import re
from functools import lru_cache

from . import ast as A


class ParseError(ValueError):
    """What is wrong with a filter, and where."""

    def __init__(self, message: str, text: str, at: int):
        line = text.count("\n", 0, at) + 1
        column = at - (text.rfind("\n", 0, at) + 1) + 1
        super().__init__(f"{message} at line {line}, column {column}")
        self.at = at


_TOKEN = re.compile(
    r"""(?P<space>\s+|\#[^\n]*)
      | (?P<number>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)
      | (?P<string>"(?:[^"\\]|\\.)*"|'[^']*')
      | (?P<name>[A-Za-z_][A-Za-z0-9_]*)
      | (?P<variable>\$[A-Za-z_][A-Za-z0-9_]*)
      | (?P<op>\|=|\+=|==|!=|<=|>=|[.\[\](){}|,;:+\-*/<>])""",
    re.X,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "/": "/", "\\": "\\", '"': '"'}
KEYWORDS = frozenset("and or not del if then else end try catch true false null def".split())
FILE_JOINS = frozenset("join inner_join left_join right_join outer_join semi_join anti_join".split())
_BARE_PATH = re.compile(r"\s*([A-Za-z0-9_./~:-]+\.[A-Za-z0-9]+)\s*(?=[;,])")


def _string(token: str) -> str:
    body = token[1:-1]
    if token[0] == "'":
        return body
    return re.sub(r"\\(u[0-9a-fA-F]{4}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] == "u" and len(m[1]) == 5 else _ESCAPES.get(m[1], m[1]), body)


class _Parser:
    def __init__(self, text: str):
        self.text, self.at, self.macros = text, 0, {}
        self.kind, self.value, self.start = "", "", 0
        self._advance()

    def _advance(self) -> None:
        while True:
            if self.at >= len(self.text):
                self.kind, self.value, self.start = "end", "", self.at
                return
            found = _TOKEN.match(self.text, self.at)
            if not found:
                raise ParseError(f"unexpected {self.text[self.at]!r}", self.text, self.at)
            self.start, self.at = self.at, found.end()
            if found.lastgroup != "space":
                self.kind, self.value = found.lastgroup, found[0]
                return

    def _fail(self, wanted: str):
        raise ParseError(f"expected {wanted}, found {self.value or 'the end'!r}", self.text, self.start)

    def _is(self, *values: str) -> bool:
        return self.kind in ("op", "name") and self.value in values

    def _take(self, *values: str) -> str | None:
        if self._is(*values):
            taken = self.value
            self._advance()
            return taken
        return None

    def _need(self, value: str) -> None:
        if not self._take(value):
            self._fail(repr(value))

    def program(self) -> A.Node:
        while self._take("def"):
            self._macro()
        if self.kind == "end":
            self._fail("a filter")
        found = self.sequence()
        if self.kind != "end":
            self._fail("the end")
        return found

    def _macro(self) -> None:
        name, params = self.value, []
        self._advance()
        if self._take("("):
            while not self._take(")"):
                params.append(self.value.lstrip("$"))
                self._advance()
                self._take(";", ",")
        self._need(":")
        body = self.sequence()
        self._need(";")
        self.macros[name, len(params)] = (params, body)

    def sequence(self) -> A.Node:
        items = [self.pipe()]
        while self._take(","):
            items.append(self.pipe())
        return items[0] if len(items) == 1 else A.Sequence(tuple(items))

    def pipe(self) -> A.Node:
        stages = [self.assign()]
        while self._take("|"):
            stages.append(self.assign())
        if len(stages) == 1:
            return stages[0]
        flat = [s for stage in stages for s in (stage.stages if isinstance(stage, A.Pipe) else (stage,))]
        return A.Pipe(tuple(flat))

    def assign(self) -> A.Node:
        target = self.either()
        if op := self._take("+=", "|="):
            return A.Assign(op, target, self.either())
        return target

    def _chain(self, ops: tuple[str, ...], below) -> A.Node:
        left = below()
        while op := self._take(*ops):
            left = A.Binary(op, left, below())
        return left

    def either(self) -> A.Node:
        return self._chain(("or",), self.both)

    def both(self) -> A.Node:
        return self._chain(("and",), self.comparison)

    def comparison(self) -> A.Node:
        left = self.total()
        if op := self._take("==", "!=", "<=", ">=", "<", ">"):
            left = A.Binary(op, left, self.total())
            if self._is("==", "!=", "<=", ">=", "<", ">"):
                self._fail("no second comparison")
        return left

    def total(self) -> A.Node:
        return self._chain(("+", "-"), self.product)

    def product(self) -> A.Node:
        return self._chain(("*", "/"), self.unary)

    def unary(self) -> A.Node:
        if self._take("not"):
            return A.Not(self.unary())
        if self._take("del"):
            return A.Delete(self.unary())
        if self._take("-"):
            operand = self.unary()
            if isinstance(operand, A.Literal) and isinstance(operand.value, (int, float)):
                return A.Literal(-operand.value)
            return A.Negate(operand)
        return self.postfix()

    def postfix(self) -> A.Node:
        node = self.primary()
        while True:
            if self._is("."):
                mark = self.text[self.at : self.at + 1]
                self._advance()
                if mark == "[" or self._is("["):
                    node = self._brackets(node)
                elif self.kind == "name":
                    node = A.Field(node, self.value)
                    self._advance()
                elif self.kind == "string":
                    node = A.Field(node, _string(self.value))
                    self._advance()
                else:
                    self._fail("a field name")
            elif self._is("["):
                node = self._brackets(node)
            else:
                return node

    def _brackets(self, base: A.Node) -> A.Node:
        self._need("[")
        if self._take("]"):
            return A.Iterate(base)
        start = None
        if not self._is(":"):
            start = self.pipe()
        if self._take(":"):
            stop = None if self._is("]") else self.pipe()
            self._need("]")
            return A.Slice(base, start, stop)
        self._need("]")
        if isinstance(start, A.Literal) and isinstance(start.value, str):
            return A.Field(base, start.value)
        return A.Index(base, start)

    def primary(self) -> A.Node:
        if self.kind == "number":
            value = self.value
            self._advance()
            return A.Literal(int(value) if value.isdigit() else float(value))
        if self.kind == "string":
            value = _string(self.value)
            self._advance()
            return A.Literal(value)
        if self.kind == "variable":
            name = self.value[1:]
            self._advance()
            return A.Variable(name)
        if self._take("("):
            found = self.sequence()
            self._need(")")
            return found
        if self._take("["):
            items: list[A.Node] = []
            while not self._take("]"):
                items.append(self.pipe())
                if not self._is("]"):
                    self._need(",")
            return A.Array(tuple(items))
        if self._take("{"):
            return self._object()
        if self._is("."):
            after = self.text[self.at : self.at + 1]
            self._advance()
            if after and (after.isalpha() or after in '_"') and self.kind in ("name", "string"):
                name = self.value if self.kind == "name" else _string(self.value)
                self._advance()
                return A.Field(A.Identity(), name)
            if after == "[":
                return self._brackets(A.Identity())
            return A.Identity()
        if self.kind == "name":
            return self._named()
        return self._fail("an expression")

    def _object(self) -> A.Node:
        entries: list[tuple[str, A.Node]] = []
        while not self._take("}"):
            if self.kind not in ("name", "string"):
                self._fail("a key")
            key = self.value if self.kind == "name" else _string(self.value)
            self._advance()
            entries.append((key, self.pipe() if self._take(":") else A.Field(A.Identity(), key)))
            if not self._is("}"):
                self._need(",")
        return A.Object(tuple(entries))

    def _named(self) -> A.Node:
        name = self.value
        constants = {"true": True, "false": False, "null": None}
        if name in constants:
            self._advance()
            return A.Literal(constants[name])
        if self._take("if"):
            condition = self.pipe()
            self._need("then")
            then = self.pipe()
            if self._take("else"):
                otherwise: A.Node = self.pipe()
            else:
                self._fail("'else'")
            self._need("end")
            return A.If(condition, then, otherwise)
        if self._take("try"):
            body = self.postfix()
            return A.Try(body, self.unary() if self._take("catch") else A.Literal(None))
        if name in KEYWORDS:
            self._fail("an expression")
        after = self.at
        self._advance()
        args: list[A.Node] = []
        if self._is("("):
            if name in FILE_JOINS and (path := _BARE_PATH.match(self.text, after + 1)):
                args.append(A.Path(path[1]))
                self.at = path.end()
                self._advance()
                self._take(";", ",")
            else:
                self._advance()
            while not self._take(")"):
                args.append(self.pipe())
                if not self._is(")") and not self._take(",", ";"):
                    self._fail("')'")
        if (name, len(args)) in self.macros:
            params, body = self.macros[name, len(args)]
            return _substitute(body, dict(zip(params, args, strict=True)))
        return A.Call(name, tuple(args))


def _substitute(node: A.Node, values: dict[str, A.Node]) -> A.Node:
    """``node`` with a macro's parameters put in."""
    if isinstance(node, A.Call) and not node.args and node.name in values:
        return values[node.name]
    if isinstance(node, A.Variable) and node.name in values:
        return values[node.name]

    def put(value):
        if isinstance(value, A.Node):
            return _substitute(value, values)
        if isinstance(value, tuple):
            return tuple(put(v) for v in value)
        return value

    return type(node)(**{k: put(v) for k, v in vars(node).items()})


@lru_cache(maxsize=1000)
def parse(text: str) -> A.Node:
    """The syntax tree of a filter; trees are cached by text."""
    return _Parser(text).program()
