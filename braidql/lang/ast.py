"""Syntax tree of a filter."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


class Node:
    """Any expression."""


@dataclass(frozen=True)
class Identity(Node):
    pass


@dataclass(frozen=True)
class Literal(Node):
    value: Any


@dataclass(frozen=True)
class Variable(Node):
    name: str


@dataclass(frozen=True)
class Field(Node):
    base: Node
    name: str


@dataclass(frozen=True)
class Index(Node):
    base: Node
    index: Node


@dataclass(frozen=True)
class Slice(Node):
    base: Node
    start: Node | None
    stop: Node | None


@dataclass(frozen=True)
class Iterate(Node):
    base: Node


@dataclass(frozen=True)
class Call(Node):
    name: str
    args: tuple[Node, ...] = ()


@dataclass(frozen=True)
class Binary(Node):
    op: str
    left: Node
    right: Node


@dataclass(frozen=True)
class Not(Node):
    operand: Node


@dataclass(frozen=True)
class Negate(Node):
    operand: Node


@dataclass(frozen=True)
class Delete(Node):
    target: Node


@dataclass(frozen=True)
class If(Node):
    condition: Node
    then: Node
    otherwise: Node


@dataclass(frozen=True)
class Try(Node):
    body: Node
    fallback: Node


@dataclass(frozen=True)
class Pipe(Node):
    stages: tuple[Node, ...]


@dataclass(frozen=True)
class Sequence(Node):
    items: tuple[Node, ...]


@dataclass(frozen=True)
class Object(Node):
    entries: tuple[tuple[str, Node], ...]


@dataclass(frozen=True)
class Array(Node):
    items: tuple[Node, ...]


@dataclass(frozen=True)
class Assign(Node):
    op: str
    target: Node
    value: Node


@dataclass(frozen=True)
class Path(Node):
    """A file named without quotes, as the first argument of a join."""

    path: str = field(default="")


def children(node: Node) -> list[Node]:
    """Direct sub-expressions."""
    found: list[Node] = []
    for value in vars(node).values():
        for item in value if isinstance(value, tuple) else (value,):
            if isinstance(item, Node):
                found.append(item)
            elif isinstance(item, tuple):
                found += [x for x in item if isinstance(x, Node)]
    return found
