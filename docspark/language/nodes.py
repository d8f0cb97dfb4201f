"""The syntax tree."""

from __future__ import annotations

from dataclasses import dataclass, field


class Node:
    """An expression."""


@dataclass(frozen=True)
class Lit(Node):
    value: object  # None, bool, int, float, str, or what extended JSON gives


@dataclass(frozen=True)
class Param(Node):
    name: str


@dataclass(frozen=True)
class Member:
    name: str


@dataclass(frozen=True)
class At:
    index: Node


@dataclass(frozen=True)
class Every:
    pass


@dataclass(frozen=True)
class Where:
    condition: Node


@dataclass(frozen=True)
class Path(Node):
    scope: str  # $, @ or *
    steps: tuple = ()


@dataclass(frozen=True)
class Binary(Node):
    op: str
    left: Node
    right: Node


@dataclass(frozen=True)
class Quantified(Node):
    quantifier: str  # ANY or ALL
    op: str
    left: Node
    right: Node


@dataclass(frozen=True)
class Call(Node):
    name: str
    args: tuple


@dataclass(frozen=True)
class Lambda(Node):
    name: str  # MAP, FILTER or SORT
    source: Node
    body: Node
    order: Node | None = None


@dataclass(frozen=True)
class Document(Node):
    fields: tuple  # of (name, node)


@dataclass(frozen=True)
class Array(Node):
    items: tuple


@dataclass(frozen=True)
class Follow(Node):
    """A path that goes on from the value of an expression."""

    base: Node
    steps: tuple


@dataclass(frozen=True)
class Group(Node):
    """An expression in parentheses."""

    inner: Node


@dataclass(frozen=True)
class Projection:
    """What SELECT gives: one document, or named values."""

    fields: tuple  # of (alias, node)
    document: Node | None = None


@dataclass
class Select:
    projection: Projection
    source: str | None = None
    options: object = None
    includes: list = field(default_factory=list)
    where: list = field(default_factory=list)
    group_by: Node | None = None
    having: Node | None = None
    order_by: Node | None = None
    descending: bool = False
    limit: int | None = None
    offset: int = 0
    for_update: bool = False
    into: str | None = None
    into_options: object = None
    auto_id: str = "OBJECTID"
    explain: bool = False


@dataclass
class Insert:
    collection: str
    documents: list
    auto_id: str = "OBJECTID"


@dataclass
class Update:
    collection: str
    document: Node
    where: Node | None = None


@dataclass
class Delete:
    collection: str
    where: Node | None = None


@dataclass
class CreateIndex:
    name: str
    collection: str
    expression: Node
    text: str
    unique: bool = False


@dataclass
class DropIndex:
    collection: str
    name: str


@dataclass
class DropCollection:
    name: str


@dataclass
class RenameCollection:
    name: str
    to: str


@dataclass
class Pragma:
    name: str
    value: object = None
    assign: bool = False


@dataclass
class Command:
    """BEGIN, COMMIT, ROLLBACK, CHECKPOINT or REBUILD."""

    name: str
    options: object = None


def fields_of(node: object, own: bool = True) -> list[str]:
    """Root fields that an expression reads, in order; ``$`` stands for the whole document."""
    found: dict[str, None] = {}

    def walk(x: object, source: bool) -> None:
        if isinstance(x, Path):
            if x.scope == "$" or (x.scope == "*") or (x.scope == "@" and source):
                first = x.steps[0].name if x.steps and isinstance(x.steps[0], Member) else "$"
                found.setdefault(first)
            for s in x.steps:
                walk(s, False)
        elif isinstance(x, Lambda):
            # the source of MAP over * is the whole document, unless the body says which fields
            if isinstance(x.source, Path) and x.source.scope == "*" and not x.source.steps:
                found.setdefault("$")
                walk(x.body, False)
            else:
                walk(x.source, source)
                walk(x.body, False)
            if x.order is not None:
                walk(x.order, False)
        elif isinstance(x, (Member, Every, Lit, Param)):
            pass
        elif isinstance(x, At):
            walk(x.index, source)
        elif isinstance(x, Where):
            walk(x.condition, False)
        elif isinstance(x, (Binary, Quantified)):
            walk(x.left, source)
            walk(x.right, source)
        elif isinstance(x, Call):
            for a in x.args:
                walk(a, source)
        elif isinstance(x, Document):
            for _, v in x.fields:
                walk(v, source)
        elif isinstance(x, Array):
            for v in x.items:
                walk(v, source)
        elif isinstance(x, Group):
            walk(x.inner, source)
        elif isinstance(x, Follow):
            walk(x.base, source)
            for s in x.steps:
                walk(s, False)

    walk(node, False)
    return list(found)


def uses_source(node: object) -> bool:
    """Whether ``*`` occurs in an expression."""
    if isinstance(node, Path):
        return node.scope == "*" or any(uses_source(s) for s in node.steps)
    if isinstance(node, At):
        return uses_source(node.index)
    if isinstance(node, Where):
        return uses_source(node.condition)
    if isinstance(node, (Binary, Quantified)):
        return uses_source(node.left) or uses_source(node.right)
    if isinstance(node, Call):
        return any(map(uses_source, node.args))
    if isinstance(node, Lambda):
        return uses_source(node.source) or uses_source(node.body)
    if isinstance(node, Document):
        return any(uses_source(v) for _, v in node.fields)
    if isinstance(node, Array):
        return any(map(uses_source, node.items))
    if isinstance(node, Group):
        return uses_source(node.inner)
    if isinstance(node, Follow):
        return uses_source(node.base) or any(map(uses_source, node.steps))
    return False


def default_name(node: Node) -> str:
    return "_".join(f for f in fields_of(node) if f != "$") or "expr"
