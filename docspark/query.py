"""Queries built by calls, and predicates built from fields.

``F``-like field objects build the same tree as the parser: ``doc.age >= 18`` is
``$.age >= 18``.  Strings are parsed, with positional arguments as @0, @1 and so on.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import replace

from pyspark.sql import DataFrame

from .language import nodes as N
from .language.parser import parse_expression, parse_projection
from .plans.values import AnalysisError


class Expr:
    """An expression built with Python's operators."""

    def __init__(self, node: N.Node):
        object.__setattr__(self, "node", node)

    def __getattr__(self, name: str) -> Expr:
        if name.startswith("__"):
            raise AttributeError(name)
        return self[name]

    def __getitem__(self, k: object) -> Expr:
        node = self.node
        if isinstance(k, str):
            step: object = N.Member(k)
        elif isinstance(k, int) and not isinstance(k, bool):
            step = N.At(N.Lit(k))
        elif k is Ellipsis or k == slice(None):
            step = N.Every()
        else:
            step = N.Where(as_node(k))
        if isinstance(node, N.Path):
            return Expr(N.Path(node.scope, (*node.steps, step)))
        return Expr(N.Lambda("MAP", node, N.Path("@", (step,))))

    def _with(self, op: str, other: object, swap: bool = False) -> Expr:
        a, b = group(self.node), group(as_value(other))
        return Expr(N.Binary(op, b, a) if swap else N.Binary(op, a, b))

    def __add__(self, o: object) -> Expr:
        return self._with("+", o)

    def __radd__(self, o: object) -> Expr:
        return self._with("+", o, True)

    def __sub__(self, o: object) -> Expr:
        return self._with("-", o)

    def __rsub__(self, o: object) -> Expr:
        return self._with("-", o, True)

    def __mul__(self, o: object) -> Expr:
        return self._with("*", o)

    def __rmul__(self, o: object) -> Expr:
        return self._with("*", o, True)

    def __truediv__(self, o: object) -> Expr:
        return self._with("/", o)

    def __rtruediv__(self, o: object) -> Expr:
        return self._with("/", o, True)

    def __mod__(self, o: object) -> Expr:
        return self._with("%", o)

    def __eq__(self, o: object) -> Expr:  # type: ignore[override]
        return self._with("=", o)

    def __ne__(self, o: object) -> Expr:  # type: ignore[override]
        return self._with("!=", o)

    def __lt__(self, o: object) -> Expr:
        return self._with("<", o)

    def __le__(self, o: object) -> Expr:
        return self._with("<=", o)

    def __gt__(self, o: object) -> Expr:
        return self._with(">", o)

    def __ge__(self, o: object) -> Expr:
        return self._with(">=", o)

    def __and__(self, o: object) -> Expr:
        return self._with("AND", o)

    def __or__(self, o: object) -> Expr:
        return self._with("OR", o)

    def __invert__(self) -> Expr:
        return self._with("=", False)

    __hash__ = object.__hash__

    def like(self, pattern: object) -> Expr:
        """``%`` and ``_`` in the pattern stand for others; startswith, endswith and contains don't take them otherwise either."""
        return self._with("LIKE", pattern)

    def between(self, low: object, high: object) -> Expr:
        return Expr(N.Binary("BETWEEN", group(self.node), N.Array((as_value(low), as_value(high)))))

    def isin(self, values: Iterable) -> Expr:
        return Expr(N.Binary("IN", group(self.node), N.Array(tuple(as_value(v) for v in values))))

    def startswith(self, s: str) -> Expr:
        return self.like(f"{s}%")

    def endswith(self, s: str) -> Expr:
        return self.like(f"%{s}")

    def contains(self, s: str) -> Expr:
        return self.like(f"%{s}%")

    def any(self, op: str, value: object) -> Expr:
        return Expr(N.Quantified("ANY", op.upper(), self.node, as_value(value)))

    def all(self, op: str, value: object) -> Expr:
        return Expr(N.Quantified("ALL", op.upper(), self.node, as_value(value)))

    def map(self, body: Callable[[Expr], object]) -> Expr:
        return Expr(N.Lambda("MAP", self.node, as_value(body(Expr(N.Path("@"))))))

    def filter(self, body: Callable[[Expr], object]) -> Expr:
        return Expr(N.Lambda("FILTER", self.node, as_value(body(Expr(N.Path("@"))))))

    def sort(self, body: Callable[[Expr], object], descending: bool = False) -> Expr:
        return Expr(N.Lambda("SORT", self.node, as_value(body(Expr(N.Path("@")))), N.Lit(-1 if descending else 1)))

    def call(self, name: str, *args: object) -> Expr:
        """A function of the language with this as its first argument."""
        return Expr(N.Call(name.upper(), (self.node, *map(as_value, args))))

    @property
    def as_text(self) -> Methods:
        """Methods of strings: ``doc.name.as_text.upper()``."""
        return Methods(self, _TEXT)

    @property
    def as_date(self) -> Methods:
        """Methods of dates: ``doc.born.as_date.year()``."""
        return Methods(self, _DATE)

    @property
    def as_items(self) -> Methods:
        """Methods of sequences: ``doc.tags.as_items.first()``."""
        return Methods(self, _ITEMS)

    @property
    def as_number(self) -> Methods:
        """Methods of numbers: ``doc.size.as_number.abs()``."""
        return Methods(self, _NUMBER)

    @property
    def convert(self) -> Methods:
        """Conversions and tests of types: ``doc.size.convert.string()``."""
        return Methods(self, _TO)

    def __iter__(self) -> object:
        raise TypeError("an expression can't be iterated over")

    def __bool__(self) -> bool:
        raise TypeError("use & and | for AND and OR")


def _calls(**names: str) -> dict[str, Callable]:
    return {k: (lambda e, *args, f=f: e.call(f, *args)) for k, f in names.items()}


def _part(e: Expr, name: str, n: object) -> Expr:
    return fn("DATEADD", name, n, e)


_TEXT: dict[str, Callable] = _calls(
    upper="UPPER", lower="LOWER", trim="TRIM", trim_start="LTRIM", trim_end="RTRIM", length="LENGTH", index_of="INDEXOF", substring="SUBSTRING", replace="REPLACE", pad_left="LPAD", pad_right="RPAD",
    split="SPLIT", format="FORMAT", is_match="IS_MATCH", match="MATCH",
) | {
    "starts_with": Expr.startswith, "ends_with": Expr.endswith, "contains": Expr.contains, "equals": Expr.__eq__, "is_empty": lambda e: e.call("LENGTH") == 0, "char_at": lambda e, k: e.call("SUBSTRING", k, 1),
    "join": lambda e, items: fn("JOIN", items, e), "concat": lambda e, *args: _sum([e, *args]),
}
_DATE: dict[str, Callable] = _calls(year="YEAR", month="MONTH", day="DAY", hour="HOUR", minute="MINUTE", second="SECOND", to_local="TO_LOCAL", to_utc="TO_UTC", format="FORMAT") | {
    f"add_{k}s": (lambda e, n, k=k: _part(e, k, n)) for k in ("year", "month", "day", "hour", "minute", "second")
} | {"date": lambda e: fn("DATETIME", e.call("YEAR"), e.call("MONTH"), e.call("DAY")), "diff": lambda e, part, other: fn("DATEDIFF", part, e, other)}
_ITEMS: dict[str, Callable] = _calls(first="FIRST", last="LAST", count="COUNT", sum="SUM", average="AVG", min="MIN", max="MAX", to_array="ARRAY", distinct="DISTINCT", take="TOP", union="UNION", except_="EXCEPT", concat="CONCAT", join="JOIN") | {
    "any": lambda e, body=None: (e if body is None else e.filter(body)).call("ANY"), "all": lambda e, body: e.call("COUNT") == e.filter(body).call("COUNT"), "contains": lambda e, x: e.any("=", x),
    "element_at": lambda e, k: e[k], "where": Expr.filter, "select": Expr.map, "order_by": Expr.sort, "order_by_descending": lambda e, body: e.sort(body, True),
}
_NUMBER: dict[str, Callable] = _calls(abs="ABS", round="ROUND", pow="POW", format="FORMAT")
_TO: dict[str, Callable] = _calls(
    string="STRING", int32="INT32", int64="INT64", double="DOUBLE", decimal="DECIMAL", boolean="BOOLEAN", datetime="DATETIME", datetime_utc="DATETIME_UTC", binary="BINARY", guid="GUID", object_id="OBJECTID",
    creation_time="OID_CREATIONTIME", is_null="IS_NULL", is_string="IS_STRING", is_int32="IS_INT32", is_int64="IS_INT64", is_double="IS_DOUBLE", is_decimal="IS_DECIMAL", is_number="IS_NUMBER", is_boolean="IS_BOOLEAN",
    is_datetime="IS_DATETIME", is_array="IS_ARRAY", is_document="IS_DOCUMENT", is_binary="IS_BINARY", is_guid="IS_GUID", is_object_id="IS_OBJECTID", or_else="COALESCE", keys="KEYS", values="VALUES",
) | {"has_value": lambda e: e != None, "get": lambda e, name: e[name]}  # noqa: E711  fmt: skip


def _sum(terms: list) -> Expr:
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


class Methods:
    """Named methods of an expression, of one kind; each gives another expression."""

    def __init__(self, expr: Expr, table: dict[str, Callable]):
        self._expr, self._table = expr, table

    def __getattr__(self, name: str) -> Callable[..., Expr]:
        if name not in self._table:
            raise AttributeError(f"no method {name}; there are {', '.join(sorted(self._table))}")
        return lambda *args: self._table[name](self._expr, *args)

    def __dir__(self) -> list[str]:
        return sorted(self._table)


#: The document of a row, and all rows: ``doc.a``, ``rows.a``.
doc, rows = Expr(N.Path("$")), Expr(N.Path("*"))


def fn(name: str, *args: object) -> Expr:
    return Expr(N.Call(name.upper(), tuple(map(as_value, args))))


def param(name: object) -> Expr:
    return Expr(N.Param(str(name)))


def group(node: N.Node) -> N.Node:
    return N.Group(node) if isinstance(node, N.Binary) else node


def as_value(x: object) -> N.Node:
    if isinstance(x, Expr):
        return x.node
    if isinstance(x, N.Node):
        return x
    if isinstance(x, dict):
        return N.Document(tuple((k, as_value(v)) for k, v in x.items()))
    if isinstance(x, (list, tuple)):
        return N.Array(tuple(map(as_value, x)))
    return N.Lit(x)


def as_node(x: object) -> N.Node:
    """A text, a builder's expression, or a tree, as a tree."""
    return parse_expression(x) if isinstance(x, str) else as_value(x)


class Where:
    """Predicates from a field's name and values."""

    @staticmethod
    def _field(name: str) -> Expr:
        return Expr(parse_expression(name))

    @classmethod
    def eq(cls, name: str, v: object) -> Expr:
        return cls._field(name) == v

    @classmethod
    def lt(cls, name: str, v: object) -> Expr:
        return cls._field(name) < v

    @classmethod
    def lte(cls, name: str, v: object) -> Expr:
        return cls._field(name) <= v

    @classmethod
    def gt(cls, name: str, v: object) -> Expr:
        return cls._field(name) > v

    @classmethod
    def gte(cls, name: str, v: object) -> Expr:
        return cls._field(name) >= v

    @classmethod
    def between(cls, name: str, low: object, high: object) -> Expr:
        return cls._field(name).between(low, high)

    @classmethod
    def starts_with(cls, name: str, s: str) -> Expr:
        return cls._field(name).startswith(s)

    @classmethod
    def contains(cls, name: str, s: str) -> Expr:
        return cls._field(name).contains(s)

    @classmethod
    def not_(cls, name: str, v: object) -> Expr:
        return cls._field(name) != v

    @classmethod
    def in_(cls, name: str, values: Iterable) -> Expr:
        return cls._field(name).isin(values)

    @staticmethod
    def and_(*terms: Expr) -> Expr:
        out = terms[0]
        for t in terms[1:]:
            out = out & t
        return out

    @staticmethod
    def or_(*terms: Expr) -> Expr:
        out = terms[0]
        for t in terms[1:]:
            out = out | t
        return out

    @classmethod
    def any(cls, name: str, op: str, v: object) -> Expr:
        """Some element of an array field: ``Where.any("phones", "=", 5)``."""
        return cls._field(name).any(op, v)


class Query:
    """A query over one collection; every call gives a new one."""

    def __init__(self, db: object, source: str, select: N.Select | None = None, params: dict | None = None):
        self._db, self._params = db, params or {}
        self._q = select or N.Select(N.Projection((("expr", N.Path("$")),), N.Path("$")), source)

    def _with(self, params: dict | None = None, **changes: object) -> Query:
        return Query(self._db, self._q.source, replace(self._q, **changes), self._params | (params or {}))

    def _renamed(self, node: N.Node, text: object, args: tuple, params: dict) -> tuple[N.Node, dict]:
        """Positional parameters under names of their own, so that several calls don't clash."""
        if not args:
            return node, params
        base = len(self._params)
        fresh = {str(k): f"p{base + k}" for k in range(len(args))}
        if isinstance(text, str):
            pattern = re.compile(r"'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\"|@(\d+)")
            node = parse_expression(pattern.sub(lambda m: f"@{fresh.get(m[1], m[1])}" if m[1] else m[0], text))
        return node, params | {fresh[str(k)]: v for k, v in enumerate(args)}

    def include(self, *paths: object) -> Query:
        return self._with(includes=[*self._q.includes, *map(as_node, paths)])

    def where(self, predicate: object, *args: object, **params: object) -> Query:
        node, more = self._renamed(as_node(predicate), predicate, args, params)
        return self._with(more, where=[*self._q.where, node])

    def order_by(self, expression: object, descending: bool = False) -> Query:
        if self._q.order_by is not None:
            raise AnalysisError("a query has one ORDER BY")
        return self._with(order_by=as_node(expression), descending=descending)

    def order_by_descending(self, expression: object) -> Query:
        return self.order_by(expression, True)

    def group_by(self, expression: object) -> Query:
        if self._q.group_by is not None:
            raise AnalysisError("a query has one GROUP BY")
        return self._with(group_by=as_node(expression))

    def having(self, predicate: object, *args: object, **params: object) -> Query:
        node, more = self._renamed(as_node(predicate), predicate, args, params)
        return self._with(more, having=node)

    def select(self, *expressions: object, **named: object) -> Query:
        if len(expressions) == 1 and isinstance(expressions[0], str) and not named:
            return self._with(projection=parse_projection(expressions[0]))
        if len(expressions) == 1 and not named:
            node = as_node(expressions[0])
            return self._with(projection=N.Projection(((N.default_name(node), node),), node if isinstance(node, N.Document) or node == N.Path("$") else None))
        fields = [(N.default_name(n := as_node(e)), n) for e in expressions] + [(k, as_node(v)) for k, v in named.items()]
        return self._with(projection=N.Projection(tuple(fields)))

    def offset(self, n: int) -> Query:
        return self._with(offset=n)

    skip = offset

    def limit(self, n: int) -> Query:
        return self._with(limit=n)

    def for_update(self) -> Query:
        return self._with(for_update=True)

    # results
    def to_df(self) -> DataFrame:
        return self._db.planner(self._params).select(self._q)

    def collect(self) -> list:
        return self.to_df().collect()

    to_list = to_documents = collect

    def values(self) -> list:
        """The first field of every row."""
        return [r[0] for r in self.collect()]

    def explain(self) -> dict:
        from .database import explain

        return explain(self._db.planner(self._params), self._q)

    get_plan = explain

    def first_or_default(self) -> object:
        return self.limit(1).to_df().first()

    def first(self) -> object:
        row = self.first_or_default()
        if row is None:
            raise LookupError("no document")
        return row

    def single_or_default(self) -> object:
        found = self.limit(2).collect()
        if len(found) > 1:
            raise LookupError("more than one document")
        return found[0] if found else None

    def single(self) -> object:
        row = self.single_or_default()
        if row is None:
            raise LookupError("no document")
        return row

    def _aggregate(self, text: str) -> object:
        if self._q.group_by is not None:
            return self.to_df().count() if text.startswith("COUNT") else bool(self.to_df().limit(1).count())
        return self._with(projection=parse_projection(text)).to_df().first()[0]

    def count(self) -> int:
        return self._aggregate("COUNT(*)")

    long_count = count

    def exists(self) -> bool:
        return self._aggregate("ANY(*)")

    def into(self, collection: str, auto_id: str = "OBJECTID", options: object = None) -> int:
        return self._db.store(collection, options, self.to_df(), auto_id)
