"""Expressions to typed Columns."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import lookup
from ..language.nodes import Array, At, Binary, Call, Document, Every, Follow, Group, Lambda, Lit, Member, Node, Param, Path, Quantified, Where
from .values import (
    AnalysisError, Val, array, as_many, as_one, between, boolean, collect, common, compare, contained, document, equal, is_array, is_date, is_null, is_number, is_string, like,
    literal, null, simple, text, to_type,
)

COMPARE = (">", ">=", "<", "<=")


@dataclass
class Context:
    """What names mean at a place of an expression."""

    root: Val | None = None  # the document of the row; None where it isn't to be read
    current: Val | None = None
    rows: Val | None = None  # * as a sequence over rows
    params: dict[str, Val] = field(default_factory=dict)
    collation: str | None = None
    for_filter: bool = False  # null may stand for false
    grouped: bool = False


def root_of(df: DataFrame) -> Val:
    """The whole document of a row, with its columns as parts."""
    parts = {f.name: Val(F.col(f"`{f.name}`"), simple(f.dataType), nullable=f.nullable) for f in df.schema.fields}
    t = T.StructType([T.StructField(f.name, f.dataType, f.nullable) for f in df.schema.fields])
    return Val(F.struct(*[v.col for v in parts.values()]) if parts else F.struct(F.lit(None).alias("_")), t, parts=parts, nullable=False)


def member(v: Val, name: str) -> Val:
    """A field of a document, whatever its letters' case; null where there is none."""
    if v.parts is not None:
        for k, x in v.parts.items():
            if k.lower() == name.lower():
                return x.but(aggregated=x.aggregated or v.aggregated)
        return null().but(aggregated=v.aggregated)
    if isinstance(v.type, T.StructType):
        for f in v.type.fields:
            if f.name.lower() == name.lower():
                return Val(v.col.getField(f.name), simple(f.dataType), aggregated=v.aggregated)
    if isinstance(v.type, T.MapType):
        return Val(F.try_element_at(v.col, F.lit(name)), simple(v.type.valueType), aggregated=v.aggregated)
    if isinstance(v.type, T.VariantType):
        quoted = name.replace("'", "\\'")
        return Val(F.try_variant_get(v.col, f"$['{quoted}']", "variant"), T.VariantType(), aggregated=v.aggregated)
    return null().but(aggregated=v.aggregated)


def plain(v: Val) -> Val:
    """A variant as a number where it is one, else as text, so that it can be computed with."""
    if isinstance(v.type, T.VariantType):
        # SQL has one type a column: numbers are the usual case in arithmetic
        return v.but(col=F.try_variant_get(v.col, "$", "double"), type=T.DoubleType())
    return v


class Compiler:
    def __init__(self, context: Context):
        self.context = context

    def at(self, **changes: object) -> Compiler:
        return Compiler(replace(self.context, **changes))

    def __call__(self, node: Node) -> Val:
        return getattr(self, "do_" + type(node).__name__.lower())(node)

    def one(self, node: Node) -> Val:
        return as_one(self(node))

    # leaves
    def do_lit(self, node: Lit) -> Val:
        return literal(node.value)

    def do_param(self, node: Param) -> Val:
        return self.context.params.get(node.name.lower(), null())

    def do_group(self, node: Group) -> Val:
        return self(node.inner)

    def do_document(self, node: Document) -> Val:
        inner = self.at(for_filter=False)
        fields = {k: inner.one(v) for k, v in node.fields}
        if len(fields) == 1:
            from ..language.parser import decode

            (k, v), = fields.items()
            if k.startswith("$") and isinstance(v.constant, str) and (got := decode({k: v.constant})) != {k: v.constant}:
                return literal(got)
        return document(fields)

    def do_array(self, node: Array) -> Val:
        inner = self.at(for_filter=False)
        return array([inner(x) for x in node.items])

    # paths
    def do_path(self, node: Path) -> Val:
        c = self.context
        if node.scope == "*":
            if c.rows is None:
                raise AnalysisError("* can't be used here")
            return self.over_rows(c.rows, node.steps)
        v = c.current if node.scope == "@" else c.root
        if v is None:
            raise AnalysisError("fields of the document can't be read here: use an aggregate over *" if c.grouped or c.rows is not None else f"{node.scope} can't be used here")
        return self.walk(v, node.steps)

    def do_follow(self, node: Follow) -> Val:
        v = self(node.base)
        return self.map_rows(v, lambda e: self.walk(e, node.steps)) if v.kind == "rows" else self.map(v, lambda e: self.walk(e, node.steps)) if v.kind == "many" else self.walk(v, node.steps)

    def walk(self, v: Val, steps: tuple) -> Val:
        for k, step in enumerate(steps):
            if v.kind == "many":  # what follows is for each element
                return self.map(v, lambda e, rest=steps[k:]: self.walk(e, rest))
            v = self.step(v, step)
        return v

    def step(self, v: Val, step: object) -> Val:
        if isinstance(step, Member):
            return member(v, step.name)
        if isinstance(step, Every):
            return as_many(v) if is_array(v.type) else as_many(Val(F.array().cast(T.ArrayType(T.StringType())), T.ArrayType(T.StringType()), nullable=False))
        if isinstance(step, At):
            return self.element(v, self.one(step.index))
        if isinstance(step, Where):
            if not is_array(v.type):
                return Val(F.array().cast(T.ArrayType(T.StringType())), T.StringType(), "many", nullable=False)
            return self.filter(as_many(v), step.condition)
        raise AnalysisError(f"unknown step {step}")

    def element(self, v: Val, index: Val) -> Val:
        if isinstance(v.type, T.VariantType) and isinstance(index.constant, int) and index.constant >= 0:
            return Val(F.try_variant_get(v.col, f"$[{index.constant}]", "variant"), T.VariantType())
        if not is_array(v.type) or not is_number(index.type):
            return null()
        k = index.col.cast("int")
        if isinstance(index.constant, int):
            place = F.lit(index.constant + 1 if index.constant >= 0 else index.constant)
        else:
            place = F.when(k >= 0, k + 1).otherwise(k)
        return Val(F.try_element_at(v.col, place), v.type.elementType, aggregated=v.aggregated)

    def over_rows(self, v: Val, steps: tuple) -> Val:
        """A path after *: for each row, or each element of a row's sequence."""
        for k, step in enumerate(steps):
            if k == 0 and isinstance(step, Every):
                continue
            if k == 0 and isinstance(step, At):  # *[0]: of the collected source
                got = self.element(as_one(collect(v)), self.one(step.index))
                return self.walk(got, steps[1:])
            if k == 0 and isinstance(step, Where):
                v = self.filter(v, step.condition)
                continue
            return self.map_rows(v, lambda e, rest=steps[k:]: self.walk(e, rest))
        return v

    def map_rows(self, v: Val, body: object) -> Val:
        if v.flat:
            inner = self.map(Val(v.col, v.type, "many"), body)
            return v.but(col=inner.col, type=inner.type, nullable=True, parts=None)
        out = body(Val(v.col, v.type, parts=v.parts, nullable=v.nullable))
        if out.kind == "many":
            return v.but(col=out.col, type=out.type, flat=True, parts=None)
        return v.but(col=out.col, type=out.type, parts=out.parts, nullable=out.nullable, constant=out.constant)

    def map(self, v: Val, body: object) -> Val:
        """``body`` for each element; sequences that it gives are joined end to end."""
        got: list[Val] = []

        def each(x: Column) -> Column:
            out = body(Val(x, v.type))
            got.append(out)
            return out.col

        col = F.transform(v.col, each)
        out = got[0]
        if is_null(out.type) and out.kind == "one":
            return v.but(col=col, type=out.type, constant=...)
        return v.but(col=F.flatten(col) if out.kind == "many" else col, type=out.type, parts=None, constant=..., nullable=True)

    def filter(self, v: Val, condition: Node) -> Val:
        if v.kind == "rows" and not v.flat:
            test = self.at(current=Val(v.col, v.type, parts=v.parts, nullable=v.nullable)).truth(condition)
            return v.but(where=test if v.where is None else v.where & test)
        inner = lambda x: self.at(current=Val(x, v.type), for_filter=True).truth(condition)
        return v.but(col=F.filter(v.col, inner), constant=...)

    def truth(self, node: Node) -> Column:
        v = self.one(node)
        if not isinstance(v.type, T.BooleanType):
            return F.lit(False)
        return F.coalesce(v.col, F.lit(False)) if v.nullable and not self.context.for_filter else v.col

    # lambdas
    def do_lambda(self, node: Lambda) -> Val:
        inner = self.at(for_filter=False)
        v = as_many(inner(node.source))
        if node.name == "FILTER":
            return inner.filter(v, node.body)
        body = lambda e: inner.at(current=e)(node.body)
        if node.name == "MAP":
            return inner.map_rows(v, body) if v.kind == "rows" else inner.map(v, body)
        if v.kind == "rows":
            v = collect(v)
        order = inner.one(node.order) if node.order is not None else literal(1)
        c = order.constant
        descending = not (c == 1 or (isinstance(c, str) and c.lower() == "asc"))
        key_of = lambda x: as_one(body(Val(x, v.type)))
        if is_null(key_of(F.lit(None).cast(v.type)).type):
            return v
        # the place of an element keeps equal keys in their order
        keyed = F.transform(v.col, lambda x, i: F.struct(key_of(x).col.alias("k"), (-i if descending else i).alias("i"), x.alias("v")))
        return v.but(col=F.transform(F.sort_array(keyed, asc=not descending), lambda s: s["v"]), constant=...)

    # calls
    def do_call(self, node: Call) -> Val:
        f = lookup(node.name, len(node.args))
        inner = self.at(for_filter=False)
        args = []
        for k, a in enumerate(node.args):
            v = inner(a)
            if k in f.sequences:
                v = as_many(v)
                if v.kind == "rows" and not f.over_rows:
                    v = collect(v)
            elif f.name != "ITEMS" or v.kind == "one":
                v = as_one(v)
            args.append(v)
        if not f.sequences and f.name in ("INT32", "INT64", "INT", "LONG", "DOUBLE", "DECIMAL", "ABS", "ROUND", "POW"):
            args = [plain(v) for v in args]
        out = f.run(self.context, *args)
        return out.but(aggregated=out.aggregated or any(a.aggregated for a in args))

    # operators
    def do_binary(self, node: Binary) -> Val:
        op = node.op
        if op in ("AND", "OR"):
            a, b = self.one(node.left), self.one(node.right)
            for v in (a, b):
                if not isinstance(v.type, (T.BooleanType, T.NullType)):
                    raise AnalysisError(f"{op} needs booleans")
            x, y = (F.lit(False) if is_null(v.type) else v.col if not v.nullable or self.context.for_filter else F.coalesce(v.col, F.lit(False)) for v in (a, b))
            return boolean(x & y if op == "AND" else x | y, a, b)
        inner = self.at(for_filter=False)
        a, b = inner.one(node.left), inner.one(node.right)
        if op in ("+", "-", "*", "/", "%"):
            return arithmetic(op, plain(a), plain(b))
        return self.relation(op, a, b)

    def relation(self, op: str, a: Val, b: Val) -> Val:
        c, f = self.context.collation, self.context.for_filter
        for v, w in ((a, b), (b, a)):
            if isinstance(v.type, T.VariantType) and not isinstance(w.type, T.VariantType) and op != "IN":
                t = simple(w.type) if not is_array(w.type) and not is_null(w.type) else T.StringType()
                v.col, v.type = F.try_variant_get(v.col, "$", t.simpleString()), t
        if op == "=":
            return equal(a, b, c, f)
        if op == "!=":
            v = equal(a, b, c)
            return literal(not v.constant) if isinstance(v.constant, bool) else boolean(~v.col, v)
        if op in COMPARE:
            return compare(op, a, b, None, f)
        if op == "LIKE":
            return like(a, b, c)
        if op == "IN":
            return contained(a, b, c, f)
        if op == "BETWEEN":
            t = b.type.elementType
            low, high = (literal(x) for x in b.constant) if isinstance(b.constant, list) else (Val(F.get(b.col, F.lit(k)), t) for k in (0, 1))
            return between(a, low, high, c, f)
        raise AnalysisError(f"unknown operator {op}")

    def do_quantified(self, node: Quantified) -> Val:
        inner = self.at(for_filter=False)
        right = inner.one(node.right)
        left = inner(node.left)
        if node.quantifier == "ANY" and node.op == "=" and left.kind == "one" and isinstance(left.constant, list) and right.constant is ...:
            return self.relation("IN", right, left)  # a constant list: membership, which files can filter by
        left = as_many(left)
        if left.kind == "rows":
            left = collect(left)
        test = lambda e: inner.relation(node.op, Val(e, left.type), right).col
        out = F.exists(left.col, test) if node.quantifier == "ANY" else F.forall(left.col, test)
        return boolean(F.coalesce(out, F.lit(node.quantifier == "ALL")), left, right)


def arithmetic(op: str, a: Val, b: Val) -> Val:
    both = (a, b)
    agg = a.aggregated or b.aggregated
    if op == "+" and (is_string(a.type) or is_string(b.type)):
        return Val(F.concat(text(a), text(b)), T.StringType(), nullable=False, aggregated=agg)
    dates = [is_date(v.type) for v in both]
    if op in "+-" and any(dates) and not all(dates):
        d, n = both if dates[0] else (b, a)
        if not is_number(n.type):
            return null(T.TimestampType())
        micros = F.call_function("div", n.col.cast("long"), F.lit(10)) if False else F.floor(n.col / 10)
        moved = F.timestamp_micros(F.unix_micros(d.col.cast("timestamp")) + (micros if op == "+" else -micros).cast("long"))
        return Val(moved, T.TimestampType(), aggregated=agg)
    if not all(is_number(v.type) for v in both):
        return null().but(aggregated=agg)
    t = common([a.type, b.type])
    nullable = a.nullable or b.nullable
    if op == "/":
        if isinstance(t, T.DecimalType):
            return Val(F.try_divide(a.col.cast(t), b.col.cast(t)).cast(t), t, aggregated=agg)
        x, y = a.col.cast("double"), b.col.cast("double")
        if b.constant not in (..., None, 0):
            return Val(x / y, T.DoubleType(), nullable=nullable, aggregated=agg)
        by_zero = F.when((x == 0) | F.isnan(x), float("nan")).when(x > 0, float("inf")).when(x < 0, float("-inf"))
        return Val(F.when(y == 0, by_zero).otherwise(F.try_divide(x, y)), T.DoubleType(), nullable=nullable, aggregated=agg)
    if op == "%":
        x, y = a.col.cast(t), b.col.cast(t)
        zero = F.lit(float("nan")) if isinstance(t, T.DoubleType) else F.lit(None).cast(t)
        safe = x % y if b.constant not in (..., None, 0) else F.when(y == 0, zero).otherwise(F.try_mod(x, y))
        return Val(safe, t, nullable=nullable or b.constant in (..., None, 0), aggregated=agg)
    if isinstance(t, T.IntegerType):
        # 32 bits that wrap around, computed in 64
        x, y = a.col.cast("long"), b.col.cast("long")
        wide = x + y if op == "+" else x - y if op == "-" else x * y
        if a.constant is not ... and b.constant is not ... and None not in (a.constant, b.constant):
            k = {"+": a.constant + b.constant, "-": a.constant - b.constant, "*": a.constant * b.constant}[op]
            return literal((k + (1 << 31)) % (1 << 32) - (1 << 31))
        return Val(F.shiftright(F.shiftleft(wide, 32), 32).cast("int"), t, nullable=nullable, aggregated=agg)
    x, y = (v.col if simple(v.type) == t else v.col.cast(t) for v in both)
    if isinstance(t, T.LongType):
        col = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](x, y)
        return Val(col, t, aggregated=agg)
    out = x + y if op == "+" else x - y if op == "-" else x * y
    return Val(out.cast(t) if isinstance(t, T.DecimalType) else out, t, nullable=nullable, aggregated=agg)


__all__ = ["Compiler", "Context", "member", "root_of", "to_type"]
