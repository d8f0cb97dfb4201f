"""Functions of documents, arrays and sequences."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.values import AnalysisError, Val, as_many, as_one, common, document, is_array, is_document, is_null, is_number, is_string, literal, null, simple, to_type
from .registry import function, made

INT, S = T.IntegerType(), T.StringType()


@function("JSON", arity=1)
def json_(ctx: object, v: Val) -> Val:
    """Parsed JSON.  A constant text is typed at once; a column's is a variant, whose members come by path."""
    if not is_string(v.type):
        return null()
    if isinstance(v.constant, str):
        from ..language.lexer import ParseError
        from ..language.parser import constant, parse_expression

        try:
            return literal(constant(parse_expression(v.constant)))
        except (ParseError, ValueError):
            return null()
    return made(F.try_parse_json(v.col), T.VariantType(), v)


@function("EXTEND", arity=2)
def extend(ctx: object, a: Val, b: Val) -> Val:
    """The fields of both documents; the second's win."""
    if not is_document(a.type):
        return b if is_document(b.type) else document({})
    if not is_document(b.type):
        return a
    parts = dict(fields(a))
    low = {k.lower(): k for k in parts}
    for k, v in fields(b).items():
        parts[low.get(k.lower(), k)] = v
    return document(parts)


def fields(v: Val) -> dict[str, Val]:
    """The fields of a document of known type."""
    if v.parts is not None:
        return v.parts
    if isinstance(v.type, T.StructType):
        return {f.name: Val(v.col.getField(f.name), simple(f.dataType), aggregated=v.aggregated) for f in v.type.fields}
    raise AnalysisError("the document's fields aren't known before it is read")


@function("ITEMS", arity=1)
def items(ctx: object, v: Val) -> Val:
    if isinstance(v.type, T.BinaryType):
        n = F.octet_length(v.col)
        byte = lambda k: F.conv(F.hex(F.call_function("substring", v.col, k, F.lit(1))), 16, 10).cast("int")
        return made(F.when(n > 0, F.transform(F.sequence(F.lit(1), n), byte)).otherwise(F.array().cast("array<int>")), INT, v).but(kind="many")
    return as_many(v)


def _two(a: Val, b: Val) -> tuple[Column, Column, T.DataType]:
    t = common([a.type, b.type])
    return cast_items(a, t), cast_items(b, t), t


def cast_items(v: Val, t: T.DataType) -> Column:
    if v.type == t:
        return v.col
    return F.transform(v.col, lambda x: to_type(Val(x, v.type), t).col)


@function("CONCAT", arity=2, sequences=(0, 1))
def concat(ctx: object, a: Val, b: Val) -> Val:
    x, y, t = _two(as_many(a), as_many(b))
    return made(F.concat(x, y), t, a, b).but(kind="many")


@function("UNION", arity=2, sequences=(0, 1))
def union(ctx: object, a: Val, b: Val) -> Val:
    x, y, t = _two(as_many(a), as_many(b))
    return made(F.array_union(x, y), t, a, b).but(kind="many")


@function("EXCEPT", arity=2, sequences=(0, 1))
def except_(ctx: object, a: Val, b: Val) -> Val:
    x, y, t = _two(as_many(a), as_many(b))
    return made(F.array_except(x, y), t, a, b).but(kind="many")


@function("DISTINCT", arity=1, sequences=(0,), over_rows=True)
def distinct(ctx: object, v: Val) -> Val:
    if v.kind == "rows":
        return v.but(distinct=True)
    return v.but(col=F.array_distinct(v.col), constant=...)


@function("TOP", arity=2, sequences=(0,))
def top(ctx: object, v: Val, n: Val) -> Val:
    if not isinstance(simple(n.type), (T.IntegerType, T.LongType)):
        return v.but(col=F.slice(v.col, 1, 0))
    k = F.lit(max(0, n.constant)) if isinstance(n.constant, int) else F.greatest(n.col.cast("int"), F.lit(0))
    return v.but(col=F.slice(v.col, F.lit(1), k), constant=...)


@function("KEYS", arity=1)
def keys(ctx: object, v: Val) -> Val:
    if isinstance(v.type, T.StructType):
        names = [f.name for f in v.type.fields]
        return Val(F.array(*map(F.lit, names)).cast("array<string>"), S, "many", nullable=False)
    if isinstance(v.type, T.MapType):
        return made(F.map_keys(v.col), S, v).but(kind="many")
    if isinstance(v.type, T.VariantType):
        return made(F.coalesce(F.json_object_keys(F.to_json(v.col)), F.array().cast("array<string>")), S, v).but(kind="many")
    return Val(F.array().cast("array<string>"), S, "many", nullable=False)


@function("VALUES", arity=1)
def values(ctx: object, v: Val) -> Val:
    if isinstance(v.type, T.StructType):
        found = list(fields(v).values())
        t = common([x.type for x in found])
        return made(F.array(*[to_type(x, t).col for x in found]), t, v, *found).but(kind="many")
    if isinstance(v.type, T.MapType):
        return made(F.map_values(v.col), v.type.valueType, v).but(kind="many")
    if isinstance(v.type, T.VariantType):
        found = F.map_values(F.try_variant_get(v.col, "$", "map<string,variant>"))
        return made(F.coalesce(found, F.array().cast("array<variant>")), T.VariantType(), v).but(kind="many")
    return Val(F.array().cast("array<string>"), S, "many", nullable=False)


@function("IIF", arity=3)
def iif(ctx: object, test: Val, a: Val, b: Val) -> Val:
    t = common([a.type, b.type])
    return made(F.when(test.col, to_type(a, t).col).otherwise(to_type(b, t).col), t, test, a, b)


@function("COALESCE", arity=2)
def coalesce(ctx: object, a: Val, b: Val) -> Val:
    if is_null(a.type):
        return b
    if is_null(b.type):
        return a
    t = common([a.type, b.type])
    if isinstance(t, T.StringType) and not is_string(a.type):
        return made(F.when(a.col.isNotNull(), to_type(a, t).col).otherwise(to_type(b, t).col), t, a, b)
    return made(F.coalesce(to_type(a, t).col, to_type(b, t).col), t, a, b, nullable=a.nullable and b.nullable)


@function("LENGTH", arity=1)
def length(ctx: object, v: Val) -> Val:
    t = v.type
    if is_null(t):
        return literal(0)
    if is_string(t):
        col = F.length(v.col)
    elif isinstance(t, T.BinaryType):
        col = F.octet_length(v.col)
    elif is_array(t):
        col = F.size(v.col)
        return made(F.when(v.col.isNull(), 0).otherwise(col), INT, v, nullable=False)
    elif isinstance(t, T.StructType):
        return made(F.when(v.col.isNull(), 0).otherwise(len(t.fields)), INT, v, nullable=False) if v.nullable else literal(len(t.fields))
    elif isinstance(t, (T.MapType, T.VariantType)):
        k = as_one(keys(ctx, v)).col
        return made(F.when(v.col.isNull(), 0).otherwise(F.size(k)), INT, v, nullable=False)
    else:
        return made(F.when(v.col.isNull(), 0), INT, v)
    return made(F.coalesce(col, F.lit(0)), INT, v, nullable=False)


@function("RANDOM", arity=0, volatile=True)
def random(ctx: object) -> Val:
    return Val(F.floor(F.rand() * ((1 << 31) - 1)).cast("int"), INT, nullable=False)


@function("RANDOM", arity=2, volatile=True)
def random_between(ctx: object, low: Val, high: Val) -> Val:
    if not is_number(low.type) or not is_number(high.type):
        return null(INT)
    a, b = low.col.cast("int"), high.col.cast("int")
    return Val(F.floor(a + F.rand() * (b - a)).cast("int"), INT)


__all__ = ["fields", "json"]
