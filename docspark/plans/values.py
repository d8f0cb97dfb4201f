"""Typed values of the expression compiler.

A value is ``one`` (exactly one value a row), ``many`` (a sequence in one array column) or
``rows`` (a sequence over the whole source or group, not yet aggregated).  Comparison is a total
order with two-valued logic: null is the least value and equal to itself, and values of
different kinds compare by the rank of their kinds.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field, replace
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NULL = T.NullType()


class AnalysisError(ValueError):
    """The expression or statement can't be compiled."""


@dataclass
class Val:
    col: Column
    type: T.DataType  # of the value, or of each element of a sequence
    kind: str = "one"
    parts: dict[str, Val] | None = None  # of a document whose fields are known one by one
    nullable: bool = True
    constant: object = ...  # the literal's value
    aggregated: bool = False
    # of rows only
    where: Column | None = None
    flat: bool = False  # col is an array of elements of each row
    distinct: bool = False
    order: list[Column] = field(default_factory=list)
    sentinel: int = 0  # -1 for the least value of all, 1 for the greatest

    def but(self, **changes: object) -> Val:
        return replace(self, **changes)


def simple(x: T.DataType) -> T.DataType:
    """The type of the value system that a Spark type belongs to."""
    if isinstance(x, (T.ByteType, T.ShortType)):
        return T.IntegerType()
    if isinstance(x, T.FloatType):
        return T.DoubleType()
    if isinstance(x, (T.DateType, T.TimestampNTZType)):
        return T.TimestampType()
    if isinstance(x, (T.VarcharType, T.CharType)):
        return T.StringType()
    return x


def is_number(x: T.DataType) -> bool:
    return isinstance(simple(x), (T.IntegerType, T.LongType, T.DoubleType, T.DecimalType))


def is_string(x: T.DataType) -> bool:
    return isinstance(x, T.StringType)


def is_date(x: T.DataType) -> bool:
    return isinstance(simple(x), T.TimestampType)


def is_array(x: T.DataType) -> bool:
    return isinstance(x, T.ArrayType)


def is_document(x: T.DataType) -> bool:
    return isinstance(x, (T.StructType, T.MapType, T.VariantType))


def is_null(x: T.DataType) -> bool:
    return isinstance(x, T.NullType)


#: Ranks of the kinds of values; numbers share one.
def rank(x: T.DataType) -> int:
    x = simple(x)
    for kinds, n in ((T.NullType, 1), ((T.IntegerType, T.LongType, T.DoubleType, T.DecimalType), 2), (T.StringType, 6), ((T.StructType, T.MapType, T.VariantType), 7), (T.ArrayType, 8), (T.BinaryType, 9), (T.BooleanType, 12), (T.TimestampType, 13)):
        if isinstance(x, kinds):
            return n
    return 7


def null(type_: T.DataType = NULL) -> Val:
    return Val(F.lit(None) if is_null(type_) else F.lit(None).cast(type_), type_, constant=None)


def literal(value: object) -> Val:
    """A value of a Python constant."""
    if value is None:
        return null()
    if isinstance(value, bool):
        t: T.DataType = T.BooleanType()
    elif isinstance(value, int):
        t = T.IntegerType() if -(1 << 31) <= value < 1 << 31 else T.LongType()
    elif isinstance(value, float):
        t = T.DoubleType()
    elif isinstance(value, Decimal):
        t = T.DecimalType(38, 18)
    elif isinstance(value, str):
        t = T.StringType()
    elif isinstance(value, (bytes, bytearray)):
        t, value = T.BinaryType(), bytearray(value)
    elif isinstance(value, dt.datetime):
        t = T.TimestampType()
    elif isinstance(value, dt.date):
        t, value = T.TimestampType(), dt.datetime.combine(value, dt.time())
    elif isinstance(value, dict):
        return document({str(k): literal(v) for k, v in value.items()})
    elif isinstance(value, (list, tuple)):
        return array([literal(v) for v in value])
    else:
        raise AnalysisError(f"no literal for {type(value).__name__}")
    return Val(F.lit(value).cast(t), t, nullable=False, constant=value)


def document(parts: dict[str, Val]) -> Val:
    parts = {k: as_one(v) for k, v in parts.items()}
    t = T.StructType([T.StructField(k, v.type, True) for k, v in parts.items()])
    col = F.struct(*[v.col.alias(k) for k, v in parts.items()]) if parts else F.struct(F.lit(None).cast("string").alias("_"))
    return Val(col, t if parts else T.StructType([]), parts=parts, nullable=False, aggregated=any(v.aggregated for v in parts.values()))


def array(items: list[Val]) -> Val:
    items = [as_one(v) for v in items]
    t = common([v.type for v in items])
    constant = [v.constant for v in items] if all(v.constant is not ... for v in items) else ...
    col = F.array(*[to_type(v, t).col for v in items]) if items else F.array().cast(T.ArrayType(NULL))
    return Val(col, T.ArrayType(t), nullable=False, constant=constant, aggregated=any(v.aggregated for v in items))


def common(types: list[T.DataType]) -> T.DataType:
    """The type that an array of such elements has; elements of different kinds become strings."""
    found = [simple(t) for t in types if not is_null(t)]
    if not found:
        return NULL
    if all(map(is_number, found)):
        best = max(found, key=lambda t: (T.IntegerType, T.LongType, T.DoubleType, T.DecimalType).index(type(t)))
        return T.DecimalType(38, 18) if isinstance(best, T.DecimalType) else best
    if all(t == found[0] for t in found):
        return found[0]
    if all(map(is_array, found)):
        return T.ArrayType(common([t.elementType for t in found]))
    if len({rank(t) for t in found}) == 1:
        return found[0]
    return T.StringType()


def to_type(v: Val, t: T.DataType) -> Val:
    """``v`` as a value of type ``t``, for arrays and branches whose elements must agree."""
    if v.type == t and not is_null(t):
        return v
    if is_string(t) and not is_string(v.type):
        return v.but(col=text(v), type=t, parts=None)
    if isinstance(t, T.StructType) and isinstance(v.type, T.StructType):
        return v
    return v.but(col=v.col.cast(t) if not is_null(t) else v.col, type=t)


def as_one(v: Val) -> Val:
    """A sequence as one array value."""
    if v.kind == "many":
        return v.but(kind="one", type=T.ArrayType(v.type), nullable=False)
    if v.kind == "rows":
        return as_one(collect(v))
    return v


def as_many(v: Val) -> Val:
    """One value as a sequence: an array's elements, nothing of null fields' arrays, or the value itself."""
    if v.kind != "one":
        return v
    if is_array(v.type):
        empty = F.array().cast(v.type)
        col = v.col if not v.nullable else F.coalesce(v.col, empty)
        return v.but(col=col, kind="many", type=v.type.elementType, nullable=True)
    if is_null(v.type):
        return Val(F.array(F.lit(None).cast("string")), NULL, "many", aggregated=v.aggregated)
    return v.but(col=F.array(v.col), kind="many", parts=None, constant=...)


def collect(v: Val) -> Val:
    """A sequence over rows as one array, in the order of the source."""
    x = v.col
    item = F.struct(*[o.alias(f"o{k}") for k, o in enumerate(v.order)], x.alias("v"))
    gathered = F.collect_list(item if v.where is None else F.when(v.where, item))
    if v.order:
        keys = len(v.order)

        def compare(a: Column, b: Column) -> Column:
            out = F.lit(0)
            for k in reversed(range(keys)):
                p, q = a[f"o{k}"], b[f"o{k}"]
                less = F.when(p.isNull(), q.isNotNull()).when(q.isNull(), F.lit(False)).otherwise(p < q)
                out = F.when(p.eqNullSafe(q), out).when(less, -1).otherwise(1)
            return out

        gathered = F.array_sort(gathered, compare) if keys > 1 or not _sortable(v.type) else F.array_sort(gathered)
    col = F.transform(gathered, lambda s: s["v"])
    if v.flat:
        col = F.flatten(col)
    if v.distinct:
        col = F.array_distinct(col)
    return Val(col, v.type, "many", aggregated=True)


def _sortable(t: T.DataType) -> bool:
    if isinstance(t, (T.MapType, T.VariantType, T.NullType)):
        return False
    if isinstance(t, T.ArrayType):
        return _sortable(t.elementType)
    if isinstance(t, T.StructType):
        return all(_sortable(f.dataType) for f in t.fields)
    return True


# text

def text(v: Val) -> Column:
    """The text of a value, as in joining strings: null is empty; documents and arrays are JSON."""
    t = simple(v.type)
    if is_null(t):
        return F.lit("")
    if is_string(t):
        return F.coalesce(v.col, F.lit("")) if v.nullable else v.col
    if isinstance(t, T.DoubleType):
        whole = (v.col == F.floor(v.col)) & (F.abs(v.col) < 1e15)
        s = F.when(whole, v.col.cast("long").cast("string")).otherwise(v.col.cast("string"))
    elif isinstance(t, T.TimestampType):
        # the fields of UTC, whatever the session's zone
        utc = (F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'") + F.make_dt_interval(secs=(F.unix_micros(v.col.cast("timestamp")).cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)"))).cast("string")
        s = F.concat(F.substring(utc, 1, 10), F.lit("T"), F.substring(utc, 12, 8), F.lit("."), F.rpad(F.substring(utc, 21, 3), 3, "0"), F.lit("Z"))
    elif isinstance(t, T.BinaryType):
        s = F.base64(v.col)
    elif isinstance(t, (T.StructType, T.ArrayType, T.MapType, T.VariantType)):
        s = F.to_json(v.col, {"ignoreNullFields": "false"})
    elif isinstance(t, T.DecimalType):
        s = F.regexp_replace(F.regexp_replace(v.col.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    else:
        s = v.col.cast("string")
    return F.coalesce(s, F.lit(""))


def variant_key(col: Column) -> Column:
    """A value of a variant in the total order: its kind's rank, its number, its text."""
    kind = F.schema_of_variant(col)
    number = F.try_variant_get(col, "$", "double")
    plain = F.try_variant_get(col, "$", "string")
    ranks = F.lit(7)
    for prefix, n in (("VOID", 1), ("BIGINT", 2), ("INT", 2), ("SMALLINT", 2), ("TINYINT", 2), ("DOUBLE", 2), ("FLOAT", 2), ("DECIMAL", 2), ("STRING", 6), ("OBJECT", 7), ("ARRAY", 8), ("BINARY", 9), ("BOOLEAN", 12), ("TIMESTAMP", 13), ("DATE", 13)):
        ranks = F.when(kind.startswith(prefix), n).otherwise(ranks)
    rank_ = F.when(col.isNull(), 1).otherwise(ranks)
    return F.struct(rank_.alias("rank"), F.when(rank_ == 2, number).alias("number"), F.when(rank_ > 2, F.coalesce(plain, F.to_json(col))).alias("text"))


# comparison

def _pair(a: Val, b: Val, collation: str | None) -> tuple[Column, Column]:
    x, y = a.col, b.col
    if isinstance(a.type, T.VariantType) and isinstance(b.type, T.VariantType):
        return variant_key(x), variant_key(y)
    if collation and is_string(a.type) and is_string(b.type):
        return F.collate(x, collation), F.collate(y, collation)
    if is_number(a.type) and is_number(b.type) and simple(a.type) != simple(b.type):
        if isinstance(simple(a.type), T.DoubleType) or isinstance(simple(b.type), T.DoubleType):
            # a column stays as it is where only the literal has another type, so that filters reach the files
            if b.constant is not ... and isinstance(simple(a.type), (T.IntegerType, T.LongType)) and float(b.constant).is_integer():
                return x, F.lit(int(b.constant))
            return x.cast("double"), y.cast("double")
    return x, y


def equal(a: Val, b: Val, collation: str | None = None, for_filter: bool = False) -> Val:
    a, b = as_one(a), as_one(b)
    if a.sentinel or b.sentinel:
        return literal(a.sentinel == b.sentinel)
    if is_null(a.type) or is_null(b.type):
        if is_null(a.type) and is_null(b.type):
            return literal(True)
        v = b if is_null(a.type) else a
        return boolean(v.col.isNull(), a, b) if v.nullable else literal(False)
    if rank(a.type) != rank(b.type):
        both = a.col.isNull() & b.col.isNull()
        return boolean(both, a, b) if a.nullable and b.nullable else literal(False)
    x, y = _pair(a, b, collation)
    if isinstance(a.type, (T.StructType, T.MapType)) and a.type != b.type:
        x, y = F.to_json(x), F.to_json(y)
    if for_filter and (not a.nullable or not b.nullable or b.constant not in (..., None) or a.constant not in (..., None)):
        return boolean(x == y, a, b)  # null is never equal to what isn't null, and a filter drops both
    return boolean(x.eqNullSafe(y), a, b)


def boolean(col: Column, *of: Val) -> Val:
    return Val(col, T.BooleanType(), nullable=False, aggregated=any(v.aggregated for v in of))


def compare(op: str, a: Val, b: Val, collation: str | None = None, for_filter: bool = False) -> Val:
    """``a op b`` for <, <=, > and >= in the total order."""
    a, b = as_one(a), as_one(b)
    if op in (">", ">="):
        return _less(b, a, op == ">=", collation, for_filter)
    return _less(a, b, op == "<=", collation, for_filter)


def _less(a: Val, b: Val, or_equal: bool, collation: str | None, for_filter: bool) -> Val:
    """a < b, or a <= b."""
    if a.sentinel or b.sentinel:
        x, y = a.sentinel, b.sentinel
        return literal(x < y or (or_equal and x == y))
    a_null, b_null = is_null(a.type), is_null(b.type)
    if a_null and b_null:
        return literal(or_equal)
    if a_null:  # null is the least
        return literal(True) if or_equal or not b.nullable else boolean(b.col.isNotNull(), b)
    if b_null:
        return boolean(a.col.isNull(), a) if or_equal and a.nullable else literal(False)
    if rank(a.type) != rank(b.type):
        base = F.lit(rank(a.type) < rank(b.type))
    else:
        x, y = _pair(a, b, collation)
        base = x <= y if or_equal else x < y
    if not a.nullable and not b.nullable:
        return boolean(base, a, b)
    if not a.nullable:
        # b null: nothing is less than it; a filter drops the null just the same
        return boolean(base if for_filter else F.coalesce(base, F.lit(False)), a, b)
    if not b.nullable:
        return boolean(base | a.col.isNull(), a, b)
    when_null = F.when(a.col.isNull(), F.lit(True) if or_equal else b.col.isNotNull()).when(b.col.isNull(), F.lit(False))
    return boolean(when_null.otherwise(base), a, b)


def between(v: Val, low: Val, high: Val, collation: str | None = None, for_filter: bool = False) -> Val:
    p, q = compare(">=", v, low, collation, for_filter), compare("<=", v, high, collation, for_filter)
    return boolean(p.col & q.col, p, q)


def like(v: Val, pattern: Val, collation: str | None = None) -> Val:
    """% and _ as in SQL, without an escape character; whatever isn't a string doesn't match."""
    v, pattern = as_one(v), as_one(pattern)
    if not is_string(v.type) or not is_string(pattern.type):
        return literal(False)
    s, p = v.col, pattern.col
    if collation:
        s, p = F.lower(s), F.lower(p)
    if isinstance(pattern.constant, str):
        k = pattern.constant.lower() if collation else pattern.constant
        if "_" not in k and "%" not in k.strip("%") and not collation:
            core = k.strip("%")
            if k == core:
                out = s == core
            elif k == core + "%":
                out = s.startswith(core)
            elif k == "%" + core:
                out = s.endswith(core)
            elif k == f"%{core}%":
                out = s.contains(core)
            else:
                out = s.like(k.replace("\\", "\\\\"))
        else:
            out = s.like(k.replace("\\", "\\\\"))
    else:
        out = F.like(s, F.replace(p, F.lit("\\"), F.lit("\\\\")))
    return boolean(F.coalesce(out, F.lit(False)) if v.nullable or pattern.nullable else out, v, pattern)


def contained(v: Val, right: Val, collation: str | None = None, for_filter: bool = False) -> Val:
    """IN: membership in an array, or equality with another value."""
    right = as_one(right)
    v = as_one(v)
    if not is_array(right.type):
        return equal(v, right, collation, for_filter)
    if isinstance(right.constant, list) and all(not isinstance(x, (list, dict)) for x in right.constant):
        known = [x for x in right.constant if x is not None and rank(literal(x).type) == rank(v.type)]
        has_null = any(x is None for x in right.constant)
        x = F.collate(v.col, collation) if collation and is_string(v.type) else v.col
        out = x.isin(known) if known and not is_null(v.type) else F.lit(False)
        if is_null(v.type):
            return literal(has_null)
        if has_null:
            return boolean(v.col.isNull() | F.coalesce(out, F.lit(False)), v)
        return boolean(out if for_filter or not v.nullable else F.coalesce(out, F.lit(False)), v)
    element = lambda e: Val(e, right.type.elementType)
    return boolean(F.coalesce(F.exists(right.col, lambda e: equal(element(e), v, collation).col), F.lit(False)), v, right)
