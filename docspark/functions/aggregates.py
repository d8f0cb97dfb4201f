"""Aggregates: over rows they are Spark's aggregates, over an array they are higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.values import AnalysisError, Val, is_null, is_number, literal, null, simple
from .registry import function

LONG, DOUBLE, BOOL = T.LongType(), T.DoubleType(), T.BooleanType()


def _agg(name: str) -> object:
    return function(name, arity=1, sequences=(0,), over_rows=True)


def _of(col: Column, t: T.DataType, v: Val, nullable: bool = True) -> Val:
    return Val(col, t, nullable=nullable, aggregated=v.kind == "rows" or v.aggregated)


def _kept(v: Val, col: Column) -> Column:
    return col if v.where is None else F.when(v.where, col)


def _plain(v: Val) -> Val:
    """Rows that an aggregate can't take one by one, as a collected array."""
    from ..plans.values import collect

    return collect(v) if v.kind == "rows" and v.distinct else v


def _numbers(v: Val) -> bool:
    return is_number(v.type)


def _wide(t: T.DataType) -> T.DataType:
    return LONG if isinstance(simple(t), T.IntegerType) else simple(t)


@_agg("COUNT")
def count(ctx: object, v: Val) -> Val:
    """Items, nulls included."""
    if v.kind == "rows":
        if v.distinct and not v.flat:
            if is_null(v.type):
                return _of((F.count(_kept(v, F.lit(1))) > 0).cast("long"), LONG, v, False)
            return _of(F.count_distinct(_kept(v, v.col)) + F.coalesce(F.max(_kept(v, v.col.isNull().cast("long"))), F.lit(0)), LONG, v, False)
        if not v.distinct:
            if v.flat:
                return _of(F.coalesce(F.sum(_kept(v, F.size(v.col))), F.lit(0)).cast("long"), LONG, v, False)
            return _of(F.count(_kept(v, F.lit(1))), LONG, v, False)
    v = _plain(v)
    return _of(F.size(v.col).cast("long"), LONG, v, False)


@_agg("ANY")
def any_(ctx: object, v: Val) -> Val:
    """Whether there is an item at all."""
    return _of(count(ctx, v).col > 0, BOOL, v, False)


def _array_sum(col: Column, t: T.DataType) -> Column:
    zero = F.lit(0).cast(t)
    return F.aggregate(col, zero, lambda a, x: a + F.coalesce(x.cast(t), zero))


@_agg("SUM")
def sum_(ctx: object, v: Val) -> Val:
    """Sum of the numbers; 0 without any.  Whole numbers add up in 64 bits."""
    if not _numbers(v):
        return literal(0).but(aggregated=v.kind == "rows" or v.aggregated) if v.kind != "rows" else _of(F.count(F.lit(None)) * 0, LONG, v, False)
    v = _plain(v)
    t = _wide(v.type)
    if v.kind == "rows":
        x = _array_sum(v.col, t) if v.flat else v.col
        return _of(F.coalesce(F.sum(_kept(v, x)), F.lit(0)).cast(t), t, v, False)
    return _of(_array_sum(v.col, t), t, v, False)


@_agg("AVG")
def avg(ctx: object, v: Val) -> Val:
    """Mean of the numbers; 0 without any."""
    t = simple(v.type) if isinstance(simple(v.type), T.DecimalType) else DOUBLE
    if not _numbers(v):
        return _of(F.count(F.lit(None)) * 0.0 if v.kind == "rows" else F.lit(0.0), DOUBLE, v, False)
    v = _plain(v)
    if v.kind == "rows" and not v.flat:
        return _of(F.coalesce(F.avg(_kept(v, v.col)), F.lit(0)).cast(t), t, v, False)
    here = F.size(F.filter(v.col, lambda x: x.isNotNull()))
    total = _array_sum(v.col, t)
    if v.kind == "rows":
        total, here = F.sum(_kept(v, total)), F.sum(_kept(v, here))
    return _of(F.when(here > 0, total / here).otherwise(0).cast(t), t, v, False)


def _extreme(v: Val, least: bool) -> Val:
    if is_null(v.type):
        return null().but(aggregated=v.kind == "rows")
    v = _plain(v)
    t = simple(v.type)
    of_rows, of_array = (F.min, F.array_min) if least else (F.max, F.array_max)
    if v.kind == "rows":
        x = of_array(v.col) if v.flat else v.col
        has_null = F.exists(v.col, lambda e: e.isNull()) if v.flat else v.col.isNull()
        out = of_rows(_kept(v, x))
        if least and (v.flat or v.nullable):  # null is less than all
            out = F.when(F.coalesce(F.max(_kept(v, has_null.cast("int"))), F.lit(0)) == 0, out)
        return _of(out, t, v)
    out = of_array(v.col)
    if least:
        out = F.when(~F.exists(v.col, lambda e: e.isNull()), out)
    return _of(out, t, v)


@_agg("MIN")
def min_(ctx: object, v: Val) -> Val:
    """The least item, where null is less than all; null without items."""
    return _extreme(v, True)


@_agg("MAX")
def max_(ctx: object, v: Val) -> Val:
    return _extreme(v, False)


def _end(v: Val, first: bool) -> Val:
    if v.kind == "rows" and not v.flat and not v.distinct:
        if is_null(v.type):
            return null().but(aggregated=True)
        if not v.order:
            raise AnalysisError("the source has no order")
        key = F.struct(*v.order)
        pick = F.min_by if first else F.max_by
        return _of(pick(F.struct(v.col.alias("v")), _kept(v, key))["v"] if v.where is None else pick(F.struct(v.col.alias("v")), F.when(v.where, key))["v"], v.type, v)
    from ..plans.values import collect

    v = collect(v) if v.kind == "rows" else v
    return _of(F.try_element_at(v.col, F.lit(1 if first else -1)), v.type, v)


@_agg("FIRST")
def first(ctx: object, v: Val) -> Val:
    """The first item in the order of the source."""
    return _end(v, True)


@_agg("LAST")
def last(ctx: object, v: Val) -> Val:
    return _end(v, False)
