"""String, regular expression and mathematical functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.values import AnalysisError, Val, as_many, is_date, is_number, is_string, literal, null, simple, text
from .registry import any_type, function, made, strict

S, INT, DOUBLE, BOOL = T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType()


def _simple(names: tuple[str, ...], kinds: list, result: object, build: object) -> None:
    function(*names, arity=len(kinds))(strict(kinds, result, build))


_simple(("LOWER",), [is_string], S, F.lower)
_simple(("UPPER",), [is_string], S, F.upper)
_simple(("LTRIM",), [is_string], S, lambda s: F.regexp_replace(s, r"^[\s\u0085\p{Z}]+", ""))
_simple(("RTRIM",), [is_string], S, lambda s: F.regexp_replace(s, r"[\s\u0085\p{Z}]+$", ""))
_simple(("TRIM",), [is_string], S, lambda s: F.regexp_replace(s, r"^[\s\u0085\p{Z}]+|[\s\u0085\p{Z}]+$", ""))
_simple(("INDEXOF",), [is_string, is_string], INT, lambda s, t: F.locate(t, s) - 1 if isinstance(t, str) else F.call_function("locate", t, s) - 1)
_simple(("INDEXOF",), [is_string, is_string, is_number], INT, lambda s, t, k: F.call_function("locate", t, s, k.cast("int") + 1) - 1)
_simple(("SUBSTRING",), [is_string, is_number], S, lambda s, k: F.call_function("substring", s, k.cast("int") + 1))
_simple(("SUBSTRING",), [is_string, is_number, is_number], S, lambda s, k, n: F.call_function("substring", s, k.cast("int") + 1, n.cast("int")))
_simple(("REPLACE",), [is_string, is_string, is_string], S, lambda s, a, b: F.replace(s, a, b))


def _pad(side: str) -> object:
    def build(s: Column, width: Column, fill: Column) -> Column:
        w = width.cast("int")
        return F.when(F.length(s) >= w, s).otherwise(F.call_function(side, s, w, F.call_function("left", fill, F.lit(1))))

    return build


_simple(("LPAD",), [is_string, is_number, is_string], S, _pad("lpad"))
_simple(("RPAD",), [is_string, is_number, is_string], S, _pad("rpad"))


@function("SPLIT", arity=2)
def split(ctx: object, s: Val, sep: Val) -> Val:
    """Parts between a literal separator, without empty ones."""
    if not is_string(s.type) or not is_string(sep.type):
        return Val(F.array().cast("array<string>"), S, "many", nullable=False)
    quoted = F.lit(re.sub(r"([^\w\s])", r"\\\1", sep.constant)) if isinstance(sep.constant, str) else F.concat(F.lit("\\Q"), sep.col, F.lit("\\E"))
    parts = F.filter(F.split(s.col, quoted), lambda x: x != "")
    return made(F.coalesce(parts, F.array().cast("array<string>")), S, s, sep, nullable=False).but(kind="many")


@function("SPLIT", arity=3)
def split_regex(ctx: object, s: Val, pattern: Val, regex: Val) -> Val:
    if regex.constant is False:
        return split(ctx, s, pattern)
    if not is_string(s.type) or not is_string(pattern.type):
        return Val(F.array().cast("array<string>"), S, "many", nullable=False)
    return made(F.coalesce(F.split(s.col, pattern.col), F.array().cast("array<string>")), S, s, pattern, nullable=False).but(kind="many")


# Tokens of date formats and what they are in Spark's patterns.
_DATE_TOKENS = {
    "yyyy": "yyyy", "yy": "yy", "MMMM": "MMMM", "MMM": "MMM", "MM": "MM", "M": "M", "dddd": "EEEE", "ddd": "EEE", "dd": "dd", "d": "d", "HH": "HH", "H": "H", "hh": "hh", "h": "h",
    "mm": "mm", "m": "m", "ss": "ss", "s": "s", "fff": "SSS", "ff": "SS", "f": "S", "tt": "a",
}


@function("FORMAT", arity=2)
def format_(ctx: object, v: Val, pattern: Val) -> Val:
    """Common date patterns, the number formats N, F, D, X, P and E with an optional precision, and patterns of digits.

    Patterns have ``0`` for digits that are always there, ``#`` for others, ``,`` ``.`` and ``%``; halves round to even.
    """
    if not isinstance(pattern.constant, str):
        return null(S)
    p = pattern.constant
    if is_date(v.type):
        out = re.sub(r"yyyy|yy|MMMM|MMM|MM|M|dddd|ddd|dd|d|HH|H|hh|h|mm|m|ss|s|fff|ff|f|tt|[A-Za-z]+", lambda m: _DATE_TOKENS.get(m[0], f"'{m[0]}'"), p)
        return made(F.date_format(v.col, out), S, v)
    if not is_number(v.type):
        return null(S)
    m = re.fullmatch(r"([NnFfDdXxPpEe])(\d*)", p)
    if not m and re.fullmatch(r"[#,]*[0,]*(\.0*#*)?%?", p) and re.search("[0#]", p):
        return made(F.call_function("format_number", v.col.cast("double"), F.lit(p)), S, v)
    if not m:
        raise AnalysisError(f"number format {p!r} isn't supported")
    kind, n = m[1].upper(), int(m[2]) if m[2] else None
    d = v.col.cast("double")
    if kind == "N":
        col = F.format_number(d, 2 if n is None else n)
    elif kind == "F":
        col = F.format_string(f"%.{2 if n is None else n}f", d)
    elif kind == "D":
        col = F.format_string(f"%0{n}d" if n else "%d", v.col.cast("long"))
    elif kind == "X":
        col = F.lpad(F.hex(v.col.cast("long")), n, "0") if n else F.hex(v.col.cast("long"))
    elif kind == "P":
        col = F.concat(F.format_number(d * 100, 2 if n is None else n), F.lit(" %"))
    else:
        col = F.format_string(f"%.{6 if n is None else n}E", d)
    return made(col, S, v)


@function("JOIN", arity=1, sequences=(0,))
def join(ctx: object, items: Val) -> Val:
    return join_with(ctx, items, literal(""))


@function("JOIN", arity=2, sequences=(0,))
def join_with(ctx: object, items: Val, sep: Val) -> Val:
    """The texts of the items with a separator between; nulls are empty."""
    items = as_many(items)
    texts = F.transform(items.col, lambda x: text(Val(x, items.type)))
    return made(F.array_join(texts, sep.constant if isinstance(sep.constant, str) else ""), S, items, sep, nullable=False) if isinstance(sep.constant, str) else made(F.call_function("array_join", texts, text_or_empty(sep)), S, items, sep, nullable=False)


def text_or_empty(v: Val) -> Column:
    return v.col if is_string(v.type) else F.lit("")


@function("IS_MATCH", arity=2)
def is_match(ctx: object, s: Val, pattern: Val) -> Val:
    if not is_string(s.type) or not is_string(pattern.type):
        return literal(False)
    return made(F.coalesce(F.rlike(s.col, pattern.col), F.lit(False)), BOOL, s, pattern, nullable=False)


@function("MATCH", arity=3)
def match(ctx: object, s: Val, pattern: Val, group: Val) -> Val:
    """A group of the first match, by number or name; null without a match."""
    if not is_string(s.type) or not is_string(pattern.type):
        return null(S)
    k = group.col
    if isinstance(group.constant, str):
        if not isinstance(pattern.constant, str):
            raise AnalysisError("a named group needs a constant pattern")
        names = re.findall(r"(?<!\\)\((?:\?<(\w+)>|(?!\?))", pattern.constant)
        if group.constant not in names:
            return null(S)
        k = F.lit(names.index(group.constant) + 1)
    found = F.regexp_extract(s.col, pattern.constant, int(group.constant)) if isinstance(pattern.constant, str) and isinstance(group.constant, int) else F.call_function("regexp_extract", s.col, pattern.col, k.cast("int"))
    return made(F.when(F.rlike(s.col, pattern.col), found), S, s, pattern)


# mathematics

@function("ABS", arity=1)
def abs_(ctx: object, v: Val) -> Val:
    return made(F.abs(v.col), simple(v.type), v, nullable=v.nullable) if is_number(v.type) else null()


@function("ROUND", arity=2)
def round_(ctx: object, v: Val, digits: Val) -> Val:
    """Half to even; whole numbers stay."""
    if not is_number(v.type) or not is_number(digits.type):
        return null()
    t = simple(v.type)
    if isinstance(t, (T.IntegerType, T.LongType)):
        return v
    n = int(digits.constant) if digits.constant not in (..., None) else None
    if n is None:
        raise AnalysisError("ROUND needs a constant number of digits")
    col = F.bround(v.col, n)
    return made(col.cast(t), t, v, nullable=v.nullable)


@function("POW", arity=2)
def pow_(ctx: object, x: Val, y: Val) -> Val:
    return strict([is_number, is_number], DOUBLE, lambda a, b: F.pow(a.cast("double"), b.cast("double")))(ctx, x, y)


__all__ = ["any_type"]
