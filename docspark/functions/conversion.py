"""Construction, conversion and tests of types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.values import Val, as_many, as_one, is_array, is_date, is_document, is_null, is_number, is_string, literal, null, simple, text
from .registry import function, made

INT, LONG, DOUBLE, DECIMAL, S, BIN, BOOL, TIME = T.IntegerType(), T.LongType(), T.DoubleType(), T.DecimalType(38, 18), T.StringType(), T.BinaryType(), T.BooleanType(), T.TimestampType()
#: Cultures that write a comma before decimals and dots between thousands, and those that begin dates with the month.
COMMA_CULTURES = ("de", "fr", "es", "pt", "it", "nl", "ru", "pl", "tr", "sv", "da", "fi", "nb")
MONTH_FIRST = ("en-us", "en")


@function("MINVALUE", arity=0)
def minvalue(ctx: object) -> Val:
    return null().but(sentinel=-1)


@function("MAXVALUE", arity=0)
def maxvalue(ctx: object) -> Val:
    return null().but(sentinel=1)


@function("OBJECTID", arity=0, volatile=True)
def new_objectid(ctx: object) -> Val:
    return Val(objectid(), S, nullable=False)


def objectid() -> Column:
    """24 hexadecimal digits: seconds, then random ones."""
    return F.lower(F.concat(F.lpad(F.hex(F.unix_timestamp(F.current_timestamp())), 8, "0"), F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 16)))


@function("GUID", arity=0, volatile=True)
def new_guid(ctx: object) -> Val:
    return Val(F.uuid(), S, nullable=False)


@function("NOW", "NOW_UTC", arity=0, volatile=True)
def now(ctx: object) -> Val:
    return Val(F.current_timestamp(), TIME, nullable=False)


@function("TODAY", arity=0, volatile=True)
def today(ctx: object) -> Val:
    return Val(F.date_trunc("day", F.current_timestamp()), TIME, nullable=False)


def _whole(t: T.DataType) -> object:
    name = t.simpleString()

    def run(ctx: object, v: Val) -> Val:
        """Numbers round half to even; strings that are whole numbers parse; the rest is null."""
        x = simple(v.type)
        if is_number(x):
            col = v.col if isinstance(x, (T.IntegerType, T.LongType)) else F.bround(v.col, 0)
            return made(col.try_cast(name), t, v)
        if is_string(x):
            s = F.trim(v.col)
            return made(F.when(F.rlike(s, F.lit(r"^[+-]?\d+$")), s.try_cast(name)), t, v)
        return null(t)

    return run


function("INT32", "INT", arity=1)(_whole(INT))
function("INT64", "LONG", arity=1)(_whole(LONG))


def _real(t: T.DataType) -> tuple[object, object]:
    name = t.simpleString()

    def run(ctx: object, v: Val, culture: Val | None = None) -> Val:
        if is_number(v.type):
            return made(v.col.try_cast(name), t, v, nullable=v.nullable)
        if not is_string(v.type):
            return null(t)
        s = F.trim(v.col)
        comma = culture is not None and isinstance(culture.constant, str) and culture.constant.lower().split("-")[0] in COMMA_CULTURES
        s = F.replace(F.regexp_replace(s, r"[.\s]", ""), F.lit(","), F.lit(".")) if comma else F.replace(s, F.lit(","), F.lit(""))
        return made(F.when(F.rlike(s, F.lit(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")), s.try_cast(name)), t, v)

    return run, lambda ctx, v, c: run(ctx, v, c)


for _t, _name in ((DOUBLE, "DOUBLE"), (DECIMAL, "DECIMAL")):
    _one, _two = _real(_t)
    function(_name, arity=1)(_one)
    function(_name, arity=2)(_two)


@function("STRING", arity=1)
def string(ctx: object, v: Val) -> Val:
    return made(text(v), S, v, nullable=False)


@function("ARRAY", arity=1, sequences=(0,))
def array_(ctx: object, v: Val) -> Val:
    return as_one(v)


@function("BINARY", arity=1)
def binary(ctx: object, v: Val) -> Val:
    if isinstance(v.type, T.BinaryType):
        return v
    return made(F.try_to_binary(v.col, F.lit("base64")), BIN, v) if is_string(v.type) else null(BIN)


def _matching(pattern: str) -> object:
    def run(ctx: object, v: Val) -> Val:
        if not is_string(v.type):
            return null(S)
        return made(F.when(F.rlike(v.col, F.lit(pattern)), F.lower(v.col)), S, v)

    return run


function("OBJECTID", arity=1)(_matching(r"^[0-9a-fA-F]{24}$"))
function("GUID", arity=1)(_matching(r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"))


@function("BOOLEAN", "BOOL", arity=1)
def boolean_(ctx: object, v: Val) -> Val:
    if isinstance(v.type, T.BooleanType):
        return v
    if not is_string(v.type):
        return null(BOOL)
    s = F.lower(F.trim(v.col))
    return made(F.when(s == "true", True).when(s == "false", False), BOOL, v)


def in_utc(local: Column) -> Column:
    """The moment at which clocks in UTC show a timestamp without zone, whatever the session's zone."""
    days = F.datediff(local.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    seconds = days * 86_400 + F.hour(local) * 3_600 + F.minute(local) * 60
    return F.timestamp_micros(seconds * 1_000_000 + (F.date_part(F.lit("SECOND"), local) * 1_000_000).cast("long"))


def parse_date(s: Column, culture: str | None = None, utc: bool = False) -> Column:
    """ISO dates, then dates with slashes, dots or dashes in the culture's order; in the session's zone, or in UTC, unless they name one."""
    day_first = culture is not None and culture.lower() not in MONTH_FIRST
    slashed = r"^\s*(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})(\s+\d{1,2}:\d{2}(:\d{2})?)?\s*$"
    s = F.when(F.rlike(s, F.lit(r"\d")), s)  # no "today"
    iso = F.regexp_replace(s, slashed, "$3-$2-$1$4" if day_first else "$3-$1-$2$4")
    if not utc:
        return F.try_to_timestamp(iso)
    names_zone = F.rlike(iso, F.lit(r"\d:\d\d.*([zZ]|[+-]\d{1,2}(:?\d{2})?|UTC|GMT)\s*$"))
    return F.when(names_zone, F.try_to_timestamp(iso)).otherwise(in_utc(iso.try_cast("timestamp_ntz")))


def _dates(names: tuple[str, str], utc: bool) -> None:
    def parsed(v: Val, culture: str | None = None) -> Val:
        if is_date(v.type):
            return v.but(col=v.col.cast("timestamp"), type=TIME)
        return made(parse_date(v.col, culture, utc), TIME, v) if is_string(v.type) else null(TIME)

    def of_parts(ctx: object, y: Val, m: Val, d: Val) -> Val:
        if not (is_number(y.type) and is_number(m.type) and is_number(d.type)):
            return null(TIME)
        zone = (F.lit("UTC"),) if utc else ()
        return made(F.try_make_timestamp(y.col.cast("int"), m.col.cast("int"), d.col.cast("int"), F.lit(0), F.lit(0), F.lit(0), *zone), TIME, y, m, d)

    function(*names, arity=1)(lambda ctx, v: parsed(v))
    function(*names, arity=2)(lambda ctx, v, culture: parsed(v, culture.constant if isinstance(culture.constant, str) else None))
    function(*names, arity=3)(of_parts)


_dates(("DATETIME", "DATE"), False)
_dates(("DATETIME_UTC", "DATE_UTC"), True)


def _test(*names: str, kinds: object) -> None:
    @function(*names, arity=1)
    def run(ctx: object, v: Val) -> Val:
        if not kinds(simple(v.type)):
            return literal(False)
        return made(v.col.isNotNull(), BOOL, v, nullable=False) if v.nullable else literal(True)


@function("IS_NULL", arity=1)
def is_null_(ctx: object, v: Val) -> Val:
    if v.sentinel:
        return literal(False)
    return literal(True) if is_null(v.type) else made(v.col.isNull(), BOOL, v, nullable=False)


@function("IS_MINVALUE", arity=1)
def is_minvalue(ctx: object, v: Val) -> Val:
    return literal(v.sentinel < 0)


@function("IS_MAXVALUE", arity=1)
def is_maxvalue(ctx: object, v: Val) -> Val:
    return literal(v.sentinel > 0)


_test("IS_INT32", "IS_INT", kinds=lambda t: isinstance(t, T.IntegerType))
_test("IS_INT64", "IS_LONG", kinds=lambda t: isinstance(t, T.LongType))
_test("IS_DOUBLE", kinds=lambda t: isinstance(t, T.DoubleType))
_test("IS_DECIMAL", kinds=lambda t: isinstance(t, T.DecimalType))
_test("IS_NUMBER", kinds=is_number)
_test("IS_STRING", kinds=is_string)
_test("IS_DOCUMENT", kinds=is_document)
_test("IS_ARRAY", kinds=is_array)
_test("IS_BINARY", kinds=lambda t: isinstance(t, T.BinaryType))
_test("IS_BOOLEAN", "IS_BOOL", kinds=lambda t: isinstance(t, T.BooleanType))
_test("IS_DATETIME", "IS_DATE", kinds=is_date)


def _is_text(*names: str, pattern: str) -> None:
    """Ids are strings here: a string counts as one by its form."""

    @function(*names, arity=1)
    def run(ctx: object, v: Val) -> Val:
        return made(F.coalesce(F.rlike(v.col, F.lit(pattern)), F.lit(False)), BOOL, v, nullable=False) if is_string(v.type) else literal(False)


_is_text("IS_OBJECTID", pattern=r"^[0-9a-f]{24}$")
_is_text("IS_GUID", pattern=r"^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")


@function("OID_CREATIONTIME", arity=1)
def oid_creationtime(ctx: object, v: Val) -> Val:
    if not is_string(v.type):
        return null(TIME)
    good = F.rlike(v.col, F.lit(r"^[0-9a-fA-F]{24}$"))
    return made(F.when(good, F.timestamp_seconds(F.conv(F.substring(v.col, 1, 8), 16, 10).cast("long"))), TIME, v)


__all__ = ["as_many", "objectid"]
