"""Date functions; what isn't a date gives null."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.values import Val, is_date, is_number, null
from .registry import function, made, strict

INT, TIME = T.IntegerType(), T.TimestampType()

for _name, _part in (("YEAR", F.year), ("MONTH", F.month), ("DAY", F.dayofmonth), ("HOUR", F.hour), ("MINUTE", F.minute), ("SECOND", F.second)):
    function(_name, arity=1)(strict([is_date], INT, _part))

# Names of the parts of a date; only a bare capital M is a month.
_PARTS = {
    "y": "YEAR", "year": "YEAR", "M": "MONTH", "month": "MONTH", "d": "DAY", "day": "DAY", "h": "HOUR", "hour": "HOUR", "m": "MINUTE", "minute": "MINUTE", "s": "SECOND", "second": "SECOND",
}


def _part(v: Val) -> str | None:
    if not isinstance(v.constant, str):
        return None
    return "MONTH" if v.constant == "M" else _PARTS.get(v.constant.lower())


@function("DATEADD", arity=3)
def dateadd(ctx: object, part: Val, n: Val, d: Val) -> Val:
    unit = _part(part)
    if unit is None or not is_number(n.type) or not is_date(d.type):
        return null(TIME)
    k, t = n.col.cast("int"), d.col.cast("timestamp")
    if unit in ("YEAR", "MONTH"):
        step = F.make_ym_interval(**{unit.lower() + "s": k})
    else:
        step = F.make_dt_interval(**{{"DAY": "days", "HOUR": "hours", "MINUTE": "mins", "SECOND": "secs"}[unit]: k})
    return made(t + step, TIME, n, d)


@function("DATEDIFF", arity=3)
def datediff(ctx: object, part: Val, a: Val, b: Val) -> Val:
    """Whole units from a to b.

    Days to seconds are cut towards zero.  Months add the days' difference as a share of the month
    that begins at b, and are cut; years count when b's month and day reach a's.
    """
    unit = _part(part)
    if unit is None or not is_date(a.type) or not is_date(b.type):
        return null(INT)
    x, y = a.col.cast("timestamp"), b.col.cast("timestamp")
    years = F.year(y) - F.year(x)
    if unit == "YEAR":
        early = (F.month(y) < F.month(x)) | ((F.month(y) == F.month(x)) & (F.dayofmonth(y) < F.dayofmonth(x)))
        col = years - early.cast("int")
    elif unit == "MONTH":
        days = F.datediff(F.add_months(y, 1), y.cast("date"))
        col = years * 12 + F.month(y) - F.month(x) + (F.dayofmonth(y) - F.dayofmonth(x)) / days
    else:
        col = F.timestamp_diff(unit, x, y)
    return made(col.cast("int"), INT, a, b)


function("TO_LOCAL", arity=1)(strict([is_date], TIME, lambda d: F.from_utc_timestamp(d, F.current_timezone())))
function("TO_UTC", arity=1)(strict([is_date], TIME, lambda d: F.to_utc_timestamp(d, F.current_timezone())))
