"""The table of functions.

A function takes the context and compiled values and gives a value.  ``sequences`` names the
arguments that are sequences: one value given there becomes a sequence, and a sequence given
elsewhere becomes an array.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.values import AnalysisError, Val, is_null, null, simple


@dataclass(frozen=True)
class Function:
    name: str
    run: Callable[..., Val]
    sequences: tuple[int, ...] = ()
    over_rows: bool = False  # takes sequences over rows as they are


FUNCTIONS: dict[tuple[str, int], Function] = {}
VOLATILE: set[str] = set()


def function(*names: str, arity: int, sequences: tuple[int, ...] = (), over_rows: bool = False, volatile: bool = False) -> Callable:
    def put(run: Callable[..., Val]) -> Callable[..., Val]:
        for name in names:
            FUNCTIONS[name, arity] = Function(name, run, sequences, over_rows)
            if volatile:
                VOLATILE.add(name)
        return run

    return put


def lookup(name: str, arity: int) -> Function:
    found = FUNCTIONS.get((name.upper(), arity))
    if found is None:
        raise AnalysisError(f"no function {name.upper()} with {arity} argument{'s' * (arity != 1)}")
    return found


def register_function(name: str, arity: int, build: Callable[..., Column], result: T.DataType, volatile: bool = False) -> None:
    """Add a scalar function: ``build`` takes ``arity`` Columns and gives one of type ``result``."""
    function(name.upper(), arity=arity, volatile=volatile)(lambda ctx, *args: made(build(*[a.col for a in args]), result, *args))


def made(col: Column, type_: T.DataType, *of: Val, nullable: bool = True) -> Val:
    return Val(col, type_, nullable=nullable, aggregated=any(v.aggregated for v in of))


def strict(kinds: object, result: T.DataType | Callable, build: Callable[..., Column]) -> Callable[..., Val]:
    """A function that is null where an argument isn't of its kind; ``kinds`` has a test for each argument."""

    def run(ctx: object, *args: Val) -> Val:
        t = result(*[a.type for a in args]) if callable(result) else result
        if any(not k(simple(a.type)) for k, a in zip(kinds, args, strict=True)):
            return null(t)
        return made(build(*[a.col for a in args]), t, *args, nullable=any(a.nullable for a in args))

    return run


def any_type(t: T.DataType) -> bool:
    return True


def none(v: Val) -> bool:
    return is_null(v.type)


__all__ = ["F", "FUNCTIONS", "Function", "any_type", "function", "lookup", "made", "none", "register_function", "strict"]
