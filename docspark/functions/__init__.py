"""Functions of the expression language, by name and number of arguments."""

from . import aggregates, conversion, dates, sequences, strings  # noqa: F401
from .registry import FUNCTIONS, VOLATILE, lookup, register_function

__all__ = ["FUNCTIONS", "VOLATILE", "lookup", "register_function"]
