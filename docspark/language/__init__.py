"""The query language: tokens, syntax tree and parser."""

from .nodes import *  # noqa: F403
from .parser import ParseError, parse_expression, parse_projection, parse_statement

__all__ = ["ParseError", "parse_expression", "parse_projection", "parse_statement"]
