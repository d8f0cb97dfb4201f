"""docspark: document analytics on Spark.

``Database`` runs statements of a compact query language, and ``Collection`` and ``Query`` are
the same by calls.  Everything compiles to DataFrame operations.
"""

from .connection import Repository, connect
from .database import Collection, Database
from .functions import register_function
from .language import ParseError, parse_expression, parse_statement
from .operators.changes import DuplicateKey
from .plans.values import AnalysisError
from .query import Query, Where, doc, fn, param, rows
from .sources.storage import FileStorage
from .sources.system import system as register_source
from .streaming import stream_query

__all__ = [
    "AnalysisError", "Collection", "Database", "DuplicateKey", "FileStorage", "ParseError", "Query", "Repository", "Where", "connect", "doc", "fn", "param", "parse_expression", "parse_statement",
    "register_function", "register_source", "rows", "stream_query",
]
