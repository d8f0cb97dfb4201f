"""Queries over streams: filters, projections and INCLUDEs of static collections run unchanged on Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..language.nodes import Select
from ..language.parser import parse_statement
from ..plans.planner import uses_source_in
from ..plans.values import AnalysisError


def stream_query(db: object, stream: DataFrame, text: str, *args: object, name: str = "stream", **params: object) -> DataFrame:
    """A SELECT from the streaming DataFrame, registered as ``name``; only plans without state."""
    if not stream.isStreaming:
        raise ValueError("the DataFrame isn't streaming")
    q = parse_statement(text)
    if not isinstance(q, Select) or q.group_by is not None or q.order_by is not None or q.limit is not None or q.offset or uses_source_in(q.projection) or q.into:
        raise AnalysisError("a stream takes filters, projections and INCLUDE only")
    db.register(name, stream)
    return db.run(q, {str(k): v for k, v in enumerate(args)} | params)
