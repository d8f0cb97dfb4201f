"""SELECT statements to DataFrames.

Without grouping: source, INCLUDE that filters need, WHERE, ORDER BY with OFFSET and LIMIT,
other INCLUDEs, projection.  A projection over ``*`` aggregates what LIMIT and OFFSET leave.
With grouping: source, WHERE, GROUP BY, HAVING, projection, OFFSET, LIMIT.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sequences import fields
from ..language.nodes import Array, Binary, Call, Group, Lambda, Lit, Node, Param, Path, Projection, Quantified, Select, default_name, fields_of, uses_source
from ..operators.include import include
from .compiler import Compiler, Context, root_of
from .values import AnalysisError, Val, as_one, is_document, literal, simple, variant_key

KEY = "__key"
_RELATIONS = ("=", "!=", ">", ">=", "<", "<=", "LIKE", "BETWEEN", "IN")


def conjuncts(node: Node) -> list[Node]:
    """The terms of nested ANDs, each a predicate; raises for anything else."""
    while isinstance(node, Group):
        node = node.inner
    if isinstance(node, Binary) and node.op == "AND":
        return conjuncts(node.left) + conjuncts(node.right)
    if uses_source(node):
        raise AnalysisError("* can't be used in WHERE")
    if isinstance(node, Quantified) or (isinstance(node, Binary) and (node.op in _RELATIONS or node.op == "OR")) or (isinstance(node, Lit) and isinstance(node.value, bool)):
        return [node]
    what = {Path: "a path", Call: "a call", Lambda: "a lambda", Param: "a parameter"}.get(type(node), "this expression")
    raise AnalysisError(f"{what} isn't a predicate: compare it with a value, as in ... = true")


def clean_type(t: T.DataType) -> T.DataType:
    """``t`` with strings where it has values of no type, which files can't hold."""
    if isinstance(t, T.NullType):
        return T.StringType()
    if isinstance(t, T.ArrayType):
        return T.ArrayType(clean_type(t.elementType), True)
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f.name, clean_type(f.dataType), f.nullable) for f in t.fields])
    return t


def output(name: str, v: Val) -> Column:
    col = v.col
    if "void" in v.type.simpleString():
        col = col.cast(clean_type(v.type))
    return col.alias(name)


class Planner:
    """Plans over one source; ``key`` names the columns that give its order."""

    def __init__(self, resolve: object, params: dict[str, object] | None = None, collation: str | None = None):
        self.resolve = resolve  # (name, options) -> (DataFrame, key columns)
        self.params = {str(k).lower(): v if isinstance(v, Val) else literal(v) for k, v in (params or {}).items()}
        self.collation = collation
        self.source: str | None = None

    def context(self, df: DataFrame, **more: object) -> Context:
        return Context(root=root_of(df), params=self.params, collation=self.collation, **more)

    def order_of(self, df: DataFrame, key: list[str]) -> list[Column]:
        names = {f.name.lower(): f.name for f in df.schema.fields}
        found = [names[k.lower()] for k in key if k.lower() in names]
        if not found and "_id" in names:
            found = [names["_id"]]
        if not found:
            found = [f.name for f in df.schema.fields if _orderable(f.dataType)]
        return [F.col(f"`{n}`") for n in found]

    # clauses
    def where(self, df: DataFrame, conditions: Iterable[Node]) -> DataFrame:
        for condition in conditions:
            for node in conjuncts(condition):
                v = Compiler(self.context(df, for_filter=True))(node)
                df = df.filter(v.col)
        return df

    def sort_key(self, df: DataFrame, node: Node) -> Val:
        v = as_one(Compiler(self.context(df))(node))
        if self.collation and isinstance(v.type, T.StringType):
            v = v.but(col=F.collate(v.col, self.collation))
        if isinstance(v.type, T.VariantType):
            v = v.but(col=variant_key(v.col))
        return v

    def select(self, q: Select) -> DataFrame:
        self.source = q.source
        df, key = self.resolve(q.source, q.options)
        if q.group_by is not None:
            if q.order_by is not None or q.includes:
                raise AnalysisError("GROUP BY doesn't go with ORDER BY or INCLUDE")
            return self.grouped(df, key, q)
        if q.having is not None:
            raise AnalysisError("HAVING needs GROUP BY")
        early = {f.lower() for n in (*q.where, *([q.order_by] if q.order_by is not None else [])) for f in fields_of(n)}
        late = []
        for path in q.includes:
            root = fields_of(path)
            if root and (root[0].lower() in early or "$" in early):
                df = include(self, df, path, key)
            else:
                late.append(path)
        df = self.where(df, q.where)
        over_all = uses_source_in(q.projection)
        if q.order_by is not None:
            v = self.sort_key(df, q.order_by)
            first = v.col.desc() if q.descending else v.col.asc()
            ties = self.order_of(df, key) if q.limit is not None or q.offset else []
            df = df.orderBy(first, *ties)
        elif q.limit is not None or q.offset:
            df = df.orderBy(*self.order_of(df, key))
        if q.offset:
            df = df.offset(q.offset)
        if q.limit is not None:
            df = df.limit(q.limit)
        if over_all and (q.order_by is not None):
            key = ["__order", *key]
            v = self.sort_key(df, q.order_by)
            df = df.withColumn("__order", v.col)
            return self.aggregate(df, q, self.ordered(df, key, q.descending))
        for path in late:
            if any(f == "$" or f.lower() == fields_of(path)[0].lower() for _, n in q.projection.fields for f in fields_of(n)):
                df = include(self, df, path, key)
        if over_all:
            return self.aggregate(df, q, self.order_of(df, key))
        return self.project(df, q.projection)

    def ordered(self, df: DataFrame, key: list[str], descending: bool) -> list[Column]:
        cols = self.order_of(df, key)
        t = df.schema["__order"].dataType
        if descending:
            from .values import is_date, is_number

            if is_number(t):
                cols[0] = -cols[0]
            elif is_date(t):
                cols[0] = -F.unix_micros(cols[0].cast("timestamp"))
            else:
                raise AnalysisError("a descending order by text can't feed an ordered aggregate")
        return cols

    def columns(self, projection: Projection, compiler: Compiler) -> list[Column]:
        if projection.document is not None:
            v = as_one(compiler(projection.document))
            if not is_document(v.type):
                return [output("expr", v)]
            return [output(k, x) for k, x in fields(v).items()]
        return [output(alias, as_one(compiler(node))) for alias, node in projection.fields]

    def project(self, df: DataFrame, projection: Projection) -> DataFrame:
        if projection.document == Path("$"):
            return df
        return df.select(*self.columns(projection, Compiler(self.context(df))))

    def rows(self, df: DataFrame, order: list[Column]) -> Val:
        root = root_of(df.drop("__order") if "__order" in df.columns else df)
        return root.but(kind="rows", order=order)

    def aggregate(self, df: DataFrame, q: Select, order: list[Column]) -> DataFrame:
        context = Context(root=None, rows=self.rows(df, order), params=self.params, collation=self.collation)
        return df.agg(*self.columns(q.projection, Compiler(context)))

    def grouped(self, df: DataFrame, key: list[str], q: Select) -> DataFrame:
        df = self.where(df, q.where)
        by = as_one(Compiler(self.context(df))(q.group_by))
        if isinstance(by.type, T.VariantType):  # a variant groups by its JSON text
            by = by.but(col=F.to_json(by.col), type=T.StringType())
        order = self.order_of(df, key)
        rows = self.rows(df, order)
        keyed = df.withColumn(KEY, by.col)
        params = self.params | {"key": Val(F.col(KEY), simple(by.type), nullable=True, aggregated=True)}
        context = Context(root=None, rows=rows, params=params, collation=self.collation, grouped=True)
        compiler = Compiler(context)
        cols = self.columns(q.projection, compiler)
        extra = []
        if q.having is not None:
            v = as_one(compiler(q.having))
            if not isinstance(v.type, T.BooleanType):
                raise AnalysisError("HAVING needs a boolean")
            extra = [v.col.alias("__having")]
        ordered = q.limit is not None or q.offset
        out = keyed.groupBy(KEY).agg(*cols, *extra)
        if extra:
            out = out.filter(F.coalesce(F.col("__having"), F.lit(False))).drop("__having")
        if ordered:
            out = out.orderBy(KEY)
            out = out.offset(q.offset) if q.offset else out
            out = out.limit(q.limit) if q.limit is not None else out
        return out.drop(KEY)


def _orderable(t: T.DataType) -> bool:
    return not isinstance(t, (T.MapType, T.VariantType, T.NullType, T.ArrayType, T.StructType))


def uses_source_in(projection: Projection) -> bool:
    return any(uses_source(n) for _, n in projection.fields)


__all__ = ["Array", "Planner", "conjuncts", "default_name"]
