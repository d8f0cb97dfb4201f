"""The rows that inserts, updates and deletes of collections write.

Ids that are missing are made up: from the largest id on, by numbering partitions, or at random.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.conversion import objectid
from ..language.nodes import Node
from ..plans.compiler import Compiler
from ..plans.planner import conjuncts
from ..plans.values import as_one, is_null, literal
from ..sources.shared import checkpointed


class DuplicateKey(ValueError):
    """A document with this _id, or this value of a unique index, is there already."""


def frame(spark: object, documents: list[dict], schema: T.StructType | None = None) -> DataFrame:
    """Documents of values as a DataFrame: few as literals, many in one Arrow table."""
    if len(documents) > 50:
        import pyarrow as pa

        order: dict[str, str] = {}
        for d in documents:
            for k in d:
                order.setdefault(k.lower(), k)
        rows_ = [{order[k.lower()]: v for k, v in d.items()} for d in documents]
        wide = pa.Table.from_pylist([{n: r.get(n) for n in order.values()} for r in rows_])
        types = [pa.int32() if pa.types.is_int64(f.type) and all(r.get(f.name) is None or -(1 << 31) <= r[f.name] < 1 << 31 for r in rows_) else f.type for f in wide.schema]
        return spark.createDataFrame(wide.cast(pa.schema([pa.field(f.name, t) for f, t in zip(wide.schema, types, strict=True)])))
    names: dict[str, str] = {}
    for f in schema.fields if schema else []:
        names[f.name.lower()] = f.name
    for d in documents:
        for k in d:
            names.setdefault(k.lower(), k)
    rows = []
    for d in documents:
        given = {names[k.lower()]: literal(v) for k, v in d.items()}
        rows.append(spark.range(1).select(*[v.col.alias(k) for k, v in given.items() if not is_null(v.type)]))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    types = {f.name: f.dataType for f in schema.fields} if schema else {}
    for name in names.values():
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast(types.get(name, T.StringType())))
    # few documents are one file
    return out.coalesce(1).select(*[F.col(f"`{n}`") for n in sorted(names.values(), key=lambda n: n != "_id")])


def match_schema(df: DataFrame, into: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with the same columns; numbers widen where the types differ."""
    have = {f.name.lower(): f for f in into.schema.fields}
    for f in df.schema.fields:
        old = have.get(f.name.lower())
        if old is None:
            into = into.withColumn(f.name, F.lit(None).cast(f.dataType))
        else:
            if old.name != f.name:
                df = df.withColumnRenamed(f.name, old.name)
            if old.dataType != f.dataType:
                wide = T.StringType() if isinstance(f.dataType, T.StringType) or isinstance(old.dataType, T.StringType) else T.DoubleType() if isinstance(f.dataType, T.DoubleType) or isinstance(old.dataType, T.DoubleType) else T.LongType()
                if isinstance(old.dataType, T.NumericType) and isinstance(f.dataType, T.NumericType):
                    into, df = into.withColumn(old.name, F.col(f"`{old.name}`").cast(wide)), df.withColumn(old.name, F.col(f"`{old.name}`").cast(wide))
                else:
                    df = df.withColumn(old.name, F.col(f"`{old.name}`").cast(old.dataType))
    names = [c for c in into.columns]
    have_now = {c.lower() for c in df.columns}
    for f in into.schema.fields:
        if f.name.lower() not in have_now:
            df = df.withColumn(f.name, F.lit(None).cast(f.dataType))
    return df.select(*[F.col(f"`{c}`") for c in names]), into


def with_ids(df: DataFrame, old: DataFrame | None, auto: str) -> DataFrame:
    """``df`` with an _id in every row, first of all columns."""
    id_ = next((c for c in df.columns if c.lower() == "_id"), None)
    if auto in ("INT", "LONG"):
        kind = "int" if auto == "INT" else "bigint"
        top = 0
        if old is not None and "_id" in old.columns:
            top = old.agg(F.max("_id")).first()[0] or 0
        if id_ is not None:
            top = max(top, df.agg(F.max(F.col(id_).cast("long"))).first()[0] or 0)
        df = checkpointed(df)  # numbering reads it twice
        number = numbered(df if id_ is None else df.filter(F.col(id_).isNull()).drop(id_))
        new = number.select((F.col("__n") + F.lit(top)).cast(kind).alias("_id"), *[F.col(f"`{c}`") for c in number.columns if c != "__n"])
        if id_ is None:
            return new
        given = df.filter(F.col(id_).isNotNull()).withColumnRenamed(id_, "_id").withColumn("_id", F.col("_id").cast(kind))
        return new.unionByName(given.select(*[F.col(f"`{c}`") for c in new.columns]))
    made = F.uuid() if auto == "GUID" else objectid()
    value: Column = made if id_ is None else F.when(F.col(id_).isNull(), made).otherwise(F.col(id_)) if isinstance(df.schema[id_].dataType, T.StringType) else F.col(id_)
    return df.select(value.alias("_id"), *[F.col(f"`{c}`") for c in df.columns if c != id_])


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with __n from 1 on without gaps: places in partitions, after the sizes of those before."""
    placed = df.withColumn("__m", F.monotonically_increasing_id()).withColumn("__p", F.shiftright("__m", 33))
    sizes = placed.groupBy("__p").agg(F.count(F.lit(1)).alias("__c"))
    before = sizes.select("__p", (F.sum("__c").over(Window.orderBy("__p")) - F.col("__c")).alias("__b"))  # a row for each partition
    out = placed.join(F.broadcast(before), "__p").withColumn("__n", F.col("__b") + F.col("__m").bitwiseAND((1 << 33) - 1) + 1)
    return out.drop("__m", "__p", "__b")


def check_ids(new: DataFrame, old: DataFrame | None) -> None:
    if new.filter(F.col("_id").isNull()).limit(1).count():
        raise DuplicateKey("_id can't be null")
    again = new.groupBy("_id").count().filter("count > 1").select("_id")
    if old is not None and "_id" in old.columns:
        again = again.unionByName(new.join(old.select(F.col("_id").alias("__old")), F.col("_id") == F.col("__old"), "left_semi").select("_id"))
    if bad := again.limit(1).collect():
        raise DuplicateKey(f"_id {bad[0][0]!r} is there already")


def matches(planner: object, df: DataFrame, where: Node | None) -> Column:
    """Whether a row fits WHERE: true or false, never null."""
    if where is None:
        return F.lit(True)
    out = F.lit(True)
    for node in conjuncts(where):
        out = out & F.coalesce(as_one(Compiler(planner.context(df))(node)).col, F.lit(False))
    return out


def updated(planner: object, df: DataFrame, document: Node, where: Node | None) -> DataFrame:
    """Rows where WHERE fits, with the document's fields; a new field is null elsewhere."""
    fits = matches(planner, df, where)
    changes = as_one(Compiler(planner.context(df))(document)).parts or {}
    if any(k.lower() == "_id" for k in changes):
        raise ValueError("_id can't change")
    names = {f.name.lower(): f for f in df.schema.fields}
    new: dict[str, Column] = {}
    for k, v in changes.items():
        old = names.get(k.lower())
        t = v.type if not is_null(v.type) else (old.dataType if old else T.StringType())
        if old is None:
            new[k] = F.when(fits, v.col.cast(t))
        else:
            both = old.dataType
            if isinstance(both, T.IntegralType) and isinstance(t, (T.DoubleType, T.DecimalType)):
                both = T.DoubleType()
            new[old.name] = F.when(fits, v.col.cast(both)).otherwise(F.col(f"`{old.name}`").cast(both))
    kept = [new.get(f.name, F.col(f"`{f.name}`")).alias(f.name) for f in df.schema.fields]
    return df.select(*kept, *[c.alias(k) for k, c in new.items() if k.lower() not in names])
