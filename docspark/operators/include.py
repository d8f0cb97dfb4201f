"""INCLUDE: documents that references point at, by left outer joins.

A reference is a document with ``$id`` and ``$ref``, the key and the name of a collection.  A
found document's fields take the place of ``$ref`` beside ``$id``; a missing one leaves ``$ref``
and says ``$missing``.  References in arrays are joined one by one and gathered in order, by the collection's key and a
digest of the row: where the rows lie by their key already, nothing is shuffled for that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..language.nodes import Every, Member, Node, Path
from ..plans.values import _sortable

_RIGHT, _ROW, _AT, _REF = "__target", "__row", "__at", "__reference"


def _field(t: T.StructType, name: str) -> T.StructField | None:
    return next((f for f in t.fields if f.name.lower() == name.lower()), None)


def include(planner: object, df: DataFrame, path: Node, key: list[str]) -> DataFrame:
    """``df`` with the references at ``path`` replaced by what they point at."""
    if not isinstance(path, Path) or path.scope != "$" or not path.steps or not all(isinstance(s, (Member, Every)) for s in path.steps):
        raise ValueError("INCLUDE takes a path of fields, with [*] for arrays")
    names = [s.name for s in path.steps if isinstance(s, Member)]
    top = _field(df.schema, names[0])
    if top is None:
        return df
    return _at(planner, df, top, names[1:], planner.resolve.references(planner.source, ".".join(names)), key)


def _at(planner: object, df: DataFrame, top: T.StructField, rest: list[str], targets: list[str] | None, key: list[str]) -> DataFrame:
    column = F.col(f"`{top.name}`")
    t: T.DataType = top.dataType
    if isinstance(t, T.ArrayType):
        return _each(planner, df, top.name, rest, targets, key)
    steps, at = [], t
    for name in rest:
        f = _field(at, name) if isinstance(at, T.StructType) else None
        if f is None:
            return df
        steps.append(f.name)
        at = f.dataType
    if not isinstance(at, T.StructType) or _field(at, "$id") is None or _field(at, "$ref") is None:
        return df
    ref = column
    for s in steps:
        ref = ref.getField(s)
    joined, found = _lookup(planner, df.withColumn(_REF, ref), at, targets)
    return joined.withColumn(top.name, _replace(column, t, steps, found)).drop(_REF, *[c for c in joined.columns if c.startswith(_RIGHT)])


def _replace(col: Column, t: T.DataType, steps: list[str], value: Column) -> Column:
    if not steps:
        return value
    inside = F.struct(*[(_replace(col.getField(f.name), f.dataType, steps[1:], value) if f.name == steps[0] else col.getField(f.name)).alias(f.name) for f in t.fields])
    return F.when(col.isNotNull(), inside)


def _targets(planner: object, df: DataFrame) -> list[str]:
    """The known collections that the references name."""
    name = F.col(_REF).getField("$ref")
    return sorted(r["r"] for r in df.select(name.alias("r")).filter(name.isin([*planner.resolve.known()])).distinct().collect())


def _lookup(planner: object, df: DataFrame, t: T.StructType, targets: list[str] | None) -> tuple[DataFrame, Column]:
    """``df`` joined with all collections that _REF names, and the reference or what it points at.

    Declared targets spare the job that asks the references for their collections.
    """
    ref = F.col(_REF)
    id_, name = ref.getField("$id"), ref.getField("$ref")
    parts: list[tuple[Column, list[tuple[str, Column]]]] = []
    unknown = F.lit(True)
    for k, target in enumerate(_targets(planner, df) if targets is None else targets):
        try:
            right, key = planner.resolve(target, None)
        except KeyError:
            continue
        own = key[0] if key else "_id"
        own = next(c for c in right.columns if c.lower() == own.lower())
        held = f"{_RIGHT}{k}"
        right = right.select(F.struct(*[F.col(f"`{c}`") for c in right.columns]).alias(held))
        df = df.join(right, (id_ == F.col(held).getField(own)) & (name == F.lit(target)), "left")
        found = F.col(held)
        parts.append((found, [(c.name, found.getField(c.name)) for c in right.schema[held].dataType.fields if c.name != "_id" and c.name != own]))
        unknown = unknown & found.isNull()
    known = name.isin([*planner.resolve.known()])
    fields: dict[str, Column] = {"$id": id_}
    fields["$ref"] = F.when(unknown, name)
    for _, columns in parts:
        for c, value in columns:
            fields[c] = F.coalesce(fields[c], value) if c in fields else value
    fields["$missing"] = F.when(unknown & known, F.lit(True))
    document = F.struct(*[v.alias(c) for c, v in fields.items()])
    return df, F.when(ref.isNotNull(), document)


def _digest(df: DataFrame) -> Column:
    """A hash of all columns of a row."""
    return F.xxhash64(*[F.col(f"`{f.name}`") if _sortable(f.dataType) else F.to_json(F.struct(F.col(f"`{f.name}`"))) for f in df.schema.fields])


def _each(planner: object, df: DataFrame, name: str, rest: list[str], targets: list[str] | None, key: list[str]) -> DataFrame:
    """References in an array: one row for each, joined, and gathered again in their order.

    Rows that repeat in all columns gather together; each of them gets its share again.
    """
    low = {k.lower() for k in key}
    by = [c for c in df.columns if c.lower() in low and c != name and _sortable(df.schema[c].dataType)]
    others = [c for c in df.columns if c != name and c not in by]
    items = df.withColumn(_ROW, _digest(df)).select("*", F.posexplode_outer(F.col(f"`{name}`")).alias(_AT, "__item"))
    inner = _at(planner, items, items.schema["__item"], rest, targets, [])
    gathered = F.collect_list(F.when(F.col(_AT).isNotNull(), F.struct(_AT, F.col("__item"))))
    # places differ but in repeated rows; documents without an order need a comparison of places alone
    gathered = F.sort_array(gathered) if _sortable(inner.schema["__item"].dataType) else F.array_sort(gathered, lambda a, b: a[_AT] - b[_AT])
    same = F.count(F.when(F.coalesce(F.col(_AT), F.lit(0)) == 0, 1)).cast("int")
    one = inner.groupBy(*[F.col(f"`{c}`") for c in by], _ROW).agg(*[F.any_value(F.col(f"`{c}`")).alias(c) for c in others], F.any_value(F.col(f"`{name}`")).alias("__was"), gathered.alias("__all"), same.alias("__same"))
    own = F.filter("__all", lambda x, k: k % F.col("__same") == 0)
    value = F.when(F.col("__was").isNotNull(), F.transform(own, lambda s: s["__item"]))
    again = one.withColumn(name, value).withColumn("__again", F.explode(F.array_repeat(F.lit(0), F.col("__same"))))
    return again.select(*[F.col(f"`{c}`") for c in df.columns])
