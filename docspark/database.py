"""Databases and their collections: statements, the collection API and transactions."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import VOLATILE
from .language.nodes import (
    Command, CreateIndex, Delete, DropCollection, DropIndex, Insert, Node, Path, Pragma, RenameCollection, Select, Update, fields_of, uses_source,
)
from .language.parser import parse_expression, parse_statement
from .operators import changes
from .plans.planner import Planner
from .plans.values import AnalysisError
from .query import Query, as_node
from .sources.catalog import Catalog, Entry
from .sources.shared import checkpointed
from .sources.system import SYSTEM, WRITERS


class _Resolver:
    """Names of sources to DataFrames and their key columns."""

    def __init__(self, db: Database):
        self.db = db

    def __call__(self, name: str | None, options: object = None) -> tuple[DataFrame, list[str]]:
        if name is None:
            return self.db.spark.range(1).select(), []
        if name.startswith("$"):
            run = SYSTEM.get(name.lower())
            if run is None:
                raise KeyError(f"no system collection {name}")
            return run(self.db, options), []
        return self.db.catalog.read(name)

    def known(self) -> list[str]:
        return self.db.catalog.names()

    def references(self, source: str | None, path: str) -> list[str] | None:
        """Collections that the references at a path name, where that was declared."""
        return self.db.catalog.references.get(((source or "").lower(), path.lower()))


class Database:
    """Collections under a folder (``path``), and views of the session.

    Without a path nothing can be written.  ``collation`` is one of Spark's, such as
    ``UTF8_BINARY`` (the default), ``UTF8_LCASE`` or ``UNICODE_CI``.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, collation: str | None = None, read_only: bool = False):
        self.spark = spark
        self.catalog = Catalog(spark, path)
        if collation:
            self.catalog.pragmas["COLLATION"] = collation
        self.read_only = read_only

    # sources
    def register(self, name: str, df: DataFrame, key: list[str] | str | None = None, references: dict[str, str | list[str]] | None = None) -> Database:
        """Name a DataFrame; ``key`` gives its order and is what references point at, ``references`` the targets of its paths."""
        self.catalog.add_view(name, df, key)
        for path, targets in (references or {}).items():
            self.declare(name, path, targets)
        return self

    def declare(self, collection: str, path: str, targets: str | list[str]) -> None:
        """The collections that references at a path of a collection name, so that INCLUDE needn't ask the data."""
        self.catalog.references[collection.lower(), path.lower()] = [targets] if isinstance(targets, str) else list(targets)

    def collection(self, name: str) -> Collection:
        return Collection(self, name)

    __getitem__ = collection

    def collection_names(self) -> list[str]:
        return self.catalog.names()

    def collection_exists(self, name: str) -> bool:
        return self.catalog.has(name)

    def drop_collection(self, name: str) -> bool:
        self._may_write()
        return self.catalog.drop(name)

    def rename_collection(self, name: str, to: str) -> bool:
        self._may_write()
        return self.catalog.rename(name, to)

    def begin(self) -> bool:
        return self.catalog.begin()

    def commit(self) -> bool:
        return self.catalog.commit()

    def rollback(self) -> bool:
        return self.catalog.rollback()

    def checkpoint(self) -> int:
        """Remove what old versions left; the number of folders."""
        return self.catalog.clean()

    def rebuild(self, collation: str | None = None) -> int:
        """Write each collection in one folder, and remove old ones; the number of collections written."""
        if collation:
            self.catalog.pragmas["COLLATION"] = collation
            self.catalog.save()
        return self.catalog.rebuild()

    @property
    def collation(self) -> str | None:
        name = str(self.catalog.pragmas["COLLATION"])
        return None if name == "UTF8_BINARY" else name

    def pragma(self, name: str, *value: object) -> object:
        name = name.upper()
        if name not in self.catalog.pragmas:
            raise KeyError(f"no pragma {name}")
        if value:
            if name == "COLLATION":
                raise ValueError("COLLATION is set by REBUILD")
            self.catalog.pragmas[name] = value[0]
            self.catalog.save()
            return True
        return self.catalog.pragmas[name]

    # statements
    def planner(self, params: dict[str, object] | None = None) -> Planner:
        return Planner(_Resolver(self), params, self.collation)

    def execute(self, text: str, *args: object, **params: object) -> DataFrame:
        """Run one statement; positional arguments are @0, @1 and so on."""
        return self.run(parse_statement(text), {str(k): v for k, v in enumerate(args)} | params)

    sql = execute

    def scalar(self, text: str, *args: object, **params: object) -> object:
        """The first value of the first row."""
        row = self.execute(text, *args, **params).first()
        return row[0] if row is not None else None

    def _may_write(self) -> None:
        if self.read_only:
            raise ValueError("the database is read-only")

    def _value(self, v: object, name: str = "expr") -> DataFrame:
        from .plans.values import literal

        return self.spark.range(1).select(literal(v).col.alias(name))

    def run(self, s: object, params: dict[str, object] | None = None) -> DataFrame:
        planner = self.planner(params)
        if isinstance(s, Select):
            if s.explain:
                return self._value(explain(planner, s), "plan")
            out = planner.select(s)
            return self._value(self.store(s.into, s.into_options, out, s.auto_id)) if s.into else out
        if isinstance(s, Pragma):
            return self._value(self.pragma(s.name, s.value) if s.assign else self.pragma(s.name))
        if isinstance(s, Command):
            if s.name in ("BEGIN", "COMMIT", "ROLLBACK"):
                return self._value(getattr(self, s.name.lower())())
            self._may_write()
            if s.name == "CHECKPOINT":
                return self._value(self.checkpoint())
            return self._value(self.rebuild(s.options.get("collation") if isinstance(s.options, dict) else None))
        self._may_write()
        c = self.collection(getattr(s, "collection", None) or s.name)
        if isinstance(s, Insert):
            return self._value(c.insert(s.documents, s.auto_id))
        if isinstance(s, Update):
            return self._value(c.update_where(s.document, s.where, params))
        if isinstance(s, Delete):
            return self._value(c.delete_where(s.where, params))
        if isinstance(s, CreateIndex):
            return self._value(c.ensure_index(s.name, s.text, s.unique))
        if isinstance(s, DropIndex):
            return self._value(c.drop_index(s.name))
        if isinstance(s, DropCollection):
            return self._value(self.drop_collection(s.name))
        if isinstance(s, RenameCollection):
            return self._value(self.rename_collection(s.name, s.to))
        raise TypeError(f"unknown statement {s!r}")

    def store(self, into: str, options: object, df: DataFrame, auto_id: str = "OBJECTID") -> int:
        """SELECT ... INTO: a collection, or a file."""
        if into.startswith("$"):
            write = WRITERS.get(into.lower())
            if write is None:
                raise ValueError(f"{into} can't be written")
            return write(self, options, df)
        self._may_write()
        return self.collection(into).insert_frame(df, auto_id)


def explain(planner: Planner, q: Select) -> dict:
    """The clauses of a query, and Spark's physical plan."""
    df = planner.select(Select(**{k: v for k, v in vars(q).items() if k not in ("explain", "into")}))
    out = {
        "collection": q.source,
        "fields": sorted({f for _, n in q.projection.fields for f in fields_of(n)} | {f for n in q.where for f in fields_of(n)}),
        "filters": len(q.where),
        "limit": q.limit if q.limit is not None else -1,
        "offset": q.offset,
        "physical": df._jdf.queryExecution().executedPlan().toString(),
    }
    if q.group_by is not None:
        out["groupBy"] = fields_of(q.group_by)
    if q.order_by is not None:
        out["orderBy"] = {"fields": fields_of(q.order_by), "order": -1 if q.descending else 1}
    if q.includes:
        out["include"] = [".".join(getattr(s, "name", "[*]") for s in p.steps) for p in q.includes]
    return out


class Collection:
    """One collection of a database: reads through queries, changes as new versions."""

    def __init__(self, db: Database, name: str, includes: tuple = ()):
        self.db, self.name, self.includes = db, name, includes

    # reading
    def query(self) -> Query:
        q = Query(self.db, self.name)
        for i in self.includes:
            q = q.include(i)
        return q

    def include(self, path: str) -> Collection:
        return Collection(self.db, self.name, (*self.includes, path))

    def to_df(self) -> DataFrame:
        return self.query().to_df()

    find_all = to_df

    def find(self, predicate: object = None, *args: object, skip: int = 0, limit: int | None = None, **params: object) -> DataFrame:
        q = self.query()
        if predicate is not None:
            q = q.where(predicate, *args, **params)
        if skip:
            q = q.skip(skip)
        return (q.limit(limit) if limit is not None else q).to_df()

    def find_one(self, predicate: object = None, *args: object, **params: object) -> object:
        return self.find(predicate, *args, limit=1, **params).first()

    def key(self) -> str:
        df, key = self.db.catalog.read(self.name)
        return (key or ["_id"])[0]

    def find_by_id(self, id_: object) -> object:
        return self.find(f"$.['{self.key()}'] = @0", id_, limit=1).first()

    def count(self, predicate: object = None, *args: object, **params: object) -> int:
        q = self.query()
        return (q if predicate is None else q.where(predicate, *args, **params)).count()

    long_count = count

    def exists(self, predicate: object = None, *args: object, **params: object) -> bool:
        q = self.query()
        return (q if predicate is None else q.where(predicate, *args, **params)).exists()

    def min(self, expression: str | None = None) -> object:
        """The least value, null included: null is less than all."""
        return self._end(expression, False)

    def max(self, expression: str | None = None) -> object:
        return self._end(expression, True)

    def _end(self, expression: str | None, descending: bool) -> object:
        e = expression or f"$.['{self.key()}']"
        q = self.query().order_by(e, descending=descending).limit(1).select(f"{{ v: {e} }}")
        row = q.to_df().first()
        return row["v"] if row is not None else None

    # changing
    def _entry(self) -> Entry:
        return self.db.catalog.entry(self.name, create=True)

    def _rows(self) -> DataFrame | None:
        return self.db.catalog.rows(self._entry())

    def insert(self, documents: dict | Iterable[dict], auto_id: str = "OBJECTID") -> int:
        docs = [documents] if isinstance(documents, dict) else list(documents)
        if not docs:
            return 0
        return self.insert_frame(changes.frame(self.db.spark, docs), auto_id)

    insert_bulk = insert

    def insert_frame(self, df: DataFrame, auto_id: str = "OBJECTID") -> int:
        self.db._may_write()
        old = self._rows()
        made_up = not any(c.lower() == "_id" for c in df.columns)
        new = checkpointed(changes.with_ids(df, old, auto_id))  # made-up ids must not change between the check and the write
        if not made_up:  # made-up ids are new
            changes.check_ids(new, old)
        n = new.count()
        self._add(new, old)
        return n

    def _add(self, new: DataFrame, old: DataFrame | None, files: dict[str, list[str]] | None = None) -> None:
        """Write rows beside the old ones, or in the place of those of some files."""
        catalog, e = self.db.catalog, self._entry()
        if old is None:
            self._unique(new)
            catalog.write(self.name, new)
            return
        types = {f.name: f.dataType for f in old.schema.fields}
        new, wide = changes.match_schema(new, old)
        rest = old if files is None else catalog.others(e, files)
        if any(f.dataType != types.get(f.name, f.dataType) for f in wide.schema.fields):  # a wider type is another file's type too
            out, rest = changes.match_schema(new, rest)
            out = rest.unionByName(out)
            self._unique(out)
            catalog.write(self.name, out)
            return
        if self._unique_indexes():
            out, rest = changes.match_schema(new, rest)
            self._unique(rest.unionByName(out))
        if files is None:
            catalog.append(self.name, new, wide.schema)
        else:
            catalog.replace(self.name, files, new, wide.schema)

    def _with_files(self, old: DataFrame, *columns: str) -> DataFrame:
        return old.select(*(columns or ["*"]), F.col("_metadata.file_path").alias("file"))

    def upsert(self, documents: dict | Iterable[dict], auto_id: str = "OBJECTID") -> int:
        """Replace documents with the same _id and insert the others; the number inserted."""
        self.db._may_write()
        docs = [documents] if isinstance(documents, dict) else list(documents)
        old = self._rows()
        new = checkpointed(changes.with_ids(changes.frame(self.db.spark, docs, old.schema if old is not None else None), old, auto_id))
        changes.check_ids(new, None)
        n = new.count()
        return n - self._put(new, old)

    def update(self, documents: dict | Iterable[dict]) -> int:
        """Replace whole documents by _id; the number found."""
        self.db._may_write()
        docs = [documents] if isinstance(documents, dict) else list(documents)
        old = self._rows()
        if old is None:
            return 0
        new = changes.frame(self.db.spark, docs, old.schema)
        found = new.join(old.select(F.col("_id").alias("__old")), F.col("_id") == F.col("__old"), "left_semi")
        return self._put(checkpointed(found), old)

    def _put(self, new: DataFrame, old: DataFrame | None) -> int:
        """Write documents in the place of those with the same _id; how many were there."""
        if old is None or old.isEmpty():
            self._add(new, old)
            return 0
        ids = new.select(F.col("_id").alias("__new"))
        same = F.col("_id") == F.col("__new")
        files, n = self.db.catalog.touched(self._entry(), self._with_files(old, "_id").join(ids, same, "left_semi"))
        if files:
            kept = self.db.catalog.rows(self._entry(), files).join(ids, same, "left_anti")
            new, kept = changes.match_schema(new, kept)
            new = kept.unionByName(new)
        self._add(new, old, files or None)
        return n

    def update_many(self, transform: str, predicate: str | None = None, *args: object, **params: object) -> int:
        """Merge the document ``transform`` into every document that fits."""
        return self.update_where(parse_expression(transform), parse_expression(predicate) if predicate else None, {str(k): v for k, v in enumerate(args)} | params)

    def update_where(self, document: Node, where: Node | None, params: dict | None = None) -> int:
        self.db._may_write()
        old, planner = self._rows(), self.db.planner(params)
        if old is None or old.isEmpty():
            return 0
        files, n = self.db.catalog.touched(self._entry(), self._with_files(old.filter(changes.matches(planner, old, where))))
        if n:
            self._add(changes.updated(planner, self.db.catalog.rows(self._entry(), files), document, where), old, files)
        return n

    def delete(self, id_: object) -> bool:
        return self.delete_many("$._id = @0", id_) > 0

    def delete_many(self, predicate: str, *args: object, **params: object) -> int:
        return self.delete_where(as_node(predicate), {str(k): v for k, v in enumerate(args)} | params)

    def delete_all(self) -> int:
        return self.delete_where(None)

    def delete_where(self, where: Node | None, params: dict | None = None) -> int:
        self.db._may_write()
        old, planner = self._rows(), self.db.planner(params)
        if old is None or old.isEmpty():
            return 0
        files, n = self.db.catalog.touched(self._entry(), self._with_files(old.filter(changes.matches(planner, old, where))))
        if n:
            kept = self.db.catalog.rows(self._entry(), files)
            self.db.catalog.replace(self.name, files, kept.filter(~changes.matches(planner, kept, where)), old.schema)
        return n

    # indexes: kept as metadata, and unique ones as rules; Spark prunes by file statistics
    def ensure_index(self, name: str, expression: str | None = None, unique: bool = False) -> bool:
        self.db._may_write()
        if expression is None:
            name, expression = re.sub(r"\W", "", name), name
        if name.startswith("$") or not re.fullmatch(r"\w+", name):
            raise ValueError(f"{name!r} isn't a name of an index")
        node = parse_expression(expression)
        if node == Path("$", parse_expression("_id").steps):
            return False
        if uses_source(node) or not fields_of(node) or "@" in re.sub(r"'[^']*'|\"[^\"]*\"", "", expression).replace("[@", "[") or any(f"{v}(" in expression.upper().replace(" ", "") for v in VOLATILE if f"{v}()" in expression.upper().replace(" ", "")):
            raise AnalysisError("an index needs an expression of fields, without parameters and volatile functions")
        e = self.db.catalog.entry(self.name, create=True)
        old = e.indexes.get(name)
        if old is not None:
            if old["expression"] != expression:
                raise ValueError(f"index {name} is there with another expression")
            return False
        e.indexes[name] = {"expression": expression, "unique": unique}
        try:
            rows = self._rows()
            if unique and rows is not None:
                self._unique(rows)
        except changes.DuplicateKey:
            del e.indexes[name]
            raise
        self.db.catalog.save()
        return True

    def drop_index(self, name: str) -> bool:
        self.db._may_write()
        found = self.db.catalog.entry(self.name).indexes.pop(name, None) is not None
        self.db.catalog.save()
        return found

    def _unique_indexes(self) -> dict[str, dict]:
        return {name: index for name, index in self._entry().indexes.items() if index["unique"]}

    def _unique(self, rows: DataFrame) -> None:
        from .plans.compiler import Compiler

        for name, index in self._unique_indexes().items():
            v = Compiler(self.db.planner().context(rows))(parse_expression(index["expression"]))
            if v.kind != "one":
                raise AnalysisError("a unique index needs one value a document")
            if rows.groupBy(v.col.alias("v")).count().filter("count > 1").limit(1).count():
                raise changes.DuplicateKey(f"unique index {name}")
