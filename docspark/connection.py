"""Connection strings, and a repository that names collections by type."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import asdict, is_dataclass

from pyspark.sql import DataFrame, SparkSession

from .database import Collection, Database
from .query import Query


def parse_connection(text: str) -> dict[str, str]:
    """``filename=...; collation=...; readonly=true``; a text without ``=`` is the file name."""
    if "=" not in text:
        return {"filename": text.strip()}
    out: dict[str, str] = {}
    for part in text.split(";"):
        key, _, value = part.partition("=")
        if key.strip():
            out[key.strip().lower()] = value.strip().strip("'\"")
    return out


def connect(spark: SparkSession, text: str) -> Database:
    """A database from a connection string; ``:memory:`` has no folder, and what belongs to page storage is ignored."""
    o = parse_connection(text)
    name = o.get("filename", ":memory:")
    return Database(spark, None if name in (":memory:", ":temp:", "") else name, o.get("collation"), o.get("readonly", "").lower() == "true")


def _document(x: object) -> dict:
    """A dictionary or dataclass as a document; a field ``id`` is its _id."""
    d = asdict(x) if is_dataclass(x) and not isinstance(x, type) else dict(x)
    return {"_id" if k == "id" else k: v for k, v in d.items() if not (k in ("id", "_id") and v is None)}


class Repository:
    """One place for all collections: each call takes a type, or a name, for the collection."""

    def __init__(self, db: Database):
        self.db = db

    @staticmethod
    def name(kind: type | str) -> str:
        return kind if isinstance(kind, str) else kind.__name__

    def collection(self, kind: type | str) -> Collection:
        return self.db.collection(self.name(kind))

    def query(self, kind: type | str) -> Query:
        return self.collection(kind).query()

    def insert(self, items: object, kind: type | str | None = None) -> int:
        docs = list(items) if isinstance(items, Iterable) and not isinstance(items, dict) else [items]
        return self.collection(kind or type(docs[0])).insert([_document(d) for d in docs])

    def upsert(self, items: object, kind: type | str | None = None) -> int:
        docs = list(items) if isinstance(items, Iterable) and not isinstance(items, dict) else [items]
        return self.collection(kind or type(docs[0])).upsert([_document(d) for d in docs])

    def update(self, item: object, kind: type | str | None = None) -> bool:
        return self.collection(kind or type(item)).update(_document(item)) > 0

    def delete(self, kind: type | str, id_: object) -> bool:
        return self.collection(kind).delete(id_)

    def delete_many(self, kind: type | str, predicate: str, *args: object) -> int:
        return self.collection(kind).delete_many(predicate, *args)

    def fetch(self, kind: type | str, predicate: object = None, *args: object) -> DataFrame:
        return self.collection(kind).find(predicate, *args)

    def first(self, kind: type | str, predicate: object, *args: object) -> object:
        return self.query(kind).where(predicate, *args).first()

    def single_by_id(self, kind: type | str, id_: object) -> object:
        return self.query(kind).where("_id = @0", id_).single()
