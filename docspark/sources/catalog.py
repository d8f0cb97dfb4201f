"""The catalog: collections, their keys, indexes and versions.

A stored collection is a list of folders of Parquet, each perhaps without some of its files; the
catalog file names the current ones.  An insert adds a folder; an update or delete writes a new
folder for the rows of the files that have a row to change, and takes those files away.  Each statement
writes first and replaces the catalog file last, so readers keep what they opened.  In a
transaction the new catalog stays in memory until COMMIT; ROLLBACK forgets it.  CHECKPOINT removes
folders that no collection names, REBUILD writes each collection in one folder.  Views are
DataFrames of the session, read-only.
"""

from __future__ import annotations

import copy
import json
import re
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import file_system

SYSTEM_PREFIX = "$"


@dataclass
class Entry:
    name: str
    folders: list[dict] = field(default_factory=list)  # path, and the names of files that don't count any more (without)
    schema: dict | None = None  # of the rows; files may lack columns
    indexes: dict[str, dict] = field(default_factory=dict)
    key: list[str] = field(default_factory=lambda: ["_id"])


class Catalog:
    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path.rstrip("/") if path else None
        self.views: dict[str, tuple[str, DataFrame, list[str]]] = {}
        self.references: dict[tuple[str, str], list[str]] = {}  # (collection, path) -> collections that references there name
        self.entries: dict[str, Entry] = {}
        self.pragmas: dict[str, object] = {"USER_VERSION": 0, "COLLATION": "UTF8_BINARY", "TIMEOUT": 60, "LIMIT_SIZE": (1 << 63) - 1, "UTC_DATE": True, "CHECKPOINT": 1000}
        self.saved: tuple | None = None  # the state before BEGIN
        if self.path:
            self._load()

    # the catalog file, wherever Spark can write
    def _hadoop(self, path: str) -> tuple:
        return file_system(self.spark, path)

    def _load(self) -> None:
        fs, p = self._hadoop(f"{self.path}/catalog.json")
        if not fs.exists(p):
            return
        stream = fs.open(p)
        text = bytes(stream.readAllBytes()).decode()
        stream.close()
        state = json.loads(text)
        self.entries = {e["name"].lower(): Entry(**e) for e in state["collections"]}
        self.pragmas |= state["pragmas"]

    def save(self) -> None:
        """Replace the catalog file, unless a transaction is open."""
        if self.saved is not None or not self.path:
            return
        state = json.dumps({"collections": [vars(e) for e in self.entries.values()], "pragmas": self.pragmas})
        fs, new = self._hadoop(f"{self.path}/catalog-{uuid.uuid4().hex}.json")
        stream = fs.create(new, True)
        stream.write(bytearray(state.encode()))
        stream.close()
        _, old = self._hadoop(f"{self.path}/catalog.json")
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(old.toUri(), self.spark._jsc.hadoopConfiguration())
        overwrite = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = overwrite
        context.rename(new, old, options)

    def begin(self) -> bool:
        if self.saved is not None:
            return False
        self.saved = (copy.deepcopy(self.entries), dict(self.pragmas))
        return True

    def commit(self) -> bool:
        open_, self.saved = self.saved is not None, None
        if open_:
            self.save()
        return open_

    def rollback(self) -> bool:
        if self.saved is None:
            return False
        (self.entries, self.pragmas), self.saved = self.saved, None
        return True

    # collections
    def names(self) -> list[str]:
        return sorted({e.name for e in self.entries.values()} | {v[0] for v in self.views.values()})

    def add_view(self, name: str, df: DataFrame, key: list[str] | str | None = None) -> None:
        self.views[name.lower()] = (name, df, [key] if isinstance(key, str) else list(key or []))

    def read(self, name: str) -> tuple[DataFrame, list[str]]:
        low = name.lower()
        if low in self.entries:
            e = self.entries[low]
            rows = self.rows(e)
            return self.spark.createDataFrame([], "_id string") if rows is None else rows, e.key
        if low in self.views:
            _, df, key = self.views[low]
            return df, key
        raise KeyError(f"no collection {name!r}")

    def entry(self, name: str, create: bool = False) -> Entry:
        low = name.lower()
        if name.startswith(SYSTEM_PREFIX):
            raise ValueError(f"{name} isn't a collection that can change")
        if low in self.views:
            raise ValueError(f"{name} is a view, which can't change")
        if low not in self.entries:
            if not create:
                raise KeyError(f"no collection {name!r}")
            self.entries[low] = Entry(name)
        return self.entries[low]

    def has(self, name: str) -> bool:
        return name.lower() in self.entries or name.lower() in self.views

    # the rows of stored collections
    def rows(self, e: Entry, files: dict[str, list[str]] | None = None) -> DataFrame | None:
        """All current rows, or those of some files by folder; None where there never were any."""
        if e.schema is None:
            return None
        schema = T.StructType.fromJson(e.schema)
        paths = [f"{folder}/{n}" for folder, names in files.items() for n in names] if files is not None else self._paths(e)
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _paths(self, e: Entry) -> list[str]:
        out: list[str] = []
        for f in e.folders:
            gone = set(f["without"])
            out += [f"{f['path']}/{n}" for n, _ in self.files(f["path"]) if n not in gone] if gone else [f["path"]]
        return out

    def files(self, folder: str) -> list[tuple[str, int]]:
        """Names and bytes of a folder's Parquet files."""
        fs, p = self._hadoop(folder)
        return sorted((s.getPath().getName(), s.getLen()) for s in fs.listStatus(p) if s.getPath().getName().startswith("part-"))

    def _new_folder(self, e: Entry, df: DataFrame) -> dict:
        if not self.path:
            raise ValueError("this database has no folder to write to")
        folder = f"{self.path}/{e.name}/{uuid.uuid4().hex}"
        df.write.parquet(folder)
        return {"path": folder, "without": []}

    def write(self, name: str, df: DataFrame) -> None:
        """A new version of all of a collection's rows."""
        e = self.entry(name, create=True)
        e.folders, e.schema = [self._new_folder(e, df)], df.schema.jsonValue()
        self.save()

    def append(self, name: str, df: DataFrame, schema: T.StructType) -> None:
        """Rows more; ``schema`` is that of the collection with them."""
        e = self.entry(name, create=True)
        e.folders, e.schema = [*e.folders, self._new_folder(e, df)], schema.jsonValue()
        self.save()

    def touched(self, e: Entry, rows: DataFrame) -> tuple[dict[str, list[str]], int]:
        """Files, by folder, of stored rows that have a column ``file``, and the rows' number, in one pass; a row for each file."""
        by_name = {f["path"].rsplit("/", 1)[-1]: f["path"] for f in e.folders}
        files: dict[str, list[str]] = {}
        n = 0
        for r in rows.groupBy("file").agg(F.count(F.lit(1)).alias("n")).collect():
            folder, name = r["file"].rsplit("/", 2)[-2:]
            files.setdefault(by_name[folder], []).append(name)
            n += r["n"]
        return files, n

    def replace(self, name: str, files: dict[str, list[str]], df: DataFrame, schema: T.StructType) -> None:
        """Rows in the place of those of some files."""
        e = self.entry(name)
        new = self._new_folder(e, df)
        kept = [{"path": f["path"], "without": sorted({*f["without"], *files.get(f["path"], ())})} for f in e.folders]
        e.folders, e.schema = [*kept, new], schema.jsonValue()
        self.save()

    def others(self, e: Entry, files: dict[str, list[str]]) -> DataFrame | None:
        """The rows of all files but some."""
        rest = Entry(e.name, [{"path": f["path"], "without": [*f["without"], *files.get(f["path"], ())]} for f in e.folders], e.schema)
        return self.rows(rest)

    def clean(self) -> int:
        """Remove folders that no collection names; how many.  What still reads them fails from then on."""
        if self.saved is not None:
            raise ValueError("a transaction is open")
        if not self.path:
            return 0
        named = {f["path"].rsplit("/", 1)[-1] for e in self.entries.values() for f in e.folders}
        fs, top = self._hadoop(self.path)
        removed = 0
        for at in [s.getPath() for s in fs.listStatus(top) if s.isDirectory()] if fs.exists(top) else []:
            for s in fs.listStatus(at):
                name = s.getPath().getName()
                if s.isDirectory() and re.fullmatch(r"[0-9a-f]{32}", name) and name not in named:
                    removed += bool(fs.delete(s.getPath(), True))
        return removed

    def rebuild(self) -> int:
        """Write every collection that is in several folders, or lacks files of one, in one folder; how many."""
        todo = [e for e in self.entries.values() if len(e.folders) > 1 or any(f["without"] for f in e.folders)]
        for e in todo:
            self.write(e.name, self.rows(e))
        self.clean()
        return len(todo)

    def drop(self, name: str) -> bool:
        found = self.entries.pop(name.lower(), None) is not None
        self.save()
        return found

    def rename(self, name: str, to: str) -> bool:
        if self.has(to):
            raise ValueError(f"{to} is there already")
        if name.lower() not in self.entries:
            return False
        e = self.entries.pop(name.lower())
        e.name = to
        self.entries[to.lower()] = e
        self.save()
        return True
