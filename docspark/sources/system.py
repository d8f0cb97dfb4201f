"""System collections: $name(options) as sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from .files import read_file, write_file

#: name -> (database, options) -> DataFrame
SYSTEM: dict[str, Callable[..., DataFrame]] = {}
#: name -> (database, options, rows) -> how many were written
WRITERS: dict[str, Callable[..., int]] = {}


def system(name: str, run: Callable[..., DataFrame], write: Callable[..., int] | None = None) -> None:
    """Add a system collection; ``run`` takes the database and the options, ``write`` the rows of SELECT ... INTO too."""
    SYSTEM[name.lower()] = run
    if write is not None:
        WRITERS[name.lower()] = write


def _cols(db: object, options: object) -> DataFrame:
    rows = [(n, "user" if n.lower() in db.catalog.entries else "view") for n in db.catalog.names()] + [(n, "system") for n in sorted(SYSTEM)]
    return db.spark.createDataFrame(rows, "name string, type string")


def _indexes(db: object, options: object) -> DataFrame:
    rows = [(e.name, "_id", "$._id", True) for e in db.catalog.entries.values()]
    rows += [(e.name, n, i["expression"], i["unique"]) for e in db.catalog.entries.values() for n, i in e.indexes.items()]
    return db.spark.createDataFrame(rows, "collection string, name string, expression string, unique boolean")


def _database(db: object, options: object) -> DataFrame:
    p = db.catalog.pragmas
    row = (db.catalog.path or ":memory:", len(db.catalog.entries), db.catalog.saved is not None, int(p["USER_VERSION"]), str(p["COLLATION"]))
    return db.spark.createDataFrame([row], "name string, collections int, transaction boolean, userVersion int, collation string")


def _sequences(db: object, options: object) -> DataFrame:
    rows = []
    for e in db.catalog.entries.values():
        df, _ = db.catalog.read(e.name)
        kind = dict(df.dtypes).get("_id")
        if kind in ("int", "bigint"):
            from pyspark.sql import functions as F

            rows.append((e.name, df.agg(F.max("_id")).first()[0] or 0))
    return db.spark.createDataFrame(rows, "collection string, value bigint")


def _transactions(db: object, options: object) -> DataFrame:
    return db.spark.createDataFrame([(1, "write")] if db.catalog.saved is not None else [], "transactionID int, mode string")


def _snapshots(db: object, options: object) -> DataFrame:
    """The folders that make up each collection's current version."""
    rows = [(k + 1, e.name, "write" if db.catalog.saved is not None else "read", f["path"], len(f["without"])) for e in db.catalog.entries.values() for k, f in enumerate(e.folders)]
    return db.spark.createDataFrame(rows, "snapshotID int, collection string, mode string, folder string, removedFiles int")


def _page_list(db: object, options: object) -> DataFrame:
    """The files of each collection, which are its pages here."""
    rows = []
    for e in db.catalog.entries.values():
        for f in e.folders:
            rows += [(len(rows) + k, "data", e.name, f"{f['path']}/{n}", size) for k, (n, size) in enumerate((x for x in db.catalog.files(f["path"]) if x[0] not in f["without"]), 1)]
    return db.spark.createDataFrame(rows, "pageID int, pageType string, collection string, file string, bytes bigint")


def _open_cursors(db: object, options: object) -> DataFrame:
    raise ValueError("$open_cursors: results are DataFrames, so no cursor stays open")


def _query(db: object, options: object) -> DataFrame:
    if not isinstance(options, str):
        raise ValueError("$query takes a statement")
    return db.execute(options)


system("$cols", _cols)
system("$indexes", _indexes)
system("$database", _database)
system("$sequences", _sequences)
system("$transactions", _transactions)
system("$snapshots", _snapshots)
system("$open_cursors", _open_cursors)
system("$page_list", _page_list)
system("$dump", _page_list)
system("$query", _query)
system("$file", lambda db, options: read_file(db.spark, options), lambda db, options, df: write_file(df, options))
