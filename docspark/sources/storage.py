"""Files kept in a database: their data in ``_files`` and their bytes, in chunks, in ``_chunks``."""

from __future__ import annotations

import datetime as dt
import mimetypes
from collections.abc import Iterable
from typing import BinaryIO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 255 * 1024


class FileStorage:
    """Upload, download, find and delete files of a database by id, such as ``$/photos/a.jpg``."""

    def __init__(self, db: object, files: str = "_files", chunks: str = "_chunks"):
        self.db, self.files, self.chunks = db, files, chunks

    def upload(self, id_: str, name: str, source: bytes | BinaryIO, metadata: str | None = None) -> dict:
        """Store one file's bytes from the driver; a file with the same id is replaced."""
        data = source if isinstance(source, bytes) else source.read()
        parts = [data[k : k + CHUNK_BYTES] for k in range(0, len(data), CHUNK_BYTES)]
        self.delete(id_)
        info = {"_id": id_, "filename": name, "mimeType": mimetypes.guess_type(name)[0] or "application/octet-stream", "length": len(data), "chunks": len(parts), "uploadDate": dt.datetime.now(dt.UTC).replace(microsecond=0)}
        if metadata is not None:
            info["metadata"] = metadata
        if parts:
            self.db[self.chunks].insert([{"_id": f"{id_}\x00{k:08d}", "f": id_, "n": k, "data": p} for k, p in enumerate(parts)])
        self.db[self.files].insert(info)
        return info

    def upload_folder(self, path: str, prefix: str = "$/") -> int:
        """Store all files that Spark's binaryFile source finds at a path, in tasks; the number of files."""
        found = self.db.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        name = F.element_at(F.split("path", "/"), -1)
        id_ = F.concat(F.lit(prefix), name)
        pieces = F.ceil(F.col("length") / CHUNK_BYTES).cast("int")
        chunks = found.filter("length > 0").select(id_.alias("f"), "content", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("n")).select(
            F.concat("f", F.lit("\x00"), F.lpad(F.col("n").cast("string"), 8, "0")).alias("_id"), "f", "n", F.substring("content", F.col("n") * CHUNK_BYTES + 1, F.lit(CHUNK_BYTES)).alias("data")
        )
        self.db[self.chunks].insert_frame(chunks)
        return self.db[self.files].insert_frame(found.select(id_.alias("_id"), name.alias("filename"), F.lit("application/octet-stream").alias("mimeType"), F.col("length"), pieces.alias("chunks"), F.col("modificationTime").alias("uploadDate")))

    def find(self, predicate: str | None = None, *args: object) -> DataFrame:
        return self.db[self.files].find(predicate, *args)

    def find_by_id(self, id_: str) -> object:
        return self.db[self.files].find_by_id(id_) if self.exists_any() else None

    def exists_any(self) -> bool:
        return self.db.collection_exists(self.files)

    def exists(self, id_: str) -> bool:
        return self.find_by_id(id_) is not None

    def open_chunks(self, id_: str) -> Iterable[bytes]:
        """The file's chunks in order, one partition at a time on the driver."""
        rows = self.db[self.chunks].query().where("f = @0", id_).order_by("n").select("data").to_df()
        for r in rows.toLocalIterator():
            yield bytes(r["data"])

    def download(self, id_: str) -> bytes:
        if not self.exists(id_):
            raise KeyError(f"no file {id_!r}")
        return b"".join(self.open_chunks(id_)) if self.db.collection_exists(self.chunks) else b""

    def set_metadata(self, id_: str, metadata: str) -> bool:
        return self.db[self.files].update_many("{ metadata: @0 }", "_id = @1", metadata, id_) > 0

    def delete(self, id_: str) -> bool:
        if not self.exists_any():
            return False
        if self.db.collection_exists(self.chunks):
            self.db[self.chunks].delete_many("f = @0", id_)
        return self.db[self.files].delete(id_)
