import io
from dataclasses import dataclass

from docspark import Database, FileStorage, Repository, connect
from docspark.connection import parse_connection
from docspark.shell import Shell


@dataclass
class Person:
    name: str
    age: int
    id: int | None = None


def test_connection_strings(spark, tmp_path):
    assert parse_connection("data.db") == {"filename": "data.db"}
    assert parse_connection("Filename='a b'; ReadOnly=true;") == {"filename": "a b", "readonly": "true"}
    assert connect(spark, ":memory:").catalog.path is None
    db = connect(spark, f"filename=file://{tmp_path}/x; collation=UTF8_LCASE")
    assert db.collation == "UTF8_LCASE" and connect(spark, "filename=:memory:;readonly=true").read_only


def test_repository(spark, tmp_path):
    r = Repository(Database(spark, f"file://{tmp_path}/db"))
    assert r.insert([Person("Ann", 30, 1), Person("Bob", 20, 2)]) == 2
    assert r.upsert(Person("Bobby", 21, 2)) == 0 and r.single_by_id(Person, 2)["name"] == "Bobby"
    assert r.update(Person("Anna", 31, 1)) and not r.update(Person("No", 1, 9))
    assert r.first(Person, "age > @0", 25)["name"] == "Anna"
    assert r.fetch(Person, "age < 100").count() == 2 and r.delete(Person, 1) and r.delete_many("Person", "age > @0", 0) == 1


def test_file_storage(spark, tmp_path):
    files = FileStorage(Database(spark, f"file://{tmp_path}/db"))
    data = bytes(range(256)) * 3000
    assert files.upload("$/a.bin", "a.bin", io.BytesIO(data))["chunks"] == 3
    files.upload("$/empty.txt", "empty.txt", b"")
    assert files.download("$/a.bin") == data and files.download("$/empty.txt") == b""
    assert files.find("length > @0", 10).count() == 1 and files.set_metadata("$/a.bin", "note")
    assert files.delete("$/a.bin") and not files.exists("$/a.bin")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "b.txt").write_bytes(data[:300_000])
    assert files.upload_folder(f"file://{tmp_path}/in") == 1 and files.download("$/b.txt") == data[:300_000]


def test_shell(spark, tmp_path):
    out = io.StringIO()
    shell = Shell(spark, f"file://{tmp_path}/db", out)
    for text in ("INSERT INTO c VALUES { _id: 1, a: 'x' }", "SELECT a FROM c", "show collections", "help", "version", "pretty", "SELECT nope(", "close", ""):
        assert shell.line(text)
    assert not shell.line("quit")
    assert '{"a": "x"}' in out.getvalue() and "ERROR" in out.getvalue()
