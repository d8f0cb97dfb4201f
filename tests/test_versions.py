"""What changes write: one file for an inserted row, the files of changed rows, and what CHECKPOINT and REBUILD leave."""

import pytest

from docspark import Database, DuplicateKey
from docspark.sources.system import system


@pytest.fixture
def db(spark, tmp_path):
    return Database(spark, f"file://{tmp_path}/db")


def files(db, name="c"):
    return {r["file"] for r in db.execute("SELECT $ FROM $page_list").collect() if r["collection"] == name}


def test_an_insert_adds_a_file(db):
    c = db["c"]
    c.insert([{"_id": k, "v": k % 7} for k in range(100)])
    before = files(db)
    c.insert({"_id": 200, "v": 1})
    assert before < files(db) and len(files(db)) == len(before) + 1
    c.insert({"_id": 201, "w": "new"})
    assert c.find_by_id(201)["w"] == "new" and c.find_by_id(1)["w"] is None and c.count() == 102
    c.insert({"_id": 202, "v": 1 << 40})  # a wider type
    assert c.find_by_id(202)["v"] == 1 << 40 and c.find_by_id(3)["v"] == 3 and c.count() == 103
    with pytest.raises(DuplicateKey):
        c.insert({"_id": 200})


def test_changes_write_the_files_of_their_rows(db, spark):
    c = db["c"]
    c.insert_frame(spark.range(100).selectExpr("id as _id", "id % 10 as v").repartition(5))
    c.insert({"_id": 500, "v": 3})
    before = files(db)
    assert c.update_many("{ v: 77 }", "_id = 500") == 1 and c.find_by_id(500)["v"] == 77
    assert len(before & files(db)) == len(before) - 1
    assert c.delete(42) and not c.delete(42) and c.count() == 100 and len(before & files(db)) == len(before) - 2
    assert c.upsert([{"_id": 500, "v": 1}, {"_id": 501, "v": 2}]) == 1 and c.count() == 101 and c.find_by_id(500)["v"] == 1
    assert c.update([{"_id": 501, "v": 9}, {"_id": 999, "v": 9}]) == 1 and c.find_by_id(501)["v"] == 9 and not c.exists("_id = 999")
    assert c.delete_many("_id < 50") == 49 and c.count() == 52
    assert db.scalar("SELECT SUM(*.v) FROM c") == sum(k % 10 for k in range(50, 100)) + 10
    assert c.update_many("{ s: 'x' }", "_id = 60") == 1 and c.find_by_id(60)["s"] == "x" and c.find_by_id(61)["s"] is None
    assert c.update_many("{ v: 0.5 }", "_id = 60") == 1 and c.find_by_id(60)["v"] == 0.5 and c.find_by_id(61)["v"] == 1
    assert c.delete_all() == 52 and c.count() == 0 and c.delete_all() == 0
    assert c.upsert({"_id": 1, "v": 1}) == 1 and c.count() == 1


def test_checkpoint_and_rebuild(db, spark):
    c = db["c"]
    c.insert([{"_id": k} for k in range(10)])
    for k in range(10, 14):
        c.insert({"_id": k})
    c.delete(3)
    db["d"].insert({"_id": 1})
    db.drop_collection("d")
    db.begin()
    with pytest.raises(ValueError):
        db.execute("CHECKPOINT")
    db.rollback()
    assert db.execute("CHECKPOINT").first()[0] == 1 and c.count() == 13 and db.execute("CHECKPOINT").first()[0] == 0
    assert db.execute("REBUILD").first()[0] == 1 and c.count() == 13
    assert db.execute("SELECT COUNT(*) AS n FROM $snapshots").first()[0] == 1
    assert db.execute("REBUILD").first()[0] == 0 and Database(spark, db.catalog.path)["c"].count() == 13
    assert db.execute("REBUILD { collation: 'UTF8_LCASE' }").first()[0] == 0 and db.collation == "UTF8_LCASE"


def test_unique_indexes_hold_over_files(db):
    c = db["c"]
    c.insert([{"_id": 1, "v": "a"}, {"_id": 2, "v": "b"}])
    c.ensure_index("byv", "v", unique=True)
    c.insert({"_id": 3, "v": "c"})
    for change in (lambda: c.insert({"_id": 4, "v": "a"}), lambda: c.update_many("{ v: 'a' }", "_id = 3"), lambda: c.upsert({"_id": 3, "v": "b"})):
        with pytest.raises(DuplicateKey):
            change()
    assert c.count() == 3 and c.find_by_id(3)["v"] == "c"


def test_writable_system_collections(db):
    kept = []
    system("$sink", lambda db, options: db.spark.createDataFrame(kept, "v int"), lambda db, options, df: kept.extend(df.collect()) or len(kept))
    assert db.execute("SELECT 5 AS v INTO $sink").first()[0] == 1 and db.execute("SELECT v FROM $sink").first()[0] == 5
    with pytest.raises(ValueError):
        db.execute("SELECT 5 AS v INTO $cols")
    with pytest.raises(ValueError):
        db.execute("SELECT $ FROM $open_cursors")
