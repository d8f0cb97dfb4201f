import pytest

from docspark import AnalysisError, Database, DuplicateKey, Where, doc, fn, register_function, rows, stream_query


@pytest.fixture
def db(spark, tmp_path):
    return Database(spark, f"file://{tmp_path}/db")


def test_crud(db):
    c = db["people"]
    assert c.insert([{"_id": 1, "name": "John", "age": 30}, {"_id": 2, "name": "Ana", "tags": ["x"]}]) == 2
    with pytest.raises(DuplicateKey):
        c.insert({"_id": 1, "name": "again"})
    assert db.execute("INSERT INTO people VALUES { _id: 3, name: 'Zoe', age: 7 }").first()[0] == 1
    assert c.upsert([{"_id": 1, "name": "Johnny"}, {"_id": 9, "name": "New"}]) == 1
    assert c.find_by_id(1)["name"] == "Johnny" and c.find_by_id(1)["age"] is None
    assert db.execute("UPDATE people SET age = 5, extra = name + '!' WHERE age = null").first()[0] == 3
    assert c.find_by_id(9)["extra"] == "New!" and c.find_by_id(3)["extra"] is None
    assert c.update({"_id": 3, "name": "Z"}) == 1 and c.find_by_id(3)["age"] is None
    assert c.delete(3) and not c.delete(3)
    assert db.execute("DELETE people WHERE name LIKE 'J%'").first()[0] == 1
    assert c.count() == 2 and c.exists("_id = 9") and c.min() == 2 and c.max("_id") == 9
    assert c.delete_all() == 2 and c.count() == 0


def test_ids_indexes_names(db):
    c = db["auto"]
    c.insert([{"v": k} for k in range(60)], auto_id="INT")
    c.insert({"v": 100}, auto_id="INT")
    assert c.max("_id") == 61 and c.count() == 61
    db["other"].insert({"v": 1})
    assert len(db["other"].find_one()["_id"]) == 24
    assert c.ensure_index("byv", "v", unique=True) and not c.ensure_index("byv", "v", unique=True)
    assert not c.ensure_index("pk", "_id")
    with pytest.raises(ValueError):
        c.ensure_index("byv", "w")
    with pytest.raises(AnalysisError):
        c.ensure_index("bad", "v + @0")
    with pytest.raises(DuplicateKey):
        c.insert({"v": 100}, auto_id="INT")
    assert db.rename_collection("auto", "moved") and db.collection_exists("moved") and not db.collection_exists("auto")
    assert {r["name"] for r in db.execute("SELECT $ FROM $indexes").collect()} == {"_id", "byv"}
    assert db.execute("SELECT value FROM $sequences WHERE collection = 'moved'").first()[0] == 61
    assert db["moved"].drop_index("byv") and db.drop_collection("moved") and not db.drop_collection("moved")


def test_transactions_and_reopening(db, spark):
    db["t"].insert([{"_id": 1}, {"_id": 2}])
    before = db["t"].to_df()
    assert db.execute("BEGIN").first()[0] and not db.begin()
    db.execute("DELETE t WHERE _id = 1")
    assert db["t"].count() == 1
    assert db.rollback() and db["t"].count() == 2
    db.begin()
    db.execute("DELETE t WHERE _id = 1")
    assert db.commit()
    assert Database(spark, db.catalog.path)["t"].count() == 1
    assert before.count() == 2  # readers keep what they opened
    assert db.execute("PRAGMA USER_VERSION = 7").first()[0] and Database(spark, db.catalog.path).pragma("user_version") == 7


def test_files(db, tmp_path):
    db["c"].insert([{"_id": 1, "s": "a,b"}, {"_id": 2, "s": 'q"'}])
    for kind in ("csv", "json"):
        path = f"file://{tmp_path}/out.{kind}"
        assert db.execute(f"SELECT _id, s INTO $file('{path}') FROM c").first()[0] == 2
        assert {r["s"] for r in db.execute(f"SELECT s FROM $file({{ filename: '{path}' }})").collect()} == {"a,b", 'q"'}
    (tmp_path / "array.json").write_text('[{"_id": {"$oid": "5f0000000000000000000000"}, "d": {"$date": "2020-01-02T03:04:05Z"}, "n": {"$numberLong": "5"}}]')
    row = db.execute(f"SELECT YEAR(d) AS y, n + 1 AS n, LENGTH(_id) AS k FROM $file('file://{tmp_path}/array.json')").first()
    assert tuple(row) == (2020, 6, 24)


def test_queries_by_calls(db):
    c = db["people"]
    c.insert([{"_id": k, "name": n, "age": a, "tags": t} for k, n, a, t in ((1, "Ann", 30, ["x", "y"]), (2, "Bob", 25, []), (3, "Cid", 41, ["y"]))])
    q = c.query()
    assert q.where(doc.age > 26).where("name != @0", "Cid").select(doc.name).values() == ["Ann"]
    assert q.where("age > @0", 26).where("age < @0", 40).select("name").values() == ["Ann"]
    assert q.where(doc.tags.any("=", "y")).order_by(doc.age, descending=True).select("name").values() == ["Cid", "Ann"]
    assert q.where(Where.or_(Where.eq("name", "Bob"), Where.starts_with("name", "C"))).count() == 2
    assert q.where(doc.name.isin(["Ann"]) | doc.age.between(40, 50)).exists()
    assert q.group_by(fn("LENGTH", doc.name)).select("@key AS k, SUM(*.age) AS s").to_df().first() == (3, 96)
    assert q.select(total=rows.age.call("sum")).to_df().first()[0] == 96
    assert q.where("_id = 1").single()["name"] == "Ann"
    with pytest.raises(LookupError):
        q.single()
    with pytest.raises(LookupError):
        q.where("_id = 99").first()
    assert q.where("_id = 99").first_or_default() is None
    assert q.limit(2).count() == 2 and q.skip(1).limit(1).select("_id").values() == [2]
    assert q.where("age > 1").explain()["filters"] == 1
    assert q.where("age > 26").into("older") == 2 and db["older"].count() == 2
    with pytest.raises(AnalysisError):
        q.order_by("a").order_by("b")
    assert [r["c"] for r in db.execute("SELECT COUNT(tags) AS c FROM people ORDER BY _id").collect()] == [2, 0, 1]


def test_references(spark):
    cities = spark.createDataFrame([(1, "Porto", "A"), (2, "Lyon", "B")], "_id int, name string, state string")
    db = Database(spark).register("city", cities, "_id")
    refs = "named_struct('$id', {0}, '$ref', 'city')"
    people = spark.sql(f"select 1 as _id, {refs.format(1)} as home, array({refs.format(2)}, {refs.format(7)}, {refs.format(1)}) as been union all select 2, {refs.format(9)}, array() union all select 3, null, null")
    db.register("p", people, "_id")
    got = {r["_id"]: r for r in db.execute("SELECT _id, home, been FROM p INCLUDE home, been[*]").collect()}
    assert got[1]["home"]["name"] == "Porto" and got[1]["home"]["$id"] == 1 and got[1]["home"]["$ref"] is None
    assert got[2]["home"]["$missing"] and got[2]["home"]["$ref"] == "city" and got[3]["home"] is None
    assert [x["name"] for x in got[1]["been"]] == ["Lyon", None, "Porto"] and got[2]["been"] == [] and got[3]["been"] is None
    assert db.execute("SELECT _id FROM p INCLUDE home WHERE home.state = 'A'").collect() == [(1,)]


def test_plans_push_filters_and_columns(spark, data):
    db = Database(spark).register("o", spark.read.parquet(f"{data}/orders.parquet"), "o_orderkey")
    plan = db.execute("EXPLAIN SELECT o_orderkey FROM o WHERE o_totalprice > 1000 AND o_orderstatus = 'F'").first()[0]["physical"]
    scan = plan[plan.index("PushedFilters") :]
    assert "GreaterThan(o_totalprice,1000" in scan and "EqualTo(o_o" in scan
    assert "o_orderpriority" not in plan
    top = db.execute("SELECT o_orderkey FROM o ORDER BY o_totalprice DESC LIMIT 3")
    assert "TakeOrderedAndProject" in top._jdf.queryExecution().executedPlan().toString()


def test_collation(spark, data):
    db = Database(spark, collation="UTF8_LCASE").register("c", spark.read.parquet(f"{data}/customer.parquet"), "c_custkey")
    n = db.scalar("SELECT COUNT(*) FROM c WHERE c_mktsegment = 'building'")
    assert n == db.scalar("SELECT COUNT(*) FROM c WHERE c_mktsegment = 'BUILDING'") > 0


def test_functions_and_streams(spark, tmp_path):
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    register_function("TWICE", 1, lambda x: F.concat(x, x), T.StringType())
    db = Database(spark)
    assert db.scalar("SELECT TWICE('ab')") == "abab"
    spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string").write.json(f"{tmp_path}/in")
    stream = spark.readStream.schema("k int, v string").json(f"{tmp_path}/in")
    out = stream_query(db, stream, "SELECT UPPER(v) AS u FROM s WHERE k > @0", 1, name="s")
    q = out.writeStream.format("memory").queryName("got").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [r[0] for r in spark.table("got").collect()] == ["B"]
    with pytest.raises(AnalysisError):
        stream_query(db, stream, "SELECT COUNT(*) FROM s", name="s")


def test_read_only(spark):
    with pytest.raises(ValueError):
        Database(spark, read_only=True)["x"].insert({"a": 1})
