"""Named methods of the query builder, pretty JSON files, and references to many collections."""

import datetime as dt

import pytest

from docspark import Database, doc, fn


@pytest.fixture(scope="module")
def ships(spark):
    rows = [(1, "Petrel", dt.datetime(2003, 4, 5, 6, 7, 8), [3, 9], 12.5, "17"), (2, " Tern", dt.datetime(2010, 12, 31, 23, 0, 0), [4], -2.25, "x"), (3, "", None, [], None, None)]
    return Database(spark).register("ships", spark.createDataFrame(rows, "_id int, name string, built timestamp, decks array<int>, draught double, code string"), "_id")


def values(ships, e):
    return ships["ships"].query().select(v=e).values()


def test_methods_of_strings(ships):
    t = doc.name.as_text
    for e, want in (
        (t.upper(), ["PETREL", " TERN", ""]), (t.trim().as_text.lower(), ["petrel", "tern", ""]), (t.length(), [6, 5, 0]), (t.index_of("e"), [1, 2, -1]), (t.substring(2, 2), ["tr", "er", ""]), (t.starts_with("Pe"), [True, False, False]),
        (t.ends_with("n"), [False, True, False]), (t.contains("tr"), [True, False, False]), (t.equals("Petrel"), [True, False, False]), (t.is_empty(), [False, False, True]), (t.char_at(1), ["e", "T", ""]), (t.concat("-", doc.code).as_text.length(), [9, 7, 1]),
        (t.pad_left(7, "*"), ["*Petrel", "** Tern", "*******"]), (t.is_match("^P"), [True, False, False]), (t.trim_start(), ["Petrel", "Tern", ""]),
    ):
        assert values(ships, e) == want
    with pytest.raises(AttributeError, match="upper"):
        t.shout()


def test_methods_of_dates_numbers_and_types(ships):
    d, n, c = doc.built.as_date, doc.draught.as_number, doc.code.convert
    for e, want in (
        (d.year(), [2003, 2010, None]), (d.add_hours(2).as_date.day(), [5, 1, None]), (d.add_years(-1).as_date.year(), [2002, 2009, None]), (d.date().as_date.hour(), [0, 0, None]), (d.format("yyyy/MM"), ["2003/04", "2010/12", None]),
        (n.abs(), [12.5, 2.25, None]), (n.round(0), [12.0, -2.0, None]), (c.int32(), [17, None, None]), (c.is_null(), [False, False, True]), (c.has_value(), [True, True, False]), (c.or_else("none"), ["17", "x", "none"]), (doc._id.convert.string(), ["1", "2", "3"]),
        (d.diff("year", fn("DATE_UTC", 2012, 12, 31)), [9, 2, None]),
    ):
        assert values(ships, e) == want


def test_methods_of_sequences(ships):
    s = doc.decks.as_items
    for e, want in (
        (s.first(), [3, 4, None]), (s.last(), [9, 4, None]), (s.count(), [2, 1, 0]), (s.sum(), [12, 4, 0]), (s.max(), [9, 4, None]), (s.element_at(1), [9, None, None]), (s.any(), [True, True, False]), (s.any(lambda x: x > 5), [True, False, False]),
        (s.all(lambda x: x > 3), [False, True, True]), (s.contains(4), [False, True, False]), (s.where(lambda x: x > 3).as_items.count(), [1, 1, 0]), (s.select(lambda x: x * 2).as_items.sum(), [24, 8, 0]), (s.order_by_descending(lambda x: x).as_items.first(), [9, 4, None]),
    ):
        assert values(ships, e) == want


@pytest.mark.parametrize("indent", [2, 4])
def test_pretty_json(ships, tmp_path, indent):
    path = f"file://{tmp_path}/out.json"
    assert ships.execute(f"SELECT _id, decks, name INTO $file({{ filename: '{path}', pretty: true, indent: {indent} }}) FROM ships").first()[0] == 3
    shown = "".join(p.read_text() for p in (tmp_path / "out.json").glob("part-*"))
    assert f'\n{" " * indent}"name"' in shown
    assert sorted((r["_id"], r["decks"], r["name"]) for r in ships.execute(f"SELECT $ FROM $file('{path}')").collect()) == [(1, [3, 9], "Petrel"), (2, [4], " Tern"), (3, [], "")]


def test_references_to_many_collections(spark):
    db = Database(spark)
    for k in range(101):
        db.register(f"port{k}", spark.range(1).selectExpr("cast(0 as int) as _id", f"{k} as depth"), "_id")
    df = spark.range(8).selectExpr("cast(id as int) as _id", "named_struct('$id', 0, '$ref', concat('port', id * 14)) as port")
    db.register("calls", df, "_id")
    got = db.execute("SELECT _id, port.depth AS depth FROM calls INCLUDE port").collect()
    assert sorted((r["_id"], r["depth"]) for r in got) == [(k, 14 * k) for k in range(8)]


def test_rows_that_repeat_keep_their_arrays(spark):
    db = Database(spark).register("port", spark.createDataFrame([(1, "Riga"), (2, "Oslo")], "_id int, name string"), "_id")
    rows = [(1, [1, 2]), (1, [1, 2]), (1, [2]), (2, []), (2, []), (3, None), (3, [2, 1, 2])]
    df = spark.createDataFrame(rows, "_id int, ids array<int>").selectExpr("_id", "transform(ids, x -> named_struct('$id', x, '$ref', 'port')) as ports")
    db.register("r", df, "_id")
    names = {1: "Riga", 2: "Oslo"}
    got = [(r["_id"], None if r["ports"] is None else [p["name"] for p in r["ports"]]) for r in db.execute("SELECT _id, ports FROM r INCLUDE ports[*]").collect()]
    assert sorted(map(str, got)) == sorted(str((k, None if ids is None else [names[x] for x in ids])) for k, ids in rows)
