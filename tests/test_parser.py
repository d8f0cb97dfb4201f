import pytest

from docspark import ParseError, parse_expression, parse_statement
from docspark.language import parse_projection
from docspark.language.nodes import Binary, Lit, Path, Quantified, fields_of, uses_source


def test_operators_reduce_one_kind_at_a_time():
    assert parse_expression("10 - 5 + 2") == Binary("-", Lit(10), Binary("+", Lit(5), Lit(2)))
    assert parse_expression("8 / 2 * 4") == Binary("*", Binary("/", Lit(8), Lit(2)), Lit(4))
    assert parse_expression("a = 1 OR b = 2 AND c = 3").op == "OR"


def test_literals_strings_comments():
    assert parse_expression("-5") == Lit(-5)
    assert parse_expression("'a\\n\\u0041'") == Lit("a\nA")
    assert parse_expression("1 -- one\n + 2") == Binary("+", Lit(1), Lit(2))
    with pytest.raises(ParseError):
        parse_expression("1 +")
    with pytest.raises(ParseError):
        parse_expression("a ~ b")


def test_quantifiers_and_between():
    q = parse_expression("x[*] ANY BETWEEN 1 AND 5 AND y ALL = 3")
    assert q.op == "AND" and isinstance(q.left, Quantified) and q.left.op == "BETWEEN" and q.right.quantifier == "ALL"


def test_names_of_projections():
    names = [k for k, _ in parse_projection("a, a, b + c, COUNT(*), x AS y, z w").fields]
    assert names == ["a", "a1", "b_c", "expr", "y", "w"]
    assert parse_projection("$").document == Path("$")
    assert parse_projection("{ a: 1 }").document is not None
    assert parse_projection("EXTEND($, { a: 1 })").document is not None


def test_fields_and_source():
    assert fields_of(parse_expression("a.b + $.c[d = 1].e")) == ["a", "c"]
    assert uses_source(parse_expression("SUM(*.a) + 1")) and not uses_source(parse_expression("a * 2"))


def test_statements():
    s = parse_statement("SELECT $ INTO x:GUID FROM y INCLUDE a, b[*] WHERE a = 1 ORDER BY c DESC LIMIT 1 OFFSET 2 FOR UPDATE; SELECT 1")
    assert (s.into, s.auto_id, s.source, len(s.includes), s.descending, s.limit, s.offset, s.for_update) == ("x", "GUID", "y", 2, True, 1, 2, True)
    for text in ("INSERT INTO a VALUES {b: 1}", "UPDATE a SET b = 1 WHERE c = 2", "UPDATE a SET {b: 1}", "DELETE a", "CREATE UNIQUE INDEX i ON a (b.c)", "DROP INDEX a.i", "DROP COLLECTION a", "RENAME COLLECTION a TO b", "PRAGMA USER_VERSION = 3", "BEGIN TRANS", "COMMIT", "ROLLBACK", "CHECKPOINT", "REBUILD {collation: 'x'}", "EXPLAIN SELECT $ FROM a"):
        parse_statement(text)
    for text in ("SELECT", "INSERT a", "DELETE", "FROM x SELECT $", "SELECT $ FROM a LIMIT x", "DROP TABLE a"):
        with pytest.raises(ParseError):
            parse_statement(text)
