"""Values of expressions over one document, by the semantics: null is the least value, kinds have an order, nothing raises."""

import datetime as dt
import json
from decimal import Decimal

import pytest

from docspark import AnalysisError, Database, parse_expression
from docspark.language.parser import constant
from docspark.plans.compiler import Compiler, Context, root_of
from docspark.plans.planner import output
from docspark.plans.values import as_one, document, literal


@pytest.fixture(scope="module")
def evaluate(spark):
    """Evaluate many expressions over one document in one job."""

    def run(doc, cases, params=()):
        d = literal(constant(parse_expression(doc)))
        df = spark.range(1).select(*[output(k, v) for k, v in (d.parts or document({}).parts or {}).items()])
        compiler = Compiler(Context(root=root_of(df), params={str(k): literal(v) for k, v in enumerate(params)}))
        row = df.select(*[output(f"c{k}", as_one(compiler(parse_expression(text)))) for k, text in enumerate(cases)]).first()
        for k, (text, want) in enumerate(cases.items()):
            got = row[k]
            if isinstance(want, dict):
                got = json.loads(json.dumps(got.asDict(True), default=str))
            assert got == (pytest.approx(want) if isinstance(want, float) else want), text

    return run


ORCHARD = "{ trees: 48, owner: null, organic: false, rows: [7, 9, 11, 21], soil: { ph: 6, mix: { clay: 30, sand: 70 } }, crates: [{ kind: 'pear', kilos: 12 }, { kind: 'plum', kilos: 31 }, { kind: 'quince', kilos: 4 }] }"


def test_paths(evaluate):
    evaluate(
        ORCHARD,
        {
            "trees": 48, "$.trees": 48, "TREES": 48, "owner": None, "nothing.at.all": None, "soil.mix.sand": 70, "Soil.Mix": {"clay": 30, "sand": 70}, "soil.sand": None, "trees.ph": None,
            "rows[0]": 7, "rows[-2]": 11, "rows[40]": None, "rows[*]": [7, 9, 11, 21], "rows[@ > 10]": [11, 21], "crates[*].kind": ["pear", "plum", "quince"], "LAST(crates[@.kilos > 10].kind)": "plum",
            "FIRST(crates[kind = 'quince'].kilos)": 4, "crates[1].kilos": 31,
        },
    )
    evaluate("{ 'net weight': 85, box: { 'made in': 'Riga' } }", {"$.['net weight']": 85, "$.['net weight'] * 2": 170, "$.box.['made in']": "Riga"})


def test_documents_and_arrays(evaluate):
    evaluate(ORCHARD, {"{ trees }": {"trees": 48}, "{ n: trees, ph: soil.ph }": {"n": 48, "ph": 6}, "{ 'per row': trees / 4 }": {"per row": 12}, "[trees, soil.ph * 10]": [48, 60], "{ soil }": {"soil": {"ph": 6, "mix": {"clay": 30, "sand": 70}}}})


def test_arithmetic(evaluate):
    evaluate(
        "{ p: 14, q: 4, r: 2.5, s: 'kilo' }",
        {
            "p + q": 18, "p * q": 56, "p % q": 2, "p / 7": 2.0, "r * 2.0": 5.0, "p - q - q": 6, "q + p * r": 39.0, "(q + p) * r": 45.0, "-14 % 5": -4, "9.5 % 3.0": 0.5, "s + 'gram'": "kilogram", "s + q": "kilo4", "4 + s": "4kilo",
            "2147483640 + p": -2147483642, "p * 1000000000": 14_000_000_000 - 3 * (1 << 32), "true + p": None, "p / 0 > 1000": True, "s - 1": None,
        },
    )


def test_comparison(evaluate):
    evaluate(
        "{ p: 14, s: 'kilo', none: null }",
        {
            "p > 13.5": True, "p >= 14": True, "p < 14.0": False, "p <= 3": False, "p = 14.0": True, "p != 14": False, "p BETWEEN 14 AND 20": True, "s BETWEEN 'a' AND 'k'": False, "p > 10 AND s = 'kilo'": True,
            "p = 1 OR s = 'x' OR p = 14": True, "p < s": True, "s < p": False, "s < true": True, "none = null": True, "absent = none": True, "none < p": True, "absent > p": False, "null <= absent": True, "p != null": True,
            "p IN [3, 14]": True, "p IN 14": True, "s IN ['gram']": False, "absent IN [p, null]": True, "MINVALUE() < absent": True, "MAXVALUE() > s": True,
        },
    )


def test_like(evaluate):
    evaluate(
        "{ birds: ['heron', 'wren', 'hen harrier'], path: 'c\\\\d' }",
        {
            "'heron' LIKE 'h%'": True, "'heron' LIKE '%ro%'": True, "'heron' LIKE 'h_r_n'": True, "'heron' LIKE 'her'": False, "'heron' LIKE '%x%'": False, "'7' LIKE 7": False, "null LIKE '%'": False, "path LIKE 'c\\\\_'": True,
            "ARRAY(MAP(birds[*] => (@ LIKE '%en%')))": [False, True, True], "ARRAY(birds[@ LIKE 'h%'])": ["heron", "hen harrier"],
        },
    )


def test_quantifiers(evaluate):
    evaluate(
        ORCHARD,
        {
            "rows ALL > 6": True, "rows ALL > 7": False, "rows ANY > 20": True, "rows ANY = 8": False, "rows ANY != 7": True, "rows ALL != 8": True, "rows ALL BETWEEN 7 AND 21": True, "rows ANY BETWEEN 12 AND 20": False,
            "rows ANY IN [1, 9]": True, "rows ALL IN [7, 9]": False, "crates[*].kind ANY LIKE 'qu%'": True, "crates[*].kind ALL LIKE 'p%'": False, "rows[@ > 99] ANY = 7": False, "rows[@ > 99] ALL = 7": True, "rows ANY <= 7": True, "rows ALL < 21": False,
        },
    )


def test_lambdas(evaluate):
    evaluate(
        ORCHARD,
        {
            "ARRAY(MAP(rows[*] => @ * 2))": [14, 18, 22, 42], "ARRAY(MAP(rows[*] => (@ + $.soil.ph)))": [13, 15, 17, 27], "ARRAY(FILTER(rows[*] => @ % 3 = 0))": [9, 21], "ARRAY(SORT(rows[*] => (0 - @)))": [21, 11, 9, 7],
            "ARRAY(SORT(crates[*].kind => LENGTH(@), -1))": ["quince", "pear", "plum"], "ARRAY(SORT(rows[*] => @, 'desc'))": [21, 11, 9, 7], "ARRAY(SORT(rows[*] => @, 1))": [7, 9, 11, 21], "SUM(MAP(crates[*] => @.kilos))": 47, "ANY(FILTER(rows[*] => @ > 50))": False,
            "ARRAY(MAP(ITEMS(trees) => (@ = $.trees)))": [True],
        },
    )


def test_strings(evaluate):
    evaluate(
        "{ title: 'Salt and pepper', blank: '', list: [4, null, 6], wide: '  mint ' }",
        {
            "UPPER(title)": "SALT AND PEPPER", "LOWER('Basil')": "basil", "LOWER(5)": None, "SUBSTRING(title, 5)": "and pepper", "SUBSTRING(title, 9, 3)": "pep", "INDEXOF(title, 'pep')": 9, "INDEXOF(title, 'p', 10)": 11, "INDEXOF(title, 'q')": -1,
            "LPAD('305', 6, '*')": "***305", "RPAD('305', 6, '*')": "305***", "RPAD('30567', 2, '*')": "30567", "REPLACE(title, 'p', 'b')": "Salt and bebber", "TRIM(wide)": "mint", "LTRIM(wide)": "mint ", "RTRIM(wide)": "  mint",
            "LENGTH(title)": 15, "LENGTH(blank)": 0, "LENGTH(list)": 3, "LENGTH(absent)": 0, "LENGTH($)": 4, "LENGTH(12)": None, "ARRAY(SPLIT('sage;;thyme;', ';'))": ["sage", "thyme"], "ARRAY(SPLIT('sage;;thyme', ';', true))": ["sage", "", "thyme"],
            "ARRAY(SPLIT('x|y', '|'))": ["x", "y"], "JOIN(list, '/')": "4//6", "JOIN(['dill', 7])": "dill7", "IS_MATCH(title, '^S.*r$')": True, "IS_MATCH(title, '\\\\d')": False, "IS_MATCH(8, '8')": False,
            "MATCH('lot 77-B', '(\\\\d+)-([A-Z])', 2)": "B", "MATCH('lot 77-B', '(?<no>\\\\d+)', 'no')": "77", "MATCH('lot', '(\\\\d+)', 1)": None, "STRING(0.25)": "0.25", "STRING(absent)": "",
        },
    )


def test_formats(evaluate):
    evaluate(
        "{ n: 98765.4321, k: 42, d: { $date: '2011-09-08T07:06:05.432Z' } }",
        {
            "FORMAT(n, 'N1')": "98,765.4", "FORMAT(n, 'F3')": "98765.432", "FORMAT(k, 'D5')": "00042", "FORMAT(k, 'X4')": "002A", "FORMAT(0.125, 'P1')": "12.5 %", "FORMAT(n, '#,##0.00')": "98,765.43", "FORMAT(k, '0000')": "0042", "FORMAT(0.5, '0%')": "50%",
            "FORMAT(d, 'dd.MM.yy HH:mm')": "08.09.11 07:06", "FORMAT('text', 'N1')": None,
        },
    )


def test_numbers_and_conversion(evaluate):
    evaluate(
        "{}",
        {
            "ABS(-8.5)": 8.5, "ABS('-8')": None, "ROUND(0.5, 0)": 0.0, "ROUND(1.5, 0)": 2.0, "ROUND(19, 3)": 19, "ROUND(DOUBLE(2.34567), 2)": 2.35, "POW(3, 4)": 81.0, "INT32(6.5)": 6, "INT32(7.5)": 8, "INT32(' 61 ')": 61, "INT32('6.1')": None,
            "INT32(8000000000)": None, "INT64('8000000000')": 8_000_000_000, "DOUBLE('6.25')": 6.25, "DOUBLE('6,25', 'fr-FR')": 6.25, "DOUBLE('six')": None, "DECIMAL('0.10')": Decimal("0.1"), "DECIMAL('2,5', 'it-IT')": Decimal("2.5"),
            "BOOLEAN('False')": False, "BOOL('true')": True, "BOOLEAN('1')": None, "BINARY('b2xpdmU=')": bytearray(b"olive"), "OBJECTID('0123')": None, "GUID('A0000000-0000-0000-0000-000000000001')": "a0000000-0000-0000-0000-000000000001",
            "IS_INT32(9)": True, "IS_INT(9)": True, "IS_INT64(9)": False, "IS_LONG(9000000000)": True, "IS_DOUBLE(9.5)": True, "IS_NUMBER('9')": False, "IS_NULL(absent)": True, "IS_STRING(absent)": False, "IS_ARRAY([9])": True, "IS_DOCUMENT({ k: 9 })": True,
            "IS_BOOL(1 = 2)": True, "IS_MINVALUE(MINVALUE())": True, "IS_MAXVALUE(9)": False, "COALESCE(absent, 'else')": "else", "IIF(3 > 2, 'more', 'less')": "more", "IIF(3 < 2, 10, 20)": 20,
        },
    )


DAY = "{ d: { $date: '2011-09-08T07:06:05.432Z' } }"


def test_dates(evaluate):
    evaluate(
        DAY,
        {
            "YEAR(d)": 2011, "MONTH(d)": 9, "DAY(d)": 8, "HOUR(d)": 7, "MINUTE(d)": 6, "SECOND(d)": 5, "YEAR(2011)": None, "DAY(DATEADD('d', -8, d))": 31, "MONTH(DATEADD('M', 5, d))": 2, "MINUTE(DATEADD('m', 55, d))": 1, "DATEADD('week', 1, d)": None,
            "DATEDIFF('d', d, DATE_UTC(2011, 9, 20))": 11, "DATEDIFF('h', d, DATE_UTC(2011, 9, 9))": 16, "DATEDIFF('y', d, DATE_UTC(2020, 9, 7))": 8, "DATEDIFF('y', d, DATE_UTC(2020, 9, 8))": 9, "DATEDIFF('M', d, DATE_UTC(2011, 12, 8))": 3,
            "DATETIME('yesterday')": None, "DATE(2011, 2, 30)": None, "DATETIME('9/8/2011 07:06')": dt.datetime(2011, 9, 8, 7, 6), "DATETIME('08.09.2011', 'de-DE')": dt.datetime(2011, 9, 8), "DATE('2011-09-08')": dt.datetime(2011, 9, 8),
            "d + 600000000 = DATEADD('m', 1, d)": True, "STRING(d)": "2011-09-08T07:06:05.432Z",
        },
    )


def test_dates_in_another_zone(evaluate, spark):
    """UTC functions and texts of dates don't depend on the session's zone; the others do."""
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        evaluate(
            DAY,
            {
                "STRING(d)": "2011-09-08T07:06:05.432Z", "HOUR(d)": 3, "STRING(DATETIME_UTC('2018-03-11T02:30:00'))": "2018-03-11T02:30:00.000Z", "STRING(DATETIME_UTC('2018-07-01 05:06'))": "2018-07-01T05:06:00.000Z",
                "STRING(DATETIME('2018-07-01 05:06'))": "2018-07-01T09:06:00.000Z", "STRING(DATETIME_UTC('2018-07-01T05:06:00+02:00'))": "2018-07-01T03:06:00.000Z", "STRING(DATETIME('2018-07-01T05:06:00Z'))": "2018-07-01T05:06:00.000Z",
                "STRING(DATE_UTC(2018, 11, 4))": "2018-11-04T00:00:00.000Z", "STRING(DATE(2018, 11, 4))": "2018-11-04T04:00:00.000Z", "STRING(DATE_UTC('31/12/2018', 'pt-PT'))": "2018-12-31T00:00:00.000Z", "STRING(DATETIME_UTC('12/31/2018 23:59:58'))": "2018-12-31T23:59:58.000Z",
                "DATETIME_UTC('bad')": None, "HOUR(TO_LOCAL(DATETIME_UTC('2018-01-01T12:00:00'))) - HOUR(DATETIME_UTC('2018-01-01T12:00:00'))": -5,
            },
        )
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_sequences(evaluate):
    evaluate(
        "{ leaf: 3 }",
        {
            "ARRAY(TOP([8, 6, 4, 2], 2))": [8, 6], "ARRAY(TOP([8], -1))": [], "ARRAY(UNION([8, 6], [6, 5]))": [8, 6, 5], "ARRAY(UNION(8, [8]))": [8], "ARRAY(EXCEPT([8, 6, 4], [6]))": [8, 4], "ARRAY(CONCAT([8], [8, 6]))": [8, 8, 6], "ARRAY(DISTINCT([8, 6, 8]))": [8, 6],
            "SUM([8, 6, 4])": 18, "AVG([8, 5])": 6.5, "MIN([8, 6])": 6, "MAX([8, 16])": 16, "MIN([8, null])": None, "MAX([8, null])": 8, "COUNT([8, null, 6])": 3, "SUM(['leaf'])": 0, "AVG(absent)": 0.0, "FIRST([8, 6])": 8, "LAST([8, 6])": 6, "ANY([8])": True,
            "ARRAY(KEYS({ stem: 1, root: 2 }))": ["stem", "root"], "ARRAY(VALUES({ stem: 1, root: 2 }))": [1, 2], "EXTEND($, { root: 9 })": {"leaf": 3, "root": 9}, "EXTEND($, { LEAF: 9 })": {"leaf": 9},
            "JSON('{stem: 5, root: \"oak\"}')": {"stem": 5, "root": "oak"}, "JSON('[unclosed')": None,
        },
    )


def test_parameters(evaluate):
    evaluate("{ rows: [7, 9, 11, 21] }", {"@0 * 10": 20, "rows[@0]": 11, "ARRAY(rows[@ > @1])": [11, 21], "@5": None}, params=(2, 9))


def test_source_aggregates(spark):
    df = spark.createDataFrame([(1, 40, "oak", [5, 8]), (2, 25, "ash", [8]), (4, 35, "elm", [2, 6, 8])], "k int, height int, name string, rings array<int>")
    db = Database(spark).register("t", df, "k")
    for text, want in {
        "SUM(*.height)": 100, "MAX(*.height)": 40, "AVG(*.height)": 100 / 3, "COUNT(*)": 3, "FIRST(*.name)": "oak", "LAST(*.name)": "elm", "*[1].name": "ash", "SUM(*.rings[*])": 37, "SUM(*.rings[@ > 5]) - 1": 29, "JOIN(*.name, '+')": "oak+ash+elm",
        "ARRAY(*.rings[*])": [5, 8, 8, 2, 6, 8], "ARRAY(MAP(*.name => UPPER(@)))": ["OAK", "ASH", "ELM"], "JOIN(MAP(*.rings[*] => (@ * 10)), ',')": "50,80,80,20,60,80", "COUNT(DISTINCT(*.rings[*]))": 4, "COUNT(DISTINCT(*.absent))": 1,
    }.items():
        assert db.scalar(f"SELECT {text} AS v FROM t") == (pytest.approx(want) if isinstance(want, float) else want), text


def test_errors(spark, data):
    db = Database(spark).register("n", spark.read.parquet(f"{data}/nation.parquet"), "n_nationkey")
    for text in (
        "SELECT $ FROM n WHERE n_name", "SELECT $ FROM n WHERE LOWER(n_name)", "SELECT $ FROM n WHERE SUM(*.n_nationkey) > 1", "SELECT n_name FROM n GROUP BY n_regionkey", "SELECT COUNT(*) FROM n GROUP BY n_name ORDER BY n_name",
        "SELECT MISSPELT(1)", "SELECT UPPER(1, 2)", "SELECT $ FROM n WHERE 1 = 1 AND n_regionkey", "SELECT FORMAT(1, 'Q7')",
    ):
        with pytest.raises(AnalysisError):
            db.execute(text)
    with pytest.raises(KeyError):
        db.execute("SELECT $ FROM elsewhere")
