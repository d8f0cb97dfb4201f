"""Queries over the test tables, one or more for each operator and function, with the same in DuckDB's SQL."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .database import Database
from .sources import shared

KEYS = {
    "region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id",
    "documents": "doc_id", "labels": "doc_id", "embeddings": "vec_id", "pages": "page_id", "benchmark": "item_id",
    "lineitem": ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"],
    "conversations": ["conv_id", "turn"],
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def database(spark: SparkSession, sf_dir: str, tables: tuple[str, ...], collation: str | None = None, path: str | None = None) -> Database:
    db = Database(spark, path, collation)
    for t in tables:
        db.register(t, spark.read.parquet(f"{sf_dir}/{t}.parquet"), KEYS[t])
    return db


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors share."""
    return shared.scratch(spark, "docspark")


def statement(name: str, tables: str, text: str, sql: str | None, *args: object, collation: str | None = None) -> None:
    """A query of one statement."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return database(spark, sf_dir, tuple(tables.split()), collation).execute(text, *args)

    QUERIES[name] = run
    if sql:
        ORACLE_SQL[name] = sql


def query(name: str, sql: str | None) -> Callable:
    def put(run: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = sql
        return run

    return put


# scans and projections
statement("scan_all", "nation", "SELECT $ FROM nation", "select * from nation")
statement("proj_doc", "customer", "SELECT { id: c_custkey, name: c_name, bal2: c_acctbal * 2 } FROM customer", "select c_custkey as id, c_name as name, c_acctbal * 2 as bal2 from customer")
statement("proj_alias", "nation", "SELECT n_name AS name, n_regionkey, n_nationkey + n_regionkey FROM nation", "select n_name as name, n_regionkey, n_nationkey + n_regionkey as n_nationkey_n_regionkey from nation")
statement("proj_extend", "region", "SELECT EXTEND($, { upper: UPPER(r_name), r_regionkey: r_regionkey + 10 }) FROM region", "select r_regionkey + 10 as r_regionkey, r_name, upper(r_name) as upper from region")
statement("proj_duplicate_names", "region", "SELECT r_name, r_name, r_name FROM region", "select r_name, r_name as r_name1, r_name as r_name2 from region")
statement("proj_no_source", "region", "SELECT 10 - 5 + 2 AS a, 8 / 2 AS b, 'x' + 1 AS c", "select 3 as a, 4.0::double as b, 'x1' as c")
statement("case_insensitive_fields", "customer", "SELECT C_CUSTKEY AS k, $.c_NAME AS n FROM CUSTOMER WHERE C_Nationkey = 3", "select c_custkey as k, c_name as n from customer where c_nationkey = 3")

# predicates
for _name, _op, _sql in (("eq", "=", "="), ("ne", "!=", "<>"), ("gt", ">", ">"), ("gte", ">=", ">="), ("lt", "<", "<"), ("lte", "<=", "<=")):
    statement(f"flt_{_name}", "part", f"SELECT p_partkey, p_size FROM part WHERE p_size {_op} 25", f"select p_partkey, p_size from part where p_size {_sql} 25")
statement("flt_between", "orders", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 100000 AND 200000", "select o_orderkey, o_totalprice from orders where o_totalprice between 100000 and 200000")
statement("flt_in", "orders", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ['1-URGENT', '2-HIGH']", "select o_orderkey from orders where o_orderpriority in ('1-URGENT', '2-HIGH')")
statement("flt_like_prefix", "customer", "SELECT c_custkey FROM customer WHERE c_mktsegment LIKE 'B%'", "select c_custkey from customer where c_mktsegment like 'B%'")
statement("flt_like_infix", "part", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%1_%' AND p_type LIKE '%E%'", "select p_partkey, p_name from part where p_name like '%1_%' and p_type like '%E%'")
statement("flt_and_or", "orders", "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' OR o_orderstatus = 'P') AND o_totalprice > @0", "select o_orderkey from orders where (o_orderstatus = 'F' or o_orderstatus = 'P') and o_totalprice > 250000", 250000)
statement("flt_date_param", "orders", "SELECT o_orderkey FROM orders WHERE o_orderdate >= { $date: '1997-01-01T00:00:00Z' } AND YEAR(o_orderdate) = 1997", "select o_orderkey from orders where o_orderdate >= timestamp '1997-01-01' and year(o_orderdate) = 1997")
statement("flt_null_order", "events", "SELECT event_id FROM events WHERE INT(event_type) < 5", "select event_id from events where try_cast(event_type as integer) is null or try_cast(event_type as integer) < 5")
statement("flt_null_eq", "documents labels", "SELECT doc_id FROM documents WHERE INT(lang) = null AND n_chars != null", "select doc_id from documents where try_cast(lang as integer) is null")
statement("flt_cross_type", "nation", "SELECT n_nationkey FROM nation WHERE n_nationkey < 'a' AND n_name > 5", "select n_nationkey from nation")

# quantified operators, over an array of 64 numbers and over words
_QUANTIFIED = (
    ("eq", "= 0", "x = 0"), ("ne", "!= 0", "x <> 0"), ("gt", "> 0.3", "x > 0.3"), ("gte", ">= 0.3", "x >= 0.3"), ("lt", "< 0.45", "x < 0.45"), ("lte", "<= 0.45", "x <= 0.45"),
    ("between", "BETWEEN -0.4 AND 0.4", "x between -0.4 and 0.4"), ("in", "IN [0.5, 1, 2]", "x in (0.5, 1, 2)"),
)
for _name, _op, _sql in _QUANTIFIED:
    for _q, _f in (("ANY", "list_bool_or"), ("ALL", "list_bool_and")):
        statement(f"flt_{_q.lower()}_{_name}", "embeddings", f"SELECT vec_id FROM embeddings WHERE embedding {_q} {_op}", f"select vec_id from embeddings where coalesce({_f}(list_transform(embedding, lambda x: {_sql})), {str(_q == 'ALL').lower()})")
    del _q, _f
statement("flt_any_like", "documents", "SELECT doc_id FROM documents WHERE SPLIT(text, ' ') ANY LIKE 'on%nt'", "select doc_id from documents where list_bool_or(list_transform(string_split(text, ' '), lambda x: x like 'on%nt'))")
statement("flt_all_like", "documents", "SELECT doc_id FROM documents WHERE SPLIT(text, ' ') ALL LIKE '%e%'", "select doc_id from documents where coalesce(list_bool_and(list_transform(list_filter(string_split(text, ' '), lambda x: x <> ''), lambda x: x like '%e%')), true)")
statement("flt_any_constant_list", "customer", "SELECT c_custkey FROM customer WHERE [1, 5, 9] ANY = c_nationkey", "select c_custkey from customer where c_nationkey in (1, 5, 9)")

# arithmetic
statement("arith_precedence", "lineitem", "SELECT l_orderkey, l_linenumber, l_quantity - 5 + l_linenumber AS a, l_quantity / 2 * 4 AS b, l_orderkey % 7 AS c FROM lineitem", "select l_orderkey, l_linenumber, l_quantity - (5 + l_linenumber) as a, (l_quantity / 2) * 4 as b, l_orderkey % 7 as c from lineitem")
statement("arith_wrap", "nation", "SELECT n_nationkey, 2147483647 + n_nationkey AS w FROM nation", "select n_nationkey, cast(case when n_nationkey = 0 then 2147483647 else -2147483649 + n_nationkey::bigint end as integer) as w from nation")
statement("arith_zero", "nation", "SELECT n_nationkey, IS_NULL(n_nationkey % 0) AS m, 1 / n_nationkey > 5 AS inf FROM nation", "select n_nationkey, true as m, n_nationkey = 0 as inf from nation")
statement("arith_date_ticks", "orders", "SELECT o_orderkey, o_orderdate + 864000000000 AS next FROM orders", "select o_orderkey, o_orderdate + interval 1 day as next from orders")

# string functions
_FN = "documents"
for _name, _expr, _sql in (
    ("lower", "LOWER(text)", "lower(text)"),
    ("upper", "UPPER(lang)", "upper(lang)"),
    ("ltrim", "LTRIM('  ' + source)", "ltrim('  ' || source)"),
    ("rtrim", "RTRIM(source + '  ')", "rtrim(source || '  ')"),
    ("trim", "TRIM(' ' + source + ' ')", "trim(' ' || source || ' ')"),
    ("indexof", "INDEXOF(text, 'th')", "cast(strpos(text, 'th') - 1 as integer)"),
    ("indexof_from", "INDEXOF(source, 'c', 1)", "cast(case when strpos(substr(source, 2), 'c') = 0 then -1 else strpos(substr(source, 2), 'c') end as integer)"),
    ("substring", "SUBSTRING(text, 3)", "substr(text, 4)"),
    ("substring_length", "SUBSTRING(text, 1, 6)", "substr(text, 2, 6)"),
    ("replace", "REPLACE(source, 'src', 'from-')", "replace(source, 'src', 'from-')"),
    ("lpad", "LPAD(STRING(doc_id), 3, '0')", "case when length(cast(doc_id as varchar)) >= 3 then cast(doc_id as varchar) else lpad(cast(doc_id as varchar), 3, '0') end"),
    ("rpad", "RPAD(source, 8, 'x')", "case when length(source) >= 8 then source else rpad(source, 8, 'x') end"),
    ("split_count", "COUNT(SPLIT(text, ' '))", "len(list_filter(string_split(text, ' '), lambda x: x <> ''))"),
    ("split_regex", "COUNT(SPLIT(text, '[ ,.]', true))", "len(regexp_split_to_array(text, '[ ,.]'))"),
    ("join", "JOIN(TOP(SPLIT(text, ' '), 3), '-')", "array_to_string(list_filter(string_split(text, ' '), lambda x: x <> '')[1:3], '-')"),
    ("join_plain", "JOIN([lang, source, null])", "lang || source"),
    ("is_match", "IS_MATCH(text, '^[A-Z][a-z]+ ')", "regexp_matches(text, '^[A-Z][a-z]+ ')"),
    ("match", "MATCH(source, 'src(\\\\d+)', 1)", "regexp_extract(source, 'src(\\d+)', 1)"),
    ("match_named", "MATCH(source, '(?<name>[a-z]+)\\\\d', 'name')", "regexp_extract(source, '([a-z]+)\\d', 1)"),
    ("concat_null", "lang + missing + doc_id", "lang || cast(doc_id as varchar)"),
    ("length", "LENGTH(text)", "cast(length(text) as integer)"),
):
    statement(f"fn_str_{_name}", _FN, f"SELECT doc_id, {_expr} AS v FROM documents", f"select doc_id, {_sql} as v from documents")

# mathematics
for _name, _expr, _sql in (
    ("abs", "ABS(c_acctbal)", "abs(c_acctbal)"),
    ("round", "ROUND(c_acctbal, 0)", "round_even(c_acctbal, 0)"),
    ("pow", "POW(c_nationkey, 2)", "pow(c_nationkey, 2)"),
):
    statement(f"fn_math_{_name}", "customer", f"SELECT c_custkey, {_expr} AS v FROM customer", f"select c_custkey, {_sql} as v from customer")

# dates
for _part in ("YEAR", "MONTH", "DAY", "HOUR", "MINUTE", "SECOND"):
    statement(f"fn_date_{_part.lower()}", "events", f"SELECT event_id, {_part}(ts) AS v FROM events", f"select event_id, cast({_part.lower()}(ts) as integer) as v from events")
statement("fn_date_add", "orders", "SELECT o_orderkey, DATEADD('M', 1, o_orderdate) AS a, DATEADD('d', -3, o_orderdate) AS b, DATEADD('year', 2, o_orderdate) AS c, DATEADD('minute', 90, o_orderdate) AS d FROM orders", "select o_orderkey, o_orderdate + interval 1 month as a, o_orderdate - interval 3 day as b, o_orderdate + interval 2 year as c, o_orderdate + interval 90 minute as d from orders")
statement(
    "fn_date_diff", "orders",
    "SELECT o_orderkey, DATEDIFF('d', o_orderdate, DATE_UTC(1998, 1, 1)) AS d, DATEDIFF('h', o_orderdate, DATE_UTC(1998, 1, 1)) AS h, DATEDIFF('M', o_orderdate, DATE_UTC(1998, 1, 1)) AS m, DATEDIFF('y', o_orderdate, DATE_UTC(1998, 1, 1)) AS y FROM orders",
    """with t as (select *, timestamp '1998-01-01' as e from orders)
    select o_orderkey, cast(trunc(epoch_us(e) / 864e8 - epoch_us(o_orderdate) / 864e8) as integer) as d, cast(trunc((epoch_us(e) - epoch_us(o_orderdate)) / 36e8) as integer) as h,
    cast(trunc((1998 - year(o_orderdate)) * 12 + 1 - month(o_orderdate) + (1 - day(o_orderdate)) / 31.0) as integer) as m,
    cast(1998 - year(o_orderdate) - case when 1 < month(o_orderdate) or (1 = month(o_orderdate) and 1 < day(o_orderdate)) then 1 else 0 end as integer) as y from t""",
)
statement("fn_date_make", "orders", "SELECT o_orderkey, DATETIME(YEAR(o_orderdate), MONTH(o_orderdate), 1) AS v FROM orders", "select o_orderkey, date_trunc('month', o_orderdate)::timestamp as v from orders")
statement("fn_date_format", "orders", "SELECT o_orderkey, FORMAT(o_orderdate, 'yyyy-MM-dd HH:mm') AS v FROM orders", "select o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M') as v from orders")
statement("fn_date_local_utc", "orders", "SELECT o_orderkey, TO_LOCAL(o_orderdate) AS l, TO_UTC(o_orderdate) AS u FROM orders", "select o_orderkey, o_orderdate as l, o_orderdate as u from orders")

# conversion and tests of types
statement(
    "fn_conv", "customer",
    "SELECT c_custkey, INT32(c_acctbal) AS i, INT64(c_acctbal) AS l, DOUBLE(c_nationkey) AS d, STRING(c_nationkey) AS s, INT(c_name) AS bad, BOOLEAN('TRUE') AS b, LONG('12') AS n FROM customer",
    "select c_custkey, cast(round_even(c_acctbal, 0) as integer) as i, cast(round_even(c_acctbal, 0) as bigint) as l, cast(c_nationkey as double) as d, cast(c_nationkey as varchar) as s, cast(null as integer) as bad, true as b, cast(12 as bigint) as n from customer",
)
statement("fn_conv_decimal", "customer", "SELECT c_custkey, DOUBLE(DECIMAL(c_acctbal) * 2) AS v, DOUBLE('1.234,5', 'de-DE') AS g FROM customer", "select c_custkey, c_acctbal * 2 as v, 1234.5::double as g from customer")
statement("fn_conv_date", "orders", "SELECT o_orderkey, DATETIME(FORMAT(o_orderdate, 'yyyy-MM-dd')) AS v, DATE('31/12/1999', 'pt-BR') AS b FROM orders", "select o_orderkey, date_trunc('day', o_orderdate)::timestamp as v, timestamp '1999-12-31' as b from orders")
statement("fn_conv_ids", "nation", "SELECT n_nationkey, GUID('00000000-0000-0000-0000-00000000000A') AS g, OBJECTID('5F00') AS o, STRING(OID_CREATIONTIME('386d43800000000000000000')) AS t, LENGTH(BINARY('MTIz')) AS n FROM nation", "select n_nationkey, '00000000-0000-0000-0000-00000000000a' as g, cast(null as varchar) as o, '2000-01-01T00:00:00.000Z' as t, 3 as n from nation")
statement(
    "fn_is", "customer",
    "SELECT c_custkey, IS_STRING(c_name) AS s, IS_NUMBER(c_acctbal) AS n, IS_INT32(c_nationkey) AS i, IS_INT64(c_custkey) AS l, IS_DOUBLE(c_acctbal) AS d, IS_NULL(missing) AS z, IS_ARRAY([1]) AS a, IS_DOCUMENT($) AS o, IS_BOOLEAN(1 = 1) AS b, IS_DATETIME(c_name) AS t, IS_DECIMAL(c_acctbal) AS e, IS_GUID(c_name) AS g, IS_OBJECTID(c_name) AS j, IS_BINARY(c_name) AS y, IS_MINVALUE(c_name) AS mi, IS_MAXVALUE(MAXVALUE()) AS ma FROM customer",
    "select c_custkey, true as s, true as n, true as i, true as l, true as d, true as z, true as a, true as o, true as b, false as t, false as e, false as g, false as j, false as y, false as mi, true as ma from customer",
)
statement("fn_volatile", "nation", "SELECT n_nationkey, LENGTH(GUID()) AS g, IS_OBJECTID(OBJECTID()) AS o, RANDOM(3, 5) BETWEEN 3 AND 4 AS r, RANDOM() >= 0 AS r2, NOW() >= TODAY() AS t, IS_DATE(NOW_UTC()) AS u FROM nation", "select n_nationkey, 36 as g, true as o, true as r, true as r2, true as t, true as u from nation")
statement("fn_json_props", "events", "SELECT event_id, INT(JSON(props).k) AS k, JSON(props).k > 50 AS big FROM events", "select event_id, cast(json_extract(props, '$.k') as integer) as k, coalesce(cast(json_extract(props, '$.k') as double) > 50, false) as big from events")
statement("fn_iif_coalesce", "part", "SELECT p_partkey, IIF(p_size > 25, 'big', 'small') AS s, COALESCE(INT(p_name), p_size) AS c FROM part", "select p_partkey, case when p_size > 25 then 'big' else 'small' end as s, coalesce(try_cast(p_name as integer), p_size) as c from part")
statement("fn_format_number", "customer", "SELECT c_custkey, FORMAT(c_acctbal, 'N2') AS n, FORMAT(c_custkey, 'D6') AS d, FORMAT(c_custkey, 'X4') AS x FROM customer", "select c_custkey, format('{:,.2f}', c_acctbal) as n, lpad(cast(c_custkey as varchar), 6, '0') as d, lpad(upper(hex(c_custkey)), 4, '0') as x from customer")

# sequences
statement("seq_map", "embeddings", "SELECT vec_id, ROUND(SUM(MAP(embedding[*] => (@ * @))), 6) AS v FROM embeddings", "select vec_id, round_even(list_sum(list_transform(embedding, lambda x: x::double * x::double)), 6) as v from embeddings")
statement("seq_filter", "embeddings", "SELECT vec_id, COUNT(FILTER(embedding[*] => @ > 0)) AS p, COUNT(embedding[@ > 0]) AS q FROM embeddings", "select vec_id, len(list_filter(embedding, lambda x: x > 0)) as p, len(list_filter(embedding, lambda x: x > 0)) as q from embeddings")
statement("seq_sort", "documents", "SELECT doc_id, JOIN(TOP(SORT(SPLIT(text, ' ') => LENGTH(@), 'desc'), 2), ' ') AS v FROM documents", "select doc_id, array_to_string((select list(w[i] order by length(w[i]) desc, i) from range(1, len(w) + 1) t(i))[1:2], ' ') as v from (select doc_id, list_filter(string_split(text, ' '), lambda x: x <> '') as w from documents)")
statement("seq_index", "embeddings", "SELECT vec_id, embedding[0] AS a, embedding[-1] AS b, IS_NULL(embedding[99]) AS c, embedding[@0] AS d FROM embeddings", "select vec_id, embedding[1]::double as a, embedding[64]::double as b, true as c, embedding[4]::double as d from embeddings", 3)
statement("seq_set_ops", "nation", "SELECT n_nationkey, JOIN(UNION([1, 2, 3], [n_nationkey, 2]), ',') AS u, JOIN(EXCEPT([1, 2, 3], n_nationkey), ',') AS e, JOIN(CONCAT([1], [n_nationkey]), ',') AS c, JOIN(DISTINCT([1, n_nationkey, 1]), ',') AS d FROM nation", "select n_nationkey, case when n_nationkey in (1, 2, 3) then '1,2,3' else '1,2,3,' || n_nationkey end as u, array_to_string(list_filter([1, 2, 3], lambda x: x <> n_nationkey), ',') as e, '1,' || n_nationkey as c, case when n_nationkey = 1 then '1' else '1,' || n_nationkey end as d from nation")
statement("seq_top_items", "nation", "SELECT n_nationkey, JOIN(TOP([n_nationkey, 1, 2], 2), ',') AS t, COUNT(ITEMS(n_nationkey)) AS i, COUNT(TOP([1, 2], -1)) AS z FROM nation", "select n_nationkey, n_nationkey || ',1' as t, 1::bigint as i, 0::bigint as z from nation")
statement("seq_keys_values", "nation", "SELECT n_nationkey, JOIN(KEYS({ a: 1, b: n_name }), ',') AS k, JOIN(VALUES({ a: 1, b: n_name }), '/') AS v FROM nation", "select n_nationkey, 'a,b' as k, '1/' || n_name as v from nation")
statement("seq_array_aggregates", "embeddings", "SELECT vec_id, MIN(embedding) AS mn, MAX(embedding) AS mx, COUNT(embedding) AS n, FIRST(embedding) AS f, LAST(embedding) AS l, ANY(embedding[@ > 9]) AS a, ROUND(AVG(embedding), 6) AS m FROM embeddings", "select vec_id, list_min(embedding)::double as mn, list_max(embedding)::double as mx, len(embedding) as n, embedding[1]::double as f, embedding[64]::double as l, false as a, round_even(list_avg(list_transform(embedding, lambda x: x::double)), 6) as m from embeddings")

# aggregates over the whole source
statement("agg_basic", "lineitem", "SELECT COUNT(*) AS n, ROUND(SUM(*.l_quantity), 2) AS q, ROUND(AVG(*.l_discount), 6) AS d, MIN(*.l_shipdate) AS a, MAX(*.l_shipdate) AS b FROM lineitem", "select count(*) as n, round_even(sum(l_quantity), 2) as q, round_even(avg(l_discount), 6) as d, min(l_shipdate) as a, max(l_shipdate) as b from lineitem")
statement("agg_first_last", "orders", "SELECT FIRST(*.o_totalprice) AS f, LAST(*.o_orderstatus) AS l, ANY(*) AS a FROM orders", "select arg_min(o_totalprice, o_orderkey) as f, arg_max(o_orderstatus, o_orderkey) as l, true as a from orders")
statement("agg_join", "nation", "SELECT JOIN(*.n_name, ',') AS names FROM nation", "select string_agg(n_name, ',' order by n_nationkey) as names from nation")
statement("agg_map_sum", "lineitem", "SELECT ROUND(SUM(MAP(* => (@.l_extendedprice * (1 - @.l_discount)))), 1) AS revenue FROM lineitem", "select round_even(sum(l_extendedprice * (1 - l_discount)), 1) as revenue from lineitem")
statement("agg_filtered", "orders", "SELECT COUNT(*[@.o_orderstatus = 'F']) AS f, ROUND(SUM(MAP(FILTER(* => @.o_totalprice > 100000) => @.o_totalprice)), 1) AS s FROM orders", "select count(*) filter (o_orderstatus = 'F') as f, round_even(sum(o_totalprice) filter (o_totalprice > 100000), 1) as s from orders")
statement("agg_nested_array", "embeddings", "SELECT COUNT(*.embedding[*]) AS n, ROUND(SUM(*.embedding[@ > 0]), 3) AS s, MAX(*.embedding[*]) AS m FROM embeddings", "select sum(len(embedding))::bigint as n, round_even(sum(list_sum(list_transform(list_filter(embedding, lambda x: x > 0), lambda x: x::double))), 3) as s, max(list_max(embedding))::double as m from embeddings")
statement("agg_distinct", "customer", "SELECT COUNT(DISTINCT(*.c_nationkey)) AS n, COUNT(DISTINCT(MAP(* => INT(@.c_name)))) AS z FROM customer", "select count(distinct c_nationkey) as n, 1::bigint as z from customer")
statement("agg_empty", "orders", "SELECT COUNT(*) AS n, SUM(*.o_totalprice) AS s, AVG(*.o_totalprice) AS a, ANY(*) AS x, IS_NULL(MIN(*.o_orderkey)) AS m FROM orders WHERE o_orderkey < 0", "select 0::bigint as n, 0.0::double as s, 0.0::double as a, false as x, true as m")
statement("agg_limit_before", "orders", "SELECT COUNT(*) AS n, SUM(*.o_orderkey) AS s FROM orders LIMIT 100 OFFSET 10", "select count(*) as n, sum(o_orderkey)::bigint as s from (select o_orderkey from orders order by o_orderkey limit 100 offset 10)")


@query("agg_source_array", "select cast(to_json(list(struct_pack(r_regionkey := r_regionkey, r_name := r_name) order by r_regionkey)) as varchar) as rows from region where r_regionkey > 2")
def _source_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows as one array of documents, shown as text."""
    return database(spark, sf_dir, ("region",)).execute("SELECT * FROM region WHERE r_regionkey > 2").selectExpr("to_json(expr) as rows")


_UNLABELLED = "select d.doc_id, l.quality from documents d left join labels l using (doc_id)"


@query("agg_count_nulls", f"select count(*) as n, null::integer as mn, max(quality) as mx from ({_UNLABELLED})")
def _agg_count_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """COUNT counts nulls, and null is the least value."""
    db = database(spark, sf_dir, ("documents", "labels"))
    joined = db.execute("SELECT { doc_id: doc_id, label: { $id: doc_id, $ref: 'labels' } } FROM documents")
    db.register("d", joined, "doc_id")
    return db.execute("SELECT COUNT(*.label.quality) AS n, MIN(*.label.quality) AS mn, MAX(*.label.quality) AS mx FROM $query(\"SELECT $ FROM d INCLUDE label\")")


# groups
statement("grp_flag", "lineitem", "SELECT { flag: @key, n: COUNT(*), qty: ROUND(SUM(*.l_quantity), 2), disc: ROUND(SUM(MAP(* => (@.l_extendedprice * (1 - @.l_discount)))), 1) } FROM lineitem WHERE l_shipdate <= @0 GROUP BY l_returnflag + l_linestatus", "select l_returnflag || l_linestatus as flag, count(*) as n, round_even(sum(l_quantity), 2) as qty, round_even(sum(l_extendedprice * (1 - l_discount)), 1) as disc from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1", dt.datetime(1998, 9, 2, tzinfo=dt.UTC))
statement("grp_having", "orders", "SELECT @key AS cust, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12", "select o_custkey as cust, count(*) as n from orders group by 1 having count(*) > 12")
statement("grp_expr_year", "orders", "SELECT @key AS y, ROUND(SUM(*.o_totalprice), 1) AS s, MIN(*.o_orderkey) AS m FROM orders GROUP BY YEAR(o_orderdate)", "select cast(year(o_orderdate) as integer) as y, round_even(sum(o_totalprice), 1) as s, min(o_orderkey) as m from orders group by 1")
statement("grp_array_collect", "nation", "SELECT { region: @key, names: JOIN(*.n_name, ','), first: FIRST(*.n_name), last: LAST(*.n_name) } FROM nation GROUP BY n_regionkey", "select n_regionkey as region, string_agg(n_name, ',' order by n_nationkey) as names, arg_min(n_name, n_nationkey) as first, arg_max(n_name, n_nationkey) as last from nation group by 1")
statement("grp_limit", "events", "SELECT @key AS t, COUNT(*) AS n FROM events GROUP BY event_type LIMIT 2 OFFSET 1", "select event_type as t, count(*) as n from events group by 1 order by 1 limit 2 offset 1")
statement("grp_distinct", "orders", "SELECT @key AS p, COUNT(DISTINCT(*.o_custkey)) AS c, MAX(*.o_totalprice) AS m FROM orders GROUP BY o_orderpriority", "select o_orderpriority as p, count(distinct o_custkey) as c, max(o_totalprice) as m from orders group by 1")
statement("grp_key_array", "customer", "SELECT { seg: @key[0], nat: @key[1], n: COUNT(*) } FROM customer GROUP BY [c_mktsegment, STRING(c_nationkey)]", "select c_mktsegment as seg, cast(c_nationkey as varchar) as nat, count(*) as n from customer group by 1, 2")
statement("grp_array_sum", "embeddings", "SELECT @key AS label, COUNT(*.embedding[*]) AS n, ROUND(SUM(*.embedding[*]), 3) AS s FROM embeddings GROUP BY label", "select label, sum(len(embedding))::bigint as n, round_even(sum(list_sum(list_transform(embedding, lambda x: x::double))), 3) as s from embeddings group by 1")

# order
statement("ord_asc", "supplier", "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal LIMIT 10", "select s_suppkey, s_acctbal from supplier order by s_acctbal, s_suppkey limit 10")
statement("ord_desc", "orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC LIMIT 25", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25")
statement("ord_expr", "orders", "SELECT o_orderkey FROM orders ORDER BY DAY(o_orderdate) LIMIT 10 OFFSET 5", "select o_orderkey from orders order by day(o_orderdate), o_orderkey limit 10 offset 5")
statement("ord_nulls_first", "documents", "SELECT doc_id FROM documents ORDER BY INT(SUBSTRING(source, 3)) LIMIT 7", "select doc_id from documents order by try_cast(substr(source, 4) as integer) nulls first, doc_id limit 7")
statement("limit_offset", "customer", "SELECT c_custkey FROM customer LIMIT 20 OFFSET 30", "select c_custkey from customer order by c_custkey limit 20 offset 30")


# references
def _with_reference(db: Database, view: str, source: str, text: str) -> Database:
    return db.register(view, db.execute(text), KEYS[source], references={"customer": "customer"})


@query("inc_customer", "select o_orderkey, c_name, c_mktsegment, null::boolean as missing from orders join customer on o_custkey = c_custkey")
def _inc_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = database(spark, sf_dir, ("orders", "customer"))
    _with_reference(db, "o", "orders", "SELECT EXTEND($, { customer: { $id: o_custkey, $ref: 'customer' } }) FROM orders")
    return db.execute("SELECT o_orderkey, customer.c_name AS c_name, customer.c_mktsegment AS c_mktsegment, customer.['$missing'] AS missing FROM o INCLUDE customer")


@query("inc_nested_nation_region", "select c_custkey, n_name, r_name from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
def _inc_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = database(spark, sf_dir, ("customer", "nation", "region"))
    db.register("n", db.execute("SELECT EXTEND($, { region: { $id: n_regionkey, $ref: 'region' } }) FROM nation"), "n_nationkey")
    db.register("c", db.execute("SELECT { c_custkey: c_custkey, nation: { $id: c_nationkey, $ref: 'n' } } FROM customer"), "c_custkey")
    return db.execute("SELECT c_custkey, nation.n_name AS n_name, nation.region.r_name AS r_name FROM c INCLUDE nation, nation.region")


@query("inc_missing", "select d.doc_id, l.quality, case when l.doc_id is null then true end as missing, case when l.doc_id is null then 'labels' end as ref from documents d left join labels l using (doc_id)")
def _inc_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = database(spark, sf_dir, ("documents", "labels"))
    db.register("d", db.execute("SELECT { doc_id: doc_id, label: { $id: doc_id, $ref: 'labels' } } FROM documents"), "doc_id")
    return db.execute("SELECT doc_id, label.quality AS quality, label.['$missing'] AS missing, label.['$ref'] AS ref FROM d INCLUDE label")


@query("inc_filter_before", "select o_orderkey from orders join customer on o_custkey = c_custkey where c_acctbal > 9000")
def _inc_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = database(spark, sf_dir, ("orders", "customer"))
    _with_reference(db, "o", "orders", "SELECT { o_orderkey: o_orderkey, customer: { $id: o_custkey, $ref: 'customer' } } FROM orders")
    return db.execute("SELECT o_orderkey FROM o INCLUDE customer WHERE customer.c_acctbal > 9000")


@query("inc_array_parts", "select l_orderkey, count(*) as n, round_even(sum(p_retailprice), 2) as price, count(distinct p_brand) as brands from lineitem join part on l_partkey = p_partkey group by 1")
def _inc_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = database(spark, sf_dir, ("lineitem", "part"))
    db.register("o", db.execute("SELECT { l_orderkey: @key, parts: ARRAY(MAP(* => { $id: @.l_partkey, $ref: 'part' })) } FROM lineitem GROUP BY l_orderkey"), "l_orderkey", references={"parts": "part"})
    return db.execute("SELECT l_orderkey, COUNT(parts[*]) AS n, ROUND(SUM(parts[*].p_retailprice), 2) AS price, COUNT(DISTINCT(parts[*].p_brand)) AS brands FROM o INCLUDE parts[*]")


# sources and sinks
statement("src_query", "nation", "SELECT n_name AS name FROM $query(\"SELECT n_name, n_regionkey FROM nation WHERE n_regionkey = 1\")", "select n_name as name from nation where n_regionkey = 1")
statement("src_cols", "nation region", "SELECT name FROM $cols WHERE type = 'view'", "select unnest(['nation', 'region']) as name")
statement("src_database", "nation", "SELECT collections, userVersion FROM $database", "select 0 as collections, 0 as userVersion")


def _through_file(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = f"{scratch(spark)}/region.{kind}"
        db = database(spark, sf_dir, ("region",))
        db.execute(f"SELECT r_regionkey, r_name INTO $file('{path}') FROM region")
        return db.execute(f"SELECT INT(STRING(r_regionkey)) AS k, r_name AS name FROM $file('{path}')")

    return run


for _kind in ("csv", "json"):
    query(f"src_file_{_kind}", "select r_regionkey as k, r_name as name from region")(_through_file(_kind))


def _stored(spark: SparkSession, sf_dir: str, table: str, key: str) -> Database:
    """A database with a collection ``c`` of the table's rows, under _id."""
    db = database(spark, sf_dir, (table,), path=scratch(spark))
    db.execute(f"SELECT EXTEND({{ _id: {key} }}, $) INTO c FROM {table}")
    return db


@query("into_collection", "select n_nationkey as _id, n_nationkey, n_name, n_regionkey from nation where n_regionkey = 3")
def _into(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = database(spark, sf_dir, ("nation",), path=scratch(spark))
    db.execute("SELECT EXTEND({ _id: n_nationkey }, $) INTO c FROM nation WHERE n_regionkey = 3")
    return db.execute("SELECT $ FROM c")


@query("dml_insert", "select n_nationkey as _id, n_name from nation union all select 100, 'NEW' union all select 101, 'NEWER'")
def _insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _stored(spark, sf_dir, "nation", "n_nationkey")
    db.execute("INSERT INTO c VALUES { _id: 100, n_name: 'NEW' }, { _id: 101, n_name: 'NEWER' }")
    return db.execute("SELECT _id, n_name FROM c")


@query("dml_insert_autoid", "select r_regionkey + 1 as _id, r_name from (select r_name, cast(row_number() over (order by r_regionkey) - 1 as integer) as r_regionkey from region)")
def _insert_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = database(spark, sf_dir, ("region",), path=scratch(spark))
    db.execute("SELECT r_name INTO c:INT FROM region ORDER BY r_regionkey")
    return db.execute("SELECT $ FROM c")


@query("dml_upsert", "select n_nationkey as _id, case when n_nationkey = 3 then 'THREE' else n_name end as n_name from nation union all select 99, 'ADDED'")
def _upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _stored(spark, sf_dir, "nation", "n_nationkey")
    if db["c"].upsert([{"_id": 3, "n_name": "THREE"}, {"_id": 99, "n_name": "ADDED"}]) != 1:
        raise AssertionError("one document is new")
    return db.execute("SELECT _id, n_name FROM c")


@query("dml_update", "select s_suppkey as _id, case when s_acctbal < 0 then 0.0 else s_acctbal end as s_acctbal, case when s_acctbal < 0 then s_name || '!' else s_name end as s_name from supplier")
def _update(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _stored(spark, sf_dir, "supplier", "s_suppkey")
    db.execute("UPDATE c SET s_acctbal = 0, s_name = s_name + '!' WHERE s_acctbal < 0")
    return db.execute("SELECT _id, s_acctbal, s_name FROM c")


@query("dml_update_document", "select r_regionkey as _id, r_name, r_regionkey * 2 as twice from region")
def _update_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _stored(spark, sf_dir, "region", "r_regionkey")
    db.execute("UPDATE c SET { twice: r_regionkey * 2 }")
    return db.execute("SELECT _id, r_name, twice FROM c")


@query("dml_delete", "select s_suppkey as _id from supplier where not (s_nationkey < 10)")
def _delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _stored(spark, sf_dir, "supplier", "s_suppkey")
    db.execute("DELETE c WHERE s_nationkey < 10")
    return db.execute("SELECT _id FROM c")


@query("dml_transaction", "select count(*) as n from region")
def _transaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _stored(spark, sf_dir, "region", "r_regionkey")
    db.execute("BEGIN")
    db.execute("DELETE c WHERE r_regionkey > 1")
    db.execute("ROLLBACK")
    return db.execute("SELECT COUNT(*) AS n FROM c")


@query("ddl_index_rename", "select unnest(['d', 'd']) as collection, unnest(['_id', 'byname']) as name, unnest([true, true]) as u")
def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _stored(spark, sf_dir, "region", "r_regionkey")
    db.execute("CREATE UNIQUE INDEX byname ON c (r_name)")
    db.execute("RENAME COLLECTION c TO d")
    return db.execute("SELECT collection, name, unique AS u FROM $indexes")


# calls
@query("api_query", "select c_custkey as id, upper(c_name) as name from customer where c_nationkey = 5 and c_acctbal > 1000 order by c_acctbal desc limit 5")
def _api(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .query import doc, fn

    q = database(spark, sf_dir, ("customer",))["customer"].query()
    return q.where((doc.c_nationkey == 5) & (doc.c_acctbal > 1000)).order_by(doc.c_acctbal, descending=True).limit(5).select(id=doc.c_custkey, name=fn("UPPER", doc.c_name)).to_df()


@query("api_find", "select * from customer where c_mktsegment = 'BUILDING' order by c_custkey limit 10 offset 2")
def _find(spark: SparkSession, sf_dir: str) -> DataFrame:
    return database(spark, sf_dir, ("customer",))["customer"].find("c_mktsegment = @0", "BUILDING", skip=2, limit=10)


@query("api_scalars", "select count(*) filter (c_nationkey = 7) as n, true as e, min(c_acctbal) as mn, max(c_acctbal) as mx, (select c_name from customer where c_custkey = 17) as name from customer")
def _scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .query import Where

    db = database(spark, sf_dir, ("customer",))
    c = db["customer"]
    by_id = c.find_by_id(17)
    row = (c.count(Where.eq("c_nationkey", 7)), c.exists("c_custkey > 3"), c.min("c_acctbal"), c.max("c_acctbal"), by_id["c_name"] if by_id else None)
    return spark.createDataFrame([row], "n long, e boolean, mn double, mx double, name string")


# what statements and calls do besides
@query("explain_select", "select 'orders' as collection, 1::integer as filters, true as pushed, -1::integer as lim")
def _explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = database(spark, sf_dir, ("orders",))
    plan = db.execute("EXPLAIN SELECT o_orderkey FROM orders WHERE o_totalprice > 1000 AND o_orderstatus = 'F'")
    return plan.selectExpr("plan.collection", "plan.filters", "contains(plan.physical, 'GreaterThan(o_totalprice,1000') as pushed", "plan.limit as lim")


@query("pragma_values", "select 7::integer as version, 'UTF8_BINARY' as collation, true as assigned")
def _pragma(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = database(spark, sf_dir, (), path=scratch(spark))
    assigned = db.scalar("PRAGMA USER_VERSION = 7")
    return spark.createDataFrame([(db.scalar("PRAGMA USER_VERSION"), db.scalar("PRAGMA COLLATION"), assigned)], "version int, collation string, assigned boolean")


@query("ddl_drop", "select true as index_gone, true as gone, false as again, 0::integer as left_")
def _drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _stored(spark, sf_dir, "region", "r_regionkey")
    db.execute("CREATE INDEX byname ON c (r_name)")
    row = (db.scalar("DROP INDEX c.byname"), db.scalar("DROP COLLECTION c"), db.scalar("DROP COLLECTION c"), len(db.catalog.entries))
    return spark.createDataFrame([row], "index_gone boolean, gone boolean, again boolean, left_ int")


@query("dml_commit", "select count(*) as n from region where r_regionkey <= 1")
def _commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _stored(spark, sf_dir, "region", "r_regionkey")
    for text in ("BEGIN TRANS", "DELETE c WHERE r_regionkey > 1", "COMMIT"):
        db.execute(text)
    return Database(spark, db.catalog.path).execute("SELECT COUNT(*) AS n FROM c")


@query("dml_checkpoint_rebuild", "select n_nationkey as _id, 2::integer as freed, 1::integer as rebuilt, 1::integer as folders from nation where n_nationkey <> 3 union all select 50, 2, 1, 1")
def _maintenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    db = _stored(spark, sf_dir, "nation", "n_nationkey")
    db.execute("SELECT $ INTO gone FROM c")
    db.execute("SELECT EXTEND($, { _id: n_nationkey + 100 }) INTO gone FROM nation")
    db.execute("DROP COLLECTION gone")
    db.execute("INSERT INTO c VALUES { _id: 50, n_name: 'NEW' }")
    db.execute("DELETE c WHERE _id = 3")
    freed, rebuilt = db.scalar("CHECKPOINT"), db.scalar("REBUILD")
    folders = db.execute("SELECT folder FROM $snapshots").count()
    return db.execute("SELECT _id FROM c").select("_id", F.lit(freed).alias("freed"), F.lit(rebuilt).alias("rebuilt"), F.lit(folders).alias("folders"))


@query("dml_update_by_id", "select n_nationkey as _id, case when n_nationkey in (2, 4) then 'CHANGED' else n_name end as n_name, 2::integer as found from nation")
def _update_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    db = _stored(spark, sf_dir, "nation", "n_nationkey")
    found = db["c"].update([{"_id": 2, "n_name": "CHANGED"}, {"_id": 4, "n_name": "CHANGED"}, {"_id": 999, "n_name": "NOBODY"}])
    return db.execute("SELECT _id, n_name FROM c").withColumn("found", F.lit(found))


@query("ddl_index_rules", "select true as fresh, false as again, false as on_id, true as other_expression, true as parameter, true as duplicate")
def _index_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    def raises(run: Callable[[], object]) -> bool:
        try:
            run()
        except ValueError:
            return True
        return False

    c = _stored(spark, sf_dir, "nation", "n_nationkey")["c"]
    row = (
        c.ensure_index("byname", "n_name", unique=True), c.ensure_index("byname", "n_name", unique=True), c.ensure_index("pk", "_id"), raises(lambda: c.ensure_index("byname", "n_regionkey")),
        raises(lambda: c.ensure_index("bad", "n_regionkey + @0")), raises(lambda: c.ensure_index("byregion", "n_regionkey", unique=True)),
    )
    return spark.createDataFrame([row], "fresh boolean, again boolean, on_id boolean, other_expression boolean, parameter boolean, duplicate boolean")


@query("api_group", "select c_nationkey as nation, count(*) as n, max(c_acctbal) as s from customer where c_acctbal > 0 group by 1 having count(*) > 1")
def _api_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .query import doc

    q = database(spark, sf_dir, ("customer",))["customer"].query()
    return q.where(doc.c_acctbal > 0).group_by(doc.c_nationkey).having("COUNT(*) > @0", 1).select("{ nation: @key, n: COUNT(*), s: MAX(*.c_acctbal) }").to_df()


@query("api_into", "select c_custkey as _id, upper(c_name) as name from customer where c_nationkey = 3")
def _api_into(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = database(spark, sf_dir, ("customer",), path=scratch(spark))
    n = db["customer"].query().where("c_nationkey = 3").select("{ _id: c_custkey, name: UPPER(c_name) }").into("c")
    if n != db["c"].count():
        raise AssertionError("as many as are there")
    return db["c"].find_all()


@query("api_include", "select o_orderkey, c_name from orders join customer on o_custkey = c_custkey where o_totalprice > 200000")
def _api_include(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .query import doc

    db = database(spark, sf_dir, ("orders", "customer"))
    _with_reference(db, "o", "orders", "SELECT EXTEND($, { customer: { $id: o_custkey, $ref: 'customer' } }) FROM orders")
    return db["o"].query().include("customer").where(doc.o_totalprice > 200000).select(doc.o_orderkey, c_name=doc.customer.c_name).to_df()


@query("api_methods", "select c_custkey as k, upper(c_name) as u, length(c_name)::integer as n, replace(c_mktsegment, 'B', 'b') as r, abs(c_acctbal) as a, cast(c_nationkey as varchar) as t, starts_with(c_name, 'Cust') as p from customer where contains(c_mktsegment, 'U')")
def _api_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .query import doc

    q = database(spark, sf_dir, ("customer",))["customer"].query().where(doc.c_mktsegment.as_text.contains("U"))
    return q.select(k=doc.c_custkey, u=doc.c_name.as_text.upper(), n=doc.c_name.as_text.length(), r=doc.c_mktsegment.as_text.replace("B", "b"), a=doc.c_acctbal.as_number.abs(), t=doc.c_nationkey.convert.string(), p=doc.c_name.as_text.starts_with("Cust")).to_df()


@query("api_methods_dates", "select o_orderkey as k, cast(year(o_orderdate) as integer) as y, o_orderdate + interval 2 day as later, date_trunc('day', o_orderdate)::timestamp as d from orders where month(o_orderdate) = 5")
def _api_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .query import doc

    q = database(spark, sf_dir, ("orders",))["orders"].query().where(doc.o_orderdate.as_date.month() == 5)
    return q.select(k=doc.o_orderkey, y=doc.o_orderdate.as_date.year(), later=doc.o_orderdate.as_date.add_days(2), d=doc.o_orderdate.as_date.date()).to_df()


@query("api_methods_items", "select vec_id as k, embedding[1]::double as f, len(embedding) as n, list_max(embedding)::double as m, embedding[3]::double as e, list_bool_and(list_transform(embedding, lambda x: x < 9)) as a from embeddings")
def _api_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .query import doc

    q = database(spark, sf_dir, ("embeddings",))["embeddings"].query()
    e = doc.embedding
    return q.select(k=doc.vec_id, f=e.as_items.first(), n=e.as_items.count(), m=e.as_items.max(), e=e.as_items.element_at(2), a=e.as_items.all(lambda x: x < 9)).to_df()


@query("api_results", "select (select min(c_custkey) from customer) as first, 17::bigint as single, true as no_single, true as nothing, (select count(*) from customer) as n")
def _api_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = database(spark, sf_dir, ("customer",))["customer"].query()
    try:
        q.single()
        several = False
    except LookupError:
        several = True
    row = (q.first()["c_custkey"], q.where("c_custkey = 17").single()["c_custkey"], several, q.where("c_custkey < 0").first_or_default() is None, len(q.select("c_custkey").values()))
    return spark.createDataFrame([row], "first long, single long, no_single boolean, nothing boolean, n long")


@query("file_storage", "select r_regionkey::bigint as k, r_name as name, r_name as held, length(r_name)::bigint as length from region")
def _file_storage(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources.storage import FileStorage

    regions = database(spark, sf_dir, ("region",))["region"].find_all().collect()  # five rows
    files = FileStorage(Database(spark, scratch(spark)))
    for r in regions:
        files.upload(f"$/{r['r_regionkey']}", r["r_name"], r["r_name"].encode())
    rows = [(r["r_regionkey"], files.find_by_id(f"$/{r['r_regionkey']}")["filename"], files.download(f"$/{r['r_regionkey']}").decode(), files.find_by_id(f"$/{r['r_regionkey']}")["length"]) for r in regions]
    return spark.createDataFrame(rows, "k long, name string, held string, length long")


@query("connection_string", "select n_nationkey as _id, true as read_only from nation")
def _connection(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .connection import connect

    path = _stored(spark, sf_dir, "nation", "n_nationkey").catalog.path
    db = connect(spark, f"filename={path}; readonly=true; collation=UTF8_LCASE")
    return db.execute("SELECT _id FROM c WHERE n_name != 'x'").withColumn("read_only", F.lit(db.read_only))


statement("fn_extremes", "nation", "SELECT n_nationkey, MINVALUE() < n_nationkey AS a, MAXVALUE() > n_name AS b, IS_MINVALUE(MINVALUE()) AS c FROM nation", "select n_nationkey, true as a, true as b, true as c from nation")
statement("fn_cultures", "nation", "SELECT n_nationkey, DOUBLE(DECIMAL('1.234,50', 'fr-FR')) AS a, DATETIME('04/03/2001', 'en-GB') AS b, DATETIME('04/03/2001', 'en-US') AS c, DATETIME_UTC('04.03.2001 05:06', 'de-DE') AS d FROM nation", "select n_nationkey, 1234.5::double as a, timestamp '2001-03-04' as b, timestamp '2001-04-03' as c, timestamp '2001-03-04 05:06:00' as d from nation")
statement("fn_aliases", "nation", "SELECT n_nationkey, IS_INT(n_nationkey) AS a, IS_LONG(n_nationkey) AS b, IS_BOOL(1 = 1) AS c, BOOL('false') AS d, DATE('2001-02-03') AS e, DATE(2001, 2, 3) AS f, DATE_UTC('2001-02-03', 'en-US') AS g, DATETIME_UTC(2001, 2, 3) AS h, DATETIME_UTC('2001-02-03T04:05:06') AS i, DATE_UTC('2001-02-03') AS j FROM nation", "select n_nationkey, true as a, false as b, true as c, false as d, timestamp '2001-02-03' as e, timestamp '2001-02-03' as f, timestamp '2001-02-03' as g, timestamp '2001-02-03' as h, timestamp '2001-02-03 04:05:06' as i, timestamp '2001-02-03' as j from nation")
statement("fn_format_pattern", "customer", "SELECT c_custkey, FORMAT(c_custkey, '0000') AS a, FORMAT(c_custkey * 1000, '#,##0') AS b FROM customer", "select c_custkey, lpad(cast(c_custkey as varchar), greatest(4, length(cast(c_custkey as varchar)))::integer, '0') as a, format('{:,}', c_custkey * 1000) as b from customer")
statement("fn_json_values", "events", "SELECT event_id, COUNT(VALUES(JSON(props))) AS n, JOIN(KEYS(JSON(props)), ',') AS k FROM events", "select event_id, len(json_keys(props))::bigint as n, array_to_string(json_keys(props), ',') as k from events")
statement("proj_for_update", "nation", "SELECT n_nationkey FROM nation WHERE n_regionkey = 1 FOR UPDATE", "select n_nationkey from nation where n_regionkey = 1")

statement("collation_lcase_eq", "customer", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'building' AND c_name LIKE 'CUSTOMER%'", "select c_custkey from customer where lower(c_mktsegment) = 'building' and lower(c_name) like 'customer%'", collation="UTF8_LCASE")
statement("variant_order", "events", "SELECT event_id FROM events ORDER BY JSON(props).k DESC LIMIT 12", "select event_id from events order by cast(json_extract(props, '$.k') as double) desc nulls last, event_id limit 12")
statement("variant_group", "events", "SELECT @key AS k, COUNT(*) AS n FROM events GROUP BY JSON(props).k", "select cast(json_extract(props, '$.k') as varchar) as k, count(*) as n from events group by 1")
