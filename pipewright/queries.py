"""The language's queries over the driver's tables, each with the SQL that says the same; some write files first and read those.

``{d}`` stands for the tables' folder. Floating sums are rounded on both sides, for their last bits depend on the order.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .api import run
from .cli import execute
from .sources.options import scratch_file

I = "CAST({} AS BIGINT) AS {}"  # noqa: E741


def ints(*names: str) -> str:
    """32-bit columns, which the language widens."""
    return ", ".join(I.format(n, n) for n in names)


NATION = f"{ints('n_nationkey')}, n_name, {ints('n_regionkey')}"
PART = f"p_partkey, p_name, p_brand, p_type, {ints('p_size')}, p_retailprice"
CUSTOMER = f"c_custkey, c_name, {ints('c_nationkey')}, c_acctbal, c_mktsegment"

#: name: (pipeline, SQL, float columns to round)
PIPELINES: dict[str, tuple[str, str, tuple[str, ...]]] = {
    # filter
    "filter_cmp": ("{d}/lineitem.parquet | filter {{ l_quantity > 30 and l_discount <= 0.05 }} | select l_orderkey, l_linenumber, l_quantity",
        f"SELECT l_orderkey, {ints('l_linenumber')}, l_quantity FROM lineitem WHERE l_quantity > 30 AND l_discount <= 0.05", ()),
    "filter_logic": ("{d}/events.parquet | filter {{ (event_type == \"click\" or value > 50) and not (user_id < 100) }} | select event_id, user_id, event_type, value",
        "SELECT event_id, user_id, event_type, value FROM events WHERE (event_type = 'click' OR value > 50) AND NOT (user_id < 100)", ()),
    "filter_null": ("{d}/events.parquet | transform v = if(value > 50, value, null) | filter {{ v is null }} | select event_id, v",
        "SELECT event_id, CAST(NULL AS DOUBLE) AS v FROM events WHERE value <= 50 OR value IS NULL", ()),
    "filter_null_drops": ("{d}/events.parquet | transform v = if(value > 50, value, null) | filter {{ not (v > 80) }} | select event_id, v",
        "SELECT event_id, value AS v FROM events WHERE value > 50 AND NOT value > 80", ()),
    "filter_not_equal": ("{d}/orders.parquet | filter {{ o_orderstatus != \"O\" }} | select o_orderkey, o_orderstatus",
        "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'O'", ()),
    # projection
    "select_duplicate": ("{d}/nation.parquet | select n_name, n_name, n_nationkey", f"SELECT n_name, n_name AS n_name_2, {ints('n_nationkey')} FROM nation", ()),
    "remove_columns": ("{d}/customer.parquet | remove c_acctbal, c_name", f"SELECT c_custkey, {ints('c_nationkey')}, c_mktsegment FROM customer", ()),
    "rename_swap": ("{d}/nation.parquet | rename n_nationkey = n_regionkey, n_regionkey = n_nationkey",
        "SELECT CAST(n_nationkey AS BIGINT) AS n_regionkey, n_name, CAST(n_regionkey AS BIGINT) AS n_nationkey FROM nation", ()),
    # transform
    "transform_arithmetic": ("{d}/part.parquet | transform twice = p_size * 2 + 1, neg = -p_size, half = p_retailprice / 2 - 1.5 | select p_partkey, twice, neg, half",
        "SELECT p_partkey, CAST(p_size AS BIGINT) * 2 + 1 AS twice, -CAST(p_size AS BIGINT) AS neg, p_retailprice / 2 - 1.5 AS half FROM part", ()),
    "transform_overwrite": ("{d}/nation.parquet | transform n_regionkey = n_nationkey + n_regionkey, n_nationkey = n_regionkey",
        "SELECT CAST(n_regionkey AS BIGINT) AS n_nationkey, n_name, CAST(n_nationkey AS BIGINT) + CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation", ()),
    "transform_divide_zero": ("{d}/lineitem.parquet | transform r = l_quantity / (l_linenumber - 1), q = l_linenumber / 4 | select l_orderkey, l_linenumber, r, q",
        f"SELECT l_orderkey, {ints('l_linenumber')}, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_quantity / (l_linenumber - 1) END AS r, l_linenumber / 4.0::DOUBLE AS q FROM lineitem", ()),
    "transform_if": ("{d}/orders.parquet | transform size = if(o_totalprice > 200000, \"big\", if(o_totalprice > 50000, \"mid\", \"small\")) | select o_orderkey, size",
        "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'big' WHEN o_totalprice > 50000 THEN 'mid' ELSE 'small' END AS size FROM orders", ()),
    "transform_coalesce": ("{d}/events.parquet | transform v = coalesce(if(value > 50, value, null), if(user_id > 20, 0, null), -1) | select event_id, v",
        "SELECT event_id, CAST(COALESCE(CASE WHEN value > 50 THEN value END, CASE WHEN user_id > 20 THEN 0 END, -1) AS DOUBLE) AS v FROM events", ()),
    "transform_null_logic": ("{d}/nation.parquet | transform t = if(n_regionkey > 2, true, null) | transform a = t and n_nationkey > 10, o = t or n_nationkey > 10, n = not t, z = t is null | select n_nationkey, a, o, n, z",
        "SELECT n_nationkey, t AND n_nationkey > 10 AS a, t OR n_nationkey > 10 AS o, NOT t AS n, t IS NULL AS z FROM (SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CASE WHEN n_regionkey > 2 THEN TRUE END AS t FROM nation)", ()),
    "exact_compare": ("{d}/orders.parquet | transform big = o_orderkey + 9007199254740992, f = 9007199254740992.0 | select o_orderkey, big, f | transform eq = big == f, gt = big > f | select o_orderkey, eq, gt",
        "SELECT o_orderkey, o_orderkey = 0 AS eq, o_orderkey > 0 AS gt FROM orders", ()),
    # strings
    "string_case": ("{d}/part.parquet | transform u = upper(p_name), l = lower(p_type), c = p_brand + \"/\" + p_type | select p_partkey, u, l, c",
        "SELECT p_partkey, UPPER(p_name) AS u, LOWER(p_type) AS l, p_brand || '/' || p_type AS c FROM part", ()),
    "string_trim": ("{d}/part.parquet | transform t = trim(\"  \" + p_name + \" \\t\") | select p_partkey, t", "SELECT p_partkey, p_name AS t FROM part", ()),
    "string_length": ("{d}/documents.parquet | transform n = str_len(text) | select doc_id, n", "SELECT doc_id, CAST(LENGTH(text) AS BIGINT) AS n FROM documents", ()),
    "string_substr": ("{d}/part.parquet | transform a = substr(p_name, 0, 4), b = substr(p_name, 2, 3), c = substr(p_name, -3, 2), e = substr(p_name, 1000, 2), w = substr(p_name, -1000, 3) | select p_partkey, a, b, c, e, w",
        "SELECT p_partkey, p_name[1:4] AS a, p_name[3:5] AS b, SUBSTR(p_name, LENGTH(p_name) - 2, 2) AS c, '' AS e, p_name[1:3] AS w FROM part", ()),
    "string_predicates": ("{d}/documents.parquet | transform a = str_contains(text, \"the\"), b = starts_with(source, \"src1\"), c = ends_with(source, \"7\") | select doc_id, a, b, c",
        "SELECT doc_id, CONTAINS(text, 'the') AS a, STARTS_WITH(source, 'src1') AS b, ENDS_WITH(source, '7') AS c FROM documents", ()),
    "string_regex": ("{d}/documents.parquet | filter {{ matches(source, \"^src1[0-9]$\") and matches(text, \"[A-Z][a-z]+,\") }} | select doc_id, source",
        "SELECT doc_id, source FROM documents WHERE REGEXP_MATCHES(source, '^src1[0-9]$') AND REGEXP_MATCHES(text, '[A-Z][a-z]+,')", ()),
    # dates
    "date_parts": ("{d}/orders.parquet | transform y = year(o_orderdate), m = month(o_orderdate), a = day(o_orderdate) | select o_orderkey, y, m, a",
        "SELECT o_orderkey, YEAR(o_orderdate) AS y, MONTH(o_orderdate) AS m, DAY(o_orderdate) AS a FROM orders", ()),
    "date_strings": ("{d}/nation.parquet | transform t = \"2024-03-0\" + if(n_regionkey > 2, \"7\", \"9\") + \"T10:11:12Z\" | transform y = year(t), m = month(t), a = day(t) | select n_nationkey, y, m, a",
        "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, 2024::BIGINT AS y, 3::BIGINT AS m, CASE WHEN n_regionkey > 2 THEN 7 ELSE 9 END::BIGINT AS a FROM nation", ()),
    # order
    "sort_head": ("{d}/orders.parquet | sort -o_totalprice, o_orderkey | head 25 | select o_orderkey, o_totalprice", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25", ()),
    "sort_nulls_last": ("{d}/events.parquet | transform v = if(value > 99, value, null) | sort -v, event_id | group event_type | reduce a = first(event_id), b = last(event_id), v = last(v) | remove grouped",
        "SELECT event_type, FIRST(event_id ORDER BY v DESC NULLS LAST, event_id) AS a, LAST(event_id ORDER BY v DESC NULLS LAST, event_id) AS b, LAST(v ORDER BY v DESC NULLS LAST, event_id) AS v "
        "FROM (SELECT event_id, event_type, CASE WHEN value > 99 THEN value END AS v FROM events) GROUP BY 1", ()),
    "head_source": ("{d}/customer.parquet | head 15", f"SELECT {CUSTOMER} FROM customer ORDER BY c_custkey LIMIT 15", ()),
    "tail_sorted": ("{d}/part.parquet | sort p_retailprice, p_partkey | tail 12 | select p_partkey, p_retailprice", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey DESC LIMIT 12", ()),
    "head_after_transform": ("{d}/orders.parquet | sort o_orderkey | transform y = year(o_orderdate) | select o_orderkey, y | head 7", "SELECT o_orderkey, YEAR(o_orderdate) AS y FROM orders ORDER BY o_orderkey LIMIT 7", ()),
    # distinct, count, describe
    "distinct_rows": ("{d}/lineitem.parquet | select l_returnflag, l_linestatus, l_linenumber | distinct", f"SELECT DISTINCT l_returnflag, l_linestatus, {ints('l_linenumber')} FROM lineitem", ()),
    "distinct_columns": ("{d}/events.parquet | distinct event_type, user_id", "SELECT DISTINCT event_type, user_id FROM events", ()),
    "distinct_first": ("{d}/customer.parquet | sort -c_acctbal, c_custkey | distinct c_mktsegment, c_nationkey | group c_nationkey | reduce a = first(c_mktsegment), b = last(c_mktsegment) | remove grouped",
        "SELECT CAST(c_nationkey AS BIGINT) AS c_nationkey, FIRST(c_mktsegment ORDER BY rn) AS a, LAST(c_mktsegment ORDER BY rn) AS b FROM (SELECT c_nationkey, c_mktsegment, MIN(rn) AS rn "
        "FROM (SELECT c_nationkey, c_mktsegment, ROW_NUMBER() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) GROUP BY 1, 2) GROUP BY 1", ()),
    "count_rows": ("{d}/lineitem.parquet | filter {{ l_returnflag == \"R\" }} | count", "SELECT COUNT(*) AS count FROM lineitem WHERE l_returnflag = 'R'", ()),
    "describe_columns": ("{d}/region.parquet | describe", "SELECT * FROM (VALUES ('r_regionkey', 'int', 5::BIGINT, 'int?'), ('r_name', 'string', 5::BIGINT, 'string?')) t(\"column\", \"type\", row_count, \"schema\")", ()),
    # group and reduce
    "group_count": ("{d}/orders.parquet | group o_orderpriority | reduce n = count() | remove grouped", "SELECT o_orderpriority, COUNT(*) AS n FROM orders GROUP BY 1", ()),
    "group_sum_avg": ("{d}/lineitem.parquet | group l_returnflag, l_linestatus | reduce qty = sum(l_quantity), lines = sum(l_linenumber), price = avg(l_extendedprice) | remove grouped",
        "SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 2) AS qty, CAST(SUM(l_linenumber) AS BIGINT) AS lines, ROUND(AVG(l_extendedprice), 4) AS price FROM lineitem GROUP BY 1, 2", ("qty:2", "price:4")),
    "group_min_max": ("{d}/part.parquet | group p_brand | reduce a = min(p_size), b = max(p_size), c = min(p_retailprice), e = max(p_retailprice), f = min(p_name), g = max(p_name) | remove grouped",
        "SELECT p_brand, CAST(MIN(p_size) AS BIGINT) AS a, CAST(MAX(p_size) AS BIGINT) AS b, MIN(p_retailprice) AS c, MAX(p_retailprice) AS e, MIN(p_name) AS f, MAX(p_name) AS g FROM part GROUP BY 1", ()),
    "group_first_last": ("{d}/orders.parquet | sort o_orderdate, o_orderkey | group o_custkey | reduce f = first(o_orderkey), l = last(o_totalprice) | remove grouped",
        "SELECT o_custkey, ARG_MIN(o_orderkey, (o_orderdate, o_orderkey)) AS f, ARG_MAX(o_totalprice, (o_orderdate, o_orderkey)) AS l FROM orders GROUP BY 1", ()),
    "group_null_key": ("{d}/events.parquet | transform k = if(value > 50, event_type, null) | group k | reduce n = count() | remove grouped",
        "SELECT CASE WHEN value > 50 THEN event_type END AS k, COUNT(*) AS n FROM events GROUP BY 1", ()),
    "reduce_expressions": ("{d}/lineitem.parquet | group l_suppkey | reduce span = max(l_linenumber) - min(l_linenumber), share = sum(l_linenumber) / count(), none = max(l_linenumber) is null | remove grouped",
        "SELECT l_suppkey, CAST(MAX(l_linenumber) - MIN(l_linenumber) AS BIGINT) AS span, SUM(l_linenumber) / COUNT(*)::DOUBLE AS share, MAX(l_linenumber) IS NULL AS none FROM lineitem GROUP BY 1", ()),
    "group_nested_length": ("{d}/nation.parquet | group n_regionkey as members | transform n = list_len(members) | remove members", "SELECT CAST(n_regionkey AS BIGINT) AS n_regionkey, COUNT(*) AS n FROM nation GROUP BY 1", ()),
    "reduce_unfused": ("{d}/orders.parquet | group o_custkey | filter {{ list_len(grouped) > 5 }} | reduce n = count(), a = min(o_orderkey), b = max(o_orderkey), s = sum(o_orderkey) | remove grouped",
        "SELECT o_custkey, COUNT(*) AS n, MIN(o_orderkey) AS a, MAX(o_orderkey) AS b, CAST(SUM(o_orderkey) AS BIGINT) AS s FROM orders GROUP BY 1 HAVING COUNT(*) > 5", ()),
    "reduce_named": ("{d}/events.parquet | group user_id as rows | reduce rows n = count(), t = min(event_type) | select user_id, n, t", "SELECT user_id, COUNT(*) AS n, MIN(event_type) AS t FROM events GROUP BY 1", ()),
    # joins
    "join_inner": ("{d}/orders.parquet | join {d}/customer.parquet on o_custkey == c_custkey | select o_orderkey, o_custkey, c_name, c_mktsegment",
        "SELECT o_orderkey, o_custkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey", ()),
    "join_left": ("{d}/customer.parquet | join left {d}/orders.parquet on c_custkey == o_custkey | select c_custkey, o_orderkey, o_totalprice",
        "SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN orders ON c_custkey = o_custkey", ()),
    "join_right": ("{d}/orders.parquet | filter {{ o_totalprice > 300000 }} | join right {d}/customer.parquet on o_custkey == c_custkey | select o_custkey, o_orderkey, c_name",
        "SELECT c_custkey AS o_custkey, o_orderkey, c_name FROM (SELECT * FROM orders WHERE o_totalprice > 300000) RIGHT JOIN customer ON o_custkey = c_custkey", ()),
    "join_full": ("{d}/supplier.parquet | filter {{ s_suppkey > 20 }} | join full {d}/nation.parquet on s_nationkey == n_nationkey | select s_nationkey, s_suppkey, n_name",
        "SELECT CAST(COALESCE(s_nationkey, n_nationkey) AS BIGINT) AS s_nationkey, s_suppkey, n_name FROM (SELECT * FROM supplier WHERE s_suppkey > 20) FULL JOIN nation ON s_nationkey = n_nationkey", ()),
    "join_multi_key": ("{d}/customer.parquet | select c_custkey, c_nationkey | rename c_nationkey = s_nationkey, c_custkey = s_suppkey | join {d}/supplier.parquet on s_suppkey and s_nationkey | select s_suppkey, s_nationkey, s_name",
        "SELECT s_suppkey, CAST(s_nationkey AS BIGINT) AS s_nationkey, s_name FROM customer JOIN supplier ON c_custkey = s_suppkey AND c_nationkey = s_nationkey", ()),
    "join_collision": ("{d}/nation.parquet | transform label = 1 | join {d}/nation.parquet on n_regionkey == n_nationkey | select n_nationkey, n_name, nation_n_name, nation_n_regionkey",
        "SELECT CAST(a.n_nationkey AS BIGINT) AS n_nationkey, a.n_name, b.n_name AS nation_n_name, CAST(b.n_regionkey AS BIGINT) AS nation_n_regionkey FROM nation a JOIN nation b ON a.n_regionkey = b.n_nationkey", ()),
    "join_path_key": ("{d}/supplier.parquet | transform at = struct(nation = s_nationkey) | join {d}/nation.parquet on at.nation == n_nationkey | select s_suppkey, at_nation, n_name",
        "SELECT s_suppkey, CAST(s_nationkey AS BIGINT) AS at_nation, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey", ()),
    # nested values
    "list_functions": ("{d}/embeddings.parquet | transform n = list_len(embedding), xs = list(label, 3, null) | transform c = list_contains(xs, 3), e = list_contains(xs, vec_id) | select vec_id, n, c, e",
        "SELECT vec_id, CAST(LEN(embedding) AS BIGINT) AS n, TRUE AS c, COALESCE(label = vec_id, FALSE) OR vec_id = 3 AS e FROM embeddings", ()),
    "list_mixed": ("{d}/part.parquet | transform xs = list(p_size, p_brand, null, true) | filter {{ list_contains(xs, \"Brand#11\") or list_contains(xs, 7.0) }} | transform n = list_len(xs) | select p_partkey, n",
        "SELECT p_partkey, 4::BIGINT AS n FROM part WHERE p_brand = 'Brand#11' OR p_size = 7", ()),
    "struct_path": ("{d}/supplier.parquet | transform r = struct(name = s_name, at = struct(nation = s_nationkey)) | select s_suppkey, r.at.nation, r.name",
        "SELECT s_suppkey, CAST(s_nationkey AS BIGINT) AS r_at_nation, s_name AS r_name FROM supplier", ()),
    "struct_equality": ("{d}/nation.parquet | transform a = struct(x = n_nationkey, y = n_regionkey), b = struct(y = n_regionkey, x = n_nationkey), c = struct(x = n_regionkey, y = n_regionkey) | transform e = a == b, f = a == c | select n_nationkey, e, f",
        "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, TRUE AS e, n_nationkey = n_regionkey AS f FROM nation", ()),
    "group_struct_key": ("{d}/part.parquet | transform k = struct(b = p_brand, s = p_size > 25) | group k.b, k.s | reduce n = count() | remove grouped", "SELECT p_brand AS k_b, p_size > 25 AS k_s, COUNT(*) AS n FROM part GROUP BY 1, 2", ()),
    # composed
    "pricing_summary": ("{d}/lineitem.parquet | filter {{ year(l_shipdate) < 1998 }} | transform net = l_extendedprice * (1 - l_discount) | transform charge = net * (1 + l_tax) | group l_returnflag, l_linestatus "
        "| reduce qty = sum(l_quantity), base = sum(l_extendedprice), net = sum(net), charge = sum(charge), price = avg(l_extendedprice), n = count() | remove grouped | sort l_returnflag, l_linestatus",
        "SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 2) AS qty, ROUND(SUM(l_extendedprice), 2) AS base, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS net, "
        "ROUND(SUM(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS charge, ROUND(AVG(l_extendedprice), 4) AS price, COUNT(*) AS n FROM lineitem WHERE YEAR(l_shipdate) < 1998 GROUP BY 1, 2",
        ("qty:2", "base:2", "net:2", "charge:2", "price:4")),
    "shipping_priority": ("{d}/customer.parquet | filter {{ c_mktsegment == \"BUILDING\" }} | join {d}/orders.parquet on c_custkey == o_custkey | join {d}/lineitem.parquet on o_orderkey == l_orderkey "
        "| transform v = l_extendedprice * (1 - l_discount) | group o_orderkey | reduce revenue = sum(v) | remove grouped | sort -revenue, o_orderkey | head 10",
        "SELECT o_orderkey, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey "
        "WHERE c_mktsegment = 'BUILDING' GROUP BY 1 ORDER BY SUM(l_extendedprice * (1 - l_discount)) DESC, 1 LIMIT 10", ("revenue:2",)),
    "local_suppliers": ("{d}/customer.parquet | join {d}/orders.parquet on c_custkey == o_custkey | join {d}/lineitem.parquet on o_orderkey == l_orderkey | join {d}/supplier.parquet on l_suppkey == s_suppkey "
        "| filter {{ c_nationkey == s_nationkey }} | join {d}/nation.parquet on c_nationkey == n_nationkey | transform v = l_extendedprice * (1 - l_discount) | group n_name | reduce revenue = sum(v) | remove grouped | sort -revenue",
        "SELECT n_name, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey "
        "JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1", ("revenue:2",)),
    "forecast_revenue": ("{d}/lineitem.parquet | filter {{ year(l_shipdate) == 1996 and l_discount >= 0.03 and l_discount <= 0.07 and l_quantity < 24 }} | transform v = l_extendedprice * l_discount, all = 1 | group all | reduce revenue = sum(v), n = count() | select revenue, n",
        "SELECT ROUND(SUM(l_extendedprice * l_discount), 2) AS revenue, COUNT(*) AS n FROM lineitem WHERE YEAR(l_shipdate) = 1996 AND l_discount >= 0.03 AND l_discount <= 0.07 AND l_quantity < 24", ("revenue:2",)),
}


def query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    text, _, rounded = PIPELINES[name]

    def call(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = run(spark, text.format(d=sf_dir))
        return df.withColumns({c: F.round(c, int(n)) for c, n in (r.split(":") for r in rounded)})

    return call


#: name: (what writes files in the folder {o}, pipeline over them, SQL). ``pack A B kind`` compresses a file.
FILES: dict[str, tuple[list[str], str, str]] = {
    "csv_round_trip": (["{d}/customer.parquet | csv to {o}/c.csv"], "{o}/c.csv", f"SELECT {CUSTOMER} FROM customer"),
    "csv_nulls_and_quotes": (["{d}/events.parquet | transform v = if(value > 50, value, null), t = event_type + \", \\\"q\\\"\\nnext\" | select event_id, v, t | csv to {o}/e.csv"], "{o}/e.csv",
        "SELECT event_id, CASE WHEN value > 50 THEN value END AS v, event_type || ', \"q\"' || CHR(10) || 'next' AS t FROM events"),
    "csv_all_rows_inferred": (["{d}/lineitem.parquet | select l_orderkey, l_quantity, l_returnflag | csv to {o}/l.csv"], "{o}/l.csv with infer_rows=-1 | group l_returnflag | reduce n = count(), q = sum(l_quantity), k = max(l_orderkey) | remove grouped",
        "SELECT l_returnflag, COUNT(*) AS n, SUM(l_quantity) AS q, MAX(l_orderkey) AS k FROM lineitem GROUP BY 1"),
    "csv_text_only": (["{d}/nation.parquet | csv to {o}/n.csv"], "{o}/n.csv with infer_rows=0", "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation"),
    "csv_no_header": (["{d}/nation.parquet | filter { n_nationkey > 0 } | csv to {o}/n.csv"], "{o}/n.csv with header=false, infer_rows=-1 | filter { col2 != \"n_name\" } | select col1, col3",
        "SELECT CAST(n_nationkey AS VARCHAR) AS col1, CAST(n_regionkey AS VARCHAR) AS col3 FROM nation WHERE n_nationkey > 0"),
    "csv_delimiter": (["{d}/nation.parquet | select n_name, n_nationkey | csv to {o}/n.csv"], "{o}/n.csv with delim=\";\" | rename `n_name,n_nationkey` = both", "SELECT n_name || ',' || n_nationkey AS both FROM nation"),
    "csv_describe": (["{d}/part.parquet | csv to {o}/p.csv"], "{o}/p.csv with infer_rows=-1 | describe | select column, type, row_count",
        "SELECT UNNEST(['p_partkey', 'p_name', 'p_brand', 'p_type', 'p_size', 'p_retailprice']) AS column, UNNEST(['int', 'string', 'string', 'string', 'int', 'float']) AS type, (SELECT COUNT(*) FROM part) AS row_count"),
    "csv_glob": (["{d}/orders.parquet | csv with split_rows=700 to {o}/o-{n}.csv"], "{o}/o-*.csv | group o_orderstatus | reduce n = count(), k = sum(o_orderkey) | remove grouped",
        "SELECT o_orderstatus, COUNT(*) AS n, CAST(SUM(o_orderkey) AS BIGINT) AS k FROM orders GROUP BY 1"),
    "csv_glob_columns": (["{d}/nation.parquet | csv to {o}/a.csv", "{d}/nation.parquet | transform more = n_regionkey + 1 | select more, n_name, n_regionkey, n_nationkey | csv to {o}/b.csv"], "{o}/*.csv",
        f"SELECT {NATION}, CAST(NULL AS BIGINT) AS more FROM nation UNION ALL SELECT {NATION}, CAST(n_regionkey AS BIGINT) + 1 FROM nation"),
    "csv_bad_records": (["{d}/nation.parquet | csv to {o}/a.csv", "{d}/region.parquet | transform n_nationkey = \"none\", n_name = r_name, n_regionkey = r_regionkey | select n_nationkey, n_name, n_regionkey | csv to {o}/b.csv"],
        "{o}/*.csv with max_bad_records=5, infer_rows=20", f"SELECT {NATION} FROM nation"),
    "csv_gzip": (["{d}/supplier.parquet | csv to {o}/s.csv", "pack {o}/s.csv {o}/s.csv.gz gzip"], "{o}/s.csv.gz | select s_suppkey, s_name", "SELECT s_suppkey, s_name FROM supplier"),
    "jsonl_zstd": (["{d}/supplier.parquet | jsonl to {o}/s.jsonl", "pack {o}/s.jsonl {o}/s.jsonl.zst zstd"], "{o}/s.jsonl.zst | select s_suppkey, s_name", "SELECT s_suppkey, s_name FROM supplier"),
    "csv_zlib": (["{d}/nation.parquet | csv to {o}/n.csv", "pack {o}/n.csv {o}/n.csv.zlib zlib"], "{o}/n.csv.zlib", f"SELECT {NATION} FROM nation"),
    "json_zlib_option": (["{d}/nation.parquet | json to {o}/n.json", "pack {o}/n.json {o}/n.data zlib"], "{o}/n.data with format=json, compression=deflate", f"SELECT {NATION} FROM nation"),
    "csv_standard_input": (["{d}/nation.parquet | csv to {o}/stdin"], "- with format=csv | filter { n_regionkey > 1 }", f"SELECT {NATION} FROM nation WHERE n_regionkey > 1"),
    "json_array": (["{d}/customer.parquet | json to {o}/c.json"], "{o}/c.json", f"SELECT {CUSTOMER} FROM customer"),
    "json_glob": (["{d}/orders.parquet | select o_orderkey, o_totalprice | json with split_rows=900 to {o}/"], "{o}/*.json with infer_rows=-1 | filter { o_totalprice > 100000 }", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000"),
    "jsonl_round_trip": (["{d}/part.parquet | jsonl to {o}/p.jsonl"], "{o}/p.jsonl | filter { p_size > 20 }", f"SELECT {PART} FROM part WHERE p_size > 20"),
    "jsonl_nested": (["{d}/nation.parquet | group n_regionkey as members | jsonl to {o}/n.jsonl"], "{o}/n.jsonl | reduce members n = count(), k = sum(n_nationkey), a = min(n_name) | remove members",
        "SELECT CAST(n_regionkey AS BIGINT) AS n_regionkey, COUNT(*) AS n, CAST(SUM(n_nationkey) AS BIGINT) AS k, MIN(n_name) AS a FROM nation GROUP BY 1"),
    "jsonl_path": (["{d}/supplier.parquet | transform at = struct(nation = s_nationkey, name = s_name) | select s_suppkey, at | jsonl to {o}/s.jsonl"], "{o}/s.jsonl | select s_suppkey, at.name, at.nation",
        "SELECT s_suppkey, s_name AS at_name, CAST(s_nationkey AS BIGINT) AS at_nation FROM supplier"),
    "jsonl_nulls": (["{d}/events.parquet | transform v = if(value > 50, value, null) | select event_id, v | jsonl to {o}/e.jsonl"], "{o}/e.jsonl | filter { v is null } | count", "SELECT COUNT(*) AS count FROM events WHERE value <= 50 OR value IS NULL"),
    "avro_round_trip": (["{d}/customer.parquet | avro to {o}/c.avro"], "{o}/c.avro", f"SELECT {CUSTOMER} FROM customer"),
    "avro_nested": (["{d}/nation.parquet | group n_regionkey as members | avro to {o}/n.avro"], "{o}/n.avro | transform n = list_len(members) | select n_regionkey, n", "SELECT CAST(n_regionkey AS BIGINT) AS n_regionkey, COUNT(*) AS n FROM nation GROUP BY 1"),
    "avro_glob": (["{d}/orders.parquet | select o_orderkey, o_custkey | avro with split_rows=600 to {o}/"], "{o}/*.avro | group o_custkey | reduce n = count(), k = max(o_orderkey) | remove grouped", "SELECT o_custkey, COUNT(*) AS n, MAX(o_orderkey) AS k FROM orders GROUP BY 1"),
    "parquet_round_trip": (["{d}/lineitem.parquet | select l_orderkey, l_linenumber, l_extendedprice | sort -l_extendedprice, l_orderkey | parquet to {o}/l.parquet"], "{o}/l.parquet | head 20",
        f"SELECT l_orderkey, {ints('l_linenumber')}, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey LIMIT 20"),
    "parquet_parts": (["{d}/orders.parquet | sort -o_orderkey | parquet with split_rows=1000 to {o}/"], "{o}/output-1.parquet | select o_orderkey, o_orderstatus", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey DESC LIMIT 1000"),
    "parquet_glob": (["{d}/nation.parquet | parquet to {o}/a.parquet", "{d}/nation.parquet | transform n_regionkey = \"r\" + n_name | parquet to {o}/b.parquet"], "{o}/*.parquet | select n_nationkey, n_regionkey",
        "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation UNION ALL SELECT n_nationkey, 'r' || n_name FROM nation"),
    "parquet_overwrite": (["{d}/nation.parquet | parquet to {o}/n.parquet", "{d}/region.parquet | parquet with overwrite=true to {o}/n.parquet"], "{o}/n.parquet", f"SELECT {ints('r_regionkey')}, r_name FROM region"),
    "join_csv_with_jsonl": (["{d}/supplier.parquet | csv to {o}/s.csv", "{d}/nation.parquet | jsonl to {o}/n.jsonl"], "{o}/s.csv | join {o}/n.jsonl on s_nationkey == n_nationkey | select s_suppkey, n_name",
        "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey"),
}


def pack(source: str, target: str, kind: str) -> None:
    import gzip
    import zlib

    import zstandard

    with open(source, "rb") as file, open(target, "wb") as out:
        out.write({"gzip": gzip.compress, "zlib": zlib.compress, "zstd": zstandard.ZstdCompressor().compress}[kind](file.read()))


def file_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    """Write files with the language, then read them with it."""
    steps, text, _ = FILES[name]

    def call(spark: SparkSession, sf_dir: str) -> DataFrame:
        folder = scratch_file(spark, name)
        os.makedirs(folder)
        at = lambda x: x.replace("{d}", sf_dir).replace("{o}", folder)
        for step in steps:
            if step.startswith("pack "):
                pack(*at(step).split()[1:])
            else:
                step = at(step)
                execute(spark, step + ".csv" if step.endswith("/stdin") else step, None)
        stdin = open(f"{folder}/stdin.csv", "rb") if text.startswith("- ") else None
        return run(spark, at(text), stdin=stdin)

    return call


QUERIES = {name: query(name) for name in PIPELINES} | {name: file_query(name) for name in FILES}
ORACLES = {name: sql for name, (_, sql, _) in PIPELINES.items()} | {name: sql for name, (_, _, sql) in FILES.items()}
