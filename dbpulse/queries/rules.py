"""Queries of plans P01-P09, anti-pattern rules D02-D11 and coverage E01-E09."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import index_facts
from ..operators import antipatterns as D
from ..operators import coverage as E
from ..operators import index_rules as X
from ..operators import n_plus_one as N
from ..operators import windows
from ..operators.rounds import written
from ..plans import flatten as P
from ..sources.fixtures import ctes, define, view
from . import ORACLE_SQL, QUERIES, counters, graphs, query  # noqa: F401  the rules' own queries
from .counters import ADMITTED, DB_BEFORE, LAG
from .texts import FACTS

# Plan texts in both vendors' layouts, one per order
define("pg_plan", [], """
SELECT o_orderkey AS id, CASE o_orderkey % 3
  WHEN 0 THEN concat('{"Node Type":"Aggregate","Plan Rows":1,"Plans":[{"Node Type":"Hash Join","Plan Rows":', cast(o_custkey AS string), ',"Plans":[{"Node Type":"Seq Scan","Relation Name":"orders","Alias":"o","Plan Rows":', cast(o_orderkey AS string), ',"Filter":"(o_total > 1)"},{"Node Type":"Hash","Plans":[{"Node Type":"Index Scan","Relation Name":"customer","Index Name":"customer_pk","Plan Rows":1}]}]}]}')
  WHEN 1 THEN concat('{"Node Type":"Bitmap Heap Scan","Relation Name":"lineitem","Plan Rows":', cast(o_custkey AS string), ',"Recheck Cond":"(l_partkey = 1)","Filter":"(l_tax > 0)","Plans":[{"Node Type":"Bitmap Index Scan","Index Name":"lineitem_part","Plan Rows":7,"Index Cond":"(l_partkey = 1)"}]}')
  ELSE concat('{"Node Type":"Sort","Plan Rows":', cast(o_custkey AS string), ',"Plans":[{"Node Type":"Index Scan","Relation Name":"part","Index Name":"part_pk","Plan Rows":2,"Index Cond":"(p_partkey = 5)"}]}') END AS plan FROM @orders""")
PG = """nd(k, path, node) AS (SELECT id, '0', plan FROM pg_plan UNION ALL SELECT k, path || '.' || length(CAST(c.i - 1 AS VARCHAR)) || ':' || (c.i - 1), CAST(json_extract(node, '$.Plans[' || (c.i - 1) || ']') AS VARCHAR)
  FROM nd, LATERAL (SELECT unnest(range(1, cast(coalesce(json_array_length(node, '$.Plans'), 0) AS BIGINT) + 1)) AS i) c),
op AS (SELECT k AS id, path, json_extract_string(node, '$."Node Type"') AS node_type, json_extract_string(node, '$."Relation Name"') AS table_name, json_extract_string(node, '$.Alias') AS alias, json_extract_string(node, '$."Index Name"') AS index_name,
  CAST(json_extract_string(node, '$."Plan Rows"') AS DOUBLE) AS estimated_rows, coalesce(json_extract_string(node, '$."Index Cond"'), json_extract_string(node, '$."Recheck Cond"')) AS c, json_extract_string(node, '$.Filter') AS f FROM nd),
ty AS (SELECT *, CASE WHEN node_type LIKE '%Scan' THEN 'scan' WHEN node_type = 'Hash Join' THEN 'join' WHEN node_type = 'Aggregate' THEN 'aggregate' WHEN node_type = 'Sort' THEN 'sort' END AS type FROM op)"""
PGW = ctes("pg_plan").replace("WITH ", "WITH RECURSIVE ", 1) + f", {PG}"


def pg_ops(spark, sf_dir):
    return P.flatten_pg_plan(view(spark, sf_dir, "pg_plan"), "id", "plan")


@query("p01_flatten_pg_plan", PGW + """ SELECT id, path, node_type, type, table_name, alias, index_name, estimated_rows, CASE WHEN c IS NOT NULL AND f IS NOT NULL THEN '(' || c || ') AND (' || f || ')' ELSE coalesce(c, f) END AS predicate FROM ty WHERE type IS NOT NULL""")
def p01(spark, sf_dir):
    return pg_ops(spark, sf_dir).drop("access_method")


@query("p03_access_method", PGW + """ SELECT id, path, CASE WHEN node_type = 'Seq Scan' THEN 'full_table_scan' WHEN type = 'scan' AND c IS NULL THEN 'full_index_scan' WHEN type = 'scan' THEN 'index_lookup' END AS access_method FROM ty WHERE type IS NOT NULL""")
def p03(spark, sf_dir):
    return pg_ops(spark, sf_dir).select("id", "path", "access_method")


@query("p04_bitmap_attrib", PGW + """ SELECT id, path, CASE WHEN node_type = 'Bitmap Index Scan' THEN 'lineitem' ELSE table_name END AS table_name, CASE WHEN node_type = 'Bitmap Heap Scan' THEN 'lineitem_part' ELSE index_name END AS index_name FROM ty WHERE type IS NOT NULL""")
def p04(spark, sf_dir):
    return P.bitmap_attrib(pg_ops(spark, sf_dir), "id").select("id", "path", "table_name", "index_name")


@query("p05_and_conditions", PGW + """ SELECT id, path, CASE WHEN c IS NOT NULL AND f IS NOT NULL THEN '(' || c || ') AND (' || f || ')' ELSE coalesce(c, f) END AS predicate FROM ty WHERE type = 'scan' AND (c IS NOT NULL OR f IS NOT NULL)""")
def p05(spark, sf_dir):
    return pg_ops(spark, sf_dir).filter("type = 'scan' and predicate is not null").select("id", "path", "predicate")


@query("p07_logical_shape", PGW + " SELECT id, " + ", ".join(f"count(*) FILTER (type = '{t}') AS {t}" for t in ("scan", "join", "aggregate", "sort", "distinct", "subquery")) + " FROM ty WHERE type IS NOT NULL GROUP BY id")
def p07(spark, sf_dir):
    return P.logical_shape(pg_ops(spark, sf_dir), "id")


T_ORDERS = '{"table":{"table_name":"orders","access_type":"ALL","rows_examined_per_scan\":\', cast(o_custkey AS string), \',"rows_produced_per_join":\', cast(o_custkey % 90 AS string), \',"filtered":"25.00","attached_condition":"(a > 1)","index_condition":"(b = 2)"}}'
T_CUSTOMER = '{"table":{"table_name":"customer","access_type":"eq_ref","key":"PRIMARY","rows_examined_per_scan":1,"rows_produced_per_join":\', cast(o_custkey % 70 AS string), \',"filtered":"100.00"}}'
define("my_plan", [], f"""
SELECT o_orderkey AS id, CASE o_orderkey % 4
  WHEN 0 THEN concat('{{"query_block":{{"ordering_operation":{{"using_filesort":true,"grouping_operation":{{"using_temporary_table":true,"nested_loop":[{T_ORDERS},{T_CUSTOMER}]}}}}}}}}')
  WHEN 1 THEN concat('{{"query_block":{{"table":{{"table_name":"part","access_type":"index","key":"part_brand","rows_examined_per_scan":', cast(o_orderkey AS string), ',"rows_produced_per_join":', cast(o_custkey AS string), ',"filtered":"10.00"}}}}}}')
  WHEN 2 THEN concat('{{"query_block":{{"duplicates_removal":{{"using_temporary_table":true,"nested_loop":[{T_ORDERS},{T_CUSTOMER}]}}}}}}')
  ELSE concat('{{"query_block":{{"table":{{"table_name":"supplier","access_type":"ref","key":"supplier_nation","rows_produced_per_join":', cast(o_custkey AS string), ',"attached_subqueries":[{{"dependent":true,"query_block":{{"table":{{"table_name":"nation","access_type":"ALL","rows_examined_per_scan":25,"rows_produced_per_join":25,"filtered":"100.00"}}}}}}]}}}}}}') END AS plan, o_custkey FROM @orders""")
_BLOCK = "0.query_block"
_OPS = [  # shape, path, type, table, index, access method, predicate, estimated rows, produced rows, in a subquery
    (0, ".ordering_operation", "sort", None, None, None, "true", "NULL", "NULL", False), (0, ".ordering_operation.grouping_operation", "aggregate", None, None, None, "true", "NULL", "NULL", False),
    (0, ".ordering_operation.grouping_operation.nested_loop", "join", None, None, None, None, "NULL", "NULL", False),
    (0, ".ordering_operation.grouping_operation.nested_loop.1:0.table", "scan", "orders", None, "full_table_scan", "((b = 2)) AND ((a > 1))", "round(o_custkey * 25.0 / 100, 2)", "o_custkey % 90", False),
    (0, ".ordering_operation.grouping_operation.nested_loop.1:1.table", "scan", "customer", "PRIMARY", "index_lookup", None, "1.0", "o_custkey % 70", False),
    (1, ".table", "scan", "part", "part_brand", "full_index_scan", None, "round(id * 10.0 / 100, 2)", "o_custkey", False),
    (2, ".duplicates_removal", "distinct", None, None, None, None, "NULL", "NULL", False), (2, ".duplicates_removal.nested_loop", "join", None, None, None, None, "NULL", "NULL", False),
    (2, ".duplicates_removal.nested_loop.1:0.table", "scan", "orders", None, "full_table_scan", "((b = 2)) AND ((a > 1))", "round(o_custkey * 25.0 / 100, 2)", "o_custkey % 90", False),
    (2, ".duplicates_removal.nested_loop.1:1.table", "scan", "customer", "PRIMARY", "index_lookup", None, "1.0", "o_custkey % 70", False),
    (3, ".table", "scan", "supplier", "supplier_nation", "index_lookup", None, "o_custkey", "o_custkey", False), (3, ".table.attached_subqueries", "subquery", None, None, None, None, "NULL", "NULL", True),
    (3, ".table.attached_subqueries.1:0.query_block.table", "scan", "nation", None, "full_table_scan", None, "25.0", "25", True),
]
_text = lambda x: "NULL" if x is None else f"'{x}'"
MY = "mo AS (" + " UNION ALL ".join(
    f"SELECT id, '{_BLOCK}{p}' AS path, '{t}' AS type, {_text(n)} AS table_name, {_text(i)} AS index_name, {_text(m)} AS access_method, {_text(c)} AS predicate, CAST({e} AS DOUBLE) AS estimated_rows, CAST({r} AS DOUBLE) AS produced, {q} AS in_subquery FROM my_plan WHERE id % 4 = {k}"
    for k, p, t, n, i, m, c, e, r, q in _OPS) + ")"


def my_ops(spark, sf_dir):
    return P.flatten_my_plan(view(spark, sf_dir, "my_plan"), "id", "plan")


@query("p02_flatten_my_plan", ctes("my_plan") + f", {MY} SELECT id, path, type, table_name, index_name, access_method, predicate, in_subquery FROM mo")
def p02(spark, sf_dir):
    return my_ops(spark, sf_dir).select("id", "path", "type", "table_name", "index_name", "access_method", "predicate", "in_subquery")


@query("p06_row_estimates", ctes("my_plan") + f", {MY} SELECT id, max_by(produced, path) FILTER (NOT in_subquery) AS output_rows, sum(estimated_rows) AS scanned_rows FROM mo WHERE type = 'scan' GROUP BY id")
def p06(spark, sf_dir):
    return P.output_rows(my_ops(spark, sf_dir), "id")


define("plan_row", ["ev"], """SELECT event_id AS plan_id, db_id, user_id AS query_id, CASE k % 4 WHEN 0 THEN 'auto_explain' WHEN 1 THEN 'generic' WHEN 2 THEN 'history' ELSE 'sample' END AS explain_source, v AS total_cost FROM ev""")


@query("p08_best_plan", ctes("plan_row") + """ SELECT db_id, query_id, plan_id, explain_source FROM plan_row QUALIFY row_number() OVER (PARTITION BY db_id, query_id ORDER BY list_position(['auto_explain', 'history', 'generic', 'sample'], explain_source), total_cost, plan_id) = 1""")
def p08(spark, sf_dir):
    return P.best_plan(view(spark, sf_dir, "plan_row"), ["db_id", "query_id"]).select("db_id", "query_id", "plan_id", "explain_source")


define("tree_node", ["ev"], """
SELECT event_id AS tree, 0 AS node_id, -1 AS parent_id, 0 AS level, CASE WHEN k % 2 = 0 THEN 'and' ELSE 'or' END AS kind, cast(NULL AS string) AS state FROM ev
UNION ALL SELECT event_id, 1, 0, 1, 'leaf', CASE k % 3 WHEN 0 THEN 'OK' WHEN 1 THEN 'FIX' ELSE 'OTHER' END FROM ev UNION ALL SELECT event_id, 2, 0, 1, CASE WHEN user_id % 2 = 0 THEN 'and' ELSE 'or' END, NULL FROM ev
UNION ALL SELECT event_id, 3, 2, 2, 'leaf', CASE user_id % 3 WHEN 0 THEN 'OK' WHEN 1 THEN 'FIX' ELSE 'OTHER' END FROM ev UNION ALL SELECT event_id, 4, 2, 2, 'leaf', CASE k % 5 WHEN 0 THEN 'OK' WHEN 1 THEN 'FIX' ELSE 'OTHER' END FROM ev""")


@query("p09_usable_tree", ctes("ev") + """, s AS (SELECT event_id AS tree, k, user_id, k % 3 = 0 AS a, k % 3 < 2 AS af, user_id % 3 = 0 AS b, user_id % 3 < 2 AS bf, k % 5 = 0 AS c, k % 5 < 2 AS cf FROM ev),
i AS (SELECT *, CASE WHEN user_id % 2 = 0 THEN b OR c ELSE b AND c END AS n, CASE WHEN user_id % 2 = 0 THEN bf OR cf ELSE bf AND cf END AS nf FROM s),
r AS (SELECT tree, CASE WHEN k % 2 = 0 THEN a OR n ELSE a AND n END AS usable, CASE WHEN k % 2 = 0 THEN af OR nf ELSE af AND nf END AS fx FROM i) SELECT tree, usable, NOT usable AND fx AS fixable FROM r""")
def p09(spark, sf_dir):
    return P.usable_tree(view(spark, sf_dir, "tree_node"))


# what the five fingerprints read, filter by equality and how they are planned
READS = [("click", "lineitem"), ("view", "orders"), ("error", "customer"), ("purchase", "nation"), ("signup", "supplier")]
define("reads", [], " UNION ALL ".join(f"SELECT '{q}' AS query_id, '{t}' AS table_name" for q, t in READS))
EQUAL = [("click", "l_orderkey"), ("view", "o_custkey"), ("error", "c_nationkey"), ("signup", "s_nationkey"), ("purchase", "n_name")]
define("equal_col", [], " UNION ALL ".join(f"SELECT '{q}' AS query_id, '{c}' AS column_name" for q, c in EQUAL))
define("filter_col", ["reads", "equal_col"], "SELECT r.query_id, r.table_name, e.column_name FROM reads r JOIN equal_col e ON r.query_id = e.query_id")
define("plan_op", ["reads", "db"], """SELECT db_id, query_id, 0 AS op_pos, CASE WHEN db_id = 'db0' THEN cast(NULL AS string) WHEN db_id = 'db3' THEN 'other' ELSE 'public' END AS schema_name, table_name, CASE WHEN query_id IN ('click', 'view', 'error') THEN 'full_table_scan' ELSE 'index_lookup' END AS access_method,
  CASE WHEN query_id = 'signup' THEN 'supplier_nation' END AS index_name, query_id <> 'error' AS simple FROM reads CROSS JOIN db""")
# condition trees of the two scanned queries, in three shapes by database
_N = "cast(replace(db_id, 'db', '') AS bigint) % 3"
_COND = [  # shape, query, table, node, parent, level, kind, column, wrapper, comparator, type
    (0, "click", "lineitem", 0, -1, 0, "and", None, None, None, None), (0, "click", "lineitem", 1, 0, 1, "leaf", "l_tax", "none", "range", None), (0, "click", "lineitem", 2, 0, 1, "or", None, None, None, None),
    (0, "click", "lineitem", 3, 2, 2, "leaf", "l_discount", "none", "eq", "numeric"), (0, "click", "lineitem", 4, 2, 2, "leaf", "l_partkey", "none", "eq", "int"),
    (0, "view", "orders", 0, -1, 0, "or", None, None, None, None), (0, "view", "orders", 1, 0, 1, "leaf", "o_custkey", "function", "eq", "int"), (0, "view", "orders", 2, 0, 1, "leaf", "o_orderdate", "function", "range", "date"),
    (1, "click", "lineitem", 0, -1, 0, "or", None, None, None, None), (1, "click", "lineitem", 1, 0, 1, "leaf", "l_tax", "none", "range", "numeric"), (1, "click", "lineitem", 2, 0, 1, "and", None, None, None, None),
    (1, "click", "lineitem", 3, 2, 2, "leaf", "l_comment", "none", "like", "text"), (1, "click", "lineitem", 4, 2, 2, "leaf", "l_discount", "none", "eq", None), (1, "view", "orders", 0, -1, 0, "leaf", "o_custkey", "arithmetic", "range", "int"),
    (2, "click", "lineitem", 0, -1, 0, "or", None, None, None, None), (2, "click", "lineitem", 1, 0, 1, "leaf", "l_comment", "none", "like", "text"), (2, "click", "lineitem", 2, 0, 1, "leaf", "l_discount", "none", "eq", "numeric"),
    (2, "view", "orders", 0, -1, 0, "and", None, None, None, None), (2, "view", "orders", 1, 0, 1, "leaf", "o_custkey", "none", "eq", "int"), (2, "view", "orders", 2, 0, 1, "leaf", "o_orderdate", "cast", "range", "date"),
]
_cast = lambda x: "cast(NULL AS string)" if x is None else f"'{x}'"
define("cond_node", ["db"], " UNION ALL ".join(
    f"SELECT db_id, '{q}' AS query_id, '{t}' AS table_name, {n} AS node_id, {p} AS parent_id, {l} AS level, '{k}' AS kind, {_cast(c)} AS column_name, {_cast(w)} AS wrapper, {_cast(o)} AS comparator, {_cast(d)} AS data_type FROM db WHERE {_N} = {i}"
    for i, q, t, n, p, l, k, c, w, o, d in _COND))
ROWS = f"""{DB_BEFORE}, rw0 AS (SELECT db_id, query_id, captured_at, lag(captured_at) {LAG} IS NULL AS is_new, coalesce(counters_epoch <> lag(counters_epoch IGNORE NULLS) {LAG}, false) AS reset, {ADMITTED.format(s=21600)} AS admitted,
  lag(captured_at) {LAG} AS window_start, execution_count - coalesce(lag(execution_count) {LAG}, 0) AS calls, rows_returned - coalesce(lag(rows_returned) {LAG}, 0) AS rows,
  CASE WHEN lag(captured_at) {LAG} IS NULL THEN total_time_ms ELSE total_time_ms - lag(total_time_ms) {LAG} END AS t FROM stmt JOIN caps USING (db_id, captured_at)),
rw AS (SELECT db_id, query_id, captured_at, window_start, is_new, calls, rows, CASE WHEN t >= 0 THEN t END AS time_ms FROM rw0 WHERE NOT reset AND (NOT is_new OR admitted) AND calls > 0 AND rows >= 0)"""
SCAN = f"""{ROWS}, fs AS (SELECT w.db_id, w.captured_at, w.query_id, o.table_name, t.live_rows, w.calls, w.rows / w.calls / t.live_rows AS selectivity FROM rw w JOIN plan_op o USING (db_id, query_id) JOIN table_stats t ON t.db_id = w.db_id AND t.table_name = o.table_name
  WHERE simple AND access_method = 'full_table_scan' AND live_rows >= 1000 AND w.calls >= 2 AND w.rows / w.calls / t.live_rows <= 0.1)"""
BASE = ctes("stmt", "plan_op", "table_stats", "cond_node", "index_catalog") + f", {SCAN}, {FACTS}, ld AS (SELECT DISTINCT db_id, table_name, columns[1] AS column_name FROM fa WHERE NOT is_partial AND columns[1] IS NOT NULL), bs AS (SELECT DISTINCT db_id, query_id, table_name FROM fs)"


def rows(spark, sf_dir):
    return windows.rows_windows(view(spark, sf_dir, "stmt"), 21600)


def scans(spark, sf_dir):
    return D.avoidable_full_scan(rows(spark, sf_dir), view(spark, sf_dir, "plan_op"), view(spark, sf_dir, "table_stats"), live_rows=1000)


def facts(spark, sf_dir):
    return index_facts(view(spark, sf_dir, "index_catalog"))


@query("d02_avoidable_full_scan", BASE + " SELECT * FROM fs")
def d02(spark, sf_dir):
    return scans(spark, sf_dir)


# worked out by hand for each shape: of an OR every wrapped branch, nothing where a bare column already leads an index
@query("d03_non_sargable", BASE + f""", a(n, column_name, subtype, in_or, partial_only) AS (VALUES (0, 'o_custkey', 'function', true, false), (0, 'o_orderdate', 'function', true, true), (1, 'o_custkey', 'arithmetic', false, false))
SELECT db_id, query_id, table_name, column_name, subtype, in_or, partial_only FROM bs JOIN a ON {_N} = n WHERE query_id = 'view'""")
def d03(spark, sf_dir):
    return D.non_sargable(scans(spark, sf_dir), view(spark, sf_dir, "cond_node"), facts(spark, sf_dir))


# of an AND the part without OR; of an OR an index for each branch; nothing where one branch cannot be helped
@query("d04_missing_index", BASE + f""", a(n, columns, suggested_index, per_branch, unverified) AS (VALUES (0, 'l_tax', 'CREATE INDEX ON lineitem (l_tax)', false, 'l_tax'),
  (1, 'l_discount, l_tax', 'CREATE INDEX ON lineitem (l_discount); CREATE INDEX ON lineitem (l_tax)', true, 'l_discount')) SELECT db_id, query_id, table_name, columns, suggested_index, per_branch, unverified FROM bs JOIN a ON {_N} = n WHERE query_id = 'click'""")
def d04(spark, sf_dir):
    return D.missing_index(scans(spark, sf_dir), view(spark, sf_dir, "cond_node"), facts(spark, sf_dir))


# the catalog in two schemas with equal names, and one index name on two tables, of which plans cite one
define("index_all", ["index_catalog", "db"], f"""
SELECT db_id, schema_name, table_name, index_name, index_ref, index_scans, last_index_scan, index_size_bytes FROM index_catalog
UNION ALL SELECT db_id, 'archive', table_name, index_name, replace(index_ref, 'public.', 'archive.'), (index_scans + 2) % 3, last_index_scan, index_size_bytes FROM index_catalog WHERE {_N} = 2 AND table_name <> 'part'
UNION ALL SELECT db_id, 'public', 'orders', 'by_key', 'CREATE INDEX by_key ON public.orders USING btree (o_clerk)', 0, cast(NULL AS string), 8192 FROM db
UNION ALL SELECT db_id, 'public', 'supplier', 'by_key', 'CREATE INDEX by_key ON public.supplier USING btree (s_acctbal)', 0, cast(NULL AS string), 8192 FROM db
UNION ALL SELECT db_id, 'public', 'orders', 'orders_some', 'CREATE INDEX orders_some ON public.orders USING btree (o_custkey) WHERE (o_clerk IS NULL)', 3, cast(NULL AS string), 8192 FROM db""")
_AT = "CASE cast(replace(db_id, 'db', '') AS bigint) % 7 WHEN 0 THEN cast(NULL AS string) WHEN 3 THEN 'archive' WHEN 5 THEN 'elsewhere' ELSE 'public' END"
define("plan_use", ["plan_op", "db"], f"""
SELECT db_id, query_id, {_AT} AS schema_name, table_name, access_method, index_name FROM plan_op
UNION ALL SELECT db_id, 'signup', {_AT}, 'supplier', 'index_lookup', 'by_key' FROM db UNION ALL SELECT db_id, 'view', {_AT}, 'orders', 'index_lookup', 'orders_cust_date' FROM db WHERE {_N} = 2""")
define("filter_at", ["filter_col", "db"], f"SELECT db_id, query_id, {_AT} AS schema_name, table_name, column_name FROM filter_col CROSS JOIN db")
define("fk_rel", ["fk", "db"], f"""
SELECT db_id, 'public' AS schema_name, table_name, constraint_name, column_name, 'public' AS referenced_schema, referenced_table, referenced_column FROM fk CROSS JOIN db
UNION ALL SELECT db_id, 'Archive', upper(table_name), constraint_name, column_name, 'Archive', referenced_table, referenced_column FROM fk CROSS JOIN db WHERE {_N} = 2""")
FACTS_ALL = FACTS.replace("FROM index_catalog", "FROM index_all")
USED = """ct AS (SELECT DISTINCT db_id, table_name, index_name, schema_name AS cited, EXISTS (FROM index_all c WHERE c.db_id = o.db_id AND c.table_name = o.table_name AND c.index_name = o.index_name AND c.schema_name = o.schema_name) AS known FROM plan_use o WHERE index_name IS NOT NULL),
us AS (SELECT DISTINCT c.db_id, c.schema_name, c.table_name, c.index_name FROM index_all c JOIN ct USING (db_id, table_name, index_name) WHERE NOT known OR cited = c.schema_name),
fx AS (SELECT fa.*, u.db_id IS NOT NULL AS in_plans, index_scans > 0 OR last_index_scan IS NOT NULL OR u.db_id IS NOT NULL AS has_reads FROM fa LEFT JOIN us u USING (db_id, schema_name, table_name, index_name))"""
ACT = f"""ac AS (SELECT db_id, query_id, captured_at, CASE WHEN whole THEN execution_count ELSE execution_count - pc END AS calls, CASE WHEN whole THEN total_time_ms ELSE total_time_ms - pt END AS time_ms
  FROM (SELECT *, coalesce(lag(captured_at) {LAG} IS NULL OR counters_epoch <> lag(counters_epoch IGNORE NULLS) {LAG} OR execution_count < lag(execution_count) {LAG}, false) AS whole, lag(execution_count) {LAG} AS pc, lag(total_time_ms) {LAG} AS pt FROM stmt)
  WHERE CASE WHEN whole THEN execution_count ELSE execution_count - pc END > 0),
tr AS (SELECT db_id, query_id, schema_name, table_name, any_value(time_ms) AS time_ms, list_sort(list(DISTINCT column_name)) AS columns,
    bool_or(EXISTS (FROM plan_use p WHERE p.db_id = f.db_id AND p.query_id = f.query_id AND p.table_name = f.table_name AND p.schema_name IS NOT DISTINCT FROM f.schema_name AND p.access_method LIKE 'full%')) AS scan
  FROM filter_at f JOIN (SELECT db_id, query_id, round(sum(time_ms), 6) AS time_ms FROM ac GROUP BY 1, 2) USING (db_id, query_id) GROUP BY 1, 2, 3, 4),
ts AS (SELECT db_id, table_name, list(DISTINCT coalesce(schema_name, '')) AS ats FROM tr GROUP BY 1, 2),
pl AS (SELECT i.db_id, i.schema_name, i.table_name, CASE WHEN list_contains(ats, i.schema_name) THEN i.schema_name WHEN list_contains(ats, '') THEN '' END AS pat FROM (SELECT DISTINCT db_id, schema_name, table_name FROM index_all) i JOIN ts USING (db_id, table_name))"""
RED = """ux AS (SELECT *, (is_unique::INT, has_reads::INT, index_scans) AS worth, db_id IN (SELECT db_id FROM db_fresh WHERE fresh) AS fresh FROM fx JOIN pl USING (db_id, schema_name, table_name) WHERE pat IS NOT NULL AND len(list_filter(columns, lambda c: c IS NULL)) = 0),
pr AS (SELECT a.db_id, a.schema_name, a.table_name, a.index_name, a.in_plans, a.is_partial, b.index_name AS other, a.columns = b.columns AS same FROM ux a JOIN ux b ON a.db_id = b.db_id AND a.schema_name = b.schema_name AND a.table_name = b.table_name AND a.method = b.method AND a.index_name <> b.index_name
  WHERE NOT a.is_unique AND NOT b.is_partial AND (a.fresh OR b.has_reads) AND ((a.columns = b.columns AND NOT a.is_partial AND (b.worth > a.worth OR (b.worth = a.worth AND b.index_name < a.index_name))) OR (len(b.columns) > len(a.columns) AND b.columns[1:len(a.columns)] = a.columns))),
rd AS (SELECT db_id, schema_name, table_name, index_name, arg_min(other, (NOT same, other)) AS covered_by, CASE WHEN bool_or(same) THEN 'copy' ELSE 'prefix' END AS kind, CASE WHEN in_plans THEN 'medium' ELSE 'low' END AS severity, CASE WHEN in_plans OR is_partial THEN 'low' ELSE 'high' END AS confidence FROM pr GROUP BY db_id, schema_name, table_name, index_name, in_plans, is_partial)"""
KEEP = """ky AS (SELECT db_id, lower(schema_name) AS schema_name, lower(table_name) AS table_name, constraint_name, list_sort(list(DISTINCT column_name)) AS key FROM fk_rel GROUP BY 1, 2, 3, 4),
kf AS (SELECT db_id, schema_name, table_name, constraint_name, bool_or(is_unique OR has_reads) AS safe, arg_min(index_name, (len(columns), index_name)) AS index_name FROM fx JOIN ky USING (db_id, schema_name, table_name)
  WHERE NOT is_partial AND len(columns) >= len(key) AND list_sort(columns[1:len(key)]) = key AND (db_id, schema_name, table_name, index_name) NOT IN (SELECT db_id, schema_name, table_name, index_name FROM rd) GROUP BY 1, 2, 3, 4),
kp AS (SELECT db_id, schema_name, table_name, constraint_name, index_name FROM kf WHERE NOT safe)"""
PICK = """pk AS (SELECT f.db_id, f.schema_name, f.table_name, f.index_name, arg_max(t.query_id, (coalesce(list_contains(t.columns, f.columns[1]), false), coalesce(list_contains(t.columns, f.columns[1]), false) AND scan, time_ms, t.query_id)) AS query_id, bool_or(coalesce(list_contains(t.columns, f.columns[1]), false)) AS by_lead
  FROM fx f JOIN pl USING (db_id, schema_name, table_name) JOIN tr t ON t.db_id = f.db_id AND t.table_name = f.table_name AND coalesce(t.schema_name, '') = pat GROUP BY 1, 2, 3, 4)"""
D05 = ctes("stmt", "plan_use", "index_all", "fk_rel", "filter_at", "db_fresh") + f", {FACTS_ALL}, {USED}, {ACT}, {RED}, {KEEP}, {PICK}"


def used(spark, sf_dir):
    return X.used_indexes(view(spark, sf_dir, "plan_use"), view(spark, sf_dir, "index_all"))


def traffic(spark, sf_dir):
    return X.query_traffic(windows.activity_windows(view(spark, sf_dir, "stmt")), view(spark, sf_dir, "filter_at"), view(spark, sf_dir, "plan_use"))


def read_facts(spark, sf_dir):
    return X.with_reads(index_facts(view(spark, sf_dir, "index_all")), used(spark, sf_dir))


def ap05(spark, sf_dir):
    """Facts, traffic, redundant indexes and keepers, each written once since several steps read it."""
    facts, moved = written(read_facts(spark, sf_dir)), written(traffic(spark, sf_dir))
    covered = written(X.redundant_indexes(facts, moved, view(spark, sf_dir, "db_fresh")))
    return facts, moved, covered, X.fk_keepers(view(spark, sf_dir, "fk_rel"), facts, covered)


@query("d05a_used_indexes", D05 + " SELECT * FROM us")
def d05a(spark, sf_dir):
    return used(spark, sf_dir)


@query("d05b_filter_traffic", D05 + """, e AS (SELECT db_id, schema_name, table_name, query_id, scan, unnest(columns) AS c FROM tr)
SELECT db_id, schema_name, table_name, count(DISTINCT query_id) AS queries, string_agg(DISTINCT c, ',' ORDER BY c) AS columns, coalesce(string_agg(DISTINCT c, ',' ORDER BY c) FILTER (scan), '') AS scan_columns FROM e GROUP BY 1, 2, 3""")
def d05b(spark, sf_dir):
    return X.filter_traffic(traffic(spark, sf_dir))


@query("d05c_redundant_indexes", D05 + " SELECT * FROM rd")
def d05c(spark, sf_dir):
    return ap05(spark, sf_dir)[2]


@query("d05d_unused_indexes", D05 + """ SELECT pk.*, CASE WHEN by_lead THEN 'high' ELSE 'low' END AS severity FROM pk JOIN fx USING (db_id, schema_name, table_name, index_name) WHERE NOT has_reads AND NOT is_unique AND db_id NOT IN (SELECT db_id FROM db_fresh WHERE fresh)
  AND (db_id, schema_name, table_name, index_name) NOT IN (SELECT db_id, schema_name, table_name, index_name FROM rd) AND (db_id, schema_name, table_name, index_name) NOT IN (SELECT db_id, schema_name, table_name, index_name FROM kp)""")
def d05d(spark, sf_dir):
    facts, moved, covered, kept = ap05(spark, sf_dir)
    return X.unused_indexes(facts, covered, kept, moved, view(spark, sf_dir, "db_fresh"))


@query("d05e_fk_keepers", D05 + " SELECT * FROM kp")
def d05e(spark, sf_dir):
    return ap05(spark, sf_dir)[3]


@query("d05f_pick_query", D05 + " SELECT * FROM pk")
def d05f(spark, sf_dir):
    return X.pick_query(read_facts(spark, sf_dir).select(*X.INDEX, F.get("columns", F.lit(0)).alias("lead")), traffic(spark, sf_dir))


# what fingerprints read and compare, by database: the schema is unknown in some; customers are also read by their key
define("reads_at", ["reads", "db"], f"SELECT db_id, query_id, {_AT} AS schema_name, table_name FROM reads CROSS JOIN db")
define("equal_at", ["filter_col", "db"], f"""SELECT db_id, query_id, {_AT} AS schema_name, table_name, column_name FROM filter_col CROSS JOIN db
UNION ALL SELECT db_id, 'error', {_AT}, 'customer', 'C_CUSTKEY' FROM db WHERE {_N} <> 1 UNION ALL SELECT db_id, 'view', {_AT}, 'orders', 'o_orderkey' FROM db WHERE {_N} <> 0""")


@query("d06_n_plus_one", ctes("stmt", "reads_at", "equal_at", "fk_rel") + f""", {ROWS},
ky AS (SELECT db_id, constraint_name, lower(schema_name) AS s, lower(table_name) AS t, list(DISTINCT lower(column_name)) AS own, lower(min(referenced_schema)) AS rs, lower(min(referenced_table)) AS rt, list(DISTINCT lower(referenced_column)) AS theirs FROM fk_rel GROUP BY 1, 2, 3, 4),
rl AS (SELECT db_id, constraint_name, 'one_to_many' AS direction, s AS child_schema, t AS child_table, own AS key, rs AS parent_schema, rt AS parent_table FROM ky UNION ALL SELECT db_id, constraint_name, 'many_to_one', rs, rt, theirs, s, t FROM ky),
eq AS (SELECT db_id, query_id, schema_name, table_name AS child_table, list(DISTINCT lower(column_name)) AS eq FROM equal_at GROUP BY 1, 2, 3, 4),
c AS (SELECT * FROM rw JOIN eq USING (db_id, query_id) JOIN rl USING (db_id, child_table) WHERE calls >= 4 AND list_has_all(eq, key) AND (schema_name IS NULL OR child_schema = schema_name)),
p AS (SELECT * FROM rw JOIN reads_at USING (db_id, query_id) WHERE rows > 0 AND rows >= 2 * calls),
x AS (SELECT c.db_id, c.captured_at, c.query_id AS child_id, p.query_id AS parent_id, c.constraint_name, direction, child_table, parent_table, p.rows AS parent_rows, c.calls AS child_calls, round(c.time_ms + coalesce(p.time_ms, 0), 3) AS impact_ms, abs(c.calls - p.rows) / p.rows AS off
  FROM c JOIN p ON c.db_id = p.db_id AND c.captured_at = p.captured_at AND c.parent_table = p.table_name AND c.query_id <> p.query_id AND (c.is_new AND p.is_new OR c.window_start = p.window_start) AND (p.schema_name IS NULL OR p.schema_name = parent_schema))
SELECT * EXCLUDE (off), CASE WHEN child_calls >= 12 THEN 'high' ELSE 'medium' END AS severity FROM x WHERE off <= 0.97 QUALIFY row_number() OVER (PARTITION BY db_id, captured_at, child_id ORDER BY off, parent_id, constraint_name, direction, child_table) = 1""")
def d06(spark, sf_dir):
    return N.n_plus_one(rows(spark, sf_dir), view(spark, sf_dir, "reads_at"), view(spark, sf_dir, "equal_at"), view(spark, sf_dir, "fk_rel"), calls=4, tolerance=0.97, high=12)


SPILL = f"""{DB_BEFORE}, sp0 AS (SELECT db_id, query_id, captured_at, lag(captured_at) {LAG} IS NULL AS is_new, coalesce(counters_epoch <> lag(counters_epoch IGNORE NULLS) {LAG}, false) AS reset, {ADMITTED.format(s=21600)} AS admitted,
  execution_count - coalesce(lag(execution_count) {LAG}, 0) AS calls, total_time_ms - coalesce(lag(total_time_ms) {LAG}, 0) AS time_ms, disk_spill_indicator - coalesce(lag(disk_spill_indicator) {LAG}, 0) AS spill FROM stmt JOIN caps USING (db_id, captured_at)),
sp AS (SELECT db_id, query_id, captured_at, calls, time_ms, spill FROM sp0 WHERE NOT reset AND (NOT is_new OR admitted) AND calls >= 0 AND spill > 0)"""


@query("d07_disk_spill", ctes("stmt") + f", {SPILL} SELECT db_id, query_id, captured_at, calls, spill, 'temporary data' AS kind, CASE WHEN time_ms >= 1000 THEN 'high' WHEN time_ms >= 500 THEN 'medium' ELSE 'low' END AS severity FROM sp")
def d07(spark, sf_dir):
    return D.disk_spill(windows.spill_windows(view(spark, sf_dir, "stmt"), 21600), 1000, 500).select("db_id", "query_id", "captured_at", "calls", "spill", "kind", "severity")


# plans of each snapshot: some are of no execution, one query is an aggregate
define("estimate", ["stmt"], """SELECT db_id, query_id, captured_at, cast(CASE query_id WHEN 'click' THEN 900 WHEN 'view' THEN 2 ELSE 60 + execution_count % 7 END AS double) AS estimated,
  cast(CASE WHEN execution_count % 3 = 0 THEN NULL ELSE rows_returned % 1500 END AS double) AS actual, CASE WHEN query_id = 'error' THEN 'aggregate' END AS shape FROM stmt""")


@query("d08_misestimate", ctes("stmt", "estimate") + f""", {ROWS}, j AS (SELECT *, greatest(greatest(estimated, 1) / greatest(actual, 1), greatest(actual, 1) / greatest(estimated, 1)) AS q_error FROM rw JOIN estimate USING (db_id, query_id, captured_at) WHERE actual IS NOT NULL AND shape IS NULL)
SELECT db_id, captured_at, query_id, estimated, actual, q_error, round(time_ms, 3) AS impact_ms, CASE WHEN estimated > actual THEN 'over' ELSE 'under' END AS direction, CASE WHEN q_error >= 25 THEN 'high' ELSE 'medium' END AS severity FROM j WHERE q_error >= 10 AND greatest(estimated, actual) >= 50""")
def d08(spark, sf_dir):
    return D.misestimate(rows(spark, sf_dir), view(spark, sf_dir, "estimate"), q_error=10, rows=50, high=25)


# rule: query whose findings it has, its query, detail and variant columns, and which of its rows
FOUND = {
    "AP-01": ("d01_baseline_degradation", "query_id", "severity", None, "true"), "AP-02": ("d02_avoidable_full_scan", "query_id", "table_name", None, "true"), "AP-03": ("d03_non_sargable", "query_id", "column_name", "subtype", "true"),
    "AP-04": ("d04_missing_index", "query_id", "suggested_index", "CASE WHEN per_branch THEN 'per_branch' END", "true"), "AP-05": ("d05d_unused_indexes", "query_id", "index_name", "severity", "true"), "AP-06": ("d06_n_plus_one", "child_id", "constraint_name", "direction", "true"),
    "AP-07": ("d07_disk_spill", "query_id", "kind", "kind", "true"), "AP-08": ("d08_misestimate", "query_id", "direction", "direction", "true"), **{f"CT-0{i}": ("g18_deadlock_events", None, "report_id", None, f"rule = 'CT-0{i}'") for i in range(1, 5)},
    "CT-05": ("g04_long_tx_cascade", None, "pid", None, "true"),
}
TIMED = ["AP-01", "AP-02", "AP-06", "AP-07", "AP-08"]


def everything(spark, sf_dir):
    """All rules' findings; a query that several rules ask is run once, and its rows go to their rules as they come."""
    frames, asked = {}, {}
    for rule, (name, *of) in FOUND.items():
        asked.setdefault(name, []).append((rule, *of))
    for name, rules in asked.items():
        df = QUERIES[name](spark, sf_dir)
        if len(rules) > 1:
            of = lambda query_id, detail, variant: [F.expr(x or "NULL").cast("string").alias(c) for c, x in (("query_id", query_id), ("detail", detail), ("variant", variant))]
            # as rows of an array: a filter by rule would be pushed below the rule's expression and work that out again
            told = F.array(*[F.when(F.expr(which), F.struct(F.lit(rule).alias("rule"), *of(query_id, detail, variant))) for rule, query_id, detail, variant, which in rules])
            frames[tuple(r for r, *_ in rules)] = df.select("db_id", F.inline_outer(told)).filter("rule is not null")
            continue
        rule, query_id, detail, variant, which = rules[0]
        df = df.filter(which).withColumn("detail", F.col(detail)).withColumn("variant", F.expr(variant or "cast(NULL AS string)"))
        frames[rule] = df.withColumn("query_id", F.col(query_id)) if query_id else df.drop("query_id")
    return D.detect_all(frames)


ALL = "WITH al AS (" + " UNION ALL ".join(
    f"SELECT db_id, {'captured_at' if rule in TIMED else 'CAST(NULL AS TIMESTAMP)'} AS captured_at, {q or 'NULL'} AS query_id, CAST({detail} AS VARCHAR) AS detail, CAST({variant or 'NULL'} AS VARCHAR) AS variant, '{rule}' AS rule FROM ({ORACLE_SQL[name]}) WHERE {which}"
    for rule, (name, q, detail, variant, which) in FOUND.items()) + ")"
TOLD = "tx(rule, v, said, recommendation, risk) AS (VALUES " + ", ".join("(" + ", ".join("'" + c.replace("'", "''") + "'" for c in row) + ")" for row in D.text_rows()) + ")"


@query("d09_render_texts", ALL + f""", {TOLD} SELECT al.*, printf(coalesce(o.said, g.said), coalesce(query_id, '-'), detail) AS text, coalesce(o.recommendation, g.recommendation) AS recommendation, coalesce(o.risk, g.risk) AS risk
FROM al LEFT JOIN tx o ON o.rule = al.rule AND o.v = al.variant AND o.v <> '' LEFT JOIN tx g ON g.rule = al.rule AND g.v = ''""")
def d09(spark, sf_dir):
    return D.render_texts(everything(spark, sf_dir))


@query("d10_detect_all", ALL + " SELECT * FROM al")
def d10(spark, sf_dir):
    return everything(spark, sf_dir)


@query("d11_findings_by_rule", ALL + " SELECT rule, query_id, count(*) AS n, count(DISTINCT db_id) AS databases FROM al GROUP BY 1, 2")
def d11(spark, sf_dir):
    return D.findings_by_rule(everything(spark, sf_dir))


SECTIONS = [("statements", 0), ("tables", 3), ("indexes", 5), ("columns", 7), ("foreign_keys", 8), ("server_start_timestamp", 10), ("active_queries", 2)]
define("snap_fact", ["stmt"], """SELECT db_id, captured_at, execution_count AS x, execution_count % 5 AS n_statements, execution_count % 3 AS n_baseline, 4 AS candidates, execution_count % 5 AS without_plan,
  3 AS q_candidates, execution_count % 2 AS q_without_plan, execution_count % 3 AS q_without_rows, execution_count % 4 = 0 AS fresh, execution_count % 6 AS foreign_keys FROM stmt WHERE query_id = 'click'""")
define("section", ["snap_fact"], "SELECT db_id, captured_at, s.section, CASE WHEN (x + s.n) % 11 = 0 THEN 'failed' WHEN (x + s.n) % 13 = 0 THEN 'empty' ELSE 'ok' END AS status FROM snap_fact CROSS JOIN ("
  + " UNION ALL ".join(f"SELECT '{s}' AS section, {n} AS n" for s, n in SECTIONS) + ") s")
CODES = ["PERFORMANCE_SCHEMA_OFF", "PS_CONSUMER_DISABLED", "EXPLAIN_FAILED", "QUERY_TEXT_TRUNCATED", "AUTO_EXPLAIN_LOG_UNAVAILABLE", "TRACK_COUNTS_OFF", "DEADLOCK_REPORTS_UNAVAILABLE", "DEADLOCK_REPORTS_PARTIAL", "DEADLOCK_ROW_WAITS_UNLOGGED", "MISSING_PROCESS_PRIVILEGE", "MISSING_PG_READ_ALL_STATS"]
define("section_issue", ["section", "snap_fact"], "SELECT db_id, captured_at, section, CASE WHEN section = 'tables' THEN 'TIMEOUT' ELSE 'PERMISSION_DENIED' END AS code FROM section WHERE status <> 'ok' AND section <> 'active_queries' UNION ALL SELECT db_id, captured_at, '', c.code FROM snap_fact JOIN ("
  + " UNION ALL ".join(f"SELECT '{c}' AS code, {i} AS i" for i, c in enumerate(CODES)) + ") c ON (x + 2 * c.i) % 7 = 0")
REASON = "rs AS (SELECT DISTINCT s.db_id, s.captured_at, s.section, coalesce(i.code, 'unread') AS reason FROM section s LEFT JOIN section_issue i ON i.db_id = s.db_id AND i.captured_at = s.captured_at AND i.section = s.section WHERE status = 'failed')"


def _reasons() -> str:
    """Every reason of every rule as rows: b blinds, e blinds if nothing else does, p makes partial; d: findings go."""
    statement_rules = [f"AP-0{i}" for i in range(1, 9)]
    out = []

    def section(rules, names, kind, discard):
        out.append(f"SELECT db_id, captured_at, r.code, '{kind}' AS kind, reason || '@' || section AS reason, {discard} AS d FROM rs, (SELECT unnest({rules}) AS code) r WHERE list_contains({names}, section)")

    def issue(rules, names, kind, where="true", default=None):
        joined = f"SELECT f.db_id, f.captured_at, r.code, '{kind}', i.code, false FROM snap_fact f JOIN section_issue i USING (db_id, captured_at), (SELECT unnest({rules}) AS code) r WHERE list_contains({names}, i.code) AND ({where})"
        out.append(joined)
        if default:
            out.append(f"SELECT db_id, captured_at, r.code, '{kind}', '{default}', false FROM snap_fact f, (SELECT unnest({rules}) AS code) r WHERE ({where}) AND NOT EXISTS (SELECT 1 FROM section_issue i WHERE i.db_id = f.db_id AND i.captured_at = f.captured_at AND list_contains({names}, i.code))")

    def fact(rule, kind, reason, where):
        out.append(f"SELECT db_id, captured_at, '{rule}', '{kind}', '{reason}', false FROM snap_fact WHERE {where}")

    section(statement_rules, ["statements"], "b", "true")
    issue(statement_rules, ["PERFORMANCE_SCHEMA_OFF", "MISSING_PG_READ_ALL_STATS"], "b")
    issue(statement_rules, ["PS_CONSUMER_DISABLED"], "b", "n_statements = 0")
    issue(statement_rules, ["PS_CONSUMER_DISABLED"], "p", "n_statements > 0")
    fact("AP-01", "e", "BASELINE_BUILDING", "n_baseline = 0")
    section(["AP-02", "AP-03", "AP-04"], ["tables"], "b", "true")
    section(["AP-03", "AP-04"], ["indexes"], "b", "true")
    section(["AP-04"], ["columns"], "p", "false")
    plans = ["EXPLAIN_FAILED", "QUERY_TEXT_TRUNCATED"]
    issue(["AP-02", "AP-03", "AP-04"], plans, "e", "without_plan = candidates", "NO_PLAN")
    issue(["AP-02", "AP-03", "AP-04"], plans, "p", "without_plan > 0 AND without_plan < candidates", "NO_PLAN")
    section(["AP-05"], ["indexes", "server_start_timestamp", "foreign_keys"], "b", "true")
    out.append("SELECT db_id, captured_at, 'AP-05', 'b', code, true FROM section_issue WHERE code = 'TRACK_COUNTS_OFF'")
    fact("AP-05", "p", "SHORT_STATS_WINDOW", "fresh")
    section(["AP-06"], ["foreign_keys"], "b", "true")
    fact("AP-06", "e", "NO_FOREIGN_KEYS", "foreign_keys = 0")
    for kind, where in (("e", "q_without_plan + q_without_rows = q_candidates"), ("p", "q_without_plan + q_without_rows <> q_candidates")):
        issue(["AP-08"], plans, kind, f"q_without_plan > 0 AND {where}", "NO_PLAN")
        issue(["AP-08"], ["AUTO_EXPLAIN_LOG_UNAVAILABLE"], kind, f"q_without_rows > 0 AND {where}", "NO_REAL_ROWS")
    deadlocks = [f"CT-0{i}" for i in range(1, 5)]
    issue(deadlocks, ["DEADLOCK_REPORTS_UNAVAILABLE"], "b")
    issue(deadlocks, ["DEADLOCK_REPORTS_PARTIAL"], "p")
    issue(["CT-01", "CT-02"], ["DEADLOCK_ROW_WAITS_UNLOGGED"], "p")
    section(["CT-04"], ["indexes"], "b", "true")
    section(["CT-05"], ["active_queries"], "b", "true")
    issue(["CT-05"], ["MISSING_PROCESS_PRIVILEGE", "MISSING_PG_READ_ALL_STATS"], "b")
    return " UNION ALL ".join(out)


RULES = [*(f"AP-0{i}" for i in range(1, 9)), *(f"CT-0{i}" for i in range(1, 6))]
STATES = f"""{REASON}, rr AS ({_reasons()}), rk AS (SELECT *, bool_or(kind = 'b') OVER (PARTITION BY db_id, captured_at, code) AS has_b FROM rr),
ef AS (SELECT db_id, captured_at, code, reason, d, CASE WHEN kind = 'p' THEN 'p' ELSE 'b' END AS kind FROM rk WHERE kind <> 'e' OR NOT has_b),
ag AS (SELECT db_id, captured_at, code, bool_or(kind = 'b') AS blind, bool_or(d) AS d, string_agg(DISTINCT reason, ',' ORDER BY reason) FILTER (kind = 'b') AS sb, string_agg(DISTINCT reason, ',' ORDER BY reason) FILTER (kind = 'p') AS sp FROM ef GROUP BY 1, 2, 3),
st AS (SELECT g.db_id, g.captured_at, g.code, CASE WHEN blind THEN 'not_evaluated' WHEN sp IS NOT NULL THEN 'partial' ELSE 'evaluated' END AS state, CASE WHEN blind THEN sb ELSE coalesce(sp, '') END AS signature, coalesce(blind AND d, false) AS discard
  FROM (SELECT f.db_id, f.captured_at, r.code FROM snap_fact f, (SELECT unnest({RULES}) AS code) r) g LEFT JOIN ag USING (db_id, captured_at, code))"""
COV = ctes("stmt", "section", "section_issue", "snap_fact")


def snaps(spark, sf_dir):
    return E.snapshots(view(spark, sf_dir, "section"), view(spark, sf_dir, "section_issue"), view(spark, sf_dir, "snap_fact"))


def states(spark, sf_dir):
    return E.evaluate(snaps(spark, sf_dir))


@query("e01_section_reasons", COV + f", {REASON} SELECT * FROM rs")
def e01(spark, sf_dir):
    return E.section_reasons(view(spark, sf_dir, "section"), view(spark, sf_dir, "section_issue"))


@query("e02_statement_blind", COV + """ SELECT DISTINCT db_id, captured_at FROM section s WHERE section = 'statements' AND (status = 'failed' OR (status = 'empty' AND EXISTS (SELECT 1 FROM section_issue i WHERE i.db_id = s.db_id AND i.captured_at = s.captured_at AND i.code = 'PERMISSION_DENIED')))""")
def e02(spark, sf_dir):
    return E.statement_blind(view(spark, sf_dir, "section"), view(spark, sf_dir, "section_issue"), ["PERMISSION_DENIED"])


@query("e03_plan_coverage", ctes("stmt") + """, p AS (SELECT DISTINCT db_id, query_id FROM stmt WHERE execution_count > 900), n AS (SELECT s.db_id, s.captured_at, count(*) AS n, count(p.query_id) AS planned FROM stmt s LEFT JOIN p USING (db_id, query_id) GROUP BY 1, 2)
SELECT *, CASE WHEN planned = 0 THEN 'none' WHEN planned < n THEN 'some' ELSE 'all' END AS coverage FROM n""")
def e03(spark, sf_dir):
    st = view(spark, sf_dir, "stmt")
    return E.plan_coverage(st.select("db_id", "captured_at", "query_id"), st.filter("execution_count > 900"))


@query("e04_baseline_ready", ctes("stmt") + """, n AS (SELECT db_id, query_id, count(*) - 1 AS n FROM stmt GROUP BY 1, 2) SELECT db_id, max(n) AS most, CASE WHEN max(n) >= 60 THEN 'evaluated' ELSE 'partial' END AS state FROM n GROUP BY 1""")
def e04(spark, sf_dir):
    st = view(spark, sf_dir, "stmt").groupBy("db_id", "query_id").agg((F.count("*") - 1).alias("n_windows"))
    return E.baseline_ready(st, 60)


def of(codes):
    return COV + f", {STATES} SELECT * FROM st WHERE list_contains({codes}, code)"


@query("e05_full_scan_state", of(["AP-02", "AP-03", "AP-04"]))
def e05(spark, sf_dir):
    return E.full_scan_states(snaps(spark, sf_dir))


@query("e06_ap_states", of(["AP-05", "AP-06", "AP-07", "AP-08"]))
def e06(spark, sf_dir):
    return E.ap_states(snaps(spark, sf_dir))


@query("e07_ct_states", of([f"CT-0{i}" for i in range(1, 6)]))
def e07(spark, sf_dir):
    return E.ct_states(snaps(spark, sf_dir))


@query("e08_evaluate", of(RULES))
def e08(spark, sf_dir):
    return states(spark, sf_dir)


@query("e09_drop_unreliable", COV + f""", {STATES}, f AS (SELECT db_id, captured_at, query_id, CASE execution_count % 2 WHEN 0 THEN 'AP-02' ELSE 'AP-01' END AS code FROM stmt)
SELECT f.*, NOT coalesce(st.discard, false) AS kept FROM f LEFT JOIN st USING (db_id, captured_at, code)""")
def e09(spark, sf_dir):
    code = F.when(F.col("execution_count") % 2 == 0, "AP-02").otherwise("AP-01")
    found = view(spark, sf_dir, "stmt").select("db_id", "captured_at", "query_id", code.alias("code"))
    kept, gone = E.drop_unreliable(found, states(spark, sf_dir))
    return kept.withColumn("kept", F.lit(True)).unionByName(gone.withColumn("kept", F.lit(False)))
