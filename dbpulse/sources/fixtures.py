"""Telemetry tables projected from the given star-schema tables.

Every projection is one SQL text for both engines: ``view`` runs it in Spark, ``ctes``
gives the same text as CTEs for a comparison in DuckDB. Few functions differ between the
two; they are written as macros in capitals and replaced.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: name -> (projections it reads, SQL); @table is one of the given Parquet tables
VIEWS: dict[str, tuple[list[str], str]] = {}


def define(name: str, reads: list[str], sql: str) -> None:
    VIEWS[name] = (reads, sql)


MACROS = {
    "spark": [
        (r"EPOCH_S\((\w+(?:\.\w+)?)\)", r"unix_seconds(cast(\1 as timestamp))"),
        (r"EPOCH_US\((\w+(?:\.\w+)?)\)", r"unix_micros(cast(\1 as timestamp))"),
        (r"AT_S\((\w+(?:\.\w+)?)\)", r"(timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, \1))"),
        (r"LIST_AGG\(([^)]*)\)", r"array_sort(collect_list(\1))"),
        (r"ARRAY\[([^\]]*)\]", r"array(\1)"),
    ],
    "duckdb": [
        (r"EPOCH_S\((\w+(?:\.\w+)?)\)", r"cast(floor(epoch(\1)) as bigint)"),
        (r"EPOCH_US\((\w+(?:\.\w+)?)\)", r"epoch_us(\1)"),
        (r"AT_S\((\w+(?:\.\w+)?)\)", r"(timestamp '1970-01-01 00:00:00' + to_seconds(\1))"),
        (r"LIST_AGG\(([^)]*)\)", r"list_sort(list(\1))"),
        (r"ARRAY\[([^\]]*)\]", r"[\1]"),
    ],
}


def _said(text: str, engine: str, place) -> str:
    for pattern, to in MACROS[engine]:
        text = re.sub(pattern, to, text)
    return re.sub(r"@(\w+)", lambda m: place(m[1]), text)


def _needed(names: list[str], seen: list[str] | None = None) -> list[str]:
    seen = [] if seen is None else seen
    for name in names:
        _needed(VIEWS[name][0], seen)
        if name not in seen:
            seen.append(name)
    return seen


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The projection as a DataFrame over the tables in ``sf_dir``."""
    place = lambda t: f"parquet.`{sf_dir}/{t}.parquet`"
    parts = [f"{n} AS ({_said(VIEWS[n][1], 'spark', place)})" for n in _needed([name])]
    return spark.sql(f"WITH {', '.join(parts)} SELECT * FROM {name}")


def ctes(*names: str) -> str:
    """``WITH a AS (...), b AS (...)`` for DuckDB, with all that the named projections read."""
    return "WITH " + ",\n".join(f"{n} AS ({_said(VIEWS[n][1], 'duckdb', lambda t: t)})" for n in _needed(list(names)))


# B1: cumulative statement counters, a row for each database, fingerprint and six hours with activity
define("ev", [], """
SELECT event_id, ts, user_id, event_type, value, cast(value AS decimal(18,4)) AS v, cast(regexp_extract(props, '[0-9]+', 0) AS bigint) AS k,
  concat('db', cast(cast(floor(user_id / 10) AS bigint) AS string)) AS db_id, cast(floor(EPOCH_S(ts) / 21600) AS bigint) AS bucket, EPOCH_S(ts) AS s FROM @events""")
define("stmt_bucket", ["ev"], """
SELECT db_id, event_type AS query_id, bucket, count(*) AS calls, sum(v) AS t, sum(k) AS n, sum(CASE WHEN value > 300 THEN 1 ELSE 0 END) AS spill,
  CASE WHEN event_type = 'signup' AND bucket >= (SELECT min(bucket) FROM ev) + 60 THEN 1 ELSE 0 END AS ep
FROM ev GROUP BY db_id, event_type, bucket""")
define("stmt_run", ["stmt_bucket"], """
SELECT db_id, query_id, bucket, ep, (bucket + 1) * 21600 AS at_s, ((SELECT min(bucket) FROM stmt_bucket) + ep * 60) * 21600 AS ep_s,
  cast(sum(calls) OVER w AS bigint) AS calls, cast(sum(t) OVER w AS decimal(28,4)) AS t, cast(sum(n) OVER w AS bigint) AS n, cast(sum(spill) OVER w AS bigint) AS spill
FROM stmt_bucket WINDOW w AS (PARTITION BY db_id, query_id, ep ORDER BY bucket ROWS UNBOUNDED PRECEDING)""")
define("stmt", ["stmt_run"], """
SELECT db_id, query_id, AT_S(at_s) AS captured_at, calls AS execution_count, cast(t AS double) AS total_time_ms, n AS rows_returned,
  spill AS disk_spill_indicator, cast(NULL AS bigint) AS sort_merge_passes, CASE WHEN calls % 11 = 0 THEN cast(NULL AS timestamp) ELSE AT_S(ep_s) END AS counters_epoch FROM stmt_run""")
# B2: the same counters as two rows of one snapshot (two users of one fingerprint)
define("stmt_dup", ["stmt"], """
SELECT db_id, query_id, captured_at, 0 AS part, execution_count - cast(floor(execution_count / 3) AS bigint) AS execution_count, total_time_ms,
  rows_returned, disk_spill_indicator, sort_merge_passes, counters_epoch FROM stmt
UNION ALL SELECT db_id, query_id, captured_at, 1, cast(floor(execution_count / 3) AS bigint), cast(NULL AS double), 0, cast(NULL AS bigint), cast(NULL AS bigint), counters_epoch FROM stmt""")
# Live rows of the given tables; columns
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
define("db", ["ev"], "SELECT DISTINCT db_id FROM ev")
define("table_count", [], " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS live_rows FROM @{t}" for t in TABLES))
define("table_stats", ["db", "table_count"], "SELECT db_id, 'public' AS schema_name, table_name, live_rows FROM table_count CROSS JOIN db")
# Index definitions, the same in every database
INDEXES = [
    ("orders", "orders_pk", "o_orderkey", True, None), ("orders", "orders_cust", "o_custkey", False, None), ("orders", "orders_cust_date", "o_custkey,o_orderdate", False, None),
    ("orders", "orders_cust_copy", "o_custkey", False, None), ("orders", "orders_open", "o_orderdate", False, "o_orderstatus = 'O'"), ("lineitem", "lineitem_pk", "l_orderkey,l_linenumber", True, None),
    ("lineitem", "lineitem_part", "l_partkey", False, None), ("lineitem", "lineitem_part_supp", "l_partkey,l_suppkey", False, None), ("lineitem", "lineitem_ship", "lower(l_shipdate),l_tax", False, None),
    ("customer", "customer_pk", "c_custkey", True, None), ("customer", "customer_nation", "c_nationkey", False, None), ("part", "part_pk", "p_partkey", True, None),
    ("part", "part_brand", "p_brand,p_type", False, None), ("supplier", "supplier_nation", "s_nationkey", False, None),
]
define("index_def", [], " UNION ALL ".join(
    f"SELECT {i} AS n, '{t}' AS table_name, '{x}' AS index_name, 'CREATE {'UNIQUE ' if u else ''}INDEX {x} ON public.{t} USING btree ({c.replace(',', ', ')}){f' WHERE ({p})'.replace(chr(39), chr(39) * 2) if p else ''}' AS index_ref"
    for i, (t, x, c, u, p) in enumerate(INDEXES)))
define("index_catalog", ["index_def", "ev"], """
SELECT d.db_id, 'public' AS schema_name, table_name, index_name, index_ref,
  CASE WHEN n % 3 = 0 OR n % 4 = 0 THEN 0 ELSE d.c % (n + 7) END AS index_scans, CASE WHEN (d.c + n) % 5 = 0 THEN 'seen' ELSE cast(NULL AS string) END AS last_index_scan, 8192 * (n + 1) AS index_size_bytes
FROM index_def CROSS JOIN (SELECT db_id, count(*) AS c FROM ev GROUP BY db_id) d""")
define("db_fresh", ["db"], "SELECT db_id, cast(replace(db_id, 'db', '') AS bigint) % 4 = 1 AS fresh FROM db")
# Foreign keys, one composite
FKS = [
    ("fk_nation_region", "nation", "n_regionkey", "region", "r_regionkey", 1), ("fk_customer_nation", "customer", "c_nationkey", "nation", "n_nationkey", 1), ("fk_supplier_nation", "supplier", "s_nationkey", "nation", "n_nationkey", 1),
    ("fk_orders_customer", "orders", "o_custkey", "customer", "c_custkey", 1), ("fk_lineitem_orders", "lineitem", "l_orderkey", "orders", "o_orderkey", 1),
    ("fk_lineitem_partsupp", "lineitem", "l_partkey", "partsupp", "ps_partkey", 1), ("fk_lineitem_partsupp", "lineitem", "l_suppkey", "partsupp", "ps_suppkey", 2),
]
define("fk", [], " UNION ALL ".join(
    f"SELECT '{c}' AS constraint_name, '{t}' AS table_name, '{k}' AS column_name, '{rt}' AS referenced_table, '{rc}' AS referenced_column, {p} AS position" for c, t, k, rt, rc, p in FKS))
# Open orders as sessions that wait for the customer's previous open order
define("session", [], """
SELECT concat('db', cast(cast(floor(o_custkey / 50) AS bigint) AS string)) AS db_id, o_orderkey AS process_id, o_custkey, EPOCH_S(o_orderdate) AS start_s,
  lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS blocker FROM @orders WHERE o_orderstatus = 'O'""")
# The lines of an order as a deadlock, each waiting for the next, the last for the first; some blocked by two, some by a stranger
_LINE = """
SELECT *, cast(rn % n + 1 AS int) AS next_id FROM (SELECT @key, l_linenumber AS process_id, l_partkey, l_returnflag, l_linestatus, l_quantity, EPOCH_S(l_shipdate) AS ship_s,
  cast(row_number() OVER (PARTITION BY @by ORDER BY l_linenumber, l_partkey, l_suppkey) AS int) AS rn, cast(count(*) OVER (PARTITION BY @by) AS int) AS n"""
define("dl_line", [], _LINE.replace("@key", "l_orderkey AS report_id").replace("@by", "l_orderkey") + " FROM @lineitem) x")
_TRX = """
SELECT a.report_id, a.rn AS process_id, concat('db', cast(cast(floor(a.report_id / 1000) AS bigint) AS string)) AS db_id, a.ship_s + a.report_id % 86400 AS at_s, a.report_id % 10 <> 0 AS complete,
  concat('part ', cast(@next AS string)) AS waits_for, concat('part ', cast(a.l_partkey AS string)) AS holds, a.report_id % 7 <> 0 AS holds_known,
  CASE a.l_returnflag WHEN 'R' THEN 'S' ELSE 'X' END AS lock_mode, CASE WHEN a.l_linestatus = 'F' THEN 'row' WHEN a.report_id % 2 = 0 THEN 'gap' ELSE 'insert_intention' END AS lock_scope,
  cast(a.l_quantity AS bigint) AS rows_locked, a.process_id AS undo_entries, a.rn = least(2, a.n) AS victim, a.next_id,
  CASE WHEN a.report_id % 19 = 0 THEN ARRAY[9] WHEN a.report_id % 6 = 5 THEN ARRAY[cast((a.rn + a.n - 2) % a.n + 1 AS int), a.next_id] ELSE ARRAY[a.next_id] END AS blocked_by,
  CASE WHEN a.report_id % 5 = 0 THEN cast(NULL AS string) WHEN a.report_id % 11 = 0 THEN 'other' ELSE 'public' END AS schema_name, CASE (a.report_id + a.rn) % 6
  WHEN 0 THEN 'UPDATE orders SET o_clerk = $1 WHERE o_custkey = $2' WHEN 1 THEN 'UPDATE orders SET o_clerk = $1 WHERE (o_clerk = $2 AND o_shippriority >= $3)' WHEN 2 THEN 'DELETE FROM shop.lineitem WHERE l_tax > $1'
  WHEN 3 THEN 'SELECT * FROM orders WHERE o_clerk = $1 FOR UPDATE' WHEN 4 THEN 'UPDATE orders AS o JOIN customer AS c ON c.c_custkey = o.o_custkey SET o_clerk = $1 WHERE c_name = $2' ELSE 'UPDATE part SET p_name = $1 WHERE LOWER(p_name) = $2' END AS canonic_query
FROM """
define("deadlock_trx", ["dl_line"], _TRX.replace("@next", "b.l_partkey") + "dl_line a JOIN dl_line b ON a.report_id = b.report_id AND a.next_id = b.rn")
# the same rows for Spark: what the next line holds is read in the order of the lines. Each line is shuffled and sorted once, by the name that its reports go by
_NEXT = _LINE.replace("@key", "report_id").replace("@by", "report_id") + ", first_value(l_partkey) OVER w AS first_partkey, lead(l_partkey) OVER w AS later_partkey"
define("dl_next", [], f"""SELECT *, CASE WHEN rn = n THEN first_partkey ELSE later_partkey END AS next_partkey FROM ({_NEXT} FROM (SELECT *, l_orderkey AS report_id FROM @lineitem WHERE l_orderkey IS NOT NULL) l
  WINDOW w AS (PARTITION BY report_id ORDER BY l_linenumber, l_partkey, l_suppkey)) x) y""")
define("deadlock_ring", ["dl_next"], _TRX.replace("@next", "a.next_partkey") + "dl_next a")
# Detections of problems
define("detection", ["ev"], """
SELECT event_id AS detection_id, db_id, event_type AS rule, concat(event_type, '/', cast(user_id % 20 AS string)) AS finding_key, ts AS detected_at, s,
  CASE WHEN value >= 200 THEN 'high' WHEN value >= 80 THEN 'medium' ELSE 'low' END AS severity, CASE WHEN event_type = 'error' THEN cast(NULL AS decimal(18,4)) ELSE v END AS impact_ms,
  concat('table', cast(k % 12 AS string)) AS table_name, concat('{"table":"table', cast(k % 12 AS string), '","rows":', cast(k AS string), ',"ratio":', cast(k % 5 AS string), '}') AS evidence FROM ev""")
# Evaluations in ten-minute buckets
define("evaluation", ["ev"], """
SELECT event_id, db_id, event_type AS code, ts AS captured_at, s, cast(floor(s / 600) AS bigint) * 600 AS bucket_s,
  CASE WHEN value < 60 THEN 'evaluated' WHEN value < 150 THEN 'partial' ELSE 'not_evaluated' END AS state, concat('r', cast(k % 4 AS string)) AS reason FROM ev""")
# Collection cycles and issues
define("cycle", ["ev"], """
SELECT db_id, hour_s AS at_s, cast(sum(errors) OVER (PARTITION BY db_id, half ORDER BY hour_s ROWS UNBOUNDED PRECEDING) AS bigint) AS deadlocks, half AS epoch,
  cast(n AS bigint) * 4096 + hour_s % 9973 AS log_bytes, log_file, n FROM (
  SELECT db_id, cast(floor(s / 3600) AS bigint) * 3600 AS hour_s, CASE WHEN floor(s / 3600) % 720 < 360 THEN 0 ELSE 1 END AS half,
    concat('log', cast(max(cast(floor(s / 86400) AS bigint)) AS string)) AS log_file, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS errors, count(*) AS n
  FROM ev GROUP BY db_id, cast(floor(s / 3600) AS bigint), CASE WHEN floor(s / 3600) % 720 < 360 THEN 0 ELSE 1 END) x""")
define("issue_seen", ["ev"], """
SELECT db_id, cast(floor(s / 86400) AS bigint) AS run_no, concat('issue', cast(k % 6 AS string)) AS code, CASE WHEN k % 2 = 0 THEN 'statements' ELSE 'locks' END AS section,
  CASE k % 3 WHEN 0 THEN 'error' WHEN 1 THEN 'warning' ELSE 'info' END AS severity, event_id, s FROM ev WHERE event_type IN ('error', 'signup')""")
# Latency samples and blocks
define("latency", ["ev"], """
SELECT event_id, event_type AS template_id, EPOCH_US(ts) AS t0, EPOCH_US(ts) + cast(v * 1000000 AS bigint) AS t1, v, s,
  cast(floor(s / 86400) AS bigint) % 2 AS side, cast(floor(floor(s / 86400) / 2) AS bigint) AS pair, event_type <> 'error' AS ok FROM ev""")
define("block", [], """
SELECT cast(d AS bigint) AS day_no, cast(d AS bigint) % 2 AS side, cast(floor(d / 2) AS bigint) AS pair, cast(d AS bigint) * 86400000000 AS start_us, (cast(d AS bigint) + 1) * 86400000000 - 3600000000 AS end_us
FROM (SELECT DISTINCT floor(EPOCH_S(ts) / 86400) AS d FROM @events) x""")
# Truth and prediction by language
define("confusion_row", [], """
SELECT l.doc_id, d.lang AS grp, l.quality AS truth, CASE WHEN d.n_chars % 5 = 0 THEN 1 - l.quality ELSE l.quality END AS predicted, l.toxic FROM @labels l JOIN @documents d ON l.doc_id = d.doc_id""")
# Statements made of the given tables' names and values
define("sql_text", [], """
SELECT o_orderkey AS id, CASE o_orderkey % 6
  WHEN 0 THEN concat('SELECT * FROM orders WHERE o_custkey = ', cast(o_custkey AS string), ' AND o_orderstatus = ''', o_orderstatus, '''')
  WHEN 1 THEN concat('SELECT o.o_orderkey FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_totalprice > ', cast(o_custkey AS string), '.5 /* hint */')
  WHEN 2 THEN concat('UPDATE orders SET o_orderstatus = ''it''''s'' WHERE o_orderkey IN (1, 2, ', cast(o_custkey AS string), ') -- tail')
  WHEN 3 THEN concat('select count(*) from lineitem where l_orderkey = ', cast(o_orderkey AS string), ' group by l_partkey')
  WHEN 4 THEN concat('WITH x AS (SELECT 1) SELECT * FROM x LIMIT ', cast(o_custkey % 50 AS string), ';')
  ELSE concat('SELECT p_name FROM part WHERE p_name LIKE ''%', o_orderpriority, '%'' AND p_size = ', cast(o_custkey % 50 AS string), ' FOR UPDATE') END AS q,
  o_custkey, o_orderpriority FROM @orders""")
