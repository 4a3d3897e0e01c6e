"""Queries of readers S01-S14."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import baseline, windows
from ..sources import scans as S
from ..sources.fixtures import ctes, define, view
from . import query
from .counters import D01, DELTA

# whole payloads, and by turns: no JSON, sections missing, a section unread (null), one of another type, a mistyped number (null then), no database
_REST = '"locks":[{"process_id":\', cast(user_id AS string), \',"table_name":"t","granted":true}],"indexes":[],"tables":[{"schema_name":"s","table_name":"t","live_rows":5}],"columns":[]'
define("raw_snapshot", ["ev"], f"""
SELECT event_id AS msg_id, db_id, ts AS captured_at, CASE k % 9 WHEN 0 THEN 'no json' WHEN 1 THEN '{{"statements":[]}}'
  ELSE concat('{{', CASE WHEN k % 9 = 2 THEN '' ELSE '"db_id":"d",' END, '"statements":[{{"query_id":"', event_type, '","execution_count":', CASE WHEN k % 9 = 3 THEN '"many"' ELSE cast(k AS string) END, ',"total_time_ms":1.5}},{{"query_id":"other","execution_count":1,"total_time_ms":2}}],
    {_REST},"active_queries":', CASE k % 9 WHEN 4 THEN 'null' WHEN 5 THEN '{{"process_id":1}}' ELSE '[]' END, ',"server_start_timestamp":[{{"server_start_time":"2024-01-01"}}]', CASE WHEN k % 9 = 6 THEN ',"deadlocks":7' ELSE ',"collection_status":{{"sections_failed":["x"],"issues":[]}}' END, ',"unknown":1}}') END AS payload,
  k, event_type, user_id FROM ev""")
VALID = "k % 9 IN (3, 4, 7, 8)"


@query("s01_ingest_snapshots", ctes("raw_snapshot") + f""", v AS (SELECT * FROM raw_snapshot WHERE {VALID}) SELECT msg_id, db_id, captured_at, 'statements' AS section, event_type AS name, CASE WHEN k % 9 <> 3 THEN k END AS n FROM v
UNION ALL SELECT msg_id, db_id, captured_at, 'statements', 'other', 1 FROM v UNION ALL SELECT msg_id, db_id, captured_at, 'locks', 't', user_id FROM v UNION ALL SELECT msg_id, db_id, captured_at, 'tables', 't', 5 FROM v
UNION ALL SELECT msg_id, db_id, captured_at, 'server_start_timestamp', '2024-01-01', 1 FROM v UNION ALL SELECT msg_id, db_id, captured_at, 'collection_status', 'x', 1 FROM v""")
def s01(spark, sf_dir):
    """Rows of all 14 sections in one layout; sections without rows give none."""
    got = S.ingest_snapshots(view(spark, sf_dir, "raw_snapshot").select("msg_id", "db_id", "captured_at", "payload"))
    shown = {"statements": ("query_id", "execution_count"), "locks": ("table_name", "process_id"), "tables": ("table_name", "live_rows"), "server_start_timestamp": ("server_start_time", None), "collection_status": ("array_join(sections_failed, ',')", None)}
    out = None
    for name, df in got.items():
        text, number = shown.get(name, ("msg_id", None))
        part = df.select("msg_id", "db_id", "captured_at", F.lit(name).alias("section"), F.expr(text).cast("string").alias("name"), (F.expr(number) if number else F.lit(1)).cast("long").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


@query("s01b_section_issues", ctes("raw_snapshot") + """, i AS (SELECT *, CASE k % 9 WHEN 0 THEN [{'section': '', 'code': 'PAYLOAD_UNREADABLE'}]
  WHEN 1 THEN list_transform(['locks', 'active_queries', 'indexes', 'tables', 'columns', 'server_start_timestamp'], lambda x: {'section': x, 'code': 'SECTION_MISSING'})
  WHEN 4 THEN [{'section': 'active_queries', 'code': 'SECTION_UNREAD'}] WHEN 5 THEN [{'section': 'active_queries', 'code': 'SECTION_MISTYPED'}] WHEN 6 THEN [{'section': 'deadlocks', 'code': 'SECTION_MISTYPED'}] ELSE [] END AS l FROM raw_snapshot)
SELECT msg_id, db_id, captured_at, u.section AS section, u.code AS code FROM (SELECT msg_id, db_id, captured_at, unnest(l) AS u FROM i)""")
def s01b(spark, sf_dir):
    return S.section_issues(view(spark, sf_dir, "raw_snapshot").select("msg_id", "db_id", "captured_at", "payload"))


@query("s01c_degradation_from_snapshots", ctes("stmt") + f", {DELTA}" + D01)
def s01c(spark, sf_dir):
    """AP-01 from whole payloads: counters go in as JSON, some snapshots twice, some fingerprints as two rows, and come out as windows."""
    row = view(spark, sf_dir, "stmt")
    third = F.floor(F.col("execution_count") / 3).cast("long")
    fields = lambda calls, time: F.struct("query_id", calls.alias("execution_count"), time.alias("total_time_ms"), "rows_returned", "disk_spill_indicator", "sort_merge_passes", F.date_format("counters_epoch", "yyyy-MM-dd'T'HH:mm:ss").alias("counters_epoch"))
    rows = F.when(F.col("execution_count") % 4 == 0, F.array(fields(third, F.col("total_time_ms")), fields(F.col("execution_count") - third, F.lit(0.0)))).otherwise(F.array(fields(F.col("execution_count"), F.col("total_time_ms"))))
    whole = row.groupBy("db_id", "captured_at").agg(F.flatten(F.collect_list(rows)).alias("statements"))
    empty = F.array().cast("array<string>")
    payload = F.to_json(F.struct("db_id", "statements", *[empty.alias(n) for n in S.MANDATORY if n != "statements"]))
    sent = whole.select("db_id", "captured_at", payload.alias("payload"), F.explode(F.when(F.hour("captured_at") == 6, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("msg_id"))
    counters = S.statement_counters(S.ingest_snapshots(sent.withColumn("msg_id", F.col("msg_id").cast("long")))["statements"])
    return baseline.baseline_degradation(windows.delta_windows(counters), min_calls=2, baseline=30, ratio=1.2)


@query("s02_split_valid", ctes("raw_snapshot") + f" SELECT msg_id, {VALID} AS valid FROM raw_snapshot")
def s02(spark, sf_dir):
    ok, bad = S.split_valid(view(spark, sf_dir, "raw_snapshot").select("msg_id", "payload"))
    return ok.select("msg_id", F.lit(True).alias("valid")).unionByName(bad.select("msg_id", F.lit(False).alias("valid")))


define("pg_stat", ["ev"], "SELECT db_id, event_id AS queryid, CASE WHEN user_id % 10 = 0 THEN 'monitor' WHEN user_id % 3 > 0 THEN 'app' END AS role, concat('SELECT ', event_type) AS query, k AS calls, v AS total_exec_time, k * 3 AS rows FROM ev WHERE k % 2 = 0")
define("my_stat", ["ev"], "SELECT db_id, 'shop' AS schema_name, cast(event_id AS string) AS digest, CASE WHEN k % 5 = 0 THEN 'SHOW STATUS' ELSE 'SELECT ?' END AS digest_text, k AS count_star, cast(k AS bigint) * 5000000000 AS sum_timer_wait, k AS sum_rows_sent FROM ev WHERE k % 2 = 1")


@query("s03_read_statements", ctes("pg_stat", "my_stat") + """ SELECT 'postgres' AS engine, db_id, CAST(queryid AS VARCHAR) AS query_id, calls, CAST(total_exec_time AS DOUBLE) AS total_time_ms, rows, rows / nullif(calls, 0) AS rows_per_call FROM pg_stat WHERE role IS DISTINCT FROM 'monitor'
UNION ALL SELECT 'mysql', db_id, schema_name || '/' || digest, count_star, sum_timer_wait / 1e9, sum_rows_sent, sum_rows_sent / nullif(count_star, 0) FROM my_stat WHERE digest_text NOT LIKE 'SHOW%'""")
def s03(spark, sf_dir):
    pg = view(spark, sf_dir, "pg_stat").withColumn("total_exec_time", F.col("total_exec_time").cast("double"))
    return S.read_statements(pg, view(spark, sf_dir, "my_stat"), ["monitor"], "^SHOW ").drop("role", "query")


@query("s04_table_stats", ctes("table_stats", "index_catalog") + """ SELECT t.db_id, t.table_name, CASE WHEN t.live_rows % 2 = 0 THEN t.live_rows ELSE t.live_rows + 5 END AS live_rows, i.n AS idx_scans
FROM table_stats t LEFT JOIN (SELECT db_id, table_name, CAST(sum(index_scans) AS BIGINT) AS n FROM index_catalog GROUP BY 1, 2) i USING (db_id, table_name)""")
def s04(spark, sf_dir):
    t = view(spark, sf_dir, "table_stats")
    stats = t.select("db_id", "table_name", F.when(F.col("live_rows") % 2 == 0, F.col("live_rows")).otherwise(0).alias("live_rows"))
    return S.table_stats(stats, t.select("db_id", "table_name", (F.col("live_rows") + 5).alias("catalog_rows")), view(spark, sf_dir, "index_catalog"))


define("index_part", [], "SELECT DISTINCT concat('db', cast(p_size % 2 AS string)) AS db_id, concat('t', cast(p_size % 5 AS string)) AS table_name, concat('ix', cast(p_size AS string)) AS index_name, p_size % 3 + cast(p_partkey % 4 AS int) AS seq, concat('c', cast(p_partkey % 4 AS string)) AS column_name, p_size % 7 = 0 AS is_unique FROM @part")


@query("s05_index_catalog", ctes("index_part") + """, b AS (SELECT db_id, table_name, index_name, string_agg(column_name, ', ' ORDER BY seq, column_name) AS columns, bool_or(is_unique) AS is_unique FROM index_part GROUP BY 1, 2, 3)
SELECT *, 'CREATE ' || CASE WHEN is_unique THEN 'UNIQUE ' ELSE '' END || 'INDEX ' || index_name || ' ON ' || table_name || ' (' || columns || ')' AS index_ref, CASE WHEN index_name <> 'ix3' THEN length(index_name) END AS index_scans FROM b""")
def s05(spark, sf_dir):
    parts = view(spark, sf_dir, "index_part")
    return S.index_catalog(parts, parts.select("db_id", "index_name", F.length("index_name").alias("index_scans")).filter("index_name != 'ix3'").distinct())


@query("s06_merge_index_sizes", ctes("index_catalog") + " SELECT db_id, table_name, index_name, CASE WHEN index_scans > 0 THEN index_scans * 16384 END AS index_size_bytes FROM index_catalog")
def s06(spark, sf_dir):
    c = view(spark, sf_dir, "index_catalog")
    return S.merge_index_sizes(c.select("db_id", "table_name", "index_name"), c.filter("index_scans > 0").select("db_id", "table_name", "index_name", F.col("index_scans").alias("pages")))


define("fk_array", [], """
SELECT concat('fk', cast(p_partkey AS string)) AS constraint_name, p_brand AS table_name, p_type AS referenced_table, ARRAY[concat('a', cast(p_size AS string)), p_name] AS columns, ARRAY[concat('b', cast(p_size AS string)), 'id'] AS referenced_columns FROM @part""")


@query("s07_flatten_fks", ctes("fk_array") + """ SELECT constraint_name, table_name, referenced_table, columns[i] AS column_name, referenced_columns[i] AS referenced_column, CAST(i AS INTEGER) AS position FROM fk_array CROSS JOIN (SELECT unnest([1, 2]) AS i)""")
def s07(spark, sf_dir):
    return S.flatten_fks(view(spark, sf_dir, "fk_array"))


define("role_path", ["ev"], "SELECT DISTINCT concat('u', cast(user_id AS string)) AS role, CASE user_id % 3 WHEN 0 THEN '$user, public' WHEN 1 THEN concat('missing,s', cast(user_id % 4 AS string), ' , public') ELSE 'missing' END AS search_path, user_id FROM ev")


@query("s08_resolve_schema", ctes("role_path") + """ SELECT role, CASE user_id % 3 WHEN 0 THEN CASE WHEN user_id % 2 = 0 THEN role ELSE 'public' END WHEN 1 THEN CASE WHEN user_id % 4 < 2 THEN 's' || user_id % 4 ELSE 'public' END END AS schema_name FROM role_path WHERE user_id % 3 < 2""")
def s08(spark, sf_dir):
    roles = view(spark, sf_dir, "role_path")
    named = roles.filter("user_id % 2 = 0").select(F.col("role").alias("schema_name"))
    return S.resolve_schema(roles, named.unionByName(spark.createDataFrame([("public",), ("s0",), ("s1",)], "schema_name string")))


@query("s09_session_sample", ctes("session") + """, l AS (SELECT process_id, min(start_s + process_id % 5) AS wait_start_s FROM session WHERE blocker IS NOT NULL GROUP BY 1), b AS (SELECT process_id, string_agg(DISTINCT CAST(blocker AS VARCHAR), ',') AS blocking_pids FROM session WHERE blocker IS NOT NULL GROUP BY 1)
SELECT db_id, process_id, wait_start_s, blocking_pids, CASE process_id % 3 WHEN 0 THEN CASE WHEN process_id % 2 = 0 THEN 'idle in transaction' ELSE 'idle' END ELSE 'active' END AS state FROM session LEFT JOIN l USING (process_id) LEFT JOIN b USING (process_id)""")
def s09(spark, sf_dir):
    s = view(spark, sf_dir, "session")
    sessions = s.select("db_id", "process_id", F.when(F.col("process_id") % 3 == 0, "Sleep").otherwise("Query").alias("command"), (F.col("process_id") % 2 == 0).alias("in_tx"))
    locks = s.select("process_id", F.col("blocker").isNull().alias("granted"), (F.col("start_s") + F.col("process_id") % 5).alias("wait_s"))
    return S.session_sample(sessions, locks, s.filter("blocker is not null").select("process_id", "blocker"))


@query("s10_lock_sample", ctes("session") + """ SELECT process_id, 'rel' || o_custkey % 9 AS table_name FROM session WHERE o_custkey % 9 > 2 AND o_custkey % 4 = 1 AND (process_id % 5 = 0 OR process_id % 5 <> 1)""")
def s10(spark, sf_dir):
    s = view(spark, sf_dir, "session")
    locks = s.select("process_id", (F.col("o_custkey") % 9).alias("relation_id"), F.concat(F.lit("d"), (F.col("o_custkey") % 4).cast("string")).alias("database"))
    relations = s.select((F.col("o_custkey") % 9).alias("relation_id")).distinct().filter("relation_id > 2").withColumn("table_name", F.concat(F.lit("rel"), F.col("relation_id").cast("string")))
    sessions = s.filter("process_id % 5 > 0").select("process_id", F.when(F.col("process_id") % 5 == 1, "monitor").otherwise("app").alias("role"))
    return S.lock_sample(locks, relations, sessions, "d1", "monitor").select("process_id", "table_name")


define("execution", ["ev"], "SELECT event_id, db_id, user_id AS query_id, v AS time_ms, k % 7 > 0 AS finished, k % 3 AS errors FROM ev")


@query("s11_slowest_execution", ctes("execution") + " SELECT db_id, query_id, CAST(max(time_ms) AS DOUBLE) AS time_ms, arg_max(event_id, (time_ms, event_id)) AS event_id FROM execution WHERE finished AND errors = 0 GROUP BY 1, 2")
def s11(spark, sf_dir):
    return S.slowest_execution(view(spark, sf_dir, "execution")).withColumn("time_ms", F.col("time_ms").cast("double"))


define("log_line", ["ev"], """SELECT event_id, concat('{"ts":', cast(s * 100 + event_id % 100 AS string), ',"query_id":"', cast(user_id AS string), '","db_id":"', db_id, '","pid":', cast(user_id AS string), ',"state_code":"', CASE WHEN k % 10 = 0 THEN '40P01' ELSE '00000' END,
  '","message":"', CASE WHEN k % 4 = 0 THEN concat('duration: ', cast(k AS string), ' ms plan: p', cast(event_id AS string)) WHEN k % 4 = 1 THEN concat('process still waiting for transaction ', cast(k % 3 AS string), ' after 1000 ms') ELSE 'checkpoint' END, '"}') AS value, db_id, user_id, k, s FROM ev""")


@query("s12_latest_logged_plan", ctes("log_line") + """ SELECT db_id, CAST(user_id AS VARCHAR) AS query_id, max(s * 100 + event_id % 100) AS ts, arg_max('p' || event_id, (s * 100 + event_id % 100, 'duration: ' || k || ' ms plan: p' || event_id)) AS plan FROM log_line WHERE k % 4 = 0 AND user_id % 2 = 0 GROUP BY 1, 2""")
def s12(spark, sf_dir):
    lines = view(spark, sf_dir, "log_line")
    return S.latest_logged_plan(lines.select("value"), lines.filter("user_id % 2 = 0").select("db_id", F.col("user_id").cast("string").alias("query_id")))


@query("s13_deadlock_log", ctes("log_line") + """, m AS (SELECT *, s * 100 + event_id % 100 AS ts FROM log_line)
SELECT 'deadlock' AS kind, user_id AS pid, ts FROM m WHERE k % 10 = 0 UNION ALL SELECT 'wait', user_id, max(ts) FROM m WHERE k % 4 = 1 GROUP BY user_id, k % 3""")
def s13(spark, sf_dir):
    return S.deadlock_log(view(spark, sf_dir, "log_line").select("value")).drop("message")


@query("s14_log_window", ctes("cycle") + """, r AS (SELECT db_id, CAST(at_s AS VARCHAR) AS path, log_bytes, sum(log_bytes) OVER (PARTITION BY db_id ORDER BY at_s DESC ROWS UNBOUNDED PRECEDING) - log_bytes AS before FROM cycle WHERE at_s >= 1704153600)
SELECT db_id, path, CAST(least(log_bytes, 5000000 - before) AS BIGINT) AS take_bytes FROM r WHERE before < 5000000""")
def s14(spark, sf_dir):
    files = view(spark, sf_dir, "cycle").select("db_id", F.col("at_s").cast("string").alias("path"), F.col("log_bytes").alias("bytes"), F.col("at_s").alias("modified_s"))
    return S.log_window(files, 5_000_000, 1704153600)
