"""Queries of re-evaluated archives: Q13, Q14, Q24-Q26, and G07."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contention, quality
from ..plans import flatten
from ..sources import scans
from ..sources.fixtures import ctes, define, view
from . import query
from .rules import PGW

define("met_window", ["ev"], "SELECT db_id, user_id AS query_id, s AS at_s FROM ev WHERE value > 150")
define("told_finding", ["ev"], "SELECT db_id, user_id AS query_id, s + 600 AS at_s FROM ev WHERE value > 140 AND k % 3 > 0")


@query("q13_eval_degradation", ctes("met_window", "told_finding") + """, m AS (SELECT db_id, query_id, min(at_s) AS met_s FROM met_window GROUP BY 1, 2), t AS (SELECT db_id, query_id, min(at_s) AS told_s FROM told_finding GROUP BY 1, 2)
SELECT coalesce(m.db_id, t.db_id) AS db_id, coalesce(m.query_id, t.query_id) AS query_id, CASE WHEN met_s IS NULL THEN 'not met' WHEN told_s IS NULL THEN 'missed' WHEN told_s < met_s THEN 'before' WHEN told_s <= met_s + 3600 THEN 'in time' ELSE 'late' END AS outcome
FROM m FULL JOIN t ON m.db_id = t.db_id AND m.query_id = t.query_id""")
def q13(spark, sf_dir):
    return quality.eval_degradation(view(spark, sf_dir, "met_window"), view(spark, sf_dir, "told_finding"), 3600)


define("pair_window", ["ev"], "SELECT DISTINCT db_id, bucket AS captured_at, event_type AS child_id, CASE WHEN bucket % 3 = 0 THEN 'a' ELSE 'b' END AS parent_id, bucket % 5 AS r FROM ev")


@query("q14_eval_n1", ctes("pair_window") + """, t AS (SELECT * FROM pair_window WHERE r < 4), f AS (SELECT db_id, captured_at, child_id, CASE WHEN r = 2 THEN 'c' ELSE parent_id END AS got FROM pair_window WHERE r > 0)
SELECT coalesce(t.child_id, f.child_id) AS child_id, count(t.parent_id) AS windows, count(*) FILTER (t.parent_id = got) AS right_parent, count(*) FILTER (t.parent_id <> got) AS other_parent, count(*) FILTER (t.parent_id IS NULL) AS stray
FROM t FULL JOIN f ON t.db_id = f.db_id AND t.captured_at = f.captured_at AND t.child_id = f.child_id GROUP BY 1""")
def q14(spark, sf_dir):
    p = view(spark, sf_dir, "pair_window")
    found = p.filter("r > 0").withColumn("parent_id", F.when(F.col("r") == 2, "c").otherwise(F.col("parent_id")))
    return quality.eval_n1(p.filter("r < 4"), found)


@query("q24_archive_projection", ctes("raw_snapshot") + """ SELECT msg_id, CAST(CASE WHEN event_type IN ('click', 'view') AND k % 9 <> 3 THEN k + 1 ELSE 1 END AS BIGINT) AS calls, CASE WHEN event_type IN ('click', 'view') THEN 2 ELSE 1 END AS rows,
  CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END AS candidates, CASE WHEN user_id % 2 = 0 THEN 2 ELSE 0 END AS scans, CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END AS full_scans FROM raw_snapshot WHERE k % 9 IN (3, 4, 7, 8)""")
def q24(spark, sf_dir):
    # every other user's snapshots have candidates and a plan, of a chosen and of another fingerprint
    more = '{"top_impact_queries":[{"query_id":"other"},{"query_id":"purchase"}],"canonic_explains":[{"query_id":"other","canonical_plan":{"physical_operations":[{"type":"scan","access_method":"full_table_scan"},{"type":"scan","access_method":"index_lookup"},{"type":"sort"}]}},{"query_id":"purchase","canonical_plan":{"physical_operations":[{"type":"scan"}]}}],'
    payload = F.when((F.col("user_id") % 2 == 0) & F.col("payload").startswith("{"), F.concat(F.lit(more), F.substring("payload", 2, 1_000_000))).otherwise(F.col("payload"))
    raw = view(spark, sf_dir, "raw_snapshot").select("msg_id", "db_id", "captured_at", payload.alias("payload"))
    ids = spark.createDataFrame([("click",), ("view",), ("other",)], "query_id string")
    return quality.archive_projection(scans.ingest_snapshots(raw), ids)


define("plan_step", ["ev"], "SELECT event_id AS plan_id, 0 AS pos, 'scan' AS type, CASE k % 3 WHEN 0 THEN 'full_table_scan' ELSE 'index_lookup' END AS access, CASE WHEN k % 3 > 0 THEN concat('ix', cast(k % 3 AS string)) END AS index_name FROM ev")
define("plan_run", ["ev"], "SELECT event_id AS plan_id, user_id AS query_id, CASE k % 4 WHEN 0 THEN 'sample' WHEN 1 THEN 'generic' ELSE 'history' END AS source, v AS time_ms, k FROM ev")


@query("q25_plan_agreement", ctes("plan_step", "plan_run") + """, s AS (SELECT r.*, k % 3 AS sig FROM plan_run r), m AS (SELECT query_id, arg_max(sig, (time_ms, plan_id)) AS ref FROM s GROUP BY 1)
SELECT source, kind, CAST(grouping_id(source, kind) AS BIGINT) AS level, avg(CASE WHEN sig = ref THEN 1.0 ELSE 0 END) AS agreement, count(*) AS plans FROM (SELECT *, CASE WHEN k % 5 = 0 THEN 'join' ELSE 'select' END AS kind FROM s) JOIN m USING (query_id) GROUP BY GROUPING SETS ((source, kind), (source))""")
def q25(spark, sf_dir):
    return quality.plan_agreement(view(spark, sf_dir, "plan_step"), view(spark, sf_dir, "plan_run").withColumn("kind", F.when(F.col("k") % 5 == 0, "join").otherwise("select")).drop("k"), "query_id")


@query("q26_lost_conditions", PGW + """ SELECT 'cond' AS kind, count(c) AS n, 0 AS lost FROM op WHERE c IS NOT NULL UNION ALL SELECT 'filter', count(f), count(*) FILTER (id % 3 = 0) FROM op WHERE f IS NOT NULL""")
def q26(spark, sf_dir):
    plans = view(spark, sf_dir, "pg_plan")
    get = flatten.field
    raw = flatten.walk(plans, "id", "plan", "Plans").select("id", "path", F.coalesce(get("Index Cond"), get("Recheck Cond")).alias("cond"), get("Filter").alias("filter"))
    ops = flatten.flatten_pg_plan(plans, "id", "plan").filter("id % 3 > 0")  # as if one vendor's scans had lost theirs
    return quality.lost_conditions(raw, ops, ["id", "path"], ["cond", "filter"])


@query("g07_known_flags", ctes("deadlock_trx", "deadlock_lock") + """ SELECT t.report_id, bool_and(w.target IS NOT NULL) AS targets_known, bool_and(holds_known) AS holds_known
FROM deadlock_trx t LEFT JOIN deadlock_lock w ON w.report_id = t.report_id AND w.process_id = t.process_id AND w.role = 'wait' GROUP BY 1""")
def g07(spark, sf_dir):
    return contention.cycle_flags(contention.reports_together(view(spark, sf_dir, "deadlock_own"))).select("report_id", "targets_known", "holds_known")
