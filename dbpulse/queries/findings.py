"""Queries over findings and collection health: S15-S20, R01-R21, H01-H09."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import baseline, health, reports, windows
from ..sources.fixtures import ctes, define, view
from . import query
from .counters import CYCLE, GROWTH

RANK = "CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END"
SINCE = "2024-01-15 00:00:00"
NOW = 1706659200  # 2024-01-31
P = "db_id, rule, finding_key"
define("problem_sql", ["detection"], f"""
SELECT {P}, min(detected_at) AS first_seen, max(detected_at) AS last_seen, count(*) AS n, max_by(severity, detection_id) AS severity, max_by(table_name, detection_id) AS table_name,
  max_by(evidence, detection_id) AS evidence FROM detection GROUP BY {P}""")


def since():
    return F.lit(SINCE).cast("timestamp_ntz")


def problems(spark, sf_dir):
    return reports.fold_problems(view(spark, sf_dir, "detection"))


@query("s15_fold_problems", ctes("problem_sql") + f" SELECT {P}, first_seen, last_seen, n, severity, table_name FROM problem_sql")
def s15(spark, sf_dir):
    return problems(spark, sf_dir).select("db_id", "rule", "finding_key", "first_seen", "last_seen", "n", "severity", "table_name")


@query("s16_findings_view", ctes("problem_sql") + f""" SELECT detection_id, {P}, d.severity, d.detected_at, p.first_seen, p.n, coalesce(CASE WHEN detection_id % 3 <> 0 THEN d.evidence END, p.evidence) AS evidence
FROM detection d JOIN problem_sql p USING ({P})""")
def s16(spark, sf_dir):
    d = view(spark, sf_dir, "detection")
    thin = d.withColumn("evidence", F.when(F.col("detection_id") % 3 != 0, F.col("evidence")))
    return reports.findings_view(reports.fold_problems(d), thin).select("detection_id", "db_id", "rule", "finding_key", "severity", "detected_at", "first_seen", "n", "evidence")


@query("s17_fold_samples", ctes("stmt") + """ SELECT db_id, query_id, max(captured_at) AS captured_at, max_by(execution_count, captured_at) AS execution_count FROM stmt
GROUP BY db_id, query_id HAVING max(captured_at) >= (SELECT max(captured_at) FROM stmt) - INTERVAL 24 HOUR""")
def s17(spark, sf_dir):
    return reports.fold_samples(view(spark, sf_dir, "stmt"), 24).select("db_id", "query_id", "captured_at", "execution_count")


@query("s18_fold_evaluation", ctes("evaluation") + " SELECT db_id, code, bucket_s, state, reason, count(DISTINCT captured_at) AS windows, max(captured_at) AS last_at FROM evaluation GROUP BY ALL")
def s18(spark, sf_dir):
    return reports.fold_evaluation(view(spark, sf_dir, "evaluation"))


@query("s19_purge", ctes("detection") + " SELECT detection_id FROM detection WHERE detected_at >= (SELECT max(detected_at) FROM detection) - INTERVAL 15 DAY")
def s19(spark, sf_dir):
    return reports.purge(view(spark, sf_dir, "detection"), "detected_at", 15).select("detection_id")


@query("s20_export_report", ctes("problem_sql") + f""" SELECT {P}, '{{"severity":"' || severity || '","n":' || n || ',"table_name":"' || table_name || '"}}' AS line FROM problem_sql""")
def s20(spark, sf_dir):
    return reports.export_report(problems(spark, sf_dir))


@query("r01_prioritize", ctes("detection") + f""" SELECT detection_id, row_number() OVER (ORDER BY coalesce(impact_ms, 0) DESC, {RANK}, rule NULLS LAST, finding_key, detection_id) AS place FROM detection""")
def r01(spark, sf_dir):
    return baseline.places(view(spark, sf_dir, "detection"), F.col("detection_id")).select("detection_id", "place")


@query("r02_session_findings", ctes("detection") + f""", g AS (
  SELECT {P}, count(*) FILTER (detected_at >= TIMESTAMP '{SINCE}') AS n, sum(impact_ms) FILTER (detected_at >= TIMESTAMP '{SINCE}') AS impact_ms, count(*) AS n_total,
    min({RANK}) FILTER (detected_at >= TIMESTAMP '{SINCE}') AS rank, max(detected_at) FILTER (detected_at >= TIMESTAMP '{SINCE}') AS last_at FROM detection GROUP BY {P})
SELECT {P}, n, CAST(impact_ms AS DOUBLE) AS impact_ms, n_total, last_at, ['high', 'medium', 'low'][rank + 1] AS severity FROM g WHERE n > 0 ORDER BY coalesce(impact_ms, 0) DESC, rank, rule, finding_key, db_id LIMIT 200""")
def r02(spark, sf_dir):
    return reports.session_findings(view(spark, sf_dir, "detection"), since()).withColumn("impact_ms", F.col("impact_ms").cast("double"))


COUNTS = ", ".join(f"count(*) FILTER (state = '{s}') AS {s}" for s in ("evaluated", "partial", "not_evaluated"))
LATEST = "arg_max(state, (captured_at, event_id))"


@query("r03_evaluation_summary", ctes("evaluation") + f" SELECT db_id, code, {LATEST} AS state, {COUNTS}, max(captured_at) AS updated_at FROM evaluation GROUP BY ALL")
def r03(spark, sf_dir):
    return reports.evaluation_summary(view(spark, sf_dir, "evaluation"))


CATALOG = ["click", "view", "error", "signup", "purchase", "CT-03", "CT-04"]
define("db_health", ["evaluation"], "SELECT db_id, db_id = 'db1' AS failed, max(captured_at) - interval '2' hour AS failed_at FROM evaluation GROUP BY db_id")
OVERLAY = f"""su AS (SELECT db_id, code, {LATEST} AS state, max(captured_at) AS updated_at FROM evaluation GROUP BY ALL), ov AS (
  SELECT h.db_id, c.code, CASE WHEN state IS NULL OR (failed AND updated_at < failed_at) THEN 'not_evaluated' ELSE state END AS state
  FROM db_health h CROSS JOIN (SELECT unnest({CATALOG}) AS code) c LEFT JOIN su ON su.db_id = h.db_id AND su.code = c.code)"""


def overlaid(spark, sf_dir):
    catalog = spark.createDataFrame([(c,) for c in CATALOG], "code string")
    return reports.overlay_failure(reports.evaluation_summary(view(spark, sf_dir, "evaluation")), view(spark, sf_dir, "db_health"), catalog)


@query("r04_overlay_failure", ctes("evaluation", "db_health") + f", {OVERLAY} SELECT * FROM ov")
def r04(spark, sf_dir):
    return overlaid(spark, sf_dir)


@query("r05_applicable", ctes("evaluation", "db_health") + f", {OVERLAY} SELECT db_id, code, CASE WHEN code IN ('CT-03', 'CT-04') AND db_id = 'db0' THEN 'not_applicable' ELSE state END AS state FROM ov")
def r05(spark, sf_dir):
    engines = view(spark, sf_dir, "db_health").select("db_id", F.when(F.col("db_id") == "db0", "postgres").otherwise("mysql").alias("engine"))
    return reports.applicable(overlaid(spark, sf_dir), engines)


@query("r06_activity", ctes("detection") + " SELECT db_id, CAST(date_trunc('hour', detected_at) AS TIMESTAMP) AS hour, count(*) AS n FROM detection GROUP BY ALL")
def r06(spark, sf_dir):
    return reports.activity(view(spark, sf_dir, "detection"))


@query("r07_dense_activity", ctes("detection") + """, a AS (SELECT db_id, CAST(date_trunc('hour', detected_at) AS TIMESTAMP) AS hour, count(*) AS n FROM detection GROUP BY ALL),
e AS (SELECT db_id, max(hour) AS e FROM a GROUP BY 1), g AS (SELECT db_id, unnest(range(0, 24)) AS i, e FROM e)
SELECT g.db_id, g.e - to_hours(i) AS hour, coalesce(n, 0) AS n FROM g LEFT JOIN a ON a.db_id = g.db_id AND a.hour = g.e - to_hours(i)""")
def r07(spark, sf_dir):
    return reports.dense_activity(reports.activity(view(spark, sf_dir, "detection")))


SAMPLES = f"{CYCLE}, {GROWTH}, cs AS (SELECT db_id, at_s, CASE WHEN reset THEN deadlocks ELSE grown END AS delta, reset, seconds, grown_bytes, grown_bytes > 20000 AS overrun FROM d JOIN l USING (db_id, at_s))"


def samples(spark, sf_dir):
    return windows.cycle_samples(view(spark, sf_dir, "cycle"), limit_bytes=20000)


@query("r08_deadlock_quality", ctes("cycle", "ev") + f""", {SAMPLES}, c AS (SELECT db_id, CAST(sum(delta) AS BIGINT) AS counted, count(*) FILTER (reset) AS resets, count(*) FILTER (overrun) AS overruns,
  count(*) FILTER (seconds > 3600) AS long_gaps FROM cs WHERE db_id <> 'db0' OR seconds IS NULL GROUP BY db_id), p AS (SELECT db_id, 'CT-0' || (k % 4 + 1) AS pattern, count(*) AS n FROM ev WHERE event_type = 'error' GROUP BY 1, 2),
s AS (SELECT db_id, CAST(sum(n) AS BIGINT) AS captured, string_agg(pattern || ':' || n, ',' ORDER BY pattern) AS patterns FROM p GROUP BY 1)
SELECT db_id, counted, resets, overruns, long_gaps, coalesce(captured, 0) AS captured, coalesce(patterns, '') AS patterns, CASE WHEN counted > coalesce(captured, 0) THEN counted - coalesce(captured, 0) WHEN counted IS NOT NULL THEN 0 END AS missed, CASE WHEN counted < coalesce(captured, 0) THEN coalesce(captured, 0) - counted WHEN counted IS NOT NULL THEN 0 END AS extra FROM c LEFT JOIN s USING (db_id)""")
def r08(spark, sf_dir):
    seen = samples(spark, sf_dir).filter("db_id != 'db0' or seconds is null")  # a database with its first sample only: nothing is comparable
    captured = view(spark, sf_dir, "ev").filter("event_type = 'error'").withColumn("pattern", F.concat(F.lit("CT-0"), (F.col("k") % 4 + 1).cast("string")))
    return reports.deadlock_quality(seen, captured, long_gap=3600)


@query("r09_range_report", ctes("detection") + f""", i AS (SELECT {P}, count(*) AS n, min(detected_at) AS first_at, max(detected_at) AS last_at, arg_min(severity, {RANK}) AS worst, arg_max(severity, (detected_at, detection_id)) AS last_severity,
  count(*) FILTER (severity = 'high') AS n_high, count(*) FILTER (severity = 'medium') AS n_medium, count(*) FILTER (severity = 'low') AS n_low, CAST(sum(impact_ms) AS DOUBLE) AS impact_ms
  FROM detection WHERE detected_at >= TIMESTAMP '{SINCE}' AND detected_at < TIMESTAMP '2024-01-25 06:00:00' GROUP BY {P}), e AS (SELECT {P}, count(*) AS n_ever, min(detected_at) AS first_ever FROM detection GROUP BY {P}) SELECT * FROM i JOIN e USING ({P})""")
def r09(spark, sf_dir):
    found = reports.range_report(view(spark, sf_dir, "detection"), since(), F.lit("2024-01-25 00:00:00").cast("timestamp_ntz"), grace_s=6 * 3600)
    return found.withColumn("impact_ms", F.col("impact_ms").cast("double"))


@query("r10_range_evaluation", ctes("evaluation") + f""" SELECT db_id, code, {COUNTS}, arg_max(reason, (captured_at, event_id)) FILTER (state <> 'evaluated') AS last_reason, {LATEST} AS final_state FROM evaluation GROUP BY db_id, code""")
def r10(spark, sf_dir):
    return reports.range_evaluation(view(spark, sf_dir, "evaluation"))


# runs that checked a section: every day with events of it, or any fourth day
define("run_checked", ["issue_seen"], """
SELECT r.db_id, r.run_no, s.section, (r.run_no + 1) * 86400 AS at_s FROM (SELECT DISTINCT db_id, run_no FROM issue_seen) r CROSS JOIN (SELECT 'statements' AS section UNION ALL SELECT 'locks') s""")
INTERVALS = """num AS (SELECT *, row_number() OVER w AS nth, lead(at_s) OVER w AS next_at FROM run_checked WINDOW w AS (PARTITION BY db_id, section ORDER BY run_no)),
seen AS (SELECT db_id, section, code, run_no, count(*) AS n, arg_max(severity, s) AS severity, min(s) AS s0, max(s) AS s1 FROM issue_seen GROUP BY ALL),
isl AS (SELECT *, nth - row_number() OVER (PARTITION BY db_id, section, code ORDER BY nth) AS island FROM seen JOIN num USING (db_id, section, run_no)),
itv AS (SELECT db_id, section, code, min(s0) AS opened_s, max(s1) AS last_s, CAST(sum(n) AS BIGINT) AS occurrences, arg_max(severity, nth) AS severity, max(next_at) FILTER (nth = mx) AS closed_s
  FROM (SELECT *, max(nth) OVER (PARTITION BY db_id, section, code, island) AS mx FROM isl) GROUP BY db_id, section, code, island)"""


def intervals(spark, sf_dir):
    return health.issue_intervals(view(spark, sf_dir, "issue_seen"), view(spark, sf_dir, "run_checked"))


@query("r11_outages", ctes("issue_seen", "run_checked") + f""", {INTERVALS}, c AS (SELECT *, greatest(opened_s, 1705276800) AS from_s, least(coalesce(closed_s, 1706140800), 1706140800) AS to_s FROM itv
  WHERE opened_s < 1706140800 AND (closed_s IS NULL OR closed_s > 1705276800))
SELECT db_id, code, min(from_s) AS first_s, max(to_s) AS last_s, bool_or(closed_s IS NULL) AS still_open, count(*) AS cuts, CAST(sum(to_s - from_s) AS BIGINT) AS seconds FROM c GROUP BY db_id, code""")
def r11(spark, sf_dir):
    return reports.outages(intervals(spark, sf_dir), 1705276800, 1706140800)


@query("r12_report_summary", ctes("problem_sql") + " SELECT severity, rule, CAST(grouping_id(severity, rule) AS BIGINT) AS level, count(*) AS problems, CAST(sum(n) AS BIGINT) AS detections FROM problem_sql GROUP BY GROUPING SETS ((severity), (rule), ())")
def r12(spark, sf_dir):
    return reports.report_summary(problems(spark, sf_dir))


@query("r13_log_rates", ctes("cycle") + f""", {SAMPLES} SELECT db_id, sum(grown_bytes) / sum(seconds) AS mean_rate, max(grown_bytes / seconds) AS max_rate, max(seconds) AS max_gap, count(*) FILTER (seconds > 3600) AS long_cycles
FROM cs WHERE seconds > 0 GROUP BY db_id""")
def r13(spark, sf_dir):
    return reports.log_rates(samples(spark, sf_dir), 3600)


@query("r14_severity_counts", ctes("problem_sql") + " SELECT CASE WHEN severity IN ('high', 'medium', 'low') THEN severity ELSE 'other' END AS severity, count(*) AS n FROM problem_sql GROUP BY 1")
def r14(spark, sf_dir):
    return reports.severity_counts(problems(spark, sf_dir))


@query("r14_top_patterns", ctes("problem_sql") + " SELECT rule, count(*) AS n FROM problem_sql GROUP BY 1 ORDER BY n DESC, rule LIMIT 3")
def r14b(spark, sf_dir):
    return reports.top_patterns(problems(spark, sf_dir))


@query("r15_kpis", ctes("problem_sql") + """ SELECT db_id, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low,
  count(DISTINCT table_name) AS tables FROM problem_sql GROUP BY 1""")
def r15(spark, sf_dir):
    return reports.kpis(problems(spark, sf_dir))


@query("r16_issue_listing", ctes("issue_seen", "run_checked") + f", {INTERVALS} SELECT db_id, code, section, opened_s, last_s, closed_s FROM itv WHERE closed_s IS NULL OR closed_s >= 1705968000")
def r16(spark, sf_dir):
    return reports.issue_listing(intervals(spark, sf_dir), 1705968000).select("db_id", "code", "section", "opened_s", "last_s", "closed_s")


@query("r17_stale_runs", ctes("cycle") + f" SELECT db_id, max(at_s) AS last_s, {NOW} - max(at_s) > 90000 AS stale FROM cycle GROUP BY 1")
def r17(spark, sf_dir):
    return reports.stale_runs(view(spark, sf_dir, "cycle"), NOW, 90000)


@query("r18_evaluated_share", ctes("evaluation") + f""", su AS (SELECT db_id, code, {LATEST} AS state, max(captured_at) AS updated_at FROM evaluation GROUP BY ALL)
SELECT db_id, count(*) FILTER (state = 'evaluated') AS evaluated, count(*) AS applicable, max(updated_at) AS updated_at FROM su GROUP BY 1""")
def r18(spark, sf_dir):
    return reports.evaluated_share(reports.evaluation_summary(view(spark, sf_dir, "evaluation")))


@query("r19_severity_breakdown", ctes("detection") + f""", c AS (SELECT {P}, severity, {RANK} AS r, count(*) AS c FROM detection GROUP BY ALL)
SELECT {P}, CASE WHEN count(*) > 1 THEN string_agg(c || ' ' || severity, ', ' ORDER BY r) END AS breakdown FROM c GROUP BY {P}""")
def r19(spark, sf_dir):
    return reports.severity_breakdown(view(spark, sf_dir, "detection"))


@query("r20_health_report", ctes("cycle", "issue_seen", "run_checked") + f""", {SAMPLES}, {INTERVALS}, rc AS (
  SELECT db_id, count(*) AS cycles, CAST(sum(delta) AS BIGINT) AS deadlocks, count(*) FILTER (overrun) AS overruns, max(grown_bytes) AS max_bytes FROM cs WHERE at_s >= {NOW} - 200000 GROUP BY db_id),
o AS (SELECT db_id, count(*) AS open_issues FROM itv WHERE closed_s IS NULL GROUP BY db_id)
SELECT db_id, coalesce(cycles, 0) AS cycles, deadlocks, coalesce(overruns, 0) AS overruns, max_bytes, coalesce(open_issues, 0) AS open_issues FROM rc FULL JOIN o USING (db_id)""")
def r20(spark, sf_dir):
    return reports.health_report(samples(spark, sf_dir), intervals(spark, sf_dir), NOW, 200000)


define("registry", ["ev"], """
SELECT user_id, CASE WHEN min(k) % 5 = 0 THEN cast(NULL AS bigint) ELSE max(s) - 86400 * (user_id % 4) END AS from_s, CASE WHEN user_id % 3 > 0 THEN max(s) + 3600 * (user_id % 50) END AS to_s, user_id % 2 = 0 AS reported FROM ev GROUP BY user_id""")
WINDOW_NOW = 1706500000


@query("r21_database_listing", ctes("registry") + f""" SELECT user_id, CASE WHEN from_s IS NULL THEN 'none' WHEN from_s > {WINDOW_NOW} THEN 'scheduled' WHEN to_s IS NULL OR to_s > {WINDOW_NOW} THEN 'running'
  WHEN reported THEN 'reported' ELSE 'finished' END AS window_state FROM registry""")
def r21(spark, sf_dir):
    return reports.database_listing(view(spark, sf_dir, "registry"), WINDOW_NOW).select("user_id", "window_state")


SEV = "CASE severity WHEN 'error' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END"


@query("h01_run_status", ctes("issue_seen") + f" SELECT db_id, run_no, CASE max({SEV}) WHEN 2 THEN 'failed' WHEN 1 THEN 'degraded' ELSE 'ok' END AS status FROM issue_seen GROUP BY db_id, run_no")
def h01(spark, sf_dir):
    return health.run_status(view(spark, sf_dir, "issue_seen"))


@query("h02_fold_issues", ctes("issue_seen") + " SELECT db_id, run_no, code, section, count(*) AS n, arg_max(severity, (s, event_id)) AS severity, max(s) AS last_s FROM issue_seen GROUP BY ALL")
def h02(spark, sf_dir):
    return health.fold_issues(view(spark, sf_dir, "issue_seen"))


@query("h03_issue_intervals", ctes("issue_seen", "run_checked") + f", {INTERVALS} SELECT db_id, section, code, opened_s, last_s, occurrences, closed_s FROM itv")
def h03(spark, sf_dir):
    return intervals(spark, sf_dir).drop("severity")


define("seen_text", [], "SELECT concat('db', cast(conv_id % 2 AS string)) AS db_id, CASE WHEN conv_id % 17 = 0 THEN '<insufficient privilege>' ELSE text END AS text FROM @conversations")


@query("h04_symptoms", ctes("seen_text") + " SELECT db_id, count(*) FILTER (contains(text, '<insufficient privilege>')) AS hidden, count(*) FILTER (strlen(text) >= 297) AS truncated FROM seen_text GROUP BY 1")
def h04(spark, sf_dir):
    return health.symptoms(view(spark, sf_dir, "seen_text"), 300)


define("stats_row", [], """
SELECT concat('db', cast(p_partkey % 7 AS string)) AS db_id, p_name AS table_name, p_size % 3 AS live_rows, p_size AS catalog_rows, CASE WHEN p_partkey % 2 = 0 THEN p_size END AS last_analyzed FROM @part""")


@query("h05_lost_stats", ctes("stats_row") + """, l AS (SELECT * FROM stats_row WHERE live_rows = 0 AND catalog_rows > 0 AND last_analyzed IS NULL)
SELECT db_id, count(*) AS n, array_to_string(list_sort(list(DISTINCT table_name))[1:3], ',') AS examples FROM l GROUP BY 1""")
def h05(spark, sf_dir):
    return health.lost_stats(view(spark, sf_dir, "stats_row"))


define("setting", [], """
SELECT concat('db', cast(p_size AS string)) AS db_id, p_brand AS name, CASE WHEN p_partkey % 3 = 0 THEN 'off' ELSE 'on' END AS value FROM @part""")
NEEDED = {"Brand#11": "on", "Brand#12": "off", "Brand#13": "on", "Brand#23": "on", "Brand#1": "on", "Brand#2": "off"}


@query("h06_config_issues", ctes("setting") + f""", n(name, want) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in NEEDED.items())})
SELECT db_id, array_to_string(list_sort(list(DISTINCT name)), ',') AS wrong, count(DISTINCT name) AS n FROM setting JOIN n USING (name) WHERE value <> want GROUP BY 1""")
def h06(spark, sf_dir):
    return health.config_issues(view(spark, sf_dir, "setting"), NEEDED)


define("server_version", [], """
SELECT concat('db', cast(p_partkey AS string)) AS db_id, CASE WHEN p_partkey % 4 = 3 THEN 'mysql' ELSE 'postgres' END AS engine, CASE WHEN p_size % 9 = 0 THEN cast(NULL AS bigint) ELSE cast(130000 + p_size % 6 * 10000 + p_size AS bigint) END AS version_num FROM @part""")


@query("h06b_version_issues", ctes("server_version") + """ SELECT db_id, version_num, CASE WHEN version_num < 150000 THEN 'PG_VERSION_UNSUPPORTED' ELSE 'PG_VERSION_LIMITED' END AS code,
  CASE WHEN version_num < 150000 THEN '' WHEN version_num < 160000 THEN 'EXPLAIN (GENERIC_PLAN), pg_stat_statements.stats_since, pg_stat_user_indexes.last_idx_scan' ELSE 'pg_stat_statements.stats_since' END AS missing FROM server_version WHERE engine = 'postgres' AND version_num < 170000""")
def h06b(spark, sf_dir):
    return health.version_issues(view(spark, sf_dir, "server_version"))


@query("h07_payload_flag", ctes("cycle") + """ SELECT db_id, at_s, coalesce(last_value(CASE WHEN log_bytes > 45000 THEN true WHEN log_bytes < 20000 THEN false END IGNORE NULLS)
  OVER (PARTITION BY db_id ORDER BY at_s ROWS UNBOUNDED PRECEDING), false) AS flag FROM cycle""")
def h07(spark, sf_dir):
    return health.payload_flag(view(spark, sf_dir, "cycle").withColumn("bytes", F.col("log_bytes")), 45000, 20000).select("db_id", "at_s", "flag")


@query("h08_missed_deadlocks", ctes("cycle", "ev") + f""", {SAMPLES}, e AS (SELECT db_id, s FROM ev WHERE event_type = 'error'),
j AS (SELECT c.db_id, c.at_s, c.delta, count(e.s) AS captured FROM cs c LEFT JOIN e ON e.db_id = c.db_id AND e.s > c.at_s - 3720 AND e.s <= c.at_s - 120 GROUP BY ALL)
SELECT db_id, at_s, delta AS counted, captured, CASE WHEN delta IS NULL THEN 0 ELSE greatest(delta - captured, 0) END AS missed FROM j""")
def h08(spark, sf_dir):
    return health.missed_deadlocks(samples(spark, sf_dir), view(spark, sf_dir, "ev").filter("event_type = 'error'"))


define("run_row", ["ev"], "SELECT event_id, db_id, s * 100 + event_id % 100 AS at_s, event_type AS status, CASE WHEN k % 4 = 0 THEN concat('v', cast(k AS string)) END AS version FROM ev")


@query("h09_last_runs", ctes("run_row") + " SELECT db_id, max(at_s) AS last_s, arg_max(status, at_s) AS status, arg_max(version, at_s) FILTER (version IS NOT NULL) AS version FROM run_row GROUP BY 1")
def h09(spark, sf_dir):
    return health.last_runs(view(spark, sf_dir, "run_row"))
