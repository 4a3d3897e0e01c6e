"""Queries over statement counters: windows W01-W14, candidates C01-C06, degradation D01."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import baseline, candidates, windows
from ..sources.fixtures import ctes, define, view
from . import query

# some samples are taken again an hour later without any call between
define("stmt_idle", ["stmt"], """
SELECT * FROM stmt UNION ALL SELECT db_id, query_id, captured_at + interval '1' hour, execution_count, total_time_ms, rows_returned, disk_spill_indicator,
  sort_merge_passes, CASE WHEN execution_count % 2 = 0 THEN counters_epoch END FROM stmt WHERE execution_count % 3 = 0""")
define("stmt_wide", ["stmt"], """
SELECT *, total_time_ms / execution_count AS mean_time_ms, total_time_ms / execution_count * (1 + execution_count % 9) AS max_time_ms FROM stmt""")

LAG = "OVER (PARTITION BY db_id, query_id ORDER BY captured_at)"
DELTA = f"""delta AS (
  SELECT *, lag(captured_at) {LAG} AS window_start, coalesce(counters_epoch <> lag(counters_epoch IGNORE NULLS) {LAG}, false) AS reset,
    execution_count - lag(execution_count) {LAG} AS dc, total_time_ms - lag(total_time_ms) {LAG} AS dt FROM stmt
), win AS (
  SELECT db_id, query_id, captured_at, window_start, CASE WHEN ok THEN dc END AS calls, CASE WHEN ok THEN dt END AS time_ms, CASE WHEN ok THEN dt / dc END AS mean_ms
  FROM (SELECT *, NOT reset AND dc > 0 AND dt >= 0 AS ok FROM delta)
)"""


@query("w01_merge_counters", ctes("stmt_dup") + """
SELECT db_id, query_id, captured_at, CAST(sum(execution_count) AS BIGINT) AS execution_count, sum(total_time_ms) AS total_time_ms, CAST(sum(rows_returned) AS BIGINT) AS rows_returned,
  CAST(sum(disk_spill_indicator) AS BIGINT) AS disk_spill_indicator, CAST(sum(sort_merge_passes) AS BIGINT) AS sort_merge_passes, arg_min(counters_epoch, part) AS counters_epoch
FROM stmt_dup GROUP BY db_id, query_id, captured_at""")
def w01(spark, sf_dir):
    return windows.merge_counters(view(spark, sf_dir, "stmt_dup"))


@query("w02_drop_idle", ctes("stmt_idle") + f""", k AS (
  SELECT *, last_value(counters_epoch IGNORE NULLS) OVER (PARTITION BY db_id, query_id ORDER BY captured_at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known, lag(execution_count) {LAG} AS c FROM stmt_idle)
SELECT db_id, query_id, captured_at, execution_count, coalesce(counters_epoch, known) AS counters_epoch FROM k
WHERE NOT coalesce(execution_count = c AND (counters_epoch IS NULL OR known IS NULL OR counters_epoch = known), false)""")
def w02(spark, sf_dir):
    return windows.drop_idle(view(spark, sf_dir, "stmt_idle")).select("db_id", "query_id", "captured_at", "execution_count", "counters_epoch")


@query("w03_delta_windows", ctes("stmt") + f", {DELTA} SELECT * FROM win")
def w03(spark, sf_dir):
    return windows.delta_windows(view(spark, sf_dir, "stmt"))


@query("w04_window_history", ctes("stmt") + f""", {DELTA}
SELECT db_id, query_id, captured_at, count(*) OVER w AS n_windows, min(captured_at) OVER w AS oldest_end, max(mean_ms) OVER w AS worst_ms FROM win WHERE calls >= 2
WINDOW w AS (PARTITION BY db_id, query_id ORDER BY captured_at ROWS BETWEEN 89 PRECEDING AND CURRENT ROW)""")
def w04(spark, sf_dir):
    h = windows.window_history(windows.delta_windows(view(spark, sf_dir, "stmt")), n=90, min_calls=2)
    return h.select("db_id", "query_id", "captured_at", F.size("means").cast("long").alias("n_windows"), F.array_min("ends").alias("oldest_end"), F.array_max("means").alias("worst_ms"))


DB_BEFORE = "caps AS (SELECT db_id, captured_at, lag(captured_at) OVER (PARTITION BY db_id ORDER BY captured_at) AS db_before FROM (SELECT DISTINCT db_id, captured_at FROM stmt))"
ADMITTED = "coalesce(epoch(captured_at) - epoch(counters_epoch) <= {s} OR counters_epoch > db_before, false)"


@query("w05_rows_windows", ctes("stmt") + f""", {DB_BEFORE}, r AS (
  SELECT db_id, query_id, captured_at, lag(captured_at) {LAG} IS NULL AS is_new, coalesce(counters_epoch <> lag(counters_epoch IGNORE NULLS) {LAG}, false) AS reset, {ADMITTED.format(s=21600)} AS admitted,
    execution_count - coalesce(lag(execution_count) {LAG}, 0) AS calls, rows_returned - coalesce(lag(rows_returned) {LAG}, 0) AS rows FROM stmt JOIN caps USING (db_id, captured_at))
SELECT db_id, query_id, captured_at, is_new, calls, rows FROM r WHERE NOT reset AND (NOT is_new OR admitted) AND calls > 0 AND rows >= 0""")
def w05(spark, sf_dir):
    return windows.rows_windows(view(spark, sf_dir, "stmt"), new_within=21600).drop("window_start", "time_ms")


@query("w06_spill_windows", ctes("stmt") + f""", {DB_BEFORE}, r AS (
  SELECT db_id, query_id, captured_at, lag(captured_at) {LAG} IS NULL AS is_new, coalesce(counters_epoch <> lag(counters_epoch IGNORE NULLS) {LAG}, false) AS reset, {ADMITTED.format(s=21600)} AS admitted,
    execution_count - coalesce(lag(execution_count) {LAG}, 0) AS calls, total_time_ms - coalesce(lag(total_time_ms) {LAG}, 0) AS time_ms,
    disk_spill_indicator - coalesce(lag(disk_spill_indicator) {LAG}, 0) AS spill FROM stmt JOIN caps USING (db_id, captured_at))
SELECT db_id, query_id, captured_at, calls, time_ms, CASE WHEN spill >= 0 THEN spill END AS spill, CAST(NULL AS BIGINT) AS merges FROM r WHERE NOT reset AND (NOT is_new OR admitted) AND calls >= 0""")
def w06(spark, sf_dir):
    return windows.spill_windows(view(spark, sf_dir, "stmt"), new_within=21600)


@query("w07_activity_windows", ctes("stmt") + f""", r AS (
  SELECT *, coalesce(lag(captured_at) {LAG} IS NULL OR counters_epoch <> lag(counters_epoch IGNORE NULLS) {LAG} OR execution_count < lag(execution_count) {LAG}, false) AS whole,
    lag(execution_count) {LAG} AS pc, lag(total_time_ms) {LAG} AS pt FROM stmt)
SELECT db_id, query_id, captured_at, CASE WHEN whole THEN execution_count ELSE execution_count - pc END AS calls, CASE WHEN whole THEN total_time_ms ELSE total_time_ms - pt END AS time_ms, whole
FROM r WHERE CASE WHEN whole THEN execution_count ELSE execution_count - pc END > 0""")
def w07(spark, sf_dir):
    return windows.activity_windows(view(spark, sf_dir, "stmt"))


@query("w08_segment_by_gap", ctes("stmt") + f""", g AS (SELECT db_id, query_id, captured_at, CASE WHEN epoch(captured_at) - epoch(lag(captured_at) {LAG}) > 12 * 3600 THEN 1 ELSE 0 END AS gap FROM stmt)
SELECT db_id, query_id, captured_at, CAST(sum(gap) OVER (PARTITION BY db_id, query_id ORDER BY captured_at) AS BIGINT) AS segment FROM g""")
def w08(spark, sf_dir):
    return windows.segment_by_gap(view(spark, sf_dir, "stmt"), hours=12).select("db_id", "query_id", "captured_at", "segment")


define("server", ["stmt"], """
SELECT db_id, query_id, captured_at, CASE WHEN execution_count % 4 = 0 THEN cast(NULL AS timestamp) ELSE counters_epoch END AS server_start_time,
  CASE WHEN execution_count % 3 = 0 THEN captured_at - interval '20' minute END AS stats_reset_time FROM stmt""")


@query("w09_stats_fresh", ctes("server") + """
SELECT db_id, query_id, captured_at, coalesce(epoch(captured_at) - epoch(greatest(server_start_time, stats_reset_time)) < 1800, false) AS fresh FROM server""")
def w09(spark, sf_dir):
    return windows.stats_fresh(view(spark, sf_dir, "server")).select("db_id", "query_id", "captured_at", "fresh")


BY_DB = "OVER (PARTITION BY db_id ORDER BY at_s)"
CYCLE = f"""d AS (
  SELECT *, coalesce(deadlocks < lag(deadlocks) {BY_DB} OR epoch <> lag(epoch) {BY_DB}, false) AS reset, deadlocks - lag(deadlocks) {BY_DB} AS grown, at_s - lag(at_s) {BY_DB} AS seconds FROM cycle)"""
GROWTH = """l AS (
  SELECT db_id, at_s, CAST(sum(CASE WHEN b IS NULL OR log_bytes < b THEN log_bytes ELSE log_bytes - b END) AS BIGINT) AS grown_bytes
  FROM (SELECT *, lag(log_bytes) OVER (PARTITION BY db_id, log_file ORDER BY at_s) AS b FROM cycle) GROUP BY db_id, at_s)"""


@query("w10_counter_delta", ctes("cycle") + f", {CYCLE} SELECT db_id, at_s, CASE WHEN reset THEN deadlocks ELSE grown END AS delta, reset FROM d")
def w10(spark, sf_dir):
    return windows.counter_delta(view(spark, sf_dir, "cycle"), "deadlocks", "epoch", ["db_id"], "at_s").select("db_id", "at_s", "delta", "reset")


@query("w11_log_growth", ctes("cycle") + f", {GROWTH} SELECT * FROM l")
def w11(spark, sf_dir):
    return windows.log_growth(view(spark, sf_dir, "cycle"))


@query("w12_cycle_samples", ctes("cycle") + f""", {CYCLE}, {GROWTH}
SELECT db_id, at_s, CASE WHEN reset THEN deadlocks ELSE grown END AS delta, reset, seconds, grown_bytes, grown_bytes > 20000 AS overrun FROM d JOIN l USING (db_id, at_s)""")
def w12(spark, sf_dir):
    return windows.cycle_samples(view(spark, sf_dir, "cycle"), limit_bytes=20000)


@query("w13_eviction_delta", ctes("cycle") + f"""
SELECT * FROM (SELECT db_id, at_s, deadlocks AS evicted, deadlocks - lag(deadlocks) {BY_DB} AS evicted_since FROM cycle) WHERE evicted_since > 0""")
def w13(spark, sf_dir):
    return windows.eviction_delta(view(spark, sf_dir, "cycle").select("db_id", "at_s", F.col("deadlocks").alias("evicted")))


@query("w14_consecutive", ctes("ev") + """, x AS (SELECT DISTINCT db_id, s AS at_s FROM ev)
SELECT db_id, at_s, coalesce(at_s - lag(at_s) OVER (PARTITION BY db_id ORDER BY at_s) <= 60, false) AS follows FROM x""")
def w14(spark, sf_dir):
    samples = view(spark, sf_dir, "ev").select("db_id", F.col("s").alias("at_s"))
    return windows.consecutive(samples, ["db_id"], "at_s", 60)


TOP = "row_number() OVER (PARTITION BY db_id, captured_at ORDER BY total_time_ms DESC NULLS LAST, query_id)"
COV = "CASE WHEN mean_time_ms > 0 THEN (CASE WHEN execution_count > 1 AND max_time_ms <= 1000 * mean_time_ms THEN (max_time_ms - mean_time_ms) / sqrt(execution_count) END) / mean_time_ms END"


@query("c01_top_time", ctes("stmt") + f"SELECT db_id, captured_at, query_id, total_time_ms, r AS rank FROM (SELECT *, {TOP} AS r FROM stmt) WHERE r <= 3")
def c01(spark, sf_dir):
    return candidates.top_time(view(spark, sf_dir, "stmt"), k=3).select("db_id", "captured_at", "query_id", "total_time_ms", F.col("rank").cast("long").alias("rank"))


@query("c02_unstable", ctes("stmt_wide") + f"SELECT db_id, captured_at, query_id FROM (SELECT *, {COV} AS cov FROM stmt_wide) WHERE cov > 0.5 AND mean_time_ms > 10")
def c02(spark, sf_dir):
    return candidates.unstable(candidates.estimate_stddev(view(spark, sf_dir, "stmt_wide")), variation=0.5).select("db_id", "captured_at", "query_id")


@query("c03_spilling", ctes("stmt") + "SELECT db_id, captured_at, query_id FROM stmt WHERE coalesce(disk_spill_indicator, 0) > 0 OR coalesce(sort_merge_passes, 0) > 0")
def c03(spark, sf_dir):
    return candidates.spilling(view(spark, sf_dir, "stmt")).select("db_id", "captured_at", "query_id")


@query("c04_candidates", ctes("stmt_wide") + f""", w AS (SELECT *, {COV} AS cov, {TOP} AS r FROM stmt_wide), u AS (
  SELECT db_id, captured_at, query_id, 'total_time' AS reason FROM w WHERE r <= 2 UNION SELECT db_id, captured_at, query_id, 'unstable' FROM w WHERE cov > 2 AND mean_time_ms > 10
  UNION SELECT db_id, captured_at, query_id, 'spill' FROM w WHERE disk_spill_indicator > 0)
SELECT db_id, captured_at, query_id, string_agg(reason, ',' ORDER BY reason) AS reasons FROM u GROUP BY ALL""")
def c04(spark, sf_dir):
    found = candidates.candidates(candidates.estimate_stddev(view(spark, sf_dir, "stmt_wide")), k=2)
    return found.select("db_id", "captured_at", "query_id", F.array_join("selected_by", ",").alias("reasons"))


@query("c05_estimate_stddev", ctes("stmt_wide") + f"""
SELECT db_id, captured_at, query_id, CASE WHEN execution_count > 1 AND max_time_ms <= 1000 * mean_time_ms THEN (max_time_ms - mean_time_ms) / sqrt(execution_count) END AS stddev_time_ms, {COV} AS coeff_of_variation FROM stmt_wide""")
def c05(spark, sf_dir):
    return candidates.estimate_stddev(view(spark, sf_dir, "stmt_wide")).select("db_id", "captured_at", "query_id", "stddev_time_ms", "coeff_of_variation")


@query("c06_mark_ready", ctes("stmt") + """, e AS (SELECT DISTINCT db_id, query_id FROM stmt WHERE disk_spill_indicator > 100)
SELECT db_id, captured_at, query_id, e.query_id IS NOT NULL OR execution_count % 5 = 0 AS ready FROM stmt LEFT JOIN e USING (db_id, query_id)""")
def c06(spark, sf_dir):
    st = view(spark, sf_dir, "stmt")
    cands = st.withColumn("has_sample", F.col("execution_count") % 5 == 0)
    return candidates.mark_ready(cands, st.filter("disk_spill_indicator > 100")).select("db_id", "captured_at", "query_id", "ready")


D01 = """, b AS (SELECT *, quantile_cont(mean_ms, 0.5) OVER f AS baseline_ms, count(mean_ms) OVER f AS n FROM win WHERE calls >= 2
  WINDOW f AS (PARTITION BY db_id, query_id ORDER BY captured_at ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)), d AS (
  SELECT db_id, query_id, captured_at, calls, mean_ms, baseline_ms, (mean_ms - baseline_ms) * calls AS impact_ms FROM b WHERE n = 30 AND baseline_ms > 0 AND mean_ms >= 1.2 * baseline_ms AND mean_ms - baseline_ms >= 10)
SELECT *, CASE WHEN impact_ms >= 10000 THEN 'high' WHEN impact_ms >= 1000 THEN 'medium' ELSE 'low' END AS severity FROM d"""


@query("d01_baseline_degradation", ctes("stmt") + f", {DELTA}" + D01)
def d01(spark, sf_dir):
    return baseline.baseline_degradation(windows.delta_windows(view(spark, sf_dir, "stmt")), min_calls=2, baseline=30, ratio=1.2)
