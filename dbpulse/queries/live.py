"""Queries of streaming jobs T01-T10, run over all that is there (availableNow)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.fixtures import ctes, define, view
from ..streaming import jobs
from . import query
from .counters import DELTA


def events(spark, sf_dir):
    """The event table as a stream, with the time as a timestamp for watermarks."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = jobs.stream_snapshots(spark, f"{sf_dir}/events.parque[t]", schema)  # a pattern may name a file or a folder
    db = F.concat(F.lit("db"), F.floor(F.col("user_id") / 10).cast("string"))
    return stream.withColumn("at", F.col("ts").cast("timestamp")).withColumn("db_id", db)


def in_parts(spark, df, folder, job, parts=2):
    """A table that lands in ``parts`` shares in time order; after each the job runs on and ends, as a restarted stream does."""
    edges, low = df.agg(F.percentile_approx("at_s", [(i + 1) / parts for i in range(parts)])).first()[0], None
    for high in edges:
        part = df.filter(F.col("at_s") <= high) if low is None else df.filter((F.col("at_s") > low) & (F.col("at_s") <= high))
        part.write.mode("append").parquet(f"{folder}/in")
        saved, low = jobs.run_now(job(jobs.stream_snapshots(spark, f"{folder}/in", df.schema, files_per_batch=10_000)), folder), high
    return saved.drop("batch_id")


def landed_in_batches(spark, df, batch, folder):
    """A table written as one file for each value of ``batch``, in that order, one file a micro-batch."""
    for (number,) in sorted(df.select(batch).distinct().collect()):  # a few batches
        df.filter(F.col(batch) == number).drop(batch).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return jobs.stream_snapshots(spark, f"{folder}/in", df.drop(batch).schema, files_per_batch=1)


@query("t01_stream_source", " SELECT event_id, user_id, event_type FROM events")
def t01(spark, sf_dir):
    stream = events(spark, sf_dir).select("event_id", "user_id", "event_type")
    return jobs.run_now(stream, jobs.work_folder(spark)).drop("batch_id")


@query("t02_dedup", " SELECT event_id, user_id FROM events")
def t02(spark, sf_dir):
    twice = events(spark, sf_dir).select("event_id", "user_id", "at").withColumn("again", F.explode(F.array(F.lit(1), F.lit(2))))
    return jobs.run_now(jobs.dedup_stream(twice, ["event_id"], "at").select("event_id", "user_id"), jobs.work_folder(spark)).drop("batch_id")


# a tenth of a database's events is sent twelve days late, the rest on its day; arrivals come in batches of three days
define("arrival", ["ev"], "SELECT db_id, event_id, s, ts, cast(floor((s - (SELECT min(s) FROM ev)) / 259200) AS bigint) + CASE WHEN k % 10 = 0 THEN 4 ELSE 0 END AS batch FROM ev")


@query("t03_late_policy", ctes("arrival") + """, m AS (SELECT batch, max(s) AS newest FROM arrival GROUP BY 1), w AS (SELECT a.batch, max(b.newest) - 86400 AS mark FROM m a LEFT JOIN m b ON b.batch <= a.batch - 2 GROUP BY 1)
SELECT db_id, count(*) AS arrived, count(*) FILTER (mark IS NULL OR (s // 21600 + 1) * 21600 > mark) AS counted, count(*) FILTER (mark IS NOT NULL AND (s // 21600 + 1) * 21600 <= mark) AS late FROM arrival JOIN w USING (batch) GROUP BY 1""")
def t03(spark, sf_dir):
    """A window is closed for a batch by the newest time of the batches up to the one before the last."""
    rows = view(spark, sf_dir, "arrival").select("db_id", "event_id", F.col("ts").cast("timestamp").alias("at"), "batch")
    folder = jobs.work_folder(spark)
    stream = landed_in_batches(spark, rows, "batch", folder)
    kept = jobs.late_policy(stream, "at", "1 day")
    windows = kept.groupBy(F.window("at", "6 hours").alias("w"), "db_id").agg(F.count("*").alias("n")).select("db_id", F.unix_seconds("w.start").alias("bucket_s"), "n")
    counted = jobs.fold_latest(jobs.run_now(windows, folder, "update"), ["db_id", "bucket_s"])
    arrived = jobs.run_now(stream.select("db_id", F.lit(1).cast("long").alias("n")), jobs.work_folder(spark))
    return jobs.late_rows(arrived, counted, "db_id")


@query("t04_stream_baseline", ctes("stmt") + f""", {DELTA}, b AS (SELECT *, quantile_cont(mean_ms, 0.5) OVER f AS baseline_ms, count(mean_ms) OVER f AS n FROM win WHERE calls >= 2
  WINDOW f AS (PARTITION BY db_id, query_id ORDER BY captured_at ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING))
SELECT db_id, query_id, epoch(captured_at)::BIGINT AS at_s, calls AS n, mean_ms, baseline_ms FROM b WHERE n = 30 AND baseline_ms > 0 AND mean_ms >= 1.2 * baseline_ms AND mean_ms - baseline_ms >= 10""")
def t04(spark, sf_dir):
    st = view(spark, sf_dir, "stmt")
    flat = st.select("db_id", "query_id", F.unix_seconds(F.col("captured_at").cast("timestamp")).alias("at_s"), F.col("execution_count").alias("calls"), F.col("total_time_ms").alias("time_ms"), F.unix_seconds(F.col("counters_epoch").cast("timestamp")).alias("epoch_s"))
    return in_parts(spark, flat, jobs.work_folder(spark), lambda stream: jobs.stream_baseline(stream, min_calls=2, baseline=30, ratio=1.2, keep_hours=10_000))


@query("t05_stream_cascade", ctes("root_sample") + """, p AS (SELECT db_id, at_s, lag(at_s) OVER (PARTITION BY db_id ORDER BY at_s) AS before_s FROM (SELECT DISTINCT db_id, at_s FROM root_sample)),
f AS (SELECT * FROM root_sample JOIN p USING (db_id, at_s) WHERE at_s - tx_start_s >= 30 AND n_blocked >= 2 AND min_wait_s >= 5),
a AS (SELECT *, coalesce(lag(at_s) OVER w = before_s AND at_s - before_s <= 3600, false) AS again FROM f WINDOW w AS (PARTITION BY db_id, pid, tx_start_s ORDER BY at_s))
SELECT db_id, pid, tx_start_s, at_s, CAST(total_wait_s AS BIGINT) AS impact_s FROM a WHERE again QUALIFY row_number() OVER (PARTITION BY db_id, pid, tx_start_s ORDER BY at_s) = 1""")
def t05(spark, sf_dir):
    roots = view(spark, sf_dir, "root_sample").select("db_id", "at_s", "pid", "tx_start_s", "n_blocked", "min_wait_s", F.col("total_wait_s").cast("long").alias("total_wait_s"))
    return in_parts(spark, roots, jobs.work_folder(spark), lambda stream: jobs.stream_cascade(stream, gap_s=3600))


@query("t06_stream_deadlocks", ctes("ev") + """, g AS (SELECT db_id, event_type AS signature, event_id AS report_id, s, CASE WHEN s - lag(s) OVER w > 3600 * 24 THEN 1 ELSE 0 END AS gap FROM ev WHERE value > 200 WINDOW w AS (PARTITION BY db_id, event_type ORDER BY s, event_id)),
r AS (SELECT *, sum(gap) OVER (PARTITION BY db_id, signature ORDER BY s, report_id ROWS UNBOUNDED PRECEDING) AS run FROM g)
SELECT db_id, signature, report_id, row_number() OVER (PARTITION BY db_id, signature, run ORDER BY s, report_id) AS occurrence FROM r""")
def t06(spark, sf_dir):
    ev = view(spark, sf_dir, "ev").filter("value > 200")
    rows = ev.select("db_id", F.col("event_type").alias("signature"), F.col("event_id").alias("report_id"), F.col("s").alias("at_s"), F.col("ts").cast("timestamp").alias("at"))
    return in_parts(spark, rows, jobs.work_folder(spark), lambda stream: jobs.stream_deadlocks(stream, "at", "10 minutes", days=1))


@query("t07_stream_evaluation", ctes("evaluation") + " SELECT db_id, code, state, bucket_s, count(*) AS n FROM evaluation GROUP BY ALL")
def t07(spark, sf_dir):
    state = F.when(F.col("value") < 60, "evaluated").when(F.col("value") < 150, "partial").otherwise("not_evaluated")
    stream = events(spark, sf_dir).select("db_id", F.col("event_type").alias("code"), state.alias("state"), "at")
    return jobs.fold_latest(jobs.run_now(jobs.stream_evaluation(stream, "at", "60 days"), jobs.work_folder(spark), "update"), ["db_id", "code", "state", "bucket_s"])


@query("t08_lookback", ctes("ev") + " SELECT db_id, CAST(c AS BIGINT) AS cycle_s, count(*) AS n FROM ev, LATERAL (SELECT unnest([floor(s / 1800) * 1800 + 1800, floor(s / 1800) * 1800 + 3600]) AS c) GROUP BY 1, 2")
def t08(spark, sf_dir):
    seen = jobs.lookback(events(spark, sf_dir), "at", "60 minutes", "30 minutes", "60 days")
    return jobs.fold_latest(jobs.run_now(seen, jobs.work_folder(spark), "update"), ["db_id", "cycle_s"])


@query("t09_sessions", """WITH e AS (SELECT 'db' || CAST(floor(user_id / 10) AS BIGINT) AS db_id, epoch_us(ts) AS u FROM events), g AS (SELECT *, CASE WHEN u - lag(u) OVER (PARTITION BY db_id ORDER BY u) >= 1200000000 THEN 1 ELSE 0 END AS gap FROM e),
r AS (SELECT *, sum(gap) OVER (PARTITION BY db_id ORDER BY u) AS run FROM g) SELECT db_id, min(u) // 1000000 AS start_s, (max(u) + 1200000000) // 1000000 AS end_s, count(*) AS n FROM r GROUP BY db_id, run""")
def t09(spark, sf_dir):
    found = jobs.sessions(events(spark, sf_dir), "at", "20 minutes", "60 days")
    saved = jobs.run_now(found, jobs.work_folder(spark), "complete")
    last = saved.agg(F.max("batch_id").alias("b"))
    return saved.join(F.broadcast(last), saved.batch_id == last.b).drop("batch_id", "b")  # one row


@query("t10_findings_sink", ctes("detection") + " SELECT db_id, rule, finding_key, count(*) AS n, min(s) AS first_s, max(s) AS last_s, arg_max(detection_id, (s, detection_id)) AS last_id, arg_max(severity, (s, detection_id)) AS severity FROM detection GROUP BY 1, 2, 3")
def t10(spark, sf_dir):
    severity = F.when(F.col("value") >= 200, "high").when(F.col("value") >= 80, "medium").otherwise("low")
    key = F.concat_ws("/", "event_type", (F.col("user_id") % 20).cast("string"))
    found = events(spark, sf_dir).select("db_id", F.col("event_type").alias("rule"), key.alias("finding_key"), F.col("event_id").alias("detection_id"), F.unix_seconds("at").alias("at_s"), severity.alias("severity"))
    folder = jobs.work_folder(spark)
    jobs.sink_findings(found, folder)
    return jobs.read_table(spark, folder, jobs.PROBLEM)
