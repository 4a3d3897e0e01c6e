"""Typed state that expires, and a findings table that only rewrites what a batch touches."""

import os

from pyspark.sql import functions as F

from dbpulse.streaming import jobs

STATEMENT = "db_id string, query_id string, at_s long, calls long, time_ms double, epoch_s long"
DETECTION = "db_id string, rule string, finding_key string, detection_id long, at_s long, severity string"
HOUR = 3600


def land(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{folder}/in")
    return jobs.stream_snapshots(spark, f"{folder}/in", spark.createDataFrame([], schema).schema)


def test_state_goes_when_the_watermark_has_passed_it(spark):
    """The state reader sees a silent fingerprint's state until its timer, and none after."""
    folder = jobs.work_folder(spark)
    made = lambda rows: jobs.run_now(jobs.stream_baseline(land(spark, folder, rows, STATEMENT), min_calls=1, baseline=3, keep_hours=24), folder)
    made([("d", "quiet", k * HOUR, 10 * k, 100.0 * k, 0) for k in range(1, 5)] + [("d", "busy", k * HOUR, 10 * k, 100.0 * k, 0) for k in range(1, 5)])
    kept = lambda: {r.key.query_id for r in spark.read.format("statestore").option("stateVarName", "last").load(f"{folder}/state").collect()}
    store = spark.conf.get(jobs.STATE_STORE[0])
    spark.conf.set(*jobs.STATE_STORE)
    try:
        assert kept() == {"quiet", "busy"}
        made([("d", "busy", 60 * HOUR, 50, 600.0, 0)])
        made([("d", "busy", 61 * HOUR, 60, 700.0, 0)])
        assert kept() == {"busy"}
        means = spark.read.format("statestore").option("stateVarName", "means").load(f"{folder}/state").collect()
        assert {r.key.query_id for r in means} <= {"busy"}
    finally:
        spark.conf.set(jobs.STATE_STORE[0], store)


def fold_of(rows):
    out = {}
    for db, rule, key, i, at, severity in rows:
        n, first, last = out.get((db, rule, key), (0, at, (-1, -1, "")))
        out[db, rule, key] = (n + 1, min(first, at), max(last, (at, i, severity)))
    return {k: (n, first, *last) for k, (n, first, last) in out.items()}


def table_of(spark, folder):
    return {(r.db_id, r.rule, r.finding_key): (r.n, r.first_s, r.last_s, r.last_id, r.severity) for r in jobs.read_table(spark, folder, jobs.PROBLEM).collect()}


def test_findings_are_upserted_batch_by_batch(spark):
    folder = jobs.work_folder(spark)
    parts = [[("d", "AP-01", f"k{i % 7}", 100 * b + i, 1000 * b + i, "high" if i % 2 else "low") for i in range(20)] for b in range(3)]
    for part in parts:
        jobs.sink_findings(land(spark, folder, part, DETECTION), folder, buckets=4)
    assert table_of(spark, folder) == fold_of([r for p in parts for r in p])
    assert spark.read.parquet(f"{folder}/detections").count() == 60


def test_a_batch_that_runs_again_changes_nothing(spark):
    folder, key = jobs.work_folder(spark), ["finding_key"]
    add = lambda old, new: old.unionByName(new).groupBy("finding_key").agg(F.sum("n").alias("n"))
    batch = lambda *rows: spark.createDataFrame(rows, "finding_key string, n long")
    read = lambda: {r.finding_key: r.n for r in jobs.read_table(spark, folder, "finding_key string, n long").collect()}
    jobs.upsert(batch(("a", 1), ("b", 1)), 0, folder, key, add)
    jobs.upsert(batch(("a", 5)), 1, folder, key, add)
    for _ in range(2):
        jobs.upsert(batch(("a", 5)), 1, folder, key, add)
    assert read() == {"a": 6, "b": 1}
    # broken off after the table was written, before the log: the rows themselves know
    log = f"{folder}/log".removeprefix("file:")
    os.rename(log, f"{log}-lost")
    jobs.upsert(batch(("a", 5)), 1, folder, key, add)
    assert read() == {"a": 6, "b": 1}
    jobs.upsert(batch(), 2, folder, key, add)
    assert read() == {"a": 6, "b": 1}


def test_only_touched_buckets_are_rewritten(spark):
    folder, key = jobs.work_folder(spark), ["finding_key"]
    keep = lambda old, new: new
    every = spark.range(200).select(F.concat(F.lit("k"), "id").alias("finding_key"), F.lit(1).cast("long").alias("n"))
    jobs.upsert(every, 0, folder, key, keep, buckets=16)
    files = lambda: {os.path.join(d, f) for d, _, names in os.walk(f"{folder}/table".removeprefix("file:")) for f in names if f.endswith(".parquet")}
    before = files()
    jobs.upsert(spark.createDataFrame([("k7", 9)], "finding_key string, n long"), 1, folder, key, keep, buckets=16)
    after = files()
    assert len(before - after) == len(after - before) == 1 and len(before) == 16
    got = {r.finding_key: r.n for r in jobs.read_table(spark, folder, "finding_key string, n long").collect()}
    assert got["k7"] == 9 and len(got) == 200
