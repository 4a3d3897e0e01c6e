"""Sections over JDBC with a driver that comes with Spark, and whole snapshots."""

import json

from pyspark.sql import functions as F

from dbpulse.functions import text as T
from dbpulse.operators import health
from dbpulse.sources import scans


def test_sections_over_jdbc_one_partition_a_database(spark):
    """An embedded Derby stands for the vendor: one section is refused and becomes an issue, the rest is read."""
    url, driver = "jdbc:derby:memory:stats;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    rows = spark.createDataFrame([("db'1", "q1", 5), ("db'1", "q2", 7), ("db2", "q1", 9), ("db3", "q9", 1)], "db_id string, query_id string, calls long")
    rows.write.option("createTableColumnTypes", "db_id VARCHAR(40), query_id VARCHAR(40)").jdbc(url, "stat", "overwrite", {"driver": driver})
    queries = {
        "statements": ('SELECT "db_id" AS db_id, "query_id" AS query_id, "calls" AS calls FROM stat', "db_id string, query_id string, calls long"),
        "locks": ("SELECT * FROM missing_view", "db_id string, process_id long"),
    }
    found, issues = scans.pull_sections(spark, url, queries, ["db'1", "db2"], driver=driver)
    assert sorted(tuple(r) for r in found["statements"].collect()) == [("db'1", "q1", 5), ("db'1", "q2", 7), ("db2", "q1", 9)]
    assert found["statements"].rdd.getNumPartitions() == 2
    assert found["locks"].columns == ["db_id", "process_id"] and found["locks"].count() == 0
    assert [(r.section, r.code) for r in issues.collect()] == [("locks", "SECTION_UNREAD")]


def test_snapshots_keep_what_rules_need(spark):
    lock = {"mode": "X", "scope": "row", "table_name": "t", "index_name": "ix", "targets": ["1:2:3"]}
    body = {name: [] for name in scans.MANDATORY} | {
        "db_id": "d", "statements": [{"query_id": 1, "execution_count": 3, "rows_returned": 4, "total_time_ms": 2.5, "disk_spill_indicator": 1, "counters_epoch": "2024-01-01T02:00:00+02:00"}, {"query_id": "1", "execution_count": 2, "rows_returned": 1}, {"query_id": "2"}],
        "deadlocks": [{"complete": True, "transactions": [{"process_id": 1, "blocked_by": [2], "waits_for": lock, "holds": [lock]}]}],
    }
    raw = spark.createDataFrame([(1, "d", 5, json.dumps(body)), (2, "d", 5, json.dumps(body)), (3, "d", 6, json.dumps(body | {"locks": None})), (4, "d", 7, json.dumps(body | {"tables": {}})), (5, "d", 8, "{")], "msg_id long, db_id string, captured_at long, payload string")
    got = scans.ingest_snapshots(raw)
    counters = {(r.captured_at, r.query_id): (r.execution_count, r.rows_returned, r.total_time_ms, r.disk_spill_indicator, str(r.counters_epoch)) for r in scans.statement_counters(got["statements"]).collect()}
    assert counters == {(at, "1"): (5, 5, 2.5, 1, "2024-01-01 00:00:00") for at in (5, 6)}
    member = got["deadlocks"].first().transactions[0]
    assert (member.blocked_by, member.waits_for.index_name, member.holds[0].targets) == ([2], "ix", ["1:2:3"])
    issues = {(r.msg_id, r.section, r.code) for r in scans.section_issues(raw).collect()}
    assert issues == {(3, "locks", "SECTION_UNREAD"), (4, "tables", "SECTION_MISTYPED"), (5, "", "PAYLOAD_UNREADABLE")}


def test_versions_at_the_borders(spark):
    rows = spark.createDataFrame([(n, "postgres", n) for n in (149999, 150000, 159999, 160000, 169999, 170000)] + [(1, "mysql", 80000), (2, "postgres", None), (3, None, 150000)], "db_id long, engine string, version_num long")
    got = {r.db_id: (r.code, r.missing.count(",") + bool(r.missing)) for r in health.version_issues(rows).collect()}
    assert got == {149999: ("PG_VERSION_UNSUPPORTED", 0), 150000: ("PG_VERSION_LIMITED", 3), 159999: ("PG_VERSION_LIMITED", 3), 160000: ("PG_VERSION_LIMITED", 1), 169999: ("PG_VERSION_LIMITED", 1)}
    ended = [("postgres", "old feature", 0, 160000)]
    assert {r.db_id: r.missing for r in health.version_issues(rows, ended).collect()}[160000] == "old feature"


def test_contention_graph_of_odd_evidence(spark):
    rows = [
        (1, json.dumps({"transactions": [{"process_id": 7, "victim": True, "blocked_by": [8, 8], "waits_for": {"schema_name": "s", "table_name": "t"}, "holds": None}, {"process_id": None, "blocked_by": [7]}, {"process_id": 8, "blocked_by": None, "waits_for": {"targets": ["a", "b"]}, "holds": [{"targets": ["a"]}]}]})),
        (2, json.dumps({"root": {"process_id": 1}, "blocked_sessions": [{"process_id": 2, "blocking_pids": [1]}, {"process_id": 3, "blocking_pids": [2, 1]}]})), (3, "no json"), (4, None), (5, json.dumps({"transactions": 7, "root": []})), (6, json.dumps({"root": {"process_id": 9}})),
    ]
    nodes, edges = T.contention_graph(spark.createDataFrame(rows, "detection_id long, evidence string"))
    assert {tuple(r) for r in edges.collect()} == {
        (1, "session 7", "session 8", "blocked by"), (1, "session 7", "s.t", "waits for"), (1, "session 8", "a", "waits for"), (1, "session 8", "b", "waits for"), (1, "a", "session 8", "held by"),
        (2, "session 2", "session 1", "blocked by"), (2, "session 3", "session 2", "blocked by"), (2, "session 3", "session 1", "blocked by"),
    }
    tags = {(r.detection_id, r.node): r.tag for r in nodes.filter(F.col("tag") != "").collect()}
    assert tags == {(1, "session 7"): "victim", (2, "session 1"): "root", (6, "session 9"): "root"} and nodes.count() == 9
