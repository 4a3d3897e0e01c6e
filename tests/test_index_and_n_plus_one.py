"""AP-05 and AP-06 over schemas and repeated names, AP-08 on its own execution, interval sweeps and carried scans."""

import random

import pytest
from pyspark.sql import functions as F

from dbpulse.operators import antipatterns, carried, contention, health, n_plus_one, overhead, quality
from dbpulse.operators import index_rules as X

FACTS = "db_id string, schema_name string, table_name string, index_name string, method string, columns array<string>, is_unique boolean, is_partial boolean, index_scans long, last_index_scan string"


def facts(spark, rows):
    return spark.createDataFrame([("d", s, t, i, "btree", c.split(","), u, p, n, None) for s, t, i, c, u, p, n in rows], FACTS)


def ops(spark, rows):
    return spark.createDataFrame([("d", *r) for r in rows], "db_id string, query_id string, schema_name string, table_name string, access_method string, index_name string")


def traffic(spark, rows):
    return spark.createDataFrame([("d", *r) for r in rows], "db_id string, query_id string, schema_name string, table_name string, time_ms double, columns array<string>, scan boolean")


def fresh(spark, flag=False):
    return spark.createDataFrame([("d", flag)], "db_id string, fresh boolean")


def test_an_index_is_known_by_schema_and_table_too(spark):
    """An unused index stays a finding though another table, or schema, has a used one of that name."""
    made = facts(spark, [("s", "t1", "ix", "a", False, False, 0), ("s", "t2", "ix", "a", False, False, 0), ("z", "t2", "ix", "a", False, False, 0)])
    used = X.used_indexes(ops(spark, [("q", "s", "t2", "index_lookup", "ix")]), made)
    assert {tuple(r)[1:] for r in used.collect()} == {("s", "t2", "ix")}
    seen = X.with_reads(made, used)
    moved = traffic(spark, [("q1", "s", "t1", 5.0, ["a"], False), ("q2", "s", "t1", 1.0, ["b"], True), ("q3", None, "t2", 1.0, ["b"], True)])
    none = facts(spark, []).select(*X.INDEX)
    got = {(r.schema_name, r.table_name, r.query_id, r.severity) for r in X.unused_indexes(seen, none, none, moved, fresh(spark)).collect()}
    assert got == {("s", "t1", "q1", "high"), ("z", "t2", "q3", "low")}
    assert X.unused_indexes(seen, none, none, moved, fresh(spark, True)).count() == 0


def test_plans_of_unknown_or_other_schemas_count_for_all(spark):
    made = facts(spark, [("s", "t", "ix", "a", False, False, 0), ("z", "t", "ix", "a", False, False, 0)])
    for schema in (None, "elsewhere"):
        assert X.used_indexes(ops(spark, [("q", schema, "t", "index_lookup", "ix")]), made).count() == 2


def test_schema_is_taken_over_only_if_there_is_one_candidate(spark):
    left = spark.createDataFrame([("d", None, "t"), ("d", "s", "t"), ("d", "s", "u"), ("d", None, "u")], "db_id string, schema_name string, table_name string")
    right = spark.createDataFrame([("d", "s", "t"), ("d", "z", "t"), ("d", None, "u")], "db_id string, schema_name string, table_name string")
    got = {(r.schema_name, r.table_name): r["at"] for r in X.at_schema(left, right).collect()}
    assert got == {("s", "t"): "s", ("s", "u"): None, (None, "u"): None}


def test_copies_prefixes_partial_and_unread_indexes(spark):
    made = facts(spark, [
        ("s", "t", "a", "x", False, False, 2), ("s", "t", "a2", "x", False, False, 5), ("s", "t", "wide", "x,y", False, False, 0), ("s", "t", "uniq", "z", True, False, 0), ("s", "t", "z1", "z", False, False, 9),
        ("s", "t", "part", "x", False, True, 1), ("z", "t", "a", "x", False, False, 0), ("s", "quiet", "b", "x", False, False, 1), ("s", "quiet", "b2", "x", False, False, 1),
    ])
    moved = traffic(spark, [("q", "s", "t", 1.0, ["x"], False)])
    seen = X.with_reads(made, made.limit(0).select(*X.INDEX))
    run = lambda f: {r.index_name: (r.covered_by, r.kind, r.confidence) for r in X.redundant_indexes(seen, moved, fresh(spark, f)).collect()}
    # uniq was never read, so it covers z1 only while statistics are too fresh to tell
    assert run(False) == {"a": ("a2", "copy", "high")}
    assert run(True) == {"a": ("a2", "copy", "high"), "a2": ("wide", "prefix", "high"), "part": ("wide", "prefix", "low"), "z1": ("uniq", "copy", "high")}
    # a used index that another one covers weighs more, and dropping it is less sure
    cited = X.with_reads(made, made.filter("index_name = 'a'").select(*X.INDEX))
    assert [(r.severity, r.confidence) for r in X.redundant_indexes(cited, moved, fresh(spark)).collect()] == [("medium", "low")]


def test_foreign_key_keeper_by_schema_and_case(spark):
    made = facts(spark, [("s", "t", "narrow", "B,a", False, False, 0), ("s", "t", "wide", "a,b,c", False, False, 0), ("z", "t", "read", "a,b", False, False, 4), ("s", "t", "cover", "a,b", False, False, 0)])
    fks = spark.createDataFrame([("d", s, "T", "fk", c) for s in ("S", "z") for c in ("A", "B")], "db_id string, schema_name string, table_name string, constraint_name string, column_name string")
    seen = X.with_reads(made, made.limit(0).select(*X.INDEX))
    gone = seen.filter("index_name = 'cover'").select(*X.INDEX)
    assert [tuple(r) for r in X.fk_keepers(fks, seen, gone).collect()] == [("d", "s", "t", "fk", "narrow")]


WINDOW = "db_id string, query_id string, captured_at timestamp, window_start timestamp, is_new boolean, calls long, rows long, time_ms double"


def found(spark, windows, reads, equal, keys, **limits):
    made = spark.createDataFrame(windows, "db string, q string, at long, since long, calls long, rows long, ms double").select(
        F.col("db").alias("db_id"), F.col("q").alias("query_id"), F.timestamp_seconds("at").alias("captured_at"), F.timestamp_seconds("since").alias("window_start"), F.col("since").isNull().alias("is_new"), "calls", "rows", F.col("ms").alias("time_ms")
    )
    r = spark.createDataFrame(reads, "db_id string, query_id string, schema_name string, table_name string")
    e = spark.createDataFrame(equal, "db_id string, query_id string, schema_name string, table_name string, column_name string")
    k = spark.createDataFrame(keys, "db_id string, schema_name string, table_name string, constraint_name string, column_name string, referenced_schema string, referenced_table string, referenced_column string")
    return n_plus_one.n_plus_one(made, r, e, k, **limits)


def test_n_plus_one_in_both_directions_and_both_new(spark):
    fk = [(d, s, "orders", "fk", "cust", s, "customer", "id") for d, s in (("d", "s"), ("d", "z"), ("e", "s"))]
    reads = [("d", "list", "s", "customer"), ("d", "each", "s", "orders"), ("d", "orders", "s", "Orders"), ("d", "cust", "s", "customer"), ("e", "list", None, "customer")]
    equal = [("d", "each", "s", "orders", "CUST"), ("d", "cust", "s", "customer", "id"), ("e", "each", "s", "orders", "cust")]
    one = [("d", "list", 100, 50, 2, 100, 3.0), ("d", "each", 100, 50, 90, 90, 7.0)]
    got = found(spark, one, reads, equal, fk).collect()
    assert [(r.child_id, r.parent_id, r.direction, r.impact_ms, r.severity) for r in got] == [("each", "list", "one_to_many", 10.0, "medium")]
    # the parent reads the referencing table, the child the referenced one by its key
    many = [("d", "orders", 100, 50, 1, 600, None), ("d", "cust", 100, 50, 600, 600, 7.0)]
    got = found(spark, many, reads, equal, fk).collect()
    assert [(r.child_id, r.parent_id, r.direction, r.impact_ms, r.severity) for r in got] == [("cust", "orders", "many_to_one", 7.0, "high")]
    # windows must begin alike: both new, or at one snapshot
    new = lambda a, b: [("d", "list", 100, a, 2, 100, 3.0), ("d", "each", 100, b, 90, 90, 7.0)]
    assert [found(spark, new(a, b), reads, equal, fk).count() for a, b in ((None, None), (None, 50), (50, None), (50, 40))] == [1, 0, 0, 0]
    # another database, another schema
    assert found(spark, [("d", "list", 100, 50, 2, 100, 3.0), ("e", "each", 100, 50, 90, 90, 7.0)], reads, equal, fk).count() == 0
    assert found(spark, one, [("d", "list", "other", "customer")], equal, fk).count() == 0
    assert found(spark, one, [("d", "list", None, "customer")], equal, fk).count() == 1


def test_n_plus_one_band_loses_nothing(spark):
    """Calls and rows over four decades: the grid gives the pairs of the plain band."""
    r = random.Random(7)
    windows = [("d", f"p{i}", 100, 50, 1, r.randrange(2, 20_000), 1.0) for i in range(80)] + [("d", f"c{i}", 100, 50, r.randrange(1, 20_000), 1, 1.0) for i in range(80)]
    windows += [("d", "p90", 100, 50, 1, 1000, 1.0), ("d", "c90", 100, 50, 800, 1, 1.0), ("d", "c91", 100, 50, 1200, 1, 1.0), ("d", "c92", 100, 50, 799, 1, 1.0), ("d", "c93", 100, 50, 1201, 1, 1.0)]
    reads, equal = [("d", w[1], "s", "customer") for w in windows], [("d", w[1], "s", "orders", "cust") for w in windows if w[1][0] == "c"]
    fk = [("d", "s", "orders", "fk", "cust", "s", "customer", "id")]
    got = {r.child_id: r.parent_id for r in found(spark, windows, reads, equal, fk, calls=1).collect()}
    want = {}
    for c in windows:
        near = [(abs(c[4] - p[5]) / p[5], p[1]) for p in windows if c[1][0] == "c" and p[1] != c[1] and p[5] >= 2 * p[4]]
        if near and min(near)[0] <= 0.2:
            want[c[1]] = min(near)[1]
    assert got == want
    plan = found(spark, windows, reads, equal, fk)._jdf.queryExecution().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_misestimate_needs_the_rows_of_that_execution(spark):
    w = spark.createDataFrame([("d", "q", 1, 10, 5, 3.0), ("d", "r", 1, 10, 5, None)], "db_id string, query_id string, captured_at long, calls long, rows long, time_ms double")
    e = lambda *rows: spark.createDataFrame(rows, "db_id string, query_id string, captured_at long, estimated double, actual double, shape string")
    run = lambda *rows: [(r.query_id, r.q_error, r.direction, r.impact_ms) for r in antipatterns.misestimate(w, e(*rows)).collect()]
    assert run(("d", "q", 1, 5000.0, None, None), ("d", "r", 1, None, 9.0, None), ("d", "q", 2, 5000.0, 1.0, None)) == []
    assert run(("d", "q", 1, 0.0, 5000.0, None), ("d", "r", 1, 5000.0, 50.0, "aggregate")) == [("q", 5000.0, "under", 3.0)]


# ---- carried scans and interval sweeps ----------------------------------------------


def test_one_database_of_all_rows_lies_in_many_tasks(spark):
    r = random.Random(9)
    rows = [("d" if r.random() < 0.9 else None, t, r.choice([None, r.randrange(100)])) for t in r.sample(range(10**6), 3000)]
    made = spark.createDataFrame(rows, "db string, t long, v long")
    for own in (True, False):
        got = carried.carried(made, ["db"], ["t"], {"m": ("max", F.col("v")), "s": ("sum", F.col("v")), "l": ("last", F.col("v")), "p": ("last", F.struct("t"))}, own=own, partitions=7)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which joins such small partitions again
        assert got.filter("db = 'd'").select(F.spark_partition_id().alias("k")).distinct().count() > 1
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        have = {(x.db, x.t): (x.m, x.s, x.l, x.p and x.p.t) for x in got.collect()}
        held = {}
        for db, t, v in sorted(rows, key=lambda x: x[1]):
            before = held.setdefault(db, [])
            if own:
                before.append((t, v))
            known = [b for _, b in before if b is not None]
            assert have[db, t] == (max(known, default=None), sum(known) if known else None, known[-1] if known else None, before[-1][0] if before else None)
            if not own:
                before.append((t, v))
    assert carried.with_previous(made.limit(0), ["db"], ["t"], ["v"]).count() == 0


@pytest.mark.parametrize("by", [None, ["x"]])
def test_interval_sweeps_are_brute_force(spark, by):
    r = random.Random(10)
    samples = [(i, r.randrange(3), t, t + r.randrange(1, 40)) for i, t in enumerate(r.choices(range(2000), k=400))]
    cycles = [(r.randrange(3), c, c + r.randrange(0, 60)) for c in r.choices(range(2000), k=40)]
    s, c = spark.createDataFrame(samples, "event_id long, x int, t0 long, t1 long"), spark.createDataFrame(cycles, "x int, c0 long, c1 long")
    got = {x.event_id: x.overlaps for x in overhead.overlaps(s, c, by).collect()}
    assert got == {i: any((not by or x == k) and t0 < c1 and c0 < t1 for k, c0, c1 in cycles if c0 < c1) for i, x, t0, t1 in samples}
    blocks = [(k, d, 100 * d, 100 * d + 80) for k in range(3) for d in range(20)] if by else [(0, d, 100 * d, 100 * d + 80) for d in range(20)]
    b = spark.createDataFrame(blocks, "x int, day_no long, start_us long, end_us long").withColumn("pair", F.lit(1)).withColumn("side", F.lit(0))
    inside = overhead.in_block(s, b if by else b.drop("x"), 10, by)
    assert sorted((x.event_id, x.day_no) for x in inside.collect()) == sorted((i, d) for i, x, t0, t1 in samples for k, d, a, e in blocks if (not by or x == k) and t0 >= a + 10 and t1 <= e)
    plan = overhead.overlaps(s, c, by)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_overlapping_blocks_are_refused(spark):
    b = spark.createDataFrame([(0, 0, 100, 1, 0), (1, 50, 150, 1, 1)], "day_no long, start_us long, end_us long, pair int, side int")
    with pytest.raises(ValueError):
        overhead.in_block(spark.createDataFrame([(1, 5, 6)], "event_id long, t0 long, t1 long"), b)


def test_as_of_joins_carry_over_ranges(spark):
    """The newest header, the last cycle and the flag reach over the ranges' borders."""
    headers = spark.createDataFrame([("d", 0), ("d", 5000)], "db_id string, h_s long")
    reports = spark.createDataFrame([("d", t, t) for t in range(1, 4000)], "db_id string, r_s long, report_id long")
    got = {r.report_id: r.h_s for r in contention.merge_headers(headers, reports, 10**6).collect()}
    assert got == {None: 5000, **{t: 0 for t in range(1, 4000)}}
    cycles = spark.createDataFrame([("d", 1, 0, 2000)], "db_id string, cycle_id long, c0 long, c1 long")
    rows = quality.finding_cycle(reports.select("db_id", F.col("r_s").alias("s"), F.col("report_id").alias("detection_id")), cycles).collect()
    assert all(r.cycle_id == 1 and r.inside == (r.detection_id <= 2000) for r in rows) and len(rows) == 3999
    sizes = spark.createDataFrame([("d", 0, 99)] + [("d", t, 50) for t in range(1, 4000)], "db_id string, at_s long, bytes long")
    assert {r.flag for r in health.payload_flag(sizes, 90, 10).collect()} == {True}
