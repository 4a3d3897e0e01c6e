"""Thresholds at the limit and one step under it, nulls, and results that do not hang on order."""

import datetime as dt
import random

from pyspark.sql import functions as F

from dbpulse.functions import text as T
from dbpulse.operators import antipatterns, baseline, candidates, contention, health, quality, reports, windows
from dbpulse.plans.flatten import and_conditions, fix_leaves, flatten_pg_plan, usable_tree
from dbpulse.streaming import jobs

AT = dt.datetime(2024, 1, 1)


def windows_of(spark, means, calls=10):
    rows = [("db", "q", AT + dt.timedelta(minutes=i), calls, float(m)) for i, m in enumerate(means)]
    return spark.createDataFrame(rows, "db_id string, query_id string, captured_at timestamp_ntz, calls long, mean_ms double")


def test_degradation_at_and_under_the_ratio(spark):
    find = lambda last, **k: baseline.baseline_degradation(windows_of(spark, [10.0] * 60 + [last]), **k).count()
    assert find(20.0) == 1
    assert find(19.9) == 0
    assert find(20.0, plus_ms=10.1) == 0


def test_degradation_needs_a_full_baseline_and_enough_calls(spark):
    assert baseline.baseline_degradation(windows_of(spark, [10.0] * 59 + [50.0])).count() == 0
    assert baseline.baseline_degradation(windows_of(spark, [10.0] * 60 + [50.0], calls=4)).count() == 0


def test_degradation_does_not_hang_on_row_order(spark):
    df = windows_of(spark, [10.0] * 60 + [25.0, 10.0, 30.0])
    rows = df.collect()
    random.Random(1).shuffle(rows)
    key = lambda d: sorted(map(tuple, baseline.baseline_degradation(d).collect()))
    assert key(df) == key(spark.createDataFrame(rows, df.schema).repartition(3))


def samples(spark, rows):
    schema = "db_id string, query_id string, captured_at timestamp_ntz, execution_count long, total_time_ms double, rows_returned long, disk_spill_indicator long, sort_merge_passes long, counters_epoch timestamp_ntz"
    return spark.createDataFrame([("db", "q", AT + dt.timedelta(hours=i), *r) for i, r in enumerate(rows)], schema)


def test_reset_gives_no_window_but_moves_the_state(spark):
    st = samples(spark, [(10, 100.0, 1, 0, None, AT), (4, 40.0, 1, 0, None, AT + dt.timedelta(hours=1)), (6, 80.0, 1, 0, None, AT + dt.timedelta(hours=1))])
    got = [(r.calls, r.time_ms) for r in windows.delta_windows(st).orderBy("captured_at").collect()]
    assert got == [(None, None), (None, None), (2, 40.0)]


def test_idle_sample_is_skipped_and_an_unknown_epoch_survives(spark):
    st = samples(spark, [(10, 100.0, 1, 0, None, AT), (10, 100.0, 1, 0, None, None), (12, 130.0, 1, 0, None, AT)])
    got = windows.drop_idle(st).orderBy("captured_at").collect()
    assert [r.execution_count for r in got] == [10, 12]
    assert windows.delta_windows(windows.drop_idle(st)).filter("calls = 2").count() == 1


def test_counter_merge_keeps_null_only_if_all_are_null(spark):
    st = samples(spark, [(1, None, 1, None, None, AT)]).withColumn("part", F.lit(0))
    both = st.unionByName(st.withColumn("part", F.lit(1)).withColumn("disk_spill_indicator", F.lit(3).cast("long")))
    row = windows.merge_counters(both).first()
    assert (row.execution_count, row.total_time_ms, row.disk_spill_indicator) == (2, None, 3)


def test_candidates_of_a_statement_are_one_row(spark):
    st = samples(spark, [(10, 900.0, 1, 5, None, AT)]).withColumn("coeff_of_variation", F.lit(3.0)).withColumn("mean_time_ms", F.lit(90.0))
    assert candidates.candidates(st).first().selected_by == ["spill", "total_time", "unstable"]


def test_spill_kinds(spark):
    rows = [("q1", 1, 0), ("q2", 0, 2), ("q3", 1, 1), ("q4", 0, None)]
    df = spark.createDataFrame([(q, 5000.0, s, m) for q, s, m in rows], "query_id string, time_ms double, spill long, merges long")
    assert {r.query_id: r.kind for r in antipatterns.disk_spill(df).collect()} == {"q1": "temporary data", "q2": "sort", "q3": "temporary table and sort"}


def test_priority_is_a_total_order(spark):
    rows = [("a", None, "high", "r"), ("b", 5.0, "low", "r"), ("c", 5.0, "high", "r"), ("d", 0.0, "high", "a"), ("e", None, "high", None)]
    df = spark.createDataFrame(rows, "finding_key string, impact_ms double, severity string, rule string")
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        got = [r.finding_key for r in baseline.prioritize(spark.createDataFrame(rows, df.schema)).collect()]
        assert got == ["c", "b", "d", "a", "e"]


def test_condition_tree_and_needs_one_or_needs_all(spark):
    def tree(kind, a, b):
        rows = [(1, 0, -1, 0, kind, None), (1, 1, 0, 1, "leaf", a), (1, 2, 0, 1, "leaf", b)]
        df = spark.createDataFrame(rows, "tree int, node_id int, parent_id int, level int, kind string, state string")
        return tuple(usable_tree(df).first())[1:]

    assert tree("and", "OK", "OTHER") == (True, False)
    assert tree("or", "OK", "OTHER") == (False, False)
    assert tree("or", "OK", "FIX") == (False, True)


def test_texts(spark):
    one = lambda expr: spark.range(1).select(expr.alias("x")).first().x
    assert one(T.canonical_text(F.lit("SELECT 'a--b', 5 -- c\nFROM t"))) == "SELECT $1, $2 FROM t"
    assert one(T.canonical_text(F.lit(None).cast("string"))) == "Not available"
    assert one(T.mask_sql(F.lit("SELECT 'open"))) is None
    assert one(T.is_explainable(F.lit("(SELECT 1)"))) is True
    assert one(T.is_explainable(F.lit("SELECT 1 FOR UPDATE"))) is False
    assert one(T.redact_predicate(F.lit("(a = $3) AND (b = 7)"))) == "(a = $3) AND (b = $4)"
    assert one(and_conditions(F.lit(None).cast("string"), F.lit("x"))) == "x"


def test_long_text_needs_no_deep_stack(spark):
    text = "SELECT '" + "x''" * 200_000 + "'"
    assert spark.range(1).select(T.mask_sql(F.lit(text)).alias("x")).first().x == "SELECT ''"


def test_wait_cycle_ends(spark):
    edges = spark.createDataFrame([("db", 2, 1), ("db", 3, 2), ("db", 2, 3)], "db_id string, waiter long, blocker long")
    assert sorted((r.root, r.member, r.depth) for r in contention.blocked_under(edges).collect()) == [(1, 2, 1), (1, 3, 2)]


def test_cascade_is_told_once_on_the_second_sample(spark):
    rows = [("db", t, 7, 0, 2, 5, 10) for t in (60, 120, 180)]
    df = spark.createDataFrame(rows, "db_id string, at_s long, pid long, tx_start_s long, n_blocked long, min_wait_s long, total_wait_s long")
    assert [r.at_s for r in contention.long_tx_cascade(df).collect()] == [120]
    assert contention.long_tx_cascade(df.filter("at_s != 120")).count() == 0  # 120 s apart


def test_issue_reopens_as_a_new_row(spark):
    runs = spark.createDataFrame([("db", n, "locks", n * 10) for n in range(1, 6)], "db_id string, run_no long, section string, at_s long")
    seen = spark.createDataFrame([("db", n, "c", "locks", "error", n * 10) for n in (1, 2, 5)], "db_id string, run_no long, code string, section string, severity string, s long")
    got = sorted((r.opened_s, r.last_s, r.closed_s) for r in health.issue_intervals(seen, runs).collect())
    assert got == [(10, 20, 30), (50, 50, None)]


def test_wilson_stays_in_bounds(spark):
    df = spark.createDataFrame([(0.0, 10.0), (10.0, 10.0), (0.0, 0.0)], "k double, n double")
    low, high = quality.wilson(F.col("k"), F.col("n"))
    got = [tuple(r) for r in df.select(low.alias("l"), high.alias("h")).collect()]
    assert 0 <= got[0][0] < 1e-9 and 0.27 < got[0][1] < 0.28
    assert 0.72 < got[1][0] < 0.73 and 1 - 1e-9 < got[1][1] <= 1.0
    assert got[2] == (None, None)


def test_empty_findings_give_empty_reports(spark):
    none = spark.createDataFrame([], "db_id string, rule string, finding_key string, detected_at timestamp_ntz, detection_id long, severity string, impact_ms double, table_name string, evidence string")
    assert reports.fold_problems(none).count() == 0
    assert reports.severity_breakdown(none).count() == 0


# ---- no caps: one past the limits that once were -------------------------------------


def test_audit_finds_every_marker(spark):
    markers = [f"marker number {i:05d}." for i in range(1_500)]
    rows = spark.createDataFrame([(i, f"it's \"{m}\"\n") for i, m in enumerate(markers)] + [(9_999, None)], "id long, text string")
    asked = spark.createDataFrame([(m,) for m in [*markers, "absent", "", None, 's "marker number 00007."\n']], "marker string")
    got = T.leak_audit({"t": rows}, asked)
    assert got.count() == 1_501 and got.agg(F.sum("n")).first()[0] == 1_501


def test_wait_chains_of_any_length(spark):
    chain = spark.createDataFrame([("db", i + 1, i) for i in range(130)] + [("db", 500, 501), ("db", 501, 500)], "db_id string, waiter long, blocker long")
    got = {(r.root, r.member): r.depth for r in contention.blocked_under(chain).collect()}
    assert got == {(0, i): i for i in range(1, 131)}
    assert contention.blocked_under(chain.limit(0)).count() == 0


def test_plans_of_any_depth_and_width(spark):
    deep, depth = '{"Node Type":"Seq Scan","Relation Name":"t"}', 55
    for _ in range(depth):
        deep = '{"Node Type":"Sort","Plans":[' + deep + "]}"
    wide = '{"Node Type":"Aggregate","Plans":[' + ",".join(f'{{"Node Type":"Seq Scan","Relation Name":"t{i}"}}' for i in range(1_200)) + "]}"
    df = spark.createDataFrame([(1, deep), (2, wide), (3, None)], "id int, plan string")
    ops = flatten_pg_plan(df, "id", "plan").orderBy("id", "path").collect()
    assert sum(r.id == 1 for r in ops) == depth + 1
    assert [r.table_name for r in ops if r.id == 2 and r.type == "scan"] == [f"t{i}" for i in range(1_200)]


def test_condition_trees_of_any_depth_and_their_leaves(spark):
    rows = []
    for level in range(0, 8, 2):  # an AND over a useless leaf and an OR, which is over a fixable leaf and the next AND
        n = 2 * level
        rows += [(1, n, n - 1 if level else -1, level, "and", None), (1, n + 2, n, level + 1, "leaf", "OTHER"), (1, n + 3, n, level + 1, "or", None), (1, n + 1, n + 3, level + 2, "leaf", "FIX")]
    rows.append((1, 100, 15, 8, "leaf", "FIX"))
    df = spark.createDataFrame([r if r[2] != r[1] - 1 else (*r[:2], r[1] - 1, *r[3:]) for r in rows], "tree int, node_id int, parent_id int, level int, kind string, state string")
    assert tuple(usable_tree(df).first()) == (1, False, True)
    assert sorted(r.node_id for r in fix_leaves(df).collect()) == [1, 5, 9, 13, 100]
    plain = spark.createDataFrame([(1, 0, -1, 0, "and", None), (1, 1, 0, 1, "leaf", "FIX"), (1, 2, 0, 1, "or", None), (1, 3, 2, 2, "leaf", "FIX"), (1, 4, 2, 2, "leaf", "OK")], df.schema)
    assert [(r.node_id, r.in_or) for r in fix_leaves(plain).collect()] == [(1, False)]
    assert fix_leaves(df.limit(0)).count() == 0


def test_markers_nest_to_any_depth(spark):
    one = lambda expr: spark.range(1).select(expr.alias("x")).first().x
    deep = "x"
    for i in range(15):
        deep = f"<{'abc'[i % 3]}>(({deep}) = 1)"
    assert one(T.strip_markers(F.lit(f"a = {deep} and (b)"))) == "a = NULL and (b)"
    assert one(T.clean_my_predicate(F.lit("<not>(<cache>((a + <if>(b))))"))) == "NOT ((a + b))"
    assert one(T.clean_my_predicate(F.lit("<odd>(a)"))) is None


# ---- deadlock patterns ----------------------------------------------------------------


def deadlock(spark, members, locks, leads=()):
    """The rule of one report: members (pid, blocked_by, rows_locked, undo, query), locks (pid, role, target, mode, scope)."""
    trx = spark.createDataFrame([(1, "db", p, True, b if isinstance(b, list) else [b], True, r, u, None, q) for p, b, r, u, q in members], "report_id long, db_id string, process_id long, complete boolean, blocked_by array<long>, holds_known boolean, rows_locked long, undo_entries long, schema_name string, canonic_query string")
    held = spark.createDataFrame([(1, *x) for x in locks], "report_id long, process_id long, role string, target string, mode string, scope string")
    known = spark.createDataFrame(list(leads), "db_id string, schema_name string, table_name string, column_name string")
    found = contention.classify_deadlocks(contention.pattern_flags(contention.amplifying_statements(trx, known), held))
    return found.first().rule


def two(first, second, rows=1, query=None):
    return [(1, 2, rows, 1, query), (2, 1, 1, 1, None)], [(1, "hold", *first[0]), (1, "wait", *first[1]), (2, "hold", *second[0]), (2, "wait", *second[1])]


def test_deadlock_patterns(spark):
    a, b = ("7:1:2", "X", "row"), ("7:1:3", "X", "row")
    assert deadlock(spark, *two((a, b), (b, a))) == "CT-01"
    s = ("7:1:2", "S", "row")
    assert deadlock(spark, *two((s, a), (s, a))) == "CT-02"
    assert deadlock(spark, *two((s, a), (a, a))) is None  # one of them did not hold it shared
    gap, insert = ("7:1:1", "X", "gap"), ("7:1:1", "X", "insert_intention")
    assert deadlock(spark, *two((gap, insert), (gap, insert))) == "CT-03"
    unknown = (None, "X", "row")
    assert deadlock(spark, *two((a, unknown), (b, a))) == "CT"
    update = "UPDATE orders SET state = $1 WHERE client = $2"
    assert deadlock(spark, *two((a, b), (b, a), 10, update)) == "CT-04"
    assert deadlock(spark, *two((a, b), (b, a), 9, update)) == "CT-01"
    assert deadlock(spark, *two((a, b), (b, a), 10, update), [("db", "x", "orders", "client")]) is None
    assert deadlock(spark, *two((a, b), (b, a), 10, "SELECT * FROM orders WHERE client = $1 FOR UPDATE")) is None
    assert deadlock(spark, *two((a, b), (b, a), 10, "UPDATE orders SET state = $1 WHERE lower(state) = $2")) is None
    members, locks = two((a, b), (b, a))
    assert deadlock(spark, [members[0], (2, 999, 1, 1, None)], locks) is None


def test_deadlocks_of_three_with_several_blockers(spark):
    """Each waits for the next; a blocker that matters may be the second of a list, strangers in it do not."""
    lock = lambda k: (f"7:1:{k}", "X", "row")
    locks = [x for k in (1, 2, 3) for x in ((k, "hold", *lock(k)), (k, "wait", *lock(k % 3 + 1)))]
    ring = lambda *blockers: [(k, b, 1, 1, None) for k, b in zip((1, 2, 3), blockers)]
    assert deadlock(spark, ring([2], [3], [1]), locks) == "CT-01"
    assert deadlock(spark, ring([3, 2], [77, 3], [2, 1]), locks) == "CT-01"
    assert deadlock(spark, ring([3], [3], [1]), locks) is None  # the one that blocks does not hold what is waited for
    assert deadlock(spark, ring([2], [77], [1]), locks) is None  # no cycle
    assert deadlock(spark, ring([2], [], [1]), locks) is None


def test_all_holders_of_what_is_waited_for(spark):
    rows = [(1, 1, "wait", "a"), (1, 2, "hold", "a"), (1, 3, "hold", "a"), (1, 1, "hold", "a"), (1, 2, "wait", "b"), (1, 3, "wait", "c"), (2, 7, "wait", "x"), (2, 9, "wait", "y"), (3, 4, "wait", None)]
    got = {(r.report_id, r.process_id): r.blockers for r in contention.blocked_by(spark.createDataFrame(rows, "report_id long, process_id long, role string, target string")).collect()}
    assert got == {(1, 1): [2, 3], (1, 2): [], (1, 3): [], (2, 7): [9], (2, 9): [7], (3, 4): []}


def test_same_victim_at_exact_times_is_another_deadlock(spark):
    def kept(*times, source="innodb_status"):
        rows = [("db", i, 5, int(t * 1_000_000), True, source) for i, t in enumerate(times)]
        return sorted(r.report_id for r in contention.dedup_deadlocks(spark.createDataFrame(rows, "db_id string, report_id long, victim_pid long, at_us long, complete boolean, source string")).collect())

    assert kept(10.1, 12.1, 14.1, 16.1, 18.1) == [0, 1, 2, 3, 4]
    assert kept(10.1, 11.0, 12.5) == [0, 2]
    assert kept(10.0, 11.5, 13.0) == [0, 2]  # the third is held against what stayed
    assert kept(10.1, 11.0, source="postgres_log") == [0, 1]
    assert kept(10.1, 10.1) == [0]


# ---- windows and streams with unknown epochs ------------------------------------------


def test_reset_is_seen_across_an_unknown_epoch(spark):
    later = AT + dt.timedelta(hours=1)
    st = samples(spark, [(10, 100.0, 1, 0, None, AT), (12, 120.0, 1, 0, None, None), (17, 150.0, 1, 0, None, later)])
    assert [r.calls for r in windows.delta_windows(st).orderBy("captured_at").collect()] == [None, 2, None]


def test_stream_takes_null_epochs_times_and_calls(spark):
    rows = [("db", "q", 3600 * i, 10 * i, 100.0 * i, None if i % 3 else 5) for i in range(1, 12)] + [("db", "q", 3600 * 12, None, 1.0, 5), ("db", "q", 3600 * 13, 120, None, None), ("db", "q", 3600 * 14, 130, 5000.0, 5), ("db", "q", 3600 * 15, 140, 9000.0, 5)]
    schema = "db_id string, query_id string, at_s long, calls long, time_ms double, epoch_s long"
    folder = jobs.work_folder(spark)
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in")
    found = jobs.stream_baseline(jobs.stream_snapshots(spark, f"{folder}/in", spark.createDataFrame([], schema).schema), baseline=5, ratio=2.0)
    assert [(r.at_s, r.n, r.mean_ms) for r in jobs.run_now(found, folder).collect()] == [(3600 * 15, 10, 400.0)]


def test_matching_goes_on_with_the_rows_still_free(spark):
    left = spark.createDataFrame([("k", 1, 0), ("k", 2, 10)], "key string, l_id long, l_s long")
    right = spark.createDataFrame([("k", 3, 8), ("k", 4, 30)], "key string, r_id long, r_s long")
    assert sorted((r.l_id, r.r_id) for r in quality.match_once(left, right, 60).collect()) == [(1, 4), (2, 3)]


def test_contention_graph_reads_evidence_once(spark):
    from dbpulse.functions.text import contention_graph

    texts = [
        '{"transactions":[{"process_id":1,"victim":true,"blocked_by":[2,null,2],"waits_for":{"targets":["r1"]},"holds":[{"schema_name":"s","table_name":"t"},{"targets":["r2","r2"]}]},{"process_id":null,"blocked_by":[1]},{"process_id":2}]}',
        '{"root":{"process_id":5},"blocked_sessions":[{"process_id":6,"blocking_pids":[5]},{"blocking_pids":[5]}]}', '{"root":{"process_id":7}}', "no json", None, "{}",
    ]
    nodes, edges = contention_graph(spark.createDataFrame(list(enumerate(texts)), "detection_id long, evidence string"))
    assert {tuple(r) for r in edges.collect()} == {(0, "session 1", "session 2", "blocked by"), (0, "session 1", "r1", "waits for"), (0, "s.t", "session 1", "held by"), (0, "r2", "session 1", "held by"), (1, "session 6", "session 5", "blocked by")}
    assert {tuple(r) for r in nodes.collect()} == {
        (0, "session 1", "session", "victim"), (0, "session 2", "session", ""), (0, "r1", "lock", ""), (0, "s.t", "lock", ""), (0, "r2", "lock", ""), (1, "session 5", "session", "root"), (1, "session 6", "session", ""), (2, "session 7", "session", "root"),
    }
    for made in (nodes, edges):
        assert made._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") + made._jdf.queryExecution().optimizedPlan().toString().count("LocalRelation") == 1


def test_only_transactions_that_may_amplify_are_searched_for_scans(spark):
    trx = spark.createDataFrame(
        [(1, "db", "s", "UPDATE  t\nSET a = 1 WHERE b = $1", 50, 1), (2, "db", "s", "UPDATE t SET a = 1 WHERE b = $1", 5, 1), (3, "db", "s", "DELETE\tFROM s.t WHERE c = $1", 10, None), (4, "db", "s", "UPDATE t ,u SET a = 1 WHERE b = 1", 50, 1), (5, "db", "s", None, 50, 1)],
        "process_id long, db_id string, schema_name string, canonic_query string, rows_locked long, undo_entries long",
    )
    leads = spark.createDataFrame([("db", "s", "t", "c")], "db_id string, schema_name string, table_name string, column_name string")
    said = lambda df: {r.process_id: r.scan and (r.scan.columns, r.scan.led) for r in df.collect()}
    asked = contention.amplifying_statements(trx, leads, ratio=10)
    assert said(asked) == {1: (["b"], False), 2: None, 3: (["c"], True), 4: None, 5: None}
    assert said(contention.amplifying_statements(trx, leads)) == {1: (["b"], False), 2: (["b"], False), 3: (["c"], True), 4: None, 5: None}
    assert "SortMergeJoin" not in asked._jdf.queryExecution().executedPlan().toString()


def test_a_query_of_several_rules_is_run_once(spark, monkeypatch):
    from dbpulse.queries import QUERIES, load, rules

    load()
    ran = []
    plain = spark.createDataFrame([("db1", "q", "x")], "db_id string, q string, x string").selectExpr(
        "db_id", "q query_id", "q child_id", "x severity", "x table_name", "x column_name", "x subtype", "x suggested_index", "true per_branch", "x index_name", "x constraint_name", "x direction", "x kind", "1 pid", "timestamp_ntz'2024-01-01' captured_at"
    )
    events = spark.createDataFrame([(i, "db1", r) for i, r in enumerate(["CT-01", "CT-02", "CT-02", "CT-04", "CT", None])], "report_id long, db_id string, rule string")
    for name in {n for n, *_ in rules.FOUND.values()}:
        monkeypatch.setitem(QUERIES, name, lambda spark, sf_dir, name=name: (ran.append(name), events if name == "g18_deadlock_events" else plain)[1])
    found = rules.everything(spark, "nowhere")
    assert sorted(ran) == sorted({n for n, *_ in rules.FOUND.values()})
    assert sorted((r.rule, r.detail) for r in found.filter("rule like 'CT-0%' and rule < 'CT-05'").collect()) == [("CT-01", "0"), ("CT-02", "1"), ("CT-02", "2"), ("CT-04", "3")]
    assert found.count() == 4 + 9


def test_deadlock_events_shuffle_each_line_once(spark):
    from dbpulse.queries import QUERIES, load
    from tests.compare import SF

    load()
    for name in ("g18_deadlock_events", "g15_classify_deadlocks", "g11_ct03", "g06_cycle_flags"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert (plan.count("Exchange hashpartitioning"), plan.count("Sort ["), plan.count("SortMergeJoin")) == (1, 1, 0), name


def test_the_next_line_is_looked_up_as_by_a_join(spark, tmp_path):
    from dbpulse.sources.fixtures import view

    # a report of one line, lines that come twice, parts unknown in the middle, at the end and of all; no report
    lines = [(1, 1, 5, 1), (2, 1, 5, 1), (2, 1, 5, 1), (2, 1, 5, 2), (3, 1, None, 1), (3, 2, 7, 1), (4, 1, 5, 1), (4, 2, None, 1), (5, None, None, None), (5, 1, 9, 1), (6, 1, None, 1), (None, 1, 5, 1), (None, 2, 6, 1)]
    rows = spark.createDataFrame([(*x, 17.0, "R" if x[3] == 1 else "N", "F", dt.datetime(2020, 1, 1)) for x in lines], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz")
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    joined, ring = (view(spark, str(tmp_path), name) for name in ("deadlock_trx", "deadlock_ring"))
    assert ring.columns == joined.columns and ring.count() == 11
    assert sorted(map(str, ring.collect())) == sorted(map(str, joined.collect()))


def test_reports_are_the_same_with_locks_beside_or_within(spark):
    trx = spark.createDataFrame(
        [(1, 1, True, [2], True, 5, None), (1, 2, True, [1, None], True, 1, 1), (2, 1, None, None, None, None, None), (2, 2, True, [9], False, 3, 1), (3, 4, True, [], True, 1, 1)],
        "report_id long, process_id int, complete boolean, blocked_by array<int>, holds_known boolean, rows_locked long, undo_entries long",
    )
    locks = spark.createDataFrame(
        [(1, 1, "wait", "b", "X", "row"), (1, 2, "wait", "a", "X", "row"), (1, 1, "hold", "a", "X", "row"), (1, 2, "hold", "b", "X", "row"), (1, 2, "hold", "c", "S", None), (2, 1, "wait", None, None, None), (2, 1, "wait", "x", "S", "gap"), (2, 2, "hold", "x", None, "gap")],
        "report_id long, process_id int, role string, target string, mode string, scope string",
    )
    own = trx
    for role, name in (("wait", "waits"), ("hold", "held")):
        own = own.join(locks.filter(f"role = '{role}'").groupBy("report_id", "process_id").agg(F.collect_list(F.struct("process_id", "target", "mode", "scope")).alias(name)), ["report_id", "process_id"], "left")
    beside, within = contention.reports_of(trx, locks), contention.reports_together(own, {"n": F.count("*")})
    assert {r.report_id: r.n for r in within.collect()} == {1: 2, 2: 2, 3: 1}

    def flags(reports):
        made = contention.unclassified(contention.lock_amplification(contention.range_contention(contention.mode_conversion(contention.inconsistent_order(contention.amplification(contention.cycle_flags(reports)))))))
        return sorted(map(str, made.select("report_id", "is_cycle", "targets_known", "holds_known", "ratio", "ct01", "ct02", "ct03", "gaps", "ct04", "open").collect()))

    assert flags(beside) == flags(within)
    assert "ct01=True" in flags(within)[0]


def test_a_query_of_several_rules_is_not_written(spark, monkeypatch):
    from dbpulse.queries import QUERIES, rules

    events = spark.createDataFrame([(i, "db1", r) for i, r in enumerate(["CT-01", "CT-02", "CT-02", "CT-04", "CT", None])], "report_id long, db_id string, rule string")
    monkeypatch.setattr(rules, "FOUND", {rule: of for rule, of in rules.FOUND.items() if of[0] == "g18_deadlock_events"})
    monkeypatch.setitem(QUERIES, "g18_deadlock_events", lambda spark, sf_dir: events)
    monkeypatch.setattr(rules, "written", None)
    found = rules.everything(spark, "nowhere")
    assert sorted((r.rule, r.detail, r.query_id, r.variant, r.captured_at) for r in found.collect()) == [("CT-01", "0", None, None, None), ("CT-02", "1", None, None, None), ("CT-02", "2", None, None, None), ("CT-04", "3", None, None, None)]
    assert dict(found.dtypes) == {"db_id": "string", "captured_at": "timestamp_ntz", "query_id": "string", "detail": "string", "variant": "string", "rule": "string"}
    of_two = antipatterns.detect_all({("CT-01", "CT-02"): events.selectExpr("db_id", "report_id detail", "rule"), "AP-07": events.selectExpr("db_id", "report_id detail")}, "CT-02")
    assert sorted((r.rule, r.detail) for r in of_two.filter("detail < '3'").collect()) == [("CT-02", "1"), ("CT-02", "2")]
