"""Queries of detection quality Q01-Q27 and observation cost O01-O14."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import overhead, quality
from ..sources.fixtures import ctes, define, view
from . import query

#: criteria of two injected scenarios: (scenario, criterion, kind, rule, field, op, operand)
CRITERIA = [
    ("a", 1, "expected", "click", "severity", "eq", "high"), ("a", 1, "expected", "click", "table_name", "prefix", "table1"), ("a", 2, "collateral", "click", "severity", "in", "medium,low"),
    ("b", 3, "expected", "view", "impact_ms", "max", "50"), ("b", 4, "baseline", "view", "evidence", "contains", "\"ratio\":3"), ("b", 5, "during", "error", "severity", "eq", "high"),
]
CRITERIA_SQL = "cr(scenario, criterion, kind, rule, field, op, operand) AS (VALUES " + ", ".join(str(c) for c in CRITERIA) + ")"
MATCH = CRITERIA_SQL + """, v AS (
  SELECT detection_id, rule, 'severity' AS field, severity AS value FROM detection UNION ALL SELECT detection_id, rule, 'table_name', table_name FROM detection
  UNION ALL SELECT detection_id, rule, 'impact_ms', CAST(impact_ms AS VARCHAR) FROM detection UNION ALL SELECT detection_id, rule, 'evidence', evidence FROM detection
), mt AS (
  SELECT detection_id, scenario, criterion, kind FROM v JOIN cr USING (rule, field) GROUP BY ALL
  HAVING bool_and(coalesce(CASE op WHEN 'eq' THEN value = operand WHEN 'max' THEN TRY_CAST(value AS DOUBLE) <= TRY_CAST(operand AS DOUBLE) WHEN 'in' THEN list_contains(string_split(operand, ','), value)
    WHEN 'prefix' THEN starts_with(value, operand) WHEN 'contains' THEN contains(value, operand) END, false)))"""


def matches(spark, sf_dir):
    criteria = spark.createDataFrame(CRITERIA, "scenario string, criterion int, kind string, rule string, field string, op string, operand string")
    found = view(spark, sf_dir, "detection").select("detection_id", "rule", "severity", "table_name", "impact_ms", "evidence")
    return quality.match(found, F.broadcast(criteria))  # a fixed short list


@query("q01_criterion_match", ctes("detection") + f", {MATCH} SELECT * FROM mt")
def q01(spark, sf_dir):
    return matches(spark, sf_dir)


@query("q02_classify_findings", ctes("detection") + f""", {MATCH}, b AS (SELECT detection_id, arg_min(kind, list_position(['expected', 'collateral', 'during', 'baseline'], kind)) AS k FROM mt GROUP BY 1)
SELECT d.detection_id, coalesce(k, 'undeclared') AS class FROM detection d LEFT JOIN b ON b.detection_id = d.detection_id""")
def q02(spark, sf_dir):
    return quality.classify_findings(view(spark, sf_dir, "detection"), matches(spark, sf_dir))


CONF = """cf AS (SELECT grp, count(*) FILTER (truth = 1 AND predicted = 1) AS tp, count(*) FILTER (truth = 0 AND predicted = 1) AS fp, count(*) FILTER (truth = 1 AND predicted = 0) AS fn,
  count(*) FILTER (truth = 0 AND predicted = 0) AS tn FROM confusion_row GROUP BY grp)"""


def confusion(spark, sf_dir):
    return quality.confusion(view(spark, sf_dir, "confusion_row"), ["grp"])


@query("q03_confusion", ctes("confusion_row") + f", {CONF} SELECT * FROM cf")
def q03(spark, sf_dir):
    return confusion(spark, sf_dir)


RATES = "rt AS (SELECT *, tp / nullif(tp + fn, 0) AS recall, tp / nullif(tp + fp, 0) AS precision FROM cf)"


@query("q04_recall_precision", ctes("confusion_row") + f", {CONF}, {RATES} SELECT *, coalesce(recall >= 0.8 AND precision >= 0.8, false) AS passes FROM rt")
def q04(spark, sf_dir):
    return quality.rates(confusion(spark, sf_dir), 0.8)


@query("q05_wilson", ctes("confusion_row") + f""", {CONF}, w AS (SELECT grp, CAST(tp AS DOUBLE) / (tp + fn) AS p, CAST(tp + fn AS DOUBLE) AS n, 1.959963984540054::DOUBLE AS z FROM cf),
m AS (SELECT grp, (p + z * z / (2 * n)) / (1 + z * z / n) AS mid, z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n) AS half FROM w WHERE n > 0)
SELECT grp, round(greatest(mid - half, 0), 9) AS low, round(least(mid + half, 1), 9) AS high FROM m""")
def q05(spark, sf_dir):
    low, high = quality.wilson(F.col("tp").cast("double"), (F.col("tp") + F.col("fn")).cast("double"))
    return confusion(spark, sf_dir).select("grp", F.round(low, 9).alias("low"), F.round(high, 9).alias("high")).filter("low is not null")


@query("q06_latency", ctes("latency") + """ SELECT template_id, count(*) FILTER (ok) AS n, count(*) FILTER (ok AND v <= 100) AS within, quantile_cont(CAST(v AS DOUBLE), 0.5) FILTER (ok) AS median, max(CAST(v AS DOUBLE)) FILTER (ok) AS most
FROM latency GROUP BY 1""")
def q06(spark, sf_dir):
    rows = view(spark, sf_dir, "latency").withColumn("latency", F.when(F.col("ok"), F.col("v").cast("double")))
    return quality.latency(rows, ["template_id"], 100)


define("m3_row", ["ev"], "SELECT event_type AS scenario, k % 4 > 0 AS detected, k % 3 > 0 AS members_ok, k % 5 > 0 AS pattern_ok FROM ev")


@query("q07_contention_accuracy", ctes("m3_row") + """ SELECT scenario, count(*) FILTER (detected AND members_ok) / nullif(count(*) FILTER (detected), 0) AS members,
  count(*) FILTER (detected AND pattern_ok) / nullif(count(*) FILTER (detected), 0) AS pattern FROM m3_row GROUP BY 1""")
def q07(spark, sf_dir):
    return quality.accuracy_m3(view(spark, sf_dir, "m3_row"), ["scenario"])


define("thin_problem", ["detection"], "SELECT CASE WHEN s % 5 > 0 THEN severity END AS severity, CASE WHEN s % 7 > 0 THEN table_name END AS table_name, impact_ms FROM detection")


@query("q08_completeness", ctes("thin_problem") + """, t AS (SELECT count(*) AS problems, count(*) FILTER (severity IS NOT NULL AND table_name IS NOT NULL AND impact_ms IS NOT NULL) AS complete,
  count(*) FILTER (severity IS NULL) AS a, count(*) FILTER (table_name IS NULL) AS b, count(*) FILTER (impact_ms IS NULL) AS c FROM thin_problem)
SELECT problems, complete, 'severity' AS field, a AS missing FROM t UNION ALL SELECT problems, complete, 'table_name', b FROM t UNION ALL SELECT problems, complete, 'impact_ms', c FROM t""")
def q08(spark, sf_dir):
    return quality.completeness(view(spark, sf_dir, "thin_problem"), ["severity", "table_name", "impact_ms"])


@query("q09_verdict", ctes("confusion_row") + f""", {CONF}, {RATES}, p AS (SELECT tp > 25 AS many, coalesce(recall >= 0.8 AND precision >= 0.8, false) AS passes FROM rt)
SELECT many, bool_and(passes) AS passes, count(*) AS checks, count(*) FILTER (NOT passes) AS failed FROM p GROUP BY 1""")
def q09(spark, sf_dir):
    return quality.verdict(quality.rates(confusion(spark, sf_dir), 0.8).withColumn("many", F.col("tp") > 25), ["many"])


@query("q10_truth_windows", ctes("stmt") + """ SELECT db_id, query_id, captured_at, execution_count - lag(execution_count, 1, 0) OVER (PARTITION BY db_id, query_id, counters_epoch ORDER BY captured_at) AS calls FROM stmt""")
def q10(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("db_id", "query_id", "counters_epoch").orderBy("captured_at")
    return view(spark, sf_dir, "stmt").select("db_id", "query_id", "captured_at", (F.col("execution_count") - F.lag("execution_count", 1, 0).over(w)).alias("calls"))


define("cycle_span", ["ev"], "SELECT event_id AS cycle_id, db_id, s AS c0, s + 600 + k * 10 AS c1 FROM ev WHERE event_type = 'signup'")


@query("q11_finding_cycle", ctes("detection", "cycle_span") + """, f AS (SELECT db_id, s, detection_id FROM detection)
SELECT f.detection_id, c.cycle_id, coalesce(f.s <= c.c1, false) AS inside FROM f ASOF LEFT JOIN (SELECT db_id, c0, max(cycle_id) AS cycle_id, arg_max(c1, cycle_id) AS c1 FROM cycle_span GROUP BY 1, 2) c ON f.db_id = c.db_id AND f.s >= c.c0""")
def q11(spark, sf_dir):
    return quality.finding_cycle(view(spark, sf_dir, "detection"), view(spark, sf_dir, "cycle_span"))


@query("q12_eval_windows", ctes("ev") + """, t AS (SELECT DISTINCT db_id, bucket FROM ev WHERE value > 250), d AS (SELECT DISTINCT db_id, bucket FROM ev WHERE value > 200 AND k % 3 > 0)
SELECT coalesce(t.db_id, d.db_id) AS db_id, count(*) FILTER (t.bucket IS NOT NULL AND d.bucket IS NOT NULL) AS both, count(*) FILTER (d.bucket IS NULL) AS missed, count(*) FILTER (t.bucket IS NULL) AS false
FROM t FULL JOIN d ON t.db_id = d.db_id AND t.bucket = d.bucket GROUP BY 1""")
def q12(spark, sf_dir):
    ev = view(spark, sf_dir, "ev")
    return quality.eval_windows(ev.filter("value > 250"), ev.filter("value > 200 and k % 3 > 0"), ["db_id", "bucket"])


WILSON = lambda k, n, sign: f"CASE WHEN {n} > 0 THEN {'greatest' if sign == '-' else 'least'}((({k} / {n} + 3.8414588206941227 / (2 * {n})) {sign} 1.959963984540054 * sqrt(({k} / {n}) * (1 - {k} / {n}) / {n} + 3.8414588206941227 / (4 * {n} * {n}))) / (1 + 3.8414588206941227 / {n}), {0 if sign == '-' else 1}) END"


@query("q15_quality_summary", ctes("confusion_row") + f""", g AS (SELECT grp AS role, toxic AS category, CAST(grouping_id(grp, toxic) AS BIGINT) AS level, count(*) AS n, count(*) FILTER (truth = 1) AS p, count(*) FILTER (truth = 1 AND predicted = 1) AS tp,
  count(*) FILTER (truth = 0 AND predicted = 1) AS fp, count(*) FILTER (truth = 1 AND doc_id % 3 > 0) AS v, count(*) FILTER (truth = 1 AND predicted = 1 AND doc_id % 3 > 0) AS vt, list_sort(list(doc_id % 4) FILTER (truth = 1 AND predicted = 1)) AS l FROM confusion_row GROUP BY CUBE (grp, toxic))
SELECT role, category, level, n, tp, fp, tp / nullif(p, 0) AS recall, {WILSON("tp", "p", "-")} AS recall_low, {WILSON("tp", "p", "+")} AS recall_high, vt / nullif(v, 0) AS valid_recall, fp / nullif(n - p, 0) AS fp_rate,
  coalesce(array_to_string(list_transform(list_sort(list_distinct(l)), lambda x: x || ':' || len(list_filter(l, lambda y: y = x))), ','), '') AS latencies FROM g""")
def q15(spark, sf_dir):
    rows = view(spark, sf_dir, "confusion_row").withColumnRenamed("grp", "role").withColumnRenamed("toxic", "category")
    return quality.quality_summary(rows.withColumn("valid", F.col("doc_id") % 3 > 0).withColumn("latency", F.col("doc_id") % 4))


@query("q16_match_once", ctes("ev").replace("WITH ", "WITH RECURSIVE ", 1) + """, l AS (SELECT db_id AS key, event_id AS l_id, s AS l_s FROM ev WHERE event_type = 'error'), r AS (SELECT db_id AS key, event_id AS r_id, s AS r_s FROM ev WHERE event_type = 'signup'),
p AS (SELECT key, l_id, r_id, abs(l_s - r_s) AS gap FROM l JOIN r USING (key) WHERE abs(l_s - r_s) <= 7200), o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY gap, l_id, r_id) AS rn FROM p),
g AS (SELECT key, rn, l_id, r_id, gap, [l_id] AS ls, [r_id] AS rs, true AS taken FROM o WHERE rn = 1
  UNION ALL SELECT o.key, o.rn, o.l_id, o.r_id, o.gap, CASE WHEN u.free THEN list_append(g.ls, o.l_id) ELSE g.ls END, CASE WHEN u.free THEN list_append(g.rs, o.r_id) ELSE g.rs END, u.free
  FROM g JOIN o ON o.key = g.key AND o.rn = g.rn + 1, LATERAL (SELECT NOT list_contains(g.ls, o.l_id) AND NOT list_contains(g.rs, o.r_id) AS free) u)
SELECT l_id, r_id, gap FROM g WHERE taken""")
def q16(spark, sf_dir):
    ev = view(spark, sf_dir, "ev")
    left = ev.filter("event_type = 'error'").select(F.col("db_id").alias("key"), F.col("event_id").alias("l_id"), F.col("s").alias("l_s"))
    right = ev.filter("event_type = 'signup'").select(F.col("db_id").alias("key"), F.col("event_id").alias("r_id"), F.col("s").alias("r_s"))
    return quality.match_once(left, right, 7200)


@query("q17_case_summary", ctes("detection") + f""", g AS (SELECT rule, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low, count(*) AS n, count(*) FILTER (severity <> 'low') AS f,
  quantile_cont(s % 600, 0.5) FILTER (severity <> 'low') AS median_latency, max(s % 600) FILTER (severity <> 'low') AS most_latency, coalesce(bool_and(impact_ms IS NOT NULL) FILTER (severity <> 'low'), false) AS evidence_ok FROM detection GROUP BY 1)
SELECT rule, high, medium, low, n, f / n AS rate, {WILSON("f", "n", "-")} AS rate_low, {WILSON("f", "n", "+")} AS rate_high, median_latency, most_latency, evidence_ok FROM g""")
def q17(spark, sf_dir):
    rows = view(spark, sf_dir, "detection").withColumn("latency", F.col("s") % 600).withColumn("evidence_ok", F.col("impact_ms").isNotNull())
    return quality.case_summary(rows, "rule", "severity", ["high", "medium", "low"], ["high", "medium"])


@query("q18_phase_check", ctes("ev") + """, e AS (SELECT * FROM ev WHERE event_type = 'error'), c AS (SELECT db_id, count(*) AS counted FROM e GROUP BY 1), a AS (SELECT db_id, count(*) AS captured FROM e WHERE k % 50 > 0 GROUP BY 1),
r AS (SELECT db_id, count(*) AS reported FROM e WHERE k % 2 = 0 GROUP BY 1)
SELECT db_id, counted, coalesce(captured, 0) AS captured, coalesce(reported, 0) AS reported, counted = coalesce(captured, 0) AND coalesce(captured, 0) >= coalesce(reported, 0) AS agrees FROM c LEFT JOIN a USING (db_id) LEFT JOIN r USING (db_id)""")
def q18(spark, sf_dir):
    e = view(spark, sf_dir, "ev").filter("event_type = 'error'")
    return quality.phase_check(e.groupBy("db_id").agg(F.count("*").alias("counted")), e.filter("k % 50 > 0"), e.filter("k % 2 = 0"), ["db_id"])


@query("q19_scenario_compare", ctes("detection") + """, a AS (SELECT finding_key, max(severity) AS want FROM detection WHERE s % 7 < 6 GROUP BY 1), b AS (SELECT finding_key, min(severity) AS got FROM detection WHERE s % 50 = 0 GROUP BY 1)
SELECT coalesce(a.finding_key, b.finding_key) AS finding_key, CASE WHEN got IS NULL THEN 'missing' WHEN want IS NULL THEN 'extra' WHEN want = got THEN 'same' ELSE 'different' END AS outcome
FROM a FULL JOIN b ON a.finding_key = b.finding_key""")
def q19(spark, sf_dir):
    d = view(spark, sf_dir, "detection")
    return quality.scenario_compare(d.filter("s % 7 < 6").groupBy("finding_key").agg(F.max("severity").alias("value")), d.filter("s % 50 = 0").groupBy("finding_key").agg(F.min("severity").alias("value")), ["finding_key"])


define("plan_label", ["ev"], "SELECT event_type AS label, CASE k % 3 WHEN 0 THEN 'paired' WHEN 1 THEN 'sample' ELSE 'none' END AS source, cast(v AS double) AS cost FROM ev")


@query("q20_source_coverage", ctes("plan_label") + """ SELECT label, avg(CASE WHEN source = 'paired' THEN 1.0 ELSE 0 END) AS paired, avg(CASE WHEN source = 'sample' THEN 1.0 ELSE 0 END) AS sample, avg(CASE WHEN source = 'none' THEN 1.0 ELSE 0 END) AS none,
  quantile_cont(cost, 0.5) AS median_cost FROM plan_label GROUP BY 1""")
def q20(spark, sf_dir):
    return quality.source_coverage(view(spark, sf_dir, "plan_label"))


define("access_row", ["ev"], "SELECT event_type AS grp, CASE k % 3 WHEN 0 THEN 'scan' WHEN 1 THEN 'index' ELSE 'range' END AS actual, CASE WHEN value > 100 THEN 'scan' ELSE 'index' END AS predicted FROM ev")


@query("q21_accuracy_matrix", ctes("access_row") + " SELECT grp, actual, count(*) FILTER (predicted = 'scan') AS scan, count(*) FILTER (predicted = 'index') AS index FROM access_row GROUP BY 1, 2")
def q21(spark, sf_dir):
    return quality.accuracy_matrix(view(spark, sf_dir, "access_row"), ["scan", "index"])


@query("q22_round_robin", ctes("detection") + """, r AS (SELECT detection_id, rule, row_number() OVER (PARTITION BY rule ORDER BY detection_id) AS turn FROM detection) SELECT detection_id, rule, turn FROM r ORDER BY turn, rule LIMIT 37""")
def q22(spark, sf_dir):
    return quality.round_robin(view(spark, sf_dir, "detection"), "rule", "detection_id", 37).select("detection_id", "rule", F.col("turn").cast("long").alias("turn"))


define("answer", ["ev"], "SELECT event_type AS statement, k % 5 + 1 AS score FROM ev")


@query("q23_likert", ctes("answer") + " SELECT statement, avg(score) AS mean, min(score) AS least, count(*) FILTER (score = 5) AS fives FROM answer GROUP BY 1")
def q23(spark, sf_dir):
    return quality.likert(view(spark, sf_dir, "answer"))


define("poll", ["ev"], "SELECT db_id, k % 4 > 0 AS found, cast(v AS double) AS age FROM ev")


@query("q27_poll_rates", ctes("poll") + " SELECT db_id, avg(CASE WHEN found THEN 1.0 ELSE 0 END) AS share, quantile_cont(age, 0.5) AS median_age, count(*) AS polls FROM poll GROUP BY 1")
def q27(spark, sf_dir):
    return quality.poll_rates(view(spark, sf_dir, "poll"), ["db_id"])


def latencies(spark, sf_dir):
    return view(spark, sf_dir, "latency").withColumn("latency", F.col("v").cast("double"))


GOOD = "FILTER (ok)"


@query("o02_latency_stats", ctes("latency") + f""" SELECT template_id, side, count(*) AS n, count(*) FILTER (NOT ok) AS failures, quantile_cont(CAST(v AS DOUBLE), 0.5) {GOOD} AS p50, quantile_cont(CAST(v AS DOUBLE), 0.95) {GOOD} AS p95,
  CAST(sum(v) {GOOD} AS DOUBLE) / nullif(count(*) {GOOD}, 0) AS mean, count(*) {GOOD} / 86400.0 AS qps FROM latency GROUP BY 1, 2""")
def o02(spark, sf_dir):
    return overhead.latency_stats(latencies(spark, sf_dir), ["template_id", "side"], 86400.0)


@query("o01_percentile", ctes("latency") + " SELECT pair, quantile_cont(CAST(v AS DOUBLE), 0.9) AS p90 FROM latency GROUP BY 1")
def o01(spark, sf_dir):
    return latencies(spark, sf_dir).groupBy("pair").agg(overhead.percentile("latency", 0.9).alias("p90"))


@query("o03_in_block", ctes("latency", "block") + """ SELECT event_id, day_no FROM latency l JOIN block b ON l.t0 >= b.start_us + 600000000 AND l.t1 <= b.end_us""")
def o03(spark, sf_dir):
    return overhead.in_block(latencies(spark, sf_dir), view(spark, sf_dir, "block"), 600_000_000).select("event_id", "day_no")


define("busy", ["latency"], "SELECT t0 AS c0, t0 + 60000000 AS c1, ok, side FROM latency WHERE template_id IN ('signup', 'error')")


@query("o04_overlaps", ctes("latency", "busy") + " SELECT event_id, EXISTS (SELECT 1 FROM busy b WHERE l.t0 < b.c1 AND b.c0 < l.t1) AS overlaps FROM latency l")
def o04(spark, sf_dir):
    return overhead.overlaps(latencies(spark, sf_dir), view(spark, sf_dir, "busy")).select("event_id", "overlaps")


@query("o05_geomean_overhead", ctes("latency") + """, m AS (SELECT pair, template_id, side, quantile_cont(CAST(v AS DOUBLE), 0.5) AS m FROM latency WHERE ok GROUP BY ALL HAVING count(*) >= 5),
r AS (SELECT pair, template_id, max(m) FILTER (side = 1) / max(m) FILTER (side = 0) AS q FROM m GROUP BY ALL)
SELECT pair, round(exp(avg(ln(q))) - 1, 9) AS overhead, count(*) AS templates FROM r WHERE q > 0 GROUP BY 1""")
def o05(spark, sf_dir):
    return overhead.geomean_overhead(latencies(spark, sf_dir), ["pair"]).withColumn("overhead", F.round("overhead", 9))


PAIRS = """pr AS (SELECT pair, count(*) FILTER (side = 0) AS base_n, count(*) FILTER (side = 1) AS treated_n, sum(v) FILTER (side = 0) AS base_t, sum(v) FILTER (side = 1) AS treated_t FROM latency WHERE ok GROUP BY 1
  HAVING count(*) FILTER (side = 0) > 0 AND count(*) FILTER (side = 1) > 0)"""


def pairs(spark, sf_dir):
    return overhead.pair_blocks(view(spark, sf_dir, "latency").withColumn("latency", F.col("v")))


@query("o11_pair_blocks", ctes("latency") + f", {PAIRS} SELECT pair, base_n, treated_n, CAST(base_t AS DOUBLE) AS base_t, CAST(treated_t AS DOUBLE) AS treated_t FROM pr")
def o11(spark, sf_dir):
    p = pairs(spark, sf_dir)
    return p.select("pair", "base_n", "treated_n", F.col("base_t").cast("double").alias("base_t"), F.col("treated_t").cast("double").alias("treated_t"))


@query("o06_throughput", ctes("latency") + f", {PAIRS} SELECT 100 * (sum(base_n) - sum(treated_n)) / sum(base_n) AS drop_percent FROM pr")
def o06(spark, sf_dir):
    return overhead.throughput_overhead(pairs(spark, sf_dir))


ARM_PAIRS = PAIRS.replace("SELECT pair, ", "SELECT template_id, pair, ").replace("GROUP BY 1", "GROUP BY 1, 2")
BOOT = f"""{ARM_PAIRS}, num AS (SELECT *, row_number() OVER (PARTITION BY template_id ORDER BY pair) - 1 AS i, count(*) OVER (PARTITION BY template_id) AS n FROM pr), dr AS (
  SELECT template_id, r.round, d.draw, CAST('0x' || substr(md5(r.round || '/' || d.draw), 1, 8) AS BIGINT) % n AS i FROM (SELECT unnest(range(0, 2000)) AS round) r, (SELECT template_id, i AS draw, n FROM num) d),
bs AS (SELECT template_id, round, (CAST(sum(treated_t) AS DOUBLE) / CAST(sum(treated_n) AS DOUBLE)) / nullif(CAST(sum(base_t) AS DOUBLE) / CAST(sum(base_n) AS DOUBLE), 0) - 1 AS x FROM dr JOIN num USING (template_id, i) GROUP BY 1, 2),
ci AS (SELECT template_id, CASE WHEN count(x) >= 1800 THEN round(quantile_cont(x, 0.025), 6) END AS low, CASE WHEN count(x) >= 1800 THEN round(quantile_cont(x, 0.975), 6) END AS high, count(x) AS rounds FROM bs GROUP BY 1),
pt AS (SELECT template_id, round((CAST(sum(treated_t) AS DOUBLE) / CAST(sum(treated_n) AS DOUBLE)) / (CAST(sum(base_t) AS DOUBLE) / CAST(sum(base_n) AS DOUBLE)) - 1, 6) AS point, least(min(base_n), min(treated_n)) >= 2 AS enough FROM pr GROUP BY 1)"""


def arm_pairs(spark, sf_dir):
    p = overhead.pair_blocks(view(spark, sf_dir, "latency").withColumn("latency", F.col("v")), ["template_id"])
    return p.select("template_id", "pair", *[F.col(c).cast("double").alias(c) for c in ("base_n", "treated_n", "base_t", "treated_t")])


def intervals(spark, sf_dir):
    ci = overhead.bootstrap_ci(arm_pairs(spark, sf_dir), ["template_id"])
    return ci.select("template_id", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "rounds")


@query("o07_bootstrap_ci", ctes("latency") + f", {BOOT} SELECT * FROM ci")
def o07(spark, sf_dir):
    return intervals(spark, sf_dir)


@query("o08_arm_verdict", ctes("latency") + f""", {BOOT} SELECT *, CASE WHEN NOT enough OR low IS NULL OR high IS NULL THEN 'no data' WHEN high < 0.05 THEN 'pass' WHEN low >= 0.05 THEN 'fail' ELSE 'inconclusive' END AS verdict,
  low > -0.05 AND high < 0.05 AS noise_ok, low >= 0.05 AS detected FROM ci JOIN pt USING (template_id)""")
def o08(spark, sf_dir):
    points = overhead.arm_points(arm_pairs(spark, sf_dir), ["template_id"], least_n=2).withColumn("point", F.round("point", 6))
    return overhead.arm_verdict(intervals(spark, sf_dir).join(points, "template_id"), 0.05)


@query("o09_cycle_summary", ctes("busy") + """ SELECT side, count(*) AS cycles, count(*) FILTER (NOT ok) AS failed, avg(c1 - c0) AS mean_wall, max(c1 - c0) AS max_wall, sum(c1 - c0) / (max(c1) - min(c0)) AS duty FROM busy GROUP BY 1""")
def o09(spark, sf_dir):
    return overhead.cycle_summary(view(spark, sf_dir, "busy"), ["side"])


@query("o10_server_rates", ctes("cycle") + """, u AS (SELECT db_id, at_s, 'deadlocks' AS field, deadlocks AS value FROM cycle UNION ALL SELECT db_id, at_s, 'log_bytes', log_bytes FROM cycle),
e AS (SELECT db_id, field, arg_min(value, at_s) AS a, arg_max(value, at_s) AS b, max(at_s) - min(at_s) AS span FROM u GROUP BY 1, 2) SELECT field, avg((b - a) / span) AS rate FROM e WHERE span > 0 GROUP BY 1""")
def o10(spark, sf_dir):
    return overhead.server_rates(view(spark, sf_dir, "cycle").select("db_id", "at_s", "deadlocks", "log_bytes"), ["deadlocks", "log_bytes"], ["db_id"])


@query("o12_round_summary", ctes("latency") + f""", {PAIRS}, x AS (SELECT (CAST(treated_t AS DOUBLE) - CAST(base_t AS DOUBLE)) / CAST(base_t AS DOUBLE) AS x FROM pr)
SELECT round(min(x), 9) AS least, round(max(x), 9) AS most, round(avg(x), 9) AS mean, round(stddev_samp(x), 9) AS sd, ['pass', 'inconclusive', 'fail'][max(CASE WHEN x >= 0.5 THEN 2 WHEN x >= 0.05 THEN 1 ELSE 0 END) + 1] AS worst FROM x""")
def o12(spark, sf_dir):
    p = pairs(spark, sf_dir).select(F.col("base_t").cast("double").alias("base"), F.col("treated_t").cast("double").alias("treated"))
    return overhead.round_summary(p).select(*[F.round(c, 9).alias(c) for c in ("least", "most", "mean", "sd")], "worst")


@query("o13_warnings", ctes("latency") + f""", a AS (SELECT template_id, side, count(*) AS n, count(*) FILTER (NOT ok) AS failures, quantile_cont(CAST(v AS DOUBLE), 0.5) {GOOD} AS p50, quantile_cont(CAST(v AS DOUBLE), 0.95) {GOOD} AS p95 FROM latency GROUP BY 1, 2)
SELECT template_id, side, array_to_string(list_filter([CASE WHEN n < 1500 THEN 'few samples' END, CASE WHEN failures > 0.1 * n THEN 'many failures' END, CASE WHEN p95 > 4 * p50 * 2.5 THEN 'long tail' END], lambda x: x IS NOT NULL), '; ') AS warnings FROM a""")
def o13(spark, sf_dir):
    return overhead.warnings(overhead.latency_stats(latencies(spark, sf_dir), ["template_id", "side"], 86400.0), 1500).select("template_id", "side", "warnings")


define("sample_line", ["latency"], """
SELECT event_id, CASE WHEN event_id % 9 = 0 THEN concat(cast(t0 AS string), ',x,', template_id) WHEN event_id % 11 = 0 THEN concat('abc,', cast(t1 AS string), ',', template_id, ',1')
  ELSE concat(cast(t0 AS string), ',', cast(t1 AS string), ',', template_id, ',', CASE WHEN ok THEN '1' ELSE '0' END) END AS value FROM latency""")


@query("o14_read_samples", ctes("sample_line") + """, p AS (SELECT string_split(value, ',') AS p FROM sample_line)
SELECT TRY_CAST(p[1] AS BIGINT) AS t0, TRY_CAST(p[2] AS BIGINT) AS t1, p[3] AS template_id, p[4] = '1' AS ok FROM p WHERE len(p) = 4 AND TRY_CAST(p[1] AS BIGINT) IS NOT NULL AND TRY_CAST(p[2] AS BIGINT) IS NOT NULL""")
def o14(spark, sf_dir):
    return overhead.read_samples(view(spark, sf_dir, "sample_line"))
