"""Detection quality: findings against what was injected, with rates and intervals."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .carried import carried, with_previous

Z = 1.959963984540054


def match(findings: DataFrame, criteria: DataFrame) -> DataFrame:
    """Which findings meet which criterion (Q01).

    ``criteria(scenario, criterion, kind, rule, field, op, operand)``: a criterion is all of
    its rows. ``op`` is eq, max, in (comma list), prefix or contains, on a column of
    ``findings`` as text. The join is by rule.
    """
    fields = F.create_map(*[x for c in findings.columns if c != "rule" for x in (F.lit(c), F.col(c).cast("string"))])
    joined = findings.withColumn("__f", fields).join(criteria, "rule")
    value, operand = F.element_at("__f", F.col("field")), F.col("operand")
    met = (
        F.when(F.col("op") == "eq", value == operand).when(F.col("op") == "max", value.try_cast("double") <= operand.try_cast("double"))
        .when(F.col("op") == "in", F.array_contains(F.split(operand, ","), value)).when(F.col("op") == "prefix", value.startswith(operand)).when(F.col("op") == "contains", value.contains(operand))
    )
    return joined.groupBy("detection_id", "scenario", "criterion", "kind").agg(F.bool_and(F.coalesce(met, F.lit(False))).alias("met")).filter("met").drop("met")


KINDS = ["expected", "collateral", "during", "baseline"]


def classify_findings(findings: DataFrame, matches: DataFrame) -> DataFrame:
    """The first kind, in the order of KINDS, that a finding has a match of; else undeclared (Q02)."""
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    best = matches.groupBy("detection_id").agg(F.min_by("kind", place).alias("class"))
    return findings.select("detection_id").join(best, "detection_id", "left").select("detection_id", F.coalesce("class", F.lit("undeclared")).alias("class"))


def confusion(rows: DataFrame, by: list[str]) -> DataFrame:
    """True and false positives and negatives per group (Q03)."""
    hit = lambda t, p: F.count_if((F.col("truth") == t) & (F.col("predicted") == p))
    return rows.groupBy(*by).agg(hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"), hit(0, 0).alias("tn"))


def rates(counts: DataFrame, least: float = 0.9) -> DataFrame:
    """Recall and precision, null where undefined, and whether both reach ``least`` (Q04)."""
    recall = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn")))
    precision = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp")))
    return counts.withColumn("recall", recall).withColumn("precision", precision).withColumn("passes", F.coalesce((F.col("recall") >= least) & (F.col("precision") >= least), F.lit(False)))


def wilson(k: Column, n: Column) -> tuple[Column, Column]:
    """95 % Wilson interval of a share, clamped to [0, 1]; null for n = 0 (Q05)."""
    p, z2 = k / n, Z * Z
    middle = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = Z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return F.when(n > 0, F.greatest(middle - half, F.lit(0.0))), F.when(n > 0, F.least(middle + half, F.lit(1.0)))


def latency(rows: DataFrame, by: list[str], limit: float) -> DataFrame:
    """Detection latency: detected, within the limit, median, greatest (Q06)."""
    return rows.groupBy(*by).agg(F.count("latency").alias("n"), F.count_if(F.col("latency") <= limit).alias("within"), F.expr("percentile(latency, 0.5)").alias("median"), F.max("latency").alias("most"))


def accuracy_m3(rows: DataFrame, by: list[str]) -> DataFrame:
    """Members right and pattern right, among the detected (Q07)."""
    seen = F.col("detected")
    return rows.groupBy(*by).agg((F.count_if(seen & F.col("members_ok")) / F.nullif(F.count_if(seen), F.lit(0))).alias("members"), (F.count_if(seen & F.col("pattern_ok")) / F.nullif(F.count_if(seen), F.lit(0))).alias("pattern"))


def completeness(problems: DataFrame, fields: list[str]) -> DataFrame:
    """How many problems lack each field, and how many lack none (Q08)."""
    lacks = problems.select(*[F.col(f).isNull().cast("int").alias(f) for f in fields])
    total = lacks.agg(F.count("*").alias("problems"), F.count_if(sum(F.col(f) for f in fields) == 0).alias("complete"), *[F.sum(f).alias(f) for f in fields])
    return total.unpivot(["problems", "complete"], fields, "field", "missing")


def verdict(checks: DataFrame, by: list[str]) -> DataFrame:
    """A group passes if all its checks do (Q09)."""
    return checks.groupBy(*by).agg(F.bool_and("passes").alias("passes"), F.count("*").alias("checks"), F.count_if(~F.col("passes")).alias("failed"))


def finding_cycle(findings: DataFrame, cycles: DataFrame, slot: int = 3600) -> DataFrame:
    """The cycle whose interval holds a finding, else the last that began before it (Q11).

    As-of by a union of both sides in time order, with the last cycle carried on: no range
    join, and a database's history may lie in several tasks. Of cycles that begin together
    the one of the largest id counts.
    """
    marks = cycles.select("db_id", F.col("c0").alias("at"), F.lit(0).alias("kind"), F.col("cycle_id"), F.col("c1"), F.lit(None).cast("long").alias("detection_id"))
    asks = findings.select("db_id", F.col("s").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("cycle_id"), F.lit(None).cast("long").alias("c1"), "detection_id")
    last = F.when(F.col("kind") == 0, F.struct("cycle_id", "c1"))
    found = carried(marks.unionByName(asks), ["db_id"], ["at", "kind", "cycle_id"], {"c": ("last", last)}).filter("kind = 1")
    return found.select("detection_id", F.col("c.cycle_id").alias("cycle_id"), F.coalesce(F.col("at") <= F.col("c.c1"), F.lit(False)).alias("inside"))


def eval_windows(truth: DataFrame, detected: DataFrame, key: list[str]) -> DataFrame:
    """Windows that were true, detected, both, or detected falsely (Q12)."""
    both = truth.select(*key).distinct().withColumn("t", F.lit(True)).join(detected.select(*key).distinct().withColumn("d", F.lit(True)), key, "full_outer")
    t, d = F.coalesce("t", F.lit(False)), F.coalesce("d", F.lit(False))
    return both.groupBy(key[0]).agg(F.count_if(t & d).alias("both"), F.count_if(t & ~d).alias("missed"), F.count_if(~t & d).alias("false"))


def quality_summary(rows: DataFrame) -> DataFrame:
    """Recall and false positives by role, by category and in all, with rates, intervals and a histogram of latencies (Q15).

    ``rows(role, category, truth, predicted, valid, latency)``: ``valid`` tells cases whose
    injection took effect, ``latency`` counts windows until the detection. Recall is over all
    true cases and over the valid ones, false positives over all that are not true; rates
    without cases are null. ``latencies`` lists "windows:cases" of those detected, in order.
    """
    true, hit = F.col("truth") == 1, F.col("predicted") == 1
    grouped = rows.cube("role", "category").agg(
        F.grouping_id().cast("long").alias("level"), F.count("*").alias("n"), F.count_if(true).alias("positives"), F.count_if(true & hit).alias("tp"), F.count_if(~true & hit).alias("fp"),
        F.count_if(true & F.col("valid")).alias("valid"), F.count_if(true & hit & F.col("valid")).alias("valid_tp"), F.array_sort(F.collect_list(F.when(true & hit, F.col("latency")))).alias("l"),
    )
    share = lambda k, n: F.when(F.col(n) > 0, F.col(k) / F.col(n))
    rated = grouped.withColumn("negatives", F.col("n") - F.col("positives"))
    low, high = wilson(F.col("tp"), F.col("positives"))
    counted = F.transform(F.array_distinct("l"), lambda x: F.concat(x.cast("string"), F.lit(":"), F.size(F.filter("l", lambda y: y == x)).cast("string")))
    return rated.select(
        "role", "category", "level", "n", "tp", "fp", share("tp", "positives").alias("recall"), low.alias("recall_low"), high.alias("recall_high"), share("valid_tp", "valid").alias("valid_recall"), share("fp", "negatives").alias("fp_rate"),
        F.array_join(counted, ",").alias("latencies"),
    )


def process_key(df: DataFrame, pids: str = "pids") -> DataFrame:
    """``df(db_id, pids)`` with ``key``: the database and its processes in order, each once; null where none is known."""
    known = F.array_sort(F.array_distinct(F.filter(pids, lambda p: p.isNotNull())))
    return df.withColumn("key", F.when(F.size(known) > 0, F.concat(F.coalesce("db_id", F.lit("")), F.lit("|"), F.array_join(F.transform(known, lambda p: p.cast("string")), ","))))


def match_once(left: DataFrame, right: DataFrame, within: int) -> DataFrame:
    """One-to-one pairs of ``left(key, l_id, l_s)`` and ``right(key, r_id, r_s)`` at most ``within`` seconds apart (Q16).

    The nearest pair goes first (ties by ids), then the nearest of the rows still free, until
    no two free rows are near. ``key`` names what must be equal: the database, the victim
    where it is known, or the set of processes (``process_key``). Rows with a null key or time
    match nothing.

    No pair reaches over a silence of more than ``within``, so a key's rows in time order are
    cut there into islands (carried scans: a long history lies in many tasks). Within an
    island the nearest pair is always of neighbouring times, so each island is settled in one
    pass with a queue of neighbours, without making all its pairs and without rounds.
    """
    rows = left.select("key", F.col("l_s").cast("long").alias("at"), F.lit(0).alias("side"), F.col("l_id").cast("long").alias("id")).unionByName(
        right.select("key", F.col("r_s").cast("long").alias("at"), F.lit(1).alias("side"), F.col("r_id").cast("long").alias("id"))
    ).filter("key is not null and at is not null")
    order = ["at", "side", "id"]
    apart = with_previous(rows, ["key"], order, ["at"]).withColumn("apart", F.coalesce((F.col("at") - F.col("previous.at") > within).cast("long"), F.lit(1).cast("long"))).drop("previous")
    islands = carried(apart, ["key"], order, {"island": ("sum", F.col("apart"))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held = None, []
        for batch in batches:
            out: list[tuple[int, int, int]] = []
            for key, island, at, side, n in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if (key, island) != here:
                    out += nearest_pairs(held, within)
                    here, held = (key, island), []
                held.append((at, side, n))
            yield _pairs_batch(out)
        yield _pairs_batch(nearest_pairs(held, within))

    whole = islands.select("key", "island", *order)
    return whole.repartition("key", "island").sortWithinPartitions("key", "island", *order).mapInArrow(run, "l_id long, r_id long, gap long")


def _pairs_batch(pairs: list[tuple[int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in range(3)], ["l_id", "r_id", "gap"])


def nearest_pairs(rows: list[tuple[int, int, int]], within: int) -> list[tuple[int, int, int]]:
    """``(left id, right id, gap)`` of ``rows(time, side, id)`` in time order, the nearest pair first, ties by ids.

    Rows of one time are one place. Only neighbouring places can hold the nearest pair; when
    a place is used up its neighbours become neighbours.
    """
    places: list[tuple[int, list[int], list[int]]] = []
    for at, side, n in rows:
        if not places or places[-1][0] != at:
            places.append((at, [], []))
        places[-1][1 + side].append(n)
    for _, ls, rs in places:
        ls.sort(reverse=True)
        rs.sort(reverse=True)
    before, after = list(range(-1, len(places) - 1)), list(range(1, len(places) + 1))
    queue: list[tuple[int, int, int, int, int]] = []

    def ask(i: int, j: int) -> None:
        """Put the pairs that places i and j hold now into the queue."""
        if 0 <= i and j < len(places):
            gap = places[j][0] - places[i][0]
            if gap <= within:
                for a, b in {(i, j), (j, i)}:
                    if places[a][1] and places[b][2]:
                        heapq.heappush(queue, (gap, places[a][1][-1], places[b][2][-1], a, b))

    for i in range(len(places)):
        ask(i, i)
        ask(i, i + 1)
    out = []
    while queue:
        gap, left, right, a, b = heapq.heappop(queue)
        if not (places[a][1] and places[b][2] and places[a][1][-1] == left and places[b][2][-1] == right):
            continue
        out.append((places[a][1].pop(), places[b][2].pop(), gap))
        for i in {a, b}:
            if places[i][1] or places[i][2]:
                ask(i, i)
                ask(before[i], i)
                ask(i, after[i])
            else:
                p, n = before[i], after[i]
                if p >= 0:
                    after[p] = n
                if n < len(places):
                    before[n] = p
                ask(p, n)
    return out


def case_summary(rows: DataFrame, case: str, outcome: str, outcomes: list[str], found: list[str]) -> DataFrame:
    """Per case: rows of each outcome, share and interval of those ``found``, their latencies, and whether all have evidence (Q17).

    ``rows`` also has ``latency`` and ``evidence_ok``. Without found rows latencies are null and
    the evidence is not ok.
    """
    hit = F.col(outcome).isin(*found)
    counted = rows.withColumn("l", F.when(hit, F.col("latency"))).groupBy(case).agg(
        *[F.count_if(F.col(outcome) == o).alias(o) for o in outcomes], F.count("*").alias("n"), F.count_if(hit).alias("found"), F.expr("percentile(l, 0.5)").alias("median_latency"), F.max("l").alias("most_latency"),
        F.coalesce(F.bool_and(F.when(hit, F.coalesce("evidence_ok", F.lit(False)))), F.lit(False)).alias("evidence_ok"),
    )
    low, high = wilson(F.col("found"), F.col("n"))
    return counted.select(case, *outcomes, "n", (F.col("found") / F.col("n")).alias("rate"), low.alias("rate_low"), high.alias("rate_high"), "median_latency", "most_latency", "evidence_ok")


def phase_check(counted: DataFrame, captured: DataFrame, reported: DataFrame, key: list[str]) -> DataFrame:
    """Does the engine's counter agree with what was captured and reported? (Q18)"""
    n = lambda df, name: df.groupBy(*key).agg(F.count("*").alias(name))
    joined = counted.join(n(captured, "captured"), key, "left").join(n(reported, "reported"), key, "left").na.fill(0, ["captured", "reported"])
    return joined.withColumn("agrees", (F.col("counted") == F.col("captured")) & (F.col("captured") >= F.col("reported")))


def scenario_compare(expected: DataFrame, obtained: DataFrame, key: list[str]) -> DataFrame:
    """Per key: same, missing, extra or different between two tables of ``(*key, value)`` (Q19)."""
    joined = expected.withColumnRenamed("value", "want").join(obtained.withColumnRenamed("value", "got"), key, "full_outer")
    state = F.when(F.col("got").isNull(), "missing").when(F.col("want").isNull(), "extra").when(F.col("want") == F.col("got"), "same").otherwise("different")
    return joined.select(*key, state.alias("outcome"))


def source_coverage(plans: DataFrame) -> DataFrame:
    """Per label: share of rows with each plan source, and the median cost (Q20)."""
    return plans.groupBy("label").agg(*[F.avg((F.col("source") == s).cast("double")).alias(s) for s in ("paired", "sample", "none")], F.expr("percentile(cost, 0.5)").alias("median_cost"))


def accuracy_matrix(rows: DataFrame, kinds: list[str]) -> DataFrame:
    """Predicted against actual access, per group (Q21)."""
    return rows.groupBy("grp", "actual").pivot("predicted", kinds).count().na.fill(0)


def round_robin(df: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """The first ``n`` rows taken in turn from each group (Q22)."""
    turn = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return df.withColumn("turn", turn).filter(F.col("turn") <= n).orderBy("turn", group).limit(n)


def likert(answers: DataFrame) -> DataFrame:
    """Mean, least and number of fives per statement (Q23)."""
    return answers.groupBy("statement").agg(F.avg("score").alias("mean"), F.min("score").alias("least"), F.count_if(F.col("score") == 5).alias("fives"))


def poll_rates(polls: DataFrame, by: list[str]) -> DataFrame:
    """Share of polls that held the execution, median age (Q27)."""
    return polls.groupBy(*by).agg(F.avg(F.col("found").cast("double")).alias("share"), F.expr("percentile(age, 0.5)").alias("median_age"), F.count("*").alias("polls"))


def eval_degradation(met: DataFrame, told: DataFrame, grace_s: int) -> DataFrame:
    """Per fingerprint: was the first finding before the rule was first met, in time, late, or missing? (Q13)

    ``met(db_id, query_id, at_s)`` are windows in which the rule holds, ``told`` the findings.
    """
    key = ["db_id", "query_id"]
    a, b = met.groupBy(*key).agg(F.min("at_s").alias("met_s")), told.groupBy(*key).agg(F.min("at_s").alias("told_s"))
    state = (
        F.when(F.col("met_s").isNull(), "not met").when(F.col("told_s").isNull(), "missed").when(F.col("told_s") < F.col("met_s"), "before")
        .when(F.col("told_s") <= F.col("met_s") + grace_s, "in time").otherwise("late")
    )
    return a.join(b, key, "full_outer").select(*key, state.alias("outcome"))


def eval_n1(truth: DataFrame, found: DataFrame) -> DataFrame:
    """Per child query: windows with an N+1, found with the right parent, with another, and stray findings (Q14)."""
    key = ["db_id", "captured_at", "child_id"]
    t, f = truth.select(*key, F.col("parent_id").alias("want")), found.select(*key, F.col("parent_id").alias("got"))
    both = t.join(f, key, "full_outer")
    return both.groupBy("child_id").agg(
        F.count("want").alias("windows"), F.count_if(F.col("want") == F.col("got")).alias("right_parent"), F.count_if(F.col("want") != F.col("got")).alias("other_parent"), F.count_if(F.col("want").isNull()).alias("stray")
    )


def archive_projection(sections: dict[str, DataFrame], ids: DataFrame) -> DataFrame:
    """Chosen fingerprints in archived snapshots: counters added up per message, membership among the candidates, scans of their plans (Q24).

    ``sections`` are those of ``ingest_snapshots``. Messages without a chosen statement have no
    row; ``candidates`` counts chosen ids among the top queries, ``scans`` the scan operations
    of chosen ids' plans, ``full_scans`` those that read everything.
    """
    chosen = lambda name: sections[name].join(ids, "query_id", "left_semi")
    counters = chosen("statements").groupBy("msg_id").agg(F.sum("execution_count").alias("calls"), F.count("*").alias("rows"))
    top = chosen("top_impact_queries").groupBy("msg_id").agg(F.count_distinct("query_id").alias("candidates"))
    ops = chosen("canonic_explains").select("msg_id", F.explode("canonical_plan.physical_operations").alias("o")).filter("o.type = 'scan'")
    scans = ops.groupBy("msg_id").agg(F.count("*").alias("scans"), F.count_if(F.col("o.access_method").isin("full_table_scan", "full_index_scan")).alias("full_scans"))
    joined = counters.join(top, "msg_id", "left").join(scans, "msg_id", "left")
    return joined.select("msg_id", "calls", "rows", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("candidates", "scans", "full_scans")])


def plan_agreement(ops: DataFrame, executions: DataFrame, key: str) -> DataFrame:
    """Share of plans, by source and kind and by source alone, whose operations are those of the slowest execution's plan (Q25).

    ``ops(plan_id, pos, type, access, index_name)``; ``executions(plan_id, key, source, kind, time_ms)``.
    ``level`` is 0 for source and kind, 1 for the source alone.
    """
    signature = F.to_json(F.array_sort(F.collect_list(F.struct("pos", "type", "access", "index_name"))))
    signed = ops.groupBy("plan_id").agg(signature.alias("signature"))
    each = executions.join(signed, "plan_id")
    slowest = each.groupBy(key).agg(F.max_by("signature", F.struct("time_ms", "plan_id")).alias("reference"))
    grouped = each.join(slowest, key).groupingSets([[F.col("source"), F.col("kind")], [F.col("source")]], F.col("source"), F.col("kind"))
    return grouped.agg(F.grouping_id().cast("long").alias("level"), F.avg((F.col("signature") == F.col("reference")).cast("double")).alias("agreement"), F.count("*").alias("plans"))


def lost_conditions(raw: DataFrame, ops: DataFrame, key: list[str], kinds: list[str]) -> DataFrame:
    """Conditions of a raw plan node that its flattened operation does not hold, by kind (Q26)."""
    long = raw.unpivot(key, kinds, "kind", "condition").filter("condition is not null")
    joined = long.join(ops.select(*key, "predicate"), key, "left")
    return joined.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(~F.coalesce(F.col("predicate").contains(F.col("condition")), F.lit(False))).alias("lost"))
