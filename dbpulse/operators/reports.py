"""Rankings, reports and rollups over problems, detections, evaluations and cycles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .baseline import severity_rank

PROBLEM = ["db_id", "rule", "finding_key"]


def fold_problems(detections: DataFrame) -> DataFrame:
    """One row per problem: the latest detection's values, first and last time, count."""
    latest = F.max_by(F.struct("severity", "impact_ms", "table_name", "evidence"), F.struct("detected_at", "detection_id")).alias("l")
    folded = detections.groupBy(*PROBLEM).agg(F.min("detected_at").alias("first_seen"), F.max("detected_at").alias("last_seen"), F.count("*").alias("n"), latest)
    return folded.select(*PROBLEM, "first_seen", "last_seen", "n", "l.*")


def findings_view(problems: DataFrame, detections: DataFrame) -> DataFrame:
    """Detections with their problem's attributes; evidence falls back on the problem's."""
    attributes = problems.select(*PROBLEM, "first_seen", "n", F.col("evidence").alias("problem_evidence"))
    joined = detections.join(attributes, PROBLEM)
    return joined.withColumn("evidence", F.coalesce("evidence", "problem_evidence")).drop("problem_evidence")


def fold_samples(samples: DataFrame, keep_hours: int = 24) -> DataFrame:
    """The newest sample of each fingerprint, without those older than ``keep_hours`` before the newest of all."""
    values = [c for c in samples.columns if c not in ("db_id", "query_id", "captured_at")]
    newest = samples.groupBy("db_id", "query_id").agg(F.max("captured_at").alias("captured_at"), F.max_by(F.struct(*values), "captured_at").alias("v"))
    end = samples.agg(F.max("captured_at").alias("end"))
    live = newest.crossJoin(F.broadcast(end)).filter(F.col("captured_at") >= F.col("end") - F.expr(f"interval '{keep_hours}' hour"))  # one row
    return live.select("db_id", "query_id", "captured_at", "v.*")


def fold_evaluation(evaluations: DataFrame) -> DataFrame:
    """Windows per database, rule, ten minutes, state and reason; when last seen."""
    return evaluations.groupBy("db_id", "code", "bucket_s", "state", "reason").agg(F.countDistinct("captured_at").alias("windows"), F.max("captured_at").alias("last_at"))


def purge(df: DataFrame, at: str, days: int) -> DataFrame:
    """Without rows more than ``days`` older than the newest."""
    end = df.agg(F.max(at).alias("__end"))
    return df.crossJoin(F.broadcast(end)).filter(F.col(at) >= F.col("__end") - F.expr(f"interval '{days}' day")).drop("__end")  # one row


def export_report(problems: DataFrame) -> DataFrame:
    """One JSON line per problem, for ``write.text`` or ``write.json``."""
    return problems.select(*PROBLEM, F.to_json(F.struct("severity", "n", "table_name")).alias("line"))


def worst_severity(column: str = "severity") -> Column:
    return F.min_by(column, severity_rank(column))


def session_findings(detections: DataFrame, since, top: int = 200) -> DataFrame:
    """Problems with detections since a time: counts since and in all, impact, worst severity; the first ``top``."""
    recent = F.col("detected_at") >= since
    rows = detections.groupBy(*PROBLEM).agg(
        F.count_if(recent).alias("n"), F.sum(F.when(recent, F.col("impact_ms"))).alias("impact_ms"), F.count("*").alias("n_total"),
        F.min(F.when(recent, severity_rank())).alias("rank"), F.max(F.when(recent, F.col("detected_at"))).alias("last_at"),
    ).filter("n > 0")
    ordered = rows.orderBy(F.coalesce("impact_ms", F.lit(0)).desc(), "rank", "rule", "finding_key", "db_id").limit(top)
    return ordered.withColumn("severity", F.element_at(F.array(*map(F.lit, ("high", "medium", "low"))), F.col("rank") + 1)).drop("rank")


def evaluation_summary(evaluations: DataFrame) -> DataFrame:
    """Per database and rule: the latest state, and windows of each state."""
    return evaluations.groupBy("db_id", "code").agg(
        F.max_by("state", F.struct("captured_at", "event_id")).alias("state"),
        *[F.count_if(F.col("state") == s).alias(s) for s in ("evaluated", "partial", "not_evaluated")],
        F.max("captured_at").alias("updated_at"),
    )


def overlay_failure(summary: DataFrame, health: DataFrame, catalog: DataFrame) -> DataFrame:
    """Where a database's last cycle failed, states older than it become not_evaluated; rules without a state too."""
    all_rules = health.select("db_id", "failed", "failed_at").crossJoin(F.broadcast(catalog))  # the catalog is a fixed list of rules
    joined = all_rules.join(summary, ["db_id", "code"], "left")
    hidden = F.col("state").isNull() | (F.col("failed") & (F.col("updated_at") < F.col("failed_at")))
    return joined.select("db_id", "code", F.when(hidden, "not_evaluated").otherwise(F.col("state")).alias("state"))


def applicable(states: DataFrame, engines: DataFrame, only_mysql=("CT-03", "CT-04")) -> DataFrame:
    """Rules that the database's engine does not have become not_applicable."""
    joined = states.join(engines, "db_id", "left")
    never = F.col("code").isin(*only_mysql) & (F.col("engine") == "postgres")
    return joined.withColumn("state", F.when(never, "not_applicable").otherwise(F.col("state"))).drop("engine")


def activity(detections: DataFrame) -> DataFrame:
    """Detections per hour."""
    return detections.groupBy("db_id", F.date_trunc("hour", "detected_at").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("n"))


def dense_activity(hourly: DataFrame, hours: int = 24) -> DataFrame:
    """The last ``hours`` hours of each database, empty ones with 0."""
    ends = hourly.groupBy("db_id").agg(F.max("hour").alias("end"))
    grid = ends.select("db_id", F.explode(F.expr(f"transform(sequence(0, {hours - 1}), i -> end - make_dt_interval(0, i, 0, 0))")).alias("hour"))
    return grid.join(hourly, ["db_id", "hour"], "left").select("db_id", "hour", F.coalesce("n", F.lit(0)).alias("n"))


def deadlock_quality(samples: DataFrame, captured: DataFrame, long_gap: int = 120) -> DataFrame:
    """Counted against captured deadlocks per database: missed, extra, resets, overruns, long gaps, captured by pattern.

    Where no growth of the counter is known, counted, missed and extra are null, not 0.
    """
    counted = samples.groupBy("db_id").agg(
        F.sum("delta").alias("counted"), F.count_if("reset").alias("resets"), F.count_if("overrun").alias("overruns"), F.count_if(F.col("seconds") > long_gap).alias("long_gaps")
    )
    each = captured.groupBy("db_id", "pattern").agg(F.count("*").alias("n"))
    seen = each.groupBy("db_id").agg(F.sum("n").alias("captured"), F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "pattern", "n"))), ",").alias("patterns"))
    joined = counted.join(seen, "db_id", "left").withColumn("captured", F.coalesce("captured", F.lit(0).cast("long"))).withColumn("patterns", F.coalesce("patterns", F.lit("")))
    over = lambda a, b: F.when(F.col("counted").isNotNull(), F.greatest(F.col(a) - F.col(b), F.lit(0)))
    return joined.withColumn("missed", over("counted", "captured")).withColumn("extra", over("captured", "counted"))


def range_report(detections: DataFrame, start, end, grace_s: int = 0) -> DataFrame:
    """Per problem detected in [start, end + grace): count, first and last time, worst and last severity, counts by severity, impact.

    ``grace_s`` seconds are for detections of what happened just before the end. Beside the
    range's figures stand those of the problem's whole life (``n_ever``, ``first_ever``). The
    impact is the sum of those known, null if none is. One shuffle: the range is a condition.
    """
    inside = (F.col("detected_at") >= start) & (F.col("detected_at") < end + F.make_interval(secs=F.lit(grace_s)))
    marked = detections.withColumn("__in", inside)
    within = lambda c: F.when(F.col("__in"), F.col(c) if isinstance(c, str) else c)
    found = marked.groupBy(*PROBLEM).agg(
        F.count_if("__in").alias("n"), F.min(within("detected_at")).alias("first_at"), F.max(within("detected_at")).alias("last_at"), F.min_by(within("severity"), within(severity_rank("severity"))).alias("worst"),
        F.max_by(within("severity"), within(F.struct("detected_at", "detection_id"))).alias("last_severity"), *[F.count_if(F.col("__in") & (F.col("severity") == s)).alias(f"n_{s}") for s in ("high", "medium", "low")],
        F.sum(within("impact_ms")).alias("impact_ms"), F.count("*").alias("n_ever"), F.min("detected_at").alias("first_ever"),
    )
    return found.filter("n > 0")


def range_evaluation(evaluations: DataFrame) -> DataFrame:
    """Per rule: windows of each state, the reason of the last window that was not evaluated, the final state."""
    at = F.struct("captured_at", "event_id")
    bad = F.col("state") != "evaluated"
    return evaluations.groupBy("db_id", "code").agg(
        *[F.count_if(F.col("state") == s).alias(s) for s in ("evaluated", "partial", "not_evaluated")],
        F.max_by(F.when(bad, F.col("reason")), F.when(bad, at)).alias("last_reason"), F.max_by("state", at).alias("final_state"),
    )


def outages(intervals: DataFrame, start: int, end: int) -> DataFrame:
    """Blocking issue intervals that overlap [start, end), clipped to it, per database and code."""
    over = intervals.filter((F.col("opened_s") < end) & (F.col("closed_s").isNull() | (F.col("closed_s") > start)))
    clipped = over.withColumn("from_s", F.greatest("opened_s", F.lit(start))).withColumn("to_s", F.least(F.coalesce("closed_s", F.lit(end)), F.lit(end)))
    return clipped.groupBy("db_id", "code").agg(
        F.min("from_s").alias("first_s"), F.max("to_s").alias("last_s"), F.bool_or(F.col("closed_s").isNull()).alias("still_open"), F.count("*").alias("cuts"), F.sum(F.col("to_s") - F.col("from_s")).alias("seconds")
    )


def report_summary(problems: DataFrame) -> DataFrame:
    """Problems and detections by severity, by rule and in all, in one pass."""
    grouped = problems.groupingSets([[F.col("severity")], [F.col("rule")], []], F.col("severity"), F.col("rule"))
    return grouped.agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("problems"), F.sum("n").alias("detections"))


def log_rates(samples: DataFrame, long_gap: int = 120) -> DataFrame:
    """Log throughput per database: mean and greatest bytes per second, greatest gap, cycles with long gaps."""
    timed = samples.filter("seconds > 0")
    return timed.groupBy("db_id").agg(
        (F.sum("grown_bytes") / F.sum("seconds")).alias("mean_rate"), F.max(F.col("grown_bytes") / F.col("seconds")).alias("max_rate"), F.max("seconds").alias("max_gap"), F.count_if(F.col("seconds") > long_gap).alias("long_cycles")
    )


def severity_counts(problems: DataFrame) -> DataFrame:
    """Problems per severity, unknown ones as "other" (R14)."""
    known = F.when(F.col("severity").isin("high", "medium", "low"), F.col("severity")).otherwise("other")
    return problems.groupBy(known.alias("severity")).agg(F.count("*").alias("n"))


def top_patterns(problems: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` rules with most problems, ties by name."""
    return problems.groupBy("rule").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "rule").limit(n)


def kpis(problems: DataFrame) -> DataFrame:
    """Per database: problems by severity and distinct affected tables."""
    return problems.groupBy("db_id").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("high", "medium", "low")], F.countDistinct("table_name").alias("tables"))


def issue_listing(intervals: DataFrame, since: int) -> DataFrame:
    """Issues open or closed since a time, open first, then severity, then recency."""
    worst = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    kept = intervals.filter(F.col("closed_s").isNull() | (F.col("closed_s") >= since))
    return kept.orderBy(F.col("closed_s").isNotNull(), worst, F.col("last_s").desc(), "db_id", "code")


def stale_runs(runs: DataFrame, now: int, seconds: int = 300) -> DataFrame:
    """Whether each database's last run is over ``seconds`` old."""
    return runs.groupBy("db_id").agg(F.max("at_s").alias("last_s")).withColumn("stale", F.lit(now) - F.col("last_s") > seconds)


def evaluated_share(states: DataFrame) -> DataFrame:
    """Evaluated rules among the applicable ones, per database."""
    return states.groupBy("db_id").agg(F.count_if(F.col("state") == "evaluated").alias("evaluated"), F.count_if(F.col("state") != "not_applicable").alias("applicable"), F.max("updated_at").alias("updated_at"))


def severity_breakdown(detections: DataFrame) -> DataFrame:
    """Text like "2 high, 1 low" per problem; null if all have one severity."""
    counts = detections.groupBy(*PROBLEM, "severity").agg(F.count("*").alias("c")).withColumn("r", severity_rank())
    parts = F.array_sort(F.collect_list(F.struct("r", F.concat_ws(" ", "c", "severity").alias("t"))))
    text = F.array_join(F.transform(parts, lambda p: p["t"]), ", ")
    return counts.groupBy(*PROBLEM).agg(parts.alias("parts")).select(*PROBLEM, F.when(F.size("parts") > 1, F.array_join(F.transform("parts", lambda p: p["t"]), ", ")).alias("breakdown"))


def health_report(samples: DataFrame, intervals: DataFrame, now: int, hour: int = 3600) -> DataFrame:
    """Per database: cycles, deadlocks and overruns of the last ``hour`` seconds, and open issues."""
    recent = samples.filter(F.col("at_s") >= now - hour).groupBy("db_id").agg(F.count("*").alias("cycles"), F.sum("delta").alias("deadlocks"), F.count_if("overrun").alias("overruns"), F.max("grown_bytes").alias("max_bytes"))
    opened = intervals.filter("closed_s is null").groupBy("db_id").agg(F.count("*").alias("open_issues"))
    return recent.join(opened, "db_id", "full_outer").na.fill(0, ["cycles", "overruns", "open_issues"])


def database_listing(registry: DataFrame, now: int) -> DataFrame:
    """State of each database's collection window: none, scheduled, running, finished or reported."""
    state = (
        F.when(F.col("from_s").isNull(), "none").when(F.col("from_s") > now, "scheduled").when(F.coalesce(F.col("to_s") > now, F.lit(True)), "running")
        .when(F.col("reported"), "reported").otherwise("finished")
    )
    return registry.withColumn("window_state", state)
