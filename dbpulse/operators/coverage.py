"""Coverage: could each rule be evaluated on each snapshot, and if not, why?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SNAP = ["db_id", "captured_at"]


def section_reasons(sections: DataFrame, issues: DataFrame) -> DataFrame:
    """Failed sections with their issues' codes, or "unread" where none was noted."""
    failed = sections.filter("status = 'failed'").select(*SNAP, "section")
    return failed.join(issues.select(*SNAP, "section", "code").distinct(), [*SNAP, "section"], "left").select(*SNAP, "section", F.coalesce("code", F.lit("unread")).alias("reason"))


def statement_blind(sections: DataFrame, issues: DataFrame, blocking: list[str]) -> DataFrame:
    """Snapshots whose statements are unread, or empty with a blocking issue."""
    unread = sections.filter("section = 'statements' and status = 'failed'").select(*SNAP)
    empty = sections.filter("section = 'statements' and status = 'empty'").join(issues.filter(F.col("code").isin(*blocking)), SNAP, "left_semi").select(*SNAP)
    return unread.unionByName(empty).distinct()


def plan_coverage(candidates: DataFrame, plans: DataFrame) -> DataFrame:
    """Per snapshot: simple candidates with a plan, as none, some or all."""
    joined = candidates.join(plans.select("db_id", "query_id").distinct().withColumn("has", F.lit(1)), ["db_id", "query_id"], "left")
    n = joined.groupBy(*SNAP).agg(F.count("*").alias("n"), F.count("has").alias("planned"))
    return n.withColumn("coverage", F.when(F.col("planned") == 0, "none").when(F.col("planned") < F.col("n"), "some").otherwise("all"))


def baseline_ready(history: DataFrame, windows: int = 60) -> DataFrame:
    """Has any fingerprint of the database a full baseline?"""
    return history.groupBy("db_id").agg(F.max("n_windows").alias("most")).withColumn("state", F.when(F.col("most") >= windows, "evaluated").otherwise("partial"))


# Issue codes of the collection, by what they make impossible or uncertain.
NO_STATEMENTS = ["PERFORMANCE_SCHEMA_OFF", "MISSING_PG_READ_ALL_STATS"]
STALE_STATEMENTS = ["PS_CONSUMER_DISABLED"]
NO_PLANS = ["EXPLAIN_PERMISSION_DENIED", "EXPLAIN_FOREIGN_DB_CONNECT_DENIED", "EXPLAIN_FAILED", "EXPLAIN_PARAM_TYPES_AMBIGUOUS", "NO_EXPLAINABLE_CANDIDATES", "QUERY_TEXT_TRUNCATED"]
NO_REAL_ROWS = ["AUTO_EXPLAIN_LOG_UNAVAILABLE"]
NO_INDEX_USAGE = ["TRACK_COUNTS_OFF"]
NO_REPORTS, PARTIAL_REPORTS, NO_ROW_WAITS = ["DEADLOCK_REPORTS_UNAVAILABLE"], ["DEADLOCK_REPORTS_PARTIAL"], ["DEADLOCK_ROW_WAITS_UNLOGGED"]
NO_SESSIONS = ["MISSING_PROCESS_PRIVILEGE", "MISSING_PG_READ_ALL_STATS"]


def snapshots(sections: DataFrame, issues: DataFrame, facts: DataFrame) -> DataFrame:
    """One row per snapshot: what could not be read (``unread``), issue ``codes``, and its counts.

    ``facts(db_id, captured_at, n_statements, n_baseline, candidates, without_plan,
    q_candidates, q_without_plan, q_without_rows, fresh, foreign_keys)``.
    """
    unread = section_reasons(sections, issues).groupBy(*SNAP).agg(F.collect_set(F.struct("section", "reason")).alias("unread"))
    codes = issues.groupBy(*SNAP).agg(F.collect_set("code").alias("codes"))
    none = F.array().cast("array<struct<section:string,reason:string>>")
    joined = sections.select(*SNAP).distinct().join(unread, SNAP, "left").join(codes, SNAP, "left").join(facts, SNAP, "left")
    return joined.withColumn("unread", F.coalesce("unread", none)).withColumn("codes", F.coalesce("codes", F.array().cast("array<string>")))


def _sections(*names: str) -> Column:
    return F.transform(F.filter("unread", lambda r: r["section"].isin(*names)), lambda r: F.concat_ws("@", r["reason"], r["section"]))


def _codes(names: list[str]) -> Column:
    return F.filter("codes", lambda c: c.isin(*names))


def _told(when: Column, reason: str) -> Column:
    return F.when(when, F.array(F.lit(reason))).otherwise(F.array().cast("array<string>"))


def _or_else(first: Column, second: Column) -> Column:
    return F.when(F.size(first) > 0, first).otherwise(second)


def _only(when: Column, reasons: Column) -> Column:
    return F.when(F.coalesce(when, F.lit(False)), reasons).otherwise(F.array().cast("array<string>"))


def _state(code: str, blind: Column, partial: Column, discard: Column) -> Column:
    """A rule without a source is not evaluated, one with reasons for doubt is partial; findings go if a section it needs was unread."""
    is_blind, is_partial = F.size(blind) > 0, F.size(partial) > 0
    reasons = F.array_join(F.array_sort(F.array_distinct(F.when(is_blind, blind).otherwise(partial))), ",")
    state = F.when(is_blind, "not_evaluated").when(is_partial, "partial").otherwise("evaluated")
    return F.struct(F.lit(code).alias("code"), state.alias("state"), reasons.alias("signature"), (is_blind & discard).alias("discard"))


def _statements() -> tuple[Column, Column, Column]:
    """What blinds the rules on statements, what makes them partial, and whether their findings go."""
    stale = _codes(STALE_STATEMENTS)
    none = F.coalesce("n_statements", F.lit(0)) == 0
    return F.concat(_sections("statements"), _codes(NO_STATEMENTS), _only(none, stale)), _only(~none, stale), F.size(_sections("statements")) > 0


def _rows(snaps: DataFrame, states: list[Column]) -> DataFrame:
    return snaps.select(*SNAP, F.inline(F.array(*states)))


def _full_scan(code: str, needed: list[str], refining: tuple[str, ...] = ()) -> Column:
    blind, partial, discard = _statements()
    blind = F.concat(blind, _sections(*needed))
    reasons = _or_else(_codes(NO_PLANS), F.array(F.lit("NO_PLAN")))
    missing = F.col("without_plan") > 0
    blind = _or_else(blind, _only(missing & (F.col("without_plan") == F.col("candidates")), reasons))
    partial = F.concat(partial, _only(missing & (F.col("without_plan") < F.col("candidates")), reasons), *([_sections(*refining)] if refining else []))
    return _state(code, blind, partial, discard | (F.size(_sections(*needed)) > 0))


def full_scan_states(snaps: DataFrame) -> DataFrame:
    """AP-02, AP-03 and AP-04 (E05): the last also reads column types, without which it is partial."""
    return _rows(snaps, [_full_scan("AP-02", ["tables"]), _full_scan("AP-03", ["tables", "indexes"]), _full_scan("AP-04", ["tables", "indexes"], ("columns",))])


def ap_states(snaps: DataFrame) -> DataFrame:
    """AP-05 to AP-08 (E06): index usage and fresh statistics, foreign keys, real row counts."""
    blind, partial, discard = _statements()
    unreliable = F.concat(_sections("indexes", "server_start_timestamp", "foreign_keys"), _codes(NO_INDEX_USAGE))
    keys = _sections("foreign_keys")
    no_keys = _told(F.coalesce("foreign_keys", F.lit(0)) == 0, "NO_FOREIGN_KEYS")
    lost = F.col("q_without_plan") + F.col("q_without_rows")
    reasons = F.concat(_only(F.col("q_without_plan") > 0, _or_else(_codes(NO_PLANS), F.array(F.lit("NO_PLAN")))), _only(F.col("q_without_rows") > 0, _or_else(_codes(NO_REAL_ROWS), F.array(F.lit("NO_REAL_ROWS")))))
    every = (lost > 0) & (lost == F.col("q_candidates"))
    return _rows(snaps, [
        _state("AP-05", F.concat(blind, unreliable), F.concat(partial, _told(F.coalesce("fresh", F.lit(False)), "SHORT_STATS_WINDOW")), discard | (F.size(unreliable) > 0)),
        _state("AP-06", _or_else(F.concat(blind, keys), no_keys), partial, discard | (F.size(keys) > 0)),
        _state("AP-07", blind, partial, discard),
        _state("AP-08", _or_else(blind, _only(every, reasons)), F.concat(partial, _only(~F.coalesce(every, F.lit(False)), reasons)), discard),
    ])


def ct_states(snaps: DataFrame) -> DataFrame:
    """CT-01 to CT-05 (E07): are there reports, are they whole, do they tell rows apart; sessions for the last."""

    def deadlock(code: str, tells_rows: bool, *needed: str) -> Column:
        read = _sections(*needed) if needed else F.array().cast("array<string>")
        partial = F.concat(_codes(PARTIAL_REPORTS), _codes(NO_ROW_WAITS)) if tells_rows else _codes(PARTIAL_REPORTS)
        return _state(code, F.concat(_codes(NO_REPORTS), read), partial, F.size(read) > 0)

    unread = _sections("active_queries")
    cascade = _state("CT-05", F.concat(unread, _codes(NO_SESSIONS)), F.array().cast("array<string>"), F.size(unread) > 0)
    return _rows(snaps, [deadlock("CT-01", True), deadlock("CT-02", True), deadlock("CT-03", False), deadlock("CT-04", False, "indexes"), cascade])


def evaluate(snaps: DataFrame) -> DataFrame:
    """State, sorted reasons and discard flag of all 13 rules on every snapshot."""
    blind, partial, discard = _statements()
    first = _rows(snaps, [_state("AP-01", _or_else(blind, _told(F.coalesce("n_baseline", F.lit(0)) == 0, "BASELINE_BUILDING")), partial, discard)])
    return first.unionByName(full_scan_states(snaps)).unionByName(ap_states(snaps)).unionByName(ct_states(snaps))


def drop_unreliable(findings: DataFrame, states: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings that stay, and those that go because a source of their rule could not be read."""
    blind = states.filter("discard").select(*SNAP, "code")
    return findings.join(blind, [*SNAP, "code"], "left_anti"), findings.join(blind, [*SNAP, "code"], "left_semi")
