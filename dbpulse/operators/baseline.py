"""Degradation of a query against its own history, and ranking of findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rounds import written

SEVERITIES = ["high", "medium", "low"]


def severity_rank(column: str = "severity"):
    return F.when(F.col(column) == "high", 0).when(F.col(column) == "medium", 1).when(F.col(column) == "low", 2).otherwise(3)


def baseline_degradation(
    windows: DataFrame, min_calls: int = 5, baseline: int = 60, ratio: float = 2.0, plus_ms: float = 10.0, high_ms: float = 10_000, medium_ms: float = 1_000
) -> DataFrame:
    """AP-01: valid windows whose mean is ``ratio`` times and ``plus_ms`` over the median of the
    ``baseline`` valid windows before. The window itself is never in its own baseline."""
    frame = Window.partitionBy("db_id", "query_id").orderBy("captured_at").rowsBetween(-baseline, -1)
    valid = windows.filter(F.col("calls") >= min_calls)
    judged = valid.withColumn("baseline_ms", F.expr("percentile(mean_ms, 0.5)").over(frame)).withColumn("n", F.count("mean_ms").over(frame))
    slower = judged.filter((F.col("n") == baseline) & (F.col("baseline_ms") > 0)).filter(
        (F.col("mean_ms") >= ratio * F.col("baseline_ms")) & (F.col("mean_ms") - F.col("baseline_ms") >= plus_ms)
    )
    extra = (F.col("mean_ms") - F.col("baseline_ms")) * F.col("calls")
    return slower.select(
        "db_id", "query_id", "captured_at", "calls", "mean_ms", "baseline_ms", extra.alias("impact_ms"),
        F.when(extra >= high_ms, "high").when(extra >= medium_ms, "medium").otherwise("low").alias("severity"),
    )


def _order(*last) -> list:
    return [F.coalesce("impact_ms", F.lit(0)).desc(), severity_rank(), F.col("rule").asc_nulls_last(), "finding_key", *last]


def prioritize(findings: DataFrame) -> DataFrame:
    """A total order: impact (null counts 0, stays null), severity, rule (nulls last), key."""
    return findings.orderBy(*_order())


def places(findings: DataFrame, *last) -> DataFrame:
    """Every finding with its ``place`` (from 1) in that order, ties by ``last``.

    Findings are sorted in ranges, numbered within each, and each range starts where the one
    before it ends; only the ranges' sizes, one row for each, go to all tasks.
    """
    within = 1 << 33  # what the numbering leaves for the rows of one range
    numbered = written(findings.orderBy(*_order(*last)).withColumn("__id", F.monotonically_increasing_id()))
    numbered = numbered.withColumn("__range", F.floor(F.col("__id") / within)).withColumn("__nth", F.col("__id") % within)
    sizes = numbered.groupBy("__range").agg(F.count("*").alias("n"))
    starts = sizes.select("__range", F.coalesce(F.sum("n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    placed = numbered.join(F.broadcast(starts), "__range").withColumn("place", F.col("__start") + F.col("__nth") + 1)
    return placed.drop("__id", "__range", "__nth", "__start")
