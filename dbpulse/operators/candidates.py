"""Candidate statements: those worth a closer look in each snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SNAPSHOT = ["db_id", "captured_at"]


def top_time(st: DataFrame, k: int = 10) -> DataFrame:
    """The first ``k`` of each snapshot by total time (ties by id)."""
    order = Window.partitionBy(*SNAPSHOT).orderBy(F.col("total_time_ms").desc_nulls_last(), "query_id")
    return st.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def unstable(st: DataFrame, variation: float = 2.0, mean_ms: float = 10.0) -> DataFrame:
    return st.filter((F.col("coeff_of_variation") > variation) & (F.col("mean_time_ms") > mean_ms))


def spilling(st: DataFrame) -> DataFrame:
    return st.filter((F.coalesce("disk_spill_indicator", F.lit(0)) > 0) | (F.coalesce("sort_merge_passes", F.lit(0)) > 0))


def candidates(st: DataFrame, k: int = 10) -> DataFrame:
    """The union of the three groups, a row per statement and snapshot with the sorted reasons."""
    key = [*SNAPSHOT, "query_id"]
    groups = [(top_time(st, k), "total_time"), (unstable(st), "unstable"), (spilling(st), "spill")]
    rows = [g.select(*key, F.lit(reason).alias("reason")) for g, reason in groups]
    union = rows[0].unionByName(rows[1]).unionByName(rows[2])
    return union.groupBy(*key).agg(F.array_sort(F.collect_set("reason")).alias("selected_by"))


def estimate_stddev(st: DataFrame) -> DataFrame:
    """Deviation guessed from the extremes: (max - mean) / sqrt(n); null for one call or a maximum over 1000 means."""
    usable = (F.col("execution_count") > 1) & (F.col("max_time_ms") <= 1000 * F.col("mean_time_ms"))
    guessed = st.withColumn("stddev_time_ms", F.when(usable, (F.col("max_time_ms") - F.col("mean_time_ms")) / F.sqrt("execution_count")))
    return guessed.withColumn("coeff_of_variation", F.when(F.col("mean_time_ms") > 0, F.col("stddev_time_ms") / F.col("mean_time_ms")))


def mark_ready(cands: DataFrame, executions: DataFrame) -> DataFrame:
    """Ready for a plan: has a sample text or a finished execution on record."""
    seen = executions.select("db_id", "query_id").distinct().withColumn("__seen", F.lit(True))
    return cands.join(seen, ["db_id", "query_id"], "left").withColumn("ready", F.coalesce("__seen", F.lit(False)) | F.col("has_sample")).drop("__seen")
