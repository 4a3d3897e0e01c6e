"""Counter differencing: cumulative counters of statement snapshots become measured windows.

Window functions are partitioned by database and fingerprint, so one busy database is spread
over as many tasks as it has fingerprints; series of a whole database are carried scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .carried import with_previous

KEY = ["db_id", "query_id"]
COUNTERS = ["execution_count", "total_time_ms", "rows_returned", "disk_spill_indicator", "sort_merge_passes"]


def _series() -> Window:
    return Window.partitionBy(*KEY).orderBy("captured_at")


def _before(column: str) -> Column:
    return F.lag(column).over(_series())


def seconds_between(early: Column | str, late: Column | str) -> Column:
    early, late = (F.col(c) if isinstance(c, str) else c for c in (early, late))
    return F.unix_seconds(late.cast("timestamp")) - F.unix_seconds(early.cast("timestamp"))


def merge_counters(st: DataFrame, order: str = "part") -> DataFrame:
    """Rows that repeat a fingerprint in one snapshot become one: counters are added (null
    where all are null), the epoch is that of the first row."""
    return st.groupBy(*KEY, "captured_at").agg(*[F.sum(c).alias(c) for c in COUNTERS], F.min_by("counters_epoch", order).alias("counters_epoch"))


def drop_idle(st: DataFrame) -> DataFrame:
    """Without samples that have the calls of the sample before and the same or no epoch."""
    known = F.last("counters_epoch", ignorenulls=True).over(_series().rowsBetween(Window.unboundedPreceding, -1))
    same = (F.col("execution_count") == _before("execution_count")) & (F.col("counters_epoch").isNull() | known.isNull() | (F.col("counters_epoch") == known))
    marked = st.withColumn("__idle", F.coalesce(same, F.lit(False))).withColumn("__known", F.coalesce("counters_epoch", known))
    return marked.filter("not __idle").withColumn("counters_epoch", F.col("__known")).drop("__idle", "__known")


def _reset() -> Column:
    """Has the epoch changed since the last sample that had one? An unknown epoch is no reset and hides none."""
    known = F.last("counters_epoch", ignorenulls=True).over(_series().rowsBetween(Window.unboundedPreceding, -1))
    return F.coalesce(F.col("counters_epoch") != known, F.lit(False))


def delta_windows(st: DataFrame) -> DataFrame:
    """Calls, time and mean since the sample before; null after a reset, without calls or with time running back."""
    w = st.select(
        *KEY, "captured_at", _before("captured_at").alias("window_start"), _reset().alias("reset"),
        (F.col("execution_count") - _before("execution_count")).alias("calls"), (F.col("total_time_ms") - _before("total_time_ms")).alias("time_ms"),
    )
    ok = ~F.col("reset") & (F.col("calls") > 0) & (F.col("time_ms") >= 0)
    kept = [F.when(ok, F.col(c)).alias(c) for c in ("calls", "time_ms")]
    return w.select(*KEY, "captured_at", "window_start", *kept).withColumn("mean_ms", F.col("time_ms") / F.col("calls"))


def window_history(windows: DataFrame, n: int = 90, min_calls: int = 5) -> DataFrame:
    """Of each valid window (at least ``min_calls``): means and ends of the last ``n`` valid windows, itself included."""
    valid = windows.filter(F.col("calls") >= min_calls)
    frame = _series().rowsBetween(-(n - 1), 0)
    return valid.select(*KEY, "captured_at", F.collect_list("mean_ms").over(frame).alias("means"), F.collect_list("captured_at").over(frame).alias("ends"))


def _admitted(new_within: int) -> Column:
    """Is a fingerprint's first sample to count whole? If its epoch is at most ``new_within``
    seconds before the capture, or after the database's snapshot before."""
    fresh = seconds_between("counters_epoch", "captured_at") <= new_within
    return F.coalesce(fresh | (F.col("counters_epoch") > F.col("db_before")), F.lit(False))


def _with_db_before(st: DataFrame) -> DataFrame:
    """The database's snapshot before each capture, from its distinct captures (small)."""
    captures = st.select("db_id", "captured_at").distinct()
    before = captures.withColumn("db_before", F.lag("captured_at").over(Window.partitionBy("db_id").orderBy("captured_at")))
    return st.join(before, ["db_id", "captured_at"])


def rows_windows(st: DataFrame, new_within: int = 10) -> DataFrame:
    """Calls, rows and time since the sample before (``window_start``); a new fingerprint counts whole if admitted; nothing after a reset.

    ``time_ms`` is null where the time is unknown or ran back.
    """
    st = _with_db_before(st)
    first = _before("captured_at").isNull()
    time = F.when(first, F.col("total_time_ms")).otherwise(F.col("total_time_ms") - _before("total_time_ms"))
    w = st.select(
        *KEY, "captured_at", _before("captured_at").alias("window_start"), F.when(time >= 0, time).alias("time_ms"), first.alias("is_new"), _reset().alias("reset"), _admitted(new_within).alias("admitted"),
        F.when(first, F.col("execution_count")).otherwise(F.col("execution_count") - _before("execution_count")).alias("calls"),
        F.when(first, F.col("rows_returned")).otherwise(F.col("rows_returned") - _before("rows_returned")).alias("rows"),
    )
    ok = ~F.col("reset") & (~F.col("is_new") | F.col("admitted")) & (F.col("calls") > 0) & (F.col("rows") >= 0)
    return w.filter(ok).select(*KEY, "captured_at", "window_start", "is_new", "calls", "rows", "time_ms")


def spill_windows(st: DataFrame, new_within: int = 10) -> DataFrame:
    """Spill indicators since the sample before, each by itself; null where it cannot be measured."""
    st = _with_db_before(st)
    first = _before("captured_at").isNull()
    new = first & _admitted(new_within)

    def since(name):
        moved = F.when(first, F.when(new, F.col(name))).when(~_reset(), F.col(name) - _before(name))
        return moved

    w = st.select(*KEY, "captured_at", since("execution_count").alias("calls"), since("total_time_ms").alias("time_ms"), since("disk_spill_indicator").alias("spill"), since("sort_merge_passes").alias("merges"))
    return w.filter("calls >= 0").select(*KEY, "captured_at", "calls", "time_ms", *[F.when(F.col(c) >= 0, F.col(c)).alias(c) for c in ("spill", "merges")])


def activity_windows(st: DataFrame) -> DataFrame:
    """Permissive: a first sighting or a reset counts whole; windows without calls are left out."""
    whole = _before("captured_at").isNull() | _reset() | (F.col("execution_count") < _before("execution_count"))
    calls = F.when(whole, F.col("execution_count")).otherwise(F.col("execution_count") - _before("execution_count"))
    time = F.when(whole, F.col("total_time_ms")).otherwise(F.col("total_time_ms") - _before("total_time_ms"))
    return st.select(*KEY, "captured_at", calls.alias("calls"), time.alias("time_ms"), whole.alias("whole")).filter("calls > 0")


def segment_by_gap(st: DataFrame, hours: float = 24) -> DataFrame:
    """Numbers the stretches of a fingerprint's samples; a gap of more than ``hours`` starts a new one."""
    gap = F.coalesce((seconds_between(_before("captured_at"), F.col("captured_at")) > hours * 3600).cast("long"), F.lit(0).cast("long"))
    marked = st.withColumn("__gap", gap)
    return marked.withColumn("segment", F.sum("__gap").over(_series().rowsBetween(Window.unboundedPreceding, 0))).drop("__gap")


def stats_fresh(s: DataFrame, least_seconds: int = 1800) -> DataFrame:
    """Are statistics younger than ``least_seconds``? False where neither start nor reset is known."""
    since = F.greatest("server_start_time", "stats_reset_time")
    return s.withColumn("fresh", F.coalesce(seconds_between(since, F.col("captured_at")) < least_seconds, F.lit(False)))


def counter_delta(df: DataFrame, value: str, mark: str, by: list[str], order: str) -> DataFrame:
    """Growth of a counter since the row before; after a reset (it fell, or ``mark`` changed) the value itself, a lower bound."""
    last = with_previous(df, by, [order], [value, mark])
    reset = F.coalesce((F.col(value) < F.col(f"previous.{value}")) | (F.col(mark) != F.col(f"previous.{mark}")), F.lit(False))
    grown = F.when(reset, F.col(value)).otherwise(F.col(value) - F.col(f"previous.{value}"))
    return last.withColumn("delta", grown).withColumn("reset", reset).drop("previous")


def log_growth(files: DataFrame) -> DataFrame:
    """``files(db_id, at_s, log_file, log_bytes)``: bytes added since the listing before; new or shrunk files count whole."""
    w = Window.partitionBy("db_id", "log_file").orderBy("at_s")
    before = F.lag("log_bytes").over(w)
    grown = F.when(before.isNull() | (F.col("log_bytes") < before), F.col("log_bytes")).otherwise(F.col("log_bytes") - before)
    return files.select("db_id", "at_s", grown.alias("grown")).groupBy("db_id", "at_s").agg(F.sum("grown").alias("grown_bytes"))


def cycle_samples(cycles: DataFrame, limit_bytes: int = 2 << 20) -> DataFrame:
    """Per cycle: deadlocks counted since the last, reset flag, log bytes, seconds, and whether the log outran its limit."""
    last = with_previous(cycles, ["db_id"], ["at_s"], ["deadlocks", "epoch", "at_s"])
    reset = F.coalesce((F.col("deadlocks") < F.col("previous.deadlocks")) | (F.col("epoch") != F.col("previous.epoch")), F.lit(False))
    grown = F.when(reset, F.col("deadlocks")).otherwise(F.col("deadlocks") - F.col("previous.deadlocks"))
    timed = last.select("db_id", "at_s", grown.alias("delta"), reset.alias("reset"), (F.col("at_s") - F.col("previous.at_s")).alias("seconds"))
    return timed.join(log_growth(cycles), ["db_id", "at_s"]).withColumn("overrun", F.col("grown_bytes") > limit_bytes)


def eviction_delta(checks: DataFrame) -> DataFrame:
    """``checks(db_id, at_s, evicted)``: rows where the eviction counter grew since the check before."""
    last = with_previous(checks, ["db_id"], ["at_s"], ["evicted"])
    return last.withColumn("evicted_since", F.col("evicted") - F.col("previous.evicted")).drop("previous").filter("evicted_since > 0")


def consecutive(samples: DataFrame, by: list[str], at: str = "at_s", most_seconds: int = 60) -> DataFrame:
    """One row per capture time, with whether it follows the one before within ``most_seconds``."""
    once = samples.dropDuplicates([*by, at])
    gap = F.col(at) - F.col(f"previous.{at}")
    return with_previous(once, by, [at], [at]).withColumn("follows", F.coalesce(gap <= most_seconds, F.lit(False))).drop("previous")
